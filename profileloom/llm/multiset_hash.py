"""Document fingerprints: homomorphic hashes of the multiset of a text's paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.llm.common import as_documents, cut

#: A fingerprint is LANES sums modulo MODULUS; a paragraph adds a number from -128 to 127 to each.
LANES, MODULUS = 64, 1 << 16
#: Likeness is taken from the same sums modulo WIDE, which 16 million repeats of a paragraph don't wrap.
WIDE = 1 << 32
#: Paragraphs end at line ends and at the marks that end a sentence, which they include; no code point is left out.
PARAGRAPH = r"[^\n.!?;]+[\n.!?;]*|[\n.!?;]+"
#: Rows of a range of ids in which the next document is looked for, and the least number of ranges.
RANGE_ROWS, LEAST_RANGES = 100_000, 64


def _signed(x: Column) -> Column:
    return (F.pmod(x + F.lit(MODULUS // 2), F.lit(MODULUS)) - F.lit(MODULUS // 2)).cast("short")


def _signed_wide(x: Column) -> Column:
    return (F.pmod(x + F.lit(WIDE // 2), F.lit(WIDE)) - F.lit(WIDE // 2)).cast("int")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets, or (sign -1) of the first without the second: paragraphs go in and out by sums alone."""
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: _signed(p["x"].cast("int") + sign * p["y"].cast("int")))


def as_hex(lanes: Column) -> Column:
    """Four hex digits for each lane."""
    return F.array_join(F.transform(lanes, lambda v: F.lower(F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(MODULUS))), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal lanes, about 0 for texts without common paragraphs; lanes must not have wrapped.

    The lanes of a difference of multisets have a mean square in proportion to the sum of its squared counts, so
    1 - |a-b|^2 / (|a|^2 + |b|^2) estimates the share of common paragraphs, with an error of about 1/sqrt(LANES).
    """

    def squares(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))

    difference = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].cast("double") - p["y"].cast("double"))
    apart, both = squares(difference), squares(a) + squares(b)
    return F.when(apart == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / both)))


def fingerprint_lanes(texts: DataFrame, keys: list[str], wide: bool = False) -> DataFrame:
    """keys and lanes (array<short>; wide: array<int>) for rows (keys, text), one for each key; texts with one key are one multiset.

    Lanes of all paragraphs are summed by codegen'd aggregation; where texts are already dealt by the keys, no shuffle.
    """
    # a text without paragraphs (the empty one) must still give a row
    units = texts.select(*keys, F.explode_outer(F.regexp_extract_all(F.col("text"), F.lit(PARAGRAPH), F.lit(0))).alias("unit"))
    # the lane number seeds the hash of the text, so that texts that collide in one hash differ in the others
    hashes = [F.xxhash64(F.lit(k), "unit").alias(f"h{k}") for k in range(LANES // 8)]
    units = units.select(*keys, F.col("unit").isNotNull().cast("long").alias("one"), *hashes)
    lane = [F.sum(F.when(F.col("one") == 1, F.shiftrightunsigned(f"h{k // 8}", 8 * (k % 8)).bitwiseAND(255) - 128).otherwise(0)).alias(f"s{k}") for k in range(LANES)]
    return units.groupBy(*keys).agg(*lane).select(*keys, F.array(*((_signed_wide if wide else _signed)(F.col(f"s{k}")) for k in range(LANES))).alias("lanes"))


def next_rows(rows: DataFrame, n: int) -> DataFrame:
    """key and next_key for rows (key, doc_id), n of them: the next row by (doc_id, key), null ids first; the last row's is the first row.

    Rows are dealt into ranges of (doc_id, key), of RANGE_ROWS rows on average, so that equal and missing ids are split
    by key. Rows are ordered within ranges, and only the first row of each range over all ranges.
    """
    ranges = max(LEAST_RANGES, n // RANGE_ROWS)
    dealt = cut(rows.repartitionByRange(ranges, "doc_id", "key").withColumn("range", F.spark_partition_id()))
    inside = dealt.withColumn("next_key", F.lead("key").over(W.partitionBy("range").orderBy("doc_id", "key")))
    firsts = dealt.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key")).alias("first"))
    ahead = F.coalesce(F.lead("first").over(W.orderBy("range")), F.first("first").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)))
    firsts = firsts.select("range", ahead["key"].alias("ahead"))
    return inside.join(F.broadcast(firsts), "range").select("key", F.coalesce("next_key", "ahead").alias("next_key"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many of the next document's, by
    ascending doc_id. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null text counts as empty; null ids come first in the order; rows with the same id follow each other by a hash of
    the text, and repeated rows count as one document and give equal results; a lone document is its own next. An
    empty table gives no rows; columns other than doc_id and text aren't read. Texts are shuffled once by row, and
    the part that an edit needs once more.
    """
    docs = as_documents(docs)
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256))
    docs = docs.withColumn("key", key)
    rows = cut(docs.groupBy("key", "doc_id").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars")))
    # one row of each key; ranking drops repeated rows before the shuffle
    docs = docs.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("key"))).where("rank = 1").drop("rank")
    order = cut(next_rows(rows.select("key", "doc_id"), rows.count()))
    owners = order.join(rows, "key")
    heads = docs.select(F.col("key").alias("next_key"), "text")
    heads = heads.join(owners.select("key", "doc_id", "copies", "n_chars", "next_key"), "next_key")
    heads = heads.select("key", "doc_id", "copies", "n_chars", "next_key", F.expr("left(text, n_chars div 2)").alias("head"))
    whole = docs.select("key", "text").join(heads, "key")
    edited = F.concat(F.expr("left(text, n_chars - n_chars div 2)"), F.col("head"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("text")), F.struct(F.lit(1).alias("v"), edited.alias("text"))))
    texts = whole.select("key", "doc_id", "copies", "n_chars", "next_key", both.alias("t"))
    texts = texts.select("key", "doc_id", "copies", "n_chars", "next_key", "t.v", F.when(F.col("t.v") == 1, F.sha2("t.text", 256)).alias("sha"), "t.text")
    kept = ["key", "doc_id", "copies", "n_chars", "next_key", "v", "sha"]
    lanes = fingerprint_lanes(texts, kept, wide=True)
    by_key = cut(lanes.groupBy("key", "doc_id", "copies", "n_chars", "next_key").agg(F.max(F.when(F.col("v") == 0, F.col("lanes"))).alias("a"), F.max(F.when(F.col("v") == 1, F.col("lanes"))).alias("b"), F.max("sha").alias("edited_sha256")))
    ahead = by_key.select(F.col("key").alias("next_key"), F.col("a").alias("c"))
    out = by_key.join(ahead, "next_key").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select("doc_id", F.col("n_chars").cast("long"), "edited_sha256", as_hex(F.col("a")).alias("fingerprint"), as_hex(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
