"""Exact duplicates by deterministic naming of text blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.llm.common import as_documents, cut, hot_hashes, is_hot, lower_ascii, salted_join

BLOCK = 4096
#: Buckets in which keys are sorted into names, and bits for the place within one.
BUCKETS, PLACE_BITS = 1 << 16, 40
_PLACE = ["doc_id", "sha", "left_", "idx"]


def _named(rows: DataFrame, keys: list[str], keep: list[str], some: DataFrame | None = None, total: Callable[[], int] | None = None) -> DataFrame:
    """`keep` and an integer name for each row, equal where all keys are equal and only there.

    The keys of a bucket are sorted, and a name is the bucket and the key's place in it. A hash picks the bucket, but
    equality rests on the keys themselves. Keys with over a thousandth of the rows, a thousand at most, are reduced to
    one row each by map-side aggregation, named in buckets above the others and broadcast to their rows, which are
    then dealt over the buckets without their keys, so that no task gets all rows of one key. some: the rows among which
    such keys are looked for, where others are known to have none; total: gives the number of all rows then.
    """
    some = rows if some is None else some
    hot = hot_hashes(some, keys, total=total)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))

    def names(offset: int) -> Column:
        place = F.dense_rank().over(W.partitionBy("_bucket").orderBy(*keys)).cast("long")
        return F.shiftleft(F.col("_bucket") + F.lit(offset), PLACE_BITS) + place

    if not hot:
        return rows.withColumn("_bucket", bucket).withColumn("name", names(0)).select(*keep, "name")
    few = some.where(is_hot(keys, hot)).select(*keys).distinct().withColumn("_bucket", bucket)
    few = few.select(*keys, names(BUCKETS).alias("_name"))
    rows = rows.join(F.broadcast(few), keys, "left")
    cold = F.col("_name").isNull()
    rows = rows.withColumn("_bucket", F.when(cold, bucket).otherwise(F.pmod(F.xxhash64(*keep), F.lit(BUCKETS))))
    rows = rows.select(*keep, "_name", "_bucket", *(F.when(cold, F.col(k)).alias(k) for k in keys))
    return rows.withColumn("name", F.coalesce("_name", names(0))).select(*keep, "name")


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """(doc_id, sha, left_, idx, block): each row's normalised text cut into blocks; the empty text has one empty block."""
    docs = docs.select("doc_id", lower_ascii(F.col("text")).alias("text"))
    blocks = F.when(F.length("text") <= block, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), blocks.alias("blocks"))
    return rows.select("doc_id", "sha", F.size("blocks").alias("left_"), F.posexplode("blocks").alias("idx", "block"))


def named_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, sha, left_, idx, name): each row's normalised text cut into blocks of `block` code points, and the blocks named.

    A text of one block can only be hot if many texts have its lengths, so a pass over lengths, which takes no
    lower-casing or hashing, leaves few texts to count and reduce.
    """
    sizes = ["chars", "octets"]
    docs = docs.select("doc_id", "text", F.length("text").alias("chars"), F.octet_length("text").alias("octets"))
    seen = Observation()
    often = hot_hashes(docs.observe(seen, F.sum(F.greatest(F.ceil(F.col("chars") / block), F.lit(1))).alias("blocks")), sizes)
    some = docs.where((F.col("chars") > block) | is_hot(sizes, often))
    return cut(_named(_blocks(docs, block), ["block"], _PLACE, _blocks(some, block), lambda: seen.get["blocks"]))


def identities(blocks: DataFrame) -> DataFrame:
    """(doc_id, sha, level, name): equal (level, name) exactly for equal normalised texts; one row per doc_id and text.

    Neighbouring names are paired and named again until each text has one. Only the naming of blocks shuffles text;
    the levels shuffle integers, half as many each time.
    """
    current, done, level = blocks, [], 0
    while True:
        done.append(current.where("left_ = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name").distinct())
        if (current.agg(F.max("left_")).first()[0] or 0) <= 1:
            break
        half = F.col("idx").bitwiseAND(1)
        pairs = current.where("left_ > 1").groupBy("doc_id", "sha", F.expr("(left_ + 1) div 2").cast("int").alias("left_"), F.expr("idx div 2").cast("int").alias("idx")).agg(F.max(F.when(half == 0, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("second"))
        current, level = cut(_named(pairs, ["first", "second"], _PLACE)), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row of `docs` with keep_id, group_size, kept and text_sha256; texts are equal if they are after lower-casing A-Z.

    keep_id is the largest doc_id of the group, and that row is kept. Null text counts as empty, null doc_id as less
    than any other (a group of those only has keep_id null and keeps one row). Of several rows with the kept doc_id,
    one is kept. An empty table gives no rows; columns other than doc_id and text aren't read.
    """
    blocks = named_blocks(as_documents(docs), block)
    ids = identities(blocks).withColumnsRenamed({"doc_id": "d", "sha": "s"})
    key = blocks.where("idx = 0").groupBy("doc_id", "sha").agg(F.count("*").alias("copies"))  # every row has a first block
    named = cut(key.join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s"))).select("doc_id", "sha", "copies", "level", "name"))
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    out = salted_join(named, groups, ["level", "name"], hot_hashes(named, ["level", "name"]), ["doc_id"])
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
