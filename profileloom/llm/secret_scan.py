"""Secrets in texts, each distinct text scanned once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.llm.common import as_documents, cut, hot_hashes, salted_join

#: Part of every ledger key; a change of the patterns below must change it.
RULE_VERSION = "1"

#: Kind, pattern, capturing group whose length counts, least length of that group. The first three are
#: the base kinds; matches are leftmost and don't overlap within a kind.
KINDS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("userinfo", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@?#]{1,64}:([^\s/@?#]{1,128})@", 1, 3),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
BASE = ("assign", "access", "hex")
#: Matches whose lengths are summed up at a time.
RUN = 256
#: A plain search that any match of the pattern contains, to skip most texts.
_NEEDS = {"pem": "-----BEGIN ", "jwt": "eyJ", "userinfo": "://", "github": "gh", "access": "AKIA"}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often, or in which loops, it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, order: int) -> Column:
    """array of (start, kind order, end) of the kind's matches, in code points: match lengths and the lengths of the pieces between them.

    Lengths are summed up within runs of RUN matches and over the runs, so no list is copied once for each match.
    """
    kind, pattern, group, least = KINDS[order]
    # a run of hex digits under the least length can be passed over as such: what is left of it can't match
    pattern = "[0-9a-f]{24,}" if kind == "hex" else pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    zero, span = F.lit(0).cast("long"), "array<struct<start:long,kind:int,end:long>>"
    nothing = F.array().cast(span)
    parts = F.arrays_zip(F.transform(whole, F.length).alias("n"), F.transform(inner, F.length).alias("m"), F.transform(F.slice(between, 1, F.size(whole)), F.length).alias("gap"))

    def in_runs(all_parts: Column) -> Column:
        last = F.call_function("div", F.size(all_parts) - 1, F.lit(RUN)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_parts, k * RUN + 1, RUN))

    def step(done: Column, x: Column) -> Column:
        a = done["at"] + x["gap"]
        b = a + x["n"]
        one = F.struct(a.alias("start"), F.lit(order).alias("kind"), b.alias("end"))
        return F.struct(b.alias("at"), F.when(x["m"] >= least, F.concat(done["found"], F.array(one))).otherwise(done["found"]).alias("found"))

    def moved(run: Column, begin: Column) -> Column:
        return F.transform(run["found"], lambda s: F.struct((s["start"] + begin).alias("start"), s["kind"].alias("kind"), (s["end"] + begin).alias("end")))

    def joined(inside: Column) -> Column:
        begins = F.aggregate(inside, F.array(zero), lambda done, run: F.concat(done, F.array(F.element_at(done, -1) + run["at"])))
        return F.flatten(F.zip_with(inside, F.slice(begins, 1, F.size(inside)), moved))

    inside = F.transform(_once(parts, in_runs), lambda run: F.aggregate(run, F.struct(zero.alias("at"), nothing.alias("found")), step))
    found = _once(inside, joined).cast(span)
    needs = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
    return F.when(needs & F.rlike(text, F.lit(pattern)), found).otherwise(nothing)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, rule_version, spans) for rows (blob, text); spans are sorted by start, then kind as listed."""
    spans = F.array_sort(F.concat(*(_spans(F.col("text"), k) for k in range(len(KINDS)))))
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), spans.alias("spans"))


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after `docs`: one row (blob, rule_version, spans) for each distinct text ever scanned by each version of the rules.

    Texts are addressed by SHA-256. Of each text that the ledger lacks for this version, one row is picked by its id,
    and only those are scanned; the texts are shuffled once, by keys that are nearly unique, so copies cause no skew.
    """
    docs = as_documents(docs).withColumn("blob", F.sha2("text", 256))
    picked = docs.groupBy("blob").agg(F.min("doc_id").alias("picked"))
    if ledger is not None:
        picked = picked.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    # ids repeat with other texts only in odd tables; the pair is the key
    rows = docs.join(picked.withColumnRenamed("blob", "b").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("picked")) & (F.col("blob") == F.col("b")), "left_semi")
    # written before any filter on the findings, which Spark would otherwise apply to all rows ahead of the join
    out = cut(scan_blobs(rows).dropDuplicates(["blob", "rule_version"]))
    return out if ledger is None else ledger.select("blob", "rule_version", "spans").union(out)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>, n_assign, n_access, n_hex, base_sha256 and spans_text for every row of `docs`.

    Findings come from the ledger and are joined back to all rows with the text, so copies are scanned once and
    reported for each. Null text counts as empty; null ids and repeated rows are kept as they are; other columns
    aren't read; an empty table gives no rows.
    """
    findings = scan_ledger(docs, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    rows = as_documents(docs).select("doc_id", F.sha2("text", 256).alias("blob"))
    out = salted_join(rows, findings, ["blob"], hot_hashes(rows, ["blob"]), ["doc_id"], "left")
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:long,kind:int,end:long>>"))
    out = out.withColumn("spans", spans)

    def count_of(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [count_of(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans_text"), "spans")
