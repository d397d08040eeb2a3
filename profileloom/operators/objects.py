"""Objects other than tables: inventory, census of their definitions, complexity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.functions.tokens import COUNT_BANDS, count_band, letters

#: Features by the words that show them.
FEATURES = {"branch": ("if", "case", "when", "elsif"), "loop": ("loop", "while", "for"), "join": ("join",), "aggregate": ("group", "having"), "set": ("union", "intersect", "except"), "write": ("insert", "update", "delete", "merge"), "cte": ("with", "recursive"), "dynamic": ("execute", "immediate"), "transaction": ("commit", "rollback"), "exception": ("exception", "raise")}
#: Complexity by the place of a band.
COMPLEXITY = ("trivial", "trivial", "low", "moderate", "high", "high", "very-high")
_SCRUB = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)", re.S)


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with `number`: the row's place, from 1, within its group by a hexadecimal hash.

    Groups are few and rows many, so places are counted in buckets of the hash's first digits, and the totals of the
    buckets, 4096 for each group at most, are summed first.
    """
    rows = df.withColumn("_bucket", F.substring(order, 1, 3))
    totals = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(order))
    rows = rows.withColumn("_rank", rank).join(totals.select(group, "_bucket", before.alias("_before")), [group, "_bucket"])
    return rows.withColumn("number", F.col("_rank") + F.col("_before")).drop("_bucket", "_rank", "_before")


def padded(number: Column, width: int) -> Column:
    """A number with leading zeros up to the width; longer ones keep all their digits."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def label(prefix: Column | str, number: Column) -> Column:
    """prefix-001 and so on; numbers over 999 keep all their digits."""
    return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("-"), padded(number, 3))


def anonymous_ids(df: DataFrame, kind: str, hash_: str) -> DataFrame:
    """df with object_id, the kind and the row's place among its kind by a keyed hash: ids that tell nothing of the names."""
    return numbered(df, kind, hash_).withColumn("object_id", label(F.col(kind), F.col("number"))).drop("number")


def schema_ids(schemas: DataFrame, hash_: str) -> DataFrame:
    """schemas, one row each, with schema_id: schema-A to schema-Z, schema-AA and so on by a keyed hash."""
    numbered_ = numbered(schemas.withColumn("_all", F.lit("schema")), "_all", hash_)
    return numbered_.withColumn("schema_id", F.concat(F.lit("schema-"), letters(F.col("number")))).drop("number", "_all")


def column_id(ordinal: Column) -> Column:
    return F.concat(F.lit("col-"), ordinal.cast("string"))


def index_ids(indexes: DataFrame, table: str, hash_: str) -> DataFrame:
    """indexes with index_id: idx-1 and so on within their table by a keyed hash."""
    return numbered(indexes, table, hash_).withColumn("index_id", F.concat(F.lit("idx-"), F.col("number").cast("string"))).drop("number")


def object_inventory(objects: DataFrame) -> DataFrame:
    """(object_id, kind, hash, status): ids by kind and hash; no requirements are complete only where none apply.

    objects: kind, hash, requirement_status, n_requirements.
    """
    status = F.when((F.col("requirement_status") == "complete") & (F.col("n_requirements") == 0), "not_applicable").otherwise(F.col("requirement_status"))
    return anonymous_ids(objects, "kind", "hash").select("object_id", "kind", "hash", status.alias("status"))


def feature_counts(texts: DataFrame, key: str, text: str, features: dict[str, tuple[str, ...]] = FEATURES) -> DataFrame:
    """(key, feature, n): occurrences of each feature's words between anything but letters, digits and _, by one regular expression for each feature."""
    counts = [F.struct(F.lit(name).alias("feature"), F.regexp_count(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])")).cast("long").alias("n")) for name, words in sorted(features.items())]
    return texts.select(key, F.explode(F.array(*counts)).alias("f")).select(key, "f.feature", "f.n").where("n > 0")


def scrubbed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, nesting): definitions without comments and literals, and their deepest nesting of parentheses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code = [_SCRUB.sub(" ", t or "") for t in batch["text"]]
            depths = []
            for t in code:
                deep = most = 0
                for c in re.findall(r"[()]", t):
                    deep = deep + 1 if c == "(" else max(0, deep - 1)
                    most = max(most, deep)
                depths.append(most)
            yield pd.DataFrame({"key": batch["key"], "code": code, "nesting": depths})

    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, code string, nesting long")


def definition_census(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, feature, band): counts of features in scrubbed definitions, and of nesting, as bands."""
    code = scrubbed(texts, key, text)
    found = feature_counts(code, "key", "code")
    nested = code.select("key", F.lit("nesting").alias("feature"), F.col("nesting").alias("n"))
    return found.union(nested).select("key", "feature", count_band("n").alias("band"))


def complexity_band(bucket: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPLEXITY)), bucket.cast("int") + 1)


def complexity_profile(observations: DataFrame) -> DataFrame:
    """(dimension, n_zero ... , not_applicable, unknown, coverage, band): histogram of each dimension over objects.

    observations: object_id, dimension, bucket (0 to 6, NULL if not assessed), state (assessed, not-applicable, unknown).
    A band is definite only if nothing is unknown, or if it is the highest already.
    """
    c, names = F.col, [f"n_{k}" for k in range(len(COUNT_BANDS[1]))]
    known = c("state") == "assessed"
    out = observations.groupBy("dimension").agg(*(F.sum((known & (c("bucket") == k)).cast("long")).alias(n) for k, n in enumerate(names)), F.sum((c("state") == "not-applicable").cast("long")).alias("not_applicable"), F.sum((c("state") == "unknown").cast("long")).alias("unknown"), F.max(F.when(known, c("bucket"))).alias("top"), F.count("*").alias("n"))
    none, all_unknown = (c("not_applicable") == c("n")), (c("unknown") == c("n"))
    low = F.coalesce(complexity_band(c("top")), F.lit("trivial"))
    coverage = F.when(none, "not-applicable").when(all_unknown, "unknown").when(c("unknown") == 0, "complete").otherwise("partial")
    band = F.when(none, "not-applicable").when(all_unknown, "unknown").when((c("unknown") == 0) | (low == "very-high"), low).otherwise("unknown")
    return out.select("dimension", *names, "not_applicable", "unknown", coverage.alias("coverage"), band.alias("band"))


def complexity_overall(observations: DataFrame, population_complete: bool = True, analyzed: bool = True) -> DataFrame:
    """One row: eligible, fully, partially and unassessed objects, and the overall band, the highest of the dimensions'.

    An object is fully assessed if no dimension is unknown, and unassessed if all are. The band is definite if it is
    the highest already, or if the population is complete and every object fully assessed.
    """
    known = F.col("state") != "unknown"
    each = observations.groupBy("object_id").agg(F.min(known).alias("all_known"), F.max(known).alias("some_known"))
    counts = each.agg(F.count("*").alias("eligible"), *(F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(n) for n, x in (("fully", F.col("all_known")), ("partially", ~F.col("all_known") & F.col("some_known")), ("unassessed", ~F.col("some_known")))))
    order = ("trivial", "low", "moderate", "high", "very-high")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("band"))
    top = complexity_profile(observations).agg(F.lit(1).alias("one"), F.coalesce(F.max(rank), F.lit(0)).alias("rank"))
    band = F.element_at(F.array(*map(F.lit, order)), F.greatest(F.col("rank"), F.lit(1)).cast("int"))
    sure = (band == "very-high") | (F.lit(population_complete) & (F.col("fully") == F.col("eligible")))
    overall = F.when(F.col("eligible") == 0, "not-applicable" if population_complete else "unknown").when(F.lit(analyzed) & sure, band).otherwise("unknown")
    return counts.withColumn("one", F.lit(1)).join(top, "one").select("eligible", "fully", "partially", "unassessed", overall.alias("overall_band"))
