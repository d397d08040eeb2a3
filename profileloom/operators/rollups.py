"""Roll-ups of profiles over tables, files and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.functions.rounding import div


def profile_totals(tables: DataFrame) -> DataFrame:
    """Sums over counted tables: table_id, counted, rows, table_bytes, index_bytes. Overflow is an error."""
    rows = tables.where("counted")
    return rows.agg(F.count("*").alias("table_count"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "table_bytes", "index_bytes")))


def evidence_counts(tables: DataFrame, families: list[str]) -> DataFrame:
    """(family, token, n): tables by the token they have in each family of states."""
    return tables.unpivot(["table_id"], families, "family", "token").groupBy("family", F.coalesce("token", F.lit("unknown")).alias("token")).agg(F.count("*").alias("n"))


def schema_compatible(left: DataFrame, right: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """keys and compatible: whether both sides have the same columns with equal attributes. One row per column of a side, by keys and column_name."""
    both = left.alias("l").join(right.alias("r"), [*keys, "column_name"], "full")
    same = F.lit(True)
    for a in attributes:
        same = same & F.col(f"l.{a}").eqNullSafe(F.col(f"r.{a}"))
    there = F.col(f"l.{attributes[0]}").isNotNull() & F.col(f"r.{attributes[0]}").isNotNull()
    return both.groupBy(*keys).agg(F.every(same & there).alias("compatible"))


def merge_file_profiles(files: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles of files with one schema as one: sums; mean length by non-null rows, halves up; greatest p95; null fraction by rows; codecs united.

    files: keys, sample_rows, non_null_rows, length_avg, length_p95, stored_bytes, codec.
    """
    some = F.sum("non_null_rows")
    mean = F.when(some > 0, div(F.sum(F.col("length_avg") * F.col("non_null_rows")) + div(some, 2), F.greatest(some, F.lit(1))))
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("sample_rows").alias("sample_rows"), some.alias("non_null_rows"), mean.alias("length_avg"), F.max("length_p95").alias("length_p95"), ((F.sum("sample_rows") - some) / F.sum("sample_rows")).alias("null_fraction"), F.sum("stored_bytes").alias("stored_bytes"), F.array_join(F.array_sort(F.collect_set("codec")), ",").alias("codecs"))


def merge_cardinality(files: DataFrame, keys: list[str]) -> DataFrame:
    """Cardinalities of files as one: greatest observed, sum of estimates up to the non-null rows, greatest fractions and quantiles.

    One file without a measure leaves the whole without. Values may overlap between files, so the result is biased.
    """
    whole = F.count("observed_distinct") == F.count("*")
    pick = lambda c: F.when(whole, c)
    estimate = F.least(F.sum("estimated_distinct"), F.greatest(F.sum("non_null_rows"), F.max("observed_distinct")))
    return files.groupBy(*keys).agg(pick(F.max("observed_distinct")).alias("observed_distinct"), pick(estimate).alias("estimated_distinct"), pick(F.max("top_value_fraction")).alias("top_value_fraction"), *(pick(F.max(q)).alias(q) for q in ("frequency_p50", "frequency_p95", "frequency_p99", "frequency_max")), whole.alias("measured"), F.when(whole, "file-overlap-unknown").alias("bias_reason"))


def merge_compression(files: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios of files weighted by bytes where they were measured alike, else 0 and a mixed tag; greatest spread; biased if any is."""
    alike = F.countDistinct("encoding") == 1
    ratio = F.sum("sample_bytes") / F.sum(F.col("sample_bytes") / F.col("ratio"))
    return files.groupBy(*keys).agg(F.sum("sample_bytes").alias("sample_bytes"), F.when(alike, ratio).otherwise(0.0).alias("ratio"), F.max("ratio_stddev").alias("ratio_stddev"), F.max("biased").alias("biased"), F.when(alike, F.min("encoding")).otherwise("mixed-encodings").alias("encoding"))


def _group_id() -> Column:
    return F.coalesce("dataset_group", F.concat(F.lit("dataset-"), F.col("source_id")))


def dataset_groups(sources: DataFrame) -> DataFrame:
    """(group_id, relationship, members_complete, n_members, violation): groups of sources, with what contradicts in their declarations.

    sources: source_id, relationship, dataset_group, group_complete. Independent groups have one member and are complete,
    unknown ones never are, replicas and shards need a group, and members must agree. violation is '' where none is.
    """
    c = F.col
    rows = sources.withColumn("relationship", F.coalesce("relationship", F.lit("unknown"))).withColumn("group_id", _group_id())
    complete = F.when(c("relationship") == "independent", True).when(c("relationship") == "unknown", False).otherwise(F.coalesce("group_complete", F.lit(False)))
    bad = F.when(~c("relationship").isin("independent", "replica", "shard", "unknown"), "unsupported-relationship").when(c("relationship").isin("replica", "shard") & c("dataset_group").isNull(), "missing-group")
    bad = bad.when((c("relationship") == "independent") & ~F.coalesce("group_complete", F.lit(True)), "independent-incomplete").when((c("relationship") == "unknown") & F.coalesce("group_complete", F.lit(False)), "unknown-complete")
    rows = rows.withColumn("complete", complete).withColumn("bad", bad)
    out = rows.groupBy("group_id").agg(F.min("relationship").alias("relationship"), F.min("complete").alias("members_complete"), F.countDistinct("source_id").alias("n_members"), F.min("bad").alias("bad"), (F.countDistinct("relationship", "complete") > 1).alias("split"))
    violation = F.when(c("bad").isNotNull(), c("bad")).when(c("split"), "inconsistent-declarations").when((c("relationship") == "independent") & (c("n_members") != 1), "independent-members").otherwise("")
    return out.select("group_id", "relationship", "members_complete", "n_members", violation.alias("violation"))


def bundle_totals(sources: DataFrame) -> DataFrame:
    """One row of totals over sources, never counting a dataset twice nor claiming what isn't known.

    sources: source_id, relationship, group_id, group_complete, succeeded, scope, table_count, row_count, table_bytes,
    index_bytes. Independent sources add; of replicas the first that succeeded counts; shards add if the group is
    complete and all succeeded; a group of unknown relationship suppresses all totals.
    """
    c, sizes = F.col, ("table_count", "row_count", "table_bytes", "index_bytes")
    good = F.when(c("succeeded"), F.struct("source_id", *sizes, "scope"))
    groups = sources.groupBy("group_id").agg(F.min("relationship").alias("relationship"), F.min("group_complete").alias("complete"), F.count("*").alias("members"), F.sum(c("succeeded").cast("long")).alias("good"), F.min(good).alias("one"), *(F.sum(F.when(c("succeeded"), c(s))).alias(f"sum_{s}") for s in sizes), F.countDistinct(F.when(c("succeeded"), F.struct(*sizes))).alias("versions"), F.max(F.when(c("succeeded"), c("scope") != "complete")).alias("any_partial"))
    single = c("relationship").isin("independent", "replica") & (c("good") > 0)
    shards = (c("relationship") == "shard") & c("complete") & (c("good") == c("members"))
    value = lambda s: F.when(single, c(f"one.{s}")).when(shards, c(f"sum_{s}")).otherwise(0)
    # fixed values: names of limitations
    notes = {
        "failed-sources": (c("good") < c("members")) | (c("relationship").isin("independent", "replica") & (c("good") == 0)),
        "replica-group-disagreement": (c("relationship") == "replica") & (c("versions") > 1),
        "shard-group-incomplete": (c("relationship") == "shard") & ~shards,
        "source-dataset-scope-incomplete": (single & (c("one.scope") != "complete")) | (shards & c("any_partial")),
        "unknown-dataset-relationship": c("relationship") == "unknown",
    }
    unknown = F.coalesce(F.max(c("relationship") == "unknown"), F.lit(False))
    total = groups.agg(unknown.alias("unknown"), F.coalesce(F.sum("members"), F.lit(0)).alias("source_count"), F.coalesce(F.sum((single | shards).cast("long")), F.lit(0)).alias("logical_dataset_count"), *(F.coalesce(F.sum(value(s)), F.lit(0)).alias(s) for s in sizes), F.array_join(F.array_sort(F.filter(F.array(*(F.when(F.max(cond), F.lit(name)) for name, cond in notes.items())), lambda x: x.isNotNull())), ",").alias("limitations"))
    shown = [F.when(c("unknown"), 0).otherwise(c(s)).alias(s) for s in ("logical_dataset_count", *sizes)]
    status = F.when(c("unknown"), "suppressed").when(c("limitations") != "", "incomplete").otherwise("complete")
    return total.select("source_count", *shown, status.alias("aggregation"), "limitations")


def top_tables(tables: DataFrame, k: int = 10) -> DataFrame:
    """The k largest counted tables, ties by id, and their share of all bytes."""
    rows = tables.where("counted")
    total = rows.agg(F.sum("table_bytes")).first()[0]
    best = rows.select("table_id", "table_bytes").orderBy(F.desc("table_bytes"), "table_id").limit(k)
    return best.withColumn("share", F.col("table_bytes") / F.lit(total))


def type_mix(columns: DataFrame) -> DataFrame:
    """(schema_id, column_type, n) with subtotals; the name of what is summed over is NULL."""
    return columns.rollup("schema_id", "column_type").agg(F.count("*").alias("n"))


def index_mix(indexes: DataFrame) -> DataFrame:
    return indexes.groupBy("index_type").agg(F.count("*").alias("n"), F.sum(F.col("is_unique").cast("long")).alias("n_unique"))


#: Groups that object kinds are shown in.
PRESENTATION = {"Routines": ("function", "procedure", "package"), "Views": ("view", "materialized-view"), "Triggers": ("trigger",), "Sequences": ("sequence",), "Types": ("type", "domain")}


def object_counts(objects: DataFrame) -> DataFrame:
    """(kind, external_class, presentation, n)."""
    shown = None
    for name, kinds in PRESENTATION.items():
        shown = (F.when if shown is None else shown.when)(F.col("kind").isin(*kinds), name)
    return objects.groupBy("kind", "external_class", shown.otherwise("Other").alias("presentation")).agg(F.count("*").alias("n"))


def token_union(lists: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """keys and the sorted distinct tokens of all lists, comma-joined."""
    return lists.select(*keys, F.explode(tokens).alias("t")).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("tokens"))


def select_scope(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose name is in the list, in any order and however often named. Names that the table doesn't have raise; an empty list selects nothing."""
    if missing := [r[0] for r in missing_names(df, column, allowed).orderBy(column).limit(20).collect()]:
        raise ValueError(f"no such {column}: {', '.join(missing)}")
    return df.where(F.col(column).isin(*sorted(set(allowed))))


def missing_names(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Names of the list that the table doesn't have."""
    names = df.sparkSession.createDataFrame([(n,) for n in sorted(set(allowed))], f"{column} string")
    return names.join(df.select(F.col(column).cast("string").alias(column)).distinct(), column, "left_anti")


def select_sources(sources: DataFrame, engines: list[str] | None = None, tag: str | None = None, source_ids: list[str] | None = None, tables: DataFrame | None = None, table: str | None = None) -> DataFrame:
    """Sources of given engines and ids that have a tag and a table; what isn't given doesn't select. tables: source_id, table_id. Ids that aren't there raise."""
    rows = sources.where(F.col("engine").isin(*engines)) if engines else sources
    if source_ids is not None:
        rows = select_scope(rows, "source_id", source_ids)
    if table is not None:
        rows = rows.join(tables.where(F.col("table_id") == table).select("source_id").distinct(), "source_id", "left_semi")
    return rows.where(F.array_contains("tags", tag)) if tag else rows
