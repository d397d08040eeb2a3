"""Scores of how far the evidence of a profile goes, and rules that a profile must keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.functions.rounding import div, weighted_percent

#: Points of a state of completeness and of freshness, and the least score of a band.
COMPLETENESS = {"complete": 100, "incomplete": 50}
FRESHNESS = {"current": 100, "fresh": 100, "possibly-stale": 80, "user-supplied": 75, "locked": 70, "known-stale": 60, "stale": 60, "never-analyzed": 30, "never_analyzed": 30}
#: Sources without a topology of their own, and the states of statistics that a limitation names.
FILE_ENGINES = ("parquet", "avro")
STALE_STATES = {"stale": ("known-stale", "stale"), "possibly-stale": ("possibly-stale",), "never-analyzed": ("never-analyzed", "never_analyzed"), "locked": ("locked",), "user-supplied": ("user-supplied",)}
BANDS = ((90, "high"), (75, "good"), (50, "moderate"))


def _points(state: Column, table: dict[str, int], default: int | None) -> Column:
    out = None
    for name, n in table.items():
        out = (F.when if out is None else out.when)(state == name, n)
    return out.otherwise(F.lit(default))


def completeness_points(state: Column) -> Column:
    return _points(state, COMPLETENESS, 25)


def artifact_points(detail: Column, inventory: Column, dependencies: Column, analysis: Column) -> Column:
    """Points of an object inventory by its detail (NULL: none was asked for) and by what of it is complete."""
    inventory, dependencies, analysis = (F.coalesce(x, F.lit(False)) for x in (inventory, dependencies, analysis))
    full = (F.when(detail.isNull() | (detail == "none"), 0).when((detail == "summary") & inventory, 50).when((detail == "graph") & inventory & dependencies, 80)
            .when((detail == "analyzed") & inventory & dependencies & analysis, 100))
    return full.otherwise(25)


def half_up(total: Column, n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(100), div(total + div(n, 2), F.greatest(n, F.lit(1))))).otherwise(0)


def fidelity_score(sources: DataFrame, tables: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Scores of each source by structure, sizing, columns, relationships and objects, and overall with its band.

    sources: source_id, engine, inventory, row_coverage, size_coverage, topology (full, partial or else), object_detail, objects_complete,
    dependencies_complete, analysis_complete. Files have the topology of their inventory.
    tables: source_id, statistics_state. columns: source_id, points, sampled, biased, lower_bound. edges: source_id, has_statistics.
    Freshness can only lower what row coverage gives; states that say nothing about it don't count.
    """
    c = F.col
    fresh = _points(c("statistics_state"), FRESHNESS, None)
    t = tables.groupBy("source_id").agg(F.sum(fresh).alias("fresh_sum"), F.count(fresh).alias("fresh_n"), *(F.max(c("statistics_state").isin(*names)).alias(f"any {state}") for state, names in STALE_STATES.items()))
    k = columns.groupBy("source_id").agg(F.sum("points").alias("points"), F.count("*").alias("n_columns"), F.sum(c("sampled").cast("long")).alias("n_sampled"), F.max("biased").alias("biased"), F.max("lower_bound").alias("low"))
    e = edges.groupBy("source_id").agg(F.sum(F.when(c("has_statistics"), 100).otherwise(50)).alias("evidence"), F.count("*").alias("n_edges"))
    rows = sources.join(t, "source_id", "left").join(k, "source_id", "left").join(e, "source_id", "left")
    inventory = completeness_points(c("inventory"))
    is_file = F.coalesce(c("engine").isin(*FILE_ENGINES), F.lit(False))
    topology = F.when(is_file, inventory).when(c("topology") == "full", 100).when(c("topology") == "partial", 60).otherwise(40)
    coverage, size = completeness_points(c("row_coverage")), completeness_points(c("size_coverage"))
    factor = weighted_percent([(F.lit(100), 3), (half_up(c("fresh_sum"), c("fresh_n")), 1)])
    rows_score = F.when(c("fresh_n") > 0, half_up(coverage * factor, F.lit(100))).otherwise(coverage)
    rows = rows.withColumn("structure_score", weighted_percent([(inventory, 3), (topology, 1)])).withColumn("sizing_score", weighted_percent([(rows_score, 1), (size, 1)]))
    rows = rows.withColumn("column_score", F.when(c("n_columns") > 0, half_up(c("points"), c("n_columns"))).otherwise(100)).withColumn("relationship_score", F.when(c("n_edges") > 0, half_up(c("evidence"), c("n_edges"))).otherwise(inventory))
    overall = weighted_percent([(c("structure_score"), 30), (c("sizing_score"), 25), (c("column_score"), 30), (c("relationship_score"), 10), (artifact_points(c("object_detail"), c("objects_complete"), c("dependencies_complete"), c("analysis_complete")), 5)])
    rows = rows.withColumn("overall_score", overall)
    level = None
    for least, name in BANDS:
        level = (F.when if level is None else level.when)(c("overall_score") >= least, name)
    # fixed values: names of limitations
    notes = {
        "artifact-inventory-incomplete": c("object_detail").isNotNull() & ~F.coalesce(c("objects_complete"), F.lit(False)),
        "artifact-inventory-not-requested": c("object_detail").isNull(),
        "biased-column-sampling": c("biased"),
        "cardinality-lower-bounds": c("low"),
        "column-statistics-not-sampled": (c("n_columns") > 0) & (c("n_sampled") == 0),
        "column-statistics-partial": (c("n_sampled") > 0) & (c("n_sampled") < c("n_columns")),
        "relationship-statistics-partial": (c("n_edges") > 0) & (c("evidence") < 100 * c("n_edges")),
        "row-count-coverage-not-complete": coverage < 100,
        "size-coverage-not-complete": size < 100,
        "table-inventory-not-complete": inventory < 100,
        **{f"table-statistics-{state}": c(f"any {state}") for state in STALE_STATES},
        "topology-visibility-partial": ~is_file & (c("topology") == "partial"),
        "topology-visibility-unknown": ~is_file & ~F.coalesce(c("topology").isin("full", "partial"), F.lit(False)),
    }
    limits = F.array_join(F.array_sort(F.filter(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in notes.items())), lambda x: x.isNotNull())), ",")
    return rows.select("source_id", *(c(s).cast("long").alias(s) for s in ("structure_score", "sizing_score", "column_score", "relationship_score")), c("overall_score").cast("long"), level.otherwise("low").alias("band"), limits.alias("limitations"))


def cardinality_rules() -> list[tuple[str, Column]]:
    """(rule, predicate that breaks it) for columns with a cardinality block."""
    c = F.col
    complete = ~c("measured") | (c("sample_rows") == 0) | (c("sample_rows") != c("table_rows")) | (c("estimated_distinct") > c("table_rows"))
    return [
        ("above-exact-population", c("exact_population") & ((c("sample_rows") > c("table_rows")) | (c("estimated_distinct") > c("table_rows")))),
        ("bias-needs-reason", c("sampled_with_bias") != (c("bias_reason") != "")),
        ("complete-read-disagrees", c("complete_source_read") & complete),
        ("distinct-above-non-null", c("observed_distinct") > c("non_null_rows")),
        ("estimate-below-observed", (c("estimated_distinct") != 0) & (c("estimated_distinct") < c("observed_distinct"))),
        ("fraction-out-of-range", (c("top_value_fraction") < 0) | (c("top_value_fraction") > 1)),
        ("max-frequency-above-rows", c("frequency_max") > c("non_null_rows")),
        ("non-null-above-sample", c("non_null_rows") > c("sample_rows")),
        ("null-fraction-disagrees", F.abs(c("null_fraction") - (c("sample_rows") - c("non_null_rows")) / c("sample_rows")) > 1e-12),
        ("nothing-known-but-counted", (c("non_null_rows") == 0) & ((c("estimated_distinct") != 0) | (c("top_value_fraction") != 0))),
        ("percentiles-out-of-order", (c("frequency_p50") > c("frequency_p95")) | (c("frequency_p95") > c("frequency_p99")) | (c("frequency_p99") > c("frequency_max"))),
    ]


def relationship_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("bias-needs-reason", c("sampled_with_bias") != (c("bias_reason") != "")),
        ("coverage-out-of-range", (c("coverage") < 0) | (c("coverage") > 1) | F.isnan("coverage")),
        ("fan-out-above-rows", c("fanout_max") > c("non_null_rows")),
        ("fan-outs-out-of-order", (c("fanout_p50") > c("fanout_p95")) | (c("fanout_p95") > c("fanout_p99")) | (c("fanout_p99") > c("fanout_max"))),
        ("non-null-above-sample", c("non_null_rows") > c("sample_rows")),
        ("orphans-above-rows", c("orphan_rows") > c("non_null_rows")),
        ("parents-above-rows", c("distinct_parents") > c("non_null_rows")),
        ("validated-with-orphans", c("validated") & (c("orphan_rows") > 0)),
    ]


#: What a foreign key may do and how it may match; an empty name is none given.
ACTIONS, MATCHES = ("", "no-action", "restrict", "cascade", "set-null", "set-default"), ("", "simple", "full", "partial")


def foreign_key_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("deferred-not-deferrable", c("initially_deferred") & ~c("deferrable")),
        ("unknown-delete-action", ~c("on_delete").isin(*ACTIONS)),
        ("unknown-match", ~c("match_type").isin(*MATCHES)),
        ("unknown-update-action", ~c("on_update").isin(*ACTIONS)),
    ]


def length_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [("negative-length", (c("length_avg") < 0) | (c("length_p95") < 0)), ("lengths-without-rows", (c("length_avg") > 0) & (c("non_null_rows") == 0))]


def compression_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("negative-ratio", (c("ratio") < 0) | F.isnan("ratio")),
        ("ratio-without-sample", (c("ratio") > 0) & (c("sample_bytes") == 0)),
        ("spread-without-ratio", (c("ratio_stddev") > 0) & (c("ratio") == 0)),
    ]


def range_rules() -> list[tuple[str, Column]]:
    """For value ranges: magnitudes and times come in full or not at all."""
    c = F.col
    some = lambda *names: [c(n).isNotNull() for n in names]
    low, high, sign = some("magnitude_min", "magnitude_max", "has_negative")
    span, decade = some("time_span", "time_recent_decade")
    return [
        ("decade-not-whole", c("time_recent_decade") % 10 != 0),
        ("magnitude-incomplete", (low != high) | (high != sign)),
        ("magnitudes-out-of-order", c("magnitude_min") > c("magnitude_max")),
        ("time-incomplete", span != decade),
    ]


def contract_violations(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """keys and rule for every rule that a row breaks, in one pass over the rows. A rule on what is missing isn't broken."""
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def totals_violations(totals: DataFrame, tables: DataFrame) -> DataFrame:
    """Published totals that differ from the sums of their counted tables: (source_id, rule)."""
    sums = tables.where("counted").groupBy("source_id").agg(F.sum("rows").alias("_rows"), F.sum("table_bytes").alias("_bytes"))
    both = totals.join(sums, "source_id", "left")
    rules = [("row-total-differs", F.col("rows") != F.coalesce("_rows", F.lit(0))), ("byte-total-differs", F.col("table_bytes") != F.coalesce("_bytes", F.lit(0)))]
    return contract_violations(both, ["source_id"], rules)
