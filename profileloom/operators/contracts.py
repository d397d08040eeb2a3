"""Rules over whole profiles: what columns, tables, scopes and inventories must keep, by themselves and with each other.

A rule states which other entities it needs. What they contribute is gathered once for each row it concerns (sets of ordinals, parents, counts) by grouped
joins on the source, and all rules of an entity are then checked in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.operators.quality import FILE_ENGINES

#: Words that may stand in a field; empty or NULL is none.
COLUMN_WORDS = {
    "value_source": ("identity-always", "identity-default", "auto-increment", "identity", "sequence-default", "generated-stored", "generated-virtual", "computed-persisted", "computed-virtual", "system-time", "rowversion"),
    "default_kind": ("constant", "function", "expression"),
    "length_semantics": ("characters", "bytes", "not-applicable", "unknown"),
    "type_kind": ("enum", "set", "domain", "composite", "array", "range", "alias"),
    "time_span": ("intraday", "days", "weeks", "months", "years", "decades"),
    "numeric_precision_radix": ("decimal", "binary"),
}
NUMERIC_MODELS = ("integer", "fixed-decimal", "unconstrained-decimal", "decimal-float", "binary-float", "not-applicable", "unknown")
#: Greatest precision by engine and model, and at all.
PRECISIONS = {("oracle", "fixed-decimal"): 38, ("oracle", "decimal-float"): 126, ("mysql", "fixed-decimal"): 65, ("sqlserver", "fixed-decimal"): 38, ("sqlserver", "binary-float"): 53, ("postgresql", "fixed-decimal"): 1000}
MOST_DIGITS, FLOAT_BITS = 1000, 126
#: Scales by engine; others go as far as PostgreSQL's, and those of WITHIN from 0 to the precision.
SCALES, WITHIN = {"oracle": (-84, 127)}, ("mysql", "sqlserver", "parquet", "avro")
TABLE_WORDS = {
    "object_kind": ("ordinary-table", "materialized-view", "external-table", "temporary-table", "nested-table", "object-table"),
    "storage_organization": ("heap", "index-organized", "clustered", "external", "unknown"),
    "partitioning": ("none", "range", "list", "hash", "interval", "reference", "composite", "system", "key", "linear-hash", "linear-key", "unknown"),
    "segment_state": ("created", "deferred", "mixed", "mixed-table-and-index", "unavailable", "unknown"),
    "row_count_method": ("postgres-planner-estimate", "mysql-table-statistics", "sqlserver-partition-counter", "oracle-table-statistics", "oracle-segment-statistics", "parquet-footer", "avro-decoded-scan", "structured-dataset-aggregate", "bounded-complete-read", "unknown"),
    "row_count_quality": ("exact-counter", "exact-read", "engine-counter", "engine-estimate", "cached-engine-estimate", "sample-extrapolation", "unavailable", "unknown"),
    "statistics_state": ("current", "possibly-stale", "known-stale", "never-analyzed", "locked", "user-supplied", "not-applicable", "unknown"),
    "refresh_age_band": ("under-1h", "1h-1d", "1-7d", "1-4w", "1-3m", "3m-plus", "unknown", "not-applicable"),
    "modification_ratio_band": ("none", "under-1pct", "1-5pct", "5-10pct", "10-20pct", "20-50pct", "over-50pct", "unknown", "not-applicable"),
    "sample_fraction_band": ("full", "75-99pct", "50-74pct", "25-49pct", "under-25pct", "unknown", "not-applicable"),
}
TABLE_LISTS = {
    "table_features": ("graph-edge", "graph-node", "memory-optimized", "temporal-current", "temporal-history"),
    "table_limitations": ("column-inventory-unavailable", "dependent-structure-suppressed", "index-inventory-unavailable", "relationship-inventory-unavailable", "relationship-target-outside-selected-scope", "relationship-target-visibility-unknown", "row-security-filter-active", "row-security-visibility-unknown", "table-classification-unavailable", "temporal-history-outside-selected-scope", "temporal-history-visibility-unknown"),
}
STATES = ("complete", "incomplete", "unknown")
SCOPE_WORDS = {
    "layout": ("full-copy", "sharded", "distributed", "structured-dataset", "unknown"),
    "table_inventory_completeness": STATES,
    "row_count_completeness": STATES,
    "size_completeness": STATES,
    "row_count_method": (*TABLE_WORDS["row_count_method"][:-2], "distributed-aggregate", "bounded-complete-read", "mixed-catalog-and-bounded-read", "not-applicable", "unknown"),
    "size_method": ("postgres-local-relation-size", "mysql-information-schema", "sqlserver-partition-pages", "oracle-segment-bytes", "oracle-table-logical-estimate", "citus-distributed-relation-size", "parquet-footer", "avro-container", "structured-dataset-aggregate", "distributed-aggregate", "mixed", "not-applicable", "unknown"),
}
SCOPE_LISTS = {
    "limitations": ("catalog-capture-truncated", "distributed-aggregate-unavailable", "distributed-row-count-unavailable", "distributed-size-unavailable", "external-data-unmeasured", "external-table-visibility-unknown", "failed-sources", "local-member-only", "logical-partition-root-unmeasured", "memory-optimized-data-unmeasured", "replica-membership-unresolved", "row-count-evidence-incomplete", "row-counts-statistical", "selection-limited", "shard-membership-incomplete", "size-evidence-incomplete", "statistics-stale", "table-inventory-visibility-unknown", "topology-unobserved", "topology-visibility-partial", "topology-visibility-unknown"),
}
INVENTORY_WORDS = {
    "scope": ("all-visible-schemas", "selected-schemas", "structured-source", "unknown"),
    "detail": ("none", "summary", "graph", "analyzed"),
    "visibility": ("full", "privilege_filtered", "unknown"),
}
#: Details that come with a complexity.
WITH_COMPLEXITY = ("graph", "analyzed")


class Rule(NamedTuple):
    name: str
    broken: Column  # NULL is not broken
    needs: tuple[str, ...] = ()  # further entities


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _words(fields: Mapping[str, tuple[str, ...]]) -> list[Rule]:
    return [Rule(f"unknown-{f.replace('_', '-')}", _given(f) & ~F.col(f).isin(*words)) for f, words in fields.items()]


def _lists(fields: Mapping[str, tuple[str, ...]]) -> list[Rule]:
    """Lists hold known words, each once and in order."""
    out = []
    for f, words in fields.items():
        name = f.replace("_", "-")
        out += [Rule(f"unknown-{name}", F.exists(f, lambda x: ~x.isin(*words))), Rule(f"{name}-out-of-order", F.col(f) != F.array_sort(F.array_distinct(f)))]
    return out


def column_rules() -> list[Rule]:
    """On value_source, has_default, default_kind, default_on_null, length_semantics, type_kind, member_count, domain_has_check, magnitude_min, magnitude_max, has_negative, time_span, time_recent_decade and what numeric_rules() reads."""
    c = F.col
    kind = F.coalesce(c("type_kind"), F.lit(""))
    default = F.coalesce(c("has_default"), F.lit(False))
    low, high, sign = (c(x).isNotNull() for x in ("magnitude_min", "magnitude_max", "has_negative"))
    return [
        *_words(COLUMN_WORDS),
        Rule("default-kind-without-default", _given("default_kind") & ~default),
        Rule("default-on-null-without-default", c("default_on_null") & ~default),
        Rule("members-missing", kind.isin("enum", "set") & (F.coalesce(c("member_count"), F.lit(0)) <= 0)),
        Rule("members-without-kind", ~kind.isin("enum", "set") & c("member_count").isNotNull()),
        Rule("domain-check-without-domain", c("domain_has_check").isNotNull() & (kind != "domain")),
        Rule("magnitude-incomplete", (low != high) | (high != sign)),
        Rule("magnitudes-out-of-order", c("magnitude_min") > c("magnitude_max")),
        Rule("time-incomplete", _given("time_span") != c("time_recent_decade").isNotNull()),
        Rule("decade-not-whole", c("time_recent_decade") % 10 != 0),
    ]


def numeric_rules() -> list[Rule]:
    """On numeric_model, numeric_precision, numeric_scale, numeric_precision_radix and the engine of the source."""
    c = F.col
    model, radix, p, s = c("numeric_model"), F.coalesce(c("numeric_precision_radix"), F.lit("")), c("numeric_precision"), c("numeric_scale")
    limit = F.lit(MOST_DIGITS)
    for (engine, name), most in PRECISIONS.items():
        limit = F.when((c("engine") == engine) & (model == name), most).otherwise(limit)
    low, high = (F.when(c("engine") == "oracle", SCALES["oracle"][k]).otherwise((-MOST_DIGITS, MOST_DIGITS)[k]) for k in (0, 1))
    within = F.coalesce(c("engine").isin(*WITHIN), F.lit(False))
    scale = F.when(within, (s < 0) | F.coalesce(s > p, F.lit(True))).otherwise((s < low) | (s > high))
    details = p.isNotNull() | s.isNotNull() | (radix != "")
    return [
        Rule("unknown-numeric-model", ~F.coalesce(model.isin(*NUMERIC_MODELS), F.lit(False))),
        Rule("precision-zero", p == 0),
        Rule("precision-above-limit", p > limit, ("sources",)),
        Rule("scale-out-of-range", s.isNotNull() & scale, ("sources",)),
        Rule("details-without-model", model.isin("unknown", "not-applicable") & details),
        Rule("unconstrained-decimal-inconsistent", (model == "unconstrained-decimal") & (p.isNotNull() | s.isNotNull() | (radix != "decimal"))),
        Rule("fixed-decimal-incomplete", (model == "fixed-decimal") & (p.isNull() | s.isNull() | (radix != "decimal"))),
        Rule("decimal-float-inconsistent", (model == "decimal-float") & (p.isNull() | s.isNotNull() | (radix != "binary") | (p > FLOAT_BITS))),
        Rule("binary-float-inconsistent", (model == "binary-float") & (s.isNotNull() | (radix != "binary"))),
        Rule("integer-with-scale", (model == "integer") & (s != 0)),
    ]


def table_rules() -> list[Rule]:
    """On the fields of TABLE_WORDS and TABLE_LISTS, rows, partition_count, partition_rows_max, partition_key_cols, parent_table and child_tables."""
    c = F.col
    parted = ~c("partitioning").isin("none", "unknown") & _given("partitioning")
    details = c("partition_count").isNotNull() | (F.size(F.coalesce("partition_key_cols", F.array().cast("array<int>"))) > 0) | c("partition_rows_max").isNotNull()
    rootless = F.coalesce((c("object_kind") == "ordinary-table") & (c("segment_state") == "unavailable"), F.lit(False))
    external = F.coalesce(c("object_kind") == "external-table", F.lit(False))
    outside = F.coalesce(c("storage_organization") == "external", F.lit(False))
    whole = F.coalesce(c("row_count_quality") == "exact-read", F.lit(False))
    listed = F.coalesce("listed_children", F.array().cast("array<string>"))
    return [
        *_words(TABLE_WORDS),
        *_lists(TABLE_LISTS),
        Rule("partition-count-missing", parted & c("partition_count").isNull()),
        Rule("partition-count-zero", parted & (c("partition_count") == 0) & ~rootless),
        Rule("partition-details-without-partitions", c("partitioning").isin("none", "unknown") & details),
        Rule("largest-partition-above-rows", c("partition_rows_max") > c("rows")),
        Rule("largest-partition-empty", (c("rows") > 0) & (c("partition_rows_max") == 0)),
        Rule("external-without-external-storage", external & ~outside),
        Rule("external-storage-without-external", outside & ~external),
        Rule("bounded-read-disagrees", F.coalesce(c("row_count_method") == "bounded-complete-read", F.lit(False)) != whole),
        Rule("exact-read-not-full", whole & ~F.coalesce(c("sample_fraction_band") == "full", F.lit(False))),
        Rule("partition-key-repeats", F.size(F.array_distinct("partition_key_cols")) < F.size("partition_key_cols")),
        Rule("partition-key-missing", F.size(F.array_except("partition_key_cols", F.coalesce("ordinals", F.array().cast("array<int>")))) > 0, ("columns",)),
        Rule("children-out-of-order", c("child_tables") != F.array_sort(F.array_distinct("child_tables"))),
        Rule("child-not-reciprocal", F.size(F.array_except(F.coalesce("child_tables", F.array().cast("array<string>")), listed)) > 0, ("tables",)),
        Rule("parent-not-reciprocal", _given("parent_table") & ((c("parent_table") == c("table_id")) | ~F.coalesce(F.array_contains("parents_children", c("table_id")), F.lit(False))), ("tables",)),
    ]


def scope_rules() -> list[Rule]:
    """On the fields of SCOPE_WORDS and SCOPE_LISTS."""
    c = F.col
    states = [F.coalesce(c(f"{x}_completeness"), F.lit("unknown")) for x in ("table_inventory", "row_count", "size")]
    every = lambda state: (states[0] == state) & (states[1] == state) & (states[2] == state)
    has = lambda x: F.coalesce(F.array_contains("limitations", x), F.lit(False))
    return [
        *_words(SCOPE_WORDS),
        *_lists(SCOPE_LISTS),
        Rule("incomplete-without-limitation", ~every("complete") & (F.size(F.coalesce("limitations", F.array().cast("array<string>"))) == 0)),
        Rule("inventory-visibility-unknown-but-complete", has("table-inventory-visibility-unknown") & (states[0] == "complete")),
        Rule("unknown-layout-with-coverage", (c("layout") == "unknown") & ~every("unknown")),
    ]


def inventory_rules() -> list[Rule]:
    """On the fields of INVENTORY_WORDS, object_count, external_count, has_complexity, and with sources and objects."""
    c = F.col
    files = F.coalesce(c("engine").isin(*FILE_ENGINES), F.lit(False))
    limited = F.coalesce(F.array_contains("limitations", "selection-limited"), F.lit(False))
    complex_ = F.coalesce(c("has_complexity"), F.lit(False))
    return [
        *_words(INVENTORY_WORDS),
        Rule("scope-disagrees-with-engine", files != (c("scope") == "structured-source"), ("sources",)),
        Rule("scope-disagrees-with-selection", limited != (c("scope") == "selected-schemas"), ("scopes",)),
        Rule("complexity-without-detail", complex_ & ~c("detail").isin(*WITH_COMPLEXITY)),
        Rule("complexity-missing", ~complex_ & c("detail").isin(*WITH_COMPLEXITY)),
        Rule("object-count-differs", c("object_count") != F.coalesce("n_objects", F.lit(0)), ("objects",)),
        Rule("external-count-differs", c("external_count") != F.coalesce("n_external", F.lit(0)), ("objects",)),
    ]


#: Rules by entity, and the column that names a row of it.
RULES: dict[str, tuple[str, Callable[[], list[Rule]]]] = {
    "columns": ("ordinal", lambda: column_rules() + numeric_rules()),
    "tables": ("table_id", table_rules),
    "scopes": ("source_id", scope_rules),
    "inventories": ("source_id", inventory_rules),
}


def _gathered(entity: str, needs: set[str], profile: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of an entity with what its rules need of others: engine, ordinals, listed_children and parents_children, limitations, n_objects and n_external."""
    rows, at = profile[entity], ["source_id", "table_id"]
    if "sources" in needs:
        rows = rows.join(profile["sources"].select("source_id", "engine").dropDuplicates(["source_id"]), "source_id", "left")
    if "columns" in needs:
        rows = rows.join(profile["columns"].groupBy(*at).agg(F.collect_set(F.col("ordinal").cast("int")).alias("ordinals")), at, "left")
    if "tables" in needs:
        tables = profile["tables"]
        # the tables that say they are children of one, other than itself, and what a table's parent lists
        children = tables.where(_given("parent_table") & (F.col("parent_table") != F.col("table_id"))).groupBy("source_id", F.col("parent_table").alias("table_id")).agg(F.collect_set("table_id").alias("listed_children"))
        lists = tables.select("source_id", F.col("table_id").alias("parent_table"), F.col("child_tables").alias("parents_children")).dropDuplicates(["source_id", "parent_table"])
        rows = rows.join(children, at, "left").join(lists, ["source_id", "parent_table"], "left")
    if "scopes" in needs:
        rows = rows.join(profile["scopes"].select("source_id", "limitations").dropDuplicates(["source_id"]), "source_id", "left")
    if "objects" in needs:
        counts = profile["objects"].groupBy("source_id").agg(F.count("*").alias("n_objects"), F.count("external_class").alias("n_external"))
        rows = rows.join(counts, "source_id", "left")
    return rows


def profile_violations(profile: Mapping[str, DataFrame]) -> DataFrame:
    """(source_id, entity, table_id, item, rule) for every rule that a row of a profile breaks. profile: columns, tables, scopes, inventories, sources and objects, as far as there are.

    Rules that need an entity which isn't there are left out, and so are entities themselves. Keys mustn't be NULL where rules join. Fields that are NULL break no rule but those that want them.
    """
    out = None
    for entity, (item, rules) in RULES.items():
        if entity not in profile:
            continue
        own = [r for r in rules() if all(n in profile for n in r.needs)]
        rows = _gathered(entity, {n for r in own for n in r.needs}, profile)
        broken = F.filter(F.array(*(F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in own)), lambda x: x.isNotNull())
        table = F.col("table_id").cast("string") if "table_id" in rows.columns else F.lit(None).cast("string")
        found = rows.select("source_id", F.lit(entity).alias("entity"), table.alias("table_id"), F.col(item).cast("string").alias("item"), F.explode(broken).alias("rule"))
        out = found if out is None else out.union(found)
    if out is None:
        raise ValueError(f"a profile has at least one of {', '.join(RULES)}")
    return out
