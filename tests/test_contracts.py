"""Each rule of a profile: a row that breaks it, and one that doesn't."""

import pytest
from profileloom.operators import contracts as R

COLUMNS = "source_id string, table_id string, ordinal int, value_source string, has_default boolean, default_kind string, default_on_null boolean, length_semantics string, type_kind string, member_count long, domain_has_check boolean, magnitude_min int, magnitude_max int, has_negative boolean, time_span string, time_recent_decade int, numeric_model string, numeric_precision int, numeric_scale int, numeric_precision_radix string, rule string, item string"
TABLES = "source_id string, table_id string, rows long, object_kind string, storage_organization string, partitioning string, segment_state string, partition_count long, partition_key_cols array<int>, partition_rows_max long, table_features array<string>, table_limitations array<string>, parent_table string, child_tables array<string>, row_count_method string, row_count_quality string, statistics_state string, refresh_age_band string, modification_ratio_band string, sample_fraction_band string, engine string"
SCOPES = "source_id string, layout string, table_inventory_completeness string, row_count_completeness string, size_completeness string, row_count_method string, size_method string, limitations array<string>"
INVENTORIES = "source_id string, scope string, detail string, visibility string, object_count long, external_count long, has_complexity boolean"


def rows(spark, schema, *items, **always):
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple((always | i).get(n) for n in names) for i in items], schema)


def broken(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item, set()).add(r.rule)
    return out


GOOD_COLUMN = {"source_id": "p", "table_id": "t", "numeric_model": "integer"}
BAD_COLUMNS = [
    ({"value_source": "magic"}, {"unknown-value-source"}), ({"default_kind": "constant"}, {"default-kind-without-default"}), ({"default_kind": "odd", "has_default": True}, {"unknown-default-kind"}),
    ({"default_on_null": True, "has_default": False}, {"default-on-null-without-default"}), ({"length_semantics": "bits"}, {"unknown-length-semantics"}), ({"type_kind": "odd"}, {"unknown-type-kind"}),
    ({"type_kind": "enum"}, {"members-missing"}), ({"type_kind": "set", "member_count": 0}, {"members-missing"}), ({"member_count": 3}, {"members-without-kind"}), ({"domain_has_check": False}, {"domain-check-without-domain"}),
    ({"magnitude_min": 1}, {"magnitude-incomplete"}), ({"magnitude_min": 3, "magnitude_max": 1, "has_negative": False}, {"magnitudes-out-of-order"}), ({"time_span": "days"}, {"time-incomplete"}), ({"time_span": "days", "time_recent_decade": 1995}, {"decade-not-whole"}), ({"time_span": "eons", "time_recent_decade": 1990}, {"unknown-time-span"}),
    ({"numeric_model": None}, {"unknown-numeric-model"}), ({"numeric_model": "odd"}, {"unknown-numeric-model"}), ({"numeric_precision": 0}, {"precision-zero"}), ({"numeric_precision": 1001}, {"precision-above-limit"}), ({"numeric_precision_radix": "octal"}, {"unknown-numeric-precision-radix"}),
    ({"source_id": "m", "numeric_model": "fixed-decimal", "numeric_precision": 66, "numeric_scale": 2, "numeric_precision_radix": "decimal"}, {"precision-above-limit"}), ({"source_id": "m", "numeric_model": "fixed-decimal", "numeric_precision": 5, "numeric_scale": 6, "numeric_precision_radix": "decimal"}, {"scale-out-of-range"}),
    ({"source_id": "o", "numeric_model": "fixed-decimal", "numeric_precision": 5, "numeric_scale": -85, "numeric_precision_radix": "decimal"}, {"scale-out-of-range"}), ({"numeric_model": "unknown", "numeric_scale": 1}, {"details-without-model"}), ({"numeric_model": "unconstrained-decimal"}, {"unconstrained-decimal-inconsistent"}),
    ({"numeric_model": "fixed-decimal", "numeric_precision": 4}, {"fixed-decimal-incomplete"}), ({"numeric_model": "decimal-float", "numeric_precision": 127, "numeric_precision_radix": "binary"}, {"decimal-float-inconsistent"}), ({"numeric_model": "binary-float", "numeric_scale": 1, "numeric_precision_radix": "binary"}, {"binary-float-inconsistent"}), ({"numeric_scale": 2}, {"integer-with-scale"}),
]
FINE_COLUMNS = [
    {}, {"value_source": "identity", "has_default": True, "default_kind": "function", "default_on_null": True}, {"type_kind": "enum", "member_count": 2}, {"type_kind": "domain", "domain_has_check": True}, {"magnitude_min": 1, "magnitude_max": 1, "has_negative": True}, {"time_span": "weeks", "time_recent_decade": 2020},
    {"numeric_model": "not-applicable", "length_semantics": "bytes"}, {"numeric_model": "unconstrained-decimal", "numeric_precision_radix": "decimal"}, {"numeric_model": "fixed-decimal", "numeric_precision": 1000, "numeric_scale": -1000, "numeric_precision_radix": "decimal"}, {"source_id": "o", "numeric_model": "decimal-float", "numeric_precision": 126, "numeric_precision_radix": "binary"}, {"numeric_model": "binary-float", "numeric_precision": 53, "numeric_precision_radix": "binary"},
]
SOURCES = [("p", "postgresql"), ("m", "mysql"), ("o", "oracle"), ("f", "parquet")]


def test_columns(spark):
    all_ = [GOOD_COLUMN | x | {"ordinal": k} for k, x in enumerate([x for x, _ in BAD_COLUMNS] + FINE_COLUMNS)]
    profile = {"columns": rows(spark, COLUMNS, *all_), "sources": spark.createDataFrame(SOURCES, "source_id string, engine string")}
    want = {str(k): names for k, (_, names) in enumerate(BAD_COLUMNS)}
    assert broken(R.profile_violations(profile)) == want
    # without the sources, the rules that need an engine are left out
    less = {k: v - {"precision-above-limit", "scale-out-of-range"} for k, v in want.items()}
    assert broken(R.profile_violations({"columns": profile["columns"]})) == {k: v for k, v in less.items() if v}
    assert R.profile_violations({"columns": profile["columns"].where("false")}).collect() == []
    with pytest.raises(ValueError):
        R.profile_violations({})


GOOD_TABLE = {"source_id": "p", "rows": 10, "object_kind": "ordinary-table", "storage_organization": "heap", "partitioning": "none", "segment_state": "created", "row_count_method": "postgres-planner-estimate", "row_count_quality": "engine-estimate", "statistics_state": "current", "sample_fraction_band": "full"}
BAD_TABLES = [
    ({"object_kind": "odd"}, {"unknown-object-kind"}), ({"storage_organization": "odd"}, {"unknown-storage-organization"}), ({"partitioning": "odd", "partition_count": 1}, {"unknown-partitioning"}), ({"segment_state": "odd"}, {"unknown-segment-state"}), ({"row_count_method": "odd"}, {"unknown-row-count-method"}),
    ({"row_count_quality": "odd"}, {"unknown-row-count-quality"}), ({"statistics_state": "odd"}, {"unknown-statistics-state"}), ({"refresh_age_band": "odd"}, {"unknown-refresh-age-band"}), ({"modification_ratio_band": "odd"}, {"unknown-modification-ratio-band"}), ({"sample_fraction_band": "odd"}, {"unknown-sample-fraction-band"}),
    ({"table_features": ["graph-node", "graph-edge"]}, {"table-features-out-of-order"}), ({"table_features": ["odd"]}, {"unknown-table-features"}), ({"table_limitations": ["row-security-filter-active"] * 2}, {"table-limitations-out-of-order"}), ({"table_limitations": ["odd"]}, {"unknown-table-limitations"}),
    ({"partitioning": "range"}, {"partition-count-missing"}), ({"partitioning": "hash", "partition_count": 0}, {"partition-count-zero"}), ({"partition_count": 1}, {"partition-details-without-partitions"}), ({"partitioning": "unknown", "partition_key_cols": [1]}, {"partition-details-without-partitions"}),
    ({"partitioning": "list", "partition_count": 2, "partition_rows_max": 11}, {"largest-partition-above-rows"}), ({"partitioning": "list", "partition_count": 2, "partition_rows_max": 0}, {"largest-partition-empty"}), ({"object_kind": "external-table"}, {"external-without-external-storage"}), ({"storage_organization": "external"}, {"external-storage-without-external"}),
    ({"row_count_method": "bounded-complete-read"}, {"bounded-read-disagrees"}), ({"row_count_quality": "exact-read"}, {"bounded-read-disagrees"}), ({"row_count_method": "bounded-complete-read", "row_count_quality": "exact-read", "sample_fraction_band": "50-74pct"}, {"exact-read-not-full"}),
    ({"partitioning": "key", "partition_count": 1, "partition_key_cols": [1, 1]}, {"partition-key-repeats"}), ({"partitioning": "key", "partition_count": 1, "partition_key_cols": [2]}, {"partition-key-missing"}), ({"child_tables": ["y", "x"]}, {"children-out-of-order", "child-not-reciprocal"}), ({"child_tables": ["nowhere"]}, {"child-not-reciprocal"}), ({"parent_table": "nowhere"}, {"parent-not-reciprocal"}),
]
FINE_TABLES = [{}, {"partitioning": "range", "partition_count": 3, "partition_key_cols": [1], "partition_rows_max": 10}, {"partitioning": "hash", "partition_count": 0, "segment_state": "unavailable"}, {"object_kind": "external-table", "storage_organization": "external"}, {"row_count_method": "bounded-complete-read", "row_count_quality": "exact-read"}, {"table_features": ["graph-edge", "temporal-current"], "table_limitations": []}]


def test_tables(spark):
    all_ = [GOOD_TABLE | x | {"table_id": f"{k:02}"} for k, x in enumerate([x for x, _ in BAD_TABLES] + FINE_TABLES)]
    family = [GOOD_TABLE | {"table_id": "mother", "child_tables": ["one", "two"]}, GOOD_TABLE | {"table_id": "one", "parent_table": "mother"}, GOOD_TABLE | {"table_id": "two", "parent_table": "mother"}, GOOD_TABLE | {"table_id": "three", "parent_table": "mother"}, GOOD_TABLE | {"table_id": "own", "parent_table": "own", "child_tables": ["own"]}, GOOD_TABLE | {"source_id": "m", "table_id": "mother"}]
    columns = rows(spark, COLUMNS, *({"source_id": "p", "table_id": t["table_id"], "ordinal": 1, "numeric_model": "unknown"} for t in all_))
    want = {f"{k:02}": names for k, (_, names) in enumerate(BAD_TABLES)} | {"three": {"parent-not-reciprocal"}, "own": {"child-not-reciprocal", "parent-not-reciprocal"}}
    got = broken(R.profile_violations({"tables": rows(spark, TABLES, *all_, *family), "columns": columns}).where("entity = 'tables'"))
    assert got == want


def test_scopes_and_inventories(spark):
    full = {"layout": "full-copy", "table_inventory_completeness": "complete", "row_count_completeness": "complete", "size_completeness": "complete", "row_count_method": "parquet-footer", "size_method": "mixed"}
    cases = {
        "fine": (full, set()), "limited": (full | {"size_completeness": "unknown", "limitations": ["selection-limited"]}, set()), "bare": (full | {"size_completeness": "incomplete"}, {"incomplete-without-limitation"}), "layout": (full | {"layout": "odd"}, {"unknown-layout"}), "state": (full | {"row_count_completeness": "most", "limitations": ["statistics-stale"]}, {"unknown-row-count-completeness"}),
        "order": (full | {"limitations": ["topology-unobserved", "failed-sources"]}, {"limitations-out-of-order"}), "word": (full | {"limitations": ["odd"]}, {"unknown-limitations"}), "seen": (full | {"limitations": ["table-inventory-visibility-unknown"]}, {"inventory-visibility-unknown-but-complete"}), "blind": (full | {"layout": "unknown"}, {"unknown-layout-with-coverage"}), "method": (full | {"size_method": "guess", "row_count_method": "guess"}, {"unknown-size-method", "unknown-row-count-method"}),
    }
    scopes = rows(spark, SCOPES, *(x | {"source_id": k} for k, (x, _) in cases.items()))
    assert broken(R.profile_violations({"scopes": scopes})) == {k: v for k, (_, v) in cases.items() if v}
    own = {"scope": "all-visible-schemas", "detail": "summary", "visibility": "full", "object_count": 0, "external_count": 0}
    cases = {
        "fine": (own | {"detail": "graph", "has_complexity": True, "object_count": 2, "external_count": 1}, set()), "limited": (own | {"scope": "selected-schemas"}, set()), "bare": (own | {"scope": "selected-schemas"}, {"scope-disagrees-with-selection"}), "f": (own, {"scope-disagrees-with-engine"}), "layout": (own | {"scope": "structured-source"}, {"scope-disagrees-with-engine"}),
        "state": (own | {"detail": "graph"}, {"complexity-missing"}), "order": (own | {"has_complexity": True}, {"complexity-without-detail"}), "word": (own | {"object_count": 1}, {"object-count-differs"}), "seen": (own | {"external_count": 1}, {"external-count-differs"}), "blind": (own | {"detail": "odd", "visibility": "odd", "scope": "odd"}, {"unknown-detail", "unknown-visibility", "unknown-scope"}),
    }
    profile = {"scopes": scopes, "inventories": rows(spark, INVENTORIES, *(x | {"source_id": k} for k, (x, _) in cases.items())), "sources": spark.createDataFrame(SOURCES, "source_id string, engine string"), "objects": spark.createDataFrame([("fine", None), ("fine", "mail")], "source_id string, external_class string")}
    assert broken(R.profile_violations(profile).where("entity = 'inventories'")) == {k: v for k, (_, v) in cases.items() if v}


def test_every_rule_has_a_row_that_breaks_it():
    seen = {n for _, names in BAD_COLUMNS + BAD_TABLES for n in names}
    assert {r.name for r in R.column_rules() + R.numeric_rules() + R.table_rules()} <= seen
