"""Snapshots of catalogs in the shapes of three engines."""

import json

import pytest
from profileloom.functions import rounding
from profileloom.operators import cells, rollups
from profileloom.sources import files
from pyspark.sql import functions as F

COLUMNS = {name: [{"attnum": k + 1, "name": c, "type": "bigint", "not_null": c != "note", "avg_width": 8} for k, c in enumerate(cols)] for name, cols in {"users": ["id", "email"], "orders": ["id", "user_id", "created", "note"]}.items()}


def snapshot(engine):
    if engine == "postgresql":
        indexes = {"users": [{"name": "pk", "method": "btree", "unique": True, "col_ords": [1]}], "orders": [{"name": "pk", "method": "btree", "unique": True, "col_ords": [1]}, {"name": "ix", "method": "gin2", "unique": False, "col_ords": [3, 2]}]}
        fks = [{"to_oid": "u", "col_ords": [2], "to_col_ords": [1]}]
    else:
        method, fk = ("BTREE", "fk_name") if engine == "mysql" else ("CLUSTERED", "fk_id")
        indexes = {"users": [{"name": "pk", "method": method, "unique": True, "seq": 1, "col_name": "id"}], "orders": [{"name": "ix", "method": "Odd", "unique": False, "seq": 2, "col_name": "user_id"}, {"name": "pk", "method": method, "unique": True, "seq": 1, "col_name": "id"}, {"name": "ix", "method": "Odd", "unique": False, "seq": 1, "col_name": "created"}]}
        fks = [{"to_oid": "u", fk: "7", "position": 1, "col_name": "user_id", "to_col_name": "id"}]
    rows = {"users": ("u", 12_500_000, 4_200_000_000, 1_100_000_000, []), "orders": ("o", 985_000, 320_000_000, 95_000_000, fks)}
    return {"schema_version": 1, "engine": engine, "engine_version": "16.0.4 built", "tables": [{"oid": i, "schema_name": "s", "table_name": t, "reltuples": n, "table_bytes": b, "index_bytes": x, "last_analyze": "2026-04-26T10:00:00Z", "columns": COLUMNS[t], "indexes": indexes[t], "fks": f} for t, (i, n, b, x, f) in rows.items()]}


def test_snapshots_of_three_engines_agree(spark):
    engines = ("postgresql", "mysql", "sqlserver")
    sets = files.catalog_snapshot(spark.createDataFrame([(json.dumps(snapshot(e)), 1, "x") for e in engines], "snapshot string, v int, engine string"))
    tables = sets["tables"]
    totals = tables.groupBy("engine").agg(F.sum(rounding.round_rows("rows")).alias("rows"), F.sum(rounding.round_bytes("table_bytes")).alias("bytes"), F.sum(rounding.round_bytes("index_bytes")).alias("index"), F.count("*").alias("n"), F.max("engine_version").alias("version"), F.min("analyzed_at").cast("string").alias("at")).collect()
    assert {tuple(r)[1:] for r in totals} == {(13_485_000, 4_514_119_680, 1_143_996_416, 2, "16.0.4", "2026-04-26 10:00:00")}
    for e in engines:
        own = {k: [r for r in df.where(F.col("engine") == e).collect()] for k, df in sets.items()}
        method = {"postgresql": "btree", "mysql": "btree", "sqlserver": "clustered"}[e]
        assert {(r.table_id, r.name, r.method, r.is_unique, tuple(r.cols)) for r in own["indexes"]} == {("u", "pk", method, True, (1,)), ("o", "pk", method, True, (1,)), ("o", "ix", "other", False, (3, 2))}
        assert [(r.child, r.parent, r.child_cols, r.parent_cols) for r in own["fk_edges"]] == [("o", "u", [2], [1])]
        assert {r.family for r in own["columns"]} == {"bigint" if e == "postgresql" else "integer"} and sum(r.nullable for r in own["columns"]) == 1


def test_snapshots_with_gaps(spark):
    odd = {"engine": "mysql", "tables": [{"oid": "a", "reltuples": "many", "columns": "none", "indexes": [{"name": "x", "seq": 1, "col_name": "gone"}, {"name": "y"}], "fks": [{"to_oid": "b", "fk_name": "f", "position": 2, "col_name": "p", "to_col_name": "q"}, {"to_oid": "b", "fk_name": "f", "position": 1, "col_name": "gone", "to_col_name": "q"}]}, {"oid": "b", "reltuples": -1, "columns": [{"attnum": 4, "name": "q"}]}]}
    rows = [("1", json.dumps(odd)), ("2", "no json"), ("3", None), ("4", "[]"), ("5", '{"tables": {}}')]
    sets = files.catalog_snapshot(spark.createDataFrame(rows, "snapshot_id string, snapshot string"))
    assert [(r.table_id, r.rows) for r in sets["tables"].orderBy("table_id").collect()] == [("a", None), ("b", 0)]
    assert {(r.name, tuple(r.cols or ())) for r in sets["indexes"].collect()} == {("x", (None,)), ("y", ())}
    assert [(r.child_cols, r.parent_cols) for r in sets["fk_edges"].collect()] == [([None, None], [4, 4])]
    empty = files.catalog_snapshot(spark.createDataFrame([], "snapshot string"))
    assert all(df.collect() == [] for df in empty.values())


def test_profiles_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "column_name string, n long")
    for _ in range(2):
        files.write_profile({"columns": rows, "tables": rows.limit(1)}, str(tmp_path), "2")
    files.write_profile({"columns": rows.limit(2)}, str(tmp_path), "10")
    assert {(r.run_id, r["count"]) for r in files.read_profile(spark, str(tmp_path), "columns").groupBy("run_id").count().collect()} == {("2", 3), ("10", 2)}
    with pytest.raises(Exception, match="gone"):
        files.write_profile({"columns": rows, "tables": rows.selectExpr("column_name", "raise_error('gone') AS n")}, str(tmp_path), "11")
    assert spark.read.parquet(f"{tmp_path}/columns").where("run_id = 11").count() == 3
    assert {r.run_id for r in files.read_profile(spark, str(tmp_path), "columns").collect()} == {"2", "10"}
    assert files.read_profile(spark, str(tmp_path), "tables").count() == 1


def test_buckets_stop_at_the_largest_long(spark):
    top = (1 << 63) - 1
    rows = spark.createDataFrame([(top, 100), (top, 7), (top - 5, 0), (150, 100), (149, 100), (7, 3), (8, 3), (None, 3)], "x long, b long")
    got = [r[0] for r in rows.select(rounding.round_to_bucket("x", rows.b)).collect()]
    assert got == [top // 100 * 100, top // 7 * 7, top - 5, 200, 100, 6, 9, None]


def test_selectors(spark):
    sources = spark.createDataFrame([("a", "mysql", ["x"]), ("b", "mysql", ["y"]), ("c", "oracle", ["x"])], "source_id string, engine string, tags array<string>")
    tables = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("b", "t2"), ("c", "t2")], "source_id string, table_id string")
    ids = lambda df: sorted(r.source_id for r in df.collect())
    assert ids(rollups.select_sources(sources, ["mysql"], "x")) == ["a"] and ids(rollups.select_sources(sources)) == ["a", "b", "c"]
    assert ids(rollups.select_sources(sources, table="t1", tables=tables)) == ["a", "b"]
    assert ids(rollups.select_sources(sources, source_ids=["c", "a", "c"], tables=tables, table="t2")) == ["c"]
    with pytest.raises(ValueError, match="nowhere"):
        rollups.select_sources(sources, source_ids=["a", "nowhere"])
    assert rollups.select_scope(sources, "engine", []).count() == 0 and rollups.missing_names(sources, "engine", ["x", "mysql"]).first()[0] == "x"


def test_transfer_columns_are_in_order(spark):
    rows = spark.createDataFrame([(2, "b", None), (1, "z", "plain"), (2, "a", "plain"), (3, "c", "rowversion")], "ordinal int, name string, kind string")
    assert [(r.ordinal, r.name) for r in cells.transfer_columns(rows).collect()] == [(1, "z"), (2, "a"), (2, "b")]


def test_snapshots_are_parsed_once(spark, capsys):
    text = '{"engine":"mysql","tables":[{"oid":1,"columns":[{"attnum":2,"name":"a","type":"int"},{"attnum":3,"name":"b","type":"int"},{"attnum":"x","name":"c","type":"int"}],"indexes":[{"name":"i","seq":2,"col_name":"a"},{"name":"j","cols":[3]},{"name":"i","seq":1,"col_name":"b"}],"fks":[{"fk_id":"f","to_oid":1,"seq":1,"col_name":"b","to_col_name":"a"},{"fk_id":"g","to_oid":9,"seq":1,"col_name":"a","to_col_name":"a"}]}]}'
    sets = files.catalog_snapshot(spark.createDataFrame([(text,)], "snapshot string"))
    for df in sets.values():
        df.explain()
    assert "parse_json" not in capsys.readouterr().out.lower()
    assert sorted((r.name, r.cols) for r in sets["indexes"].collect()) == [("i", [3, 2]), ("j", [3])]
    assert sorted((r.name, r.child_cols, r.parent_cols) for r in sets["fk_edges"].collect()) == [("f", [3], [2]), ("g", [2], [None])]
    assert sorted(((r.name, r.ordinal, r.family) for r in sets["columns"].collect())) == [("a", 2, "integer"), ("b", 3, "integer"), ("c", None, "integer")]


def test_keys_find_columns_of_repeated_tables_without_grouping(spark, capsys):
    one = lambda k, *names: {"oid": "t", "columns": [{"attnum": k + i, "name": n} for i, n in enumerate(names)]}
    fks = [{"fk_id": "f", "to_oid": "t", "seq": i, "col_name": "a", "to_col_name": c} for i, c in enumerate("abcd")]
    text = json.dumps({"engine": "mysql", "tables": [one(5, "b", "c"), one(1, "a", "b"), one(9, "b", "c"), {"oid": "u", "columns": [{"attnum": 7, "name": "a"}], "fks": fks}]})
    edges = files.catalog_snapshot(spark.createDataFrame([(text,)], "snapshot string"))["fk_edges"]
    assert [(r.child, r.child_cols, r.parent_cols) for r in edges.collect()] == [("u", [7] * 4, [1, 2, 6, None])]
    edges.explain()
    assert "Aggregate" not in capsys.readouterr().out


def test_parts_of_a_folder_are_one_table(spark, tmp_path):
    from profileloom import queries

    root = f"{tmp_path}/a b"
    spark.range(10).selectExpr("id AS doc_id").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.range(4).selectExpr("id AS doc_id").coalesce(1).write.parquet(f"{root}/documents.parquet.more")
    assert list(map(tuple, queries.queries()["profile_per_file"](spark, root).collect())) == [("table-001", "documents.parquet", 10)]
    both = [f"{root}/documents.parquet", f"file:{root}/documents.parquet.more/"]
    got = files.profile_per_file(spark.read.parquet(*both), both).collect()
    assert sorted((r.file, r.n_rows) for r in got) == [("documents.parquet", 10), ("documents.parquet.more", 4)]
    assert files.profile_per_file(spark.read.parquet(*both), both[1:]).count() == 4 == files.profile_per_file(spark.read.parquet(*both)).count()
