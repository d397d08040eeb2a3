"""Permutations in windows, calibration by bisection, catalogs of tables."""

import pytest
from profileloom.operators import compression as Z
from profileloom.plans import calibration as K
from profileloom.plans import catalog as D
from profileloom.plans import generation as M
from profileloom.plans import permutation as R
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 97, 1000])
def test_permutations_stay_in_their_windows(spark, n):
    for entropy in (0.0, 0.35, 0.8, 1.0, 7.0, -1.0):
        rows = R.permuted(spark.range(n).withColumn("p", F.lit("other")).withColumnRenamed("p", "x"), "id", {"p": (F.lit(n), 3, F.lit(entropy))})
        rows = rows.withColumn("w", R.window_size(F.lit(n), F.lit(entropy))).collect()
        assert sorted(r.p for r in rows) == list(range(n))
        assert all(r.p // r.w == r.id // r.w for r in rows)
        assert rows[0].w == (1 if entropy <= 0 else n if entropy >= 1 else rows[0].w)


def test_locality_grows_with_entropy(spark):
    n, far = 5000, []
    for entropy in (0.0, 0.25, 0.5, 0.75, 1.0):
        far.append(R.permuted(spark.range(n), "id", {"p": (F.lit(n), 1, F.lit(entropy))}).agg(F.avg(F.abs(F.col("p") - F.col("id")))).first()[0])
    assert far[0] == 0 and all(a < b for a, b in zip(far, far[1:], strict=False))
    assert n * 0.3 < far[-1] < n * 0.37  # a random order: a third
    steps = [r.p for r in R.permuted(spark.range(n), "id", {"p": (F.lit(n), 1, F.lit(1.0))}).orderBy("id").collect()]
    assert len({(b - a) % n for a, b in zip(steps, steps[1:], strict=False)}) > n / 2


def test_null_and_large_numbers(spark):
    n = 1 << 62
    rows = spark.range(5000).select((F.lit(n - 1) - F.col("id") * 7).alias("i"))
    got = [r.p for r in R.permuted(rows, "i", {"p": (F.lit(n), 2, F.lit(1.0))}).collect()]
    assert len(set(got)) == 5000 and min(got) >= 0 and max(got) < n


def test_entropy_orders_values_of_a_table(spark):
    """Few values: the same counts at any entropy, but fewer changes from row to row where it is low."""
    changes, counts = [], set()
    for entropy in (0.0, 0.4, 0.8, 1.0):
        rows = [r.x for r in M.generate_table(spark, "t", 4000, [M.ColumnProfile("x", "integer", 10, entropy=entropy)], 1).collect()]
        changes.append(sum(a != b for a, b in zip(rows, rows[1:], strict=False)))
        counts.add(tuple(sorted(map(rows.count, set(rows)))))
    assert len(counts) == 1 and changes[0] == 9 and all(a < b for a, b in zip(changes, changes[1:], strict=False))


def test_bytes_and_digits_by_sha256(spark):
    import hashlib

    digest = lambda *x: hashlib.sha256("".join(map(str, x)).encode()).hexdigest()
    for entropy in (0.0, 0.3, 1.0):
        for r in spark.range(40).select("id", F.lower(F.hex(M.gen_binary("id", F.lit(100), entropy))).alias("b"), M.gen_text("id", F.lit(77), "hex", entropy).alias("h")).collect():
            blocks = "".join(digest(r.id, ":", k) if int(digest(r.id, "/", k)[:4], 16) < entropy * 65536 else digest("0") for k in range(6))
            want = digest(r.id)[:16] + blocks
            assert r.b == want[:200] and r.h == (f"{r.id:x}" + want)[:77]


def test_texts_compress_by_their_entropy(spark):
    for family in ("text", "hex", "json", "binary", "base64", "numeric-text", "xml"):
        ratios = K._measured(spark, "t", 3000, [(M.ColumnProfile("x", family, 3000, length_avg=120, length_p95=120), e) for e in (0.0, 0.25, 0.5, 0.75, 1.0)])
        assert all(a > b for a, b in zip(ratios, ratios[1:], strict=False)), (family, ratios)


def test_calibration_meets_its_targets(spark):
    columns = [M.ColumnProfile(f, f, 6000, 0.1, 0.0, 90, 150) for f in ("text", "hex", "json", "binary")] + [M.ColumnProfile("few", "integer", 50), M.ColumnProfile("other", "integer", 9)]
    got = {r.column_name: r for r in K.calibrate_entropy(spark, "t", 8000, columns, {"text": 3.0, "hex": 4.0, "json": 6.0, "binary": 2.5, "few": 5.0}).collect()}
    assert got.keys() == {"text", "hex", "json", "binary", "few"}
    assert all(r.matched and r.error <= K.TOLERANCE for c, r in got.items() if c != "few"), got
    assert got["few"].error < 0.1 and all(3 <= r.observations <= 3 + 2 * K.ROUNDS for r in got.values())
    beyond = K.calibrate_entropy(spark, "t", 2000, columns[1:2], {"hex": 1.2}).first()
    assert not beyond.matched and beyond.entropy > 0.9 and 1.8 < beyond.ratio < 2.2
    assert K.calibrate_entropy(spark, "t", 2000, columns, {}).collect() == []
    with pytest.raises(ValueError):
        K.calibrate_entropy(spark, "t", 10, columns, {"hex": float("nan")})


def test_table_calibration_keeps_the_columns_order(spark):
    columns = [M.ColumnProfile("a", "text", 5000, 0.0, 0.0, 80, 80, entropy=0.2), M.ColumnProfile("b", "hex", 5000, 0.0, 0.0, 80, 80, entropy=0.6), M.ColumnProfile("c", "binary", 5000, 0.0, 0.0, 60, 60, entropy=0.9)]
    shifted, row = K.calibrate_table(spark, "t", 5000, columns, 3.0, {"c": 1.0})
    r = row.first()
    assert r.matched and r.error <= K.TOLERANCE
    assert shifted[2].entropy == 0.9 and 0 < shifted[0].entropy < shifted[1].entropy < 1
    assert K.shifted_entropy(0.4, 0.4, 0.7) == pytest.approx(0.7) and K.shifted_entropy(0.3, 0.5, 0.5) == pytest.approx(0.3)
    assert [K.shifted_entropy(e, 0.5, 1.0) for e in (0.0, 0.5, 1.0)] == [0.0, 1.0, 1.0] and [K.shifted_entropy(e, 0.5, 0.0) for e in (0.0, 0.5, 1.0)] == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_frames_are_cut_at_a_thousand_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    keys = {"numbered": "id", "same": "7L", "none": "cast(null AS long)", "mixed": "if(id % 3 = 0, null, id % 5)"}
    for key in keys.values():
        rows = spark.range(20_000).selectExpr(f"{key} AS k", "if(id % 4 = 0, null, id % 9) AS c")
        assert Z.frame_compression(rows, "k", ["c"]).first().frames == 20
    rows = spark.range(4_500).selectExpr("id AS k", "id % 9 AS c", "if(id < 2001, 'x', null) AS g")
    assert {r.g: r.frames for r in Z.frame_compression(rows, "k", ["c"], by="g").collect()} == {"x": 3, None: 3}
    assert Z.frame_compression(rows.where("false"), "k", ["c"]).first().frames == 0
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_have_their_bytes(spark):
    cells = spark.createDataFrame([("a", k, "x" * n) for k, n in enumerate((10, 200_000, 65_535, 65_536, 0))] + [("a", 9, None)], "column_name string, row_id long, cell string")
    assert Z.column_compression(cells).first().raw_bytes == 10 + 200_000 + 65_535 + 65_536 + 6


# catalogs

COLUMNS = {
    "a": {1: M.ColumnProfile("id", "integer", 200), 2: M.ColumnProfile("code", "text", 200, length_avg=9), 3: M.ColumnProfile("b_id", "integer", 100), 4: M.ColumnProfile("up", "integer", 50)},
    "b": {1: M.ColumnProfile("x", "integer", 10), 2: M.ColumnProfile("y", "text", 12), 3: M.ColumnProfile("a_id", "integer", 90)},
    "c": {1: M.ColumnProfile("x", "integer", 10), 2: M.ColumnProfile("y", "text", 12), 3: M.ColumnProfile("code", "text", 20), 4: M.ColumnProfile("n", "integer", 3)},
    "d": {1: M.ColumnProfile("a_id", "integer", 100), 2: M.ColumnProfile("c_code", "text", 9)},
    "e": {1: M.ColumnProfile("id", "integer", 5)},
}
TABLES = [(t, n, sorted(COLUMNS[t])) for t, n in (("a", 200), ("b", 100), ("c", 5000), ("d", 900), ("e", 0))]
KEYS = [("a", 1, [1]), ("a", 2, [2]), ("b", 1, [1, 2]), ("c", 1, [3, 4]), ("d", 1, [1, 2])]
EDGES = [
    (1, "a", [3], "b", [1]), (2, "b", [3], "a", [1]), (3, "a", [4], "a", [1]), (4, "c", [1, 2], "b", None), (5, "c", [3], "a", [2]), (6, "d", [1], "a", None), (7, "d", [2], "a", [2]),
    (8, "c", [1], "e", [1]), (9, "c", [9], "a", [1]), (10, "c", [4], "z", [1]), (11, "c", [1], "a", [1]), (12, "z", [1], "a", [1]),
]


def planned(spark, **more):
    tables = spark.createDataFrame(TABLES, "table_id string, rows long, cols array<int>")
    keys = spark.createDataFrame(KEYS, "table_id string, key_no int, cols array<int>")
    edges = spark.createDataFrame(EDGES, "edge_id int, child string, child_cols array<int>, parent string, parent_cols array<int>")
    return D.catalog_plan(tables, keys, edges, **more)


def test_catalog_plan(spark):
    plan = planned(spark)
    status = {r.edge_id: r.status for r in plan.edges.collect()}
    assert status == {1: "deferred", 2: "deferred", 3: "emitted", 4: "emitted", 5: "emitted", 6: "emitted", 7: "emitted", 8: "unsupported", 9: "unsupported", 10: "external", 11: "unsupported"}
    assert {r.edge_id: r.parent_cols for r in plan.edges.where("edge_id IN (4, 6)").collect()} == {4: [1, 2], 6: [1]}
    assert [(r.table_id, r.name, r.level) for r in plan.tables.orderBy("load_order").collect()] == [("a", "t0001", 0), ("b", "t0002", 0), ("e", "t0005", 0), ("c", "t0003", 1), ("d", "t0004", 1)]
    assert tuple(D.plan_summary(plan).first()) == (11, 5, 2, 0, 1, 3)
    assert planned(spark, keep_cycles=False).edges.where("status = 'cycle'").count() == 2
    few = planned(spark, selected=["c", "a"], scale=0.1)
    assert {r.table_id: r.rows for r in few.tables.collect()} == {"a": 20, "c": 500}
    assert {r.edge_id: r.status for r in few.edges.collect()} == {1: "external", 3: "emitted", 4: "external", 5: "emitted", 8: "external", 9: "unsupported", 10: "external", 11: "emitted"}
    with pytest.raises(ValueError, match="nowhere"):
        planned(spark, selected=["nowhere"])


def test_generated_catalogs_hold(spark, tmp_path):
    plan = planned(spark)
    stats = {4: D.EdgeProfile(0.5, 0.3, 0.1, (1, 4, 20)), 5: D.EdgeProfile(0.1), 2: D.EdgeProfile(0.9, 0.0, 0.2)}
    made = D.generate_catalog(spark, plan, COLUMNS, stats)
    assert list(made) == ["a", "b", "e", "c", "d"] and made["e"].count() == 0
    for r in D.check_catalog(plan, made, COLUMNS).collect():
        assert r.held == r.rows, r
    c = made["c"].cache()
    assert 350 < c.where("x is null").count() < 650 and c.where("(x is null) <> (y is null)").count() == 0
    top = c.where("x is not null").groupBy("x", "y").count().orderBy(F.desc("count")).first()["count"]
    assert 1200 < top < 1600 and c.select("x", "y").dropna().distinct().count() == 50
    assert c.select("code").distinct().count() == 20
    # the same values whoever asks, and wherever rows are made
    assert c.join(made["a"].select("code"), "code", "left_anti").count() == made["d"].join(made["a"].select(F.col("code").alias("c_code")), "c_code", "left_anti").count() == 0
    D.write_catalog(plan, made, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t0003").exceptAll(c).count() == 0


def test_catalog_of_columns_in_a_circle(spark):
    """Two tables whose keys are each other's foreign keys: no rows can start there, so neither edge is made."""
    tables = spark.createDataFrame([("a", 5, [1]), ("b", 5, [1])], "table_id string, rows long, cols array<int>")
    keys = spark.createDataFrame([("a", 1, [1]), ("b", 1, [1])], "table_id string, key_no int, cols array<int>")
    edges = spark.createDataFrame([(1, "a", [1], "b", [1]), (2, "b", [1], "a", [1]), (3, "a", [1], "a", [1])], "edge_id int, child string, child_cols array<int>, parent string, parent_cols array<int>")
    plan = D.catalog_plan(tables, keys, edges)
    assert {r.edge_id: r.status for r in plan.edges.collect()} == {1: "unsupported", 2: "unsupported", 3: "unsupported"}
    columns = {t: {1: M.ColumnProfile("id", "integer", 5)} for t in "ab"}
    made = D.generate_catalog(spark, plan, columns)
    assert made["a"].distinct().count() == 5
    nothing = D.catalog_plan(tables.where("false"), keys, edges)
    assert D.generate_catalog(spark, nothing, columns) == {} and D.check_catalog(nothing, {}, columns).collect() == []


def test_entropy_by_kinds(spark):
    rows = spark.createDataFrame([("a", None, None, True, False, None), ("a", 8.0, None, True, False, False), ("b", None, None, False, True, False), ("c", None, 40.0, False, False, None), ("d", None, 0.5, False, False, None), ("e", None, None, True, False, True), (None, 2.5, None, False, False, False)], "table_id string, ratio double, table_ratio double, is_text boolean, is_binary boolean, is_large boolean")
    got = sorted((r.table_id or "", r.ratio or 0, r.entropy) for r in Z.entropy_profile(rows).collect())
    assert got == [("", 2.5, 0.45), ("a", 0, 0.5), ("a", 8.0, 0.12), ("b", 0, 0.75), ("c", 0, 0.02), ("d", 0, 0.8), ("e", 0, 0.35)]


def test_sql_of_gen_temporal_follows_the_calendar_past_its_last_year(spark, tmp_path):
    import duckdb
    from profileloom import queries

    keys = (0, 335, 336, 2_681_279, 2_681_280, 9_000_000, 240_000_000_000)  # the last year is 9999; then the first comes again
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, queries.queries()["gen_temporal"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.oracle_sql()["gen_temporal"]).fetchall())


def test_permuted_places_are_told_apart_by_bits(spark, sf_dir, capsys):
    from profileloom import queries

    queries.queries()["permuted_windows"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "bit_or" in plan and "p#" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_batches_are_permuted_and_keep_null(spark, n):
    rows = spark.range(n + 5).select(F.when(F.col("id") < n, F.col("id")).alias("i"))
    got = rows.select("i", R.permute_batch("i", n, 5).alias("p")).collect()
    assert sorted(r.p for r in got if r.i is not None) == list(range(n)) and all(r.p is None for r in got if r.i is None)
    top = spark.range(3000).select(R.permute_batch(F.lit((1 << 62) - 1) - F.col("id") * 7, 1 << 62, n).alias("p")).collect()
    assert len({r.p for r in top}) == 3000 and min(r.p for r in top) >= 0 and max(r.p for r in top) < 1 << 62


def test_catalogs_are_made_in_batches(spark, capsys):
    plan = planned(spark, selected=["c", "a"], scale=0.1)
    D.generate_catalog(spark, plan, COLUMNS)["c"].explain()
    assert "ArrowEvalPython" in capsys.readouterr().out


def test_edges_are_checked_without_joins(spark, capsys):
    columns = {t: {1: M.ColumnProfile("id", "integer", 3)} for t in "pc"}
    edges = spark.createDataFrame([(1, "c", [1], "p", [1])], "edge_id int, child string, child_cols array<int>, parent string, parent_cols array<int>").withColumn("status", F.lit("emitted"))
    keys = spark.createDataFrame([], "table_id string, key_no int, cols array<int>")
    tables = spark.createDataFrame([("p", 2)], "table_id string, rows long")
    made = {"p": spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long"), "c": spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id long")}
    checked = D.check_catalog(D.CatalogPlan(tables, edges, keys), made, columns)
    assert [tuple(r) for r in checked.collect()] == [("edge", "c", "1", 4, 3)]
    checked.explain()
    assert "Join" not in capsys.readouterr().out
