import hashlib
import hmac

import pytest
from profileloom.functions import rounding as R
from profileloom.functions import tokens as T
from profileloom.operators import cells as C
from profileloom.operators import columns as P
from profileloom.operators import compression as Z
from profileloom.operators import graph as G
from profileloom.operators import objects as O
from profileloom.operators import quality as Q
from profileloom.operators import rollups as U
from profileloom.operators import sampling as S
from profileloom.plans import generation as M
from profileloom.sources import files
from pyspark.sql import functions as F


def values(spark, xs, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x long").orderBy("k").select(*columns).collect()]


def test_rounding(spark):
    got = values(spark, [0, 49, 50, 10_000, 10_499, 10_500, 1_005_000, None], R.round_rows("x"), R.round_estimated_rows("x"))
    assert got == [(0, 0), (0, 100), (100, 100), (10_000, 10_000), (10_000, 10_000), (11_000, 11_000), (1_010_000, 1_010_000), (None, None)]
    assert values(spark, [32, 33, 34, 1 << 40, (1 << 40) - 1], R.quantize_count("x")) == [(32,), (34,), (34,), (1 << 40,), (1 << 40,)]
    assert values(spark, [33, 100, 20], R.quantize_count_at_most("x", 33)) == [(32,), (32,), (20,)]
    assert values(spark, [1023, 1536, 1 << 20, 1 << 30], R.round_bytes("x")) == [(1024,), (2048,), (1 << 20,), (1048576000,)]
    assert values(spark, [0, 1, 5, 10], R.quantize_non_null_rows(10, 1, "x")) == [(0,), (1,), (1,), (1,)]
    assert values(spark, [7], R.round_to_bucket("x", 0), R.round_to_bucket("x", 5)) == [(7, 5)]


def test_fractions(spark):
    rows = spark.createDataFrame([(0.0024,), (0.0025,), (2.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in rows.select(R.quantize_fraction("v")).collect()] == [0.0, 0.005, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_keyed_hash_is_an_hmac(spark):
    def framed(s):
        return len(s.encode()).to_bytes(8, "big") + s.encode()

    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("ab", None), ("é", "c")], "a string, b string").select(T.keyed_hash("d", [F.col("a"), F.col("b")], key)).collect()
        want = [hmac.new(key, b"profile" + framed("d") + framed(a) + framed(b), hashlib.sha256).hexdigest()[:16] for a, b in (("ab", ""), ("é", "c"))]
        assert [r[0] for r in got] == want


def test_letters_and_types(spark):
    assert values(spark, [1, 26, 27, 52, 702, 703], T.letters("x")) == [("A",), ("Z",), ("AA",), ("AZ",), ("ZZ",), ("AAA",)]
    rows = spark.createDataFrame([("numeric(10, 2)",), ("Numeric",), ("int8[]",), ("bit(3)",), (" timestamp with time zone ",)], "t string")
    assert [r[0] for r in rows.select(T.normalize_type("t")).collect()] == ["numeric(10,2)", "numeric", "array<bigint>", "user-defined", "timestamptz"]


def test_letters_and_types_of_engines(spark):
    assert values(spark, [0, 18278, 18279, 2**63 - 1], T.letters("x")) == [("",), ("ZZZ",), ("AAAA",), ("CRPXNLSKVLJFHG",)]
    rows = spark.createDataFrame([("mysql", "INT(11) unsigned"), ("mysql", "bit(1)"), ("mysql", "bit(8)"), ("mysql", "year"), ("mysql", "enum('a')"), ("mssql", "Decimal(10, 2)"), ("mssql", "money"), ("mssql", "timestamp"), ("mssql", "sql_variant"), ("postgresql", "int8[]"), ("db", "int"), ("mysql", None)], "e string, t string")
    got = [r[0] for r in rows.select(T.normalize_type("t", F.col("e"))).collect()]
    assert got == ["integer", "boolean", "binary", "year", "text", "decimal(10,2)", "numeric", "binary", "user-defined", "array<bigint>", "user-defined", "user-defined"]
    assert rows.select(T.normalize_type("t", "mysql")).first()[0] == "integer"
    assert values(spark, [None, 0, 1, 128, 129], T.cpu_band("x"), T.connection_band("x")) == [("unknown", "unknown"), ("unknown", "none"), ("1", "1"), ("65-128", "101-500"), ("129-plus", "101-500")]
    rates = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (10.5,), (20000.0,), (None,)], "v double")
    assert [r[0] for r in rates.select(T.rate_band("v")).collect()] == ["none", "under-1", "1-10", "11-100", "10000-plus", "unknown"]


def test_styles(spark):
    texts = ["", "deadbeef" * 2, "QUJDREVGR0hJSktMTU5PUA==\n", "1,234.5e-6", '{"a": [1, 2]}', '{"a": [1, 2}', "<a>x</a>", "Some words that are plain enough to read.", "??", None, '{"a": "' + "x" * 4000 + '"}', '{"a": "' + '\\"' * 500 + '"}', '["' + "é" * 4096 + '": 1]', '{"a}": "\\"{"}', "<!x>", "<1>"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.style for r in P.text_styles(rows, "t").orderBy("k").collect()]
    assert got == ["", "hex", "base64", "numeric-text", "json", "mixed", "xml", "natural-text", "mixed", None, "json", "json", "mixed", "json", "xml", "mixed"]
    cells = rows.select(F.lit("c").alias("column_name"), F.col("t").alias("cell"))
    assert {r.style: r.n for r in P.text_style_profile(cells.union(cells)).collect()} == {"": 2, "hex": 2, "base64": 2, "numeric-text": 2, "json": 8, "mixed": 8, "xml": 4, "natural-text": 2}


def test_ids_keep_their_digits(spark, tmp_path):
    made = M.generation_plan(spark.range(10_050).selectExpr("id AS table_id", "10L AS rows"), 1.0, 5)
    assert made.select("name").distinct().count() == 10_050 and made.where("name = 't10050' OR name = 't0001'").count() == 2
    assert values(spark, [7, 999, 1000, 12_345], O.label("table", F.col("x"))) == [("table-007",), ("table-999",), ("table-1000",), ("table-12345",)]


def test_compression_does_not_depend_on_partitions(spark):
    """The same blocks and frames, however many partitions the groups fall in; keys that are NULL or repeat are dealt over frames."""
    rows = spark.range(30_000).selectExpr("id % 3 AS column_no", "id AS row_id", "sha2(cast(id % 500 as string), 256) AS cell", "if(id % 2 = 0, null, 1) AS key")
    cells, got, frames = rows.selectExpr("concat('c', column_no) AS column_name", "row_id", "cell"), set(), set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.add(tuple(sorted((r.column_name, r.raw_bytes, r.packed_bytes, round(r.ratio_stddev, 9)) for r in Z.column_compression(cells).collect())))
        frames.add(tuple(Z.frame_compression(rows, "key", ["cell", "row_id"]).first()[:3]))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(frames) == 1 and 30 <= next(iter(frames))[0] < 90


def test_profiles_of_nothing_and_of_nulls(spark):
    none = spark.createDataFrame([], "column_name string, cell string")
    assert P.cardinality_profile(none, F.col("n_rows"), F.lit(False)).collect() == []
    nulls = spark.createDataFrame([("a", None), ("a", None)], "column_name string, cell string")
    assert P.null_profile(nulls).first().null_fraction == 1.0 and P.length_profile(nulls).collect() == []
    assert C.encoded_size_profile(nulls).first().encoded_bytes == 2


def test_nested_columns_become_json(spark):
    df = spark.createDataFrame([(1, [1.5, 2.0])], "i int, v array<double>")
    assert [(r.tag, r.cell) for r in C.long_cells(df).collect()] == [("int", "1"), ("json", "[1.5,2.0]")]


def test_compression(spark):
    same = spark.range(5000).select(F.lit("same").alias("column_name"), F.col("id").alias("row_id"), F.lit("x" * 40).alias("cell"))
    noise = spark.range(5000).select(F.lit("noise").alias("column_name"), F.col("id").alias("row_id"), F.sha2(F.col("id").cast("string"), 256).alias("cell"))
    got = {r.column_name: r for r in Z.column_compression(same.union(noise)).collect()}
    assert got["same"].ratio > 50 > 3 > got["noise"].ratio > 1 and got["same"].raw_bytes == 5000 * 41


def test_sampling(spark):
    df = spark.range(1000).withColumn("text", F.repeat(F.lit("a"), 10))
    assert [r.id for r in S.sample_first_n(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert S.sample_percent(None, 5) == S.sample_percent(0, 5) == 100.0 and S.sample_percent(10**9, 10) == 0.1
    ranges = S.sample_key_ranges(df, "id", 10).groupBy("key_range").count().orderBy("key_range").collect()
    assert [r["count"] for r in ranges] == [3, 3, 2, 2]
    assert S.sample_provenance(df, 2000, "m", "row").first().complete_row_read


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7)], "child int, parent int")
    assert {tuple(r) for r in G.fk_cycles(edges).collect()} == {(1, 2), (2, 3), (3, 1)}
    tables = spark.createDataFrame([(k,) for k in range(1, 9)], "table_id int")
    assert {tuple(r) for r in G.fk_load_level(tables, edges).collect()} == {(5, 0), (7, 0), (8, 0), (6, 1)}
    assert {r.node for r in G.hierarchy_cycles(edges.toDF("node", "parent")).collect()} == {1, 2, 3, 5}
    assert [r.root for r in G.partition_rollup(spark.createDataFrame([(1, None, 5), (2, 1, 6), (3, 2, 7), (4, 2, 9), (5, 6, 1), (6, 5, 1), (7, None, 2)], "node int, parent int, rows int")).collect()] == [1]
    nothing = edges.limit(0)
    assert G.fk_cycles(nothing).collect() == [] and len(G.fk_load_level(tables, nothing).collect()) == 8


def test_cycles_by_brute_force(spark):
    import random

    rng = random.Random(7)
    for n, m in ((12, 14), (30, 45), (40, 44)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(a, b) for a, b in edges if a != b}
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        df = spark.createDataFrame([*edges, (None, 1)], "child int, parent int")
        assert {tuple(r) for r in G.fk_cycles(df).collect()} == {(a, b) for a, b in edges if a != b and (b, a) in reach}
        up = {a: min(y for x, y in edges if x == a) for a, _ in edges}
        on = set()
        for a in up:
            b = up[a]
            for _ in range(n):
                if b == a:
                    on.add(a)
                b = up.get(b, -1)
        assert {r.node for r in G.hierarchy_cycles(df.toDF("node", "parent")).collect()} == on


def test_load_levels_have_no_cap(spark):
    """Every table of a chain gets its level, tables on or behind a cycle none."""
    edges = spark.createDataFrame([(k + 1, k) for k in range(4)] + [(8, 9), (9, 8), (10, 9)], "child int, parent int")
    tables = spark.createDataFrame([(k,) for k in (*range(5), 8, 9, 10)], "table_id int")
    assert {tuple(r) for r in G.fk_load_level(tables, edges).collect()} == {(k, k) for k in range(5)}


def test_plan_status_settles_claims_in_order(spark):
    """Edges of several columns against a walk over them in order, in which only emitted edges claim."""
    import random

    dice = random.Random(4)
    tables = [(t, dice.choice((0, 5, 5, 5)), [1, 2, 3]) for t in range(5)]
    edges = []
    for e in range(120):
        child_cols = dice.sample([1, 2, 3, 3, 9] if e % 9 == 0 else [1, 2, 3], dice.choice((1, 1, 2)))
        parent_cols = None if e % 13 == 0 else dice.choices([1, 2], k=len(child_cols) if e % 11 else 3)
        edges.append((e, dice.randrange(6), child_cols, dice.randrange(6), parent_cols))
    has, claims, want = {t: (r, cols) for t, r, cols in tables}, {}, {}
    for e, child, child_cols, parent, parent_cols in edges:
        if child not in has:
            continue
        if parent not in has:
            want[e] = "external"
            continue
        pairs = [((child, a), (parent, b)) for a, b in zip(child_cols, parent_cols or [], strict=False)]
        bad = (has[child][0] and not has[parent][0]) or not set(child_cols) <= set(has[child][1]) or parent_cols is None or len(parent_cols) != len(child_cols)
        if bad or any(claims.get(a, b) != b for a, b in pairs):
            want[e] = "unsupported"
            continue
        want[e] = "emitted"
        for a, b in pairs:
            claims.setdefault(a, b)
    df = spark.createDataFrame(edges, "edge_id int, child int, child_cols array<int>, parent int, parent_cols array<int>")
    status = G.fk_plan_status(df, spark.createDataFrame(tables, "table_id int, rows int, cols array<int>"))
    assert {tuple(r) for r in status.collect()} == set(want.items())
    summary = G.fk_plan_summary(status).first()
    assert summary.source_edges == len(want) and summary.external == list(want.values()).count("external")
    assert tuple(G.fk_plan_summary(status.where("false")).first()) == (0, 0, 0, 0)


def test_given_parent_columns_must_exist(spark):
    edges = spark.createDataFrame([(1, "a", [1], 1), (2, "a", [7], 1), (3, "a", [], 1), (4, "b", [1], 1), (5, "b", None, 1)], "edge_id int, parent string, parent_cols array<int>, width int")
    keys = spark.createDataFrame([("a", 1, [1]), ("a", 2, [2])], "table_id string, key_no int, cols array<int>")
    columns = spark.createDataFrame([("a", [1, 2])], "table_id string, cols array<int>")
    got = {r.edge_id: (r.resolved_cols, r.exact_key) for r in G.fk_resolve(edges, keys, columns).collect()}
    assert got == {1: ([1], True), 2: (None, False), 3: ([1], True), 4: (None, False), 5: (None, False)}


def test_bundles(spark):
    schema = "source_id string, relationship string, group_id string, group_complete boolean, succeeded boolean, scope string, table_count long, row_count long, table_bytes long, index_bytes long"
    rows = [("a", "independent", "g1", True, True, "complete", 1, 10, 100, 5), ("b", "replica", "g2", True, True, "complete", 2, 20, 200, 6), ("c", "replica", "g2", True, True, "complete", 2, 21, 200, 6), ("d", "shard", "g3", True, True, "complete", 3, 30, 300, 7), ("e", "shard", "g3", True, False, "complete", 3, 30, 300, 7)]
    got = U.bundle_totals(spark.createDataFrame(rows, schema)).first()
    assert (got.row_count, got.logical_dataset_count, got.aggregation) == (30, 2, "incomplete")
    assert got.limitations == "failed-sources,replica-group-disagreement,shard-group-incomplete"
    hidden = U.bundle_totals(spark.createDataFrame([*rows, ("f", "unknown", "g4", False, True, "complete", 1, 1, 1, 1)], schema)).first()
    assert hidden.aggregation == "suppressed" and hidden.row_count == 0


def test_violations(spark):
    rows = spark.createDataFrame([(1, 0.5, 10, 3, True), (2, 1.5, 2, 3, False)], "edge_id int, coverage double, non_null_rows long, orphan_rows long, validated boolean").withColumn("distinct_parents", F.lit(1))
    rows = rows.withColumns({"sample_rows": F.lit(10), **{f"fanout_{q}": F.lit(1) for q in ("p50", "p95", "p99", "max")}, "sampled_with_bias": F.lit(None).cast("boolean"), "bias_reason": F.lit(None).cast("string")})
    got = {tuple(r) for r in Q.contract_violations(rows, ["edge_id"], Q.relationship_rules()).collect()}
    assert got == {(1, "validated-with-orphans"), (2, "coverage-out-of-range"), (2, "orphans-above-rows")}


def test_census(spark):
    rows = spark.createDataFrame([("p", "SELECT 1 -- if if\nIF a THEN (SELECT (1)) 'while' /* for */ UNION x"), ("q", None)], "id string, body string")
    got = {(r.key, r.feature): r.band for r in O.definition_census(rows, "id", "body").collect()}
    assert got == {("p", "branch"): "1", ("p", "set"): "1", ("p", "nesting"): "2-4", ("q", "nesting"): "0"}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutations(spark, n):
    got = [r[0] for r in spark.range(n).select(M.permute_index("id", F.lit(n), 9)).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def test_distribution(spark):
    counts = {r.v: r["count"] for r in spark.range(1000).select(M.project_distribution("id", F.lit(1000), 50, 0.2).alias("v")).groupBy("v").count().collect()}
    assert len(counts) == 50 and counts[0] == 200 == max(counts.values()) and sum(counts.values()) == 1000


def test_generated_table_keeps_the_profile(spark):
    profile = [M.ColumnProfile("i", "integer", 500, 0.1), M.ColumnProfile("t", "text", 20, 0.0, 0.3, 30, 60), M.ColumnProfile("d", "date", 2000)]
    made = M.generate_table(spark, "x", 2000, profile).cache()
    assert made.count() == 2000 and made.select("d").distinct().count() == 2000
    assert abs(made.where("i is null").count() - 200) < 60
    top = made.groupBy("t").count().orderBy(F.desc("count")).first()
    assert top["count"] == 600 and made.select("t").distinct().count() <= 21


def test_large_permutations_keep_their_places(spark):
    n = (1 << 61) + 12345
    at = spark.range(20_000).select((F.lit(n - 1) - F.col("id") * 1_000_003).alias("i"))
    got = [r[0] for r in at.select(M.permute_index("i", F.lit(n), 3)).collect()]
    assert len(set(got)) == 20_000 and 0 <= min(got) and max(got) < n and max(got) > n // 2


def test_distribution_follows_its_quantiles(spark):
    """Half of the other values are rare, 45 % are more frequent and 5 % most; even profiles are runs; every value occurs."""
    def counts(*args):
        rows = spark.range(args[0]).select(M.project_distribution("id", *map(F.lit, args)).alias("v")).groupBy("v").count().collect()
        return {r.v: r["count"] for r in rows}

    skewed = counts(10_000, 101, 0.2, 10, 100, 400)
    assert len(skewed) == 101 and skewed[0] == 2000 and sum(skewed.values()) == 10_000
    assert max(skewed[v] for v in range(1, 51)) < min(skewed[v] for v in range(51, 96)) and max(skewed[v] for v in range(51, 96)) < min(skewed[v] for v in range(96, 101))
    assert set(counts(1000, 30, 0.0, 5, 6, 9).values()) == {33, 34}
    assert counts(5, 9, 0.9) == {k: 1 for k in range(5)} and counts(4, 1, 1.0) == {0: 4} and counts(1, 0, 0.0) == {0: 1}
    assert spark.range(1).select(M.project_distribution(F.lit(None).cast("long"), 5, 2, 0.5)).first()[0] is None


def test_texts_have_their_lengths(spark):
    import base64
    import json

    for style in ("natural-text", "utf8-text", "hex", "numeric-text", "base64", "json", "xml"):
        for n in (1, 7, 40, 203):
            got = [r[0] for r in spark.range(500).select(M.gen_text("id", F.lit(n), style)).collect()]
            assert len(set(got)) == 500 or n < 5
            for t in got:
                least = {"base64": 4, "json": 20, "xml": 15}.get(style, 0)
                assert len(t) == (max(n // 4 * 4, 4) if style == "base64" else n) or (n < least and len(t) <= least)
                if style == "json":
                    json.loads(t)
                if style == "base64":
                    base64.b64decode(t, validate=True)


def test_generated_texts_have_a_tail(spark):
    made = M.generate_table(spark, "x", 5000, [M.ColumnProfile("t", "text", 5000, 0.0, 0.0, 30, 90), M.ColumnProfile("u", "hex", 5000, 0.0, 0.0, 30, 90, 64)])
    r = made.agg(F.countDistinct("t").alias("n"), F.max(F.length("t")).alias("t"), F.max(F.length("u")).alias("u"), F.avg(F.length("t")).alias("mean")).first()
    assert (r.n, r.t, r.u) == (5000, 90, 64) and 28 < r.mean < 36


def test_unique_prefixes_stay_unique(spark):
    rows = spark.range(36**6 - 50, 36**6 + 50)
    assert rows.select(M.unique_prefix("id", F.lit("v"), 20).alias("x")).distinct().count() == 100
    assert spark.range(1000).select(M.unique_prefix("id", F.lit("v"), 3).alias("x")).distinct().count() == 1000


def test_foreign_keys_without_and_with_one_parent(spark):
    child, parent = spark.range(300), spark.range(5).select(F.col("id").alias("row_index"), (F.col("id") * 10).alias("key"))
    rows = M.gen_fk(child, "id", 300, parent, 5, 1.0, 0.5, 0.4).collect()
    assert len(rows) == 300 and 80 < sum(r.key is None for r in rows) < 160 and {r.key for r in rows} == {None, 0, 10, 20, 30, 40}
    assert M.gen_fk(child, "id", 300, parent, 5, 0.0, 1.0).where("key = 0").count() == 300


def test_write_profile(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "column_name string, n long")
    files.write_profile({"columns": rows}, str(tmp_path), "r1")
    files.write_profile({"columns": rows}, str(tmp_path), "r2")
    assert spark.read.parquet(f"{tmp_path}/columns").count() == 2


def test_effective_distinct(spark):
    rows = spark.createDataFrame([(100, 100, True, 100, 100, 5000), (100, 100, False, 100, 100, 5000), (30, 30, True, 100, 100, 5000)], "e long, o long, b boolean, s long, n long, r long")
    got = [r[0] for r in rows.select(M.effective_distinct("e", "o", F.col("b"), "s", "n", "r")).collect()]
    assert got == [5000, 100, 30]


def test_range_and_compression_rules(spark):
    rows = spark.createDataFrame([(1, 2, 1, True, "days", 1995, 0.0, 10, 0.5), (2, 1, None, None, None, None, 2.0, 0, 0.0)], "k int, magnitude_min int, magnitude_max int, has_negative boolean, time_span string, time_recent_decade int, ratio double, sample_bytes long, ratio_stddev double")
    got = {tuple(r) for r in Q.contract_violations(rows, ["k"], Q.range_rules() + Q.compression_rules()).collect()}
    assert got == {(1, "decade-not-whole"), (1, "magnitudes-out-of-order"), (1, "spread-without-ratio"), (2, "magnitude-incomplete"), (2, "ratio-without-sample")}


def test_footers(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id", "if(id % 4 = 0, null, cast(id as string)) AS t").repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    near = {r.column_name: r for r in files.storage_profile(df).collect()}
    assert near["t"].nulls == 250 and near["id"].values == 1000 and near["id"].row_groups == 3 and near["t"].ratio > 0
    monkeypatch.setattr(files, "RANGE_SCHEMES", ())
    assert {r.column_name: r for r in files.storage_profile(df).collect()} == near


def test_values_are_counted_without_their_texts(spark):
    """Values of all lengths, nulls, empty and alike ones by Counter; long values aren't shuffled."""
    from collections import Counter

    from profileloom.operators import columns

    long = "x" * 5000
    values = ["", "", None, None, "a", "a", "b", "x" * 24, "x" * 24, "x" * 25, "x" * 25, "x" * 26, long, long, long + "y", long + "z", "é" * 12, "é" * 13, "é" * 13, "A" + long[1:]]
    cells = spark.createDataFrame([("c", v) for v in values] + [("d", v) for v in values[:3]], "column_name string, cell string")
    counts = columns.value_counts(cells)
    got = Counter((r.column_name, r.missing, r.frequency) for r in counts.collect())
    want = Counter((name, v is None, n) for name, vs in (("c", values), ("d", values[:3])) for v, n in Counter(vs).items())
    assert got == want
    plan = counts._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "cell" not in exchange and "short" in exchange
    histogram = Counter({(r.column_name, r.frequency): r.n_values for r in columns.frequency_histogram(cells).collect()})
    assert histogram == Counter((name, n) for name, missing, n in want.elements() if not missing)
    assert columns.value_counts(cells.limit(0)).collect() == []


def test_reservoir_sorts_only_rows_that_can_be_in_it(spark, capsys):
    cells = spark.range(5000).selectExpr("id % 3 = 0 AS third", "id AS row_id").selectExpr("CASE WHEN third THEN NULL ELSE 'a' END AS column_name", "row_id", "CAST(row_id AS STRING) AS cell")
    sample = S.sample_reservoir(cells, 40)
    sample.explain()
    assert "_last" in capsys.readouterr().out  # the join by which far rows go before they are sorted
    h = cells.selectExpr("*", "xxhash64(column_name, row_id, 42) AS h").collect()
    wanted = {(c, r.row_id) for c in (None, "a") for r in sorted((x for x in h if x.column_name == c), key=lambda x: x.h)[:40]}
    assert {(r.column_name, r.row_id) for r in sample.collect()} == wanted


def test_compressed_columns_are_dealt_by_their_bytes(spark, capsys, monkeypatch):
    cells = spark.range(3000).selectExpr("'c' AS column_name", "id AS row_id", "repeat(sha2(CAST(id AS STRING), 256), 16) AS cell")
    expected = Z.column_compression(cells).collect()
    monkeypatch.setattr(Z, "TASK_GROUPS", 1)
    spread = Z.column_compression(cells)
    spread.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
    (one,), (other,) = spread.collect(), expected
    assert (one.raw_bytes, one.packed_bytes) == (other.raw_bytes, other.packed_bytes) and one.raw_bytes == 3000 * 1025
    assert abs(one.ratio_stddev - other.ratio_stddev) < 1e-12
