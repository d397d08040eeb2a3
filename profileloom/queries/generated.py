"""Queries of synthetic tables, made from profiles of the data tables and as many rows as they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.operators import cells as C
from profileloom.operators import columns as P
from profileloom.plans import calibration as K
from profileloom.plans import catalog as D
from profileloom.plans import generation as G
from profileloom.plans import permutation as R
from profileloom.queries import load, query


@query("WITH t AS (SELECT l_suppkey AS table_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT table_id, 't' || CASE WHEN row_number() OVER (ORDER BY table_id) < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY table_id) AS VARCHAR), 4, '0') ELSE CAST(row_number() OVER (ORDER BY table_id) AS VARCHAR) END AS name, CAST(least(greatest(floor(n * 0.37 + 0.5), 1), 200) AS BIGINT) AS rows FROM t")
def generation_plan(spark, sf_dir):
    tables = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("table_id")).agg(F.count("*").alias("rows"))
    return G.generation_plan(tables, 0.37, 200)


@query("WITH c AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS d, count(*) AS s, o_custkey % 50 AS r FROM orders GROUP BY 1, 4) SELECT o_custkey, CASE WHEN r > 0 THEN least(greatest((d * r + s // 2) // s, 1), r) ELSE 0 END AS n FROM c")
def scaled_distinct(spark, sf_dir):
    c = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("d"), F.count("*").alias("s")).withColumn("r", F.col("o_custkey") % 50)
    return c.select("o_custkey", G.scaled_distinct("d", "s", "r").alias("n"))


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    return spark.range(n), n


@query("SELECT count(*) AS n, count(*) AS n_distinct, CAST(0 AS BIGINT) AS least, count(*) - 1 AS greatest FROM orders")
def permute_index(spark, sf_dir):
    """Row numbers of orders permuted: as many values as rows, from 0 to one less."""
    rows, n = _numbered(spark, sf_dir)
    p = rows.select(G.permute_index("id", F.lit(n), 3).alias("p"))
    return p.agg(F.count("*").alias("n"), F.countDistinct("p").alias("n_distinct"), F.min("p").alias("least"), F.max("p").alias("greatest"))


def _domain_sql(i: str, n: str, d: str, top: str, p50: str, p95: str, p99: str) -> str:
    """SQL for the domain value of row i of n: runs if frequencies are even, else the hot value, each other one once, and the rest by weights."""
    d, o = f"least(greatest({d}, 1), {n})", f"(least(greatest({d}, 1), {n}) - 1)"
    hot = f"greatest(least(CAST(floor({n} * {top} + 0.5) AS BIGINT), {n} - {o}), 1)"
    few, some = f"({o} * 50 // 100)", f"({o} * 95 // 100)"
    first, second = f"({few} * {p50})", f"({few} * {p50} + ({some} - {few}) * {p95})"
    whole = f"({second} + ({o} - {some}) * {p99})"
    at = f"least(CAST(floor(CAST({i} - {hot} - {o} AS DOUBLE) * {whole} / greatest({n} - {hot} - {o}, 1)) AS BIGINT), {whole} - 1)"
    run = f"CASE WHEN {i} < {n} % {d} * ({n} // {d} + 1) THEN {i} // ({n} // {d} + 1) ELSE {n} % {d} + ({i} - {n} % {d} * ({n} // {d} + 1)) // ({n} // {d}) END"
    dealt = f"CASE WHEN {at} < {first} THEN {at} // {p50} WHEN {at} < {second} THEN {few} + ({at} - {first}) // {p95} ELSE {some} + ({at} - {second}) // {p99} END + 1"
    even = f"{p99} <= {p50} * 2 AND ({top} <= 0 OR abs({top} - 1.0::DOUBLE / {d}) <= 0.01)"
    return f"CAST(CASE WHEN {even} THEN {run} WHEN {i} < {hot} OR {o} = 0 THEN 0 WHEN {i} < {hot} + {o} THEN {i} - {hot} + 1 ELSE {dealt} END AS BIGINT)"


@query(f"""WITH g AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) // 3 AS d, CASE WHEN l_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END AS t, CASE WHEN l_suppkey % 2 = 0 THEN 9 ELSE 2 END AS q FROM lineitem GROUP BY 1),
r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, {_domain_sql('i', 'n', 'd', 't', '1', '3', 'q')} AS v FROM r JOIN g USING (l_suppkey)""")
def project_distribution(spark, sf_dir):
    """The lines of each supplier over a third as many values as it has parts: skewed or even, with a hot value for two of three suppliers."""
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    s = F.col("l_suppkey")
    groups = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.floor(F.countDistinct("l_partkey") / 3).alias("d"))
    rows = lines.withColumn("i", F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")) - 1).join(groups, "l_suppkey")
    v = G.project_distribution("i", "n", "d", F.when(s % 3 == 0, 0.0).otherwise(0.3), 1, 3, F.when(s % 2 == 0, 9).otherwise(2))
    return rows.select("l_orderkey", "l_linenumber", v.alias("v"))


@query()
def null_mask(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", G.null_mask("orders", "o_custkey", "o_orderkey", 0.2).alias("is_null"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 19 = 0 THEN 90 WHEN (o_orderkey + 3) % 11 = 0 THEN 20 ELSE 40 END AS BIGINT) AS n, CAST(CASE WHEN o_orderkey % 19 = 0 THEN 64 WHEN (o_orderkey + 3) % 11 = 0 THEN 20 ELSE 40 END AS BIGINT) AS capped FROM orders")
def value_length(spark, sf_dir):
    size = lambda cap: G.value_length("o_orderkey", 3, 40, 90, cap).cast("long")
    return load(spark, sf_dir, "orders").select("o_orderkey", size(0).alias("n"), size(64).alias("capped"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 1 THEN -(o_orderkey % 2147483648) ELSE o_orderkey % 2147483648 END AS BIGINT) AS i, CAST(CAST(o_orderkey % 1000000000000 AS DECIMAL(18,0)) * 0.01 AS DECIMAL(12,2)) AS d,
  o_orderkey / 7.0::DOUBLE AS f, o_orderkey % 2 = 1 AS b, CAST(2020 + o_orderkey % 7980 AS INTEGER) AS y, right(lpad(bin(o_orderkey % 16777216), 24, '0'), 24) AS bits FROM orders""")
def gen_numeric(spark, sf_dir):
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", G.gen_integer(k, 32, True).alias("i"), G.gen_decimal(k, 12, 2).alias("d"), (k / 7.0).alias("f"), (k % 2 == 1).alias("b"), G.gen_year(k).alias("y"), G.gen_bits(k, 24).alias("bits"))


@query("""SELECT o_orderkey, make_date(2020 + o_orderkey // 336 % 7980, o_orderkey // 28 % 12 + 1, o_orderkey % 28 + 1) AS d,
  make_timestamp(2024 + (o_orderkey * 977) // 86400 // 336 % 7976, (o_orderkey * 977) // 86400 // 28 % 12 + 1, (o_orderkey * 977) // 86400 % 28 + 1, (o_orderkey * 977) // 3600 % 24, (o_orderkey * 977) // 60 % 60, (o_orderkey * 977) % 60) AS ts,
  lpad(CAST(o_orderkey // 3661 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey // 61 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS t FROM orders""")
def gen_temporal(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", G.gen_date("o_orderkey").alias("d"), G.gen_timestamp(F.col("o_orderkey") * 977).alias("ts"), G.gen_time("o_orderkey").alias("t"))


@query()
def gen_text(spark, sf_dir):
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", *(G.gen_text(k, F.lit(48), s).alias(s.replace("-", "_")) for s in ("natural-text", "utf8-text", "hex", "numeric-text", "base64", "json", "xml")))


@query()
def gen_binary(spark, sf_dir):
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.hex(G.gen_binary(k, F.lit(96), 0.3)).alias("b"), G.gen_uuid(k).alias("u"), F.size(G.gen_vector(k, 8)).alias("dimensions"))


@query(f"""WITH k AS (SELECT count(*) AS n, (SELECT CAST(round(0.8 * count(*)) AS BIGINT) FROM customer) AS d FROM orders),
r AS (SELECT row_number() OVER () - 1 AS i FROM orders), v AS (SELECT {_domain_sql('i', 'n', 'least(d, n)', '0.05::DOUBLE', '2', '9', '30')} AS v FROM r, k),
c AS (SELECT v, count(*) AS children FROM v GROUP BY 1) SELECT children, count(*) AS parents FROM c GROUP BY 1""")
def gen_fk(spark, sf_dir):
    """As many children as orders, over four fifths of as many parents as customers: how many parents have so many children."""
    child, n = _numbered(spark, sf_dir)
    customers = load(spark, sf_dir, "customer").count()
    parent = spark.range(customers).select(F.col("id").alias("row_index"), F.concat(F.lit("k"), "id").alias("key"))
    rows = G.gen_fk(child, "id", n, parent, customers, 0.8, 0.05, fan_out=(2, 9, 30))
    return rows.groupBy("key").agg(F.count("*").alias("children")).groupBy("children").agg(F.count("*").alias("parents"))


@query("SELECT p_partkey, substring(token || '_' || p_name, 1, 16) AS name FROM (SELECT *, lpad((CASE WHEN p_partkey // 46656 > 0 THEN substring(a, p_partkey // 46656 % 36 + 1, 1) ELSE '' END || CASE WHEN p_partkey // 1296 > 0 THEN substring(a, p_partkey // 1296 % 36 + 1, 1) ELSE '' END || CASE WHEN p_partkey // 36 > 0 THEN substring(a, p_partkey // 36 % 36 + 1, 1) ELSE '' END || substring(a, p_partkey % 36 + 1, 1)), 6, '0') AS token FROM part, (SELECT '0123456789abcdefghijklmnopqrstuvwxyz' AS a))")
def unique_prefix(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", G.unique_prefix("p_partkey", F.col("p_name"), 16).alias("name"))


def _events_profile(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, list[G.ColumnProfile]]:
    events = load(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("error"))).select("user_id", "event_type", "props")
    profile = column_profile(events)
    families = {"user_id": "integer", "event_type": "text", "props": "json"}
    rows = profile.collect()  # a row for each column
    return profile, rows[0].n_rows, [G.ColumnProfile(r.column_name, families[r.column_name], r.observed_distinct, r.null_fraction, r.top_value_fraction, r.length_avg, r.length_p95, 0, (r.frequency_p50, r.frequency_p95, r.frequency_p99)) for r in sorted(rows, key=lambda r: r.column_name)]


def column_profile(df: DataFrame) -> DataFrame:
    cells = C.long_cells(df)
    summary = P.column_summary(cells).withColumn("null_fraction", (F.col("n_rows") - F.col("non_null")) / F.col("n_rows"))
    return summary.join(P.length_profile(cells), "column_name").select("column_name", "n_rows", "null_fraction", "observed_distinct", "top_value_fraction", "length_avg", "length_p95", "frequency_p50", "frequency_p95", "frequency_p99")


@query()
def generate_table(spark, sf_dir):
    _, rows, columns = _events_profile(spark, sf_dir)
    return G.generate_table(spark, "events", rows, columns)


@query()
def roundtrip_error(spark, sf_dir):
    profile, rows, columns = _events_profile(spark, sf_dir)
    return G.roundtrip_error(profile, column_profile(G.generate_table(spark, "events", rows, columns)))


@query("""WITH n AS (SELECT l_suppkey AS g, count(*) AS n FROM lineitem GROUP BY 1), e(e, p) AS (VALUES (0.0, 0.0::DOUBLE), (0.4, 0.4::DOUBLE), (1.0, 1.0::DOUBLE)),
w AS (SELECT g, n, e, CAST(CASE WHEN e >= 1 THEN n ELSE least(ceil(pow(n, p)), n) END AS BIGINT) AS w FROM n, e)
SELECT g, CAST(e AS DOUBLE) AS entropy, n, n AS n_distinct, CAST(0 AS BIGINT) AS least, n - 1 AS greatest, w AS window_size, CAST(0 AS BIGINT) AS n_outside FROM w""")
def permuted_windows(spark, sf_dir):
    """The lines of each supplier permuted at three entropies: every place is taken once, and none outside its window."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), "l_orderkey", "l_linenumber")
    own = W.partitionBy("g")
    rows = lines.select("g", (F.row_number().over(own.orderBy("l_orderkey", "l_linenumber")) - 1).cast("long").alias("i"), F.count("*").over(own).alias("n"))
    rows = rows.withColumn("entropy", F.explode(F.array(*map(F.lit, (0.0, 0.4, 1.0)))))
    size = R.window_size("n", "entropy")
    moved = R.permuted(rows.withColumn("w", size), "i", {"p": (F.col("n"), 5, F.col("entropy"))})
    outside = F.count(F.when(F.floor(F.col("p") / F.col("w")) != F.floor(F.col("i") / F.col("w")), 1))
    # places are told apart by a bit each, in words of 64
    bit = F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")
    words = moved.groupBy("g", "entropy", F.floor(F.col("p") / 64).alias("word")).agg(F.max("n").alias("n"), F.bit_or(bit).alias("bits"), F.min("p").alias("least"), F.max("p").alias("greatest"), F.max("w").alias("w"), outside.alias("outside"))
    return words.groupBy("g", "entropy").agg(F.max("n").alias("n"), F.sum(F.bit_count("bits").cast("long")).alias("n_distinct"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.max("w").alias("window_size"), F.sum("outside").alias("n_outside"))


#: Tables of the catalog: columns by ordinal with their families, and unique keys.
_TABLES = {
    "region": ({1: ("r_regionkey", "integer"), 2: ("r_name", "text")}, [[1]]),
    "nation": ({1: ("n_nationkey", "integer"), 2: ("n_name", "text"), 3: ("n_regionkey", "integer"), 4: ("n_leader", "integer")}, [[1]]),
    "customer": ({1: ("c_custkey", "integer"), 2: ("c_name", "text"), 3: ("c_nationkey", "integer"), 4: ("c_mktsegment", "text"), 5: ("c_referrer", "integer")}, [[1], [2]]),
    "supplier": ({1: ("s_suppkey", "integer"), 2: ("s_name", "text"), 3: ("s_nationkey", "integer")}, [[1]]),
    "part": ({1: ("p_partkey", "integer"), 2: ("p_brand", "text")}, [[1]]),
    "orders": ({1: ("o_orderkey", "integer"), 2: ("o_custkey", "integer"), 3: ("o_orderstatus", "text"), 4: ("o_orderdate", "timestamp")}, [[1]]),
    "lineitem": ({1: ("l_orderkey", "integer"), 2: ("l_linenumber", "integer"), 3: ("l_partkey", "integer"), 4: ("l_suppkey", "integer"), 5: ("l_returnflag", "text")}, [[1, 2]]),
    "returned": ({1: ("l_orderkey", "integer"), 2: ("l_linenumber", "integer"), 3: ("l_shipdate", "timestamp")}, []),
    "offered": ({1: ("l_partkey", "integer"), 2: ("l_suppkey", "integer")}, [[1, 2]]),
}
#: Edges of the catalog: child and its columns, parent and its columns (None: its key), share of the parents that occur.
_EDGES = {
    1: ("nation", [3], "region", [1], 1.0), 2: ("customer", [3], "nation", None, 1.0), 3: ("supplier", [3], "nation", [1], 1.0), 4: ("orders", [2], "customer", [1], 0.5), 5: ("lineitem", [1], "orders", [1], 0.8),
    6: ("lineitem", [3], "part", None, 0.9), 7: ("lineitem", [4], "supplier", [1], 0.9), 8: ("customer", [5], "customer", [1], 0.25), 9: ("nation", [4], "supplier", [1], 1.0), 10: ("returned", [1, 2], "lineitem", None, 0.5),
    11: ("offered", [1], "part", [1], 1.0), 12: ("offered", [2], "supplier", [1], 1.0), 13: ("orders", [2], "supplier", [1], 1.0), 14: ("part", [2], "brand", [1], 1.0), 15: ("part", [2], "region", [1, 2], 1.0),
}
_HALF = "CAST(floor({} * 0.5 + 0.5) AS BIGINT)"


def _catalog_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = load(spark, sf_dir, "lineitem")
    own = {t: load(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders")}
    own["nation"] = own["nation"].withColumn("n_leader", F.col("n_nationkey"))
    own["customer"] = own["customer"].withColumn("c_referrer", F.col("c_nationkey"))
    more = {"lineitem": lines, "returned": lines.where("l_returnflag = 'R'"), "offered": lines.select("l_partkey", "l_suppkey").distinct()}
    return {t: df.select(*(name for name, _ in _TABLES[t][0].values())) for t, df in (own | more).items()}


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[D.CatalogPlan, dict, dict]:
    """The plan of the catalog at half its rows, and profiles of its columns from the tables."""
    found = []
    for t, df in _catalog_tables(spark, sf_dir).items():
        names = [name for name, _ in _TABLES[t][0].values()]
        found.append(df.agg(F.count("*").alias("n"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.approx_count_distinct(c) for c in names))).alias("d")).withColumn("t", F.lit(t)))
    counts = found[0]
    for x in found[1:]:
        counts = counts.union(x)
    seen = {r.t: r for r in counts.collect()}  # a row for each table
    columns = {t: {k: G.ColumnProfile(name, family, max(1, seen[t].d[name])) for k, (name, family) in cols.items()} for t, (cols, _) in _TABLES.items()}
    tables = spark.createDataFrame([(t, seen[t].n, list(cols)) for t, (cols, _) in _TABLES.items()], "table_id string, rows long, cols array<int>")
    keys = spark.createDataFrame([(t, k, key) for t, (_, own) in _TABLES.items() for k, key in enumerate(own)], "table_id string, key_no int, cols array<int>")
    edges = spark.createDataFrame([(e, c, cc, p, pc) for e, (c, cc, p, pc, _) in _EDGES.items()], "edge_id int, child string, child_cols array<int>, parent string, parent_cols array<int>")
    return D.catalog_plan(tables, keys, edges, 0.5), columns, {e: D.EdgeProfile(x[4]) for e, x in _EDGES.items()}


_ROWS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS t, {_HALF.format('count(*)')} AS n FROM {dict(returned=chr(40) + 'SELECT * FROM lineitem WHERE l_returnflag = ' + chr(39) + 'R' + chr(39) + ')', offered='(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)').get(t, t)}" for t in _TABLES)


@query(f"""WITH r AS ({_ROWS_SQL}), o(t, level, place) AS (VALUES ('part', 0, 1), ('region', 0, 2), ('nation', 1, 3), ('offered', 1, 0), ('supplier', 0, 0), ('customer', 2, 0), ('orders', 3, 0), ('lineitem', 4, 0), ('returned', 5, 0))
SELECT t AS table_id, 't' || lpad(CAST(row_number() OVER (ORDER BY t) AS VARCHAR), 4, '0') AS name, n AS rows, CAST(level AS BIGINT) AS level, row_number() OVER (ORDER BY level, t) AS load_order FROM r JOIN o USING (t)""")
def catalog_plan(spark, sf_dir):
    """Load order of the catalog: nation and supplier refer to each other, so those edges come later and bind neither."""
    plan, _, _ = _catalog(spark, sf_dir)
    return plan.tables


@query("""SELECT * FROM (VALUES (1, 'emitted'), (2, 'emitted'), (3, 'deferred'), (4, 'emitted'), (5, 'emitted'), (6, 'emitted'), (7, 'emitted'), (8, 'emitted'), (9, 'deferred'), (10, 'emitted'), (11, 'emitted'), (12, 'emitted'), (13, 'unsupported'), (14, 'external'), (15, 'unsupported')) AS t(edge_id, status), (SELECT count(*) AS n FROM nation) AS tables WHERE n > 0""".replace("SELECT *", "SELECT edge_id, status"))
def catalog_edges(spark, sf_dir):
    """What becomes of the catalog's edges: 13 would bind orders' customers to suppliers, too, 14 leads out of it, 15 has too few columns."""
    plan, _, _ = _catalog(spark, sf_dir)
    return plan.edges.select("edge_id", "status")


@query(f"""WITH r AS ({_ROWS_SQL}), e(item, child) AS (VALUES {', '.join(f"('{e}', '{x[0]}')" for e, x in _EDGES.items() if e < 13)}), k(item, t) AS (VALUES {', '.join(f"('{k}', '{t}')" for t, (_, own) in _TABLES.items() for k in range(len(own)))})
SELECT 'edge' AS kind, child AS table_id, item, n AS rows, n AS held FROM e JOIN r ON child = t UNION ALL SELECT 'key', t, item, n, CASE WHEN t = 'offered' THEN least(n, (SELECT product(n) FROM r WHERE t IN ('part', 'supplier'))::BIGINT) ELSE n END FROM k JOIN r USING (t)""")
def generate_catalog(spark, sf_dir):
    """All tables of the catalog at half their rows: every child has its parent, also by composite keys, by itself and in cycles, and unique keys tell rows apart."""
    plan, columns, stats = _catalog(spark, sf_dir)
    return D.check_catalog(plan, D.generate_catalog(spark, plan, columns, stats), columns)


@query()
def calibrate_entropy(spark, sf_dir):
    """Entropies of a text, hex, JSON and binary column, as many rows and as long as those of events, for a ratio each."""
    events = load(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.avg(F.length("props")).cast("int").alias("length")).first()
    columns = [G.ColumnProfile(f"{f}_column", f, events.n, length_avg=max(48, events.length), length_p95=max(48, events.length)) for f in ("text", "hex", "json", "binary")]
    return K.calibrate_entropy(spark, "events", events.n, columns, {"text_column": 4.0, "hex_column": 3.0, "json_column": 5.0, "binary_column": 2.5})
