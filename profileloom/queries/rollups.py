"""Queries of roll-ups over tables, files and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profileloom.functions import tokens as T
from profileloom.operators import compression as Z
from profileloom.operators import rollups as U
from profileloom.queries import load, query
from profileloom.queries.profiles import RATIO_SQL, _ratios

TABLES_SQL = "t AS (SELECT l_suppkey AS table_id, l_suppkey % 7 <> 0 AS counted, count(*) AS rows, CAST(sum(l_partkey) AS BIGINT) AS table_bytes, count(DISTINCT l_partkey) AS index_bytes FROM lineitem GROUP BY 1)"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tables, their lines as rows."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("table_id")).agg(F.count("*").alias("rows"), F.sum("l_partkey").alias("table_bytes"), F.countDistinct("l_partkey").alias("index_bytes")).withColumn("counted", F.col("table_id") % 7 != 0)


@query(f"WITH {TABLES_SQL} SELECT count(*) AS table_count, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(table_bytes) AS BIGINT) AS table_bytes, CAST(sum(index_bytes) AS BIGINT) AS index_bytes FROM t WHERE counted")
def profile_totals(spark, sf_dir):
    return U.profile_totals(_tables(spark, sf_dir))


@query("SELECT 'o_orderstatus' AS family, o_orderstatus AS token, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def evidence_counts(spark, sf_dir):
    return U.evidence_counts(load(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "table_id"), ["o_orderstatus", "o_orderpriority"])


PROFILE_SQL = "c AS (SELECT source, lang AS column_name, max(n_chars) > 15000 AS nullable, count(*) // 10 AS size_class, doc_id % 2 AS side FROM documents GROUP BY 1, 2, 5)"


@query(f"WITH {PROFILE_SQL} SELECT coalesce(l.source, r.source) AS source, bool_and(coalesce(l.nullable = r.nullable AND l.size_class = r.size_class, false)) AS compatible FROM (SELECT * FROM c WHERE side = 0) l FULL JOIN (SELECT * FROM c WHERE side = 1) r ON l.source = r.source AND l.column_name = r.column_name GROUP BY 1")
def schema_compatible(spark, sf_dir):
    c = load(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("column_name"), (F.col("doc_id") % 2).alias("side")).agg((F.max("n_chars") > 15000).alias("nullable"), F.expr("count(*) div 10").alias("size_class"))
    return U.schema_compatible(c.where("side = 0").drop("side"), c.where("side = 1").drop("side"), ["source"], ["nullable", "size_class"])


FILES_SQL = """f AS (SELECT source, doc_id % 8 AS file, count(*) AS sample_rows, count(*) FILTER (doc_id % 5 <> 0) AS non_null_rows, CAST(avg(n_chars) AS BIGINT) AS length_avg, max(n_chars) AS length_p95, CAST(sum(n_chars) AS BIGINT) AS stored_bytes, CASE WHEN doc_id % 8 < 4 THEN 'SNAPPY' ELSE 'ZSTD' END AS codec,
  count(DISTINCT lang) AS observed_distinct, count(DISTINCT lang) * 3 AS estimated_distinct, count(DISTINCT lang) / count(*) AS top_value_fraction, count(*) AS frequency_max, count(*) // 4 AS frequency_p50, count(*) // 3 AS frequency_p95, count(*) // 2 AS frequency_p99 FROM documents GROUP BY 1, 2, 8)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over eight files by source, each file with a profile."""
    file = F.col("doc_id") % 8
    langs = F.countDistinct("lang")
    return load(spark, sf_dir, "documents").groupBy("source", file.alias("file"), F.when(file < 4, "SNAPPY").otherwise("ZSTD").alias("codec")).agg(F.count("*").alias("sample_rows"), F.sum((F.col("doc_id") % 5 != 0).cast("long")).alias("non_null_rows"), F.expr("cast(bround(avg(n_chars)) as bigint)").alias("length_avg"), F.max("n_chars").alias("length_p95"), F.sum("n_chars").alias("stored_bytes"), langs.alias("observed_distinct"), (langs * 3).alias("estimated_distinct"), (langs / F.count("*")).alias("top_value_fraction"), F.count("*").alias("frequency_max"), *(F.expr(f"count(*) div {k}").alias(f"frequency_p{p}") for p, k in ((50, 4), (95, 3), (99, 2))))


@query(f"WITH {FILES_SQL} SELECT source, count(*) AS files, CAST(sum(sample_rows) AS BIGINT) AS sample_rows, CAST(sum(non_null_rows) AS BIGINT) AS non_null_rows, CASE WHEN sum(non_null_rows) > 0 THEN CAST((sum(length_avg * non_null_rows) + sum(non_null_rows) // 2) // sum(non_null_rows) AS BIGINT) END AS length_avg, max(length_p95) AS length_p95, (sum(sample_rows) - sum(non_null_rows)) / sum(sample_rows) AS null_fraction, CAST(sum(stored_bytes) AS BIGINT) AS stored_bytes, array_to_string(list_sort(list(DISTINCT codec)), ',') AS codecs FROM f GROUP BY 1")
def merge_file_profiles(spark, sf_dir):
    return U.merge_file_profiles(_files(spark, sf_dir), ["source"])


@query(f"WITH {FILES_SQL}, g AS (SELECT source, CASE WHEN file = 7 AND source = 'src2' THEN NULL ELSE observed_distinct END AS o, * FROM f) SELECT source, CASE WHEN count(o) = count(*) THEN max(o) END AS observed_distinct, CASE WHEN count(o) = count(*) THEN CAST(least(sum(estimated_distinct), greatest(sum(non_null_rows), max(o))) AS BIGINT) END AS estimated_distinct, CASE WHEN count(o) = count(*) THEN max(top_value_fraction) END AS top_value_fraction, CASE WHEN count(o) = count(*) THEN max(frequency_max) END AS frequency_max, CASE WHEN count(o) = count(*) THEN max(frequency_p50) END AS frequency_p50, CASE WHEN count(o) = count(*) THEN max(frequency_p95) END AS frequency_p95, CASE WHEN count(o) = count(*) THEN max(frequency_p99) END AS frequency_p99, count(o) = count(*) AS measured, CASE WHEN count(o) = count(*) THEN 'file-overlap-unknown' END AS bias_reason FROM g GROUP BY source")
def merge_cardinality(spark, sf_dir):
    rows = _files(spark, sf_dir).withColumn("observed_distinct", F.when(~((F.col("file") == 7) & (F.col("source") == "src2")), F.col("observed_distinct")))
    return U.merge_cardinality(rows, ["source"])


@query(f"WITH {FILES_SQL}, g AS (SELECT source, stored_bytes AS sb, sample_rows % 9 + 1.5 AS ratio, sample_rows % 5 / 10 AS sd, sample_rows % 2 = 0 AS biased, CASE WHEN source = 'src3' THEN codec ELSE 'cells' END AS encoding FROM f) SELECT source, CAST(sum(sb) AS BIGINT) AS sample_bytes, round(CASE WHEN count(DISTINCT encoding) = 1 THEN sum(sb) / sum(sb / ratio) ELSE 0 END, 9) AS ratio, max(sd) AS ratio_stddev, bool_or(biased) AS biased, CASE WHEN count(DISTINCT encoding) = 1 THEN min(encoding) ELSE 'mixed-encodings' END AS encoding FROM g GROUP BY 1")
def merge_compression(spark, sf_dir):
    n = F.col("sample_rows")
    rows = _files(spark, sf_dir).select("source", F.col("stored_bytes").alias("sample_bytes"), (n % 9 + F.lit(1.5)).alias("ratio"), (n % 5 / 10).alias("ratio_stddev"), (n % 2 == 0).alias("biased"), F.when(F.col("source") == "src3", F.col("codec")).otherwise("cells").alias("encoding"))
    return U.merge_compression(rows, ["source"]).withColumn("ratio", F.round("ratio", 9))


SOURCES_SQL = """s AS (SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'independent' WHEN 1 THEN 'replica' WHEN 2 THEN 'shard' END AS rel, CASE WHEN c_nationkey % 4 IN (1, 2) AND c_custkey % 50 <> 0 THEN 'g' || (c_nationkey % 4) || '-' || (c_custkey // 8) END AS grp, CASE WHEN c_nationkey % 4 = 2 THEN c_custkey % 31 <> 0 WHEN c_custkey % 17 = 0 THEN c_custkey % 2 = 0 END AS done FROM customer),
m AS (SELECT *, coalesce(rel, 'unknown') AS relationship, coalesce(grp, 'dataset-' || id) AS group_id FROM s),
k AS (SELECT *, CASE relationship WHEN 'independent' THEN true WHEN 'unknown' THEN false ELSE coalesce(done, false) END AS complete,
  CASE WHEN relationship IN ('replica', 'shard') AND grp IS NULL THEN 'missing-group' WHEN relationship = 'independent' AND NOT coalesce(done, true) THEN 'independent-incomplete' WHEN relationship = 'unknown' AND coalesce(done, false) THEN 'unknown-complete' END AS bad FROM m)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources, with declarations by nation and number."""
    c, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    group = F.when(n.isin(1, 2) & (c % 50 != 0), F.concat(F.lit("g"), n, F.lit("-"), F.expr("c_custkey div 8")))
    done = F.when(n == 2, c % 31 != 0).when(c % 17 == 0, c % 2 == 0)
    return load(spark, sf_dir, "customer").select(c.alias("source_id"), F.when(n == 0, "independent").when(n == 1, "replica").when(n == 2, "shard").alias("relationship"), group.alias("dataset_group"), done.alias("group_complete"))


@query(f"WITH {SOURCES_SQL}, g AS (SELECT group_id, min(relationship) AS relationship, bool_and(complete) AS members_complete, count(DISTINCT id) AS n_members, min(bad) AS bad, count(DISTINCT relationship || complete) > 1 AS split FROM k GROUP BY 1) SELECT group_id, relationship, members_complete, n_members, CASE WHEN bad IS NOT NULL THEN bad WHEN split THEN 'inconsistent-declarations' WHEN relationship = 'independent' AND n_members <> 1 THEN 'independent-members' ELSE '' END AS violation FROM g")
def dataset_groups(spark, sf_dir):
    return U.dataset_groups(_sources(spark, sf_dir))


@query("""WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'independent' WHEN c_custkey % 3 = 1 THEN 'replica' ELSE 'shard' END AS rel, CASE c_custkey % 3 WHEN 0 THEN 'd' || c_custkey WHEN 1 THEN 'r' || (c_custkey // 9) ELSE 's' || (c_custkey // 9) END AS grp, c_custkey % 41 <> 0 AS ok, CASE WHEN c_custkey % 100 = 0 THEN 'incomplete' ELSE 'complete' END AS scope, c_custkey % 5 AS tc, c_custkey AS rc, c_custkey * 10 AS tb, c_custkey * 2 AS ib FROM customer),
g AS (SELECT grp, min(rel) AS rel, count(*) AS m, count(*) FILTER (ok) AS k, min(id) FILTER (ok) AS one, CAST(sum(tc) FILTER (ok) AS BIGINT) AS stc, CAST(sum(rc) FILTER (ok) AS BIGINT) AS src, CAST(sum(tb) FILTER (ok) AS BIGINT) AS stb, CAST(sum(ib) FILTER (ok) AS BIGINT) AS sib, count(DISTINCT CASE WHEN ok THEN rc END) AS v, bool_or(scope <> 'complete') FILTER (ok) AS part FROM s GROUP BY 1),
h AS (SELECT g.*, s.tc, s.rc, s.tb, s.ib, s.scope, rel IN ('independent', 'replica') AND k > 0 AS single, g.rel = 'shard' AND k = m AS sh FROM g LEFT JOIN (SELECT id, tc, rc, tb, ib, scope FROM s) s ON g.one = s.id)
SELECT CAST(sum(m) AS BIGINT) AS source_count, count(*) FILTER (single OR sh) AS logical_dataset_count, CAST(sum(CASE WHEN single THEN tc WHEN sh THEN stc ELSE 0 END) AS BIGINT) AS table_count, CAST(sum(CASE WHEN single THEN rc WHEN sh THEN src ELSE 0 END) AS BIGINT) AS row_count, CAST(sum(CASE WHEN single THEN tb WHEN sh THEN stb ELSE 0 END) AS BIGINT) AS table_bytes, CAST(sum(CASE WHEN single THEN ib WHEN sh THEN sib ELSE 0 END) AS BIGINT) AS index_bytes, 'incomplete' AS aggregation,
  array_to_string([x FOR x IN [CASE WHEN bool_or(k < m OR (rel <> 'shard' AND k = 0)) THEN 'failed-sources' END, CASE WHEN bool_or(rel = 'replica' AND v > 1) THEN 'replica-group-disagreement' END, CASE WHEN bool_or(rel = 'shard' AND NOT sh) THEN 'shard-group-incomplete' END, CASE WHEN bool_or((single AND scope <> 'complete') OR (sh AND part)) THEN 'source-dataset-scope-incomplete' END] IF x IS NOT NULL], ',') AS limitations FROM h""")
def bundle_totals(spark, sf_dir):
    c = F.col("c_custkey")
    k = c % 3
    group = F.when(k == 0, F.concat(F.lit("d"), c)).when(k == 1, F.concat(F.lit("r"), F.expr("c_custkey div 9"))).otherwise(F.concat(F.lit("s"), F.expr("c_custkey div 9")))
    rows = load(spark, sf_dir, "customer").select(c.alias("source_id"), F.when(k == 0, "independent").when(k == 1, "replica").otherwise("shard").alias("relationship"), group.alias("group_id"), F.lit(True).alias("group_complete"), (c % 41 != 0).alias("succeeded"), F.when(c % 100 == 0, "incomplete").otherwise("complete").alias("scope"), (c % 5).alias("table_count"), c.alias("row_count"), (c * 10).alias("table_bytes"), (c * 2).alias("index_bytes"))
    return U.bundle_totals(rows)


@query("SELECT o_custkey % 3 AS a, o_orderkey % 4 AS b, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'complete' WHEN o_custkey % 3 = 2 OR o_orderkey % 4 = 3 THEN 'unknown' ELSE 'incomplete' END AS scope, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def scope_completeness(spark, sf_dir):
    a, b = F.col("o_custkey") % 3, F.col("o_orderkey") % 4
    first = F.when(a == 0, "complete").when(a == 1, "incomplete").otherwise("unknown")
    second = F.when(b == 0, "complete").when(b == 3, "unknown").otherwise("incomplete")
    return load(spark, sf_dir, "orders").groupBy(a.alias("a"), b.alias("b"), T.scope_completeness(first, second).alias("scope")).agg(F.count("*").alias("n"))


@query(f"WITH {TABLES_SQL} SELECT table_id, table_bytes, table_bytes / (SELECT sum(table_bytes) FROM t WHERE counted) AS share FROM t WHERE counted ORDER BY table_bytes DESC, table_id LIMIT 10")
def top_tables(spark, sf_dir):
    return U.top_tables(_tables(spark, sf_dir), 10)


@query(f"WITH {RATIO_SQL} SELECT table_id, raw_bytes, ratio FROM t WHERE counted AND ratio > 0 ORDER BY ratio DESC, table_id LIMIT 10")
def compression_ranking(spark, sf_dir):
    return Z.compression_ranking(_ratios(spark, sf_dir), 10).select("table_id", "raw_bytes", "ratio")


@query("SELECT p_brand AS schema_id, p_type AS column_type, count(*) AS n FROM part GROUP BY ROLLUP (1, 2)")
def type_mix(spark, sf_dir):
    return U.type_mix(load(spark, sf_dir, "part").select(F.col("p_brand").alias("schema_id"), F.col("p_type").alias("column_type")))


@query("SELECT p_type AS index_type, count(*) AS n, CAST(sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unique FROM part GROUP BY 1")
def index_mix(spark, sf_dir):
    return U.index_mix(load(spark, sf_dir, "part").select(F.col("p_type").alias("index_type"), (F.col("p_size") % 2 == 0).alias("is_unique")))


@query("WITH o AS (SELECT CASE p_size % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'function' WHEN 2 THEN 'trigger' ELSE 'synonym' END AS kind, p_brand AS external_class FROM part) SELECT kind, external_class, CASE kind WHEN 'view' THEN 'Views' WHEN 'function' THEN 'Routines' WHEN 'trigger' THEN 'Triggers' ELSE 'Other' END AS presentation, count(*) AS n FROM o GROUP BY 1, 2, 3")
def object_counts(spark, sf_dir):
    k = F.col("p_size") % 4
    return U.object_counts(load(spark, sf_dir, "part").select(F.when(k == 0, "view").when(k == 1, "function").when(k == 2, "trigger").otherwise("synonym").alias("kind"), F.col("p_brand").alias("external_class")))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT t)), ',') AS tokens FROM (SELECT user_id, unnest([event_type, 'any']) AS t FROM events) GROUP BY 1")
def token_union(spark, sf_dir):
    return U.token_union(load(spark, sf_dir, "events").select("user_id", F.array("event_type", F.lit("any")).alias("tokens")), ["user_id"], "tokens")
