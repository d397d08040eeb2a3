"""Key prefixes and relationships between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profileloom.functions.rounding import div, quantize_count, quantize_count_at_most, quantize_fraction
from profileloom.operators.columns import nearest_rank


def index_prefix_inferred(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, index_id, rows, prefix_distinct): the running product of the key columns' distinct estimates, capped at the rows.

    0 from the first column without estimate on; the last place of a unique key is the table's rows. indexes: table_id,
    index_id, cols array<int>, is_unique, rows. columns: table_id, ordinal, estimated_distinct. Tables without rows have none.
    """
    parts = indexes.where(F.col("rows") > 0).select("table_id", "index_id", "rows", "is_unique", F.posexplode("cols").alias("at", "ordinal"))
    parts = parts.join(columns.select("table_id", "ordinal", "estimated_distinct"), ["table_id", "ordinal"], "left")
    keys = parts.groupBy("table_id", "index_id", "rows", "is_unique").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("estimated_distinct", F.lit(0)).alias("d")))), lambda x: x["d"]).alias("d"))
    # dividing the cap first keeps the product within a long
    step = lambda done, d: F.concat(done, F.array(F.when((d <= 0) | (F.element_at(done, -1) <= 0), F.lit(0).cast("long")).when(F.element_at(done, -1) > div(F.col("rows"), F.greatest(d, F.lit(1))), F.col("rows")).otherwise(F.element_at(done, -1) * d)))
    run = F.aggregate("d", F.array(F.lit(1).cast("long")), step)
    run = F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0)))
    last = F.when(F.col("is_unique"), F.concat(F.slice(run, 1, F.size(run) - 1), F.array(F.col("rows")))).otherwise(run)
    return keys.select("table_id", "index_id", "rows", last.alias("prefix_distinct"))


def index_prefix_exact(df: DataFrame, key: list[str]) -> DataFrame:
    """(prefix_columns, prefix_distinct): distinct values of each prefix of a key, by one grouping that each shorter prefix groups again."""
    at, out = df.select(*key).distinct(), []
    for k in range(len(key), 0, -1):
        at = at.select(*key[:k]).distinct()
        out.append(at.agg(F.lit(k).cast("long").alias("prefix_columns"), F.count("*").alias("prefix_distinct")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    return rows


def relationship_measured(child: DataFrame, child_key: list[str], parent: DataFrame, parent_key: list[str]) -> DataFrame:
    """One row: child rows, rows without a key, distinct parents, coverage, fan-out percentiles and orphan rows.

    Children are counted by key before the join, so a hot parent is one row in it.
    """
    full = F.lit(True)
    for k in child_key:
        full = full & F.col(k).isNotNull()
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(child_key)]
    keys = [f"k{i}" for i in range(len(child_key))]
    fans = child.where(full).groupBy(*named).agg(F.count("*").alias("fan"))
    parents = parent.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(parent_key))).distinct().withColumn("found", F.lit(True))
    fans = fans.join(parents, keys, "left")
    histogram = fans.groupBy(F.col("found").isNotNull().alias("found"), "fan").agg(F.count("*").alias("n"))
    one = F.lit(1).alias("one")  # the parts of the result have a row each
    quantiles = nearest_rank(histogram.where("found").select("*", one), ["one"], "fan", "n", {"fan_p50": 50, "fan_p95": 95, "fan_p99": 99, "fan_max": 100})
    counts = histogram.agg(one, F.coalesce(F.sum(F.col("fan") * F.col("n")), F.lit(0)).alias("non_null_rows"), F.coalesce(F.sum(F.when(F.col("found"), F.col("n"))), F.lit(0)).alias("distinct_parents"), F.coalesce(F.sum(F.when(~F.col("found"), F.col("fan") * F.col("n"))), F.lit(0)).alias("orphan_rows"))
    rows = child.agg(one, F.count("*").alias("child_rows")).join(parents.agg(one, F.count("*").alias("parent_rows")), "one").join(counts, "one")
    rows = rows.withColumn("coverage", F.when(F.col("parent_rows") > 0, F.col("distinct_parents") / F.col("parent_rows")).otherwise(0.0))
    return rows.join(quantiles, "one", "left").drop("one")


def relationship_inferred(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Relationship statistics of each edge from its child columns' profiles, without reading the tables.

    edges: edge_id, child_id, cols array<int>, child_rows, parent_rows, validated. columns: table_id, ordinal, sample_rows,
    non_null_rows, observed_distinct, estimated_distinct, frequency_p50, frequency_p95, frequency_p99, frequency_max, biased. An edge has none
    if a side has no rows, a column stands twice in it or one isn't profiled. Columns count as independent: the non-null share and the
    distinct values multiply, the latter up to the non-null rows, the child's and the parent's. Fan-outs are those of the only
    column, or for composite keys the mean, rounded up; each is at least the one before, and all are on the grid within the non-null rows. An
    inference finds no orphans: orphan_rows is 0 and the method says so.
    """
    c = F.col
    fans = ("p50", "p95", "p99", "max")
    usable = edges.where((c("child_rows") > 0) & (c("parent_rows") > 0) & (F.size(F.array_distinct("cols")) == F.size("cols")))
    parts = usable.select("edge_id", "child_id", "child_rows", "parent_rows", "validated", F.size("cols").alias("width"), F.explode("cols").alias("ordinal"))
    known = columns.withColumnRenamed("table_id", "child_id").where(c("sample_rows") > 0)
    parts = parts.join(known, ["child_id", "ordinal"])
    seen = F.greatest("observed_distinct", F.lit(1)).cast("double")
    most = F.greatest("estimated_distinct", "observed_distinct", F.lit(1)).cast("double")
    out = parts.groupBy("edge_id", "child_rows", "parent_rows", "validated", "width").agg(F.count("*").alias("known"), F.min("sample_rows").alias("least"), F.product(c("non_null_rows") / c("sample_rows")).alias("share"), F.product(seen).alias("seen"), F.product(most).alias("most"), F.max("biased").alias("biased"), *(F.max(f"frequency_{f}").alias(f"one_{f}") for f in fans))
    out = out.where(c("known") == c("width"))
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    out = out.withColumn("sample_rows", quantize_count("least"))
    out = out.withColumn("non_null_rows", F.least(quantize_count(rounded(c("least") * c("share"))), c("sample_rows")))
    out = out.withColumn("distinct_parents", quantize_count(F.least("seen", c("non_null_rows").cast("double")).cast("long")))
    scaled = F.greatest(rounded(c("child_rows") * c("share")), F.lit(1)).cast("double")
    out = out.withColumn("estimated_parents", F.least("most", scaled, c("parent_rows").cast("double")).cast("long"))
    mean = F.when(c("distinct_parents") > 0, div(c("non_null_rows") + c("distinct_parents") - 1, F.greatest("distinct_parents", F.lit(1)))).otherwise(0)
    raw = [F.when(c("width") == 1, c(f"one_{f}")).otherwise(mean) for f in fans]
    rising = [F.greatest(*raw[: k + 1]) if k else raw[0] for k in range(len(fans))]
    shown = [quantize_count_at_most(x, "non_null_rows").alias(f"fan_{f}") for f, x in zip(fans, rising, strict=True)]
    method = F.concat(F.lit("inferred from column profiles; "), F.when(c("validated"), "valid constraint").otherwise("unvalidated constraint"))
    return out.select("edge_id", "sample_rows", "non_null_rows", "distinct_parents", "estimated_parents", quantize_fraction(c("estimated_parents") / c("parent_rows")).alias("coverage"), *shown, F.lit(0).cast("long").alias("orphan_rows"), c("biased").alias("sampled_with_bias"), method.alias("method"))
