"""Bounded reads with provenance. Sampling is the feature here; every operator says what its sample covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.functions.rounding import div
from profileloom.operators.cells import encoded_size

#: Bits of a hash by which rows of a reservoir are counted.
BUCKET_BITS = 16


def sample_first_n(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows by a key: a top-n, which keeps n rows in each task."""
    return df.orderBy(*order_by).limit(n)


def sample_percent(estimated_rows: int | None, n: int) -> float:
    """The share to read so that about 4n rows come back, 100 without a usable estimate."""
    return min(100.0, max(0.1, n * 400 / estimated_rows)) if estimated_rows and estimated_rows > 0 else 100.0


def sample_adaptive(df: DataFrame, key: str, n: int, estimated_rows: int | None) -> DataFrame:
    """About `sample_percent` of the rows, picked by key modulo 1000 so that reruns agree, then the first n by key."""
    tenths = max(1, round(sample_percent(estimated_rows, n) * 10))
    return df.where(F.pmod(F.col(key), F.lit(1000)) < tenths).orderBy(key).limit(n)


def sample_key_ranges(df: DataFrame, key: str, n: int, windows: int = 4) -> DataFrame:
    """The first rows of `windows` equal ranges of an integer key, n/windows each and one more in the first n % windows.

    Least and greatest key come from one aggregate; ranking by range keeps a quota in each task before its shuffle.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    span = max((high or 0) - (low or 0), 1)
    window = F.least(F.lit(windows - 1), div((F.col(key) - F.lit(low or 0)) * windows, span))
    rows = df.withColumn("key_range", window.cast("long"))
    rank = F.row_number().over(W.partitionBy("key_range").orderBy(key))
    rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= n // windows + 1)
    return rows.where(F.col("_rank") <= n // windows + (F.col("key_range") < n % windows).cast("int")).drop("_rank")


def sample_reservoir(cells: DataFrame, k: int = 8192, seed: int = 42) -> DataFrame:
    """A uniform sample of k cells of each column, the least hashes of (row, seed): the same in any order, and samples of parts merge.

    cells: (column_name, row_id, cell). Counts by the first BUCKET_BITS bits of the hash tell how far the k least can reach, so that only those rows
    are sorted and shuffled: k of a column and what else is in the last bucket.
    """
    h = F.xxhash64("column_name", "row_id", F.lit(seed))
    rows = cells.where(F.col("cell").isNotNull()).withColumn("_h", h).withColumn("_b", F.shiftright("_h", 64 - BUCKET_BITS))
    buckets = rows.groupBy(F.col("column_name").alias("_c"), F.col("_b").alias("_of")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_c").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reach = buckets.withColumn("_before", before).where(F.col("_before") < k).groupBy("_c").agg(F.max("_of").alias("_last"))
    rows = rows.join(F.broadcast(reach), F.col("column_name").eqNullSafe(F.col("_c")) & (F.col("_b") <= F.col("_last"))).drop("_b", "_c", "_last")
    return rows.withColumn("_k", F.row_number().over(W.partitionBy("column_name").orderBy("_h", "row_id"))).where(F.col("_k") <= k).drop("_h", "_k")


def sample_byte_capped(df: DataFrame, n: int, budget: int, order_by: str, columns: list[str]) -> DataFrame:
    """Of the first n rows, those before their running encoded size passes the budget; the window sees n rows at most."""
    size = sum((encoded_size(F.col(c).cast("string")) for c in columns), F.lit(0).cast("long"))
    rows = df.orderBy(order_by).limit(n).withColumn("row_bytes", size)
    return rows.withColumn("running_bytes", F.sum("row_bytes").over(W.orderBy(order_by).rowsBetween(W.unboundedPreceding, 0))).where(F.col("running_bytes") <= budget)


def sample_provenance(sample: DataFrame, requested: int, method: str, layout: str, biased_reason: str = "deterministic-first-n-rows") -> DataFrame:
    """One row that says how a sample was taken; fewer rows than requested mean that all were read, which is never biased."""
    complete = F.col("sample_rows") < requested
    out = sample.agg(F.count("*").alias("sample_rows"))
    return out.select("sample_rows", F.lit(method).alias("sample_method"), F.lit(layout).alias("sample_layout"), (~complete).alias("sampled_with_bias"), F.when(~complete, biased_reason).otherwise("").alias("bias_reason"), complete.alias("complete_row_read"))


def scale_sample_bytes(df: DataFrame, sample_bytes: str, sample_rows: str, rows: str) -> DataFrame:
    """df with logical_bytes: the bytes of the sample scaled to all rows, rounded up."""
    wide = F.col(sample_bytes).cast("decimal(20,0)") * F.col(rows).cast("decimal(18,0)") + F.col(sample_rows) - 1
    return df.withColumn("logical_bytes", F.when(F.col(sample_rows) > 0, div(wide.cast("decimal(38,0)"), F.greatest(F.col(sample_rows), F.lit(1)).cast("decimal(20,0)")).cast("long")).otherwise(0))
