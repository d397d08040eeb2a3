"""Compressibility of columns and tables. Bytes are compressed by Arrow's zstd in tasks that hold one bounded block each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.functions.tokens import entropy_from_ratio
from profileloom.operators.graph import _cut

#: Raw bytes of a block whose ratio varies, and rows of a frame.
BLOCK_BYTES, FRAME_ROWS = 64 << 10, 1000
#: Groups of eight blocks in a task: 64 MB of cells.
TASK_GROUPS = 128


def _zstd(raw: bytes) -> int:
    import pyarrow as pa

    return pa.Codec("zstd", compression_level=3).compress(raw).size if raw else 0


def column_compression(cells: DataFrame) -> DataFrame:
    """(column_name, raw_bytes, packed_bytes, ratio, ratio_stddev): ratios by zstd over blocks of at most BLOCK_BYTES, and their spread.

    cells: (column_name, row_id, cell). Cells are dealt by (column, hash of row) into as many groups as the column's
    bytes need, so no task gets a whole column; within a group they are packed in row order, block by block. There are as many tasks as leave each
    about TASK_GROUPS groups, however large the input.
    """
    size = F.octet_length("cell") + 1
    totals = cells.groupBy("column_name").agg(F.ceil(F.sum(F.coalesce(size, F.lit(1))) / (8 * BLOCK_BYTES)).alias("groups"))
    totals, seen = _cut(totals, F.sum("groups").alias("groups"))  # a row for each column
    rows = cells.join(F.broadcast(totals), "column_name").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("groups")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, block, held, at = [], [], 0, (None, None)

        def flush() -> None:
            nonlocal block, held
            raw = b"".join(block)
            if raw:
                out.append((at[0], len(raw), _zstd(raw)))
            block, held = [], 0

        for batch in batches:
            for name, part, cell in zip(batch.column_name, batch.part, batch.cell, strict=True):
                if (name, part) != at:  # groups that share a partition don't share a block
                    flush()
                    at = name, part
                raw = memoryview(b"\0" if cell is None else b"\1" + cell.encode())
                while raw:  # a cell may go on in the next block
                    block.append(raw[: BLOCK_BYTES - held])
                    held, raw = held + len(block[-1]), raw[BLOCK_BYTES - held :]
                    if held == BLOCK_BYTES:
                        flush()
            if out:
                yield pd.DataFrame(out, columns=["column_name", "raw", "packed"])
                out.clear()
        flush()
        yield pd.DataFrame(out, columns=["column_name", "raw", "packed"])

    tasks = (seen.get("groups") or 0) // TASK_GROUPS + 1
    many = tasks > int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.repartition(tasks, "column_name", "part") if many else rows.repartition("column_name", "part")).sortWithinPartitions("column_name", "part", "row_id", "cell").select("column_name", "part", "cell")
    blocks = rows.mapInPandas(run, "column_name string, raw long, packed long")
    out = blocks.groupBy("column_name").agg(F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("packed_bytes"), F.coalesce(F.stddev_pop(F.col("raw") / F.col("packed")), F.lit(0.0)).alias("ratio_stddev"))
    return out.select("column_name", "raw_bytes", "packed_bytes", (F.col("raw_bytes") / F.col("packed_bytes")).alias("ratio"), "ratio_stddev")


def _frames(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with `frame` and `number`: rows of each `by` in order, cut at every multiple of FRAME_ROWS.

    Rows are dealt by ranges of (by, order), however many, and numbered there; a frame that goes on in the next range is whole all the same, since
    numbers start from the counts of the ranges before. Those counts are a row for each range and `by` at most. Equal rows fall in one range and may change places.
    """
    placed = _cut(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id()))
    place = F.shiftright("_at", 33)
    ranges = placed.groupBy(by, place.alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), (before - F.col("_first")).alias("_shift"))
    numbers = placed.withColumn("_range", place).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    number = F.col("_at") + F.col("_shift")
    return numbers.select(*rows.columns, number.alias("number"), F.floor(number / FRAME_ROWS).alias("frame"))


def frame_compression(df: DataFrame, key: str, columns: list[str], by: str | None = None) -> DataFrame:
    """One row (frames, raw_bytes, packed_bytes, ratio) for the table packed by frames of FRAME_ROWS rows, column by column; with `by` one for each of its values, beside it.

    Rows go in the order of key and columns, NULL first, and are cut at every FRAME_ROWS rows of the table, or of the value of `by`, whatever the partitions: only the last
    frame is shorter. A frame is a descriptor, the lengths (0xFFFFFFFF for NULL) and the payloads of each column.
    """
    cells = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select((F.col(by).cast("string") if by else F.lit("")).alias("by"), F.col(key).alias("key"), *cells)
    order = ["key", *(f"c{i}" for i in range(len(columns)))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame, at, out = [], None, []

        def flush() -> None:
            if not frame:
                return
            raw = b""
            for i in range(len(columns)):
                values = [r[i] for r in frame]
                raw += i.to_bytes(4, "little") + b"".join((0xFFFFFFFF if v is None else len(v)).to_bytes(4, "little") for v in values) + b"".join(v for v in values if v)
            out.append((at[0], len(raw), _zstd(raw)))
            frame.clear()

        for batch in batches:
            for group, number, *values in zip(batch["by"], batch["frame"], *(batch[f"c{i}"] for i in range(len(columns))), strict=True):
                if (group, number) != at:
                    flush()
                    at = group, number
                frame.append([None if v is None else v.encode() for v in values])
            yield pd.DataFrame(out, columns=["by", "raw", "packed"])
            out.clear()
        flush()
        yield pd.DataFrame(out, columns=["by", "raw", "packed"])

    dealt = _frames(rows, "by", order).repartition("by", "frame").sortWithinPartitions("by", "frame", "number")
    packed = dealt.select("by", "frame", *order[1:]).mapInPandas(run, "by string, raw long, packed long")
    sums = [F.count("*").alias("frames"), F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("packed_bytes"), (F.sum("raw") / F.sum("packed")).alias("ratio")]
    return packed.groupBy(F.col("by").alias(by)).agg(*sums) if by else packed.agg(*sums)


def storage_ratio(logical: Column, stored: Column) -> Column:
    return F.when((logical > 0) & (stored > 0), logical / stored).otherwise(0.0)


def compression_summary(tables: DataFrame) -> DataFrame:
    """Totals over counted tables with a positive ratio. tables: table_id, counted, raw_bytes, ratio, biased."""
    rows = tables.where(F.col("counted") & (F.col("ratio") > 0))
    out = rows.agg(F.count("*").alias("n_tables"), F.sum("raw_bytes").alias("raw_bytes"), F.sum(F.col("raw_bytes") / F.col("ratio")).alias("packed_bytes"), F.sum(F.col("biased").cast("long")).alias("n_biased"))
    return out.withColumn("ratio", F.col("raw_bytes") / F.col("packed_bytes")).withColumn("reduction_percent", 100 * (1 - F.col("packed_bytes") / F.col("raw_bytes")))


def compression_ranking(tables: DataFrame, k: int = 10) -> DataFrame:
    """The k best ratios, ties by id."""
    return tables.where(F.col("counted") & (F.col("ratio") > 0)).orderBy(F.desc("ratio"), "table_id").limit(k)


#: Entropy of a table without a ratio, by its kinds of columns: bytes and no texts, large objects or MANY texts, some texts, neither.
BY_KIND, MANY = (0.75, 0.35, 0.5, 0.8), 4


def entropy_by_kinds(columns: DataFrame) -> DataFrame:
    """(table_id, kinds_entropy) from what kinds of columns a table has. columns: table_id, is_text, is_binary, is_large (a type without a bound); NULL flags are false."""
    count = lambda flag: F.count(F.when(F.col(flag), 1)).alias(flag)
    n = columns.groupBy("table_id").agg(count("is_text"), count("is_binary"), count("is_large"))
    bytes_only, large, texts = (F.col("is_binary") > 0) & (F.col("is_text") == 0), (F.col("is_large") > 0) | (F.col("is_text") >= MANY), F.col("is_text") > 0
    return n.select("table_id", F.when(bytes_only, BY_KIND[0]).when(large, BY_KIND[1]).when(texts, BY_KIND[2]).otherwise(BY_KIND[3]).alias("kinds_entropy"))


def entropy_profile(columns: DataFrame) -> DataFrame:
    """columns (table_id, ratio, table_ratio, is_text, is_binary, is_large) with their entropy: from the column's ratio, else its table's, else the kinds of the table's columns.

    A ratio counts if it is at least 1. NULL tables have no kinds in common: their columns without any ratio get NULL.
    """
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 1) & (F.col(c) < float("inf"))
    rows = columns.join(entropy_by_kinds(columns), "table_id", "left")
    entropy = F.when(usable("ratio"), entropy_from_ratio("ratio")).when(usable("table_ratio"), entropy_from_ratio("table_ratio")).otherwise(F.col("kinds_entropy"))
    return rows.withColumn("entropy", entropy).drop("kinds_entropy")
