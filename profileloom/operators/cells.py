"""Cells in long form, and their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark type names by cell tag; what isn't listed is text.
TAGS = {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "binary": "bytes"}


def type_tag(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return "decimal"
    return "json" if spark_type.startswith(("array", "map", "struct")) else TAGS.get(spark_type, "text")


def as_text(df: DataFrame, column: str) -> Column:
    """A cell as text; nested columns as JSON."""
    return F.to_json(column) if type_tag(dict(df.dtypes)[column]) == "json" else F.col(column).cast("string")


def long_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, ordinal, tag, cell): a row for each cell; ordinals are those of the table, from 1. Columns that aren't asked for aren't read."""
    types, columns = dict(df.dtypes), columns or df.columns
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(df.columns.index(c) + 1).alias("ordinal"), F.lit(type_tag(types[c])).alias("tag"), as_text(df, c).alias("cell")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def encoded_size(cell: Column) -> Column:
    """Bytes of a cell as tag, LEB128 length and payload; a NULL is one byte."""
    n = F.octet_length(cell)
    digits = F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)
    return F.when(cell.isNull(), F.lit(1)).otherwise(1 + digits + n).cast("long")


def encoded_size_profile(cells: DataFrame) -> DataFrame:
    """(column_name, cells, encoded_bytes)."""
    return cells.groupBy("column_name").agg(F.count("*").alias("cells"), F.sum(encoded_size(F.col("cell"))).alias("encoded_bytes"))


def truncate_cells(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Texts cut to so many characters, each beside the octets it had, <column>_octets."""
    out = []
    for c in df.columns:
        out += [F.substring(c, 1, limits[c]).alias(c), F.octet_length(c).cast("long").alias(f"{c}_octets")] if c in limits else [F.col(c)]
    return df.select(*out)


def transfer_columns(columns: DataFrame) -> DataFrame:
    """Columns that can be loaded: not generated, computed, of system time or a row version; by table, ordinal and name, as far as `columns` has them. A NULL kind is an ordinary column."""
    order = [c for c in ("table_id", "ordinal", "name") if c in columns.columns]
    return columns.where(~F.coalesce(F.col("kind"), F.lit("")).isin("generated", "computed", "system-time", "rowversion")).orderBy(*order)
