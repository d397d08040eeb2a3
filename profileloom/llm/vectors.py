"""What the operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and holds neither null nor NaN nor infinite components."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def doubles(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def padded(vector: Column, size: int) -> Column:
    """A vector of `size` components, with zeros at its end."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast("double"), F.greatest(F.lit(size) - F.size(vector), F.lit(0))))


def longest(rows: DataFrame, vector: str) -> int:
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def inner_product(a: str, b: str) -> Column:
    """The sum of products in double precision, first components first; what one vector is longer by counts as zero."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0).cast("double"), lambda s, x: s + x)


def list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a column of lists and where each row's begin and end."""
    offsets = column.offsets.to_numpy()
    return column.values, offsets


def regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `size` rows, the last one smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size).combine_chunks().to_batches()[0]
            rest = table.slice(size).combine_chunks()
            held = rest.to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
