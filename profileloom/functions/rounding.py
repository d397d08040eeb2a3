"""Rounding of counts, sizes, lengths and fractions before a profile is shared. Column to Column; NULL stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | int


def _col(x: Number | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def div(a: Number | str, b: Number | str) -> Column:
    """Integer division."""
    return F.call_function("div", _col(a), _col(b))


def round_to_bucket(x: Number | str, bucket: Number) -> Column:
    """Nearest multiple of the bucket, halves up, but the one below where that is more than a long holds; a bucket of 0 leaves the value."""
    x, b = _col(x), _col(bucket)
    whole = F.when(b == 0, F.lit(1)).otherwise(b).cast("long")
    below = div(x, whole) * whole
    up = x - below >= whole - div(whole, 2)
    return F.when(b == 0, x).otherwise(F.when(up, F.coalesce(F.try_add(below, whole), below)).otherwise(below))


def round_rows(x: Number | str) -> Column:
    x = _col(x)
    return round_to_bucket(x, F.when(x <= 10_000, 100).when(x <= 1_000_000, 1_000).otherwise(10_000))


def round_estimated_rows(x: Number | str) -> Column:
    """Like round_rows, but a positive estimate never falls under 100."""
    x = _col(x)
    return F.when(x == 0, F.lit(0).cast("long")).when(x.isNotNull(), F.greatest(F.lit(100), round_rows(x)))


def round_partition_rows_max(x: Number | str, table_rows: Number | str) -> Column:
    """The largest partition, bounded by its table; NULL if the partition is unknown (0)."""
    x, rows = _col(x), _col(table_rows)
    return F.when(rows == 0, F.lit(0).cast("long")).when(x > 0, F.least(round_estimated_rows(x), rows))


def _bytes(x: Column, small: int) -> Column:
    return round_to_bucket(x, F.when(x < 1 << 20, small).when(x < 1 << 30, 1 << 20).otherwise(100 << 20))


def round_bytes(x: Number | str) -> Column:
    return _bytes(_col(x), 1 << 10)


def round_sample_bytes(x: Number | str) -> Column:
    return _bytes(_col(x), 64 << 10)


def _power_of_two(x: Column) -> Column:
    """The greatest power of two up to x, from the length of its binary digits; a float logarithm errs at powers."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x)) - 1)


def quantize_count(x: Number | str) -> Column:
    """Exact up to 32, else to a sixteenth of the greatest power of two."""
    x = _col(x).cast("long")
    return F.when(x <= 32, x).otherwise(round_to_bucket(x, div(_power_of_two(x), 16)))


#: Lengths use the same grid as counts.
round_len_relative = quantize_count


def quantize_count_at_most(x: Number | str, bound: Number | str) -> Column:
    """quantize_count, rounded down on the grid where it would pass the bound."""
    low = F.least(_col(x).cast("long"), _col(bound).cast("long"))
    near = quantize_count(low)
    step = div(_power_of_two(F.greatest(low, F.lit(33))), 16)
    return F.when(near <= _col(bound), near).otherwise(div(low, step) * step)


def quantize_non_null_rows(kept_rows: Number | str, rows: Number | str, kept_non_null: Number | str) -> Column:
    """Non-null rows of `kept_rows`, scaled to `rows`. None and all stay exact, and what is between stays between."""
    kept, rows, some = _col(kept_rows), _col(rows), _col(kept_non_null)
    safe = F.greatest(kept, F.lit(1))
    scaled = div(some.cast("decimal(38,0)") * rows.cast("decimal(20,0)") + div(kept, 2), safe.cast("decimal(20,0)")).cast("long")
    mixed = F.when(rows <= 1, F.lit(1).cast("long")).otherwise(quantize_count_at_most(F.least(F.greatest(scaled, F.lit(1)), rows - 1), rows - 1))
    return F.when((kept == 0) | (rows == 0) | (some == 0), F.lit(0).cast("long")).when(some >= kept, rows.cast("long")).otherwise(mixed)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def quantize_fraction(x: Number | str) -> Column:
    """To a two-hundredth within 0 and 1; what isn't finite is 0."""
    x = _col(x).cast("double")
    return F.when(_finite(x), F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 200 + 0.5) / 200).otherwise(0.0)


def round_ratio(x: Number | str) -> Column:
    """To a twentieth; what isn't finite is 0."""
    x = _col(x).cast("double")
    return F.when(_finite(x), F.floor(x * 20 + 0.5) / 20).otherwise(0.0)


def length_policy(avg: Number | str, p95: Number | str, policy: str) -> tuple[Column, Column]:
    """Average and 95th percentile as a policy shows them: exact, balanced (relative grid) or strict (tens and hundreds)."""
    avg, p95 = _col(avg), _col(p95)
    if policy == "balanced":
        short = round_len_relative(avg)
        return short, F.greatest(short, round_len_relative(p95))
    return (round_to_bucket(avg, 10), round_to_bucket(p95, 100)) if policy == "strict" else (avg, p95)


def weighted_percent(parts: list[tuple[Column, int]]) -> Column:
    """Weighted mean of whole percentages, halves up."""
    weight = sum(w for _, w in parts)
    return div(sum((c * w for c, w in parts), F.lit(0)) + weight // 2, weight)
