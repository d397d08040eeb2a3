"""Entropies at which generated columns and tables compress as measured: two-sided bisection, a Spark job a round."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import isfinite, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profileloom.operators.compression import column_compression, frame_compression
from profileloom.plans.generation import ColumnProfile, table_values

#: Rounds after the first, relative error that is near enough, and rows of a table that are made to measure it.
ROUNDS, TOLERANCE, SAMPLE_ROWS = 8, 0.02, 20_000
#: A column of bytes that compresses by no more than this stays as it is when its table is calibrated (fixed value).
INCOMPRESSIBLE = 1.1
#: Entropy of a column whose profile has none.
MIDDLE = 0.5


def _measured(spark: SparkSession, table: str, rows: int, probes: Sequence[tuple[ColumnProfile, float]]) -> list[float]:
    """The compression ratio of each column at its entropy, of the first SAMPLE_ROWS rows, in one job."""
    own = [p._replace(name=f"c{k}", entropy=e) for k, (p, e) in enumerate(probes)]
    base = spark.range(0, min(rows, SAMPLE_ROWS), 1, max(1, min(rows, SAMPLE_ROWS) // 2_000))
    made = table_values(base, table, rows, own)
    as_text = lambda p: F.lower(F.hex(p.name)) if p.family == "binary" else F.to_json(p.name) if p.family == "vector" else F.col(p.name).cast("string")
    cells = [F.struct(F.lit(p.name).alias("column_name"), F.col("id").alias("row_id"), as_text(p).alias("cell")) for p in own]
    found = {r.column_name: r.ratio for r in column_compression(made.select(F.explode(F.array(*cells)).alias("c")).select("c.*")).collect()}
    return [found.get(p.name, 1.0) for p in own]


def _next_probes(seen: dict[float, float], target: float) -> list[float]:
    """Up to two entropies to try next: between the two neighbours whose ratios enclose the target most closely, by halves and by the logarithms of their
    ratios; without such, the halves on both sides of the best."""
    order = sorted(seen)
    around = [(abs(log(seen[a] / seen[b])), a, b) for a, b in zip(order, order[1:], strict=False) if min(seen[a], seen[b]) <= target <= max(seen[a], seen[b])]
    if around:
        _, a, b = min(around)
        part = log(seen[a] / target) / log(seen[a] / seen[b]) if seen[a] != seen[b] else 0.5
        tries = [(a + b) / 2, a + (b - a) * min(max(part, 0.02), 0.98)]
    else:
        best = order.index(min(order, key=lambda e: abs(seen[e] - target)))
        tries = [(order[max(best - 1, 0)] + order[best]) / 2, (order[best] + order[min(best + 1, len(order) - 1)]) / 2]
    return [e for e in dict.fromkeys(tries) if all(abs(e - x) > 1e-9 for x in seen)]


def _checked(targets: Mapping[str, float]) -> None:
    bad = [c for c, t in targets.items() if not isfinite(t) or t <= 0]
    if bad:
        raise ValueError(f"ratios must be finite and positive: {bad}")


def _outcome(seen: dict[float, float], target: float, tolerance: float) -> tuple[float, float, float, int, bool]:
    best = min(sorted(seen), key=lambda e: abs(seen[e] - target))
    error = abs(seen[best] - target) / target
    return best, seen[best], error, len(seen), error <= tolerance


def calibrate_entropy(spark: SparkSession, table: str, rows: int, columns: Sequence[ColumnProfile], targets: Mapping[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(column_name, target_ratio, entropy, ratio, error, observations, matched) for each column with a target, the best entropy found.

    Both ends and the profile's entropy are measured first, then up to two entropies a round for each column that is still open, all columns in one job. A
    target beyond what a column can reach gets the nearest ratio measured, unmatched. Ratios are those of column_compression over the first SAMPLE_ROWS
    generated rows. Targets that aren't finite and positive raise; columns without a target have no row.
    """
    _checked(targets)
    own = [p for p in columns if p.name in targets]
    seen: dict[str, dict[float, float]] = {p.name: {} for p in own}
    for k in range(rounds + 1):
        probes = []
        for p in own:
            known, start = seen[p.name], MIDDLE if p.entropy is None else min(max(p.entropy, 0.0), 1.0)
            if not known or not _outcome(known, targets[p.name], tolerance)[4]:
                probes += [(p, e) for e in (_next_probes(known, targets[p.name]) if known else dict.fromkeys((0.0, 1.0, start)))]
        if not probes:
            break
        for (p, e), ratio in zip(probes, _measured(spark, table, rows, probes), strict=True):
            seen[p.name][e] = ratio
    out = [(p.name, float(targets[p.name]), *_outcome(seen[p.name], targets[p.name], tolerance)) for p in own]
    return spark.createDataFrame(out, "column_name string, target_ratio double, entropy double, ratio double, error double, observations int, matched boolean")


def shifted_entropy(entropy: float, baseline: float, level: float) -> float:
    """A column's entropy when its table goes from the baseline to a level, both between 0 and 1: a power that takes the baseline there.

    Columns keep their order, 0 and 1 stay, and levels of 0 and 1 take every other column along.
    """
    if level <= 0 or level >= 1:
        return float(level >= 1) if 0 < entropy < 1 else entropy
    edge = min(max(baseline, 1e-6), 1 - 1e-6)
    return 0.0 if entropy <= 0 else entropy ** (log(level) / log(edge))


def calibrate_table(spark: SparkSession, table: str, rows: int, columns: Sequence[ColumnProfile], target_ratio: float, ratios: Mapping[str, float] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[ColumnProfile], DataFrame]:
    """Columns whose entropies are shifted together until the table compresses as measured, and a row (target_ratio, level, ratio, error, observations, matched).

    The baseline is the mean entropy of the columns. Columns of bytes of which `ratios` says that they don't compress stay. The ratio is that of
    frame_compression over the first SAMPLE_ROWS rows; the levels of a round are measured in one job.
    """
    _checked({table: target_ratio})
    start = [MIDDLE if p.entropy is None else min(max(p.entropy, 0.0), 1.0) for p in columns]
    baseline = sum(start) / max(len(start), 1)
    fixed = {p.name for p in columns if p.family in ("binary", "base64") and (ratios or {}).get(p.name, 2.0) <= INCOMPRESSIBLE}
    at = lambda level: [p if p.name in fixed else p._replace(entropy=shifted_entropy(e, baseline, level)) for p, e in zip(columns, start, strict=True)]
    seen: dict[float, float] = {}
    for k in range(rounds + 1):
        if seen and _outcome(seen, target_ratio, tolerance)[4]:
            break
        levels = _next_probes(seen, target_ratio) if seen else list(dict.fromkeys((0.0, 1.0, min(max(baseline, 0.0), 1.0))))
        if not levels:
            break
        base, all_rows = spark.range(0, min(rows, SAMPLE_ROWS), 1, max(1, min(rows, SAMPLE_ROWS) // 2_000)), None
        for level in levels:
            made = table_values(base, table, rows, at(level)).withColumn("_level", F.lit(str(level)))
            made = made.withColumns({p.name: F.lower(F.hex(p.name)) for p in columns if p.family == "binary"} | {p.name: F.to_json(p.name) for p in columns if p.family == "vector"})
            all_rows = made if all_rows is None else all_rows.union(made)
        seen |= {float(r["_level"]): r.ratio for r in frame_compression(all_rows, "id", [p.name for p in columns], by="_level").collect()}
    level, *rest = _outcome(seen, target_ratio, tolerance)
    return at(level), spark.createDataFrame([(float(target_ratio), level, *rest)], "target_ratio double, level double, ratio double, error double, observations int, matched boolean")
