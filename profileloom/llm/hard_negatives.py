"""Hard negatives by exact integer scores from tables of subset sums, looked up by bytes of bit planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.llm.common import stored
from profileloom.llm.vectors import doubles, finite, longest, padded

#: Components are floor(SCALE * x); dimensions are looked up in groups of eight.
SCALE, GROUP = 256, 8
#: Anchors whose tables of subset sums one task holds, and rows that are scored against them at a time.
ANCHORS, ROWS = 256, 2048
#: Rows scored in one pass over the tables: their sums stay in the processor's cache.
STEP = 128


def with_components(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v being the integer components.

    Rows with a null id, label, vector or component or one that isn't finite take no part. vec_id is the key: of rows that share one, the
    least label and vector counts. Vectors are as long as the longest, with zeros at their end. Components beyond the long range stop at it.
    """
    kept = rows.where(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & finite(vector))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), doubles(vector).alias("x"))
    kept = kept.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    size = -(-max(longest(kept, "x"), 1) // GROUP) * GROUP
    return kept.select("vec_id", "label", F.transform(padded(F.col("x"), size), lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def bit_planes(v: np.ndarray) -> tuple[np.ndarray, int]:
    """uint8[plane, group, row] of integer rows: byte g of plane b has bit b of components 8g to 8g+7, in two's complement; and the number of planes."""
    bits = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1 if len(v) else 0, 0).bit_length() + 1
    planes = np.stack([np.packbits(((v >> b) & 1).astype(np.uint8).reshape(len(v), -1, GROUP), axis=2, bitorder="little")[:, :, 0].T for b in range(bits)])
    return planes, bits


def subset_sums(v: np.ndarray) -> np.ndarray:
    """int64[group, byte, anchor]: for each group of eight dimensions the sums of all subsets of an anchor's components, each from a smaller one."""
    groups = v.reshape(len(v), -1, GROUP).transpose(1, 2, 0)
    out = np.zeros((groups.shape[0], 1, len(v)), np.int64)
    for d in range(GROUP):
        out = np.concatenate([out, out + groups[:, d, None, :]], axis=1)
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [row, anchor] by lookups, shifts and additions: planes count twice as much each, the highest one negatively."""
    bits, groups, n = planes.shape
    total = np.zeros((n, tables.shape[2]), np.int64)
    for a in range(0, n, STEP):
        out = total[a : a + STEP]
        for b in range(bits - 1, -1, -1):
            part = tables[0].take(planes[b, 0, a : a + STEP], axis=0)
            for g in range(1, groups):
                part += tables[g].take(planes[b, g, a : a + STEP], axis=0)
            if b == bits - 1:
                np.negative(part, out=out)
            else:
                out <<= 1
                out += part
    return total


def _narrow(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The tables with 32 bits where no sum of lookups can pass them, which halves the memory that is read."""
    most = sum(max(int(t.max(initial=0)), -int(t.min(initial=0))) for t in tables)
    return tables.astype(np.int32) if most << planes.shape[0] < 1 << 31 else tables


def _best(score: np.ndarray, ids: np.ndarray, good: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the best `keep` rows of each anchor (columns) among the good ones; ties by smaller id; rows are sorted by id."""
    masked = np.where(good, score, np.iinfo(np.int64).min)
    if len(ids) > 4 * keep:
        # all rows that are as good as the keep-th best, so that ties are settled by id
        least = np.partition(masked, len(ids) - keep, axis=0)[len(ids) - keep]
        good = good & (masked >= least)
    anchor, row = np.nonzero(good.T)
    order = np.lexsort((row, -masked[row, anchor], anchor))
    anchor, row = anchor[order], row[order]
    starts = np.searchsorted(anchor, np.arange(score.shape[1]))
    rank = np.arange(len(anchor)) - starts[anchor]
    return anchor[rank < keep], row[rank < keep]


def _blocks(rows: DataFrame, size: int, *more: str) -> DataFrame:
    """Rows in blocks of about `size`: (block, rows), rows being structs in the order of their ids. Blocks are hashes, so none is hot."""
    n = rows.count()
    blocks = max(1, -(-n // size))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    return rows.withColumn("block", block).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "v", *more))).alias("rows"))


def _pairs(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """(anchors, rows): each block of rows with each block of anchors; the smaller table is repeated, in whole blocks."""
    n = anchors.agg(F.max("block")).first()[0]
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(0 if n is None else n).cast("long"))
    repeated = rows.select("rows", F.explode(numbers).alias("block"))
    return anchors.withColumnRenamed("rows", "anchors").join(repeated, "block").select("anchors", "rows")


def _structs(column: pa.Array, at: int) -> pa.StructArray:
    return column.slice(at, 1).flatten()


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each pair of blocks the fields of both and their scores [row, anchor]."""
    for batch in batches:
        for k in range(batch.num_rows):
            a, r = (dict(zip([f.name for f in s.type], s.flatten(), strict=True)) for s in (_structs(batch.column("anchors"), k), _structs(batch.column("rows"), k)))
            planes, _ = bit_planes(_matrix(r["v"]))
            tables = _narrow(subset_sums(_matrix(a["v"])), planes)
            yield a, r, scores(tables, planes)


def _positives(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, r, score in _scored(batches):
            ids, anchors = r["vec_id"].to_numpy(), a["vec_id"].to_numpy()
            good = (r["label"].to_numpy()[:, None] == a["label"].to_numpy()[None]) & (ids[:, None] != anchors[None])
            anchor, row = _best(score, ids, good, keep)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[anchor]), pa.array(ids[row]), pa.array(score[row, anchor])], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(keep: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, r, score in _scored(batches):
            ids, anchors = r["vec_id"].to_numpy(), a["vec_id"].to_numpy()
            other = r["label"].to_numpy()[:, None] != a["label"].to_numpy()[None]
            found: list[tuple] = []
            lists = a["positives"].to_pylist()
            for k in range(max(map(len, lists), default=0)):  # the k-th positives of all anchors at once
                has = np.array([len(x) > k for x in lists])
                ids_k = np.array([x[k]["positive_id"] if len(x) > k else -1 for x in lists], np.int64)
                score_k = np.array([x[k]["positive_score"] if len(x) > k else 0 for x in lists], np.int64)
                whole, rest = score_k // 100, score_k % 100
                least, most = whole * low + -(-rest * low // 100), whole * high + rest * high // 100
                good = other & has[None] & (score >= least[None]) & (score <= most[None])
                anchor, row = _best(score, ids, good, keep)
                found.append((anchors[anchor], ids_k[anchor], ids[row], score_k[anchor], score[row, anchor]))
            names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if found else pa.array([], pa.int64()) for x in (zip(*found, strict=True) if found else [()] * 5)], names)

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    rows: vec_id, label, v of with_components; is_anchor: a condition on vec_id and label. Positives are the anchor's best rows of its label, itself left out;
    negatives the best rows of other labels whose score is `low` to `high` per cent of the positive's. Ties go to the smaller vec_id. An anchor without
    positives, or a positive without such negatives, has no row; so has an empty table. Scores must fit a long.

    Every anchor meets every row, in pairs of blocks: a task holds ANCHORS tables of subset sums and ROWS rows as bit planes, and gives
    the best few of each anchor; those of all tasks are ranked then, limited before the shuffle, too.
    """
    rows = stored(rows)
    anchors = rows.where(is_anchor)
    blocks = stored(_blocks(rows, ROWS))
    first = _pairs(_blocks(anchors, ANCHORS), blocks).mapInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = first.withColumn("place", place).where(F.col("place") <= positives)
    lists = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    known = stored(anchors.join(lists, "vec_id"))
    second = _pairs(_blocks(known, ANCHORS, "positives"), blocks).mapInArrow(_negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return second.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
