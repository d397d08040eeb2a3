"""Approximate nearest neighbours by inner product: a graph built by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.llm.common import hot_hashes, salted_join, stored
from profileloom.llm.vectors import doubles, finite, inner_product, longest, padded, regrouped

#: Neighbours of a node in the graph, and links to it that count besides; a node with more of those takes part by a hash's choice.
DEGREE, BACK = 24, 24
#: Random orders in which vectors that come close to each other are compared first, vectors of one comparison, and best ones of each.
ORDERS, BLOCK, FIRST = 4, 256, 12
#: Planes of an order: vectors on the same side of all of them are next to each other.
PLANES = 30
#: Rounds of NN-descent at most; it ends sooner when less than SETTLED of the links are new.
ROUNDS, SETTLED = 5, 0.05
#: Nodes a search keeps, best first.
BEAM = 256
#: Steps of a search at most, so that it ends; it does when a step finds nothing better, mostly after ten.
STEPS = 100


# Codes: 16-bit components with a scale, 2 bytes each, beside which links and messages are small. They steer; scores come from the vectors.


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1, initial=0) / 32767
    return np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype("<i2"), scale


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _unpacked(codes: pa.Array, scale: pa.Array) -> np.ndarray:
    """float32 vectors of codes."""
    n = len(codes)
    if not n:
        return np.zeros((0, 0), np.float32)
    whole = b"".join(codes.to_pylist())
    return np.frombuffer(whole, "<i2").reshape(n, -1).astype(np.float32) * scale.to_numpy().astype(np.float32)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, scale = _codes(_matrix(batch.column("x"))) if batch.num_rows else (np.zeros((0, 1), "<i2"), np.zeros(0))
        yield pa.RecordBatch.from_arrays([batch.column("node"), _binary(codes), pa.array(scale)], ["node", "code", "scale"])


def encoded(vectors: DataFrame) -> DataFrame:
    """(node, code, scale) of (node, x)."""
    return vectors.select("node", "x").mapInArrow(_encode, "node long, code binary, scale double")


def _orders(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(7).standard_normal((dimensions, ORDERS * PLANES)).astype(np.float32)
        weights = 1 << np.arange(PLANES, dtype=np.int64)
        for batch in batches:
            sides = (_unpacked(batch.column("code"), batch.column("scale")) @ planes > 0).reshape(batch.num_rows, ORDERS, PLANES) if batch.num_rows else np.zeros((0, ORDERS, PLANES), bool)
            keys = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * ORDERS, pa.array((sides @ weights).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["node", "code", "scale", "keys"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best FIRST of each vector within its block."""
    for batch in regrouped(batches, BLOCK):
        x, ids = _unpacked(batch.column("code"), batch.column("scale")), batch.column("node").to_numpy()
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        keep = min(FIRST, len(ids) - 1)
        if not keep:
            continue
        best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        rows = np.repeat(np.arange(len(ids)), keep)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[best.ravel()]), pa.array(sims[rows, best.ravel()].astype(np.float32))], ["v", "c", "sim"])


def _first_links(nodes: DataFrame, dimensions: int) -> DataFrame:
    """(v, c, sim): links between vectors that stand close to each other in one of the random orders. Ties are dealt by a hash."""
    keyed = nodes.mapInArrow(_orders(dimensions), "node long, code binary, scale double, keys array<long>")
    keyed = keyed.select("node", "code", "scale", F.posexplode("keys").alias("tree", "key"))
    order = ["tree", "key", F.xxhash64("node")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "code", "scale").mapInArrow(_near, "v long, c long, sim float")


def _kept(links: DataFrame) -> DataFrame:
    """The best DEGREE links (v, c, sim, fresh) of each node, and the least sim of a full list; a link that was there before isn't fresh."""
    one = links.groupBy("v", "c").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    best = one.withColumn("place", F.row_number().over(W.partitionBy("v").orderBy(F.desc("sim"), "c"))).where(F.col("place") <= DEGREE)
    floor = F.max(F.when(F.col("place") == DEGREE, F.col("sim"))).over(W.partitionBy("v"))
    return best.withColumn("floor", floor).select("v", "c", "sim", "fresh", "floor")


def _around(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, near): each node with its neighbours, those it is a neighbour of (BACK at most, by hash) and itself: node, code, scale, floor, fresh."""
    back = links.select(F.col("c").alias("v"), F.col("v").alias("node"), "fresh")
    back = back.withColumn("place", F.row_number().over(W.partitionBy("v").orderBy(F.xxhash64("node", "v")))).where(F.col("place") <= BACK).drop("place")
    itself = nodes.select(F.col("node").alias("v"), "node", F.lit(False).alias("fresh"))
    pairs = links.select("v", F.col("c").alias("node"), "fresh").union(back).groupBy("v", "node").agg(F.max("fresh").alias("fresh")).union(itself)
    floors = links.groupBy(F.col("v").alias("node")).agg(F.max("floor").alias("floor"))
    known = nodes.join(floors, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")).cast("float")))
    met = salted_join(pairs, known, ["node"], hot_hashes(links, ["c"]), ["v"])
    return met.groupBy("v").agg(F.collect_list(F.struct("node", "code", "scale", "floor", "fresh")).alias("near"))


def _fields(column: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The fields of lists of structs, flat, and the offsets of the lists."""
    offsets = column.offsets.to_numpy()
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return dict(zip([f.name for f in flat.type], flat.flatten(), strict=True)), offsets - offsets[0]


def _best_of(v: np.ndarray, c: np.ndarray, sim: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, the best `keep` of each v."""
    order = np.lexsort((c, v))
    v, c, sim = v[order], c[order], sim[order]
    first = np.r_[True, (v[1:] != v[:-1]) | (c[1:] != c[:-1])] if len(v) else np.zeros(0, bool)
    v, c, sim = v[first], c[first], sim[first]
    order = np.lexsort((-sim, v))
    v, c, sim = v[order], c[order], sim[order]
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, int)
    kept = np.arange(len(v)) - np.repeat(starts, np.diff(np.r_[starts, len(v)])) < keep
    return v[kept], c[kept], sim[kept]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between those around a node that at least one end doesn't have yet and would keep; pairs that met before are left out."""
    for batch in regrouped(batches, 1000):
        near, offsets = _fields(batch.column("near"))
        x, ids, floor, fresh = _unpacked(near["code"], near["scale"]), near["node"].to_numpy(), near["floor"].to_numpy(), near["fresh"].to_numpy(zero_copy_only=False)
        size = np.diff(offsets)
        widest = int(size.max(initial=0))
        at = offsets[:-1, None] + np.minimum(np.arange(widest)[None], np.maximum(size[:, None] - 1, 0))
        real = np.arange(widest)[None] < size[:, None]
        found: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(at), 100):
            some, there = at[a : a + 100], real[a : a + 100]
            vectors = x[some]
            sims = vectors @ vectors.transpose(0, 2, 1)
            new = fresh[some] & there
            good = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & (sims > floor[some][:, :, None]) & ~np.eye(widest, dtype=bool)[None]
            g, i, j = np.nonzero(good)
            found.append((ids[some[g, i]], ids[some[g, j]], sims[g, i, j]))
        v, c, sim = _best_of(*(np.concatenate(f) for f in zip(*found, strict=True)), DEGREE) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(c, pa.int64()), pa.array(sim, pa.float32())], ["v", "c", "sim"])


def neighbour_links(nodes: DataFrame, dimensions: int) -> DataFrame:
    """(v, c, sim, fresh, floor): for each node (node, code, scale) its about DEGREE nearest.

    Links between vectors close in random orders come first. In each round then, all around a node - its neighbours, whose neighbour it is,
    and itself - meet there, unless they met before, and each takes those better than what it has: neighbours of neighbours are
    neighbours. A round is a join of links with nodes and two grouped steps; tasks send only what beats a full list.
    """
    links = stored(_kept(_first_links(nodes, dimensions).withColumn("fresh", F.lit(True))))
    for _ in range(ROUNDS):
        met = _around(links, nodes).mapInArrow(_meet, "v long, c long, sim float").withColumn("fresh", F.lit(True))
        links = stored(_kept(links.select("v", "c", "sim", F.lit(False).alias("fresh")).union(met)))
        total, new = links.agg(F.count("*"), F.count(F.when(F.col("fresh"), 1))).first()
        if new <= SETTLED * total:
            break
    return links


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of what is around the nodes that searches go on from; what a full beam wouldn't take stays here."""
    for batch in regrouped(batches, 2000):
        near, offsets = _fields(batch.column("near"))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        query = _unpacked(batch.column("q_code"), batch.column("q_scale"))
        sim = np.einsum("nd,nd->n", query[rows], _unpacked(near["code"], near["scale"])) if len(rows) else np.zeros(0, np.float32)
        good = sim > batch.column("least").to_numpy()[rows]
        q, c, sim = _best_of(batch.column("q").to_numpy()[rows[good]], near["node"].to_numpy()[good], sim[good], BEAM)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(sim, pa.float32())], ["q", "c", "sim"])


def graph_search(graph: DataFrame, queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(q, c, sim): the BEAM best nodes that a greedy search finds for each query. graph: _around's; queries: q, q_code, q_scale; seeds: q, c to start from.

    A step goes on from all nodes of a query's beam that it hasn't been at, in one join with the graph, and keeps the best BEAM of what it finds
    and has. It ends when no beam has such nodes.
    """
    none = F.lit(float("-inf")).cast("float")
    front = seeds.select("q", "c", none.alias("least"))
    beam = None
    for _ in range(STEPS):
        asked = front.join(queries, "q")
        met = salted_join(asked, graph.select(F.col("v").alias("c"), "near"), ["c"], hot_hashes(front, ["c"]), ["q"])
        found = met.select("q", "q_code", "q_scale", "least", "near").mapInArrow(_step, "q long, c long, sim float").withColumn("open", F.lit(True))
        if beam is None:  # the seeds themselves are around them, and have been gone on from
            found = found.union(seeds.select("q", "c", none.alias("sim"), F.lit(False).alias("open")))
        both = found if beam is None else beam.select("q", "c", "sim", F.lit(False).alias("open")).union(found)
        one = both.groupBy("q", "c").agg(F.max("sim").alias("sim"), F.min("open").alias("open"))
        best = one.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "c"))).where(F.col("place") <= BEAM)
        beam = stored(best.withColumn("least", F.coalesce(F.max(F.when(F.col("place") == BEAM, F.col("sim"))).over(W.partitionBy("q")), none)))
        front = beam.where("open").select("q", "c", "least")
        if not front.take(1):
            return beam.select("q", "c", "sim")
    raise RuntimeError(f"searches haven't ended after {STEPS} steps")


def usable_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part: not null, not all zero, all components finite. vec_id is the key: of rows that share one, the least vector counts."""
    kept = rows.where(F.col("vec_id").isNotNull() & finite(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), doubles(vector).alias("x"))
    return kept.where(F.exists("x", lambda x: x != 0)).groupBy("vec_id").agg(F.min("x").alias("x"))


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query, a row of `rows` that meets the condition on vec_id, the k other rows of largest inner product found.

    Ties go to the smaller vec_id. Rows that usable_vectors leaves out are neither queries nor found; shorter vectors count as filled with zeros. An empty
    table, or one row alone, gives no rows. The search is approximate: what it finds has exact scores, in double precision,
    but a better row may be missed. k is at most DEGREE - 1.

    Equal vectors are one node of the graph, whose k+1 least ids are all that an answer can hold, so that thousands of copies don't
    crowd out each other's neighbours. A query starts at its own node.
    """
    if k >= DEGREE:
        raise ValueError(f"k must be less than {DEGREE}")
    vectors = stored(usable_vectors(rows, vector))
    size = longest(vectors, "x")
    vectors = vectors.withColumn("x", padded(F.col("x"), size))
    firsts = vectors.groupBy("x").agg(F.min("vec_id").alias("node"))
    placed = stored(salted_join(vectors, firsts, ["x"], hot_hashes(vectors, ["x"]), ["vec_id"]).select("vec_id", "node", "x"))
    originals = placed.where("vec_id = node").select("node", "x")
    nodes = stored(encoded(originals))
    links = neighbour_links(nodes, size)
    graph = stored(_around(links, nodes))
    asked = placed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    searched = asked.select("q").distinct()
    queries = nodes.select(F.col("node").alias("q"), F.col("code").alias("q_code"), F.col("scale").alias("q_scale")).join(searched, "q", "left_semi")
    found = graph_search(graph, stored(queries), searched.withColumn("c", F.col("q")))
    # codes steer to a few more than are wanted, the vectors decide
    few = found.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "c"))).where(F.col("place") <= 2 * k).select("q", "c")
    itself = searched.select("q", F.col("q").alias("c"))
    few = few.union(itself).distinct()
    ends = few.join(originals.select(F.col("node").alias("q"), F.col("x").alias("q_x")), "q")
    scored = salted_join(ends, originals.select(F.col("node").alias("c"), F.col("x").alias("c_x")), ["c"], hot_hashes(few, ["c"]), ["q"]).select("q", "c", inner_product("q_x", "c_x").alias("score"))
    copies = placed.select(F.col("node").alias("c"), "vec_id").withColumn("place", F.row_number().over(W.partitionBy("c").orderBy("vec_id"))).where(F.col("place") <= k + 1).select("c", "vec_id")
    lists = copies.groupBy("c").agg(F.collect_list("vec_id").alias("ids"))
    met = salted_join(scored, lists, ["c"], hot_hashes(few, ["c"]), ["q"]).select("q", "score", F.explode("ids").alias("vec_id"))
    # one more than wanted, since a query doesn't find itself
    top = met.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    answers = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("top"))
    each = salted_join(asked, answers, ["q"], hot_hashes(asked, ["q"]), ["query_id"])
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("p", "t")).select("query_id", (F.col("p") + 1).alias("rank"), "t.vec_id", "t.score")
