"""The exact check of near copies: links by the Jaccard similarity of word shingles, after those that fingerprints propose."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profileloom.llm.common import cut, hot_hashes, lower_ascii, removed, salted_join, stored, text_or_empty
from profileloom.llm.components import connected_components
from profileloom.llm.shingles import majority_bits, shingle_hashes

WIDTH = 5
#: Sets are near copies if their Jaccard similarity is LIKE[0] / LIKE[1] or more.
LIKE = (4, 5)
#: Texts that a worker unpacks at a time, and keys that it yields at a time.
SLICE, KEYS_AT_ONCE = 200, 200_000
#: Members of a bucket that meet each other in one part of a join.
PART = 256
#: Members over which a bucket is compared in blocks, sets by sets; nodes and shingles in a block on average, whichever are reached first, and those
#: of a bucket that a block has at least on average, as blocks that hardly share a bucket aren't worth comparing whole; shingles that a block's table
#: has at a time. A set is sent to each block that its own meets, so blocks are as large as a task can hold.
LARGE, BLOCK, BLOCK_SHINGLES, LEAST_SHARED, COLUMNS = 32, 512, 1 << 18, 8, 8192
#: Rounds in which buckets compare their members with one of them only.
STAR_ROUNDS = 1
#: Two fingerprints of near copies, of 64 bits each, differ in at most so many bits. At a similarity of just 0.8 one in seven bits
#: differs on average (the angle of the sets over pi), and more than 38 of 128 in about one pair of 100,000; of alike texts in fewer yet.
#: Sets of fewer shingles, whose majorities are often ties, aren't compared by fingerprint.
NEAR_BITS, FEW = 38, 8
#: The same for nodes of large buckets, before their sets are sent to other blocks: beyond it are fewer than one of a billion near copies.
BLOCK_BITS = 46
#: Rows of candidates, and bytes of their sets, up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(np.frombuffer(shingle_hashes(text, width), ">u8").astype(np.uint64))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    mixed = (hashes ^ (hashes >> np.uint64(33))) * _C2
    return (mixed ^ (mixed >> np.uint64(29))) * _C3


def node_of(hashes: np.ndarray) -> int:
    """A signed number for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64))


def size_class(n: int) -> tuple[int, int, int]:
    """(number, end, next one's end) of the class of sizes that n is in: each ends at LIKE[1]/LIKE[0] of its start."""
    number, start = 0, 1
    while True:
        end = start * LIKE[1] // LIKE[0]
        if n <= end:
            return number, end, (end + 1) * LIKE[1] // LIKE[0]
        number, start = number + 1, end + 1


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """Keys such that any two near copies, share one.

    Near copies of x <= y hashes differ in at most (x + y) / 9 of them (for 4/5), and y is in the class of x or in the
    next one. For its own class and for the next, a set is dealt by hash into more parts than sets up to the class's
    end can differ in, so that near copies have a part in common; a key is the class, the part and the sum of its
    hashes. So many empty parts that they alone could be the common ones have keys, too.
    """
    n, (p, q) = len(hashes), LIKE
    if not n:
        return np.zeros(0, np.uint64)
    number, *ends = size_class(n)
    out = []
    for k, end in enumerate(ends):
        apart = 2 * end * (q - p) // (q + p)
        spare = 1 + int(np.ceil(0.02 * apart + 4 * (0.02 * apart) ** 0.5)) if apart else 0
        parts = apart + 1 + spare
        part = ((hashes * _C1) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        used, starts = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(hashes[order], starts)
        # a partner of up to n * q/p hashes differs in as many at most
        differ = min(apart, n * (q - p) // p)
        if parts - len(used) >= parts - differ:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), used)
            used, sums = np.concatenate([used, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        key = sums * _C2 + (np.uint64(((number + k) << 40)) + used + np.uint64(1)) * _C3
        out.append((key ^ (key >> np.uint64(29))) * _C1)
    return np.concatenate(out)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(lower_ascii(text_or_empty("text")), 256).alias("text_sha256"), text_or_empty("text").alias("text"))


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_sha256, node, n, fp, fp2) of every row: its set of shingles, how many they are, and the set's fingerprints by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                digests = [shingle_hashes(t, width) for t in part.column("text").to_pylist()]
                every = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)
                counts = np.array([len(d) // 8 for d in digests], np.int64)
                sets = [np.unique(x) for x in np.split(every, np.cumsum(counts)[:-1])]
                sizes, flat = np.array([len(x) for x in sets], np.int64), np.concatenate(sets)
                prints = [pa.array(majority_bits(x, sizes).view(np.int64)) for x in (flat, _mixed(flat))]
                columns = [pa.array([node_of(x) for x in sets], pa.int64()), pa.array(sizes), *prints]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_sha256"), *columns], ["doc_id", "text_sha256", "node", "n", "fp", "fp2"])

    return _named(docs).mapInArrow(run, "doc_id long, text_sha256 string, node long, n long, fp long, fp2 long")


def _buckets(docs: DataFrame, width: int) -> DataFrame:
    """(key, node): the keys that more than one node has, once for each of them."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                sets = [shingle_set(t, width) for t in batch.slice(at, SLICE).column("text").to_pylist()]
                keys = [keys_of(x) for x in sets]
                node = np.repeat(np.array([node_of(x) for x in sets], np.int64), [len(k) for k in keys])
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
                for k in range(0, len(flat), KEYS_AT_ONCE):
                    yield pa.RecordBatch.from_arrays([pa.array(flat[k : k + KEYS_AT_ONCE]), pa.array(node[k : k + KEYS_AT_ONCE])], ["key", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def several(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
            key, node = key[new], node[new]
            same = key[1:] == key[:-1]
            good = np.r_[same, False] | np.r_[False, same] if len(key) else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(node[good])], ["key", "node"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            node = np.concatenate([node, batch.column("node").to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            if last:
                yield several(key[:last], node[:last])
                key, node = key[last:], node[last:]
        yield several(key, node)

    rows = docs.select(text_or_empty("text").alias("text")).mapInArrow(keyed, "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(shared, "key long, node long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, hashes) for rows (text), one of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                sets = [shingle_set(t, width) for t in batch.slice(at, SLICE).column("text").to_pylist()]
                hashes = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), hashes], ["node", "hashes"])

    return texts.select("text").mapInArrow(run, "node long, hashes array<long>")


def _sets_of(ends: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the nodes in `ends`, made of one text of each."""
    few = cut(nodes.join(ends, "node", "left_semi").select(F.col("row.doc_id").alias("_id"), F.col("row.text_sha256").alias("_sha")))
    some = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    texts = _named(docs).join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left_semi")
    return stored(_sets(texts, width).dropDuplicates(["node"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are near copies."""
    p, q = LIKE
    size = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    small = F.broadcast if 8 * size <= BROADCAST_BYTES else lambda rows: rows
    one = pairs.join(small(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))), "a")
    both = one.join(small(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b")


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((node, block) of the nodes in large buckets, (low, high) of the blocks to compare, (key) of the buckets that these stand for).

    rows: key, node, n, members. A node's home is the largest of its buckets, so that groups of alike texts share few homes; homes are split by hash into
    blocks. Two blocks are compared if they share a bucket. Buckets that are scattered over blocks of few of their members are left out.
    """
    large = rows.where(F.col("members") > LARGE)
    homes = large.groupBy("node").agg(F.max(F.struct("members", "key"))["key"].alias("home"), F.max("n").alias("n"))
    n = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("k"))
    homes = homes.drop("n")
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("k")))
    placed = cut(salted_join(homes, n, ["home"], hot_hashes(homes, ["home"]), ["node"]).select("node", block.alias("block")))
    met = salted_join(large.select("key", "node"), placed, ["node"], hot_hashes(large, ["node"]), ["key"]).groupBy("key", "block").agg(F.count("*").alias("n"))
    met = cut(met)
    whole = cut(met.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).where(F.col("n") >= LEAST_SHARED * F.col("blocks")).select("key"))
    low = met.join(whole, "key", "left_semi").select("key", F.col("block").alias("low"))
    meet = low.join(low.withColumnRenamed("low", "high"), "key").where("low <= high").select("low", "high").distinct()
    return placed, cut(meet), whole


def block_links(low: list[np.ndarray], high: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in low, then high) of links that join what all near copies between the sets of two blocks would join, at most one for each set.

    Shingles that both blocks have are columns of a table for each, and the product of the tables counts what two sets have in common.
    """
    (p, q), sizes = LIKE, [np.array([len(x) for x in side], np.int64) for side in (low, high)]
    flat, owner = [np.concatenate([*side, np.zeros(0, np.uint64)]) for side in (low, high)], [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.intersect1d(*flat)
    for k in range(2):
        at = np.searchsorted(shared, flat[k])
        inside = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == flat[k]) if len(shared) else at[:0]
        order = inside[np.argsort(at[inside], kind="stable")]
        flat[k], owner[k] = at[order], owner[k][order]
    common = np.zeros((len(low), len(high)), np.float32)
    for start in range(0, len(shared), COLUMNS):
        tables = []
        for k, side in enumerate((low, high)):
            i, j = np.searchsorted(flat[k], (start, start + COLUMNS))
            table = np.zeros((len(side), min(COLUMNS, len(shared) - start)), np.float32)
            table[owner[k][i:j], flat[k][i:j] - start] = 1
            tables.append(table)
        common += tables[0] @ tables[1].T
    near = common.astype(np.int64) * (p + q) >= (sizes[0][:, None] + sizes[1][None, :]) * p
    a, b = np.nonzero(near)
    b += len(low)
    label = np.arange(len(low) + len(high))
    link_a, link_b = [], []
    while len(a):  # each round every label that meets a lower one goes to the lowest of them, over one link
        x, y = label[a], label[b]
        different = x != y
        a, b, x, y = a[different], b[different], x[different], y[different]
        if not len(a):
            break
        to, of = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((to, of))
        first = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        link_a.append(a[first])
        link_b.append(b[first])
        new = np.arange(len(label))
        new[of[first]] = to[first]
        while not np.array_equal(further := new[new], new):
            new = further
        label = new[label]
    return np.concatenate([*link_a, np.zeros(0, np.int64)]), np.concatenate([*link_b, np.zeros(0, np.int64)])


def _per_pair(meet: DataFrame, members: DataFrame) -> DataFrame:
    """(low, high, side, ...) for the members (block, ...) of the blocks that meet, those of two blocks together in a task; side 1 only of different blocks."""
    rows = [meet.join(members.withColumnRenamed("block", side), side).withColumn("side", F.lit(k)) for k, side in enumerate(("low", "high"))]
    rows = rows[0].unionByName(rows[1].where("low <> high"))
    return rows.repartition("low", "high").sortWithinPartitions("low", "high", "side")


def alike(low: list[np.ndarray], high: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes of two blocks, given as n, fp, fp2 and root, may be near copies of one of the other block that no link has joined to them."""
    p, q = LIKE
    (n, fp, fp2, root), (bn, bfp, bfp2, broot) = [x[:, None] for x in low], [x[None, :] for x in high]
    least, bits = np.minimum(n, bn), np.bitwise_count(fp ^ bfp).astype(np.int16) + np.bitwise_count(fp2 ^ bfp2)
    good = (root != broot) & (least * q >= np.maximum(n, bn) * p) & ((least < FEW) | (bits <= BLOCK_BITS))
    return good.any(axis=1), good.any(axis=0)


def _candidates(placed: DataFrame, meet: DataFrame, known: DataFrame) -> DataFrame:
    """(low, high, side, node): of the blocks that meet, the nodes whose sets are to be compared. known: node, n, fp, fp2, root of all nodes."""
    columns = ["node", "n", "fp", "fp2", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []

        def chosen(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            low, high, side = (rows.column(c).to_numpy() for c in ("low", "high", "side"))
            starts = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            values = [rows.column(c).to_numpy() for c in columns]
            values[2:4] = (x.view(np.uint64) for x in values[2:4])
            for i, j in zip(starts, [*starts[1:], len(low)], strict=True):
                k = i + int(np.searchsorted(side[i:j], 1))
                own, other = [x[i:k] for x in values[1:]], [x[k:j] for x in values[1:]]
                a, b = alike(own, other if low[i] != high[i] else own)
                at = np.r_[i + np.flatnonzero(a), k + np.flatnonzero(b)] if low[i] != high[i] else i + np.flatnonzero(a)
                yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (low, high, side, values[0])], ["low", "high", "side", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*left, batch])
            low, high = (whole.column(c).to_numpy() for c in ("low", "high"))
            last = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[-1]  # the last two blocks may go on in the next batch
            if last:
                yield from chosen(whole.slice(0, last))
            left = whole.slice(last).to_batches()
        if left:
            yield from chosen(pa.Table.from_batches(left))

    rows = _per_pair(meet, cut(placed.join(known.select(*columns), "node")))
    return cut(rows.select("low", "high", "side", *columns).mapInArrow(run, "low long, high long, side int, node long"))


def _within_blocks(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join what near copies among the candidates of two blocks would join; a task holds their sets."""
    rows = candidates.join(sets, "node").select("low", "high", "side", "node", "hashes").repartition("low", "high").sortWithinPartitions("low", "high", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sides = None, ([], []), ([], [])

        def links() -> pa.RecordBatch:
            low, high = sides[0], sides[1] if now[0] != now[1] else sides[0]
            name = np.array([*nodes[0], *(nodes[1] if now[0] != now[1] else nodes[0])], np.int64)
            a, b = block_links(low, high)
            a, b = np.minimum(name[a], name[b]), np.maximum(name[a], name[b])
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        for batch in batches:
            lows, highs, which, names = (batch.column(c).to_pylist() for c in ("low", "high", "side", "node"))
            lists = batch.column("hashes")
            for i in range(batch.num_rows):
                if now != (lows[i], highs[i]):
                    if now:
                        yield links()
                    now, nodes, sides = (lows[i], highs[i]), ([], []), ([], [])
                nodes[which[i]].append(names[i])
                sides[which[i]].append(lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
        if now:
            yield links()

    return rows.mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, width: int, proposed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_sha256, node, n, fp, fp2) of every row, links (a, b) of nodes): links join what near copies would join.

    proposed gives links between fingerprints (fp), which are confirmed first. Then each bucket of nodes that share a
    part of their shingles compares its members with one of them, by a hash that is the same in all buckets, so that a
    group of near copies compares with few; and last, of what no link has joined by then, all pairs. Pairs are compared by size, then by fingerprint (NEAR_BITS), and those that are left are confirmed by their
    sets, no pair twice. Large buckets are compared in blocks instead, each two blocks once, whatever the buckets they share, first by fingerprint
    (BLOCK_BITS), then by the sets of those that are left.
    """
    rows = stored(_nodes(docs, width))
    nodes = cut(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.min(F.struct("doc_id", "text_sha256")).alias("row")))
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("one")))
    ends = proposed(prints.select("fp"))
    first = ends.join(prints.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b").select("x", "y")
    first = first.union(nodes.join(prints, "fp").select(F.col("one").alias("x"), F.col("node").alias("y"))).where("x <> y")
    first = cut(first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    sets = _sets_of(_ends(first).distinct(), docs, nodes, width)
    links, tried = cut(_confirmed(first, sets)), first
    removed(sets)
    buckets = stored(_buckets(docs, width))
    hot = hot_hashes(buckets, ["node"])
    p, q = LIKE
    for turn in range(STAR_ROUNDS + 1):
        roots = connected_components(links)
        candidates = None
        known = nodes.select("node", "n", "fp", "fp2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        done: list[DataFrame] = []
        open_ = stored(salted_join(buckets, known, ["node"], hot, ["key"]))
        counts = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node", "n", "fp", "fp2", "root")).alias("one"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
        counts = counts.where("low <> high").select("key", "one.node", "one.n", "one.fp", "one.fp2", "one.root", "members").withColumnsRenamed({"node": "b", "n": "bn", "fp": "bfp", "fp2": "bfp2", "root": "broot"})
        if turn < STAR_ROUNDS:
            pairs = salted_join(open_, counts, ["key"], hot_hashes(open_, ["key"]), ["node"])
        else:
            # a bucket of many members is split by hash in parts; each member meets part by part
            rest = salted_join(open_, counts.select("key", "members"), ["key"], hot_hashes(open_, ["key"]), ["node"])
            rest = stored(rest)
            done = [rest]
            if rest.where(F.col("members") > LARGE).take(1):
                placed, meet, whole = _placed(rest.select("key", "node", "n", "members"))
                candidates = _candidates(placed, meet, known)
                rest = stored(salted_join(rest, whole, ["key"], hot_hashes(rest, ["key"]), ["node"], "left_anti"))
                done.append(rest)
            rest = rest.withColumn("k", F.ceil(F.col("members") / PART)).drop("members")
            left = rest.withColumn("part", F.explode(F.expr("sequence(0L, k - 1)"))).drop("k")
            right = rest.select("key", F.pmod(F.xxhash64("node"), F.col("k")).alias("part"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("fp").alias("bfp"), F.col("fp2").alias("bfp2"), F.col("root").alias("broot"))
            pairs = left.join(right, ["key", "part"])
        close = F.expr(f"least(n, bn) * {q} >= greatest(n, bn) * {p} and (least(n, bn) < {FEW} or bit_count(fp ^ bfp) + bit_count(fp2 ^ bfp2) <= {NEAR_BITS})")
        pairs = pairs.where((F.col("root") != F.col("broot")) & close).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        removed(open_, *done)
        ends = _ends(pairs) if candidates is None else _ends(pairs).union(candidates.select("node"))
        sets = _sets_of(ends.distinct(), docs, nodes, width)
        # one after the other, so that the shuffles of both aren't on disk at once
        links, tried = cut(links.union(_confirmed(pairs, sets))), tried.union(pairs)
        if candidates is not None:
            links = cut(links.union(_within_blocks(candidates, sets)))
        removed(sets)
    removed(buckets)
    return rows, links
