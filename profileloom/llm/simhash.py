"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.llm.common import as_documents, cut, hot_hashes, salted_join
from profileloom.llm.components import connected_components
from profileloom.llm.jaccard import WIDTH, near_links
from profileloom.llm.shingles import majority_bits, shingle_hashes

BITS = 64
#: Fingerprints of a bucket that one task compares with each other; larger buckets are compared part by part.
PART = 1024
#: Pairs of (64 fingerprints, one fingerprint) that are compared at a time.
AT_ONCE = 1 << 16
#: Texts that a worker unpacks at a time.
SLICE = 500


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's text as a signed long; 0 for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                digests = [shingle_hashes(t, width) for t in part.column("text").to_pylist()]
                counts = np.array([len(d) // 8 for d in digests], np.int64)
                hashes = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(majority_bits(hashes, counts).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _band_keys(fp: Column, radius: int) -> Column:
    """Keys such that fingerprints within the radius share one: the bits fall in radius+2 bands, of which two stay equal."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]
    bands = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    pairs = list(combinations(range(n), 2))
    top = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    return F.array(*(F.lit(i << (2 * top)).bitwiseOR(F.shiftleft(bands[a], top)).bitwiseOR(bands[b]) for i, (a, b) in enumerate(pairs)))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """The 64 bit planes of a multiple of 64 fingerprints: bit j of planes[b, w] is bit b of fingerprint 64*w + j."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.reshape(-1, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def within_radius(planes: np.ndarray, words: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For each pair (word of planes, fingerprint), the lanes at most `radius` bits apart, as bits of a word.

    Distances of 64 lanes are counted at once in bitwise counters with carry-save addition; the last counter sticks.
    Every few planes, pairs whose lanes are all beyond the radius are abandoned.
    """
    out, at = np.zeros(len(words), np.uint64), np.arange(len(words))
    size = (radius + 1).bit_length()
    # counters start so that passing the radius carries out of the highest one
    start = (1 << size) - 1 - radius
    counters = [np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(size)]
    beyond = np.zeros(len(words), np.uint64)
    for b in range(BITS):
        carry = planes[b, words] ^ (np.uint64(0) - ((fps >> np.uint64(b)) & np.uint64(1)))
        for k in range(size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        beyond |= carry
        if b % 8 == 7 and b < BITS - 1:
            alive = np.flatnonzero(~beyond)
            if len(alive) < 0.75 * len(at):
                at, words, fps, beyond = at[alive], words[alive], fps[alive], beyond[alive]
                counters = [c[alive] for c in counters]
                if not len(at):
                    return out
    out[at] = ~beyond
    return out


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowers labels until linked places have one label."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, labels):
            return labels
        labels = new


def _linked(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links (pairs of fingerprints) that joins what links within buckets join; rows are sorted by bucket."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    many = sizes > 1
    starts, sizes = starts[many], sizes[many]
    if not len(starts):
        return fps[:0], fps[:0]
    # each bucket fills whole words of 64 lanes; spare lanes are marked
    words_of = -(-sizes // 64)
    word_start = np.cumsum(words_of) - words_of
    member = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)])
    offset = np.concatenate([np.arange(n) for n in sizes])
    lane = np.repeat(word_start * 64, sizes) + offset
    total = int(words_of.sum())
    row_of_lane = np.full(total * 64, -1, np.int64)
    row_of_lane[lane] = member
    padded = np.zeros(total * 64, np.uint64)
    padded[lane] = fps[member].view(np.uint64)
    planes = bit_planes(padded)
    labels = np.arange(len(bucket))
    # the pairs to compare: each member with the words of its bucket from its own on
    own = lane // 64
    last = np.repeat(word_start + words_of, sizes)
    pairs_of = last - own
    ends = np.cumsum(pairs_of)
    step = 0
    while step < len(member):
        base = ends[step] - pairs_of[step]
        stop = max(step + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        n = pairs_of[step:stop]
        query = np.repeat(np.arange(step, stop), n)
        word = np.repeat(own[step:stop], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hits = within_radius(planes, word, fps[member[query]].view(np.uint64), radius)
        some = np.flatnonzero(hits)
        lanes = np.unpackbits(hits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(lanes)
        other = row_of_lane[word[some[i]] * 64 + j]
        this = member[query[some[i]]]
        good = (other >= 0) & (other != this)
        if good.any():
            labels = _forest(labels, this[good], other[good])
        step = stop
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return fps[moved], fps[labels[moved]]


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that join what all pairs of distinct fingerprints at most `radius` bits apart would join.

    Fingerprints within the radius agree on two of radius+2 bands, so they meet in the bucket of one pair of bands;
    no pair is missed. Buckets of over PART fingerprints are split by hash into parts that meet part by part, so
    that no task holds a whole large bucket. A task gives a spanning forest of its links, not all pairs.
    """
    keyed = fps.select("fp", F.explode(_band_keys(F.col("fp"), radius)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # where a bucket is split in k parts, part p meets the parts above it: rows go to one group for each other part
    parts = F.ceil(F.col("n") / PART).cast("int")
    rows = salted_join(keyed, counts, ["key"], hot_hashes(keyed, ["key"]), ["fp"]).withColumn("k", parts).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.expr("sequence(0, k - 1)")))
    rows = rows.select("fp", "key", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            kept.append(batch)
            whole = pd.concat(kept, ignore_index=True)
            change = (whole[["key", "low", "high"]] != whole[["key", "low", "high"]].shift()).any(axis=1).to_numpy()
            last = np.flatnonzero(change)[-1]  # the last bucket may go on in the next batch
            if last and len(whole) >= 4096:
                a, b = _linked(np.cumsum(change[:last]), whole.fp.to_numpy()[:last], radius)
                yield pd.DataFrame({"a": a, "b": b})
                kept = [whole[last:]]
            else:
                kept = [whole]
        if kept:
            whole = pd.concat(kept, ignore_index=True)
            change = (whole[["key", "low", "high"]] != whole[["key", "low", "high"]].shift()).any(axis=1).to_numpy()
            a, b = _linked(np.cumsum(change), whole.fp.to_numpy(), radius)
            yield pd.DataFrame({"a": a, "b": b})

    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return rows.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of `docs`.

    component_id is the smallest doc_id reachable over links between fingerprints at most `radius` bits apart. Texts
    with fewer words than a shingle are hashed whole; null texts and those without words have fingerprint zero, which
    is linked like any other. Null ids are grouped too but never name a group, unless it has no other (then null).
    Repeated rows are repeated in the result; an empty table gives no rows; columns other than doc_id and text aren't read.
    """
    rows = cut(fingerprints(as_documents(docs), width))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(fingerprint_links(groups.select("fp"), radius)).withColumnRenamed("node", "fp")
    groups = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = cut(groups)
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_join(groups, named, ["root"], hot_hashes(groups, ["root"]), ["fp"]).select("fp", "component_id")
    out = salted_join(rows, named, ["fp"], hot_hashes(groups, ["fp"], F.col("n")), ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_near_copies(docs: DataFrame, width: int = WIDTH, radius: int = 3) -> DataFrame:
    """(doc_id, text_sha256) of one row of each group of near copies: the smallest doc_id, null only where no row has one.

    Near copies are texts whose sets of word shingles have a Jaccard similarity of 4/5 or more. Texts with fingerprints
    at most `radius` bits apart are found first, by bit-sliced comparison, and linked if their shingles say so.
    Fingerprints of near copies can differ in more bits, so the exact check goes on to those (near_links): it looks at all
    texts that share a part of their shingles, which near copies always do, and that are at most NEAR_BITS bits apart.
    A-Z are lower-cased, words parted by ASCII white space, texts of fewer words than a shingle are one; texts without words
    (null ones, too) are near copies of each other. text_sha256 is as in exact_duplicates. Repeated rows are one; shingles
    and sets of them are told apart by 64-bit hashes. An empty table gives no rows; columns other than doc_id and
    text aren't read.
    """
    rows, links = near_links(docs, width, lambda fps: fingerprint_links(fps, radius))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_sha256")).alias("first")
    least = rows.groupBy("node").agg(first)
    least = least.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return least.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_sha256")
