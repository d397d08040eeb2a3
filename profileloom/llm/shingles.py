"""Word shingles of texts, as hashes, and fingerprints of them."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash

SEED = 42
_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int) -> bytes:
    """XXH64 digests, one after the other, of the text's word shingles; A-Z lower-cased, words parted by ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    line = b" ".join(words)
    if not words:
        return b""
    if len(words) <= width:
        return xxhash.xxh64_digest(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, digest = [0, *ends], xxhash.xxh64_digest
    return b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)])


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of `counts` hashes: bit set if it is in over half of the run's hashes.

    Each bit of a byte is summed for all eight bytes of a word at once, over pieces of up to 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts)
    begins = ends - counts
    cuts = np.concatenate([np.arange(begins[i], ends[i], 255) for i in full])
    owner = np.repeat(np.arange(len(full)), -(-counts[full] // 255))
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _BYTES, cuts)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (ones * 2 > counts[full][:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(bits).view(np.uint64).ravel() << np.uint64(k)
    return out
