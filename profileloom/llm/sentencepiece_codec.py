"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass."""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from profileloom.llm.common import Remembered, as_documents, on_worker

SPACE = "▁"
#: Distinct segments whose ids a worker keeps.
KEPT_SEGMENTS = 120_000
#: Texts that a worker unpacks at a time.
SLICE = 500
_NEVER = float("inf")


class Vocabulary(NamedTuple):
    """Pieces and scores by id, ids of the byte pieces, and how the model was made."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]  # by byte; empty without byte fallback
    unknown: int
    bpe: bool


def read_vocabulary(path: str, bpe: bool = True) -> Vocabulary:
    """The vocabulary of a model file, read on the driver. Models whose text normalization does more than mark spaces are refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    probe = "ÅＡ①  x́ "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("the model normalizes texts")
    pieces = [model.id_to_piece(i) for i in range(n)]
    is_byte = [bool(re.fullmatch("<0x[0-9A-F]{2}>", p)) and model.is_byte(i) for i, p in enumerate(pieces)]
    normal = [not (b or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i, b in enumerate(is_byte)]
    byte_ids = [i for _, i in sorted((int(pieces[i][3:5], 16), i) for i in range(n) if is_byte[i])]
    return Vocabulary(pieces, [model.get_score(i) for i in range(n)], normal, byte_ids, model.unk_id(), bpe)


class Codec:
    """Encodes and decodes as the vocabulary's model does.

    The automaton gives, at each place of a segment, all pieces that end there. Each is a step from the place where it
    starts, and the best step is kept. For unigram models that is the one with the greatest sum of scores. In BPE models
    merges compete by rank, and every prefix has exactly one encoding: a piece may follow the best encoding of the text
    before it only if no merge across the seam would have come first, which the ranks on both sides of the seam tell.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.times: dict[str, float] = {}
        self.seams: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if not v.bpe or len(p) == 1 or self._whole(p):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.known = {p for p in self.ids if len(p) == 1}
        # texts fall apart where no piece can join what is left and right of a place
        letters = "".join(re.escape(c) for c in sorted(self.known) if c.isalpha())
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.segment = re.compile(".+", re.S)
        elif not letters or any(x.isalpha() and not y.isalpha() for p in self.ids for x, y in zip(p, p[1:], strict=False)):
            self.segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.segment = re.compile(f"{SPACE}*[^{letters}{SPACE}]*[{letters}]+|{SPACE}*[^{letters}{SPACE}]+|{SPACE}+")
        self.bytes = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.bytes[i] = bytes([b])
        for i, normal in enumerate(v.normal):
            if not normal and i not in set(v.byte_ids):
                self.bytes[i] = b" \xe2\x81\x87 " if i == v.unknown else b""
        self.kind = np.dtype(np.uint16 if len(v.pieces) <= 1 << 16 else np.int32)
        self.kept = Remembered(self._packed, KEPT_SEGMENTS)

    def _rank(self, piece: str) -> float:
        i = self.ids.get(piece)
        return _NEVER if i is None else -self.v.scores[i]

    def merge(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """BPE by its definition: merge the best neighbours, leftmost first among equals. Also the parts of each merged piece."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        left, right, made = list(range(-1, n - 1)), list(range(1, n + 1)), {}
        heap = [(self._rank(a + b), k, a, b) for k, (a, b) in enumerate(zip(text, text[1:], strict=False)) if a + b in self.ids]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k]
            if symbols[k] != a or j >= n or symbols[j] != b:
                continue
            made[a + b] = (a, b)
            symbols[k], symbols[j] = a + b, None
            right[k] = right[j]
            if right[k] < n:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y < n and symbols[x] + symbols[y] in self.ids:
                    heapq.heappush(heap, (self._rank(symbols[x] + symbols[y]), x, symbols[x], symbols[y]))
        return [s for s in symbols if s is not None], made

    def _whole(self, piece: str) -> bool:
        """Whether the piece encodes as itself; keeps its last merge."""
        if piece not in self.parts:
            out, made = self.merge(piece)
            self.parts[piece] = made[piece] if out == [piece] and len(piece) > 1 else None
        return len(piece) == 1 or self.parts[piece] is not None

    def _time(self, piece: str) -> float:
        """When a piece is made: its merge's rank, but not before its parts."""
        if len(piece) == 1:
            return -_NEVER
        if piece not in self.times:
            self._whole(piece)
            a, b = self.parts.get(piece) or self.merge(piece)[1].get(piece, (piece[:1], piece[1:]))
            self.times[piece] = max(self._rank(piece), self._time(a), self._time(b))
        return self.times[piece]

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at one end of the piece (0: left, 1: right) while it is made, from its character on, each with its time."""
        key = piece, side
        if key not in self.spines:
            out = [(piece, self._time(piece))]
            while len(out[-1][0]) > 1:
                self._whole(out[-1][0])
                parts = self.parts[out[-1][0]] or self.merge(out[-1][0])[1][out[-1][0]]
                out.append((parts[side], self._time(parts[side])))
            self.spines[key] = out[::-1]
        return self.spines[key]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether piece b after piece a stays so: no merge across the seam comes before those that make a and b."""
        key = a, b
        if (known := self.seams.get(key)) is not None:
            return known
        x, y, i, j, good = self._spine(a, 1), self._spine(b, 0), 0, 0, True
        while True:
            on_left = x[i + 1][1] if i + 1 < len(x) else _NEVER
            on_right = y[j + 1][1] if j + 1 < len(y) else _NEVER
            across = max(self._rank(x[i][0] + y[j][0]), x[i][1], y[j][1])
            if across < on_left and across <= on_right:
                good = False
                break
            if on_left == on_right == _NEVER:
                break
            if on_left <= on_right:
                i += 1
            else:
                j += 1
        if len(self.seams) >= 200_000:
            self.seams.clear()
        self.seams[key] = good
        return good

    def _unknown(self, char: str) -> tuple[int, ...]:
        v = self.v
        return tuple(v.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")) if v.byte_ids else (v.unknown,)

    def encode_segment(self, text: str) -> tuple[int, ...]:
        """Ids of a segment. Characters that are no piece are joined by none, so the known runs between them stand alone."""
        if self.known.issuperset(text):
            return self._encode_known(text)
        out: list[int] = []
        run = 0
        for k, c in enumerate(text):
            if c not in self.known:
                out += (*(self._encode_known(text[run:k]) if run < k else ()), *self._unknown(c))
                run = k + 1
        return (*out, *(self._encode_known(text[run:]) if run < len(text) else ()))

    def _encode_known(self, text: str) -> tuple[int, ...]:
        ids, n = self.ids, len(text)
        if self.v.bpe and SPACE * 2 in text:  # runs of spaces are pieces of equal rank, which only the place tells apart
            return tuple(ids[s] for s in self.merge(text)[0])
        last: list[str | None] = [None] * (n + 1)  # the last piece of the best encoding up to a place
        if self.v.bpe:
            seams = self.seams
            for at, piece in self.automaton.iter(text):
                end = at + 1
                if last[end] is None:
                    start = end - len(piece)
                    if start:
                        before = last[start]
                        good = before is not None and ((known := seams.get((before, piece))) or known is None and self.may_follow(before, piece))
                        if not good:
                            continue
                    last[end] = piece
        else:
            scores, best = self.v.scores, [0.0] + [-_NEVER] * n
            for at, piece in self.automaton.iter(text):
                score = best[at + 1 - len(piece)] + scores[ids[piece]]
                if score > best[at + 1]:
                    best[at + 1], last[at + 1] = score, piece
        out, at = [], n
        while at > 0:
            if last[at] is None:  # ranks that contradict each other: by definition then
                return tuple(ids[s] for s in self.merge(text)[0])
            out.append(ids[last[at]])
            at -= len(last[at])
        return tuple(reversed(out))

    def _packed(self, text: str) -> bytes:
        """Ids of a segment in as few bytes as the vocabulary allows, which is how a worker keeps them."""
        return np.array(self.encode_segment(text), self.kind).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = SPACE + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.kept.__getitem__, self.segment.findall(text))), self.kind).astype(np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class SentencePiece:
    """Encodes and decodes columns of DataFrames. Only the model's vocabulary, read on the driver, goes to the executors."""

    def __init__(self, spark: SparkSession, model_path: str, bpe: bool = True):
        self.shared, self.name = spark.sparkContext.broadcast(read_vocabulary(model_path, bpe)), f"{model_path}:{uuid.uuid4().hex}"

    def _with_columns(self, df: DataFrame, source: str, types: list[tuple[str, DataType, pa.DataType]], make: Callable[[Codec, list], list[list]], drop: bool = False) -> DataFrame:
        """df with columns (name, type, Arrow type) that `make` gives for slices of a column; the other columns pass as they are.

        With `drop` the source column isn't sent back. A worker holds one batch at a time, none while it waits for the next.
        """
        shared, name, at = self.shared, self.name, df.columns.index(source)
        passed = [k for k in range(len(df.columns)) if k != at or not drop]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = on_worker(name, lambda: Codec(shared.value))
            for batch in batches:
                for k in range(0, batch.num_rows, SLICE):
                    part = batch.slice(k, SLICE)
                    made = make(codec, part.column(at).to_pylist())
                    new = [pa.array(values, kind) for values, (_, _, kind) in zip(made, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *new], [*(part.schema.names[c] for c in passed), *(t[0] for t in types)])
                    del part, made, new
                del batch

        schema = StructType([df.schema.fields[c] for c in passed])
        for n, kind, _ in types:
            schema = schema.add(n, kind)
        return df.mapInArrow(run, schema)

    def encode(self, df: DataFrame, text: str, ids: str) -> DataFrame:
        return self._with_columns(df, text, [(ids, ArrayType(IntegerType()), pa.list_(pa.int32()))], lambda codec, texts: [[codec.encode(t or "") for t in texts]])

    def decode(self, df: DataFrame, ids: str, text: str) -> DataFrame:
        return self._with_columns(df, ids, [(text, StringType(), pa.string())], lambda codec, rows: [[codec.decode(r or ()) for r in rows]])

    def round_trip(self, df: DataFrame, text: str, ids: str, decoded_sha256: str) -> DataFrame:
        """encode() and decode() in one pass, without the text; of the decoded text its SHA-256 is returned."""

        def make(codec: Codec, texts: list) -> list[list]:
            encoded = [codec.encode(t or "") for t in texts]
            return [encoded, [hashlib.sha256(codec.decode(e).encode("utf-8", "replace")).hexdigest() for e in encoded]]

        return self._with_columns(df, text, [(ids, ArrayType(IntegerType()), pa.list_(pa.int32())), (decoded_sha256, StringType(), pa.string())], make, drop=True)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 (of the text that the ids decode to) for every row of `docs`.

    Null text counts as empty and has no ids. A text decodes to itself, but for the mark U+2581, which comes back as a
    space. Null ids and repeated rows are encoded as they are; an empty table gives no rows; columns other than doc_id
    and text aren't read. Nothing is shuffled.
    """
    rows = SentencePiece(docs.sparkSession, model_path).round_trip(as_documents(docs), "text", "ids", "decoded_sha256")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")
