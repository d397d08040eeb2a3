"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.llm.common import on_worker, text_or_empty

#: Bounds of the sample a language is learned from: documents, code points of each, and letters and spaces of the running text in all.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TEXT = 200, 20_000, 40_000
#: Languages that can be learned; with more, learning fails, since each has an automaton on every worker.
LANGUAGES = 100
#: A text is parsed in pieces of so many letters and spaces, which are cut at a space where there is one.
PIECE = 4096
#: Texts that a worker unpacks at a time, and letters that it parses at a time.
SLICE, AT_ONCE = 500, 4_000_000
_CODE_POINTS = 0x110000


def running_text(text: str) -> str:
    """The words of a text, lower-cased: runs of letters (Unicode category L), parted by one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """All substrings of a text: walking `next_of` from state 0 follows the longest match."""

    def __init__(self, text: str):
        self.next_of: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            state = len(length)
            self.next_of.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next_of[p]:
                self.next_of[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next_of[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    clone = len(length)
                    self.next_of.append(dict(self.next_of[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next_of[p].get(c) == q:
                        self.next_of[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state

    def steps(self, alphabet: str) -> np.ndarray:
        """steps[k * states + state]: what the k-th code point of the alphabet (0: any other) does in the state.

        The state that follows, twice, and 1 more if a phrase begins: where no match goes on, the next one starts
        with this code point. One that the text never has is a phrase of its own, after which the state is 0.
        """
        n = len(self.next_of)
        table = np.zeros((len(alphabet) + 1, n), np.int32)
        table[0] = 1
        for k, c in enumerate(alphabet, 1):
            table[k] = 2 * self.next_of[0].get(c, 0) + 1
        place = {c: k for k, c in enumerate(alphabet, 1)}
        for state, following in enumerate(self.next_of[1:], 1):
            for c, to in following.items():
                table[place[c], state] = 2 * to
        return table.ravel()


class LanguageModel:
    """Suffix automata by language, from running texts."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        alphabet = "".join(sorted(set("".join(texts.values())) | {" "}))
        automata = [SuffixAutomaton(texts[k]) for k in self.languages]
        self.states = [len(a.next_of) for a in automata]
        self.steps = [a.steps(alphabet) for a in automata]
        self.bits = [math.log2(max(2, len(texts[k]))) for k in self.languages]
        # classes of code points: 0 for what isn't a letter, 1 for letters that no text has, then the alphabet
        self.classes = np.array([c.isalpha() for c in map(chr, range(_CODE_POINTS))], np.uint16)
        for k, c in enumerate(alphabet):
            self.classes[ord(c)] = k + 2 if c != " " else 0
        self.space = alphabet.index(" ") + 1

    def symbols(self, text: str) -> np.ndarray:
        """Places in the alphabet of the text's words, each with a space before and after; empty without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        kinds = self.classes[codes]
        letters = kinds > 0
        if not letters.any():
            return np.zeros(0, np.uint16)
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # one space after each word
        kinds = kinds[keep]
        out = np.where(kinds > 0, kinds - 1, self.space)
        return np.concatenate([[self.space], out, [self.space]] if kinds[-1] else [[self.space], out])

    def phrases(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Phrases of the greedy parse of each text into longest matches, by language; many pieces go side by side."""
        pieces, owner = [], []
        for k, symbols in enumerate(texts):
            at = 0
            while at < len(symbols):
                end = min(len(symbols), at + PIECE)
                if end < len(symbols):
                    spaces = np.flatnonzero(symbols[at + 1 : end] == self.space)
                    end = at + 2 + int(spaces[-1]) if len(spaces) else end
                pieces.append(symbols[at:end])
                owner.append(k)
                at = end
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        if not pieces:
            return counts
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        sizes = np.array([len(pieces[i]) for i in order])
        ends = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # pieces that have a j-th symbol
        starts = np.concatenate([[0], np.cumsum(ends)[:-1]])
        lines = np.empty(int(sizes.sum()), np.int32)
        for rank, i in enumerate(order):  # symbol by symbol, so that each step reads one run
            lines[starts[: len(pieces[i])] + rank] = pieces[i]
        owners = np.array(owner)[order]
        for k, (steps, states) in enumerate(zip(self.steps, self.states, strict=True)):
            state, begun = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int64)
            for start, n in zip(starts, ends, strict=True):
                done = steps[lines[start : start + n] * states + state[:n]]
                begun[:n] += done & 1
                state[:n] = done >> 1
            counts[k] = np.bincount(owners, begun, len(texts)).astype(np.int64)
        return counts

    def predict(self, texts: Sequence[str]) -> Iterator[tuple[str, float]]:
        """The language with the lowest cross-parsing entropy, ties by name, and its lead over the second as a share of the latter's.

        The entropy is the phrases of a code point, times the bits that name a place in the language's text.
        """
        symbols, at = [self.symbols(t) for t in texts], 0
        while at < len(symbols):
            end, held = at, 0
            while end < len(symbols) and (end == at or held + len(symbols[end]) <= AT_ONCE):
                held, end = held + len(symbols[end]), end + 1
            counts = self.phrases(symbols[at:end])
            for k in range(at, end):
                n = len(symbols[k])
                if not n or not self.languages:
                    yield "und", 0.0
                    continue
                ranked = sorted((int(c) * b / n, name) for c, b, name in zip(counts[:, k - at], self.bits, self.languages, strict=True))
                yield ranked[0][1], 1.0 if len(ranked) == 1 else (ranked[1][0] - ranked[0][0]) / ranked[1][0]
            at = end


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, str]:
    """Running text of a bounded sample of each language, from rows that aren't held out and have a language.

    The sample has the SAMPLE_DOCS documents of a language with the least hashes of their ids. A filter on the hash by
    the language's number of rows comes first, and ranking keeps SAMPLE_DOCS rows of a language in each task, so no
    task gets a whole language. At most SAMPLE_CHARS code points of a document reach the driver, and each document
    gives an equal part of the SAMPLE_TEXT code points, whole words, as far as it has them; what is missing comes from the rests.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
    ids = known.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang")).withColumn("h", F.xxhash64("id"))
    rows = ids.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages to learn")
    share = F.lit(0.0)
    for r in rows:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, 4 * SAMPLE_DOCS / r.n))).otherwise(share)
    few = ids.where((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) <= share)
    few = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).where(F.col("k") <= SAMPLE_DOCS)
    few = few.select("id", F.col("lang").alias("of"), "h").distinct()
    texts = known.join(F.broadcast(few), (F.col("doc_id").cast("long") == F.col("id")) & (F.col("lang").cast("string") == F.col("of")))
    sample = texts.select("of", "h", F.substring(text_or_empty("text"), 1, SAMPLE_CHARS).alias("text")).distinct().collect()
    out: dict[str, str] = {}
    for lang in sorted({r.of for r in sample}):
        words = [running_text(r.text).split() for r in sorted((r for r in sample if r.of == lang), key=lambda r: (r.h, r.text))]
        taken, size, part = [[] for _ in words], 0, max(1, SAMPLE_TEXT // max(1, len(words)))
        while size < SAMPLE_TEXT and any(words):
            for k, rest in enumerate(words):
                n = length = 0
                while n < len(rest) and length < part and size + length < SAMPLE_TEXT:
                    length, n = length + len(rest[n]) + 1, n + 1
                taken[k] += rest[:n]
                words[k], size = rest[n:], size + length
        if size:
            out[lang] = f" {' '.join(' '.join(t) for t in taken if t)} "
    return out


def _predictions(name: str, sample: dict[str, str], texts: pa.Array) -> Iterator[tuple[str, float]]:
    """Predictions for a column of texts, of which few are Python objects at a time."""
    model = on_worker(name, lambda: LanguageModel(sample))
    for at in range(0, len(texts), SLICE):
        yield from model.predict([t or "" for t in texts.slice(at, SLICE).to_pylist()])


def identify_languages(docs: DataFrame, model: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of `docs`, from the whole text; `model` is learned from docs if not given.

    A text's words are parsed, across spaces, into the fewest longest matches with each language's sample. The phrases
    are normalised by the text's length and the sample's (cross-parsing entropy); the language with the least is predicted,
    with its lead over the second as score, ties by name. Texts of over PIECE letters are parsed piece by piece, all of them. Null texts and
    those without letters get und and score 0, and so do all if nothing was learned. Null ids and repeated rows are
    judged as they are; an empty table gives no rows; columns other than doc_id, text and (to learn) lang aren't read.
    The sample, not the automata, goes to the executors.
    """
    sample, name = docs.sparkSession.sparkContext.broadcast(learn(docs) if model is None else model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = list(_predictions(name, sample.value, batch.column("text")))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_known_language(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language can't be told (und), and with the predicted language as lang; other columns stay.

    Null and empty texts and those without letters go. Null ids are judged like others; equal texts get equal
    languages; repeated rows stay repeated; an empty table gives no rows.
    """
    sample, name = docs.sparkSession.sparkContext.broadcast(learn(docs)), uuid.uuid4().hex
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.array([s[0] for s in _predictions(name, sample.value, batch.column(at))], pa.string())
            known = pa.array([s != "und" for s in said.to_pylist()], pa.bool_())
            yield batch.set_column(lang, batch.schema.names[lang], said).filter(known)

    return docs.mapInArrow(run, docs.schema)
