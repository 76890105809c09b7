"""Language-model scores: each word is the sum over all its segmentations into pieces of an existing vocabulary.

The pieces start from the vocabulary's own scores and get their probabilities from the training words by expected counts. A word's
lattice holds every piece that matches somewhere in it, and one more arc over the whole word for words seen in training; the forward
recursion adds all paths in log space. A text's log probability is the sum over its words and one end.

Word statistics are a table, never a broadcast. Texts are read once and become chunks: a list of distinct words and, for each text,
which of them it holds how often. Each chunk asks for each of its words once, so a frequent word costs a row per chunk and not one
per occurrence.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm.common import Scratch

END = b"\n"  # white space: no word equals it
START_OF_WORD = "▁"
BYTES = [f"<0x{b:02X}>" for b in range(256)]
STEP = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


def held_out(key: str, folds: int = 10) -> Column:
    """Rows whose crc32 of the key as text is divisible by ``folds``; a null key counts as crc32 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(True))


def existing_scores(model: str) -> dict[str, float]:
    """Natural-log weights from the vocabulary's scores: a BPE file's score is minus the piece's merge rank, taken as Zipf's rank."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    raw = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))}
    ranked = min(raw.values()) < -100
    weight = {p: 1.0 / (2.0 - s) if ranked else math.exp(s) for p, s in raw.items() if p not in BYTES}
    weight |= {b: min(weight.values()) for b in BYTES}  # every byte stays possible
    total = sum(weight.values())
    return {p: math.log(w / total) for p, w in weight.items()}


class Lattice:
    def __init__(self, log_p: dict[str, float]) -> None:
        self.log_p, self.longest = log_p, max(map(len, log_p))
        self.byte = [log_p[b] for b in BYTES]

    def arcs(self, word: str) -> list[list[tuple[int, float, tuple[str, ...]]]]:
        """For each place the (start, log probability, pieces) of what can end there; a character without a piece is its bytes."""
        text, get = START_OF_WORD + word, self.log_p.get
        n, out = len(text), [[] for _ in range(len(text) + 1)]
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                p = get(text[i:j])
                if p is not None:
                    out[j].append((i, p, (text[i:j],)))
                    single |= j == i + 1
            if not single:
                raw = text[i].encode("utf-8", "surrogatepass")
                out[i + 1].append((i, sum(self.byte[b] for b in raw), tuple(BYTES[b] for b in raw)))
        return out

    @staticmethod
    def add(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum([math.exp(v - top) for v in values])) if len(values) > 1 else top

    def forward(self, arcs: list) -> list[float]:
        f = [0.0]
        for ends in arcs[1:]:
            f.append(self.add([f[i] + p for i, p, _ in ends]))
        return f

    def log_marginal(self, word: str) -> float:
        """Natural log of the probability of the word over all segmentations."""
        return self.forward(self.arcs(word))[-1]

    def expected(self, word: str, count: float, into: dict[str, float]) -> None:
        """Adds ``count`` times the expected uses of each piece."""
        arcs = self.arcs(word)
        f, n = self.forward(arcs), len(arcs) - 1
        back: list[list[float]] = [[] for _ in range(n + 1)]
        back[n] = [0.0]
        total = f[n]
        for j in range(n, 0, -1):
            b = self.add(back[j]) if back[j] else None
            if b is None:
                continue
            for i, p, pieces in arcs[j]:
                back[i].append(b + p)
                share = count * math.exp(f[i] + p + b - total)
                for piece in pieces:
                    into[piece] = into.get(piece, 0.0) + share


class BatchLattice:
    """``Lattice`` for many words at once: words of equal length are one matrix, and each arc place is one array operation."""

    def __init__(self, log_p: dict[str, float], most: int = 64) -> None:
        self.one, self.most = Lattice(log_p), most
        self.pieces = [p for p in log_p if p not in BYTES]
        self.longest = max(map(len, self.pieces))
        keys = np.array([self.hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.which = keys[order], order
        self.p = np.array([log_p[p] for p in self.pieces])[order]
        self.single = {ord(p) for p in self.pieces if len(p) == 1}

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * STEP + ord(c) + 1) & (2**64 - 1)
        return h

    def _arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, place in the sorted pieces or -1, log probability) in order of the end."""
        n = codes.shape[1]
        hashes = np.zeros((n, len(codes)), np.uint64)  # hashes[i]: of what starts at i and ends at j
        for j in range(1, n + 1):
            low = max(0, j - self.longest)
            hashes[low:j] = hashes[low:j] * np.uint64(STEP) + (codes[:, j - 1] + 1).astype(np.uint64)
            for i in range(low, j):
                at = np.minimum(np.searchsorted(self.keys, hashes[i]), len(self.keys) - 1)
                hit = self.keys[at] == hashes[i]
                p = np.where(hit, self.p[at], -np.inf)
                if i == j - 1 and not hit.all():
                    lone = {c: self._bytes(chr(c)) for c in np.unique(codes[~hit, i]).tolist()}
                    p[~hit] = [lone[c] for c in codes[~hit, i].tolist()]
                if hit.any() or i == j - 1:
                    yield i, j, np.where(hit, at, -1), p

    def _bytes(self, char: str) -> float:
        return sum(self.one.byte[b] for b in char.encode("utf-8", "surrogatepass"))

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size[size <= self.most]).tolist():
            at = np.flatnonzero(size == n)
            codes = np.frombuffer("".join(START_OF_WORD + words[k] for k in at).encode("utf-32-le", "surrogatepass"), "<u4")
            yield at, codes.reshape(len(at), n + 1).astype(np.int64)

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        f = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        f[0] = 0
        arcs = []
        for i, j, at, p in self._arcs(codes):
            f[j] = np.logaddexp(f[j], f[i] + p)
            arcs.append((i, j, at, p))
        return f, arcs

    def log_marginals(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for at, codes in self._groups(words):
            out[at] = self._forward(codes)[0][-1]
        for k, w in enumerate(words):
            if len(w) > self.most:
                out[k] = self.one.log_marginal(w)
        return out

    def expected(self, words: list[str], counts: np.ndarray, into: np.ndarray, rest: dict[str, float]) -> None:
        """Adds the expected uses of each piece (by its place in ``pieces``); those of bytes and of pieces in very long words go to ``rest``."""
        for at, codes in self._groups(words):
            f, arcs = self._forward(codes)
            back = np.full_like(f, -np.inf)
            back[-1] = 0
            for i, j, which, p in reversed(arcs):
                back[i] = np.logaddexp(back[i], back[j] + p)
                share = counts[at] * np.exp(f[i] + p + back[j] - f[-1])
                hit = which >= 0
                into += np.bincount(self.which[which[hit]], share[hit], len(into))
                if i == j - 1:
                    for k in np.flatnonzero(~hit & (share > 0)).tolist():
                        for b in chr(codes[k, i]).encode("utf-8", "surrogatepass"):
                            rest[BYTES[b]] = rest.get(BYTES[b], 0.0) + share[k]
        for k, w in enumerate(words):
            if len(w) > self.most:
                self.one.expected(w, float(counts[k]), rest)


def _text(word: bytes) -> str:
    return "" if word == END else word.decode("utf-8", "surrogatepass")


CHUNK = "chunk long, words array<binary>, train array<long>, doc_ids array<long>, held array<boolean>, sizes array<long>, widths array<long>, which binary, times binary"

ARROW_CHUNK = pa.schema({"chunk": pa.int64(), "words": pa.list_(pa.binary()), "train": pa.list_(pa.int64()), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "widths": pa.list_(pa.int64()), "which": pa.binary(), "times": pa.binary()})


def narrow(numbers: array) -> bytes:
    """Unsigned numbers of the smallest width that holds them all."""
    a = np.asarray(numbers)
    return a.astype(np.min_scalar_type(int(a.max(initial=0)))).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}")


def chunked(docs: DataFrame, chunk_rows: int = 20_000, chunk_bytes: int = 32_000_000) -> DataFrame:
    """Texts (doc_id, text, held_out) as chunks of up to so many rows and about so many bytes: distinct words with their counts in training texts, and each text's words by place and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = ARROW_CHUNK
        place: dict[bytes, int] = {}
        train: list[int] = []
        ids, held, sizes, widths, which, times, load = [], [], [], [], array("i"), array("i"), 0

        def flush() -> pa.RecordBatch:
            row = [number, list(place), train, ids, held, sizes, widths, narrow(which), narrow(times)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            for doc, text, out in zip(b.column(0), b.column(1), b.column(2), strict=True):
                found = Counter(words(text.as_py()))
                size = sum(found.values()) + 1
                found[END] = 1
                for w, n in found.items():
                    at = place.setdefault(w, len(place))
                    if at == len(train):
                        train.append(0)
                    if not out.as_py():
                        train[at] += n
                    which.append(at)
                    times.append(n)
                ids.append(doc.as_py())
                held.append(out.as_py())
                sizes.append(size)
                widths.append(len(found))
                load += len(text.as_py() or "")
                if len(ids) >= chunk_rows or load >= chunk_bytes:
                    yield flush()
                    number += 1
                    place, train = {}, []
                    ids, held, sizes, widths, which, times, load = [], [], [], [], array("i"), array("i"), 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, CHUNK)


def fit_pieces(counts: DataFrame, start: dict[str, float], rounds: int = 1, floor: float = 0.1) -> dict[str, float]:
    """Piece log probabilities after ``rounds`` of expected counts over all training words (word, c). What reaches the driver has one number for each piece of the given vocabulary."""
    log_p = start
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], log_p: dict[str, float] = log_p) -> Iterator[pa.RecordBatch]:
            lattice = BatchLattice(log_p)
            uses, rest = np.zeros(len(lattice.pieces)), {}
            for b in batches:
                lattice.expected([_text(w) for w in b.column(0).to_pylist()], b.column(1).to_numpy(), uses, rest)
            n = [(lattice.pieces[k], uses[k]) for k in np.flatnonzero(uses)] + list(rest.items())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in n], pa.string()), pa.array([v for _, v in n], pa.float64())], ["piece", "n"])

        used = counts.mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = dict.fromkeys(start, floor) | {r["piece"]: r["n"] + floor for r in used}
        total = math.log(math.fsum(n.values()))
        log_p = {p: math.log(v) - total for p, v in n.items()}
    return log_p


def score(docs: DataFrame, model: str, held: Column, smoothing: float = 0.1, rounds: int = 1) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where ``held`` is false are learned from. A null or empty text is its end alone. ``base_score`` is the smoothed unigram log10
    probability; ``score`` mixes the relative frequency of each token with its lattice marginal, which gets the share of training
    tokens that were seen once (Good-Turing, at most one half). Without training rows the lattice alone scores, by the vocabulary's
    own weights. Repeated rows are scored each; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(True)).alias("held_out"))
    chunks = scratch.write(chunked(rows), "chunks")
    listed = chunks.select(F.explode(F.arrays_zip("words", "train")).alias("e")).select(F.col("e.words").alias("word"), F.col("e.train").alias("c"))
    counts = scratch.write(listed.groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total, distinct, once = (x or 0 for x in counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum((F.col("c") == 1).cast("long"))).first())
    share = min(0.5, max(once, 1) / total) if total else 1.0
    # each kind of word counts once: the lattice stands in for words that were not seen
    log_p = fit_pieces(counts.filter("c > 0").select("word", F.lit(1).cast("long").alias("c")), existing_scores(model), rounds if total else 0)
    below = total + smoothing * (distinct + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = BatchLattice(log_p)
        for b in batches:
            c = b.column(1).to_numpy().astype(np.float64)
            marginal = lattice.log_marginals([_text(w) for w in b.column(0).to_pylist()]) + math.log(share)
            with np.errstate(divide="ignore"):
                seen = np.log((1 - share) * c / max(total, 1))
            mixed = np.logaddexp(seen, marginal) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mixed)], ["word", "c", "mixed"])

    scored = counts.mapInArrow(weigh, "word binary, c long, mixed double")
    asked = chunks.select(F.col("chunk").alias("asker"), F.posexplode("words").alias("at", "word"))
    answers = asked.join(scored, "word").select("asker", "at", "c", "mixed")

    def add_up(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        row = texts.iloc[0]
        table, at, c = np.empty((len(words), 3)), words["at"].to_numpy(), words["c"].to_numpy()
        table[at, 0], table[at, 1], table[at, 2] = c > 0, np.log10((c + smoothing) / below), words["mixed"]
        pairs = int(np.sum(row["widths"]))
        which, times = widen(row["which"], pairs), widen(row["times"], pairs)
        first = np.cumsum(row["widths"]) - row["widths"]
        known, base, mixed = (np.add.reduceat(table[which, k] * times, first) for k in range(3))
        return pd.DataFrame({"doc_id": pd.array(list(row["doc_ids"]), "Int64"), "held_out": np.array(list(row["held"]), bool), "n_tokens": row["sizes"], "n_known": known.astype(np.int64), "base_score": base, "score": mixed})

    texts = chunks.select("chunk", "doc_ids", "held", "sizes", "widths", "which", "times")
    out = texts.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInPandas(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
