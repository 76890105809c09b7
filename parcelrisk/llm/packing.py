"""Packing of token sequences: shallow length combinations, repeat counts by non-negative least squares, greedy rest.

Each document is cut into whole windows and one remainder. The plan needs only the histogram of piece lengths, which has as many
bins as a window has tokens however large the corpus is; pieces then find their place by their rank among those of equal length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk.llm.common import Memo, Scratch, byte_letters, space_chunks

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """ids of a byte-level vocabulary file. Chunks that a worker has seen come from a dictionary; special strings and the first chunk of a text go to the file's own library, other new chunks to a faster one that holds the same ranks."""

    def __init__(self, path: str, pattern: str, cache_words: int) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache = Memo(self.encode_word, cache_words)
        # the file's own vocabulary as ranks: its ids stand in the order of its merges, so both libraries give the same ids
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in self.library.get_vocab().items() if t not in self.special}
        with open(path, encoding="utf-8") as f:
            merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(f)["model"]["merges"]]
        made = [self.library.token_to_id(a + b) for a, b in merges]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"the ids of {path} do not stand in the order of its merges")
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode_word(self, chunk: str) -> bytes:
        """Ids of a chunk behind a space."""
        if any(s in chunk for s in self.special):
            return self.encode([" " + chunk])[0]
        return array("I", self.fast.encode_ordinary(" " + chunk)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        rows, of = [space_chunks(t or "") for t in texts], self.cache.__getitem__
        heads = self.encode([row[0] for row in rows])
        return [head + b"".join(map(of, row[1:])) for head, row in zip(heads, rows, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, cache_words: int) -> Encoder:
    return Encoder(path, pattern, cache_words)


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, window: int = 1024, end_id: int = 0, slice_rows: int = 1_000, cache_words: int = 250_000) -> DataFrame:
    """One row per piece of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens. A null text is an empty one; every document ends with ``end_id`` and so has a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(vocabulary, pattern, cache_words), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for lo in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(lo, slice_rows)
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), code.encode_batch(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def combinations(window: int) -> np.ndarray:
    """Lengths that fill a window exactly: alone, in twos and in threes (0: none)."""
    twos = [(window - b, b, 0) for b in range(1, window // 2 + 1)]
    threes = [(window - b - c, b, c) for c in range(1, window // 3 + 1) for b in range(c, (window - c) // 2 + 1)]
    return np.array([(window, 0, 0), *twos, *threes], np.int64)


def repeat_counts(lengths: np.ndarray, histogram: np.ndarray, gap: float = 0.02, most_rounds: int = 50_000) -> np.ndarray:
    """Non-negative least squares of combination counts against the histogram, by accelerated projected gradients.

    It ends when the duality gap shows that the squared residual is within ``gap`` of the least (or a millionth of the histogram's): every
    combination fills the window, so lengths over the window are a price of 1 for each, and a residual less such a price is dual feasible.
    Should that take over ``most_rounds``, the counts found by then are returned; the greedy rest packs every piece in any case.
    """
    h = histogram.astype(np.float64)
    window = int(lengths[0].sum())
    prices = np.arange(len(h)) / window
    flat, real = lengths.ravel(), np.where(lengths > 0, 1.0, 0.0)
    at_lengths = lambda x: np.bincount(flat, (real * x[:, None]).ravel(), len(h))
    at_rows = lambda r: (r[lengths] * real).sum(1)
    v = np.ones(len(h))
    for _ in range(60):  # the largest eigenvalue, for the step
        v = at_lengths(at_rows(v))
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (1.05 * size)
    x = np.zeros(len(lengths))
    y, t, before = x, 1.0, np.inf
    for k in range(most_rounds):
        new = np.maximum(y + step * at_rows(h - at_lengths(y)), 0)
        if k % 20 == 0:
            rest = h - at_lengths(new)
            value = rest @ rest
            dual = rest - max(at_rows(rest).max(), 0) * prices
            least = h @ h - (h - dual) @ (h - dual)
            if value - least <= max(gap * value, 1e-6 * (h @ h)):
                return new
            if value > before:
                t = 1.0  # start the acceleration anew
            before = value
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, window: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of every kind of sequence; histogram[l] pieces have length l. Every piece is used exactly once."""
    left = histogram.astype(np.int64).copy()
    lengths = combinations(window)
    x = repeat_counts(lengths, histogram)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(row: tuple[int, ...], most: int) -> None:
        n = min([most, *(int(left[l]) // row.count(l) for l in set(row))])
        if n > 0:
            for l in row:
                left[l] -= n
            out.append((row, n))

    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        use(tuple(int(l) for l in lengths[j] if l), round(float(x[j])))
    # the rest: the longest piece first, then whatever fills most of the gap
    while left.any():
        row, room, free = [], window, left.copy()
        while room and (fit := np.flatnonzero(free[: room + 1])).size:
            row.append(int(fit[-1]))
            free[fit[-1]] -= 1
            room -= int(fit[-1])
        use(tuple(row), int(left.sum()))
    return out


def ranked(spark: SparkSession, pieces: DataFrame, total: int, group_rows: int = 200_000) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of equal length. A length that very many pieces share is numbered in salted groups, whose offsets are running sums of their sizes."""
    salts = max(8, -(-total // group_rows))
    p = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sizes = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    p = p.withColumn("within", F.row_number().over(inside) - 1)
    return p.join(sizes, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("first")).drop("salt", "within", "first")


def pack(docs: DataFrame, vocabulary: str, pattern: str, window: int = 1024) -> DataFrame:
    """Places all documents in sequences of at most ``window`` ids. Returns one row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. Each id lies in exactly one piece; pieces of a sequence lie without gaps from offset 0.
    An empty table gives no rows; repeated rows are packed once each; documents without id are packed too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(token_pieces(docs, vocabulary, pattern, window), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # one row a length: at most `window` rows
        histogram[length] = n
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = np.zeros(window + 1, np.int64), 0
    for row, n in plan(histogram, window):
        offset = 0
        for l in row:
            slots.setdefault(l, []).append((int(used[l]), sequence, offset))
            used[l] += n
            offset += l
        sequence += n
    places = {l: np.array(s, np.int64).T for l, s in slots.items()}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            seq, off = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            for l in np.unique(length):
                at = np.flatnonzero(length == l)
                first, base, start = places[int(l)]
                slot = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = base[slot] + rank[at] - first[slot], start[slot]
            yield f.drop(columns="rank").assign(sequence_id=seq, offset=off)

    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked(spark, pieces, int(histogram.sum())).select(*order, "rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")
