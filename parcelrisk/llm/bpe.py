"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary, decode up the tree.

A sequence of tokens is the encoding of its bytes exactly if every two adjacent tokens re-encode to themselves. Two encodings are
therefore joined by re-encoding a window across the boundary, which grows until its first and last tokens are stable beside the
untouched tokens outside it; from there on nothing outside can change.

All new pieces of a batch go up their trees together: tokens lie end to end in one array, and each level joins every second node to its
neighbour at once. The smallest window, the two tokens at a boundary, comes from a table of pairs; only where that is not yet
stable, windows grow one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm.common import space_chunks


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def splice(ids: np.ndarray, begins: np.ndarray, stops: np.ndarray, sizes: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``ids`` with the ranges [begin, stop), which do not overlap, replaced by so many of ``new`` each."""
    covered = np.zeros(len(ids) + 1, np.int8)
    covered[begins] += 1
    covered[stops] -= 1
    kept = np.cumsum(covered[:-1]) == 0
    width = kept.astype(np.int64)
    width[begins] += sizes
    place = np.cumsum(width) - width
    out = np.empty(width.sum(), np.int64)
    out[place[kept]] = ids[kept]
    out[np.repeat(place[begins], sizes) + ragged(sizes)] = new
    return out


class Codec:
    """Encoder and decoder of one rank file (base64 bytes and rank on each line).

    A worker keeps the ids of chunks of at most ``cache_chars`` characters, two generations of ``cache_chunks``, and what up to
    ``cache_pairs`` token pairs re-encode to, as arrays of about 24 bytes a pair.
    """

    def __init__(self, path: str, pattern: str, leaf: int = 1, cache_chunks: int = 150_000, cache_chars: int = 32, cache_pairs: int = 1_000_000) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.vocabulary = pa.array(self.bytes_of, pa.large_binary())
        self.width = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.find, self.leaf = regex.compile(pattern).findall, leaf
        self.cache_chunks, self.cache_chars, self.cache_pairs = cache_chunks, cache_chars, cache_pairs
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.forget_pairs()

    def forget_pairs(self) -> None:
        self.keys, self.first, self.count, self.tokens = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int16), np.empty(0, np.int32))

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first, for leaves and windows."""
        parts, rank = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get
        pairs = [rank(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            low, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at])

    def window(self, tokens: list[int]) -> list[int]:
        return self.merge(b"".join(map(self.bytes_of.__getitem__, tokens)))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``tokens`` the encodings of the pairs' bytes begin, and their lengths."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = np.unique(key[self.keys[at] != key]) if len(self.keys) else np.unique(key)
        if len(new):
            if len(self.keys) + len(new) > self.cache_pairs:
                self.forget_pairs()
                new = np.unique(key)
            made = [self.window([k >> 24, k & 0xFFFFFF]) for k in new.tolist()]
            sizes = np.fromiter(map(len, made), np.int16, len(made))
            first = len(self.tokens) + np.cumsum(sizes, dtype=np.int64) - sizes
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.first, self.count = keys[order], np.concatenate([self.first, first.astype(np.int32)])[order], np.concatenate([self.count, sizes])[order]
            self.tokens = np.concatenate([self.tokens, np.array([t for m in made for t in m], np.int32)])
            at = np.searchsorted(self.keys, key)
        return self.first[at], self.count[at]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes."""
        apart = lambda a, b: self.window([a, b]) == [a, b]
        if not left or not right or apart(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self.window(left[-a:] + right[:b])
            more_left = a < len(left) and not apart(left[-a - 1], window[0])
            more_right = b < len(right) and not apart(window[-1], right[b])
            if not more_left and not more_right:
                return left[:-a] + window + right[b:]
            a, b = min(len(left), 2 * a if more_left else a), min(len(right), 2 * b if more_right else b)

    def level(self, ids: np.ndarray, node: int, begin: np.ndarray, size: np.ndarray, rounds: int = 32) -> np.ndarray:
        """Joins nodes of ``node`` bytes in twos. ``begin`` and ``size`` are the places and lengths of the pieces in bytes.

        The window of a join is the two tokens at the cut; it grows by a token to each side where it is not stable yet. Each round
        grows all windows at once. What is not settled after ``rounds`` is joined by itself, with windows that double.
        """
        joins = -(-size // node) // 2
        cut = np.repeat(begin, joins) + (2 * ragged(joins) + 1) * node  # the first byte of each right-hand node
        low, high = cut - node, np.minimum(cut + node, np.repeat(begin + size, joins))
        at, of, before = cut, np.arange(len(cut)), ids  # marks between tokens that are not known to be stable, and whose they are
        for _ in range(rounds):
            ends = np.cumsum(self.width[ids])
            right = np.searchsorted(ends, at, side="right")
            there = ends[right - 1] == at  # else a token has grown over the mark
            right, at, of = right[there], at[there], of[there]
            first, count = self.pairs(ids[right - 1], ids[right])
            loose = np.flatnonzero((count != 2) | (self.tokens[first] != ids[right - 1]))
            if not len(loose):
                return ids
            right, at, of, first, count = right[loose], at[loose], of[loose], first[loose], count[loose].astype(np.int64)
            # of marks that share a token every other one waits
            run = np.maximum.accumulate(np.where(np.diff(right, prepend=-2) != 1, np.arange(len(right)), 0))
            now = (np.arange(len(right)) - run) % 2 == 0
            wait_at, wait_of = at[~now], of[~now]
            right, of, first, count = right[now], of[now], first[now], count[now]
            left_end, right_end = np.where(right > 1, ends[right - 2], 0), ends[right]
            ids = splice(ids, right - 1, right + 1, count, self.tokens[np.repeat(first, count) + ragged(count)])
            inner_left, inner_right = left_end > low[of], right_end < high[of]
            at, some = np.unique(np.concatenate([left_end[inner_left], right_end[inner_right], wait_at]), return_index=True)
            of = np.concatenate([of[inner_left], of[inner_right], wait_of])[some]
            if not len(at):
                return ids
        rest, old, new = np.unique(of), np.cumsum(self.width[before]), np.cumsum(self.width[ids])
        span = lambda ends, a, b: (np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b) + 1)
        lefts, rights = span(old, low[rest], cut[rest]), span(old, cut[rest], high[rest])
        grown = [self.join(before[a:b].tolist(), before[c:d].tolist()) for a, b, c, d in zip(*lefts, *rights, strict=True)]
        return splice(ids, *span(new, low[rest], high[rest]), np.fromiter(map(len, grown), np.int64, len(grown)), np.array([t for g in grown for t in g], np.int64))

    def trees(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces (none is empty), end to end, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin, raw = np.cumsum(size) - size, b"".join(pieces)
        if self.leaf == 1:
            ids = self.byte[np.frombuffer(raw, np.uint8)]
        else:
            ids = np.array([t for p in pieces for i in range(0, len(p), self.leaf) for t in self.merge(p[i : i + self.leaf])], np.int64)
        node, longest = self.leaf, int(size.max(initial=0))
        while node < longest:
            ids = self.level(ids, node, begin, size)
            node *= 2
        ends = np.searchsorted(np.cumsum(self.width[ids]), begin + size)
        return ids, np.diff(ends, prepend=-1)

    def tree(self, piece: bytes) -> list[int]:
        return self.trees([piece])[0].tolist()

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text[:1] == " ":
            if text[1:].isalpha():  # one word: one match
                return [text]
            if text[-1] in ",." and text[1:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.find(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; pieces join by plain concatenation, since none merges with its neighbour."""
        rows = [space_chunks(t or "") for t in texts]
        if len(self.chunks) > self.cache_chunks:
            self.older, self.chunks = self.chunks, {}
        known, older, fresh = self.chunks, self.older, []
        for c in {c for row in rows for c in row[1:]}.difference(known):
            old = older.get(c)
            if old is None:
                fresh.append(c)
            else:
                known[c] = old
        split = [*(self.split(" " + c) for c in fresh), *(self.find(row[0]) for row in rows)]
        rank = self.ranks.get
        ids = {p: rank(p.encode()) for ps in split for p in ps}  # a piece that is a token is that token
        trees = [p for p, token in ids.items() if token is None]
        flat, sizes = self.trees([p.encode() for p in trees])
        data, at = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        coded = {p: token.to_bytes(4, "little") for p, token in ids.items() if token is not None}
        coded.update((p, data[a:b]) for p, a, b in zip(trees, [0, *at], at, strict=False))
        whole = [b"".join(map(coded.__getitem__, ps)) for ps in split]
        known.update(zip(fresh, whole, strict=False))
        out = [head + b"".join(map(known.__getitem__, row[1:])) for head, row in zip(whole[len(fresh) :], rows, strict=True)]
        for c in fresh:
            if len(c) > self.cache_chars:
                del known[c]
        return out

    def decode_batch(self, ids: pa.Array, fan: int = 4096) -> pa.Array:
        """Bytes of little-endian unsigned 32-bit ids; null is null.

        Leaves are the strings of ``fan`` tokens, laid end to end in one buffer: to join two neighbours is to drop the mark between them.
        """
        ids = ids.cast(pa.large_binary())
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        tokens = np.frombuffer(ids.buffers()[2] or b"", "<u4")[bounds[0] : bounds[-1]] if len(ids) else np.empty(0, "<u4")
        bounds = bounds - bounds[:1]
        leaves = self.vocabulary.take(pa.array(tokens))
        marks = np.r_[0, np.cumsum(self.width[tokens])]
        count = np.maximum(-(-np.diff(bounds) // fan), 1)  # leaves of each row
        level = np.minimum(np.repeat(bounds[:-1], count) + ragged(count) * fan, np.repeat(bounds[1:], count))
        while count.max(initial=1) > 1:
            level = level[ragged(count) % 2 == 0]
            count = (count + 1) // 2
        offsets = np.r_[marks[level], marks[-1:]] if len(ids) else np.zeros(1, np.int64)
        valid = ids.is_valid().buffers()[1] if ids.null_count else None
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [valid, pa.py_buffer(offsets), leaves.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", slice_rows: int = 2_000) -> DataFrame:
    """key and ``ids`` (binary: little-endian unsigned 32-bit) of every row, each match of ``pattern`` encoded separately. A null text
    is an empty one; repeated rows and null keys stay rows of their own, other columns are left out, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, slice_rows):
                b = whole.slice(lo, slice_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code.encode_batch(b.column(1).to_pylist()), pa.binary())], [key, "ids"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, ids binary")


def decode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", slice_rows: int = 2_000) -> DataFrame:
    """key, ids and ``decoded`` (binary) of encoded rows; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, slice_rows):
                b = whole.slice(lo, slice_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code.decode_batch(b.column(1))], [key, "ids", "decoded"])

    return df.select(key, "ids").mapInArrow(run, f"{key} long, ids binary, decoded binary")
