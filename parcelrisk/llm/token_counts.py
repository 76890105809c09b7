"""Token counts by rank-synchronous merging of ragged numpy arrays.

A text is cut at white space, each distinct chunk is normalised and pre-tokenised once, and the pre-tokens that are new to a worker
are laid end to end in one array. In every round each sequence applies its lowest-ranked pair at all places at once; what is left
when no pair has a rank are its tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm.common import byte_letters

NO_RANK = np.int32(2**31 - 1)
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
#: Python's str.split() takes these as white space, Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


class MergeTable:
    """The merges of a word-end BPE vocabulary as sorted arrays."""

    def __init__(self, path: str, cache_words: int) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.to_byte = byte_letters()
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for char, byte in self.to_byte.items():
            self.inner[byte], self.last[byte] = vocab[char], vocab[char + end]
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (none is empty)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, ends = self.inner[raw], np.cumsum(size) - 1
        ids[ends] = self.last[raw[ends]]
        out, live = size.copy(), np.arange(len(words))
        seq = np.repeat(live, size)
        rank = np.full(len(ids), NO_RANK, np.int32)
        inside = np.ones(len(ids), bool)
        inside[ends] = False
        at = np.flatnonzero(inside)
        rank[at] = self.rank(ids[at], ids[at + 1])
        while len(ids):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, starts)
            on = best < NO_RANK
            if not on.all():  # finished sequences leave
                out[live[~on]] = size[~on]
                if not on.any():
                    break
                mask = np.repeat(on, size)
                ids, rank, size, live, best = ids[mask], rank[mask], size[on], live[on], best[on]
                seq = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(rank == best[seq])
            # equal pairs that overlap (a run of one symbol): every other one, from the left
            fresh = np.r_[True, np.diff(hit) != 1]
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))) % 2 == 0]
            ids[hit] = self.merged[best[seq[hit]]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            size = size - np.bincount(seq[hit], minlength=len(size))
            place = np.cumsum(keep) - 1
            ids, rank, seq, new = ids[keep], rank[keep], seq[keep], place[hit]
            new = np.unique(np.r_[new, new[new > 0] - 1])
            follows = np.zeros(len(new), bool)
            inner = new + 1 < len(ids)
            follows[inner] = seq[new[inner]] == seq[new[inner] + 1]
            rank[new] = NO_RANK
            rank[new[follows]] = self.rank(ids[new[follows]], ids[new[follows] + 1])
        return out

    def words(self, chunk: str) -> tuple[list[bytes], int]:
        """Pre-tokens of a chunk without white space as bytes, and its special tokens."""
        special = 0
        parts = [chunk]
        if self._special and "<" in chunk and self._special.search(chunk):
            parts = self._special.split(chunk)
            special, parts = len(parts) // 2, parts[::2]
        out: list[bytes] = []
        for part in parts:
            if part.isascii():
                out += [w.encode() for w in _ASCII_WORD.findall(part.lower())]
            else:
                text = self.library.normalizer.normalize_str(part)
                out += [bytes(map(self.to_byte.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return [w for w in out if w], special

    def count_batch(self, texts: list[str | None]) -> list[int]:
        chunks = [(_ASCII_SPACE.split(t) if _SEPARATORS.search(t) else t.split()) if t else [] for t in texts]
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        fresh = list({c for row in chunks for c in row if c not in self.cache})
        for lo in range(0, len(fresh), 100_000):
            part = fresh[lo : lo + 100_000]
            split = [self.words(c) for c in part]
            words = list({w for ws, _ in split for w in ws})
            tokens = dict(zip(words, self.merge_counts(words).tolist(), strict=True)) if words else {}
            self.cache.update((c, n + sum(map(tokens.__getitem__, ws))) for c, (ws, n) in zip(part, split, strict=True))
        return [sum(map(self.cache.__getitem__, row)) for row in chunks]


@lru_cache(maxsize=2)
def merge_table(path: str, cache_words: int) -> MergeTable:
    return MergeTable(path, cache_words)


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens", slice_rows: int = 2_000, cache_words: int = 600_000) -> DataFrame:
    """Adds ``out``: the number of tokens of ``text`` under a word-end BPE vocabulary file, as its library counts them without begin,
    end or padding. Null and empty texts have 0 tokens. Other columns are kept; an existing ``out`` is replaced. Nothing is
    shuffled: each worker counts its own rows, and keeps the counts of up to ``cache_words`` chunks between batches.
    """
    schema = df.drop(out).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(vocabulary, cache_words)
        for whole in batches:
            for lo in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(lo, slice_rows)
                counts = pa.array(table.count_batch(batch.column(text).to_pylist()), pa.int64())
                kept = [n for n in batch.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), counts], [*kept, out])

    return df.mapInArrow(run, schema)


def over_limit(count: Column, limit: int = 2048) -> Column:
    return count > limit
