"""How far the term use of the sources of a language lies apart, exactly, from bitmaps of terms by count.

A source has one bitmap of term ids for each count that some term has in it. Two bitmaps and-ed give the terms with one count here and
another there: their number, times what such a term adds, is a cell's share of the divergence of a pair of sources. Terms that a source
lacks have no bitmap: their cells follow by complement, from the sizes of the bitmaps and of the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from string import ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk.llm.common import Scratch, scan, spread_join

MOST_HELD = 300_000  # terms that a task counts before it hands them on
SLICE = 1 << 20  # bytes of a text that are cut into terms at once
CELLS = 1 << 21  # pairs of bitmaps that are compared at once
WORDS_A_TASK = 16
#: Terms are runs of ASCII letters and of bytes above 0x7F; other bytes part them, A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if chr(b) in ascii_uppercase else b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _slices(data: bytes) -> Iterator[bytes]:
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + SLICE) if len(data) - lo > SLICE else -1
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi]
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [*n, b""]  # the empty term says that the group occurs
            counts = pa.array([*n.values(), 0], pa.int64())
            columns = [pa.array([v] * len(terms)) for v in (lang, source)] + [pa.array(terms, pa.binary()).cast(pa.string()), counts, pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)
        held.clear()

    for b in batches:
        for text, lang, source in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in _slices(text.translate(TERM_BYTES)):
                terms = part.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > MOST_HELD:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); each group also has a row of the empty term, with 0 of both."""
    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return d.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, whole: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 1) / (whole + terms)), exactly; null without terms."""
    return F.expr(f"1 + (CAST(1000000000 AS decimal(10, 0)) * CAST({n} + 1 AS decimal(20, 0))) div CAST(nullif({whole} + {terms}, 0) AS decimal(20, 0))")


def _f(p: str, q: str) -> str:
    """What a term of share p here and q there adds; shares are at most 10^9 + 1, so the square fits."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _joint(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over the cells in which both sources of a pair have the terms, beyond what the complement counts for these terms: a, b, value."""
    names, source = np.unique(pdf["source"].to_numpy(object).astype(str), return_inverse=True)
    bits, p, p0, word = (pdf[c].to_numpy(np.int64) for c in ("bits", "p", "p0", "word"))
    bits = bits.view(np.uint64)
    f = lambda a, b: (a - b) * (a - b) // b
    keys, sums = [], []
    order = np.argsort(word, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(word[order])) + 1):
        step = max(1, CELLS // len(own))
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            both = np.bitwise_count(bits[some][:, None] & bits[own][None, :])
            i, j = np.nonzero(both)
            n, i, j = both[i, j].astype(np.int64), some[i], own[j]
            other = source[i] != source[j]
            n, i, j = n[other], i[other], j[other]
            if len(n):
                more = f(p[i], p[j]) - f(p0[i], p[j]) - f(p[i], p0[j]) + f(p0[i], p0[j])
                key, place = np.unique(source[i] * len(names) + source[j], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, place, n * more)
                keys.append(key)
                sums.append(total)
    if not keys:
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, np.concatenate(sums))
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": names[key // len(names)], "b": names[key % len(names)], "value": total})


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from each other one of its language, and by which terms from the whole.

    ``docs`` has text, lang and source, null counting as empty. A language keeps the terms of ``least_docs`` documents or more. A
    source's share p of a term with n >= 0 occurrences is 1 + floor(10^9 (n + 1) / (N + V)), N all its occurrences of kept terms, V the
    kept terms. Part ``pair`` sums floor((p - q)^2 / q) over all kept terms, q the other source's share; part ``term`` gives that of each
    term with n > 0 and p > q, q the language's share, for the ``most_terms`` first ranks. Ranks order by value, falling, then by item in
    UTF-8. Groups without text or terms have pairs, of value 0 where their language keeps no term; a language of one source has no
    pairs. Repeated rows count as documents; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.write(term_counts(docs), "counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "total", (-F.col("total")).alias("o"))
    # terms of like counts lie together, so that few bitmaps have a bit in one word
    kept = scratch.write(scan(kept, ["lang"], ["o", "term"], {"id": (F.sum, lambda a, b: a + b, F.lit(1))}, scratch, "terms").select("lang", "term", "total", (F.col("id") - 1).alias("id")), "kept")
    cells = scratch.write(counts.filter("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "total"), "cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = counts.filter("term = ''").select("lang", "source").join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n_source")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_source", "v", "n_lang")])
    groups = scratch.write(groups.withColumn("p0", _share("0", "n_source", "v")), "groups")
    shares = spread_join(cells, groups, ["lang", "source"]).select("lang", "source", "term", "id", "n", _share("n", "n_source", "v").alias("p"), "p0", _share("total", "n_lang", "v").alias("q"))
    shares = scratch.write(shares, "shares")
    # a bitmap is kept as words of 64 terms
    words = shares.groupBy("lang", F.expr("id div 64").alias("word"), "source", "n").agg(F.bit_or(F.expr("shiftleft(1L, CAST(id % 64 AS int))")).alias("bits"), F.max("p").alias("p"), F.max("p0").alias("p0"))
    joint = words.groupBy("lang", F.expr(f"word div {WORDS_A_TASK}").alias("block")).applyInPandas(_joint, "lang string, a string, b string, value long")
    levels = scratch.write(shares.groupBy("lang", F.col("source").alias("own"), "n").agg(F.count("*").alias("m"), F.max("p").alias("p"), F.max("p0").alias("p0")), "levels")
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("z"), "v")
    met = spread_join(levels, others, ["lang"]).filter("own <> other")
    cell = lambda a, b, with_bit, without: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.expr(f"m * ({with_bit} - {without})").alias("value"))
    one_side = met.select("lang", F.explode(F.array(cell("own", "other", _f("p", "z"), _f("p0", "z")), cell("other", "own", _f("z", "p"), _f("z", "p0")))).alias("c")).select("lang", "c.*")
    neither = groups.select("lang", F.col("source").alias("a"), "p0").join(others, "lang").filter("a <> other").select("lang", "a", F.col("other").alias("b"), F.coalesce(F.expr(f"v * ({_f('p0', 'z')})"), F.lit(0)).alias("value"))
    pairs = joint.union(one_side).union(neither).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    ranked = lambda d: d.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).union(ranked(terms).filter(F.col("rank") <= most_terms))
