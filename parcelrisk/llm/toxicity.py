"""Toxicity as an ordinal regression on sparse text features.

Features are words and word beginnings. Those that labelled toxic texts hold significantly more often than the others enter a
cumulative-link (proportional odds) model, which shares their weights across the ordered thresholds of the severity grades and gives
P(grade >= k); the expected severity is the sum of these. Nothing else than the weights of a text's features decides.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm.common import Scratch

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
SAMPLE_TASKS = 32


def features(word: str) -> list[str]:
    """The word and its beginnings (marked by a trailing asterisk)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def words(text: str | None) -> list[str]:
    """Lower-cased letter runs of the whole text."""
    return _WORD.findall((text or "").lower())


def copy_key(ws: list[str], run: int = 3) -> int:
    """The smallest crc32 of a run of words: nearly always equal for copies with few changes, hardly ever for other texts."""
    return min((zlib.crc32(" ".join(ws[i : i + run]).encode()) for i in range(max(1, len(ws) - run + 1))), default=0)


@dataclass
class SeverityModel:
    """Weights of the features; cuts[k-1] is the threshold of grade k. Grade 0 is clean."""

    weights: dict[str, float]
    cuts: list[float]

    def margin(self, held: Iterable[str]) -> float:
        return math.fsum(map(self.weights.__getitem__, held))

    def at_least(self, margins: list[float]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each margin."""
        return 1 / (1 + np.exp(np.array(self.cuts)[None, :] - np.array(margins, np.float64)[:, None]))


def fit_cumulative_link(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int, l2: float = 0.02, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts of P(y >= k) = sigmoid(x w - cut_k), the same w >= 0 for every grade k = 1..grades.

    Adam on the penalised likelihood; the cuts are a first cut and positive steps, so they stay in order.
    """
    n, d = x.shape
    theta = np.concatenate([np.zeros(d), [1.0], np.zeros(grades - 1)])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    row = np.arange(n)
    for t in range(1, steps + 1):
        w, cuts = theta[:d], np.cumsum(np.r_[theta[d], np.exp(theta[d + 1 :])])
        s = 1 / (1 + np.exp(np.clip(cuts - (x @ w)[:, None], -40, 40)))
        s = np.column_stack([np.ones(n), s, np.zeros(n)])
        slope = s * (1 - s)
        p = np.maximum(s[row, y] - s[row, y + 1], 1e-12)
        up, down = weight * slope[row, y] / p, weight * slope[row, y + 1] / p
        to_cuts = np.array([down[y + 1 == k].sum() - up[y == k].sum() for k in range(1, grades + 1)])
        tail = np.cumsum(to_cuts[::-1])[::-1]
        grad = np.concatenate([x.T @ (up - down) - l2 * w, [tail[0]], tail[1:] * np.exp(theta[d + 1 :])]) / weight.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta[:d] = np.maximum(theta[:d], 0)
        theta = theta + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-10)
    return np.maximum(theta[:d], 0), np.cumsum(np.r_[theta[d], np.exp(theta[d + 1 :])])


def sample(labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(doc_id, toxic) of at most so many labelled ids of each kind, the first by the hash of the id. An id with several labels is toxic if one of them says so."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    # a draw of a few more leaves little to sort
    kinds = [known.filter((F.col("toxic") == k) & (draw < 1_000 + int(1_100_000 * min(1.0, most / max(size.get(k, 0), 1))))).orderBy(draw, "doc_id").limit(most) for k, most in ((1, toxic_rows), (0, clean_rows))]
    return kinds[0].union(kinds[1])


def grade_toxic(x: np.ndarray, toxic: np.ndarray, n: np.ndarray, weight: np.ndarray, fold: np.ndarray, grades: int) -> np.ndarray:
    """Grades 1..``grades`` of the toxic rows, 0 of the others: equal shares of the toxic texts by their margin in a two-class fit that has not seen their fold."""
    margin = np.zeros(len(x))
    for f in np.unique(fold[toxic]):
        own = fold == f
        w, cuts = fit_cumulative_link(x[~own], toxic[~own].astype(int), weight[~own], 1, steps=300)
        margin[own] = x[own] @ w - cuts[0]
    steps = np.quantile(np.repeat(margin[toxic], n[toxic]), np.arange(1, grades) / grades)
    return np.where(toxic, 1 + np.searchsorted(steps, margin, side="left"), 0)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 4_000, clean_rows: int = 12_000, least_df: int = 5, least_share: float = 0.01, least_z: float = 4.0, grades: int = 2, folds: int = 5) -> SeverityModel:
    """Fits on ``labels`` (doc_id, toxic 0/1) of ``docs`` (doc_id, text).

    The fit is on a bounded sample: at most ``toxic_rows`` toxic and ``clean_rows`` clean ids with one text each, whatever the size of the
    corpus; of copies of one text one counts. Every feature enters that at least ``least_df`` and ``least_share`` of the sample's toxic
    texts hold and whose share in them is ``least_z`` standard errors above that in clean ones; both classes weigh the same. Labels
    have two classes only: toxic texts are graded 1, 2, ... by how toxic a fit on the other ``folds`` finds them. The texts become features
    in tasks, once; the driver gets the kept features and, for each kind of text, which of them it holds. Rows without text, id or label are left
    out; without both classes nothing is toxic.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    drawn = sample(labels, toxic_rows, clean_rows)
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # an id that several rows hold counts once, so that the sample bounds the rows; the task number keeps batches of texts small
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).repartition(SAMPLE_TASKS, "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [words(t) for t in b.column("text").to_pylist()]
            held = [sorted({f for w in set(ws) for f in features(w)}) for ws in texts]
            keys = pa.array([copy_key(ws) for ws in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), keys, pa.array(held, pa.list_(pa.string()))], ["doc_id", "toxic", "key", "held"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    described = rows.mapInArrow(describe, f"doc_id {id_type}, toxic int, key long, held array<string>")
    # copies of one text would make all its words telling: of texts with an equal key one counts
    described = scratch.write(described.groupBy("toxic", "key").agg(F.min_by("held", F.xxhash64("doc_id")).alias("held")), "described")
    size = {r["toxic"]: r["count"] for r in described.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        scratch.drop("described")
        return SeverityModel({}, [50.0 + k for k in range(grades)])
    one = described.select("toxic", F.explode("held").alias("f")).groupBy("f").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    share = F.col("all") / (n_toxic + n_clean)
    above = F.col("bad") / n_toxic - (F.col("all") - F.col("bad")) / n_clean
    telling = (above > 0) & (above >= least_z * F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean)))
    kept = one.filter((F.col("bad") >= max(least_df, least_share * n_toxic)) & telling).select("f")
    names = sorted(r["f"] for r in kept.collect())  # of a sample of bounded size
    held = F.array_sort(F.array_intersect("held", F.lit(names) if names else F.array().cast("array<string>")))
    kinds = described.groupBy("toxic", F.pmod("key", F.lit(folds)).alias("fold"), held.alias("held")).count().collect()  # no more than the sample's rows
    scratch.drop("described")
    kinds.sort(key=lambda r: (r["toxic"], r["fold"], r["held"]))
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(kinds), len(names)))
    for k, r in enumerate(kinds):
        x[k, [at[f] for f in r["held"]]] = 1
    toxic, n, fold = np.array([r["toxic"] == 1 for r in kinds]), np.array([r["count"] for r in kinds]), np.array([r["fold"] for r in kinds])
    weight = n * np.where(toxic, 0.5 / n_toxic, 0.5 / n_clean) * (n_toxic + n_clean)
    w, cuts = fit_cumulative_link(x, grade_toxic(x, toxic, n, weight, fold, grades), weight, grades)
    return SeverityModel({f: float(w[k]) for f, k in at.items()}, cuts.tolist())


def score(docs: DataFrame, model: SeverityModel, text: str = "text", reject_at: float = 0.5) -> DataFrame:
    """Adds p_toxic (P(grade >= 1)), expected_severity (sum over grades of P(grade >= k)), severity (likeliest grade) and rejected
    (p_toxic >= ``reject_at``) to every row, from the whole text. A null or empty text has no features. Columns of these names are
    replaced; nothing is shuffled."""
    new = {"p_toxic": "double", "expected_severity": "double", "severity": "int", "rejected": "boolean"}
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept, *(F.lit(None).cast(t).alias(c) for c, t in new.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.weights, {}
        for b in batches:
            margins = []
            for t in b.column(text):
                held: set[str] = set()
                for w in set(words(t.as_py())):
                    fs = known.get(w)
                    if fs is None:
                        if len(known) > 200_000:
                            known.clear()
                        fs = known[w] = [f for f in features(w) if f in weights]
                    held.update(fs)
                margins.append(model.margin(held))
            p = model.at_least(margins)
            each = -np.diff(np.column_stack([np.ones(len(p)), p, np.zeros(len(p))]), axis=1)
            columns = [pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= reject_at)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], [*kept, *new])

    return docs.mapInArrow(run, schema)
