"""Model fitting, importance and explanation as Spark jobs."""

from __future__ import annotations

from math import factorial

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk.functions.raster import softmax
from parcelrisk.operators import graph
from parcelrisk.operators.metrics import auc, class_report, class_weights
from parcelrisk.operators.numbering import number_within, range_bucket
from parcelrisk.sources.scratch import settle


class PixelClassifier:
    """Standardised logistic regression with balanced class weights."""

    def __init__(self, features: list[str], iterations: int = 1000) -> None:
        self.features, self.iterations = features, iterations
        self.model: LogisticRegressionModel | None = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self.assembler.transform(df))

    def fit(self, df: DataFrame, label: str = "y") -> PixelClassifier:
        if (kinds := df.select(label).distinct().limit(2).count()) < 2:
            raise ValueError(f"{kinds} class; two are needed")
        self.assembler = VectorAssembler(inputCols=self.features, outputCol="raw_features")
        d = df.join(F.broadcast(class_weights(df, label, 2)), label)  # a row for each class
        raw = self.assembler.transform(d)
        self.scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True).fit(raw)
        self.model = LogisticRegression(labelCol=label, weightCol="weight", maxIter=self.iterations, regParam=1e-6).fit(self.scaler.transform(raw))
        return self

    def linear(self) -> tuple[list[float], float]:
        """Weights and intercept on the unscaled features, so that scoring is a plain column expression."""
        w = [c / s if s else 0.0 for c, s in zip(self.model.coefficients, self.scaler.std, strict=True)]
        return w, float(self.model.intercept - sum(a * m for a, m in zip(w, self.scaler.mean, strict=True)))

    def probability(self, of: dict[str, Column] | None = None) -> Column:
        w, b = self.linear()
        columns = [(of or {}).get(f, F.col(f)) for f in self.features]
        z = sum((float(a) * c for a, c in zip(w, columns, strict=True)), F.lit(b))
        return 1 / (1 + F.exp(-z))


def permutation_importance(df: DataFrame, features: list[str], probability=None, label: str = "y", repeats: int = 3, seed: int = 0, weights: list[float] | None = None) -> DataFrame:
    """feature, mean and std of the AUC drop when one column is shuffled within ``fold``, largest mean first.

    Each row meets one donor a repeat, in the order of md5("seed:repeat:id"), whose values serve all features, one at a time: a row is
    joined ``repeats`` times, whatever the number of features, and only scores are shuffled from there on. With ``weights`` the score is
    the weighted sum of the features, whose rank is that of its probability: one replaced feature changes it by weight x (given - own), so a
    score costs one product. Otherwise ``probability`` maps {feature: column} to a score column, of which 12 digits count. Rows without ``fold`` take no part.
    """
    ranges = lambda h: F.conv(F.substring(h, 1, 3), 16, 10).cast("int")
    place = F.md5(F.concat_ws(":", F.col("id").cast("string")))
    own = [F.col(f).cast("double") for f in features]
    if weights is None:
        base, digits = probability({}), 12
        replaced = lambda given: [probability({f: given[i]}) for i, f in enumerate(features)]
    else:
        base, digits = sum((float(w) * c for w, c in zip(weights, own, strict=True)), F.lit(0.0)), 9
        replaced = lambda given: [F.col("__base") + float(w) * (given[i] - c) for i, (w, c) in enumerate(zip(weights, own, strict=True))]
    known = df.filter("fold IS NOT NULL").withColumn("__base", base)
    numbered = number_within(known, ["fold"], ranges(place), [place, "id"], "__k")
    donors = known.select("fold", "id", F.array(*own).alias("__given"), F.explode(F.array(*map(F.lit, range(repeats)))).alias("__r"))
    moved_to = F.md5(F.concat_ws(":", F.lit(seed), "__r", F.col("id").cast("string")))
    donors = number_within(donors, ["fold", "__r"], ranges(moved_to), [moved_to, "id"], "__k").drop("id")
    scores = F.posexplode(F.array(*replaced(F.col("__given")))).alias("f", "score")
    scored = numbered.join(donors.hint("merge"), ["fold", "__k"]).select("__r", F.col(label).alias("label"), scores).withColumn("score", F.round("score", digits))
    plain = known.select(F.col(label).alias("label"), F.round("__base", digits).alias("score"))
    whole = auc(plain, []).select(F.col("auc").alias("base"))
    drops = auc(scored, ["f", "__r"], ranges=range_bucket(plain, "score")).crossJoin(F.broadcast(whole)).select("f", (F.col("base") - F.col("auc")).alias("drop"))  # one row
    names = F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1)
    return drops.groupBy(names.alias("feature")).agg(F.avg("drop").alias("mean"), F.coalesce(F.stddev_pop("drop"), F.lit(0.0)).alias("std")).orderBy(F.desc("mean"), "feature")


def signal_report(here: DataFrame, there: DataFrame, features: list[str], label: str = "y", repeats: int = 10) -> DataFrame:
    """One row: classifier fitted on one location, AUC there and on the other, positive shares, and ``importance``: feature, mean and std of its AUC drop on the other location (id, fold, ...), largest mean first."""
    m = PixelClassifier(features).fit(here, label)
    scored = lambda d: d.select(F.col(label).alias("label"), m.probability().alias("score"))
    a = auc(scored(here), []).select(F.col("auc").alias("auc_here"), (F.col("positives") / F.col("n")).alias("positive_here"))
    b = auc(scored(there), []).select(F.col("auc").alias("auc_there"), (F.col("positives") / F.col("n")).alias("positive_there"))
    drops = permutation_importance(there, features, label=label, repeats=repeats, weights=m.linear()[0])
    listed = F.sort_array(F.collect_list(F.struct(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "feature")), asc=False)
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(drops.agg(listed.alias("importance"))))  # one row each


def hop_features(nodes: DataFrame, edges: DataFrame, features: list[str]) -> DataFrame:
    """Own features and the neighbour means of one and two hops (h1_*, h2_*)."""
    one = graph.neighbour_mean(nodes, edges, features, "h1_")
    return graph.neighbour_mean(one, edges, [f"h1_{f}" for f in features], "h2_").withColumnsRenamed({f"h2_h1_{f}": f"h2_{f}" for f in features})


def neighbourhood_classifier(nodes: DataFrame, edges: DataFrame, features: list[str], penalties: tuple[float, ...] = (1e-4, 1e-2), classes: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes (y, split) with class probabilities, and the report on each split. Neighbour means of two hops feed a class-weighted softmax
    regression; the penalty is the one of the best macro-F1 on val."""
    d = hop_features(graph.standardise(nodes, features, ["site_id"]).select("site_id", "node_id", "y", "split", *[F.col(f"z_{f}").alias(f) for f in features]), edges, features)
    d = settle(d)  # read by each fit and each report
    columns = [*features, *[f"h1_{f}" for f in features], *[f"h2_{f}" for f in features]]
    train = d.filter("split = 'train'")
    v = VectorAssembler(inputCols=columns, outputCol="features").transform(d.join(F.broadcast(class_weights(train, "y", classes)), "y"))  # a row for each class
    best = None
    for p in penalties:
        model = LogisticRegression(labelCol="y", weightCol="weight", regParam=p, maxIter=50, family="multinomial").fit(v.filter("split = 'train'"))
        out = settle(model.transform(v).select("site_id", "node_id", "y", "split", vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("pred")))
        score = class_report(out.filter("split = 'val'"), classes).first()["macro_f1"]
        if best is None or score > best[0]:
            best = (score, out)
    reports = [class_report(best[1].filter(F.col("split") == s), classes).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return best[1], reports[0].union(reports[1]).union(reports[2])


def _dense(inputs: list[Column], weights: list[list[float]]) -> list[Column]:
    return [sum((float(w) * c for w, c in zip(row, inputs, strict=True)), F.lit(0.0)) for row in weights]


def forward(nodes: DataFrame, edges: DataFrame, features: list[str], layers: list[tuple[list[list[float]], list[list[float]], list[float]]], head: tuple[list[list[float]], list[float]]) -> DataFrame:
    """site_id, node_id, p (array): mean-aggregation layers relu(W_self x + W_near mean(x) + b) with given weights, a linear head, softmax."""
    d, names = nodes.select("site_id", "node_id", *features), features
    for k, (own, near, bias) in enumerate(layers):
        d = graph.neighbour_mean(d, edges, names)
        a, b = _dense([F.col(n) for n in names], own), _dense([F.col(f"mean_{n}") for n in names], near)
        new = [f"h{k}_{j}" for j in range(len(own))]
        d = d.select("site_id", "node_id", *[F.greatest(x + y + float(c), F.lit(0.0)).alias(n) for x, y, c, n in zip(a, b, bias, new, strict=True)])
        names = new
    logits = [z + float(c) for z, c in zip(_dense([F.col(n) for n in names], head[0]), head[1], strict=True)]
    return d.select("site_id", "node_id", softmax(F.array(*logits)).alias("p"))


def shapley(df: DataFrame, keys: list[str], features: list[str], score) -> DataFrame:
    """keys, feature, attribution, rank: exact Shapley values over all 2^n coalitions; an absent feature is the site's mean.

    Every coalition is scored once for every row as a column of one projection; the attributions of a row sum to its score less that
    of the means. ``score`` maps {feature: column} to a column.
    """
    n = len(features)
    means = df.groupBy("site_id").agg(*[F.avg(f).alias(f"mean_{f}") for f in features])
    d = df.join(F.broadcast(means), "site_id")  # a row for each site
    full = 1 << n
    values = F.array(*[score({f: F.col(f) if s >> i & 1 else F.col(f"mean_{f}") for i, f in enumerate(features)}) for s in range(full)])
    d = d.select(*keys, values.alias("v"))
    parts = []
    for i, f in enumerate(features):
        terms = [(factorial(s.bit_count()) * factorial(n - s.bit_count() - 1) / factorial(n), s) for s in range(full) if not s >> i & 1]
        total = sum(((F.col("v")[s | 1 << i] - F.col("v")[s]) * w for w, s in terms[1:]), (F.col("v")[terms[0][1] | 1 << i] - F.col("v")[terms[0][1]]) * terms[0][0])
        parts.append(F.struct(F.lit(f).alias("feature"), total.alias("attribution")))
    ranked = F.array_sort(F.array(*parts), lambda a, b: F.when(F.abs(a["attribution"]) > F.abs(b["attribution"]), -1).when(F.abs(a["attribution"]) < F.abs(b["attribution"]), 1).otherwise(0))
    return d.select(*keys, F.posexplode(ranked).alias("rank", "e")).select(*keys, "e.feature", "e.attribution", (F.col("rank") + 1).alias("rank"))


def flood_probability(stack: DataFrame, bands: list[str], label: str, radius: int = 1, scorer=None) -> DataFrame:
    """site_id, row, col, p: probability per pixel. By default a pixel classifier on the bands and their focal means; ``scorer`` may be a
    function for mapInPandas that adds ``p`` to (site_id, row, col, bands)."""
    from parcelrisk.operators.raster import PIXEL, focal_mean

    if scorer is not None:
        return stack.select(*PIXEL, *bands).mapInPandas(scorer, "site_id int, row int, col int, p double")
    d = stack
    for b in bands:
        d = focal_mean(d, b, radius, f"focal_{b}")
    names = [*bands, *[f"focal_{b}" for b in bands]]
    known = d.dropna(subset=[*names, label]).withColumn("y", (F.col(label) > 0.5).cast("int"))
    m = PixelClassifier(names).fit(known)
    return d.dropna(subset=names).select(*PIXEL, m.probability().alias("p"))
