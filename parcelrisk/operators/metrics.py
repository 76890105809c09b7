"""Agreement, confusion, reports, losses and AUC as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.operators.numbering import range_bucket


def counts(label: Column, reference: Column, valid: Column | None = None) -> list[Column]:
    """tp, fp, fn, tn of booleans under a mask; missing is false."""
    a, b = F.coalesce(label, F.lit(False)), F.coalesce(reference, F.lit(False))
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    return [F.count_if(ok & x & y).alias(n) for n, x, y in (("tp", a, b), ("fp", a, ~b), ("fn", ~a, b), ("tn", ~a, ~b))]


def _scores(tp: Column, fp: Column, fn: Column, tn: Column, eps: float = S.AGREEMENT_EPS) -> dict[str, Column]:
    total = tp + fp + fn + tn
    precision, recall = tp / (tp + fp + eps), tp / (tp + fn + eps)
    reference = (tp + fn) / (total + eps)
    return {"iou": tp / (tp + fp + fn + eps), "precision": precision, "recall": recall, "f1": 2 * tp / (2 * tp + fp + fn + eps), "label_fraction": (tp + fp) / (total + eps), "reference_fraction": reference, "lift": precision / (reference + eps)}


def agreement_columns(label: Column, reference: Column, valid: Column | None = None) -> list[Column]:
    """The counts and what follows from them, as aggregates of one scan."""
    c = counts(label, reference, valid)
    return [*c, *[v.alias(k) for k, v in _scores(*c).items()]]


def agreement(df: DataFrame, keys: list[str], label: Column, reference: Column, valid: Column | None = None) -> DataFrame:
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(*counts(label, reference, valid)).select(*keys, "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in _scores(*[F.col(n) for n in ("tp", "fp", "fn", "tn")]).items()])


def compare_labels(df: DataFrame, labels: dict[str, Column], reference: Column, valid: Column | None = None) -> DataFrame:
    """Agreement of several named labels with one reference, in one scan."""
    long = df.withColumn("l", F.explode(F.array(*[F.struct(F.lit(n).alias("label_name"), c.alias("is")) for n, c in labels.items()])))
    return agreement(long.withColumn("label_name", F.col("l.label_name")), ["label_name"], F.col("l.is"), reference, valid)


def pixel_scores(confusion: DataFrame, eps: float = S.PIXEL_EPS) -> DataFrame:
    """IoU, F1, Dice (the same for two classes), precision and recall of rows with tp, fp, fn (sums of however many batches)."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    precision, recall, f1 = tp / (tp + fp + eps), tp / (tp + fn + eps), 2 * tp / (2 * tp + fp + fn + eps)
    return confusion.select("*", (tp / (tp + fp + fn + eps)).alias("iou"), f1.alias("f1"), f1.alias("dice"), precision.alias("precision"), recall.alias("recall"))


def multiclass_confusion(df: DataFrame, classes: int = 3, keys: list[str] | None = None) -> DataFrame:
    """keys, y, pred, n over the whole class grid; out-of-range rows do not count."""
    keys = keys or []
    ok = df.filter(F.col("y").between(0, classes - 1) & F.col("pred").between(0, classes - 1))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("pred")) for a in range(classes) for b in range(classes)])).alias("c")
    seen = ok.groupBy(*keys, "y", "pred").agg(F.count("*").alias("n"))
    frame = (ok.select(*keys).distinct() if keys else df.sparkSession.range(1)).select(*keys, cells).select(*keys, "c.y", "c.pred")
    return frame.join(seen, [*keys, "y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(df: DataFrame, classes: int = 3, by_site: bool = False, eps: float = S.AGREEMENT_EPS) -> DataFrame:
    """Accuracy, macro-F1, per-class F1 and support; with ``by_site`` per site and pooled (site_id NULL) from summed counts."""
    ok = df.filter(F.col("y").between(0, classes - 1) & F.col("pred").between(0, classes - 1))
    y, p = F.col("y"), F.col("pred")
    sums = [c for k in range(classes) for c in (F.count_if((y == k) & (p == k)).alias(f"tp{k}"), F.count_if((y != k) & (p == k)).alias(f"fp{k}"), F.count_if((y == k) & (p != k)).alias(f"fn{k}"))]
    g = (ok.rollup("site_id") if by_site else ok.groupBy()).agg(F.count("*").alias("n"), F.count_if(y == p).alias("correct"), *sums)
    hit = [(F.col(f"tp{k}") / (F.col(f"tp{k}") + F.col(f"fp{k}") + eps), F.col(f"tp{k}") / (F.col(f"tp{k}") + F.col(f"fn{k}") + eps)) for k in range(classes)]
    f1 = [2 * precision * recall / (precision + recall + eps) for precision, recall in hit]
    return g.select(*(["site_id"] if by_site else []), "n", (F.col("correct") / (F.col("n") + eps)).alias("accuracy"), (sum(f1[1:], f1[0]) / classes).alias("macro_f1"), *[f.alias(f"f1_{k}") for k, f in enumerate(f1)], *[(F.col(f"tp{k}") + F.col(f"fn{k}")).alias(f"support_{k}") for k in range(classes)])


def binary_report(df: DataFrame) -> DataFrame:
    """tp, fp, fn, tn rows (one per site) to IoU and F1 per site and pooled (site_id NULL) from summed counts."""
    return pixel_scores(df.rollup("site_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def target_flags(report: DataFrame, score: str, target: float) -> DataFrame:
    """Whether each site and the pool reach a target, and whether all sites do (false without any)."""
    flagged = report.withColumn("meets", F.coalesce(F.col(score) >= target, F.lit(False)))
    every = flagged.filter("site_id IS NOT NULL").agg(F.coalesce(F.every("meets"), F.lit(False)).alias("all_sites_meet"))
    return flagged.select("site_id", score, "meets").crossJoin(F.broadcast(every))  # one row


def tile_loss(df: DataFrame, tile: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """One row: mean cross-entropy, mean soft Dice loss over tiles, and their even mix."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-7)), F.lit(1e-7))
    entropy = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    t = df.groupBy(*tile).agg(F.sum(F.col(p) * F.col(y)).alias("pt"), F.sum(p).alias("sp"), F.sum(y).alias("st"), F.sum(entropy).alias("e"), F.count("*").alias("n"))
    s = t.agg((F.sum("e") / F.sum("n")).alias("bce"), F.avg(1 - (2 * F.col("pt") + 1) / (F.col("sp") + F.col("st") + 1)).alias("dice_loss"))
    return s.withColumn("loss", 0.5 * F.col("bce") + 0.5 * F.col("dice_loss"))


def auc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", ranges: Column | None = None) -> DataFrame:
    """Exact rank-sum AUC with ties, from counts per distinct score; NULL with one class. Ranges of scores are ranked by themselves, so no task sees all of a key's scores.

    With ``ranges``, a number that must not fall as scores rise, rows are ranked as they come, in one shuffle: for scores that seldom repeat.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    if ranges is not None:
        return _auc_of_ranks(known.select(*keys, F.col(score).alias("score"), (F.col(label) > 0).alias("positive"), ranges.alias("range")), keys)
    g = known.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).withColumn("range", range_bucket(known, score))
    before = W.partitionBy(*keys, "range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(before), F.lit(0)))
    part = g.groupBy(*keys, "range").agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)).alias("u"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    lower = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    part = part.withColumn("u", F.col("u") + F.col("p") * F.coalesce(F.sum("q").over(lower), F.lit(0)))
    s = part.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "upq"])
    return s.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).alias("auc"), F.col("p").alias("positives"), (F.col("p") + F.col("q")).alias("n"))


def _auc_of_ranks(df: DataFrame, keys: list[str]) -> DataFrame:
    group = [*keys, "range"]
    rank = F.rank().over(W.partitionBy(*group).orderBy("score")) + (F.count("*").over(W.partitionBy(*group, "score")) - 1) / 2
    part = df.withColumn("rank", rank).groupBy(*group).agg(F.sum(F.when(F.col("positive"), F.col("rank"))).alias("r"), F.count_if("positive").alias("p"), F.count("*").alias("n"))
    lower = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    part = part.withColumn("r", F.coalesce("r", F.lit(0.0)) + F.col("p") * F.coalesce(F.sum("n").over(lower), F.lit(0)))
    s = part.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "rpn"]).withColumn("q", F.col("n") - F.col("p"))
    u = F.col("r") - F.col("p") * (F.col("p") + 1) / 2
    return s.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), u / (F.col("p") * F.col("q"))).alias("auc"), F.col("p").alias("positives"), "n")


def class_distribution(df: DataFrame, column: str, classes: int = 3) -> DataFrame:
    """Count and fraction of each class, zeroes included."""
    dims = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(column))
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return dims.join(n, column, "left").crossJoin(F.broadcast(total)).select(column, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"))


def class_weights(df: DataFrame, column: str, classes: int = 3) -> DataFrame:
    """Inverse frequencies scaled to mean 1."""
    d = class_distribution(df, column, classes).withColumn("raw", F.sum("n").over(W.partitionBy(F.lit(0))) / F.greatest("n", F.lit(1)))  # a row for each class
    return d.select(column, (F.col("raw") / F.avg("raw").over(W.partitionBy(F.lit(0)))).alias("weight"))


def site_centre(df: DataFrame, lat: str, lon: str, default: tuple[float, float], keys: list[str] | None = None) -> DataFrame:
    """Mean of the known positions, of all rows or for each of ``keys``; ``default`` where none is known."""
    return df.groupBy(*(keys or [])).agg(F.coalesce(F.avg(lat), F.lit(default[0])).alias("lat"), F.coalesce(F.avg(lon), F.lit(default[1])).alias("lon"))


def flooded_baseline(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """IoU of calling every pixel flooded."""
    return df.groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("baseline_iou"))
