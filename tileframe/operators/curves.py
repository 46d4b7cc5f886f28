"""Curves from score histograms and from exact scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileframe.operators.ranks import running_sums


def curve_points(h: DataFrame, keys: Sequence[str] = (), bins: int = 4096) -> DataFrame:
    """Cumulative tp and fp from the top bin down, threshold, tpr, fpr, precision (1 where nothing is predicted) and recall."""
    by = [*keys, "class_id"]
    down = Window.partitionBy(*by).orderBy(F.desc("bin_id")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    c = h.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "p": F.sum("pos").over(every), "q": F.sum("neg").over(every)})
    d = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    return c.select(*by, "bin_id", (F.col("bin_id") / float(bins)).alias("threshold"), "tp", "fp", d(F.col("tp"), F.col("p")).alias("tpr"), d(F.col("fp"), F.col("q")).alias("fpr"), F.coalesce(d(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), d(F.col("tp"), F.col("p")).alias("recall"))


def curves(h: DataFrame, keys: Sequence[str] = (), bins: int = 4096) -> DataFrame:
    """roc_auc (trapezoid), average_precision (steps) and pr_auc (trapezoid) of each class; NULL without positives, or for ROC without negatives."""
    by = [*keys, "class_id"]
    order = Window.partitionBy(*by).orderBy(F.desc("bin_id"))
    before = lambda c, start: F.coalesce(F.lag(c).over(order), F.lit(start))
    pts = curve_points(h, keys, bins).withColumns({"tpr0": before("tpr", 0.0), "fpr0": before("fpr", 0.0), "prec0": before("precision", 1.0)})
    return pts.groupBy(*by).agg(
        F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("roc_auc"),
        F.sum((F.col("recall") - F.col("tpr0")) * F.col("precision")).alias("average_precision"),
        F.sum((F.col("recall") - F.col("tpr0")) * (F.col("precision") + F.col("prec0")) / 2).alias("pr_auc"),
    )


def pooled_curves(h: DataFrame, method: str = "method_id", bins: int = 4096) -> DataFrame:
    """Points of each method's histograms summed over seeds."""
    return curve_points(h.groupBy(method, "class_id", "bin_id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), [method], bins)


def cumulated(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """keys, score, pos and neg of each distinct score, tp and fp from the highest down, n_pos and n_neg; keys with one class only are left out.

    Without keys, ranges of scores are summed apart; a key's scores are one group's.
    """
    steps = df.groupBy(*keys, score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    if keys:
        every = Window.partitionBy(*keys)
        upto = every.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
        s = steps.withColumns({"tp": F.sum("pos").over(upto), "fp": F.sum("neg").over(upto), "n_pos": F.sum("pos").over(every), "n_neg": F.sum("neg").over(every)})
    else:
        s = running_sums(steps, score, ["pos", "neg"], descending=True).withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp", "pos_all": "n_pos", "neg_all": "n_neg"})
    return s.where("n_pos > 0 and n_neg > 0")


def roc(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Exact ROC AUC of 0/1 labels, equal scores as one step; keys with one class only are left out."""
    s = cumulated(df, keys, score, label)
    area = s.groupBy(*keys).agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    return area.where("n_pos is not null").select(*keys, "n_pos", "n_neg", (F.col("area") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def roc_points(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """threshold, tp, fp, tpr and fpr at each distinct score, from the highest down, and the start at 0, 0 (threshold NULL); keys with one class only are left out."""
    s = cumulated(df, keys, score, label)
    points = s.select(*keys, F.col(score).alias("threshold"), "tp", "fp", (F.col("tp") / F.col("n_pos")).alias("tpr"), (F.col("fp") / F.col("n_neg")).alias("fpr"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("tp", "fp")] + [F.lit(0.0).alias(c) for c in ("tpr", "fpr")]
    # One row for each key, where there are points.
    start = s.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 0").select(*keys, F.lit(None).cast(df.schema[score].dataType).alias("threshold"), *zero)
    return points.unionByName(start)


def lovasz(df: DataFrame, keys: Sequence[str] = ("tile_id",), k: int = 3, weights: Sequence[float] | None = None) -> DataFrame:
    """Lovasz-softmax score: for each class present, errors in descending order times the steps of the Jaccard index; mean over classes.

    df has target, probs and a column ``pixel`` that orders equal errors (which doesn't change the sum).
    """
    one = df.select(*keys, "pixel", F.posexplode("probs").alias("class_id", "p"), "target").where(F.col("class_id") < k)
    one = one.withColumn("fg", (F.col("target") == F.col("class_id")).cast("int")).withColumn("e", F.abs(F.col("fg") - F.col("p")))
    by = [*keys, "class_id"]
    order = Window.partitionBy(*by).orderBy(F.desc("e"), "pixel")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    g = F.sum("fg").over(Window.partitionBy(*by))
    s = one.withColumns({"g": g, "cf": F.sum("fg").over(upto), "cb": F.sum(1 - F.col("fg")).over(upto)}).where("g > 0")
    s = s.withColumn("j", 1 - (F.col("g") - F.col("cf")) / (F.col("g") + F.col("cb")))
    s = s.withColumn("dj", F.col("j") - F.coalesce(F.lag("j").over(order), F.lit(0.0)))
    per = s.groupBy(*by).agg(F.sum(F.col("e") * F.col("dj")).alias("loss"))
    w = F.get(F.array(*[F.lit(float(x)) for x in (weights or [1.0] * k)]), F.col("class_id"))
    return per.groupBy(*keys).agg((F.sum(F.col("loss") * w) / F.sum(w)).alias("lovasz"))
