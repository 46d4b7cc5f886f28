"""Deterministic samples, splits and tree ensembles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.operators.extratrees import ExtraTrees, fit_extra_trees, predict, predict_left_out
from tileframe.operators.metrics import confusion, group_metrics
from tileframe.operators.ranks import ranked_by_hash


def draw_key(seed: int, *cols: str) -> Column:
    """The md5 of seed and columns: the same order in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def stratified_sample(df: DataFrame, n: int, seed: int, strata: Sequence[str] = ("tile_id", "target"), pixel: Sequence[str] = ("y", "x")) -> DataFrame:
    """At most n rows of each stratum without replacement, with weight N / n. A stratum is a tile's class, so its size is bounded by the tile."""
    # Counted apart, so that the ranked side can be cut before it is shuffled.
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(draw_key(seed, *strata, *pixel), *pixel))
    kept = df.withColumn("_r", rank).where(F.col("_r") <= n)
    return kept.join(sizes, list(strata)).withColumn("weight", F.col("_n") / F.least(F.col("_n"), F.lit(n))).select(*df.columns, "weight")


def random_split(images: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42, unit: str = "id") -> DataFrame:
    """unit and split: whole units (images or series) in hash order, rounded shares with at least one each for val and test, the rest for train."""
    u = images.select(unit).distinct()
    r = ranked_by_hash(u, draw_key(seed, unit), [unit])
    a, b = F.greatest(F.lit(1), F.round(F.col("_t") * test)), F.greatest(F.lit(1), F.round(F.col("_t") * val))
    return r.select(unit, F.when(F.col("_k") <= a, "test").when(F.col("_k") <= a + b, "val").otherwise("train").alias("split"))


def assemble_samples(px: DataFrame, n: int, seed: int, t: int = 100, evaluation: bool = False) -> DataFrame:
    """In-gate C0 and C1 samples with weights; for evaluation, in-gate C2 as well."""
    inside = px.where((F.col("v") < t) & F.col("target").isin(*((0, 1, 2) if evaluation else (0, 1))))
    return stratified_sample(inside, n, seed)


def fit_forest(df: DataFrame, features: Sequence[str], label: str = "target", weight: str | None = "weight", trees: int = 128, depth: int = 24, leaf: int = 8, seed: int = 20260821, leave_out: str | None = None) -> ExtraTrees:
    """Extremely randomised trees with balanced class weights, square-root features and no bootstrap."""
    return fit_extra_trees(df, features, label, weight, trees, depth, leaf, seed, leave_out=leave_out)


def predict_gated(model: ExtraTrees, px: DataFrame, t: int = 100) -> DataFrame:
    """pred: the model's class inside the gate, mineral outside (and where v is NULL). px has v and the model's features."""
    inside = F.coalesce(F.col("v") < t, F.lit(False))
    sure = F.when(F.col("pred").isin(0, 1), F.col("pred")).otherwise(F.raise_error(F.lit("only pore classes may be predicted inside the gate")).cast("int"))
    return predict(model, px, "pred", only=inside).withColumn("pred", F.when(inside, sure).otherwise(F.lit(2)))


def group_cv(df: DataFrame, group: str, features: Sequence[str], label: str = "target", weight: str = "weight", **forest) -> tuple[DataFrame, DataFrame]:
    """Leave-one-group-out: weighted confusion of each fold, and the mean metrics. The forests of all folds grow in the same passes."""
    scored = predict_left_out(df, group, features, label, weight, **forest).where("pred is not null")
    cm = confusion(scored, [group], 3, label, "pred", weight=weight)
    return cm, group_metrics(cm, group)


def score_patches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A caller's function on Arrow batches of patches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)
