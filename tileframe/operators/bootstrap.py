"""Whole-tile percentile bootstraps from sufficient statistics; pixels are never read again.

``by="splits"``: draws are counted by seeded binomials where the tiles are (``resampling``), and no draw is a row: for any number of tiles.
``by="hash"``: replicate r draws tile ``md5(seed:r:slot) mod T`` for each of T slots, which SQL can repeat; it makes replicates x T rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileframe.operators.metrics import class_metrics, summary_metrics
from tileframe.operators.ranks import ranked_by_value
from tileframe.operators.resampling import replicate_sums


def numbered(tiles: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Tiles with numbers from 0 in order: one row per tile, not per pixel."""
    return ranked_by_value(tiles.select(tile).distinct(), tile).select(tile, (F.col("_k") - 1).alias("k"))


def draws(tiles: DataFrame, reps: int, seed: int, tile: str = "tile_id") -> DataFrame:
    """rep, tile and times drawn."""
    order = numbered(tiles, tile)
    total = order.agg(F.count("*").alias("t"))
    slots = tiles.sparkSession.range(reps).select(F.col("id").alias("rep")).join(F.broadcast(total)).withColumn("slot", F.explode(F.expr("sequence(0, t - 1)"))).where("t > 0")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string")).cast("binary"))
    pick = F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint") % F.col("t")
    return slots.groupBy("rep", pick.alias("k")).agg(F.count("*").alias("times")).join(order, "k").select("rep", tile, "times")


def resampled(df: DataFrame, reps: int, seed: int, keys: Sequence[str], values: Sequence[str], tile: str, by: str) -> DataFrame:
    """keys, rep and the sums of values over each replicate's tiles."""
    if by == "splits":
        return replicate_sums(df, reps, seed, keys, values, tile)
    if by != "hash":
        raise ValueError("draws are made by splits or by hash")
    return df.join(draws(df, reps, seed, tile), tile).groupBy(*keys, "rep").agg(*[F.sum(F.col(v) * F.col("times")).alias(v) for v in values])


def interval(value: str, conf: float) -> list[Column]:
    """Linear-interpolated percentiles of the finite values, their number, and the number of replicates."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    a = (1 - conf) / 2
    return [F.percentile(v, F.lit(a)).alias("low"), F.percentile(v, F.lit(1 - a)).alias("high"), F.count(v).alias("n_finite"), F.count("*").alias("n_reps")]


def replicate_metrics(cm: DataFrame, reps: int, seed: int, keys: Sequence[str], tile: str = "tile_id", k: int = 3, by: str = "splits") -> DataFrame:
    """Tidy metrics (keys, rep, class_id or -1 for summaries, metric, value) of each replicate's summed matrix."""
    sums = resampled(cm, reps, seed, [*keys, "true_id", "pred_id"], ["n"], tile, by)
    m = class_metrics(sums, [*keys, "rep"], k)
    names = ("iou", "dice", "precision", "recall")
    per = m.select(*keys, "rep", "class_id", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])).alias("x")).select(*keys, "rep", "class_id", "x.*")
    tops = ("macro_iou", "accuracy", "harmonic_iou")
    s = summary_metrics(m, [*keys, "rep"])
    s = s.select(*keys, "rep", F.lit(-1).alias("class_id"), F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in tops])).alias("x")).select(*keys, "rep", "class_id", "x.*")
    return per.unionByName(s)


def bootstrap(cm: DataFrame, reps: int = 5000, seed: int = 20260820, conf: float = 0.95, keys: Sequence[str] = (), tile: str = "tile_id", by: str = "splits") -> DataFrame:
    """low, high, n_finite and n_reps of each metric of confusion counts by tile."""
    r = replicate_metrics(cm, reps, seed, keys, tile, by=by)
    return r.groupBy(*keys, "class_id", "metric").agg(*interval("value", conf))


def paired_bootstrap(cm: DataFrame, reference: str, reps: int = 5000, seed: int = 20260820, conf: float = 0.95, tile: str = "tile_id", by: str = "splits") -> DataFrame:
    """Intervals of reference less method under shared draws; cm has method_id and seed (NULL for methods without one).

    Seeded methods are paired by seed and averaged within the replicate; others meet the reference's mean. An interval is given only where
    every replicate is defined.
    """
    r = replicate_metrics(cm, reps, seed, ["method_id", "seed"], tile, by=by)
    ref = r.where(F.col("method_id") == reference)
    on = ["rep", "class_id", "metric"]
    means = ref.groupBy(*on).agg(F.when(F.count("*") == F.count("value"), F.avg("value")).alias("ref"))
    others = r.where(F.col("method_id") != reference)
    seeded = others.where("seed is not null").join(ref.select(*on, "seed", F.col("value").alias("ref")), [*on, "seed"])
    plain = others.where("seed is null").join(means, on)
    both = seeded.select("method_id", *on, "value", "ref").unionByName(plain.select("method_id", *on, "value", "ref")).withColumn("d", F.col("ref") - F.col("value"))
    per = both.groupBy("method_id", *on).agg(F.when(F.count("*") == F.count("d"), F.avg("d")).alias("d"))
    out = per.groupBy("method_id", "class_id", "metric").agg(*interval("d", conf))
    whole = F.col("n_finite") == F.col("n_reps")
    return out.withColumns({"low": F.when(whole, F.col("low")), "high": F.when(whole, F.col("high"))})


STATISTICS = ("pixels", "c0_true", "c0_pred", "c1_true", "c1_pred", "largest_true", "largest_pred", "components_true", "components_pred", "boundary_pred", "boundary_pred_hit", "boundary_true", "boundary_true_hit")


def diagnostics_of_sums(s: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area fractions, largest-component share of C1, C0 components per megapixel and boundary scores from summed statistics, with errors.

    With no boundary on either side the boundary scores are 1, with one side empty 0.
    """
    share = lambda n, d: F.col(n) / F.nullif(F.col(d).cast("double"), F.lit(0.0))
    out = s
    for side in ("true", "pred"):
        out = out.withColumns({f"c0_area_{side}": share(f"c0_{side}", "pixels"), f"c1_area_{side}": share(f"c1_{side}", "pixels"), f"largest_share_{side}": share(f"largest_{side}", f"c1_{side}"), f"per_megapixel_{side}": F.col(f"components_{side}") * 1e6 / F.col("pixels")})
    none = (F.col("boundary_pred") == 0) & (F.col("boundary_true") == 0)
    part = lambda side: F.when(none, 1.0).when(F.col(f"boundary_{side}") == 0, 0.0).otherwise(share(f"boundary_{side}_hit", f"boundary_{side}"))
    out = out.withColumns({"boundary_precision": part("pred"), "boundary_recall": part("true")})
    p, r = F.col("boundary_precision"), F.col("boundary_recall")
    out = out.withColumn("boundary_f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0))))
    names = ("c0_area", "c1_area", "largest_share", "per_megapixel")
    out = out.withColumns({f"{x}_error": F.col(f"{x}_pred") - F.col(f"{x}_true") for x in names})
    out = out.withColumns({f"{x}_abs_error": F.abs(f"{x}_error") for x in names})
    return out.select(*keys, *[f"{x}_{e}" for x in names for e in ("error", "abs_error")], "boundary_precision", "boundary_recall", "boundary_f1")


def pool_diagnostics(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled secondary diagnostics; tiles has STATISTICS for each tile."""
    return diagnostics_of_sums(tiles.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in STATISTICS]), keys)


def bootstrap_diagnostics(tiles: DataFrame, reps: int = 5000, seed: int = 20260820, conf: float = 0.95, tile: str = "tile_id", by: str = "splits") -> DataFrame:
    s = resampled(tiles, reps, seed, [], STATISTICS, tile, by)
    m = diagnostics_of_sums(s, ["rep"])
    names = [c for c in m.columns if c != "rep"]
    long = m.select("rep", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])).alias("x")).select("rep", "x.*")
    return long.groupBy("metric").agg(*interval("value", conf))
