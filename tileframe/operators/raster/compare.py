"""Comparisons of target and prediction rasters: boundaries, diagnostics, topology, difficulty, features."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.operators.bootstrap import diagnostics_of_sums
from tileframe.operators.raster.components import components, label_runs
from tileframe.operators.raster.distance import distances
from tileframe.operators.raster.filters import filtered, gaussian_kernel, log_of, mean_and_std, sobel_of
from tileframe.operators.raster.tiles import Box, append_by_tile, dilated, edge_of, numbers
from tileframe.operators.storage import materialise

KEY = ["tile_id", "y", "x"]
#: The features of a pixel, in order (fixed names).
FEATURES = ("gray", "gaussian_1", "gaussian_3", "mean_7", "std_7", "mean_31", "std_31", "sobel", "log_1", "distance", "dark_15", "area")


def one_row_by_tile(px: DataFrame, columns: Sequence[str], schema: str, made: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], list[tuple]]) -> DataFrame:
    """tile_id and the rows that made gives for y, x and the columns (as doubles, NULL as NaN) of one whole tile: one shuffle. Pixels without coordinates are left out."""
    kinds = [f.split()[1] for f in schema.split(", ")]
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = made(table.column("y").to_numpy().astype("int64"), table.column("x").to_numpy().astype("int64"), [numbers(table.column(f"_{k}")) for k in range(len(columns))])
        out = [pa.array([r[k] for r in rows], arrow[kind]) for k, kind in enumerate(kinds)]
        return pa.table([pa.repeat(table.column("tile_id")[0], len(rows)), *out], names=["tile_id", *names])

    picked = px.where("y is not null and x is not null").select(*KEY, *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    return picked.groupBy("tile_id").applyInArrow(run, f"tile_id {dict(picked.dtypes)['tile_id']}, {schema}")


def met_boundaries(box: Box, t: np.ndarray, p: np.ndarray, tol: int) -> tuple[int, int, int, int]:
    """Boundary pixels of p, those near the other's, and the same of t, for masks given by pixel."""
    bt, bp = (edge_of(box.spread(m, False)) for m in (t, p))
    k = 2 * tol + 1
    return int(bp.sum()), int((bp & dilated(bt, k)).sum()), int(bt.sum()), int((bt & dilated(bp, k)).sum())


BOUNDARIES = "boundary_pred bigint, boundary_pred_hit bigint, boundary_true bigint, boundary_true_hit bigint"


def boundary_counts(px: DataFrame, class_id: int | None = None, tol: int = 2, target: str = "target", pred: str = "pred") -> DataFrame:
    """Per tile: boundary pixels of each side, and those within Chebyshev distance tol of the other's. class_id None takes both pore classes."""
    of = lambda v: (v == 0) | (v == 1) if class_id is None else v == class_id
    return one_row_by_tile(px, [target, pred], BOUNDARIES, lambda y, x, v: [met_boundaries(Box(y, x), of(v[0]), of(v[1]), tol)])


def boundary_f1(px: DataFrame, class_id: int | None = None, tol: int = 2, target: str = "target", pred: str = "pred") -> DataFrame:
    """precision, recall and f1 of boundaries; all 1 where neither side has one, 0 where only one has."""
    c = boundary_counts(px, class_id, tol, target, pred)
    none = (F.col("boundary_pred") == 0) & (F.col("boundary_true") == 0)
    part = lambda s: F.when(none, 1.0).when(F.col(f"boundary_{s}") == 0, 0.0).otherwise(F.col(f"boundary_{s}_hit") / F.nullif(F.col(f"boundary_{s}"), F.lit(0)))
    c = c.withColumns({"precision": part("pred"), "recall": part("true")})
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0))))


def sizes_of(y: np.ndarray, x: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The sizes of the 8-connected regions of the pixels that are on."""
    return np.unique(label_runs(y[on], x[on], 1), return_counts=True)[1] if on.any() else np.empty(0, "int64")


def tile_statistics(px: DataFrame, tol: int = 2, target: str = "target", pred: str = "pred") -> DataFrame:
    """The sufficient statistics of a tile's diagnostics: areas, C0 regions, largest C1 region, boundary counts. All in one group of the tile."""
    names = ["pixels", "c0_true", "c0_pred", "c1_true", "c1_pred", "components_true", "largest_true", "components_pred", "largest_pred"]

    def made(y: np.ndarray, x: np.ndarray, v: list[np.ndarray]) -> list[tuple]:
        regions = []
        for side in v:
            regions += [len(sizes_of(y, x, side == 0)), int(sizes_of(y, x, side == 1).max(initial=0))]
        t, p = ((side == 0) | (side == 1) for side in v)
        return [(len(y), *[int((side == k).sum()) for k in (0, 1) for side in v], *regions, *met_boundaries(Box(y, x), t, p, tol))]

    return one_row_by_tile(px, [target, pred], ", ".join(f"{n} bigint" for n in names) + ", " + BOUNDARIES, made)


def tile_diagnostics(px: DataFrame, tol: int = 2, target: str = "target", pred: str = "pred") -> DataFrame:
    return diagnostics_of_sums(tile_statistics(px, tol, target, pred), ["tile_id"])


def topology_diff(px: DataFrame, class_id: int, least: int = 10, fragmentation: float = 1.0, connectivity: float = 1.0, target: str = "target", pred: str = "pred") -> DataFrame:
    """Per tile: relative difference of region counts, L1 distance of size histograms (19 bins up to the largest size, density), Euler difference and their combination.

    Without regions in the target the histogram error is 0, with none in the prediction only it is 1.
    """

    def made(y: np.ndarray, x: np.ndarray, v: list[np.ndarray]) -> list[tuple]:
        rows: list[tuple] = [("t", "any", 0), ("p", "any", 0)]
        for side, values in zip("tp", v, strict=True):
            for kind, on in (("fg", values == class_id), ("bg", (values != class_id) & ~np.isnan(values))):
                rows += [(side, kind, int(n)) for n in sizes_of(y, x, on)]
        return rows

    every = materialise(one_row_by_tile(px, [target, pred], "side string, kind string, a bigint", made), "sizes")
    n = lambda side, kind: F.count_if((F.col("side") == side) & (F.col("kind") == kind))
    counts = every.groupBy("tile_id").agg(n("t", "fg").alias("nt"), n("p", "fg").alias("np"), n("t", "bg").alias("bt"), n("p", "bg").alias("bp"))
    big = every.where((F.col("kind") == "fg") & (F.col("a") >= least)).withColumn("top", F.max("a").over(Window.partitionBy("tile_id")))
    bins = big.withColumn("bin", F.least(F.floor(F.col("a") * 19 / F.col("top")), F.lit(18)))
    w = Window.partitionBy("tile_id", "side")
    share = bins.withColumn("m", F.count("*").over(w)).groupBy("tile_id", "bin", "top").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, 1 / (F.col("m") * F.col("top") / 19.0))), F.lit(0.0)).alias(s) for s in ("t", "p")])
    error = share.groupBy("tile_id").agg(F.sum(F.abs(F.col("t") - F.col("p"))).alias("l1"), F.sum("t").alias("st"), F.sum("p").alias("sp"))
    out = counts.join(error, "tile_id", "left").fillna(0)
    out = out.withColumn("component_diff", F.abs(F.col("np") - F.col("nt")) / F.greatest(F.col("nt"), F.lit(1)))
    out = out.withColumn("size_error", F.when(F.col("st") == 0, 0.0).when(F.col("sp") == 0, 1.0).otherwise(F.col("l1")))
    out = out.withColumn("euler_diff", F.abs((F.col("np") - F.col("bp")) - (F.col("nt") - F.col("bt"))))
    return out.select("tile_id", F.col("nt").alias("regions_true"), F.col("np").alias("regions_pred"), "component_diff", "size_error", "euler_diff", (fragmentation * F.col("component_diff") + connectivity * F.col("size_error")).alias("connectivity_score"))


def difficulty(px: DataFrame, label: str = "target", small: int = 100) -> DataFrame:
    """Difficulty of a tile from 0 to 1: density, imbalance, disconnected share, pixels with a gradient, share of small C0 regions."""
    def gradient(axis: str) -> Column:
        w = Window.partitionBy("tile_id", "x" if axis == "y" else "y").orderBy(axis)
        a, b = F.lag(label).over(w), F.lead(label).over(w)
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - F.col(label)).when(b.isNull(), F.col(label) - a).otherwise((b - a) / 2.0)

    p = px.withColumns({"_gy": gradient("y"), "_gx": gradient("x")})
    c = [F.count_if(F.col(label) == k) for k in range(3)]
    s = p.groupBy("tile_id").agg(F.count("*").alias("n"), *[x.alias(f"c{k}") for k, x in enumerate(c)], F.count_if((F.col("_gy") != 0) | (F.col("_gx") != 0)).alias("g"))
    shares = [F.col(f"c{k}") / F.col("n") for k in range(3)]
    mean = (shares[0] + shares[1] + shares[2]) / 3
    deviation = F.sqrt(((shares[0] - mean) ** 2 + (shares[1] - mean) ** 2 + (shares[2] - mean) ** 2) / 3)
    few = components(px.select(*KEY, (F.col(label) == 0).alias("mask"))).groupBy("tile_id", "region_id").agg(F.count("*").alias("a")).groupBy("tile_id").agg((F.count_if(F.col("a") < small) / F.count("*")).alias("few"))
    pores = F.col("c0") + F.col("c1")
    out = s.join(few, "tile_id", "left").select(
        "tile_id", (pores / F.col("n")).alias("pore_density"), F.when((F.col("c0") > 0) & (F.col("c1") > 0) & (F.col("c2") > 0), deviation * 3).otherwise(1.0).alias("class_imbalance"),
        F.coalesce(F.col("c0") / F.nullif(pores, F.lit(0)), F.lit(0.0)).alias("disconnected_ratio"), (F.col("g") / F.col("n")).alias("boundary_complexity"), F.coalesce("few", F.lit(0.0)).alias("small_component_ratio"),
    )
    total = 0.15 * F.col("pore_density") + 0.25 * F.col("class_imbalance") + 0.2 * F.col("disconnected_ratio") + 0.2 * F.col("boundary_complexity") + 0.2 * F.col("small_component_ratio")
    return out.withColumn("difficulty", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


#: The difficulty percentiles of the stages of a curriculum.
PERCENTILES = (0.3, 0.6, 0.9, 1.0)


def curriculum_percentile(epoch: int, epochs: int, warmup: int, strategy: str = "progressive", percentiles: Sequence[float] = PERCENTILES) -> float | None:
    """The percentile of difficulty that is admitted at an epoch: the first in the warm-up, then one after the other. Without a strategy, NULL: all below 1."""
    if strategy not in ("progressive", "staged", "none"):
        raise ValueError("strategy is progressive, staged or none")
    last = len(percentiles) - 1
    if epoch < warmup:
        return percentiles[0]
    if strategy == "progressive":
        return percentiles[min(last, (epoch - warmup) * len(percentiles) // (epochs - warmup))]
    if strategy == "staged":
        return percentiles[min(last, (epoch - warmup) // ((epochs - warmup) // len(percentiles)))]
    return None


def curriculum(samples: DataFrame, difficulties: DataFrame, epoch: int, epochs: int, warmup: int = 5, strategy: str = "progressive") -> DataFrame:
    """Samples up to the epoch's difficulty, with weight 1 - difficulty / 2 in the warm-up and 1 + difficulty * progress after it; samples of unknown difficulty stay, with weight 1."""
    q = curriculum_percentile(epoch, epochs, warmup, strategy)
    limit = difficulties.agg((F.percentile("difficulty", F.lit(q)) if q is not None else F.lit(1.0)).alias("_limit"))
    j = samples.join(difficulties.select("tile_id", "difficulty"), "tile_id", "left").join(F.broadcast(limit))
    weight = 1 - F.col("difficulty") / 2 if epoch < warmup else 1 + F.col("difficulty") * ((epoch - warmup) / (epochs - warmup))
    return j.where(F.col("difficulty").isNull() | (F.col("difficulty") <= F.col("_limit"))).withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("_limit")


def features(px: DataFrame, t: int = 100, keep: Sequence[str] = ()) -> DataFrame:
    """tile_id, y, x, v, the columns ``keep`` and FEATURES of each pixel, all in one group of the tile; distance is scaled by the tile's diagonal (and is that in a tile that
    is all gate) and area by its size, both log1p, 0 outside the gate. Pixels without a value or coordinates have NULL features and don't count."""

    def made(y: np.ndarray, x: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        v = numbers(table.column("v"))
        g, g1, g3, gate, box = v / 255.0, gaussian_kernel(1), gaussian_kernel(3), v < t, Box(y, x)
        mean7, std7 = mean_and_std(g, y, x, 7)
        mean31, std31 = mean_and_std(g, y, x, 31)
        diagonal = math.hypot(y.max() + 1, x.max() + 1)
        away = np.nan_to_num(distances(box, gate), nan=diagonal)
        area = np.zeros(len(v))
        if gate.any():
            _, region, size = np.unique(label_runs(y[gate], x[gate], 1), return_inverse=True, return_counts=True)
            area[gate] = np.log1p(size[region]) / math.log1p(len(v))
        return dict(zip(FEATURES, (
            g, filtered(g, y, x, g1, g1), filtered(g, y, x, g3, g3), mean7, std7, mean31, std31, sobel_of(g, y, x), log_of(g, y, x, 1.0),
            np.log1p(away) / math.log1p(diagonal), filtered(gate.astype("float64"), y, x, [1 / 15] * 15, [1 / 15] * 15), area,
        ), strict=True))

    return append_by_tile(px.select(*KEY, "v", *keep), dict.fromkeys(FEATURES, "double"), made, needs=["v"])


def features_are_finite(f: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Pixels with a feature that is NULL or not finite."""
    bad = F.lit(False)
    for n in names:
        bad = bad | F.col(n).isNull() | F.isnan(n) | (F.abs(n) == math.inf)
    return f.where(bad)
