"""Offline augmentation of pixel tables; every choice is drawn from a hash, so that results repeat."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.functions.beta import beta_from_uniform
from tileframe.operators.ranks import ranked_by_hash
from tileframe.operators.raster.components import components

KEY = ["tile_id", "y", "x"]


def digest(seed: int, *cols: str | Column) -> Column:
    """Twelve hexadecimal digits of a hash of seed and columns."""
    key = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.substring(F.md5(key.cast("binary")), 1, 12)


def draw(seed: int, *cols: str | Column) -> Column:
    """A uniform number from 0 to 1 of seed and columns."""
    return F.conv(digest(seed, *cols), 16, 10).cast("bigint") / float(1 << 48)


def extent(px: DataFrame) -> DataFrame:
    return px.groupBy("tile_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def symmetry(px: DataFrame, k: Column) -> DataFrame:
    """One of the eight symmetries: k // 2 quarter turns, then a flip if k is odd."""
    p = px.join(extent(px), "tile_id").withColumn("_k", k)
    turns = F.floor(F.col("_k") / 2)
    y = F.when(turns == 0, F.col("y")).when(turns == 1, F.col("w") - 1 - F.col("x")).when(turns == 2, F.col("h") - 1 - F.col("y")).otherwise(F.col("x"))
    x = F.when(turns == 0, F.col("x")).when(turns == 1, F.col("y")).when(turns == 2, F.col("w") - 1 - F.col("x")).otherwise(F.col("h") - 1 - F.col("y"))
    width = F.when(turns % 2 == 1, F.col("h")).otherwise(F.col("w"))
    flipped = F.when(F.col("_k") % 2 == 1, width - 1 - x).otherwise(x)
    return p.select("tile_id", y.cast("int").alias("y"), flipped.cast("int").alias("x"), *[c for c in px.columns if c not in KEY])


def augment_symmetry(px: DataFrame, seed: int) -> DataFrame:
    return symmetry(px, F.floor(draw(seed, "tile_id") * 8))


def pairs(px: DataFrame, seed: int) -> DataFrame:
    """Each tile with the next in hash order of the same size, the last with the first: one row per tile."""
    e = ranked_by_hash(extent(px), digest(seed, "tile_id"), ["tile_id"], ["h", "w"])
    following = e.select(F.col("tile_id").alias("other"), "h", "w", F.col("_k").alias("_next"))
    return e.withColumn("_next", F.col("_k") % F.col("_t") + 1).join(following, ["h", "w", "_next"]).select("tile_id", "other", "h", "w")


def _joined(px: DataFrame, seed: int) -> DataFrame:
    b = px.select(F.col("tile_id").alias("other"), "y", "x", F.col("v").alias("v2"), F.col("target").alias("t2"))
    # Ragged tiles: a pixel without a partner meets itself.
    j = px.join(pairs(px, seed), "tile_id").join(b, ["other", "y", "x"], "left")
    alone = F.col("t2").isNull() & F.col("v2").isNull()
    return j.withColumns({"v2": F.when(alone, F.col("v")).otherwise(F.col("v2")), "t2": F.when(alone, F.col("target")).otherwise(F.col("t2"))})


def _with_share(p: DataFrame, px: DataFrame, seed: int, lam: float | None, alpha: float) -> DataFrame:
    """Adds lam: the given share, or one for each pair from a beta distribution of twice alpha, told by a hash (one row a tile)."""
    if lam is not None:
        return p.withColumn("lam", F.lit(float(lam)))
    shares = px.select("tile_id").distinct().select("tile_id", beta_from_uniform(draw(seed, F.lit("lam"), "tile_id"), alpha, alpha).alias("lam"))
    return p.join(shares, "tile_id")


def mixup(px: DataFrame, seed: int, lam: float | None = None, minority: int | None = None, alpha: float = 1.0) -> DataFrame:
    """v mixed as lam * a + (1 - lam) * b, target of the heavier side (the second at one half), and lam; with a minority class, its pixels in either tile stay as they are."""
    p = _with_share(_joined(px, seed), px, seed, lam, alpha)
    lam = F.col("lam")
    v, t = lam * F.col("v") + (1 - lam) * F.col("v2"), F.when(lam > 0.5, F.col("target")).otherwise(F.col("t2"))
    if minority is not None:
        v = F.when(F.col("target") == minority, F.col("v").cast("double")).when(F.col("t2") == minority, F.col("v2").cast("double")).otherwise(v)
        t = F.when(F.col("target") == minority, F.col("target")).when(F.col("t2") == minority, F.col("t2")).otherwise(t)
    return p.select("tile_id", "other", "y", "x", v.alias("v"), t.alias("target"), "lam")


def cutmix(px: DataFrame, seed: int, lam: float | None = None, alpha: float = 1.0) -> DataFrame:
    """A hash-placed rectangle of about (1 - lam) of the tile comes from the paired tile; lam becomes the share that is left of the tile's own."""
    p = _with_share(_joined(px, seed), px, seed, lam, alpha)
    side = F.sqrt(1 - F.col("lam"))
    p = p.withColumns({"_rh": F.floor(F.col("h") * side), "_rw": F.floor(F.col("w") * side)})
    p = p.withColumns({"_y0": F.floor(draw(seed, F.lit("y"), "tile_id") * (F.col("h") - F.col("_rh") + 1)), "_x0": F.floor(draw(seed, F.lit("x"), "tile_id") * (F.col("w") - F.col("_rw") + 1))})
    inside = (F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y0") + F.col("_rh")) & (F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x0") + F.col("_rw"))
    left = 1 - F.col("_rh") * F.col("_rw") / (F.col("h") * F.col("w")).cast("double")
    return p.select("tile_id", "other", "y", "x", F.when(inside, F.col("v2")).otherwise(F.col("v")).alias("v"), F.when(inside, F.col("t2")).otherwise(F.col("target")).alias("target"), left.alias("lam"))


def mosaic(px: DataFrame, size: int, seed: int, minority: int = 0) -> DataFrame:
    """Four tiles at a time in hash order as quadrants of a size x size tile, richest in the minority first, nearest neighbour. A last group of fewer is filled up from the first tiles; fewer than four tiles in all leave quadrants empty."""
    half = size // 2
    e = px.groupBy("tile_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count_if(F.col("target") == minority).alias("m"))
    e = ranked_by_hash(e, digest(seed, "tile_id"), ["tile_id"]).withColumn("mosaic_id", F.floor((F.col("_k") - 1) / 4))
    # The first tiles in hash order fill up a last group of fewer than four.
    spare = F.when((F.col("_t") % 4 > 0) & (F.col("_k") <= F.pmod(-F.col("_t"), F.lit(4))), F.floor((F.col("_t") - 1) / 4))
    e = e.withColumn("mosaic_id", F.explode(F.array_distinct(F.array_compact(F.array("mosaic_id", spare)))))
    e = e.withColumn("q", F.row_number().over(Window.partitionBy("mosaic_id").orderBy(F.desc("m"), "tile_id")) - 1)
    side = F.sequence(F.lit(0), F.lit(half - 1))
    out = e.withColumn("oy", F.explode(side)).withColumn("ox", F.explode(side))
    out = out.select("mosaic_id", "tile_id", (F.col("oy") + F.floor(F.col("q") / 2) * half).cast("int").alias("my"), (F.col("ox") + F.col("q") % 2 * half).cast("int").alias("mx"), F.floor(F.col("oy") * F.col("h") / half).cast("int").alias("y"), F.floor(F.col("ox") * F.col("w") / half).cast("int").alias("x"))
    return out.join(px, KEY).select("mosaic_id", F.col("my").alias("y"), F.col("mx").alias("x"), "tile_id", "v", "target")


def grid_mask(px: DataFrame, cell: int, share: float, seed: int, minority: int = 0) -> DataFrame:
    """v is 0 in hash-chosen cells that hold no pixel of the minority class."""
    c = [F.floor(F.col("y") / cell), F.floor(F.col("x") / cell)]
    rare = F.max((F.col("target") == minority).cast("int")).over(Window.partitionBy("tile_id", *c))
    gone = (draw(seed, "tile_id", *c) < share) & (rare == 0)
    return px.withColumn("_gone", gone).withColumn("v", F.when(F.col("_gone"), F.lit(0).cast(px.schema["v"].dataType)).otherwise(F.col("v"))).withColumn("masked", F.col("_gone")).drop("_gone")


def copy_paste(px: DataFrame, seed: int, minority: int = 0) -> DataFrame:
    """Each region of the minority class is copied to a hash-chosen offset if it stays in the tile and covers no pixel of the class; of
    overlapping copies the one of the lower region id stays on top."""
    c = components(px.select(*KEY, "v", "target", (F.col("target") == minority).alias("mask"))).join(extent(px), "tile_id")
    moved = c.withColumns({"ny": (F.col("y") + F.floor((draw(seed, F.lit("y"), "tile_id", "region_id") - 0.5) * F.col("h"))).cast("int"), "nx": (F.col("x") + F.floor((draw(seed, F.lit("x"), "tile_id", "region_id") - 0.5) * F.col("w"))).cast("int")})
    taken = px.where(F.col("target") == minority).select("tile_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.lit(True).alias("_taken"))
    free = moved.join(px.select("tile_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.lit(True).alias("_there")), ["tile_id", "ny", "nx"], "left").join(taken, ["tile_id", "ny", "nx"], "left")
    bad = free.where(F.col("_taken").isNotNull() | F.col("_there").isNull()).select("tile_id", "region_id").distinct()
    good = free.join(bad, ["tile_id", "region_id"], "left_anti").groupBy("tile_id", F.col("ny").alias("y"), F.col("nx").alias("x")).agg(F.min_by(F.struct("v", "target"), "region_id").alias("_new"))
    out = px.join(good, KEY, "left")
    return out.withColumns({"v": F.coalesce(F.col("_new.v"), F.col("v")), "target": F.coalesce(F.col("_new.target"), F.col("target")), "pasted": F.col("_new").isNotNull()}).drop("_new")


def augment_tiles(px: DataFrame, augmentor: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """A caller's augmentor on each tile: a pandas frame of its pixels in row order to one of any pixels, by default with the same columns.

    A tile is one group. Columns that the augmentor adds have to be in ``schema``.
    """

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        return augmentor(tile.sort_values(["y", "x"], ignore_index=True))

    return px.groupBy("tile_id").applyInPandas(run, schema or px.schema)
