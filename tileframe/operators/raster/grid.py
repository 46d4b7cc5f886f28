"""Patch grids, cutting and stitching, and crops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.operators.pairing import assign_patches
from tileframe.operators.raster.tiles import Box, summed


def axis_positions(length: Column, patch: int, overlap: int = 0) -> Column:
    """Starts 0, s, 2s, ... with the last at length - patch; an error where the patch or the overlap is too large."""
    if overlap >= patch or overlap < 0 or patch < 1:
        raise ValueError("overlap must be at least 0 and below the patch size")
    last = length - patch
    steps = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(patch - overlap)), last))
    return F.when(last >= 0, steps).otherwise(F.raise_error(F.concat(F.lit(f"patch {patch} exceeds length "), length.cast("string"))).cast("array<int>"))


def patch_grid(images: DataFrame, patch: int, overlap: int = 0, repeat: int = 1) -> DataFrame:
    """tile_id, patch_id (<tile>_<row>_<col>), row, col, y0, x0, y1, x1, and copy for each of ``repeat`` passes; images has height and width."""
    rows = images.select("tile_id", "width", F.posexplode(axis_positions(F.col("height").cast("int"), patch, overlap)).alias("row", "y0"))
    cells = rows.select("tile_id", "row", "y0", F.posexplode(axis_positions(F.col("width").cast("int"), patch, overlap)).alias("col", "x0"))
    out = cells.select("tile_id", F.concat_ws("_", F.col("tile_id").cast("string"), F.col("row").cast("string"), F.col("col").cast("string")).alias("patch_id"), "row", "col", "y0", "x0", (F.col("y0") + patch).alias("y1"), (F.col("x0") + patch).alias("x1"))
    return out if repeat == 1 else out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))


def cut(px: DataFrame, patches: DataFrame) -> DataFrame:
    """Pixels of patches with their place in the patch, py and px."""
    return assign_patches(px, patches).withColumns({"py": F.col("y") - F.col("y0"), "px": F.col("x") - F.col("x0")})


def stitch(df: DataFrame, value: str = "value") -> DataFrame:
    """One value for each pixel of the tile: of overlapping patches the later in row-major order."""
    return df.groupBy("tile_id", "y", "x").agg(F.max_by(value, F.struct("patch_row", "patch_col")).alias(value))


def smart_crop(px: DataFrame, size: int, threshold: float, minority: int = 0, label: str = "target") -> DataFrame:
    """tile_id, y0, x0, ratio: the window (stride size // 4) richest in the minority class, first on a tie; below the threshold one by hash.

    Windows are counted by four look-ups in the tile's summed-area table: one pass over its pixels.
    """
    stride = max(1, size // 4)

    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy().astype("int64") for c in ("y", "x"))
        box, minor = Box(y, x), table.column("m").to_numpy(zero_copy_only=False).astype("int64")
        starts = [np.arange(0, n + low - size + 1, stride) for n, low in zip(box.shape, (box.y0, box.x0), strict=True)]
        ends = [(np.clip(s - low, 0, n), np.clip(s - low + size, 0, n)) for s, n, low in zip(starts, box.shape, (box.y0, box.x0), strict=True)]

        def counted(dense: np.ndarray) -> np.ndarray:
            area = summed(dense)
            (a, b), (c, d) = ends
            return area[np.ix_(b, d)] - area[np.ix_(a, d)] - area[np.ix_(b, c)] + area[np.ix_(a, c)]

        n, i = counted(box.spread(minor)), np.nonzero(counted(box.spread(np.ones(len(y), "int64"))))
        columns = [pa.array(starts[0][i[0]]), pa.array(starts[1][i[1]]), pa.array(n[i] / float(size * size))]
        return pa.table([pa.repeat(table.column("tile_id")[0], len(i[0])), *columns], names=["tile_id", "y0", "x0", "ratio"])

    picked = px.where("y is not null and x is not null").select("tile_id", "y", "x", F.coalesce(F.col(label) == minority, F.lit(False)).cast("int").alias("m"))
    w = picked.groupBy("tile_id").applyInArrow(run, f"tile_id {dict(picked.dtypes)['tile_id']}, y0 bigint, x0 bigint, ratio double")
    best = Window.partitionBy("tile_id").orderBy(F.desc("ratio"), "y0", "x0")
    drawn = Window.partitionBy("tile_id").orderBy(F.md5(F.concat_ws(":", F.col("tile_id").cast("string"), "y0", "x0").cast("binary")))
    w = w.withColumns({"_b": F.row_number().over(best), "_d": F.row_number().over(drawn), "_m": F.max("ratio").over(Window.partitionBy("tile_id"))})
    return w.where(F.when(F.col("_m") >= threshold, F.col("_b")).otherwise(F.col("_d")) == 1).select("tile_id", "y0", "x0", "ratio")
