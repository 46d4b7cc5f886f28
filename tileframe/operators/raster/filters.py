"""Separable filters with half-sample reflection, and binary morphology, on pixel tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.operators.raster.tiles import Box, append_by_tile, closed, dilated, edge_of, eroded, flags, numbers, square_extremes

#: Common kernels, lists centred on their middle (fixed values).
SOBEL_SMOOTH = (1.0, 2.0, 1.0)
SOBEL_STEP = (-1.0, 0.0, 1.0)


def gaussian_kernel(sigma: float, order: int = 0) -> list[float]:
    """Truncated at floor(4 sigma + 1/2); order 2 is the second derivative."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    total = sum(w)
    w = [x / total for x in w]
    return w if order == 0 else [x * (d * d / sigma**4 - 1 / sigma**2) for d, x in zip(range(-r, r + 1), w, strict=True)]


def lines(at: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of pixels by line and place (0, 1, ... in each), and for each pixel in that order where its line starts and how long it is."""
    order = np.lexsort([along, at])
    n = np.unique(at, return_counts=True)[1]
    return order, np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)


def weighed(values: np.ndarray, at: np.ndarray, along: np.ndarray, kernel: Sequence[float]) -> np.ndarray:
    """Each pixel's kernel sum along its line, which is reflected at either end (edge pixels twice), again and again where the kernel is longer."""
    order, start, n = lines(at, along)
    place, ordered, total = np.arange(len(values)) - start, values[order], np.zeros(len(values))
    for d, w in enumerate(kernel, -(len(kernel) // 2)):
        if w:
            to = (place + d) % (2 * n)
            total += w * ordered[start + np.minimum(to, 2 * n - 1 - to)]
    out = np.empty(len(values))
    out[order] = total
    return out


def filtered(values: np.ndarray, y: np.ndarray, x: np.ndarray, kx: Sequence[float], ky: Sequence[float]) -> np.ndarray:
    """Along rows, then along columns."""
    return weighed(weighed(values, y, x, kx), x, y, ky)


def by_tile(px: DataFrame, columns: dict[str, Column], made: Callable[..., dict[str, np.ndarray]], band: int | None = None, halo: int = 0) -> DataFrame:
    """tile_id, y, x and what ``made`` gives, as doubles, for y, x and the columns of one whole tile (or a band of it, ``append_by_tile``).

    A pixel without one of the values is as if it weren't there, and has NULL results.
    """
    picked = px.select("tile_id", "y", "x", *[c.cast("double").alias(f"_{n}") for n, c in columns.items()])
    picked = picked.withColumns({f"_{n}": F.nullif(F.col(f"_{n}"), F.lit(float("nan"))) for n in columns})
    names = [f"_{n}" for n in columns]
    outs = made(np.zeros(1, "int64"), np.zeros(1, "int64"), *[np.zeros(1)] * len(names))  # the names
    run = lambda y, x, t: made(y, x, *[numbers(t.column(n)) for n in names])
    return append_by_tile(picked, dict.fromkeys(outs, "double"), run, band=band, halo=halo, needs=names).select("tile_id", "y", "x", *outs)


def convolve(px: DataFrame, kx: Sequence[float], ky: Sequence[float], value: str = "v", band: int | None = None) -> DataFrame:
    """tile_id, y, x and the filtered value. Ragged lines reflect at their own end, and again where kernels are longer.

    band: so many rows of a tile are a group's, beside a halo of the kernel's reach; columns must have no gaps then.
    """
    return by_tile(px, {value: F.col(value)}, lambda y, x, v: {value: filtered(v, y, x, kx, ky)}, band, len(ky) // 2)


def box_mean(px: DataFrame, size: int, value: str = "v", band: int | None = None) -> DataFrame:
    return convolve(px, [1 / size] * size, [1 / size] * size, value, band)


def gaussian(px: DataFrame, sigma: float, value: str = "v", band: int | None = None) -> DataFrame:
    k = gaussian_kernel(sigma)
    return convolve(px, k, k, value, band)


def sobel_of(v: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.hypot(filtered(v, y, x, SOBEL_STEP, SOBEL_SMOOTH), filtered(v, y, x, SOBEL_SMOOTH, SOBEL_STEP))


def log_of(v: np.ndarray, y: np.ndarray, x: np.ndarray, sigma: float) -> np.ndarray:
    g, d = gaussian_kernel(sigma), gaussian_kernel(sigma, 2)
    return filtered(v, y, x, d, g) + filtered(v, y, x, g, d)


def mean_and_std(v: np.ndarray, y: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    box = [1 / size] * size
    mean, square = filtered(v, y, x, box, box), filtered(v * v, y, x, box, box)
    return mean, np.sqrt(np.maximum(square - mean * mean, 0.0))


def sobel(px: DataFrame, value: str = "v", band: int | None = None) -> DataFrame:
    """sobel: the gradient magnitude."""
    return by_tile(px, {"v": F.col(value)}, lambda y, x, v: {"sobel": sobel_of(v, y, x)}, band, 1)


def laplacian_of_gaussian(px: DataFrame, sigma: float = 1.0, value: str = "v", band: int | None = None) -> DataFrame:
    return by_tile(px, {"v": F.col(value)}, lambda y, x, v: {"log": log_of(v, y, x, sigma)}, band, int(4 * sigma + 0.5))


def local_std(px: DataFrame, size: int, value: str = "v", band: int | None = None) -> DataFrame:
    """mean and std of the square neighbourhood, the variance clamped at 0."""
    return by_tile(px, {"v": F.col(value)}, lambda y, x, v: dict(zip(("mean", "std"), mean_and_std(v, y, x, size), strict=True)), band, size // 2)


def _reshaped(px: DataFrame, mask: str, name: str, made: Callable[[np.ndarray, np.ndarray], np.ndarray], band: int | None, halo: int) -> DataFrame:
    """px with a mask made from the mask and the pixels there are, both dense. A NULL mask is not set."""

    def run(y: np.ndarray, x: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        box = Box(y, x)
        return {"_new": box.read(made(box.spread(flags(table.column(mask)), False), box.spread(np.ones(len(y), bool), False)))}

    found = append_by_tile(px, {"_new": "boolean"}, run, band=band, halo=halo)
    return found.withColumn(name, F.col("_new")).drop("_new")


def erode(px: DataFrame, k: int, mask: str = "mask", band: int | None = None) -> DataFrame:
    """A pixel stays if its whole k x k square is set; outside the tile nothing is. band: rows of a tile in a group, beside a halo."""
    return _reshaped(px, mask, mask, lambda on, _: eroded(on, k), band, k // 2)


def dilate(px: DataFrame, k: int, mask: str = "mask", band: int | None = None) -> DataFrame:
    return _reshaped(px, mask, mask, lambda on, _: dilated(on, k), band, k // 2)


def close(px: DataFrame, k: int, mask: str = "mask", band: int | None = None) -> DataFrame:
    """Dilation, then erosion that counts what lies outside the tile as set."""
    return _reshaped(px, mask, mask, lambda on, inside: closed(on, inside, k), band, 2 * (k // 2) + 1)


def boundary(px: DataFrame, mask: str, name: str = "boundary", band: int | None = None) -> DataFrame:
    """Adds whether a pixel of the mask is not in its 3 x 3 erosion."""
    return _reshaped(px, mask, name, lambda on, _: edge_of(on), band, 1)


def extreme(px: DataFrame, k: int, value: str, name: str, largest: bool = True, band: int | None = None) -> DataFrame:
    """The greatest (or least) value of the k x k square, cut at the tile's edge; NULL values are passed over."""
    sign = 1.0 if largest else -1.0

    def run(y: np.ndarray, x: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        box, v = Box(y, x), sign * numbers(table.column(value))
        found = box.read(square_extremes(box.spread(np.where(np.isnan(v), -np.inf, v), -np.inf), k, -np.inf))
        return {name: np.where(np.isinf(found), np.nan, sign * found)}

    return append_by_tile(px, {name: "double"}, run, band=band, halo=k // 2 + 1)


def smoothness(df: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Mean absolute difference of the two pore probabilities to the pixel above, plus that to the pixel on the left."""
    up = F.lag("probs").over(Window.partitionBy("tile_id", "x").orderBy("y"))
    left = F.lag("probs").over(Window.partitionBy("tile_id", "y").orderBy("x"))

    def gap(other: Column) -> Column:
        pores = F.zip_with(F.slice("probs", 1, 2), F.slice(other, 1, 2), lambda a, b: F.abs(a - b))
        return F.when(other.isNotNull(), F.aggregate(pores, F.lit(0.0), lambda s, v: s + v) / 2)

    d = df.withColumns({"_u": up, "_l": left}).withColumns({"_dy": gap(F.col("_u")), "_dx": gap(F.col("_l"))})
    return d.groupBy(*keys).agg((F.coalesce(F.avg("_dy"), F.lit(0.0)) + F.coalesce(F.avg("_dx"), F.lit(0.0))).alias("smoothness"))
