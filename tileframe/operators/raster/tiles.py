"""Work on one tile, or one band of its rows, in an Arrow group; and what is done there on dense arrays.

A pixel without coordinates (what an unreadable image leaves) passes through with NULL results; the others of its tile are not
disturbed. Dense arrays span the box of a group's pixels only, wherever it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """As doubles, NULL as NaN; booleans as 0 and 1."""
    if pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    return column.cast(pa.float64()).to_numpy()


def flags(column: pa.ChunkedArray) -> np.ndarray:
    """As booleans, NULL as false."""
    return column.cast(pa.bool_()).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)


def append_by_tile(df: DataFrame, columns: dict[str, str], made: Callable[[np.ndarray, np.ndarray, pa.Table], dict[str, np.ndarray]], keys: Sequence[str] = ("tile_id",), band: int | None = None, halo: int = 0, needs: Sequence[str] = ()) -> DataFrame:
    """df with more columns (name: type), made from y, x and all columns of one tile's pixels: one shuffle.

    made sees the pixels that have coordinates and values in ``needs``; others get NULL. band: a group has so many rows of a tile and ``halo``
    rows above and below them, which are copies; made must not look further than that.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names, kinds = list(columns), {}
    for n, kind in columns.items():
        kinds[n] = {"double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}[kind]

    def run(table: pa.Table) -> pa.Table:
        known = np.ones(table.num_rows, bool)
        for n in ("y", "x", *needs):
            known &= table.column(n).is_valid().to_numpy(zero_copy_only=False)
        own = np.ones(table.num_rows, bool)
        if band:
            own = pc.equal(table.column("_band"), pc.floor(pc.divide(table.column("y").cast(pa.float64()), float(band))).cast(pa.int64())).combine_chunks().fill_null(True).to_numpy(zero_copy_only=False)
            table = table.drop_columns(["_band"])
        some = table if known.all() else table.filter(pa.array(known))
        out = made(some.column("y").to_numpy().astype("int64"), some.column("x").to_numpy().astype("int64"), some) if some.num_rows else {}
        for n in names:
            values = np.full(table.num_rows, None, object) if not known.all() else None
            found = out.get(n, np.empty(0))
            if values is None:
                array = pa.array(found, from_pandas=True).cast(kinds[n])
            else:
                values[known] = [None if v != v else v for v in found.tolist()]
                array = pa.array(values.tolist(), kinds[n])
            table = table.append_column(n, array)
        return table if own.all() else table.filter(pa.array(own))

    groups = list(keys)
    if band:
        df = df.withColumn("_band", F.explode_outer(F.sequence(F.floor((F.col("y") - halo) / band), F.floor((F.col("y") + halo) / band))))
        groups.append("_band")
    return df.groupBy(*groups).applyInArrow(run, fields + "".join(f", `{n}` {kind}" for n, kind in columns.items()))


class Box:
    """The smallest rectangle of some pixels: arrays of its shape, filled from lists of pixels and read back."""

    def __init__(self, y: np.ndarray, x: np.ndarray):
        self.y0, self.x0 = int(y.min()), int(x.min())
        self.y, self.x = y - self.y0, x - self.x0
        self.shape = (int(self.y.max()) + 1, int(self.x.max()) + 1)

    def spread(self, values: np.ndarray, fill: object = 0) -> np.ndarray:
        out = np.full(self.shape, fill, values.dtype)
        out[self.y, self.x] = values
        return out

    def read(self, dense: np.ndarray) -> np.ndarray:
        return dense[self.y, self.x]


def summed(dense: np.ndarray) -> np.ndarray:
    """The summed-area table: sums of all above and to the left, with a row and a column of 0 before."""
    out = np.zeros((dense.shape[0] + 1, dense.shape[1] + 1), "int64" if dense.dtype.kind in "bui" else "float64")
    np.cumsum(np.cumsum(dense, 0, dtype=out.dtype), 1, out=out[1:, 1:])
    return out


def square_sums(dense: np.ndarray, k: int) -> np.ndarray:
    """The sum of the k x k square about each pixel (k // 2 before it), cut at the edges: four look-ups in the summed-area table."""
    area = summed(dense)
    at = [np.arange(n) for n in dense.shape]
    low = [np.maximum(a - k // 2, 0) for a in at]
    high = [np.minimum(a + k - k // 2, n) for a, n in zip(at, dense.shape, strict=True)]
    return area[np.ix_(high[0], high[1])] - area[np.ix_(low[0], high[1])] - area[np.ix_(high[0], low[1])] + area[np.ix_(low[0], low[1])]


def eroded(on: np.ndarray, k: int) -> np.ndarray:
    """Pixels whose whole k x k square is set; beyond the edges nothing is."""
    return square_sums(on, k) == k * k


def dilated(on: np.ndarray, k: int) -> np.ndarray:
    return square_sums(on, k) > 0


def closed(on: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """Dilation, then erosion that counts what is not inside as set."""
    grown = dilated(on, k)
    return square_sums(inside & ~grown, k) == 0


def edge_of(on: np.ndarray) -> np.ndarray:
    """Pixels of on that are not in its 3 x 3 erosion."""
    return on & ~eroded(on, 3)


def square_extremes(dense: np.ndarray, k: int, fill: float) -> np.ndarray:
    """The greatest value of the k x k square about each pixel, in steps of doubled width; fill lies beyond the edges."""
    out = dense
    for axis in (0, 1):
        wide = np.moveaxis(out, axis, 0)
        n = len(wide)
        padded = np.full((n + k, *wide.shape[1:]), fill, wide.dtype)
        padded[k // 2 : k // 2 + n] = wide
        width = 1
        while 2 * width <= k:
            padded[: len(padded) - width] = np.maximum(padded[: len(padded) - width], padded[width:])
            width *= 2
        found = padded[:n] if width == k else np.maximum(padded[:n], padded[k - width : k - width + n])
        out = np.moveaxis(found, 0, axis)
    return out


def square_distances(zero: np.ndarray) -> np.ndarray:
    """The exact squared distance of each pixel to the nearest where zero is set (somewhere it must be): along rows, then the lower envelope of
    the parabolas of each column, all columns at once. Linear in the pixels."""
    height, width = zero.shape
    far = np.int64(4) * (height + width)
    columns = np.arange(width)
    before = np.maximum.accumulate(np.where(zero, columns, -far), axis=1)
    after = np.minimum.accumulate(np.where(zero, columns, 2 * far)[:, ::-1], axis=1)[:, ::-1]
    row = np.minimum(np.minimum(columns - before, after - columns), far)
    g = row * row
    # Parabolas of a column that are lowest somewhere: their row, and from where on they are.
    site, start = np.zeros((height, width), "int64"), np.zeros((height, width), "int64")
    top = np.zeros(width, "int64")
    for u in range(1, height):
        while True:
            alive = np.flatnonzero(top >= 0)
            s, t = site[top[alive], alive], start[top[alive], alive]
            worse = (t - s) ** 2 + g[s, alive] > (t - u) ** 2 + g[u, alive]
            if not worse.any():
                break
            top[alive[worse]] -= 1
        none = np.flatnonzero(top < 0)
        top[none], site[0, none], start[0, none] = 0, u, 0
        some = np.flatnonzero((top >= 0) & (site[np.maximum(top, 0), columns] != u))
        s = site[top[some], some]
        w = 1 + (u * u - s * s + g[u, some] - g[s, some]) // (2 * (u - s))
        new = w < height
        at = some[new]
        top[at] += 1
        site[top[at], at], start[top[at], at] = u, w[new]
    out = np.empty((height, width), "int64")
    for u in range(height - 1, -1, -1):
        s = site[top, columns]
        out[u] = (u - s) ** 2 + g[s, columns]
        top -= start[top, columns] == u
        np.maximum(top, 0, out=top)
    return out
