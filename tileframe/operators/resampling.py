"""Whole-tile bootstrap draws without a row for a draw.

Tiles are numbered 0 to T - 1. Each replicate has T draws; how many fall on either half of a range of tiles is a binomial number, seeded
by the range, so that every task that comes past a range draws the same. A task goes down from all tiles to its block of BLOCK tiles,
splits on to single tiles, and multiplies draws with the tiles' numbers there and then: what leaves it is one sum for each replicate
and key of a block. Every replicate has exactly T draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileframe.operators.ranks import ranked_by_value

#: Tiles of a group, and tiles whose draws are held at once (powers of two).
BLOCK = 2048
LEAVES = 64


def halves(seed: int, counts: np.ndarray, start: int, size: int, tiles: int) -> np.ndarray:
    """Of the draws (one number a replicate) that fall on tiles start .. start + size - 1 (size a power of two, cut off at ``tiles``), those on the first half."""
    whole, left = min(size, tiles - start), min(size // 2, tiles - start)
    if whole == left:
        return counts
    random = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), start * 64 + size.bit_length()]))
    return random.binomial(counts, left / whole)


def down_to(seed: int, reps: int, tiles: int, block: int, size: int) -> np.ndarray:
    """The draws of each replicate that fall on a block of ``size`` tiles."""
    counts, start, width = np.full(reps, tiles, "int64"), 0, 1 << max(0, tiles - 1).bit_length()
    while width > size:
        left = halves(seed, counts, start, width, tiles)
        width //= 2
        if block * size >= start + width:
            counts, start = counts - left, start + width
        else:
            counts = left
    return counts


def spread_out(seed: int, counts: np.ndarray, start: int, size: int, tiles: int) -> Iterator[tuple[int, np.ndarray]]:
    """The first tile of each LEAVES tiles, and the draws (replicates x tiles) of these."""
    if start >= tiles:
        return
    if size > LEAVES:
        left = halves(seed, counts, start, size, tiles)
        yield from spread_out(seed, left, start, size // 2, tiles)
        yield from spread_out(seed, counts - left, start + size // 2, size // 2, tiles)
        return
    columns = [(start, size, counts)]
    while columns[0][1] > 1:
        finer = []
        for a, n, c in columns:
            left = halves(seed, c, a, n, tiles) if a < tiles else c
            finer += [(a, n // 2, left), (a + n // 2, n // 2, c - left)]
        columns = finer
    yield start, np.stack([c for a, _, c in columns if a < tiles], 1)


def replicate_sums(df: DataFrame, reps: int, seed: int, keys: Sequence[str], values: Sequence[str], tile: str = "tile_id") -> DataFrame:
    """keys, rep and the sums of values over the drawn tiles' rows, each as often as its tile was drawn; tiles are drawn for all keys alike.

    Sums of integers are exact. Rows without a tile (NULL) take no part; a NULL value counts as 0.
    """
    known = df.where(F.col(tile).isNotNull())
    order = ranked_by_value(known.select(tile).distinct(), tile).select(F.col(tile).alias("_tile"), (F.col("_k") - 1).alias("_n"), "_t")
    kinds = dict(df.dtypes)
    whole = {v: kinds[v] in ("tinyint", "smallint", "int", "bigint") for v in values}
    rows = known.join(order, F.col(tile) == F.col("_tile")).select(
        *keys, (F.floor(F.col("_n") / BLOCK)).alias("_block"), "_n", "_t", *[F.coalesce(F.col(v).cast("bigint" if whole[v] else "double"), F.lit(0)).alias(v) for v in values]
    )

    def run(table: pa.Table) -> pa.Table:
        block, tiles = table.column("_block")[0].as_py(), table.column("_t")[0].as_py()
        size = min(BLOCK, 1 << max(0, tiles - 1).bit_length())
        table = table.sort_by("_n")
        names = list(zip(*[table.column(k).to_pylist() for k in keys], strict=True)) if keys else [()] * table.num_rows
        place = {name: i for i, name in enumerate(dict.fromkeys(names))}
        key, n = np.array([place[x] for x in names]), table.column("_n").to_numpy()
        numbers = [table.column(v).to_numpy() for v in values]
        sums = [np.zeros((len(place), reps), x.dtype) for x in numbers]
        for start, drawn in spread_out(seed, down_to(seed, reps, tiles, block, size), block * size, size, tiles):
            a, b = np.searchsorted(n, [start, start + drawn.shape[1]])
            order = a + np.argsort(key[a:b], kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if b > a else []:
                times = drawn[:, n[some] - start]
                for total, x in zip(sums, numbers, strict=True):
                    total[key[some[0]]] += times @ x[some]
        columns = {k: pa.array(np.repeat(np.arange(len(place)), reps)) for k in keys}
        first = {name: i for i, name in reversed(list(enumerate(names)))}
        where = pa.array([first[name] for name in place])
        columns = [table.column(k).take(where).combine_chunks().take(columns[k]) for k in keys]
        return pa.table([*columns, pa.array(np.tile(np.arange(reps), len(place))), *[pa.array(x.ravel()) for x in sums]], names=[*keys, "rep", *values])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["rep bigint"] + [f"`{v}` {'bigint' if whole[v] else 'double'}" for v in values])
    parts = rows.groupBy("_block").applyInArrow(run, schema)
    return parts.groupBy(*keys, "rep").agg(*[F.sum(v).alias(v) for v in values])
