"""Exact distances, markers, and growth from markers: each a group of one whole tile."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileframe.operators.raster.components import KEY_BITS, area_rule, label_runs
from tileframe.operators.raster.tiles import Box, append_by_tile, dilated, edge_of, flags, numbers, square_distances, square_extremes

KEY = ("tile_id", "y", "x")
#: Steps to a pixel's neighbours, the nearer ones first.
AROUND = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))


def distances(box: Box, on: np.ndarray) -> np.ndarray:
    """The exact Euclidean distance of each pixel to the nearest that is not on (pixels that are missing don't count); NaN if there is none."""
    if on.all():
        return np.full(len(on), np.nan)
    return np.sqrt(box.read(square_distances(box.spread(~on, False))).astype("float64"))


def distance(px: DataFrame, mask: str = "mask", max_radius: float | None = None, name: str = "distance") -> DataFrame:
    """Adds the Euclidean distance of each pixel of the mask to the nearest pixel outside it; 0 outside the mask (a NULL mask is outside).

    Exact at any distance; with max_radius at most that. A tile without a pixel outside the mask has no distance (NULL; with max_radius,
    that); nor have pixels without coordinates.
    """
    found = append_by_tile(px, {name: "double"}, lambda y, x, t: {name: distances(Box(y, x), flags(t.column(mask)))})
    return found if max_radius is None else found.withColumn(name, F.when(F.col("y").isNotNull() & F.col("x").isNotNull(), F.least(F.col(name), F.lit(float(max_radius)))))


def spaced_peaks(squares: np.ndarray, on: np.ndarray, least: float, separation: int) -> list[tuple[int, int]]:
    """Peaks of the distance, greatest first (ties in row-major order): pixels of the mask that are the greatest of their square of reach
    ``separation`` and lie deeper than ``least``, each of which stays if no peak before it is nearer than the separation along both axes."""
    reach = 2 * separation + 1
    y, x = np.nonzero(on & (squares > least * least) & (squares == square_extremes(squares, reach, -1)))
    order = np.argsort(-squares[y, x], kind="stable")
    cells: dict[tuple[int, int], tuple[int, int]] = {}
    kept = []
    for a, b in zip(y[order].tolist(), x[order].tolist(), strict=True):
        i, j = a // separation, b // separation
        # Two peaks of a cell would be too near, so a cell has one at most.
        beside = (cells.get((i + di, j + dj)) for di in (-1, 0, 1) for dj in (-1, 0, 1))
        if all(p is None or max(abs(p[0] - a), abs(p[1] - b)) >= separation for p in beside):
            cells[i, j] = (a, b)
            kept.append((a, b))
    return kept


def marked(box: Box, on: np.ndarray, least: float, separation: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The squared distances (dense), and markers: spaced peaks, then the deepest pixel of each region that has none (ties in row-major order)."""
    mask = box.spread(on, False)
    # A tile that is all mask has no distance; it is as deep everywhere.
    squares = square_distances(box.spread(~on, False)) if not on.all() else np.where(mask, np.int64(1) << 40, 0)
    squares = np.where(mask, squares, 0)
    peaks = spaced_peaks(squares, mask, least, separation)
    y, x = np.nonzero(mask)
    region = np.zeros(box.shape, "int64")
    region[y, x] = label_runs(y, x, 1)
    covered = {int(region[p]) for p in peaks}
    order = np.lexsort([x, y, -squares[y, x], region[y, x]])
    first = order[np.flatnonzero(np.diff(region[y, x][order], prepend=-1))]
    return squares, peaks + [(int(y[k]), int(x[k])) for k in first.tolist() if int(region[y[k], x[k]]) not in covered]


def flood(height: np.ndarray, mask: np.ndarray, seeds: Iterable[tuple[int, int]]) -> np.ndarray:
    """Which seed (its number) floods each pixel of the mask; -1 where none does. The greatest height goes first, among equals the one
    that has waited longest; a pixel belongs to the neighbour that reaches it first."""
    rows, width = mask.shape[0] + 2, mask.shape[1] + 2
    label = np.full((rows, width), -2)
    label[1:-1, 1:-1] = np.where(mask, -1, -2)
    level = np.zeros((rows, width), height.dtype)
    level[1:-1, 1:-1] = -height
    label, level = label.ravel().tolist(), level.ravel().tolist()
    queue, age = [], 0
    for number, (a, b) in enumerate(seeds):
        at = (a + 1) * width + b + 1
        if label[at] == -1:
            label[at] = number
            queue.append((level[at], age, at))
            age += 1
    heapq.heapify(queue)
    steps = [dy * width + dx for dy, dx in AROUND]
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        _, _, at = pop(queue)
        for step in steps:
            to = at + step
            if label[to] == -1:
                label[to] = label[at]
                push(queue, (level[to], age, to))
                age += 1
    found = np.array(label).reshape(rows, width)[1:-1, 1:-1]
    return np.where(found < 0, -1, found)


def keyed(box: Box, seeds: Sequence[tuple[int, int]]) -> np.ndarray:
    """The pixel keys of seeds, and a last one of -1 for none."""
    return np.array([(a + box.y0) << KEY_BITS | b + box.x0 for a, b in seeds] + [-1], "int64")


def markers(px: DataFrame, mask: str = "mask", least: float = 5.0, separation: int = 10) -> DataFrame:
    """tile_id, y, x, marker (a pixel key) and rank: spaced peaks of the distance, then the deepest pixel of each region without one."""

    def run(y: np.ndarray, x: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        box, rank = Box(y, x), np.full(len(y), np.nan)
        _, seeds = marked(box, flags(table.column(mask)), least, separation)
        dense = np.full(box.shape, np.nan)
        for k, p in enumerate(seeds):
            dense[p] = k
        rank = box.read(dense)
        return {"marker": np.where(np.isnan(rank), np.nan, (y << KEY_BITS | x).astype("float64")), "rank": rank}

    found = append_by_tile(px.select(*KEY, mask), {"marker": "double", "rank": "double"}, run).where("rank is not null")
    return found.select(*KEY, F.col("marker").cast("bigint").alias("marker"), F.col("rank").cast("int").alias("rank"))


def seeded_regions(px: DataFrame, seeds: DataFrame, mask: str = "mask") -> DataFrame:
    """The mask's pixels with region_id, the marker that floods them by distance from the outside of the mask, deepest first; pixels that no
    marker reaches are left out. Markers of a tile are taken by rank, if seeds have one, else by marker."""
    rank = F.col("rank") if "rank" in seeds.columns else F.col("marker")
    both = px.select(*KEY, mask).join(seeds.select(*KEY, F.col("marker").alias("_m"), rank.alias("_k")), list(KEY), "left")

    def run(y: np.ndarray, x: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        box, on = Box(y, x), flags(table.column(mask))
        squares = box.read(square_distances(box.spread(~on, False))) if not on.all() else np.zeros(len(y), "int64")
        rank, marker = numbers(table.column("_k")), table.column("_m").combine_chunks().fill_null(-1).to_numpy().astype("int64")
        some = np.flatnonzero(~np.isnan(rank))
        some = some[np.lexsort([marker[some], rank[some]])]
        found = flood(box.spread(squares), box.spread(on, False), zip(box.y[some].tolist(), box.x[some].tolist(), strict=True))
        return {"region_id": np.append(marker[some], -1)[box.read(found)]}

    return append_by_tile(both, {"region_id": "bigint"}, run).where("region_id >= 0").select(*KEY, "region_id")


def watershed(px: DataFrame, mask: str = "mask", least: float = 5.0, separation: int = 10) -> DataFrame:
    """px with region_id (the pixel key of its marker; NULL outside the mask): distance, markers, regions and flood in one group of the tile."""

    def run(y: np.ndarray, x: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        box, on = Box(y, x), flags(table.column(mask))
        squares, seeds = marked(box, on, least, separation)
        found = keyed(box, seeds)[box.read(flood(squares, box.spread(on, False), seeds))]
        return {"region_id": np.where(found < 0, np.nan, found.astype("float64"))}

    found = append_by_tile(px, {"region_id": "double"}, run)
    return found.withColumn("region_id", F.col("region_id").cast("bigint"))


def classify_by_watershed(px: DataFrame, cutoff: int, t: int = 100, least: float = 5.0, separation: int = 10) -> DataFrame:
    """px (with v) with region_id, area and pred by the region-size rule over the regions that a watershed cuts the gate into."""
    found = watershed(px.withColumn("_gate", F.coalesce(F.col("v") < t, F.lit(False))), "_gate", least, separation)
    areas = found.where("region_id is not null").groupBy("tile_id", "region_id").agg(F.count("*").alias("area"))
    return found.join(areas, ["tile_id", "region_id"], "left").withColumn("pred", area_rule(F.col("area"), F.col("_gate"), cutoff)).select(*px.columns, "region_id", "area", "pred")


def boundary_weights(px: DataFrame, weight: float = 3.0, reach: int = 5, label: str = "target") -> DataFrame:
    """boundary_weight: from ``weight`` at a pore boundary down to 1 at ``reach``; band: near both pores and mineral."""

    def run(y: np.ndarray, x: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        box, classes = Box(y, x), numbers(table.column(label))
        pore, mineral = box.spread((classes == 0) | (classes == 1), False), box.spread(classes == 2, False)
        edge = edge_of(pore)
        away = np.sqrt(square_distances(edge).astype("float64")) if edge.any() else np.full(box.shape, reach + 1.0)
        w = np.where(away <= reach, weight - (weight - 1) * away / reach, 1.0)
        return {"boundary_weight": box.read(w), "band": box.read(dilated(pore, 3) & dilated(mineral, 3))}

    return append_by_tile(px, {"boundary_weight": "double", "band": "boolean"}, run)


def hausdorff(px: DataFrame, class_id: int, pct: float = 0.95, target: str = "target", pred: str = "pred", max_radius: int | None = None) -> DataFrame:
    """Percentile Hausdorff distance of the class's boundaries by tile, at most max_radius if given; 0 if either is empty."""

    def run(y: np.ndarray, x: np.ndarray, table: pa.Table) -> dict[str, np.ndarray]:
        box = Box(y, x)
        t, p = (edge_of(box.spread(numbers(table.column(c)) == class_id, False)) for c in (target, pred))
        out = {}
        for name, on, other in (("_a", p, t), ("_b", t, p)):
            far = np.sqrt(square_distances(other).astype("float64")) if other.any() else np.full(box.shape, np.nan)
            out[name] = box.read(np.where(on, far, np.nan))
        return out

    picked = px.select(*KEY, target, *([pred] if pred != target else []))
    b = append_by_tile(picked, {"_a": "double", "_b": "double"}, run)
    limit = (lambda c: F.col(c)) if max_radius is None else (lambda c: F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(float(max_radius)))))
    g = b.groupBy("tile_id").agg(F.percentile(limit("_a"), F.lit(pct)).alias("a"), F.percentile(limit("_b"), F.lit(pct)).alias("b"))
    return g.select("tile_id", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.greatest("a", "b")).alias("hausdorff"))
