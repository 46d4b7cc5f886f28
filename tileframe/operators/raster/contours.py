"""Outlines of regions as polygons, and polygons back to pixels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.operators.raster.components import KEY_BITS, label_runs
from tileframe.operators.raster.tiles import Box

#: A pixel's eight neighbours clockwise from the one to the right (y down).
CLOCKWISE = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def outline(label: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """The outer border of the region of start, its first pixel in row-major order: pixels (y, x) clockwise, each step to a neighbour, until
    the border comes back to start the way it left it. label has a margin of one pixel."""
    own = label[start]
    border, at, back = [start], start, 4
    first = None
    while True:
        for turn in range(1, 9):
            way = (back + turn) % 8
            y, x = at[0] + CLOCKWISE[way][0], at[1] + CLOCKWISE[way][1]
            if label[y, x] == own:
                break
        else:
            return border  # one pixel
        if at == start:
            if first is None:
                first = way
            elif way == first:
                return border[:-1]
        at, back = (y, x), (way + 4) % 8
        border.append(at)


def double_area(points: Sequence[tuple[float, float]]) -> float:
    """Twice the signed area within a ring of points."""
    p = np.asarray(points, "float64")
    q = np.roll(p, -1, 0)
    return float((p[:, 1] * q[:, 0] - q[:, 1] * p[:, 0]).sum())


def perimeter(points: Sequence[tuple[float, float]]) -> float:
    p = np.asarray(points, "float64")
    return float(np.hypot(*(np.roll(p, -1, 0) - p).T).sum())


def farthest(p: np.ndarray, a: int, b: int) -> tuple[float, int]:
    """The greatest distance to the chord from p[a] to p[b] (a segment) of the points between, and the first that has it."""
    some = p[a + 1 : b]
    if not len(some):
        return -1.0, a
    chord, off = p[b] - p[a], some - p[a]
    length = float(chord @ chord)
    along = np.clip(off @ chord / length, 0, 1) if length else np.zeros(len(some))
    away = np.hypot(*(off - along[:, None] * chord).T)
    k = int(away.argmax())
    return float(away[k]), a + 1 + k


def simplified(points: Sequence[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """A ring of some of the points from which no point lies farther than the tolerance: cut at the first point and the one farthest from it,
    then each part again at the point farthest from its chord."""
    if len(points) < 3:
        return list(points)
    p = np.asarray([*points, points[0]], "float64")
    pivot = int(np.hypot(*(p[:-1] - p[0]).T).argmax())
    kept, todo = {0, pivot}, [(0, pivot), (pivot, len(points))]
    while todo:
        a, b = todo.pop()
        away, k = farthest(p, a, b)
        if away > tolerance:
            kept.add(k)
            todo += [(a, k), (k, b)]
    return [points[k] for k in sorted(kept)]


def polygons(px: DataFrame, classes: Sequence[int] = (0, 1, 2), min_area: float = 20.0, tolerance: float = 0.01, label: str = "target") -> DataFrame:
    """tile_id, annotation_id (within the tile), category_id, region_id, area, bbox and segmentation ([x, y, x, y, ...]) of the outer outlines of
    8-connected regions, in one group of the tile.

    Outlines run through pixel centres; those that enclose less than min_area are left out, others are simplified within tolerance times their
    length, and left out if fewer than three points remain. Holes are not cut out. area and bbox are the polygon's.
    """

    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy().astype("int64") for c in ("y", "x"))
        c, found = table.column("c").to_numpy(), []
        for category in classes:
            on = c == category
            if not on.any():
                continue
            box = Box(y[on], x[on])
            region = label_runs(y[on], x[on], 1)
            dense = np.full((box.shape[0] + 2, box.shape[1] + 2), -1, "int64")
            dense[box.y + 1, box.x + 1] = region
            for key in np.unique(region).tolist():
                start = ((key >> KEY_BITS) - box.y0 + 1, (key & ((1 << KEY_BITS) - 1)) - box.x0 + 1)
                border = outline(dense, start)
                if len(border) < 3 or abs(double_area(border)) / 2 < min_area:
                    continue
                ring = [(a + box.y0 - 1, b + box.x0 - 1) for a, b in simplified(border, tolerance * perimeter(border))]
                if len(ring) >= 3:
                    ys, xs = [a for a, _ in ring], [b for _, b in ring]
                    found.append((len(found) + 1, category, key, abs(double_area(ring)) / 2, [float(v) for v in (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))], [float(v) for a, b in ring for v in (b, a)]))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        return pa.table([pa.repeat(table.column("tile_id")[0], len(found)), *columns], names=["tile_id", "annotation_id", "category_id", "region_id", "area", "bbox", "segmentation"])

    picked = px.where("y is not null and x is not null").select("tile_id", "y", "x", F.coalesce(F.col(label).cast("int"), F.lit(-1)).alias("c"))
    return picked.groupBy("tile_id").applyInArrow(run, f"tile_id {dict(picked.dtypes)['tile_id']}, annotation_id int, category_id int, region_id bigint, area double, bbox array<double>, segmentation array<double>")


def ring_of(segmentation: Column) -> Column:
    """The points (structs of x and y) of a flat list [x, y, x, y, ...]."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(segmentation) / 2).cast("int") - 1)), lambda k: F.struct(F.get(segmentation, 2 * k).alias("x"), F.get(segmentation, 2 * k + 1).alias("y")))


def spans(polys: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile_id, order, class_id, y, xa and xb: runs of pixels in or on the edge of polygons (runs of a polygon may overlap).

    Each edge goes to the rows that it crosses, and there to the place where it does; the crossings of a row, in order, bound the runs. So the
    work is that of the edges and their heights, however many points a ring has. Rings of fewer than three points are ignored; equal
    polygons count once.
    """
    p = polys.where(F.size("points") >= 3).select("tile_id", "order", "class_id", "points").dropDuplicates()
    p = p.join(tiles.select("tile_id", "height", "width"), "tile_id").withColumn("poly", F.xxhash64("points"))
    ends = F.zip_with("points", F.concat(F.slice("points", F.lit(2), F.size("points")), F.slice("points", 1, 1)), lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by")))
    key = ["tile_id", "order", "class_id", "poly"]
    e = p.select(*key, "height", "width", F.explode(ends).alias("e")).select(*key, "height", "width", "e.*")
    ya, yb = F.greatest(F.lit(0), F.ceil(F.least("ay", "by"))).cast("int"), F.least(F.col("height") - 1, F.floor(F.greatest("ay", "by"))).cast("int")
    e = e.withColumns({"_ya": ya, "_yb": yb}).where("_ya <= _yb").withColumn("y", F.explode(F.sequence("_ya", "_yb")))
    y, dx, dy = F.col("y"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    e = e.withColumn("cx", F.when(dy != 0, dx * (y - F.col("ay")) / F.nullif(dy, F.lit(0.0)) + F.col("ax")))
    near = F.round("cx")
    touched = F.when(dy == 0, F.when(F.col("ay") == y, F.struct(F.ceil(F.least("ax", "bx")).alias("a"), F.floor(F.greatest("ax", "bx")).alias("b")))).when(F.abs(dx * (y - F.col("ay")) - dy * (near - F.col("ax"))) < 1e-9, F.struct(near.cast("bigint").alias("a"), near.cast("bigint").alias("b")))
    crossing = F.when((F.col("ay") > y) != (F.col("by") > y), F.col("cx"))
    rows = e.select(*key, "width", "y", crossing.alias("c"), touched.alias("t")).groupBy(*key, "width", "y").agg(F.array_sort(F.collect_list("c")).alias("c"), F.collect_set("t").alias("t"))
    # A pixel is inside where an odd number of crossings lies to its right.
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int")), lambda k: F.struct(F.ceil(F.get("c", 2 * k)).alias("a"), (F.ceil(F.get("c", 2 * k + 1)) - 1).alias("b")))
    pairs = F.filter(pairs, lambda r: r["b"].isNotNull())
    every = rows.select("tile_id", "order", "class_id", "width", "y", F.explode(F.concat(pairs, F.col("t"))).alias("r"))
    clipped = every.select("tile_id", "order", "class_id", "y", F.greatest(F.lit(0), F.col("r.a")).cast("int").alias("xa"), F.least(F.col("width") - 1, F.col("r.b")).cast("int").alias("xb"))
    return clipped.where("xa <= xb")


def rasterise(polys: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile_id, y, x, class_id: pixels in or on the edge of polygons, later ones on top; rings of fewer than three points are ignored.

    polys has tile_id, order, class_id and points (array of x, y structs); tiles height and width.
    """
    cells = spans(polys, tiles).withColumn("x", F.explode(F.sequence("xa", "xb")))
    return cells.groupBy("tile_id", "y", "x").agg(F.max_by("class_id", F.struct("order", "class_id")).alias("class_id"))


def coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, images_per_document: int = 1000) -> DataFrame:
    """document (a number) and json: COCO documents of so many images each, with the annotations of these.

    images has tile_id, file_name, width and height; annotations are ``polygons``; categories has id and name (few rows). Image ids are ranks
    of file names over all documents, annotation ids run within a document. A document is one row, bounded by its images.
    """
    from tileframe.operators.ranks import ranked_by_value

    if images_per_document < 1:
        raise ValueError("a document has one image at least")
    ranked = ranked_by_value(images.select("tile_id", "file_name", "width", "height"), "file_name").select("tile_id", F.col("_k").alias("id"), "file_name", "width", "height")
    ranked = ranked.withColumn("document", F.floor((F.col("id") - 1) / images_per_document))
    order = Window.partitionBy("document").orderBy("image_id", "category_id", "region_id")
    a = annotations.join(ranked.select("tile_id", "document", F.col("id").alias("image_id")), "tile_id").withColumn("id", F.row_number().over(order))
    listed = a.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("id", "image_id", "category_id", F.array("segmentation").alias("segmentation"), "area", "bbox", F.lit(0).alias("iscrowd")))).alias("annotations"))
    pictures = ranked.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("id", "file_name", "width", "height"))).alias("images"))
    names = categories.select(F.struct(F.col("id").cast("int").alias("id"), "name").alias("c")).agg(F.array_sort(F.collect_list("c")).alias("categories"))
    kind = dict(listed.dtypes)["annotations"]
    whole = pictures.join(listed, "document", "left").crossJoin(F.broadcast(names)).withColumn("annotations", F.coalesce("annotations", F.array().cast(kind)))  # one row of categories
    return whole.select("document", F.to_json(F.struct("images", "annotations", "categories")).alias("json"))

