"""Outlines, their simplification and their way back to pixels; fills against a plain even-odd test; the COCO document."""

import json
import math
import random

from pyspark.sql import functions as F

from tileframe.operators.raster import contours, grid
from tileframe.sources.writers import write_coco


def discs(seed, h=40, w=50, n=6):
    r = random.Random(seed)
    on = set()
    for _ in range(n):
        cy, cx, k = r.randrange(4, h - 4), r.randrange(4, w - 4), r.randrange(2, 9)
        on |= {(y, x) for y in range(h) for x in range(w) if math.hypot(y - cy, x - cx) <= k}
    return on


def table(spark, tiles, h=40, w=50):
    return spark.createDataFrame([(t, y, x, 0 if (y, x) in on else 2) for t, on in enumerate(tiles) for y in range(h) for x in range(w)], "tile_id int, y int, x int, target int")


def regions(on):
    left, out = set(on), []
    while left:
        todo, region = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                region.add(p)
                todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        out.append(region)
    return out


def filled(region):
    """The region with its holes: what 4-connected steps from outside don't reach."""
    ys, xs = [y for y, _ in region], [x for _, x in region]
    a, b, c, d = min(ys) - 1, max(ys) + 1, min(xs) - 1, max(xs) + 1
    todo, outside = [(a, c)], set()
    while todo:
        p = todo.pop()
        if p not in outside and p not in region and a <= p[0] <= b and c <= p[1] <= d:
            outside.add(p)
            todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    return {(y, x) for y in range(a, b + 1) for x in range(c, d + 1)} - outside


def test_outlines_without_tolerance_give_the_regions_back(spark):
    tiles = [discs(k) for k in range(4)] + [{(5, 5), (6, 6), (7, 5), (6, 4)}, {(0, 0), (0, 1), (1, 1)}, {(3, 3)}, {(9, x) for x in range(20)}]
    got = contours.polygons(table(spark, tiles), (0,), 0.0, 0.0).collect()
    polys = [(r.tile_id, r.annotation_id, r.category_id, [(int(x), int(y)) for x, y in zip(r.segmentation[::2], r.segmentation[1::2], strict=True)]) for r in got]
    df = spark.createDataFrame(polys, "tile_id int, order int, class_id int, points array<struct<x: int, y: int>>")
    back = {(r.tile_id, r.y, r.x) for r in contours.rasterise(df, spark.range(len(tiles)).select(F.col("id").cast("int").alias("tile_id"), F.lit(40).alias("height"), F.lit(50).alias("width"))).collect()}
    want = set()
    for t, on in enumerate(tiles):
        for region in regions(on):
            if len({y for y, _ in region}) > 1:  # the others have no third corner
                want |= {(t, *p) for p in filled(region)}
    assert back == want


def test_simplified_polygons_stay_within_the_tolerance(spark):
    tiles = [discs(k) for k in range(10, 14)]
    got = contours.polygons(table(spark, tiles), (0,), 20.0, 0.01).collect()
    assert got and all(len(r.segmentation) >= 6 for r in got) and [r.annotation_id for r in got if r.tile_id == 0] == list(range(1, 1 + sum(r.tile_id == 0 for r in got)))
    for t, on in enumerate(tiles):
        wholes = {min(r)[0] << 24 | min(r)[1]: r for r in regions(on)}
        for r in (r for r in got if r.tile_id == t):
            region = filled(wholes[r.region_id])
            ring = list(zip(r.segmentation[1::2], r.segmentation[::2], strict=True))
            edge = [p for p in region if any((p[0] + a, p[1] + b) not in region for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
            # The outline is at most as long as its pixels' steps.
            tolerance = 0.01 * math.sqrt(2) * 2 * len(edge) + 1e-9

            def away(p, ring=ring):
                best = math.inf
                for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1], strict=True):
                    n = (by - ay) ** 2 + (bx - ax) ** 2
                    s = min(1, max(0, ((p[0] - ay) * (by - ay) + (p[1] - ax) * (bx - ax)) / n)) if n else 0
                    best = min(best, math.hypot(p[0] - ay - s * (by - ay), p[1] - ax - s * (bx - ax)))
                return best

            assert max(map(away, edge)) <= tolerance and len(ring) <= len(edge)
            xs, ys = r.segmentation[::2], r.segmentation[1::2]
            assert r.bbox == [min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)]
            assert math.isclose(r.area, abs(sum(x * ys[(k + 1) % len(ys)] - xs[(k + 1) % len(xs)] * y for k, (x, y) in enumerate(zip(xs, ys, strict=True)))) / 2)


def test_fill_is_even_odd_with_edges(spark):
    r = random.Random(8)
    polys = [(0, k, k % 3, [(r.randrange(-3, 18), r.randrange(-3, 15)) for _ in range(r.choice((2, 3, 5, 8)))]) for k in range(60)]
    polys += [polys[7], (0, 99, 1, [(2, 2), (9, 2), (9, 2), (2, 2)]), (0, 100, 2, [(4, 4), (4, 4), (4, 4)])]
    df = spark.createDataFrame(polys, "tile_id int, order int, class_id int, points array<struct<x: int, y: int>>")
    want = {}
    for _, order, c, ring in polys:
        if len(ring) < 3:
            continue
        for y in range(12):
            for x in range(16):
                inside = on = False
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                    on |= (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
                    inside ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
                if inside or on:
                    want[y, x] = max(want.get((y, x), (-1, -1)), (order, c))
    tiles = spark.createDataFrame([(0, 12, 16)], "tile_id int, height int, width int")
    assert {(r.y, r.x): r.class_id for r in contours.rasterise(df, tiles).collect()} == {k: c for k, (_, c) in want.items()}
    big = [(0, 1, 1, [(round(500 + 400 * math.cos(k / 10_000 * 2 * math.pi), 3), round(500 + 400 * math.sin(k / 10_000 * 2 * math.pi), 3)) for k in range(10_000)])]
    ring = spark.createDataFrame(big, "tile_id int, order int, class_id int, points array<struct<x: double, y: double>>")
    n = contours.rasterise(ring, spark.createDataFrame([(0, 1000, 1000)], "tile_id int, height int, width int")).count()
    assert abs(n - math.pi * 400**2) < 1500


def test_coco_documents(spark, tmp_path):
    px = table(spark, [discs(k) for k in range(3)] + [set()])
    images = spark.createDataFrame([(t, f"{9 - t}.png", 50, 40) for t in range(4)], "tile_id int, file_name string, width int, height int")
    categories = spark.createDataFrame([(0, "a"), (1, "b")], "id int, name string")
    a = contours.polygons(px, (0, 1))
    write_coco(contours.coco_documents(images, a, categories, 3), f"{tmp_path}/coco")
    found = [json.loads(p.read_text()) for p in sorted((tmp_path / "coco").glob("part-*.txt")) if p.stat().st_size]
    assert sorted(len(d["images"]) for d in found) == [1, 3] and sum(len(d["annotations"]) for d in found) == a.count()
    for d in found:
        assert [x["id"] for x in d["annotations"]] == list(range(1, len(d["annotations"]) + 1)) and [c["name"] for c in d["categories"]] == ["a", "b"]
        assert {x["image_id"] for x in d["annotations"]} <= {i["id"] for i in d["images"]}
        assert all(len(x["segmentation"]) == 1 and len(x["segmentation"][0]) >= 6 and x["iscrowd"] == 0 for x in d["annotations"])
    assert sorted((i["id"], i["file_name"]) for d in found for i in d["images"]) == [(1, "6.png"), (2, "7.png"), (3, "8.png"), (4, "9.png")]


def test_crops_by_summed_areas(spark):
    r = random.Random(1)
    cells = {(t, y, x): r.choice((0, 1, 2)) for t in range(3) for y in range(17) for x in range(13) if (y, x) != (3, 3)}
    px = spark.createDataFrame([(*k, v) for k, v in cells.items()], "tile_id int, y int, x int, target int")
    for size in (4, 8):
        stride, want = max(1, size // 4), {}
        for t in range(3):
            for y0 in range(0, 17 - size + 1, stride):
                for x0 in range(0, 13 - size + 1, stride):
                    n = sum(cells.get((t, y, x)) == 0 for y in range(y0, y0 + size) for x in range(x0, x0 + size))
                    want[t] = max(want.get(t, (-1, 0, 0)), (n, -y0, -x0))
        got = {q.tile_id: (round(q.ratio * size * size), -q.y0, -q.x0) for q in grid.smart_crop(px, size, 0.0).collect()}
        assert got == want
