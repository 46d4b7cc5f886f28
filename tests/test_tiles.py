"""What is worked out in one group of a tile or of a band of its rows, against brute force; NULL values and unreadable images."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileframe.operators.metrics import confusion
from tileframe.operators.raster import compare, components, distance, filters, tiles
from tileframe.sources import read_tiles


def table(spark, *grids, **more):
    rows = [(t, y, x, int(v)) for t, g in enumerate(grids) for y, line in enumerate(g) for x, v in enumerate(line) if v is not None]
    return spark.createDataFrame(rows, "tile_id int, y int, x int, v int")


def blobs(seed, h=26, w=31, n=9):
    """A raster of dark discs that run into each other, with plateaus, ridges and regions too small for a peak."""
    r = random.Random(seed)
    g = [[255] * w for _ in range(h)]
    for _ in range(n):
        cy, cx, k = r.randrange(h), r.randrange(w), r.choice((1, 2, 4, 6))
        for y in range(h):
            for x in range(w):
                if abs(y - cy) + (abs(x - cx) if seed % 2 else 0) <= k and abs(x - cx) <= k:
                    g[y][x] = 10
    return g


def plain_squares(g):
    off = [(y, x) for y, line in enumerate(g) for x, v in enumerate(line) if v >= 100]
    return {(y, x): min((y - a) ** 2 + (x - b) ** 2 for a, b in off) for y, line in enumerate(g) for x, v in enumerate(line) if v < 100}


def plain_regions(on):
    left, out = set(on), {}
    while left:
        todo, region = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                region.add(p)
                todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        out |= dict.fromkeys(region, min(region))
    return out


def plain_markers(d, least, separation):
    """Greedy, one pixel after the other, over all that are the greatest of their square."""
    peaks = [p for p, v in d.items() if v > least * least and all(v >= d.get((p[0] + a, p[1] + b), 0) for a in range(-separation, separation + 1) for b in range(-separation, separation + 1))]
    kept = []
    for p in sorted(peaks, key=lambda p: (-d[p], p)):
        if all(max(abs(p[0] - a), abs(p[1] - b)) >= separation for a, b in kept):
            kept.append(p)
    regions = plain_regions(d)
    for root in sorted(set(regions.values())):
        if not any(regions[p] == root for p in kept):
            kept.append(min((p for p in d if regions[p] == root), key=lambda p: (-d[p], p)))
    return kept


def plain_flood(d, seeds):
    """A priority flood, the label written when a pixel is pushed."""
    label, queue, age = {}, [], 0
    for p in seeds:
        label[p] = p
        heapq.heappush(queue, (-d[p], age, p))
        age += 1
    while queue:
        _, _, (y, x) = heapq.heappop(queue)
        for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)):
            q = (y + a, x + b)
            if q in d and q not in label:
                label[q] = label[y, x]
                heapq.heappush(queue, (-d[q], age, q))
                age += 1
    return label


@pytest.fixture(scope="module")
def grids():
    return [blobs(k) for k in range(5)]


def test_markers_are_a_greedy_choice(spark, grids):
    px = table(spark, *grids).withColumn("mask", F.col("v") < 100)
    for least, separation in ((1.0, 3), (0.5, 2), (2.0, 5)):
        got = {(r.tile_id, r.rank): (r.y, r.x) for r in distance.markers(px, "mask", least, separation).collect()}
        want = {(t, k): p for t, g in enumerate(grids) for k, p in enumerate(plain_markers(plain_squares(g), least, separation))}
        assert got == want


def test_watershed_is_a_priority_flood(spark, grids):
    px = table(spark, *grids).withColumn("mask", F.col("v") < 100)
    want = {}
    for t, g in enumerate(grids):
        d = plain_squares(g)
        for p, root in plain_flood(d, plain_markers(d, 1.0, 3)).items():
            want[t, *p] = root[0] << 24 | root[1]
    got = {(r.tile_id, r.y, r.x): r.region_id for r in distance.watershed(px, "mask", 1.0, 3).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and len(got) == 5 * 26 * 31
    assert {(r.tile_id, r.y, r.x): r.region_id for r in distance.seeded_regions(px, distance.markers(px, "mask", 1.0, 3)).collect()} == want
    assert len(set(want.values())) > len(plain_regions(plain_squares(grids[0])).values()) / 400


def test_watershed_rule(spark, grids):
    """The rule end to end: sizes of flooded regions against a cutoff, then counts against a target."""
    cut = 20
    px = table(spark, *grids).withColumn("target", F.when(F.col("v") >= 100, 2).otherwise(F.col("x") % 2))
    want = {}
    for t, g in enumerate(grids):
        d = plain_squares(g)
        label = plain_flood(d, plain_markers(d, 1.0, 3))
        sizes = {}
        for root in label.values():
            sizes[root] = sizes.get(root, 0) + 1
        for y in range(26):
            for x in range(31):
                key = (t, x % 2 if (y, x) in d else 2, (0 if sizes[label[y, x]] < cut else 1) if (y, x) in d else 2)
                want[key] = want.get(key, 0) + 1
    rated = distance.classify_by_watershed(px, cut, least=1.0, separation=3)
    assert {(r.tile_id, r.true_id, r.pred_id): r.n for r in confusion(rated).where("n > 0").collect()} == want


def test_lower_envelope():
    r = np.random.default_rng(3)
    for _ in range(200):
        h, w = r.integers(1, 12, 2)
        zero = r.random((h, w)) < r.choice([0.05, 0.4])
        zero[r.integers(h), r.integers(w)] = True
        y, x = np.mgrid[:h, :w]
        a, b = np.nonzero(zero)
        assert (tiles.square_distances(zero) == ((y[..., None] - a) ** 2 + (x[..., None] - b) ** 2).min(-1)).all()


def test_squares():
    r = np.random.default_rng(4)
    for k in range(1, 8):
        v = r.integers(0, 9, (7, 9))
        near = lambda y, x: v[max(0, y - k // 2) : y + k - k // 2, max(0, x - k // 2) : x + k - k // 2]  # noqa: E731, B023
        sums, most = tiles.square_sums(v, k), tiles.square_extremes(v, k, -1)
        assert all(sums[y, x] == near(y, x).sum() and most[y, x] == near(y, x).max() for y in range(7) for x in range(9))


def test_bands_give_what_whole_tiles_give(spark):
    r = random.Random(5)
    px = table(spark, *[[[r.randrange(256) for _ in range(13)] for _ in range(29)] for _ in range(2)]).withColumn("mask", F.col("v") < 120)

    def same(f, band=8):
        whole, cut = ({(x.tile_id, x.y, x.x): tuple(x)[3:] for x in df.collect()} for df in (f(None), f(band)))
        assert whole.keys() == cut.keys() and len(whole) == 2 * 29 * 13
        for k, v in whole.items():
            assert all(a == b if not isinstance(a, float) else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(v, cut[k], strict=True))

    same(lambda b: filters.box_mean(px, 7, band=b))
    same(lambda b: filters.box_mean(px, 31, band=b))  # the halo is longer than a band
    same(lambda b: filters.gaussian(px, 1.0, band=b))
    same(lambda b: filters.local_std(px, 7, band=b))
    same(lambda b: filters.sobel(px, band=b))
    same(lambda b: filters.laplacian_of_gaussian(px, band=b))
    for k in (2, 3, 5):
        same(lambda b, k=k: filters.erode(px, k, band=b))
        same(lambda b, k=k: filters.dilate(px, k, band=b))
        same(lambda b, k=k: filters.close(px, k, band=b))
        same(lambda b, k=k: filters.extreme(px, k, "v", "most", band=b))
    same(lambda b: filters.boundary(px, "mask", band=b))


def with_holes(spark):
    """Tile 0 has a pixel without a value, tile 1 is an unreadable image, tile 2 has both and a NULL mask."""
    px = table(spark, [[10, 10, 200], [10, 10, 200], [200, 200, 200]]).withColumn("v", F.when((F.col("y") != 1) | (F.col("x") != 1), F.col("v")))
    bad = spark.createDataFrame([(1, None, None, None)], px.schema)
    return px.unionByName(bad).unionByName(px.withColumn("tile_id", F.lit(2))).unionByName(bad.withColumn("tile_id", F.lit(2)))


def test_missing_values_and_coordinates(spark):
    px = with_holes(spark).withColumn("mask", F.col("v") < 100)
    got = {(r.tile_id, r.y, r.x): r.distance for r in distance.distance(px).collect()}
    assert len(got) == 9 + 1 + 9 + 1 and got[0, 1, 1] == 0.0 and got[0, 0, 0] == math.sqrt(2) and got[0, 0, 1] == 1.0 and got[1, None, None] is None and got[2, None, None] is None
    assert {(r.tile_id, r.y, r.x) for r in distance.markers(px).collect()} == {(0, 0, 0), (2, 0, 0)}
    assert distance.watershed(px).where("region_id is not null").count() == 6 and distance.classify_by_watershed(px.drop("mask"), 2).where("pred = 1").count() == 6
    mean = {(r.tile_id, r.y, r.x): r.v for r in filters.box_mean(px, 3).collect()}
    assert mean[0, 1, 1] is None and mean[1, None, None] is None and all(v is not None for k, v in mean.items() if k not in {(0, 1, 1), (2, 1, 1), (1, None, None), (2, None, None)})
    f = {(r.tile_id, r.y, r.x): r for r in compare.features(px).collect()}
    assert len(f) == 20 and f[0, 1, 1].distance is None and f[2, None, None].area is None and math.isclose(f[0, 0, 0].area, math.log1p(3) / math.log1p(8))
    assert filters.dilate(px, 3).where("tile_id = 0 and mask").count() == 8 and filters.dilate(px, 3).where("y is null").count() == 2
    both = px.withColumns({"target": F.when(F.col("v").isNull(), 2).when(F.col("v") < 100, 0).otherwise(2), "pred": F.lit(2)})
    s = {r.tile_id: r for r in compare.tile_statistics(both).collect()}
    assert set(s) == {0, 2} and (s[0].pixels, s[0].c0_true, s[0].components_true, s[0].boundary_true) == (9, 3, 1, 3)
    assert distance.hausdorff(both, 0).where("hausdorff <> 0").count() == 0 and distance.boundary_weights(both).count() == 20
    assert components.components(px).count() == 6


def test_a_folder_with_an_unreadable_image(spark, tmp_path):
    from pathlib import Path

    (tmp_path / "bad.png").write_bytes(b"no image")
    px = read_tiles(spark, str(tmp_path))
    assert compare.features(px.select("tile_id", "y", "x", "v")).where("gray is not null").count() == 0
    assert distance.distance(px.withColumn("mask", F.col("v") < 100)).count() == px.count()
    assert Path(tmp_path).exists()


def test_arrays_span_the_box_of_the_pixels(spark):
    px = spark.createDataFrame([(1, 10**6 + y, 10**6 + x, y == x == 1) for y in range(3) for x in range(3)], "tile_id int, y int, x int, mask boolean")
    assert {r.distance for r in distance.distance(px).collect()} == {0.0, 1.0}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_shuffle_of_the_pixels(spark, tmp_path):
    """On stored pixels, each of these deals the pixels out once."""
    px = table(spark, [[10, 200], [200, 10]]).withColumns({"target": F.lit(1), "pred": F.lit(2)})
    px.write.parquet(f"{tmp_path}/px")
    px = spark.read.parquet(f"{tmp_path}/px")
    assert [exchanges(f(px)) for f in (compare.boundary_counts, compare.tile_statistics, compare.features)] == [1, 1, 1]
    assert exchanges(compare.tile_diagnostics(px)) == 1 and exchanges(distance.watershed(px.withColumn("mask", F.col("v") < 100))) == 1
