"""Extremely randomised trees against a plain version that grows one node after the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileframe.operators import extratrees, sampling
from tileframe.operators.raster import compare

NAMES = ("a", "b", "c", "d")


def plain_tree(rows, tree, seed, tries, leaf, depth, classes):
    """feature, threshold and leaf shares by place in the tree; rows are (x, y, w)."""
    total = [sum(w for _, y, w in rows if y == c) for c in classes]
    balance = [sum(total) / (sum(t > 0 for t in total) * t) if t else 0.0 for t in total]
    out = {}

    def draw(place, f, what):
        return float(extratrees.uniform(seed, np.array([tree]), np.array([place]), f, what)[0])

    def grow(rows, place, deep):
        weights = [sum(w for _, y, w in rows if y == c) * b for c, b in zip(classes, balance, strict=True)]
        out[place] = (None, None, [w / sum(weights) for w in weights])
        if deep == depth or len(rows) < 2 * leaf or sum(w > 0 for w in weights) < 2:
            return
        low, high = [min(x[f] for x, _, _ in rows) for f in range(4)], [max(x[f] for x, _, _ in rows) for f in range(4)]
        order = sorted(range(4), key=lambda f: draw(place, f, 1))
        tried = [f for f in order[:tries] if high[f] > low[f]] or [f for f in order if high[f] > low[f]][:1]
        best = None
        for f in tried:
            cut = low[f] + draw(place, f, 2) * (high[f] - low[f])
            sides = [[r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]]
            if min(map(len, sides)) < leaf:
                continue
            gain = 0
            for side in sides:
                own = [sum(w for _, y, w in side if y == c) * b for c, b in zip(classes, balance, strict=True)]
                gain += sum(w * w for w in own) / sum(own)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, cut, sides)
        if best:
            out[place] = (best[1], best[2], None)
            grow(best[3][0], 2 * place, deep + 1)
            grow(best[3][1], 2 * place + 1, deep + 1)

    grow(rows, 1, 0)
    return out


def as_places(model, tree):
    out, todo = {}, [(tree, 1)]
    while todo:
        at, place = todo.pop()
        f = int(model.feature[at])
        out[place] = (None, None, list(model.shares[at])) if f < 0 else (f, float(model.threshold[at]), None)
        if f >= 0:
            todo += [(int(model.left[at]), 2 * place), (int(model.left[at]) + 1, 2 * place + 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = []
    for i in range(240):
        x = (r.randrange(6) / 2, r.random(), 1.0, r.gauss(0, 1))
        out.append((*x, int(x[1] + 0.3 * x[0] + r.random() > 1.6), r.choice((1.0, 2.0, 2.5)), "pqr"[i % 3]))
    return out


def test_same_trees_as_one_by_one(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, target int, weight double, series string").repartition(5)
    monkeypatch.setattr(extratrees, "SLOTS", 7)  # several passes a level
    model = extratrees.fit_extra_trees(df, NAMES, trees=6, depth=5, leaf=4, seed=11, leave_out="series")
    assert model.folds == ("p", "q", "r") and model.trees == 6 and (model.feature >= 0).sum() > 3 * 18
    for fold, out in enumerate("pqr"):
        own = [(x[:4], x[4], round(x[5] * extratrees.UNIT)) for x in rows if x[6] != out]
        for t in range(fold * 6, fold * 6 + 6):
            want, got = plain_tree(own, t, 11, 2, 4, 5, [0, 1]), as_places(model, t)
            assert want.keys() == got.keys()
            for place, (f, cut, shares) in want.items():
                assert got[place][0] == f and got[place][1] == cut
                assert shares is None or np.allclose(shares, got[place][2])
    # Each row is judged by the trees without its series.
    got = extratrees.predict(model, df, fold_of="series").collect()
    for r in got:
        fold, x = "pqr".index(r.series), (r.a, r.b, r.c, r.d)
        shares = []
        for t in range(fold * 6, fold * 6 + 6):
            tree, place = as_places(model, t), 1
            while tree[place][0] is not None:
                place = 2 * place + (x[tree[place][0]] > tree[place][1])
            shares.append(tree[place][2])
        assert r.pred == int(np.argmax(np.mean(shares, 0)))


def test_awkward_rows(spark, rows):
    schema = "a double, b double, c double, d double, target int, weight double, series string"
    odd = [(None, 1.0, 1.0, 1.0, 1, 1.0, "p"), (float("nan"), 1.0, 1.0, 1.0, 1, 1.0, "p"), (1.0, 1.0, 1.0, 1.0, None, 1.0, "p"), (1.0, 1.0, 1.0, 1.0, 1, None, "p")]
    a = extratrees.fit_extra_trees(spark.createDataFrame(rows, schema), NAMES, trees=3, leaf=5)
    b = extratrees.fit_extra_trees(spark.createDataFrame(rows + odd, schema).repartition(3), NAMES, trees=3, leaf=5)
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and np.array_equal(a.shares, b.shares)
    got = extratrees.predict(b, spark.createDataFrame(rows + odd, schema).withColumn("pred", F.lit("taken")), "guess").collect()
    assert sum(r.guess is None for r in got) == 2 and {r.pred for r in got} == {"taken"}
    none = extratrees.fit_extra_trees(spark.createDataFrame([], schema), NAMES, trees=3)
    assert {r.pred for r in extratrees.predict(none, spark.createDataFrame(rows, schema)).collect()} == {None}
    same = extratrees.fit_extra_trees(spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, k % 2, 1.0, "p") for k in range(40)], schema), NAMES, trees=2)
    assert (same.feature == -1).all() and np.allclose(same.shares, 0.5)
    with pytest.raises(ValueError, match="nodes"):
        extratrees.fit_extra_trees(spark.createDataFrame(rows, schema), NAMES, trees=3, max_nodes=4)


def test_forest_on_the_twelve_features(spark):
    """Dark discs, small ones of class 0 and large ones of class 1: what was held out is told apart, and the gate is kept."""
    r, cells = random.Random(2), []
    for t in range(6):
        grid = {(y, x): (220, 2) for y in range(60) for x in range(60)}
        for k in range(9):
            cy, cx, size = 10 + 20 * (k // 3), 10 + 20 * (k % 3), 2 if (k + t) % 2 else 7
            for y in range(cy - size, cy + size + 1):
                for x in range(cx - size, cx + size + 1):
                    grid[y, x] = (r.randrange(20, 90), int(size > 3))
        cells += [(t, y, x, v, c) for (y, x), (v, c) in grid.items()]
    px = spark.createDataFrame(cells, "tile_id int, y int, x int, v int, target int")
    f = compare.features(px).join(px.select("tile_id", "y", "x", "target"), ["tile_id", "y", "x"]).withColumn("series", F.col("tile_id") % 3)
    samples = sampling.assemble_samples(f, 60, 1)
    _, means = sampling.group_cv(samples, "series", compare.FEATURES, trees=12)
    assert all(v > 0.9 for k, v in means.first().asDict().items() if "iou" in k)
    rated = sampling.predict_gated(sampling.fit_forest(samples, compare.FEATURES, trees=12), f)
    assert rated.count() == 6 * 3600 and rated.where("v >= 100 and pred <> 2").isEmpty() and rated.where("v < 100 and pred <> target").count() < 100
