"""Draws by splits, running sums over ranges, and beta quantiles."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileframe.functions import beta
from tileframe.operators import bootstrap, curves, metrics, ranks, resampling
from tileframe.operators.raster import augment


def plain_draws(seed, reps, tiles):
    """Every range split in turn, from all tiles down to single ones: replicates x tiles."""
    out, todo = np.zeros((reps, tiles), "int64"), [(0, 1 << max(0, tiles - 1).bit_length(), np.full(reps, tiles))]
    while todo:
        start, size, counts = todo.pop()
        if start >= tiles:
            assert not counts.any()
        elif size == 1:
            out[:, start] = counts
        else:
            left = resampling.halves(seed, counts, start, size, tiles)
            todo += [(start, size // 2, left), (start + size // 2, size // 2, counts - left)]
    return out


@pytest.mark.parametrize("tiles", [1, 2, 5, 64, 131])
def test_each_replicate_draws_as_many_as_there_are(tiles):
    drawn = plain_draws(7, 300, tiles)
    assert (drawn.sum(1) == tiles).all() and (drawn >= 0).all()
    if tiles > 4:
        assert abs(drawn.mean() - 1) < 1e-12 and abs(drawn.var() - (1 - 1 / tiles)) < 0.1
        assert np.abs(drawn.mean(0) - 1).max() < 0.35


def test_sums_of_replicates(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 16)
    monkeypatch.setattr(resampling, "LEAVES", 4)
    r = random.Random(3)
    rows = [(t, m, r.randrange(100), r.random()) for t in range(45) for m in ("a", "b", None) if r.random() < 0.8] + [(None, "a", 5, 1.0), (3, "a", None, None)]
    df = spark.createDataFrame(rows, "tile_id int, m string, n int, x double")
    order = sorted({t for t, *_ in rows if t is not None})
    drawn = plain_draws(5, 20, len(order))
    want = collections.defaultdict(lambda: [0, 0.0])
    for t, m, n, x in rows:
        if t is not None:
            for rep in range(20):
                times = int(drawn[rep, order.index(t)])
                want[m, rep][0] += times * (n or 0)
                want[m, rep][1] += times * (x or 0.0)
    got = {(q.m, q.rep): (q.n, q.x) for q in resampling.replicate_sums(df, 20, 5, ["m"], ["n", "x"]).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == v[0] and math.isclose(got[k][1], v[1], abs_tol=1e-9) for k, v in want.items())
    # The same whatever the blocks.
    monkeypatch.setattr(resampling, "BLOCK", 64)
    assert {(q.m, q.rep): q.n for q in resampling.replicate_sums(df, 20, 5, ["m"], ["n"]).collect()} == {k: v[0] for k, v in got.items()}
    assert resampling.replicate_sums(df.where("false"), 20, 5, [], ["n"]).collect() == []


def test_intervals_by_splits(spark):
    r = random.Random(4)
    cm = spark.createDataFrame([(t, a, p, r.randrange(1, 30)) for t in range(12) for a in range(3) for p in range(3)], "tile_id int, true_id int, pred_id int, n bigint")
    a, b = ({(x.class_id, x.metric): x for x in bootstrap.bootstrap(cm, 400, 9, by=by).collect()} for by in ("splits", "hash"))
    assert a.keys() == b.keys() and all(abs(a[k].low - b[k].low) < 0.05 and abs(a[k].high - b[k].high) < 0.05 and a[k].n_reps == 400 for k in a)
    assert sorted(map(str, a.values())) == sorted(map(str, bootstrap.bootstrap(cm.repartition(5), 400, 9).collect()))
    whole = {(x.class_id, "iou"): x.iou for x in metrics.class_metrics(cm.groupBy("true_id", "pred_id").agg(F.sum("n").alias("n")), []).collect()}
    assert all(a[k].low <= v <= a[k].high for k, v in whole.items())


def test_running_sums(spark):
    r = random.Random(6)
    rows = [(r.choice([None, *range(40)]), r.randrange(5), r.randrange(3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "score int, a int, b int").repartition(6)
    for descending in (False, True):
        key = lambda s: (s is None) if descending else (s is not None), (lambda s: 0 if s is None else -s if descending else s)
        place = lambda s: (key[0](s), key[1](s))  # noqa: E731, B023
        for q in ranks.running_sums(df, "score", ["a", "b"], descending).collect():
            assert q.a_upto == sum(a for s, a, _ in rows if place(s) <= place(q.score)) and q.b_all == sum(b for _, _, b in rows)


def test_roc_without_keys_has_no_task_for_all_scores(spark):
    df = spark.createDataFrame([(k / 50, int(k * 7 % 11 > 4)) for k in range(50)] * 2, "score double, label int")
    plan = curves.roc_points(df)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    # What meets in one task are sums: one row for each range of scores.
    assert all("HashAggregate" in lines[k + 1] for k, line in enumerate(lines) if "SinglePartition" in line)
    got = sorted((q.tp, q.fp, q.threshold) for q in curves.roc_points(df).collect() if q.threshold is not None)
    want = sorted((2 * sum(int(j * 7 % 11 > 4) for j in range(k, 50)), 2 * sum(int(j * 7 % 11 <= 4) for j in range(k, 50)), k / 50) for k in range(50))
    assert got == want
    pos, neg = [k for k in range(50) if k * 7 % 11 > 4], [k for k in range(50) if k * 7 % 11 <= 4]
    assert math.isclose(curves.roc(df).first().auc, sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)))
    assert curves.roc(df.where("label = 1")).collect() == curves.roc_points(df.where("label = 1")).collect() == []


def test_beta_quantiles():
    u = np.array([0.0, 1e-12, 1e-5, 0.01, 0.2, 0.5, 0.77, 0.99, 1 - 1e-9, 1.0])
    assert np.abs(beta.beta_quantile(u, 1, 1) - u).max() < 1e-12
    assert np.abs(beta.beta_quantile(u, 2, 1) - np.sqrt(u)).max() < 1e-9
    assert np.abs(beta.beta_quantile(u, 1, 3) - (1 - (1 - u) ** (1 / 3))).max() < 1e-9
    assert np.abs(beta.beta_quantile(u, 0.5, 0.5) - np.sin(math.pi * u / 2) ** 2).max() < 1e-9
    # Three uniform numbers' middle one: 3 x^2 - 2 x^3.
    x = beta.beta_quantile(u, 2, 2)
    assert np.abs(3 * x**2 - 2 * x**3 - u).max() < 1e-12
    for a, b in ((0.2, 0.2), (0.4, 1.7), (8, 3), (30, 0.3)):
        x = beta.beta_quantile(u, a, b)
        assert (np.diff(x) >= 0).all() and np.abs(beta.beta_cdf(x, a, b) - u).max() < 1e-9
    # A sum over small steps, for one pair of parameters without a closed form.
    t = (np.arange(400_000) + 0.5) / 400_000
    density = t**1.4 * (1 - t) ** 2.6
    share = np.cumsum(density) / density.sum()
    assert np.abs(beta.beta_cdf(t[::4000] + 0.5 / 400_000, 2.4, 3.6) - share[::4000]).max() < 1e-9
    with pytest.raises(ValueError):
        beta.beta_quantile(u, 0.0, 1.0)


def test_shares_are_drawn_for_each_pair(spark):
    px = spark.range(40 * 9).select((F.col("id") / 9).cast("int").alias("tile_id"), (F.col("id") % 9 / 3).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("x"), (F.col("id") % 200).cast("int").alias("v"), (F.col("id") % 3).cast("int").alias("target"))
    mixed = augment.mixup(px, 5, alpha=0.4)
    assert mixed.count() == 360 and 30 < mixed.select("lam").distinct().count() <= 40
    v, t = ({(r.tile_id, r.y, r.x): r[c] for r in px.collect()} for c in ("v", "target"))
    for r in mixed.collect():
        a, b = (r.tile_id, r.y, r.x), (r.other, r.y, r.x)
        assert math.isclose(r.v, r.lam * v[a] + (1 - r.lam) * v[b], abs_tol=1e-9) and r.target == (t[a] if r.lam > 0.5 else t[b])
    cut = augment.cutmix(px, 5, alpha=1.0)
    for r in cut.groupBy("tile_id", "lam").agg(F.count("*").alias("n")).collect():
        assert r.n == 9 and min(abs(r.lam - (1 - k / 9)) for k in (0, 1, 4, 9)) < 1e-9
