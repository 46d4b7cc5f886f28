"""Trees that tasks grow whole, grown below passes, and grown to judge what was left out: the same trees."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileframe.operators import extratrees, sampling

NAMES = ("a", "b", "c", "d")
SCHEMA = "a double, b double, c double, d double, target int, weight double, series string"


def made(n, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = (r.randrange(6) / 2, r.random(), 1.0, r.gauss(0, 1))
        rows.append((*x, int(x[1] + 0.3 * x[0] + r.random() > 1.6), r.choice((1.0, 2.0, 2.5)), "pqr"[i % 3]))
    return rows


@pytest.mark.parametrize("leave_out", [None, "series"])
def test_same_trees_with_and_without_passes(spark, monkeypatch, leave_out):
    df = spark.createDataFrame(made(300), SCHEMA).repartition(3)
    rows = np.array([x[:4] for x in made(300)])
    found = []
    for held in (10**6, 60, 1):
        monkeypatch.setattr(extratrees, "HELD_ROWS", held)
        model = extratrees.fit_extra_trees(df, NAMES, trees=4, depth=6, leaf=4, leave_out=leave_out)
        found.append([(model.feature >= 0).sum(), *[model.probabilities(rows, fold) for fold in range(len(model.folds))]])
    for other in found[1:]:
        assert other[0] == found[0][0] and all(np.array_equal(a, b) for a, b in zip(found[0][1:], other[1:], strict=True))


@pytest.mark.parametrize("held", [10**6, 60])
def test_left_out_as_by_the_model(spark, monkeypatch, held):
    monkeypatch.setattr(extratrees, "HELD_ROWS", held)
    odd = [(None, 1.0, 1.0, 1.0, 1, 1.0, "p"), (1.0, 0.5, 1.0, 1.0, None, 1.0, "p"), (1.0, 0.5, 1.0, 1.0, 1, None, "q"), (1.0, 0.5, 1.0, 1.0, None, None, "alone"), (1.0, float("nan"), 1.0, 1.0, 0, 1.0, None)]
    df = spark.createDataFrame(made(200) + odd + [(*x[:6], None) for x in made(30, 8)], SCHEMA).repartition(3)
    model = extratrees.fit_extra_trees(df, NAMES, trees=5, leaf=4, leave_out="series")
    want = extratrees.predict(model, df, fold_of="series").select("series", "target", "weight", "pred").collect()
    got = extratrees.predict_left_out(df, "series", NAMES, trees=5, leaf=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r.pred is None for r in got) == 3
    one = extratrees.predict_left_out(df.where("series = 'p'"), "series", NAMES, trees=5).select("pred").distinct().collect()
    assert [r.pred for r in one] == [None]


def test_no_jobs_for_each_level_or_fold(spark, monkeypatch):
    """Deep forests of many folds take a fixed number of jobs; what comes to the driver does not grow with their nodes."""
    rows = [(*x[:6], str(k % 12)) for k, x in enumerate(made(600))]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(extratrees, "level", None)  # no pass
    monkeypatch.setattr(extratrees, "fit_extra_trees", None)  # no model on the driver
    began = time.time()
    cm, means = sampling.group_cv(df, "series", NAMES, trees=40, leaf=2)
    assert means.first().groups == 12 and cm.agg(F.sum("n")).first()[0] == pytest.approx(sum(x[5] for x in rows))
    assert time.time() - began < 120


def test_pixels_are_read_once(spark):
    """What is inside the gate and what is outside come from one pass over the features."""
    df = spark.createDataFrame([(*x, 50 + 100 * (k % 2)) for k, x in enumerate(made(120))] + [(0.5, 0.5, 1.0, 0.0, 1, 1.0, "p", None)], f"{SCHEMA}, v int")
    model = extratrees.fit_extra_trees(df, NAMES, trees=3)
    same = df.mapInArrow(lambda batches: batches, df.schema)
    rated = sampling.predict_gated(model, same)
    assert rated._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    got = rated.collect()
    assert len(got) == 121 and all((r.pred == 2) == (r.v != 50) for r in got)
    want = {str(r) for r in extratrees.predict(model, df.where("v < 100"), "pred").collect()}
    assert {str(r) for r in got if r.v == 50} == want
    with pytest.raises(Exception, match="pore classes"):
        sampling.predict_gated(model, spark.createDataFrame([(None, 0.5, 1.0, 0.0, 1, 1.0, "p", 50)], f"{SCHEMA}, v int")).collect()
