"""Scores, readers and choices against numbers worked out by hand."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tileframe.functions import check_grayscale
from tileframe.operators import audit, curves, losses, metrics, ranks, selection
from tileframe.operators.raster import augment, compare, components, distance
from tileframe.sources import read_run_summaries


def one(df):
    return df.first()


def test_tversky_weighs_false_positives_by_alpha(spark):
    df = spark.createDataFrame([(1, 0, [0.6, 0.3, 0.1]), (1, 1, [0.5, 0.5, 0.0])], "tile_id int, target int, probs array<double>")
    # Class 0: tp 0.6, fp 0.5, fn 0.4; class 1: tp 0.5, fp 0.3, fn 0.5; class 2: tp 0, fp 0.1, fn 0.
    def index(a, b, smooth=1e-6):
        return [(tp + smooth) / (tp + a * fp + b * fn + smooth) for tp, fp, fn in ((0.6, 0.5, 0.4), (0.5, 0.3, 0.5), (0.0, 0.1, 0.0))]

    got = one(losses.tversky(df))
    assert math.isclose(got.tversky, sum(index(0.7, 0.3)) / 3) and math.isclose(got.focal_tversky, sum((1 - x) ** 2 for x in index(0.7, 0.3)) / 3)
    # Shares are one half, one half and none: 0.3 and 0.7 twice, then 0.7 and 0.3.
    want = [index(0.3, 0.7)[0], index(0.3, 0.7)[1], index(0.7, 0.3)[2]]
    got = one(losses.tversky(df, adaptive=True, weights=[100, 10, 1]))
    assert math.isclose(got.tversky, (100 * want[0] + 10 * want[1] + want[2]) / 111)


def test_sparse_score(spark):
    rows = [(1, 2, [0.9, 0.05, 0.05]), (1, 0, [0.8, 0.1, 0.1]), (1, 2, [0.1, 0.1, 0.8]), (1, 0, [0.2, 0.7, 0.1]), (1, -100, [1.0, 0.0, 0.0])]
    terms = [10 * 0.95**2 * -math.log(0.05), 3 * 0.2**2 * -math.log(0.8), 0.2**2 * -math.log(0.8), 0.8**2 * -math.log(0.2)]
    got = one(losses.sparse_score(spark.createDataFrame(rows, "tile_id int, target int, probs array<double>")))
    assert math.isclose(got.focal, sum(terms) / 4) and got.pore_ratio == 0.75 and math.isclose(got.score, sum(terms) / 4 * (1 + 10 * (0.75 - 0.15)))
    ignored = one(losses.sparse_score(spark.createDataFrame(rows[-1:], "tile_id int, target int, probs array<double>")))
    assert (ignored.focal, ignored.pore_ratio, ignored.score) == (0.0, 0.0, 0.0)


def test_hierarchical_score(spark):
    rows = [(0, [0.5, 0.3, 0.2]), (1, [0.2, 0.6, 0.2]), (2, [0.0, 0.1, 0.9]), (-100, [0.9, 0.1, 0.0])]
    s = 1e-6
    dice = lambda i, p, t: 1 - (2 * i + s) / (p + t + s)
    region = (dice(0.5, 0.7, 1) + dice(0.6, 1.0, 1) + dice(0.9, 1.3, 1)) / 3
    union = dice(0.8 + 0.8, 0.8 + 0.8 + 0.1, 2)
    w0, w1 = math.sqrt(100 / 20), math.sqrt(100 / 80)
    conditional = (w0 * dice(0.625, 0.625 + 0.25, 1) + w1 * dice(0.75, 0.375 + 0.75, 1)) / (w0 + w1)
    got = one(losses.hierarchical_score(spark.createDataFrame(rows, "target int, probs array<double>"), (20, 80), weights=(1, 1, 2)))
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip((got.region, got.pore_union, got.conditional, got.loss), (region, union, conditional, (region + union + 2 * conditional) / 4), strict=True))


def test_curriculum(spark):
    p = compare.curriculum_percentile
    assert [p(e, 60, 5) for e in (0, 4, 5, 18, 19, 32, 33, 46, 47, 59)] == [0.3, 0.3, 0.3, 0.3, 0.6, 0.6, 0.9, 0.9, 1.0, 1.0]
    assert [p(e, 60, 5, "staged") for e in (4, 5, 17, 18, 31, 44, 59)] == [0.3, 0.3, 0.3, 0.6, 0.9, 1.0, 1.0] and p(9, 60, 5, "none") is None
    with pytest.raises(ValueError):
        p(1, 60, 5, "random")
    d = spark.createDataFrame([(k, k / 10) for k in range(11)], "tile_id int, difficulty double")
    samples = d.select("tile_id").unionByName(spark.createDataFrame([(99,)], "tile_id int"))
    warm = {r.tile_id: r.weight for r in compare.curriculum(samples, d, 2, 60).collect()}
    assert set(warm) == {0, 1, 2, 3, 99} and math.isclose(warm[2], 0.9) and warm[99] == 1.0
    later = {r.tile_id: r.weight for r in compare.curriculum(samples, d, 20, 60).collect()}
    assert set(later) == {*range(7), 99} and math.isclose(later[2], 1 + 0.2 * 15 / 55)


def test_run_summaries(spark, tmp_path):
    def put(path, text):
        folder = tmp_path / path
        folder.mkdir(parents=True)
        (folder / "training_summary.json").write_text(text)

    put("ablation/depth/run_20260101_1200_unet_big", json.dumps({"final_metrics": {"best_pore_iou": "0.75", "final_mean_iou": 0.5, "best_val_loss": "nan"}, "training_config": {"epochs_trained": 12, "early_stopped": True, "learning_rate": 1e-4}}))
    put("patch_training/base", json.dumps({"final_metrics": {"best_pore_iou": "n/a"}}))
    put("misc/broken", "{not json")
    got = {r.run_name: r for r in read_run_summaries(spark, str(tmp_path)).collect()}
    assert set(got) == {"unet_big", "base"}
    a, b = got["unet_big"], got["base"]
    assert (a.group, a.early_stopped, a.epochs_trained, a.learning_rate, a.best_pore_iou, a.final_mean_iou, a.best_val_loss) == ("depth", True, 12.0, 1e-4, 0.75, 0.5, None)
    assert (b.group, b.early_stopped, b.epochs_trained, b.best_pore_iou) == ("patch_training", False, None, None)


def test_grayscale(spark):
    rows = [("one", 5, None, None, None, None), ("same", None, 7, 7, 7, 255), ("colour", None, 7, 8, 7, 255), ("clear", None, 7, 7, 7, 254), ("none", None, None, None, None, None)]
    got = {r.tile_id: r.is_grayscale for r in check_grayscale(spark.createDataFrame(rows, "tile_id string, v int, r int, g int, b int, a int")).collect()}
    assert got == {"one": True, "same": True, "colour": False, "clear": False, "none": False}


def test_byte_digest(spark):
    rows = [("s", "b/é.png", b"two"), ("s", "a.png", b""), ("t", "a.png", b"x")]
    df = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "scope string, name string, content binary")
    got = {r.scope: r for r in metrics.byte_digest(df, ["scope"]).collect()}
    assert got["s"].image_digest == hashlib.sha256(b"a.png\0\0" + "b/é.png".encode() + b"\0two\0").hexdigest()
    assert got["s"].names_digest == hashlib.sha256(json.dumps(["a.png", "b/é.png"], separators=(",", ":")).encode()).hexdigest() and got["t"].files == 1
    assert metrics.byte_digest(df.where("false"), ["scope"]).collect() == []
    # Lengths and sizes in eight bytes, names in order, one stream for all files and one for each scope.
    sized = df.select("scope", "name", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))

    def tree(files):
        stream = b"public-snapshot-tree-v1\0"
        for name, content in sorted(files):
            stream += len(name.encode()).to_bytes(8, "big") + name.encode() + len(content).to_bytes(8, "big") + hashlib.sha256(content).digest()
        return hashlib.sha256(stream).hexdigest()

    assert {r.scope: (r.files, r.tree_digest) for r in metrics.tree_digest(sized, ["scope"]).collect()} == {k: (sum(r[0] == k for r in rows), tree([r[1:] for r in rows if r[0] == k])) for k in "st"}
    many = [(f"d{k % 7}/{k}.bin", str(k).encode() * 3) for k in range(500)]
    whole = spark.createDataFrame([(n, bytearray(c)) for n, c in many], "name string, content binary").select("name", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))
    assert [(r.files, r.tree_digest) for r in metrics.tree_digest(whole.repartition(9)).collect()] == [(500, tree(many))]


def test_regions_across_bands(spark, monkeypatch):
    monkeypatch.setattr(components, "BAND", 4)
    on = {(y, 3) for y in range(11)} | {(y, 9 - abs(y - 5)) for y in range(11)} | {(0, 20), (10, 20)}
    px = spark.createDataFrame([(1, y, x, (y, x) in on) for y in range(11) for x in range(22)], "tile_id int, y int, x int, mask boolean")
    left, found = set(on), set()
    while left:
        todo, region = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                region.add(p)
                todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        found |= {(*p, min(region)[0] << 24 | min(region)[1]) for p in region}
    assert {(r.y, r.x, r.region_id) for r in components.components(px).collect()} == found


def test_the_deeper_marker_floods_first(spark):
    px = spark.createDataFrame([(1, 0, x, x != 7) for x in range(12)], "tile_id int, y int, x int, mask boolean")
    seeds = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 6, 6)], "tile_id int, y int, x int, marker bigint")
    assert {(r.x, r.region_id) for r in distance.seeded_regions(px, seeds).collect()} == {*((x, 0) for x in range(6)), (6, 6)}


def test_mixes_keep_every_pixel(spark):
    px = spark.createDataFrame([(t, p // 4, p % 4, 10 * t + p, p % 3) for t, n in ((1, 10), (2, 9), (3, 11)) for p in range(n)], "tile_id int, y int, x int, v int, target int")
    assert augment.mixup(px, 5, 0.6).count() == augment.cutmix(px, 5, 0.6).count() == 30
    whole = augment.mosaic(px.unionByName(px.withColumn("tile_id", F.col("tile_id") + 3)), 4, 5)
    assert whole.select("tile_id").distinct().count() == 6 and whole.select("mosaic_id").distinct().count() == 2


def test_ranks(spark):
    df = spark.createDataFrame([(i, i % 3, f"n{i:03d}") for i in range(100)], "id int, g int, name string")
    got = [r.name for r in ranks.ranked_by_value(df, "name").orderBy("_k").collect()]
    assert got == sorted(got) and len(got) == 100
    key = F.md5(F.col("name").cast("binary"))
    for g in range(3):
        rows = ranks.ranked_by_hash(df, key, ["id"], ["g"]).where(F.col("g") == g).orderBy("_k").collect()
        assert [r._k for r in rows] == list(range(1, len(rows) + 1)) and {r._t for r in rows} == {len(rows)}
        assert [r.name for r in rows] == sorted((r.name for r in rows), key=lambda x: hashlib.md5(x.encode()).hexdigest())


def test_roc_points_and_best_runs(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    assert [(r.threshold, r.tpr, r.fpr) for r in curves.roc_points(df).orderBy("tp", "fp").collect()] == [(None, 0.0, 0.0), (0.9, 0.5, 0.0), (0.8, 1.0, 0.5), (0.1, 1.0, 1.0)]
    runs = spark.createDataFrame([(f"r{k}", None if k % 5 == 0 else k / 10) for k in range(30)], "run_name string, iou double")
    best = selection.best_runs(runs, "iou").collect()
    assert len(best) == 15 and best[0].run_name == "r29" and all(r.iou is not None for r in best)


def test_reports_and_record_kinds(spark):
    tiles = spark.createDataFrame([("a", 2, 2, 1), ("b", 2, 2, 2)], "tile string, height int, width int, ordinal int")
    cm = spark.createDataFrame([("a", 0, 0, 3), ("a", 0, 1, 1), ("b", 1, 1, 4)], "tile string, true_id int, pred_id int, n bigint")
    right = metrics.class_metrics(cm, ["tile"]).select("tile", "class_id", "iou")
    whole = cm.groupBy("true_id", "pred_id").agg(F.sum("n").alias("n"))
    assert audit.check_report(tiles, cm, right, whole, (2, 2)).collect() == []
    bad = audit.check_report(tiles.withColumn("ordinal", F.col("ordinal") + 1), cm, right, whole.where("pred_id = 1"), (2, 3)).collect()
    assert sorted((r.tile or "", r.finding) for r in bad) == [("", "aggregate differs in 1 cells"), ("", "tile numbers don't run from 1"), ("a", "another shape"), ("b", "another shape")]
    texts = ["1", "-0.5e3", '"1"', "true", "null", "", None, "01", "1.0"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    for kind, fine in (("is_number", {0, 1, 8}), ("is_integer", {0}), ("is_string", {2}), ("is_boolean", {3})):
        assert {r.k for r in audit.check_records(rows, {"x": kind}, "k").collect()} == set(range(9)) - fine


def test_asymmetric_focal_with_class_weights(spark):
    rows = [(1, 0, [0.7, 0.2, 0.1]), (1, 2, [0.0, 1.0, 0.0])]
    pos, neg, clip = (0.5, 1.0, 2.0), (1.0, 3.0, 0.25), 1e-7
    total = 0.0
    for _, t, p in rows:
        for c in range(3):
            total += -pos[c] * (1 - p[c]) ** 2 * math.log(max(p[c], clip)) if c == t else -neg[c] * p[c] ** 4 * math.log(max(1 - p[c], clip))
    got = one(losses.asymmetric_focal(spark.createDataFrame(rows, "tile_id int, target int, probs array<double>"), alpha_pos=pos, alpha_neg=neg))
    assert math.isclose(got.asymmetric_focal, total / 2)


def test_counts_inside_rings(spark):
    px = spark.createDataFrame([(1, 0, 0, 0, True), (1, 0, 1, 2, True), (1, 0, 2, 0, False), (1, 0, 3, 1, None), (2, 0, 0, 2, False)], "tile_id int, y int, x int, target int, inside boolean")
    got = {r.tile_id: r for r in metrics.inside_histogram(px).collect()}
    assert (got[1].pixels, got[1].n_inside, got[1].n0_inside, got[1].n0_outside, got[1].n1_outside, got[1].n2_inside, got[2].n_inside) == (4, 2, 1, 1, 1, 1, 0)
    s = {r.name: r for r in metrics.describe_counts(metrics.inside_histogram(px), ["pixels", "n_inside"]).collect()}
    assert (s["pixels"].total, s["pixels"].mean, s["pixels"].median, s["n_inside"].least, s["n_inside"].most, s["n_inside"].tiles) == (5, 2.5, 2.5, 0, 2, 2)
