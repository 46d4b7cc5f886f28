"""Hand-computed fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from tileframe import functions as fn
from tileframe.operators import audit, bootstrap, metrics, pairing, sampling, selection
from tileframe.operators.raster import augment, compare, components, contours, distance, filters, grid
from tileframe.plans.queries import QUERIES
from tileframe.sources import audit_json, json_report, metric_csv, read_allowlist, read_coco, read_contract_csv, read_files, read_manifest, read_tiles, synthetic_tiles, write_once


def tile(spark, cells, name="t", **more):
    """cells: rows of values, or of tuples (v, target, pred)."""
    rows = [(name, y, x, *(c if isinstance(c, tuple) else (c,))) for y, line in enumerate(cells) for x, c in enumerate(line)]
    cols = ["v", "target", "pred"][: len(rows[0]) - 3]
    return spark.createDataFrame(rows, "tile_id string, y int, x int, " + ", ".join(f"{c} int" for c in cols))


def labels(spark, target, pred, v=50):
    return tile(spark, [[(v, t, p) for t, p in zip(a, b, strict=True)] for a, b in zip(target, pred, strict=True)])


def test_area_rule(spark):
    cells = [[255] * 7 for _ in range(5)]
    cells[1][1] = 0
    for x in (1, 2, 3):
        cells[3][x] = 0
    got = {(r.y, r.x): r.pred for r in components.classify_by_area(tile(spark, cells), 3).collect()}
    assert got[1, 1] == 0 and [got[3, x] for x in (1, 2, 3)] == [1, 1, 1]
    assert sorted(got.values()).count(2) == 31


def test_unassigned_gate_pixel_is_an_error(spark):
    df = spark.createDataFrame([(50, None)], "v int, area bigint")
    with pytest.raises(Exception, match="unassigned"):
        df.select(components.area_rule(F.col("area"), F.col("v") < 100, 3)).collect()


def test_confusion_and_metrics(spark):
    cm = metrics.confusion(labels(spark, [[0, 0, 1], [1, 2, 2]], [[0, 1, 1], [2, 2, 0]]))
    assert [r.n for r in cm.orderBy("true_id", "pred_id").collect()] == [1, 1, 0, 0, 1, 1, 1, 0, 1]
    m = metrics.class_metrics(cm)
    s = metrics.summary_metrics(m).first()
    assert s.accuracy == 0.5 and s.harmonic_iou == pytest.approx(2 / 9 / (2 / 3 + 1e-8))
    u = metrics.pore_union(cm).first()
    assert u.pore_union_iou == pytest.approx(3 / 5) and u.agreement == pytest.approx(4 / 6)
    merged = metrics.merge_classes(cm, metrics.PORE_VS_MINERAL).orderBy("true_id", "pred_id").collect()
    assert [r.n for r in merged] == [3, 1, 1, 1]


def test_undefined_ratios(spark):
    cm = metrics.confusion(labels(spark, [[2, 2]], [[2, 2]]))
    assert metrics.class_metrics(cm).where("class_id = 0").first().iou is None
    assert metrics.class_metrics(cm, undefined="zero").where("class_id = 0").first().iou == 0
    with pytest.raises(Exception, match="out of range"):
        metrics.confusion(labels(spark, [[2]], [[7]])).collect()


def test_harmonic_values(spark):
    assert spark.range(1).select(metrics.harmonic_iou(F.lit(0.2), F.lit(0.8))).first()[0] == pytest.approx(0.32 / (1 + 1e-8), abs=1e-15)
    rows = [("g", t, p, n) for t, line in enumerate([[8, 1, 1], [2, 16, 2], [1, 2, 67]]) for p, n in enumerate(line)]
    cm = spark.createDataFrame(rows, "tile_id string, true_id int, pred_id int, n bigint")
    assert metrics.pore_union(cm).first().pore_union_iou == pytest.approx(27 / 33)


def test_gate_diagnostic(spark):
    px = spark.createDataFrame([("t", 0, 0, 0, 0), ("t", 0, 1, 100, 1), ("t", 1, 0, 99, 2), ("t", 1, 1, 255, 2)], "tile_id string, y int, x int, v int, target int")
    g = metrics.gate_diagnostic(px).where("pooled = 1").first()
    assert (g.pore_in, g.pore_out, g.mineral_in, g.mineral_out, g.mismatched, g.mismatch_rate, g.c0_outside, g.c1_outside) == (1, 1, 1, 1, 2, 0.5, 0, 1)


def test_score_histogram(spark):
    rows = [(0, [0.9, 0.05, 0.05]), (0, [0.8, 0.1, 0.1]), (1, [0.1, 0.8, 0.1]), (2, [0.1, 0.1, 0.8])]
    h = metrics.score_histogram(spark.createDataFrame(rows, "target int, probs array<double>"), 16)
    s = {r.class_id: (r.p, r.q) for r in h.groupBy("class_id").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).collect()}
    assert s == {0: (2, 2), 1: (1, 3), 2: (1, 3)}
    from tileframe.operators.curves import curves

    c = curves(h, bins=16).where("class_id = 0").first()
    assert c.roc_auc == 1 and c.average_precision == 1


@pytest.mark.parametrize("length,patch,overlap,want", [(2048, 683, 0, [0, 683, 1365]), (2048, 1024, 0, [0, 1024]), (2048, 2048, 0, [0]), (24, 10, 4, [0, 6, 12, 14]), (10, 4, 1, [0, 3, 6])])
def test_axis_positions(spark, length, patch, overlap, want):
    assert spark.range(1).select(grid.axis_positions(F.lit(length), patch, overlap)).first()[0] == want


def test_axis_errors(spark):
    with pytest.raises(Exception, match="exceeds"):
        spark.range(1).select(grid.axis_positions(F.lit(2048), 2049)).collect()
    with pytest.raises(ValueError):
        grid.axis_positions(F.lit(10), 4, 4)


def test_polygon_edges_are_inside(spark):
    polys = spark.createDataFrame([("t", 1, 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]), ("t", 2, 1, [(0.0, 0.0), (1.0, 1.0)])], "tile_id string, order int, class_id int, points array<struct<x: double, y: double>>")
    tiles = spark.createDataFrame([("t", 3, 3)], "tile_id string, height int, width int")
    assert {(r.y, r.x) for r in contours.rasterise(polys, tiles).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_categories_and_masks(spark):
    names = ["Isolated Pore", " connected ", "matrix", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(fn.category_id(F.col("n"))).collect()] == [0, 1, 2, None]
    m = spark.createDataFrame([(0,), (1,), (255,), (7,)], "v int")
    assert [r[0] for r in m.select(fn.recode_mask(F.col("v"))).collect()] == [0, 1, 2, None]
    assert [r[0] for r in m.select(fn.recode_mask(F.col("v"), 2)).collect()] == [0, 1, -100, None]
    assert fn.mask_violations(m).count() == 1


def test_split_table(spark):
    masks = {"train": [[0, 1], [2, 2]], "val": [[0, 0], [1, 2]], "test": [[1, 1], [1, 2]]}
    px = None
    for k, m in masks.items():
        p = labels(spark, m, m).withColumn("tile_id", F.lit(k))
        px = p if px is None else px.unionByName(p)
    splits = spark.createDataFrame([(k, k) for k in masks], "tile_id string, split string")
    t = {r.split: (f"{r.pct0:.6f}", f"{r.pct1:.6f}", f"{r.pct2:.6f}") for r in metrics.split_table(px, splits).collect()}
    assert t == {"train": ("25.000000", "25.000000", "50.000000"), "val": ("50.000000", "25.000000", "25.000000"), "test": ("0.000000", "75.000000", "25.000000"), "Total": ("25.000000", "41.666667", "33.333333")}
    with pytest.raises(Exception, match="no pixel of class"):
        metrics.class_statistics(px, splits, "test").collect()


def test_manifest_checks(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"train": [1, "b.png", "3"], "val": [4, 5], "test": [5, 6], "_provenance": {"x": 1}}')
    m = read_manifest(spark, str(tmp_path / "m.json"))
    images = spark.createDataFrame([(1, "a.png"), (2, "b.png"), (3, "c.png"), (4, "d.png"), (5, "e.png"), (6, "f.png"), (7, "g.png")], "id bigint, file_name string")
    r = pairing.resolve_manifest(m, images)
    assert {(x.split, x.image_id) for x in r.collect()} == {("train", 1), ("train", 2), ("train", 3), ("val", 4), ("val", 5), ("test", 5), ("test", 6)}
    assert [(x.image_id, x.splits) for x in audit.check_leakage(r).collect()] == [(5, "test,val")]
    assert [(x.image_id, x.finding) for x in audit.check_complete(r, images).collect()] == [(7, "not assigned")]
    (tmp_path / "n.json").write_text('{"train": [true], "val": []}')
    with pytest.raises(Exception, match="lacks split|must not be"):
        read_manifest(spark, str(tmp_path / "n.json")).collect()


def test_safe_paths(spark):
    df = spark.createDataFrame([("../tile.png",), ("/tmp/tile.png",), ("nested\\tile.png",), ("",), ("nested/tile.png",), (None,)], "p string")
    assert [r[0] for r in df.select(fn.is_safe_path(F.col("p"))).collect()] == [False, False, False, False, True, False]


def test_synthetic_tiles(spark):
    s = synthetic_tiles(spark, 3, 9)
    counts = s.groupBy("tile_id").agg(*[F.count_if(F.col("mask") == v).alias(f"m{v}") for v in (0, 1, 255)], F.count_if(F.col("v") < 100).alias("g")).orderBy("tile_id").collect()
    assert [tuple(r)[1:] for r in counts] == [(9, 16, 56, 33), (9, 16, 56, 33), (9, 17, 55, 31)]


def test_running_best(spark):
    log = spark.createDataFrame([("r", 1, 0.5, 0.1, 1.0), ("r", 2, 0.5, 0.2, 1.0), ("r", 3, 0.5, 0.1, 1.0)], "run_id string, epoch int, score double, tie_breaker double, val_loss double")
    got = selection.running_best(log).orderBy("epoch").collect()
    assert [r.improved for r in got] == [True, True, False] and got[-1].best_epoch == 2
    assert selection.early_stop(log, 1).first().stop_epoch == 3


def screen(spark, failed):
    rows = [(f"c{i // 3}", 2023 + i % 3, "failure" if i == failed else "success", *[None if i == failed else v for v in (0.4 + 0.1 * (i // 3), 0.4, 0.4, 0.5, 1.0)]) for i in range(15)]
    return spark.createDataFrame(rows, "candidate string, seed int, outcome string, score double, c0_iou double, c1_iou double, pore_union_iou double, validation_loss double")


def test_candidates(spark):
    got = {r.candidate: r for r in selection.select_candidate(screen(spark, 14), "c0", 3).collect()}
    assert not got["c4"].eligible and got["c3"].winner and sum(r.winner for r in got.values()) == 1
    o = {r.candidate: r for r in selection.outcome_summary(screen(spark, 14)).collect()}
    assert o["c4"].failed_seeds == [2025] and sum(r.successes for r in o.values()) == 14
    with pytest.raises(Exception, match="reference"):
        selection.select_candidate(screen(spark, 0), "c0", 3).collect()


def test_mean_of_harmonics(spark):
    df = spark.createDataFrame([(c, *x) for c, x in zip("abcd", [(0.4, 0.6), (0.1, 0.9), (0.4, 0.6), (0.1, 0.9)], strict=True)], "s string, c0 double, c1 double")
    assert df.select(F.avg(metrics.harmonic_iou(F.col("c0"), F.col("c1")))).first()[0] == pytest.approx(0.3299999967, abs=1e-9)


def test_diagnostics(spark):
    t = [[2] * 8 for _ in range(8)]
    for y, x in ((1, 1), (1, 2), (2, 1), (2, 2), (5, 5)):
        t[y][x] = 0
    for y in (1, 2, 3):
        for x in (4, 5, 6):
            t[y][x] = 1
    px = labels(spark, t, t)
    s = compare.tile_statistics(px).first()
    assert (s.c0_true, s.c1_true, s.largest_true, s.components_true) == (5, 9, 9, 2)
    d = compare.tile_diagnostics(px).first()
    assert d.boundary_f1 == 1 and d.c0_area_error == 0 and d.per_megapixel_error == 0
    b = [bootstrap.bootstrap_diagnostics(compare.tile_statistics(px), 20, 19).orderBy("metric").collect() for _ in range(2)]
    assert b[0] == b[1]


def test_markers_and_growth(spark):
    cells = [[255] * 33 for _ in range(33)]
    for a in (2, 19):
        for y in range(a, a + 12):
            for x in range(a, a + 12):
                cells[y][x] = 0
    px = tile(spark, cells).withColumn("mask", F.col("v") < 100)
    seeds = distance.markers(px)
    assert seeds.count() == 2
    r = distance.seeded_regions(px, seeds)
    assert r.count() == 288 and r.select("region_id").distinct().count() == 2


def test_distances_have_no_bound(spark):
    off = {(0, 0), (3, 150)}
    cells = [[255 if (y, x) in off else 0 for x in range(200)] for y in range(9)] + [[0] * 60]
    px = tile(spark, cells).withColumn("mask", F.col("v") < 100)
    got = {(r.y, r.x): r.distance for r in distance.distance(px).collect()}
    assert len(got) == 9 * 200 + 60 and all(abs(d - min(math.hypot(y - a, x - b) for a, b in off)) < 1e-9 for (y, x), d in got.items())
    assert {r.distance for r in distance.distance(tile(spark, [[0, 0]]).withColumn("mask", F.lit(True))).collect()} == {None}
    far = labels(spark, [[1 if x < 3 else 2 for x in range(120)] for _ in range(3)], [[1 if x > 116 else 2 for x in range(120)] for _ in range(3)])
    assert distance.hausdorff(far, 1, 1.0).first().hausdorff == 117.0


def test_features_are_finite(spark):
    f = compare.features(tile(spark, [[(9 * y + 7 * x) % 256 for x in range(11)] for y in range(9)]))
    assert f.count() == 99 and compare.features_are_finite(f).count() == 0


def test_filters_reflect_again_on_short_lines(spark):
    for n in (1, 5):
        got = {r.x: r.v for r in filters.convolve(tile(spark, [[3 * x + 1 for x in range(n)]]), [k / 496 for k in range(1, 32)], [1.0]).collect()}
        for x in range(n):
            at = [(x + d) % (2 * n) for d in range(-15, 16)]
            assert abs(got[x] - sum((k + 1) / 496 * (3 * min(a, 2 * n - 1 - a) + 1) for k, a in enumerate(at))) < 1e-9


def test_filters(spark):
    px = tile(spark, [[40 if y == x == 2 else 10 for x in range(5)] for y in range(5)])
    assert {round(r.v, 9) for r in filters.box_mean(px, 3).where("y = 1 and x = 1").collect()} == {round(120 / 9, 9)}
    flat = tile(spark, [[7] * 9] * 9)
    assert {round(r.v, 9) for r in filters.gaussian(flat, 1.0).collect()} == {7.0}
    assert {round(r.sobel, 9) for r in filters.sobel(flat).collect()} == {0.0}
    m = px.withColumn("mask", F.col("v") > 20)
    assert filters.dilate(m, 3).where("mask").count() == 9 and filters.erode(filters.dilate(m, 3), 3).where("mask").count() == 1 and filters.close(m, 3).where("mask").count() == 1


def test_rings(spark):
    c = [[0] * 5 for _ in range(5)]
    for y, x in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3)):
        c[y][x] = 1
    px = tile(spark, c).withColumn("ring", F.col("v") == 1)
    assert [(r.y, r.x) for r in components.inside_rings(px).where("inside").collect()] == [(2, 2)]


def test_spiral_is_one_region(spark):
    n = 15
    c = [[255] * n for _ in range(n)]
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(n * n):
        c[y][x] = 0
        ny, nx, ay, ax = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if not (0 <= ny < n and 0 <= nx < n) or c[ny][nx] == 0 or (0 <= ay < n and 0 <= ax < n and c[ay][ax] == 0):
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < n and 0 <= nx < n) or c[ny][nx] == 0:
                break
        y, x = ny, nx
    px = tile(spark, c).withColumn("mask", F.col("v") == 0)
    assert components.components(px, connectivity=4).select("region_id").distinct().count() == 1


def test_samples_repeat(spark):
    df = spark.range(1000).select(F.lit(7).alias("tile_id"), F.lit(0).alias("target"), F.col("id").alias("y"), F.lit(0).alias("x"))
    a = {r.y for r in sampling.stratified_sample(df, 40, 1).collect()}
    b = {r.y for r in sampling.stratified_sample(df.repartition(5), 40, 1).collect()}
    c = {r.y for r in sampling.stratified_sample(df.withColumn("tile_id", F.lit(8)), 40, 1).collect()}
    assert len(a) == 40 and a == b and a != c
    assert {r.split for r in sampling.random_split(spark.range(5).select("id")).collect()} == {"train", "val", "test"}


def test_approvals(spark):
    schema = "schema_version string, template_only boolean, assets array<struct<paths: array<string>, approval_status: string, approval_date: string, contains_source_image_pixels: boolean, contains_annotation_or_mask_pixels: boolean, owner: string>>"
    docs = [("1", True, [(["a.png"], "approved", "2026-01-02", False, False, "x")]), ("1", False, [(["b.png"], "pending", "2026-01-02", False, False, "x"), (["../c.png"], "approved", "2026-01-02", False, False, "x"), (["d.png"], "approved", "2026-01-02", False, False, "x")])]
    paths = spark.createDataFrame([("a.png",), ("b.png",), ("d.png",), ("e.png",)], "path string")
    got = {(r.path, r.finding) for r in audit.audit_approvals(paths, spark.createDataFrame(docs, schema), ["owner"]).collect()}
    assert got == {("a.png", "template only"), ("b.png", "not approved"), ("../c.png", "unsafe path"), ("e.png", "no record")}


def test_digest_isolated(spark):
    rows = [("a", 1, "x"), ("b", 2, "y"), ("h", 3, "z")]
    one = metrics.corpus_digest(spark.createDataFrame(rows[:2], "name string, size bigint, sha256 string")).first()
    assert metrics.corpus_digest(spark.createDataFrame(rows[1::-1], "name string, size bigint, sha256 string")).first() == one
    assert metrics.corpus_digest(spark.createDataFrame([("a", 1, "q"), rows[1]], "name string, size bigint, sha256 string")).first().digest != one.digest


def test_leaks_and_json(spark):
    df = spark.createDataFrame([("p", "one\ntwo me@example.org\n/home/someone/x")], "path string, content string")
    assert {(r.pattern, r.line) for r in audit.scan_patterns(df).collect()} == {("email address", 2), ("Linux home path", 3)}
    j = spark.createDataFrame([("a", '{"k": 1, "k": 2}'), ("b", '{"x": NaN}'), ("c", "[1]"), ("d", "{"), ("e", '{"x": 1}')], "key string, doc string")
    assert {(r.key, r.finding) for r in audit_json(j, "doc", "key").collect()} == {("a", "duplicate key k"), ("b", "constant NaN"), ("c", "root is not an object"), ("d", "not JSON")}


def test_leak_scan_reports_each_pattern(spark, tmp_path):
    # Put together here, so that no scan of this file finds them.
    planted = {
        "private key": "-----BEGIN RSA PRIVATE" + " KEY-----", "GitHub token": "ghp" + "_" + "a1" * 12, "AWS access key": "AKIA" + "Q7" * 8, "Google API key": "AIza" + "b2" * 18,
        "Hugging Face token": "hf" + "_" + "c3" * 12, "OpenAI-style key": "sk" + "-" + "d4" * 12, "literal credential assignment": "password" + " = 'correct horse'", "Weights & Biases API key": "WANDB_API_KEY" + "=" + "e5" * 20,
        "email address": "me" + "@example.org", "macOS home path": "/Users" + "/someone/", "Linux home path": "/home" + "/someone/", "HPC scratch path": "/mnt" + "/scratch/",
    }
    assert set(planted) == set(audit.LEAK_PATTERNS)
    rows = [(k, f"one\ntwo {x} end") for k, x in enumerate(planted.values())] + [(50, "nothing here"), (51, None), (52, "\n".join(planted.values()))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["leak_scan"](spark, str(tmp_path)).collect()
    want = {(k, n, 2, x) for k, (n, x) in enumerate(planted.items())} | {(52, n, k + 1, x) for k, (n, x) in enumerate(planted.items())}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_sinks_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 0.1), (None, 1e-7), (float("nan"), 123456789.25), (100.0, 1e20)], "a double, b double")
    got = [tuple(r) for r in metric_csv(df, ["a", "b"]).collect()]
    assert got == [("1.5", "0.1"), ("", "1e-07"), ("", "123456789.25"), ("100", "1e+20")]
    assert '"a":null' in json_report(df).collect()[2][0]
    write_once(df, str(tmp_path / "o"))
    with pytest.raises(Exception):
        write_once(df, str(tmp_path / "o"))
    (tmp_path / "list.txt").write_text("# c\n\nsrc/*\n")
    assert [r[0] for r in read_allowlist(spark, str(tmp_path / "list.txt")).collect()] == ["src/*"]
    assert read_files(spark, str(tmp_path), "list.txt").first()["size"] == 11
    (tmp_path / "m.csv").write_text("name,value\na,1.5\n")
    assert read_contract_csv(spark, str(tmp_path / "m.csv"), "value double", exact=["name", "value"]).first().value == 1.5
    with pytest.raises(ValueError):
        read_contract_csv(spark, str(tmp_path / "m.csv"), "value double", exact=["value"])


def test_images_and_index(spark, tmp_path):
    import struct
    import zlib

    def png(rows, channels):
        raw = b"".join(b"\0" + bytes(r) for r in rows)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        head = struct.pack(">IIBBBBB", len(rows[0]) // channels, len(rows), 8, 0 if channels == 1 else 2, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "gray.png").write_bytes(png([[1, 200, 3], [4, 5, 6]], 1))
    (tmp_path / "img" / "rgb.png").write_bytes(png([[250, 240, 10, 1, 2, 3]], 3))
    (tmp_path / "img" / "bad.png").write_bytes(b"no image")
    got = read_tiles(spark, str(tmp_path / "img")).collect()
    assert {(r.y, r.x): r.v for r in got if r.tile_id == "gray"} == {(0, 0): 1, (0, 1): 200, (0, 2): 3, (1, 0): 4, (1, 1): 5, (1, 2): 6}
    assert [(r.r, r.g, r.b) for r in got if r.tile_id == "rgb" and r.x == 0] == [(250, 240, 10)]
    assert [(r.y, r.v) for r in got if r.tile_id == "bad"] == [(None, None)]
    rings = fn.ring_predicates(spark.createDataFrame([(250, 240, 10), (100, 100, 100)], "r int, g int, b int")).collect()
    assert rings[0].ring and rings[0].ring_rgb and not rings[1].ring
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a.png", "width": 3, "height": 2}], "annotations": [{"id": 1, "image_id": 1, "category_id": 30, "segmentation": [[0, 0, 1, 0, 1, 1]], "area": 1.0, "bbox": [0, 0, 1, 1], "iscrowd": 0}], "categories": [{"id": 30, "name": "disconnected pore"}]}')
    coco = read_coco(spark, str(tmp_path / "c.json"))
    fine, odd = pairing.map_annotations(coco["annotations"], coco["images"], coco["categories"])
    assert fine.first().class_id == 0 and odd.count() == 0


def test_symmetries_keep_pixels(spark):
    px = tile(spark, [[1, 2, 3], [4, 5, 6]])
    for k in range(8):
        got = augment.symmetry(px, F.lit(k)).collect()
        assert sorted(r.v for r in got) == [1, 2, 3, 4, 5, 6] and len({(r.y, r.x) for r in got}) == 6 and min(min(r.y, r.x) for r in got) == 0


def test_reconcile_and_grid(spark):
    a = spark.createDataFrame([(1, 5, 0.5), (2, None, None), (3, 1, 1.0)], "k int, n int, x double")
    b = spark.createDataFrame([(1, 5, 0.5 + 1e-13), (2, None, 0.1), (4, 1, 1.0)], "k int, n int, x double")
    assert {(r.k, r.column, r.finding) for r in pairing.reconcile(a, b, ["k"], ["n"], ["x"]).collect()} == {(2, "x", "differs"), (3, "*", "missing in b"), (4, "*", "missing in a")}
    g = spark.createDataFrame([("a", 1), ("a", 2), ("z", 9)], "candidate string, seed int")
    assert {(r.candidate, r.seed, r.finding) for r in pairing.check_grid(g, ["a", "b"], [1]).collect()} == {("a", 2, "extra"), ("b", 1, "missing"), ("z", 9, "extra")}
    files = spark.createDataFrame([("s1_001",), ("s1",), ("s2x",)], "stem string")
    series = spark.createDataFrame([("s1",), ("s2",)], "series string")
    assert {(r.stem, r.series, r.matches) for r in pairing.assign_series(files, series).collect()} == {("s1_001", "s1", 1), ("s1", "s1", 1), ("s2x", None, 0)}
