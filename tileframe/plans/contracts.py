"""Queries of recodes, pairing, curves over seeds, contracts and approvals, each on the given tables, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileframe.functions import category_id, check_grayscale, colourise, compose_labels, compose_probs, compose_target, content_id, is_sha256, mask_violations, normalise_category, parse_float, recode_mask, ring_counts, ring_predicates, run_group, run_name, softmax
from tileframe.operators import audit, bootstrap, curves, metrics, pairing, sampling, selection
from tileframe.operators.raster import augment, compare, components, filters
from tileframe.plans.more import flood
from tileframe.plans.queries import IOUS, PX, SC, SEEDED, query, rounded, seed_values, seeded_confusion
from tileframe.plans.tables import pixels, scored, table

# Recodes and checks of pixels


@query(f"WITH {PX}, m AS (SELECT tile_id, CASE WHEN v % 25 = 0 THEN 7 WHEN target = 2 THEN 255 ELSE target END AS m FROM px) SELECT tile_id, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 255 THEN 2 END AS three, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 255 THEN -100 END AS two, count(*) AS n, count(*) FILTER (m NOT IN (0, 1, 255)) AS violations FROM m GROUP BY ALL")
def recoded_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of 0, 1 and 255 with some other values among them, in both codings."""
    m = pixels(spark, sf_dir).select("tile_id", F.when(F.col("v") % 25 == 0, 7).when(F.col("target") == 2, 255).otherwise(F.col("target")).alias("v"))
    bad = mask_violations(m).groupBy("tile_id").agg(F.count("*").alias("violations"))
    out = m.groupBy("tile_id", recode_mask(F.col("v")).alias("three"), recode_mask(F.col("v"), 2).alias("two")).agg(F.count("*").alias("n"))
    return out.join(bad, "tile_id", "left").withColumn("violations", F.when(F.col("three").isNull(), F.col("violations")).otherwise(F.lit(0).cast("bigint")))


@query("""WITH n AS (SELECT p_partkey, ' ' || upper(CASE p_partkey % 6 WHEN 0 THEN 'Disconnected Pore' WHEN 1 THEN 'isolated-pore' WHEN 2 THEN 'connected' WHEN 3 THEN 'matrix' WHEN 4 THEN 'background' ELSE p_brand END) AS name FROM part),
c AS (SELECT p_partkey, replace(replace(lower(trim(name)), ' ', '_'), '-', '_') AS plain FROM n), d AS (SELECT p_partkey, CASE plain WHEN 'isolated_pore' THEN 'disconnected_pore' WHEN 'connected' THEN 'connected_pore' WHEN 'matrix' THEN 'mineral' WHEN 'background' THEN 'mineral' ELSE plain END AS category FROM c)
SELECT p_partkey, category, CASE category WHEN 'disconnected_pore' THEN 0 WHEN 'connected_pore' THEN 1 WHEN 'mineral' THEN 2 END AS class_id FROM d""")
def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, "Disconnected Pore").when(k == 1, "isolated-pore").when(k == 2, "connected").when(k == 3, "matrix").when(k == 4, "background").otherwise(F.col("p_brand"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.upper(raw)).alias("name"))
    return p.select("p_partkey", normalise_category(F.col("name")).alias("category"), category_id(F.col("name")).cast("int").alias("class_id"))


COLOURS = f"{PX}, rgb AS (SELECT tile_id, y, x, v, least(255, v * 2) AS r, least(255, v + y % 3 * 90) AS g, CASE WHEN target = 0 THEN v // 8 ELSE v END AS b FROM px)"


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rasters with made-up colours, some of them yellow."""
    px = pixels(spark, sf_dir)
    return px.select("tile_id", "y", "x", "v", F.least(F.lit(255), F.col("v") * 2).alias("r"), F.least(F.lit(255), F.col("v") + F.col("y") % 3 * 90).alias("g"), F.when(F.col("target") == 0, F.floor(F.col("v") / 8)).otherwise(F.col("v")).cast("int").alias("b"))


HUE = """h AS (SELECT *, greatest(r, g, b) AS mx, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS sp FROM rgb),
dg AS (SELECT *, CASE WHEN sp = 0 THEN 0 WHEN mx = r THEN 60 * (g - b) / sp WHEN mx = g THEN 120 + 60 * (b - r) / sp ELSE 240 + 60 * (r - g) / sp END AS dg FROM h),
hs AS (SELECT *, round(CASE WHEN dg < 0 THEN dg + 360 ELSE dg END / 2) % 180 AS hue, round(CASE WHEN mx = 0 THEN 0 ELSE 255 * sp / mx END) AS sat FROM dg),
li AS (SELECT *, list_transform([r, g, b], lambda c: CASE WHEN c / 255.0::DOUBLE <= 0.04045 THEN c / 255.0::DOUBLE / 12.92::DOUBLE ELSE ((c / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE END) AS l FROM hs),
xyz AS (SELECT *, list_transform([(0.412453::DOUBLE * l[1] + 0.357580::DOUBLE * l[2] + 0.180423::DOUBLE * l[3]) / 0.950456::DOUBLE, 0.212671::DOUBLE * l[1] + 0.715160::DOUBLE * l[2] + 0.072169::DOUBLE * l[3], (0.019334::DOUBLE * l[1] + 0.119193::DOUBLE * l[2] + 0.950227::DOUBLE * l[3]) / 1.088754::DOUBLE], lambda t: CASE WHEN t > 0.008856 THEN t ** (1 / 3.0::DOUBLE) ELSE 7.787::DOUBLE * t + 16 / 116.0::DOUBLE END) AS f FROM li),
wy AS (SELECT *, hue BETWEEN 10 AND 50 AND sat >= 50 AND mx >= 50 AS ring_hsv, round(500 * (f[1] - f[2]) + 128) > 128 AND round(200 * (f[2] - f[3]) + 128) > 150 AS ring_lab,
  coalesce(r / nullif(r + g + b, 0) > 0.33::DOUBLE AND g / nullif(r + g + b, 0) > 0.33::DOUBLE AND b / nullif(r + g + b, 0) < 0.25::DOUBLE AND r + g + b > 100, false) AS ring_ratio, r > 150 AND g > 150 AND b < 100 AND r + g > 350 AS ring_rgb, (r + g) / 2.0::DOUBLE - b > 80 AS ring_score, r > 200 AND g > 200 AND b < 50 AND hue BETWEEN 15 AND 35 AS ring_strict FROM xyz)"""


@query(f"""WITH {COLOURS}, {HUE} SELECT tile_id, count(*) FILTER (ring_hsv OR ring_lab OR ring_ratio OR ring_rgb OR ring_score OR ring_strict) AS n_ring, count(*) FILTER (ring_hsv) AS n_ring_hsv, count(*) FILTER (ring_lab) AS n_ring_lab, count(*) FILTER (ring_ratio) AS n_ring_ratio, count(*) FILTER (ring_rgb) AS n_ring_rgb,
  count(*) FILTER (ring_score) AS n_ring_score, count(*) FILTER (ring_strict) AS n_ring_strict FROM wy GROUP BY 1""")
def ring_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_counts(ring_predicates(coloured(spark, sf_dir)))


KINDS = ("hsv", "lab", "ratio", "rgb", "score", "strict")


@query(f"""WITH {COLOURS}, {HUE}, t AS (SELECT tile_id, count(*) FILTER ({' OR '.join(f'ring_{k}' for k in KINDS)}) AS n_ring, {', '.join(f'count(*) FILTER (ring_{k}) AS n_ring_{k}' for k in KINDS)} FROM wy GROUP BY 1)
SELECT name, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 9) AS mean, round(quantile_cont(n, 0.5), 9) AS median, min(n) AS least, max(n) AS most FROM (UNPIVOT (SELECT * EXCLUDE (tile_id) FROM t) ON COLUMNS(*) INTO NAME name VALUE n) GROUP BY 1""")
def ring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring pixels of the corpus, of each kind."""
    counts = ring_counts(ring_predicates(coloured(spark, sf_dir)))
    return rounded(metrics.describe_counts(counts, ["n_ring", *[f"n_ring_{k}" for k in KINDS]]))


@query()
def ring_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From colours to classes: ring pixels by any way, closed gaps, small rings dropped, insides, classes, and annotations of the regions."""
    px = ring_predicates(coloured(spark, sf_dir)).select("tile_id", "y", "x", "v", "ring")
    closed = filters.close(px, 2, "ring")
    kept = components.drop_small(components.components(closed.select("tile_id", "y", "x", "ring"), "ring"), 5).select("tile_id", "y", "x", F.lit(True).alias("_kept"))
    rings = closed.drop("ring").join(kept, ["tile_id", "y", "x"], "left").withColumn("ring", F.coalesce("_kept", F.lit(False))).drop("_kept")
    classed = components.classify_by_ring(components.inside_rings(rings))
    a = components.annotations(classed, 4, "pred")
    return a.select("tile_id", "annotation_id", "category_id", "area", F.to_json("bbox").alias("bbox"), F.size("runs").alias("n_runs"))


@query(f"WITH {COLOURS} SELECT tile_id, tile_id % 3 = 0 OR (tile_id % 3 = 1 AND bool_and(r = g AND g = b)) OR tile_id % 3 = 2 AS is_grayscale FROM rgb GROUP BY 1")
def grayscale_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the tiles with one channel, a third in colour, a third with equal channels."""
    c = coloured(spark, sf_dir)
    kind = F.col("tile_id") % 3
    px = c.select("tile_id", F.when(kind == 0, F.col("v")).alias("v"), *[F.when(kind == 1, F.col(x)).when(kind == 2, F.col("v")).alias(x) for x in "rgb"], F.when(kind > 0, 255).alias("a"))
    return check_grayscale(px)


@query(f"WITH {PX} SELECT tile_id, y, x, CASE WHEN v < 100 THEN pred ELSE 2 END AS label, CASE WHEN v % 35 = 0 THEN 2 ELSE target END AS truth, CASE WHEN v < 100 THEN 255 * CAST(pred = 0 AS INTEGER) ELSE 0 END AS r, CASE WHEN v < 100 THEN 255 * CAST(pred = 1 AS INTEGER) ELSE 0 END AS g, CASE WHEN v < 100 THEN 255 * CAST(pred = 2 AS INTEGER) ELSE 255 END AS b FROM px")
def composed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    truth = compose_target(F.when(F.col("v") % 35 == 0, F.lit(-100)).otherwise(F.col("target")))
    return colourise(px.select("tile_id", "y", "x", compose_labels(F.col("v") < 100, F.col("pred")).alias("label"), truth.alias("truth")), "label")


@query(f"WITH {SC}, s AS (SELECT pixel, list_transform(probs, lambda p: exp(p * 3)) AS e, probs FROM sc), t AS (SELECT pixel, list_transform(e, lambda x: x / list_sum(e)) AS q FROM s) SELECT pixel, round(CASE WHEN pixel % 3 = 0 THEN q[1] ELSE 0 END, 9) AS p0, round(CASE WHEN pixel % 3 = 0 THEN q[2] ELSE 0 END, 9) AS p1, round(CASE WHEN pixel % 3 = 0 THEN 0 ELSE 1 END, 9) AS p2 FROM t")
def composed_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of three logits, composed with a gate."""
    s = scored(spark, sf_dir).select("pixel", softmax(F.transform("probs", lambda p: p * 3)).alias("q"))
    c = s.withColumn("c", compose_probs(F.col("pixel") % 3 == 0, F.col("q")))
    return rounded(c.select("pixel", *[F.get("c", F.lit(k)).alias(f"p{k}") for k in range(3)]))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE round(value, 9) END AS number, CASE WHEN event_id % 4 = 0 THEN 'candidate' WHEN event_id % 4 = 1 THEN 'k' || user_id WHEN event_id % 4 = 2 THEN 'patch_training' ELSE 'other' END AS "group", CASE WHEN event_id % 2 = 0 THEN 'deep_net' ELSE 'base' END AS name FROM events WHERE value IS NOT NULL""")
def run_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    k = F.col("event_id") % 4
    folder = F.when(k == 0, "candidates").when(k == 1, F.concat(F.lit("ablation/k"), F.col("user_id").cast("string"))).when(k == 2, "patch_training").otherwise("misc")
    path = F.concat(F.lit("results/"), folder, F.lit("/"), F.when(F.col("event_id") % 2 == 0, "run_01_02_deep_net").otherwise("base"), F.lit("/training_summary.json"))
    text = F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 5 == 1, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return rounded(e.select("event_id", parse_float(text).alias("number"), run_group(path).alias("group"), run_name(path).alias("name")))


@query("""SELECT p_partkey, 'part-' || substr(sha256('{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}'), 1, 16) AS id, p_partkey % 2 = 0 AS is_digest FROM part""")
def content_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("p_partkey").cast("string"), 256)
    return table(spark, sf_dir, "part").select("p_partkey", content_id(["p_size", "p_partkey"], "part").alias("id"), is_sha256(F.when(F.col("p_partkey") % 2 == 0, digest).otherwise(F.upper(digest))).alias("is_digest"))


# Pairing


@query("""SELECT 't' || s_suppkey AS tile_id, CASE WHEN s_suppkey % 3 = 0 THEN 'tile' ELSE 'same' END AS side, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 5 <> 0 END AS same_shape FROM supplier UNION ALL SELECT 'x' || s_suppkey, 'mask', NULL FROM supplier WHERE s_suppkey % 7 = 0""")
def paired_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    tiles = s.select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("tile_id"), F.lit(24).alias("height"), F.lit(24).alias("width"))
    masks = s.where("k % 3 <> 0").select(F.concat(F.lit("t"), F.col("k").cast("string"), F.lit("_mask")).alias("tile_id"), F.when(F.col("k") % 5 == 0, 23).otherwise(24).alias("height"), F.lit(24).alias("width"))
    masks = masks.unionByName(s.where("k % 7 = 0").select(F.concat(F.lit("x"), F.col("k").cast("string"), F.lit("_mask")).alias("tile_id"), F.lit(24).alias("height"), F.lit(24).alias("width")))
    both, alone = pairing.pair_masks(tiles, masks)
    return both.select("tile_id", F.lit("same").alias("side"), "same_shape").unionByName(alone.select("tile_id", "side", F.lit(None).cast("boolean").alias("same_shape")))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.concat(F.lit("img_"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("file_name"))


@query("""SELECT s_suppkey AS id, s_suppkey % 4 <> 0 AS has_tile FROM supplier""")
def paired_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    have, lack = pairing.pair_index(images(spark, sf_dir), images(spark, sf_dir).where("id % 4 <> 0").select(F.concat(F.lit("img_"), F.col("id").cast("string")).alias("tile_id")))
    return have.select("id", F.lit(True).alias("has_tile")).unionByName(lack.select("id", F.lit(False).alias("has_tile")))


@query("""WITH m AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'img_' || s_suppkey || '.png' WHEN 1 THEN CAST(s_suppkey AS VARCHAR) WHEN 2 THEN CAST(s_suppkey AS VARCHAR) ELSE 'unknown_' || s_suppkey END AS ident FROM supplier)
SELECT CASE WHEN k % 2 = 0 THEN 'train' ELSE 'test' END AS split, ident, CASE WHEN k % 4 < 3 THEN CAST(k AS BIGINT) END AS image_id FROM m""")
def resolved_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idents that are file names, numbers, digit strings or unknown."""
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    ident = F.when(k % 4 == 0, F.concat(F.lit("img_"), text, F.lit(".png"))).when(k % 4 < 3, text).otherwise(F.concat(F.lit("unknown_"), text))
    m = table(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, "train").otherwise("test").alias("split"), ident.alias("ident"), (k % 4 != 1).alias("is_text"))
    return pairing.resolve_manifest(m, images(spark, sf_dir))


@query("""SELECT p_partkey AS id, p_partkey % 5 < 3 AND p_partkey % 2000 IN (SELECT s_suppkey FROM supplier) AS known, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 5 END AS class_id FROM part""")
def mapped_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of which some have an unknown category or image."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2000).alias("image_id"), (F.col("p_partkey") % 5).alias("category_id"))
    c = spark.createDataFrame([(0, "isolated pore"), (1, "Connected-Pore"), (2, "matrix"), (3, "crack")], "id bigint, name string")
    fine, odd = pairing.map_annotations(a, images(spark, sf_dir), c)
    return fine.select("id", F.lit(True).alias("known"), F.col("class_id").cast("bigint").alias("class_id")).unionByName(odd.select("id", F.lit(False).alias("known"), F.col("class_id").cast("bigint").alias("class_id")))


@query("""WITH f AS (SELECT DISTINCT n_name || '_' || c_mktsegment || '_' || (c_custkey % 3) AS stem FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT n_name AS s FROM nation WHERE n_nationkey % 4 <> 0 UNION SELECT n_name || '_BUILDING' FROM nation WHERE n_nationkey % 5 = 0),
h AS (SELECT stem, min(s) AS series, count(s) AS matches FROM f LEFT JOIN s ON stem = s OR starts_with(stem, s || '_') GROUP BY 1) SELECT stem, CASE WHEN matches = 1 THEN series END AS series, matches FROM h""")
def series_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    files = c.select(F.concat_ws("_", "n_name", "c_mktsegment", (F.col("c_custkey") % 3).cast("string")).alias("stem"))
    series = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("series")).unionByName(n.where("n_nationkey % 5 = 0").select(F.concat("n_name", F.lit("_BUILDING")).alias("series")))
    return pairing.assign_series(files, series)


def darkened(tile):
    """A caller's augmentor: mirrored along x within each line, at half the value."""
    last = tile.groupby("y")["x"].transform("max")
    return tile.assign(x=(last - tile["x"]).astype("int32"), v=(tile["v"] // 2).astype("int32"))


@query(f"WITH {PX} SELECT tile_id, y, CAST(max(x) OVER (PARTITION BY tile_id, y) - x AS INTEGER) AS x, CAST(v // 2 AS INTEGER) AS v, target FROM px")
def augmented_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.augment_tiles(pixels(spark, sf_dir).select("tile_id", "y", "x", "v", "target"), darkened)


# Metrics, curves and selection


@query(f"""WITH {SEEDED}, p AS (SELECT method_id, true_id, pred_id, sum(n) AS n FROM scm GROUP BY ALL), u AS (SELECT method_id, CAST(sum(n) FILTER (true_id = 2 AND pred_id = 2) AS DOUBLE) AS tp, CAST(sum(n) FILTER (true_id < 2 AND pred_id = 2) AS DOUBLE) AS fp, CAST(sum(n) FILTER (true_id = 2 AND pred_id < 2) AS DOUBLE) AS fn, CAST(sum(n) FILTER (true_id < 2 AND pred_id < 2) AS DOUBLE) AS tn FROM p GROUP BY 1)
SELECT method_id, round(tp / (tp + fp + fn), 9) AS c2_iou, round(2 * tp / (2 * tp + fp + fn), 9) AS c2_dice, round(tp / (tp + fp), 9) AS c2_precision, round(tp / (tp + fn), 9) AS c2_recall, round(tn / (tn + fp + fn), 9) AS pore_union_iou, round((tp + tn) / (tp + fp + fn + tn), 9) AS agreement, CASE method_id WHEN 'C' THEN 'rule' ELSE 'model' END AS prediction_source FROM u""")
def full_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.full_area_metrics(seeded_confusion(spark, sf_dir), sources={"C": "rule"}))


@query(f"""WITH {SC}, t AS (SELECT count(*) AS t FROM sc) SELECT 1 AS class_id, 'positives differ from support' AS finding FROM t WHERE t > 0 UNION ALL SELECT 2, 'negatives differ from the rest' FROM t WHERE t > 0 UNION ALL SELECT 0, 'repeated bin' FROM t WHERE t > 0 UNION ALL SELECT 1, 'missing bin' FROM t WHERE t > 0 UNION ALL SELECT 2, 'edges off the grid' FROM t WHERE t > 0""")
def histogram_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole histogram with bin 0 twice in class 0, a positive too many and no bin 4095 in class 1, a negative too many and one wrong edge in class 2."""
    s = scored(spark, sf_dir)
    h = metrics.complete_histogram(metrics.score_histogram(s))
    first = F.col("bin_id") == 0
    h = h.withColumns({"pos": F.col("pos") + (first & (F.col("class_id") == 1)).cast("int"), "neg": F.col("neg") + (first & (F.col("class_id") == 2)).cast("int"), "score_upper": F.col("score_upper") + (first & (F.col("class_id") == 2)).cast("double")})
    last = h.where("class_id = 1 and bin_id = 4095").select(F.lit(1).alias("class_id"), F.lit(4094).alias("bin_id"), F.col("pos").alias("_p"), F.col("neg").alias("_n"))
    h = h.where("not (class_id = 1 and bin_id = 4095)").join(last, ["class_id", "bin_id"], "left").withColumns({"pos": F.col("pos") + F.coalesce("_p", F.lit(0)), "neg": F.col("neg") + F.coalesce("_n", F.lit(0))}).drop("_p", "_n")
    again = h.where("class_id = 0 and bin_id = 0").withColumns({"pos": F.lit(0).cast("bigint"), "neg": F.lit(0).cast("bigint")})
    return metrics.check_histogram(h.unionByName(again), metrics.confusion(s.withColumn("pred", F.col("target")), []))


@query(f"""WITH {SC}, b AS (SELECT tile_id, round(probs[1], 2) AS s, CAST(target = 0 AS INTEGER) AS l FROM sc), g AS (SELECT tile_id, s, sum(l) AS pos, sum(1 - l) AS neg FROM b GROUP BY 1, 2), n AS (SELECT tile_id, sum(pos) AS p, sum(neg) AS q FROM g GROUP BY 1 HAVING sum(pos) > 0 AND sum(neg) > 0),
c AS (SELECT tile_id, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY tile_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT tile_id, NULL, 0, 0 FROM n)
SELECT tile_id, round(s, 9) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / p, 9) AS tpr, round(fp / q, 9) AS fpr FROM c JOIN n USING (tile_id)""")
def exact_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("tile_id", F.round(F.get("probs", F.lit(0)), 2).alias("score"), (F.col("target") == 0).cast("int").alias("label"))
    return rounded(curves.roc_points(s, ["tile_id"]))


@query("SELECT c_name AS run_name, c_acctbal FROM (SELECT c_name, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS c_acctbal FROM customer) WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, c_name LIMIT 15")
def best_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, of which a quarter has no metric."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("run_name"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return selection.best_runs(c, "c_acctbal")


@query(f"""WITH {SC}, m AS (SELECT target, probs, CASE WHEN pixel % 2 = 0 THEN 'A' ELSE 'B' END AS method_id FROM sc), o AS (SELECT method_id, target, unnest(probs) AS p, unnest([0, 1, 2]) AS class_id FROM m), h AS (SELECT method_id, class_id, CAST(least(floor(p * 64), 63) AS INTEGER) AS bin_id, count(*) FILTER (target = class_id) AS pos, count(*) FILTER (target <> class_id) AS neg FROM o GROUP BY 1, 2, 3)
SELECT method_id, class_id, bin_id, round(bin_id / 64.0::DOUBLE, 9) AS threshold, CAST(sum(pos) OVER d AS BIGINT) AS tp, CAST(sum(neg) OVER d AS BIGINT) AS fp, round(sum(pos) OVER d / sum(pos) OVER e, 9) AS tpr, round(sum(neg) OVER d / sum(neg) OVER e, 9) AS fpr, round(sum(pos) OVER d / (sum(pos) OVER d + sum(neg) OVER d), 9) AS "precision", round(sum(pos) OVER d / sum(pos) OVER e, 9) AS recall
FROM h WINDOW d AS (PARTITION BY method_id, class_id ORDER BY bin_id DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY method_id, class_id)""")
def pooled_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of the curves of two methods, each pooled over five seeds."""
    s = scored(spark, sf_dir).withColumns({"method_id": F.when(F.col("pixel") % 2 == 0, "A").otherwise("B"), "seed": F.floor(F.col("pixel") / 2) % 5})
    return rounded(curves.pooled_curves(metrics.score_histogram(s, 64, ["method_id", "seed"]), bins=64))


@query(f"""WITH {SEEDED}, {IOUS}, s AS (SELECT method_id, 'iou' || class_id AS metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM i GROUP BY ALL), m AS (SELECT a.method_id, 'iou' || a.class_id AS metric, avg(a.value - r.value) AS margin FROM i a JOIN i r ON r.method_id = 'A' AND r.seed = a.seed AND r.class_id = a.class_id WHERE a.method_id <> 'A' GROUP BY ALL)
SELECT method_id, metric, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(margin, 9) AS margin FROM s LEFT JOIN m USING (method_id, metric)""")
def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.screen_summary(seed_values(spark, sf_dir), "A"))


CANDIDATES = """o AS (SELECT o_orderpriority AS candidate, CAST(o_orderkey % 3 AS INTEGER) AS seed, avg(o_totalprice) AS score, avg(o_totalprice % 1000) AS c0_iou, avg(o_totalprice % 700) AS c1_iou, avg(o_totalprice % 300) AS pore_union_iou, avg(o_custkey) AS validation_loss FROM orders GROUP BY ALL),
f AS (SELECT *, candidate = '5-LOW' AND seed = 2 AS failed FROM o), m AS (SELECT candidate, count(*) FILTER (NOT failed) AS n, avg(score) FILTER (NOT failed) AS score, avg(c0_iou) FILTER (NOT failed) AS c0_iou, avg(c1_iou) FILTER (NOT failed) AS c1_iou, avg(pore_union_iou) FILTER (NOT failed) AS pore_union_iou, avg(validation_loss) FILTER (NOT failed) AS validation_loss FROM f GROUP BY 1)"""


@query(f"""WITH {CANDIDATES}, r AS (SELECT * FROM m WHERE candidate = '3-MEDIUM'), j AS (SELECT m.*, CASE WHEN m.candidate = '3-MEDIUM' THEN 'reference' WHEN m.n < 3 THEN 'missing seed' WHEN NOT m.score > r.score THEN 'score not above reference' WHEN m.c0_iou < r.c0_iou THEN 'c0 below reference' WHEN m.c1_iou < r.c1_iou THEN 'c1 below reference' END AS reason FROM m, r),
b AS (SELECT candidate AS best FROM j WHERE reason IS NULL ORDER BY score DESC, pore_union_iou DESC, validation_loss LIMIT 1)
SELECT candidate, n, round(score, 6) AS score, round(c0_iou, 6) AS c0_iou, round(c1_iou, 6) AS c1_iou, round(pore_union_iou, 6) AS pore_union_iou, round(validation_loss, 6) AS validation_loss, reason IS NULL AS eligible, reason, coalesce(candidate = best, false) AS winner FROM j LEFT JOIN b ON true""")
def chosen_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as candidates with three seeds, one of which fails."""
    price = F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("candidate"), (F.col("o_orderkey") % 3).cast("int").alias("seed")).agg(F.avg(price).alias("score"), F.avg(price % 1000).alias("c0_iou"), F.avg(price % 700).alias("c1_iou"), F.avg(price % 300).alias("pore_union_iou"), F.avg("o_custkey").alias("validation_loss"))
    o = o.withColumn("outcome", F.when((F.col("candidate") == "5-LOW") & (F.col("seed") == 2), "failure").otherwise("success"))
    return rounded(selection.select_candidate(o, "3-MEDIUM", 3), 6)


@query(f"""WITH {PX}, r AS (SELECT *, row_number() OVER (PARTITION BY tile_id, target ORDER BY md5('9:' || tile_id || ':' || target || ':' || y || ':' || x), y, x) AS k, count(*) OVER (PARTITION BY tile_id, target) AS n FROM px WHERE v < 100) SELECT tile_id, y, x, target, round(n / least(n, 6), 9) AS weight FROM r WHERE k <= 6""")
def evaluation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.assemble_samples(pixels(spark, sf_dir), 6, 9, evaluation=True).select("tile_id", "y", "x", "target", "weight"))


@query(f"""WITH RECURSIVE {PX}, {flood('t0', 'target = 0')}, {flood('p0', 'pred = 0')}, {flood('t1', 'target = 1')}, {flood('p1', 'pred = 1')},
b1 AS (SELECT a.tile_id, a.y, a.x, a.target < 2 AND count(*) FILTER (b.target < 2) < 9 AS bt, a.pred < 2 AND count(*) FILTER (b.pred < 2) < 9 AS bp FROM px a JOIN px b ON a.tile_id = b.tile_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.tile_id, a.y, a.x, a.target, a.pred),
b2 AS (SELECT a.tile_id, a.y, a.x, a.bt, a.bp, bool_or(b.bt) AS nt, bool_or(b.bp) AS np FROM b1 a JOIN b1 b ON a.tile_id = b.tile_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (target = 0) AS a0, count(*) FILTER (pred = 0) AS b0, count(*) FILTER (target = 1) AS a1, count(*) FILTER (pred = 1) AS b1 FROM px),
c AS (SELECT s.*, (SELECT count(*) FROM (SELECT DISTINCT tile_id, region_id FROM t0)) AS ct, (SELECT count(*) FROM (SELECT DISTINCT tile_id, region_id FROM p0)) AS cp,
  (SELECT sum(m) FROM (SELECT max(a) AS m FROM (SELECT tile_id, count(*) AS a FROM t1 GROUP BY tile_id, region_id) GROUP BY tile_id)) AS lt, (SELECT sum(m) FROM (SELECT max(a) AS m FROM (SELECT tile_id, count(*) AS a FROM p1 GROUP BY tile_id, region_id) GROUP BY tile_id)) AS lp FROM s),
f AS (SELECT count(*) FILTER (bp AND nt) / CAST(count(*) FILTER (bp) AS DOUBLE) AS pr, count(*) FILTER (bt AND np) / CAST(count(*) FILTER (bt) AS DOUBLE) AS re FROM b2),
d AS (SELECT (b0 - a0) / n AS e0, (b1 - a1) / n AS e1, lp / CAST(b1 AS DOUBLE) - lt / CAST(a1 AS DOUBLE) AS el, (cp - ct) * 1e6 / n AS em FROM c)
SELECT round(e0, 9) AS c0_area_error, round(abs(e0), 9) AS c0_area_abs_error, round(e1, 9) AS c1_area_error, round(abs(e1), 9) AS c1_area_abs_error, round(el, 9) AS largest_share_error, round(abs(el), 9) AS largest_share_abs_error, round(em, 9) AS per_megapixel_error, round(abs(em), 9) AS per_megapixel_abs_error, round(pr, 9) AS boundary_precision, round(re, 9) AS boundary_recall, round(2 * pr * re / (pr + re), 9) AS boundary_f1 FROM d, f""")
def pooled_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.pool_diagnostics(compare.tile_statistics(pixels(spark, sf_dir))))


@query()
def diagnostics_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.bootstrap_diagnostics(compare.tile_statistics(pixels(spark, sf_dir))))


# Contracts


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS k FROM part), f AS (SELECT path, 'no record' AS finding FROM p WHERE k % 10 = 0 UNION ALL SELECT path, 'not approved' FROM p WHERE k % 10 = 1 UNION ALL SELECT path, 'bad date' FROM p WHERE k % 10 = 2 UNION ALL SELECT path, 'flag missing' FROM p WHERE k % 10 = 3 UNION ALL SELECT path, 'several records' FROM p WHERE k % 10 = 4 UNION ALL SELECT path, 'rights is empty' FROM p WHERE k % 10 = 5) SELECT * FROM f""")
def approval_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as assets: a tenth each without a record, not approved, with a bad date, no flag, two records, or an empty text."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", k.cast("string").alias("path"))
    asset = F.struct(
        F.array("path").alias("paths"), F.when(k % 10 == 1, "pending").otherwise("approved").alias("approval_status"), F.when(k % 10 == 2, "soon").otherwise("2026-08-20").alias("approval_date"),
        F.when(k % 10 != 3, F.lit(False)).alias("contains_source_image_pixels"), F.lit(False).alias("contains_annotation_or_mask_pixels"), F.when(k % 10 == 5, " ").otherwise("own").alias("rights"),
    )
    docs = p.where(k % 10 != 0).select(F.lit(1).alias("schema_version"), F.lit(False).alias("template_only"), F.when(k % 10 == 4, F.array(asset, asset)).otherwise(F.array(asset)).alias("assets"))
    return audit.audit_approvals(p.select("path"), docs, ["rights"])


SCOPE_DIGEST = "SELECT split_part(url, '/', 3) AS scope, count(*) AS files, sha256(string_agg(page_id || chr(0) || octet_length(encode(html)) || chr(0) || sha256(html), chr(10) ORDER BY page_id || chr(0) || octet_length(encode(html)) || chr(0) || sha256(html))) AS digest FROM pages GROUP BY 1"


@query(f"WITH s AS ({SCOPE_DIGEST}), e AS (SELECT scope, files, CASE WHEN files % 2 = 0 THEN digest ELSE '' END AS d FROM s) SELECT s.scope, s.files, e.files AS expected_files, s.digest, e.d AS expected_digest, s.digest = e.d AS attested FROM s JOIN e USING (scope)")
def attested_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as scopes, of which those with an odd number of pages expect another digest."""
    p = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("scope"), F.col("page_id").cast("string").alias("name"), F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha256"))
    seen = metrics.corpus_digest(p, ["scope"])
    expected = seen.select("scope", "files", F.when(F.col("files") % 2 == 0, F.col("digest")).otherwise("").alias("digest"))
    return audit.attest(p.drop("scope"), p.select("name", "scope"), expected)


@query(f"""WITH {PX}, n AS (SELECT tile_id AS tile, count(*) AS n, count(*) FILTER (target = 0 AND pred = 0) / nullif(CAST(count(*) FILTER (target = 0 OR pred = 0) AS DOUBLE), 0) AS i0 FROM px GROUP BY 1)
SELECT tile, 'repeated tile' AS finding FROM n WHERE tile % 6 = 0 UNION ALL SELECT tile, 'matrix does not cover the tile' FROM n WHERE tile % 5 = 0 UNION ALL SELECT tile, 'iou of class 0' FROM n WHERE tile % 4 = 0
UNION ALL SELECT NULL, 'aggregate differs in 1 cells' UNION ALL SELECT NULL, 'tile numbers don''t run from 1'""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with repeated tiles, areas that the matrix doesn't cover, IoUs that aren't the matrix's, and an aggregate that isn't the sum; most tiles are clean."""
    cm = metrics.confusion(pixels(spark, sf_dir)).withColumnRenamed("tile_id", "tile")
    tiles = cm.groupBy("tile").agg(F.sum("n").alias("height")).withColumn("height", F.col("height") + (F.col("tile") % 5 == 0).cast("int")).withColumn("width", F.lit(1))
    tiles = tiles.unionByName(tiles.where("tile % 6 = 0"))
    wrong = (F.col("tile") % 4 == 0) & (F.col("class_id") == 0)
    reported = metrics.class_metrics(cm, ["tile"]).select("tile", "class_id", F.when(wrong, F.coalesce("iou", F.lit(0.0)) + 0.25).otherwise(F.col("iou")).alias("iou"))
    tiles = tiles.withColumn("ordinal", F.col("tile") + 2)
    aggregate = cm.groupBy("true_id", "pred_id").agg((F.sum("n") + F.when((F.col("true_id") == 2) & (F.col("pred_id") == 0), 1).otherwise(0)).alias("n"))
    return audit.check_report(tiles, cm, reported, aggregate)


@query("""WITH r AS (SELECT DISTINCT c_mktsegment AS m, c_nationkey % 3 AS seed FROM customer) SELECT 'FURNITURE' AS method_id, 'several display names' AS finding UNION ALL SELECT 'MACHINERY', 'wrong number of records' UNION ALL SELECT 'MACHINERY', 'repeated seed' UNION ALL SELECT '*', 'not exactly one selected method' FROM (SELECT count(*) AS n FROM r) WHERE n > 0""")
def collection_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as methods of three seeds: one is listed twice for a seed, one has two names, and two are selected."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("method_id"), (F.col("c_nationkey") % 3).cast("int").alias("seed")).distinct()
    c = c.withColumns({"kind": F.lit("trained"), "display_name": F.when((F.col("method_id") == "FURNITURE") & (F.col("seed") == 0), "Other").otherwise(F.col("method_id")), "selected": F.col("method_id").isin("BUILDING", "AUTOMOBILE")})
    return audit.check_collection(c.unionByName(c.where("method_id = 'MACHINERY' and seed = 1")), {"trained": 3})


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")


@query(f"""WITH h AS (SELECT c_mktsegment AS candidate, CAST(c_nationkey % 7 AS INTEGER) AS seed, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2),
g AS (SELECT unnest({list(SEGMENTS)}) AS candidate, s AS seed FROM range(5) t(s))
SELECT coalesce(h.candidate, g.candidate) AS candidate, CAST(coalesce(h.seed, g.seed) AS INTEGER) AS seed, CASE WHEN n IS NULL THEN 'missing' WHEN g.candidate IS NULL THEN 'extra' ELSE 'repeated' END AS finding FROM h FULL JOIN g ON h.candidate = g.candidate AND h.seed = g.seed WHERE n IS NULL OR g.candidate IS NULL OR n > 1""")
def grid_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and nations as the cells of a plan of four by five."""
    cells = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_mktsegment").alias("candidate"), (F.col("c_nationkey") % 7).cast("int").alias("seed"))
    return pairing.check_grid(cells, SEGMENTS, range(5))


@query("SELECT p_brand, name, tile_id FROM (SELECT p_brand, p_name AS name, p_partkey AS tile_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r FROM part) WHERE r = 1")
def first_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_tile(table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), F.col("p_partkey").alias("tile_id")), ["p_brand"])


def dark_share(patches: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a caller's model: the share of dark pixels of each patch, and a class by it."""
    share = patches["v"].map(lambda v: float((np.asarray(v) < 100).mean()))
    return pd.DataFrame({"tile_id": patches["tile_id"], "patch_id": patches["patch_id"], "score": share, "pred": (share >= 0.4).astype("int32")})


@query(f"""WITH {PX}, p AS (SELECT tile_id, tile_id || '_' || y // 8 || '_' || x // 8 AS patch_id, avg(CAST(v < 100 AS INTEGER)) AS score, count(*) AS n FROM px GROUP BY tile_id, y // 8, x // 8)
SELECT tile_id, patch_id, round(score, 9) AS score, CAST(score >= 0.4 AS INTEGER) AS pred FROM p WHERE n = 64""")
def scored_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function on patches of 8 x 8 pixels, as arrays."""
    px = pixels(spark, sf_dir)
    name = F.concat_ws("_", F.col("tile_id").cast("string"), F.floor(F.col("y") / 8).cast("string"), F.floor(F.col("x") / 8).cast("string"))
    patches = px.groupBy("tile_id", name.alias("patch_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda q: q["v"]).alias("v")).where(F.size("v") == 64)
    return rounded(sampling.score_patches(patches, dark_share, "tile_id bigint, patch_id string, score double, pred int"))
