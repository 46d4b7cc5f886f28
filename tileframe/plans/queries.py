"""Each registered query applies operators to the given tables; ORACLES has the same in DuckDB SQL, ratios rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileframe.functions import argmax_class, canonical_json, check_probs, error_category, gate, normalise, pct, quantise, worst_class
from tileframe.operators import audit, bootstrap, curves, losses, metrics, pairing, sampling, selection
from tileframe.operators.raster import augment, compare, components, contours, distance, filters, grid
from tileframe.plans.tables import epoch_log, pixels, scored, splits, table
from tileframe.sources import audit_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PX = """px AS (SELECT CAST(l_suppkey AS BIGINT) AS tile_id, CAST(p // 24 AS INTEGER) AS y, CAST(p % 24 AS INTEGER) AS x, v, target, CASE WHEN v >= 100 THEN 2 WHEN ls = 'O' THEN 1 ELSE 0 END AS pred FROM (
  SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS p, CAST(l_quantity * 5 AS INTEGER) AS v,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS target, l_linestatus AS ls FROM lineitem))"""
SPLITS = "splits AS (SELECT CAST(s_suppkey AS BIGINT) AS tile_id, s_nationkey AS series, CASE WHEN s_nationkey % 10 = 0 THEN 'val' WHEN s_nationkey % 5 = 1 THEN 'test' ELSE 'train' END AS split FROM supplier)"
CLS = "cls AS (SELECT unnest([0, 1, 2]) AS class_id)"
CM = "cm AS (SELECT tile_id, t AS true_id, q AS pred_id, count(*) FILTER (target = t AND pred = q) AS n FROM px, (SELECT unnest([0,1,2]) AS t), (SELECT unnest([0,1,2]) AS q) GROUP BY ALL)"
SC = """sc AS (SELECT vec_id AS pixel, vec_id % 20 AS tile_id, label % 3 AS target, [e0 / (e0 + e1 + e2), e1 / (e0 + e1 + e2), e2 / (e0 + e1 + e2)] AS probs FROM (
  SELECT *, exp(CAST(embedding[1] AS DOUBLE) * 8) AS e0, exp(CAST(embedding[2] AS DOUBLE) * 8) AS e1, exp(CAST(embedding[3] AS DOUBLE) * 8) AS e2 FROM embeddings))"""
LOG = """lg AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, round(value, 0) AS score, round(value % 7, 1) AS tie_breaker, CAST(event_id % 11 AS DOUBLE) AS val_loss
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"""


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[(F.round(c, places) if kind in ("double", "float") else F.col(c)).alias(c) for c, kind in df.dtypes])


def integers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# Counting and metrics


@query(f"WITH {PX} SELECT tile_id, count(*) AS n, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1, count(*) FILTER (target = 2) AS n2, round(100.0::DOUBLE * count(*) FILTER (target = 0) / count(*), 9) AS pct0, round(100.0::DOUBLE * count(*) FILTER (target = 1) / count(*), 9) AS pct1, round(100.0::DOUBLE * count(*) FILTER (target = 2) / count(*), 9) AS pct2 FROM px WHERE v < 100 GROUP BY 1")
def gate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_histogram(pixels(spark, sf_dir).where(gate(F.col("v")))))


@query(f"WITH {PX}, per AS (SELECT tile_id, target AS class_id, count(*) AS n FROM px GROUP BY 1, 2) SELECT class_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS tiles, round(avg(n), 9) AS mean, round(quantile_cont(n, 0.5), 9) AS median, min(n) AS least, max(n) AS most, round(100.0::DOUBLE * sum(n) / sum(sum(n)) OVER (), 9) AS pct FROM per GROUP BY 1")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.corpus_summary(pixels(spark, sf_dir)))


@query(f"WITH {PX}, {SPLITS} SELECT CASE WHEN grouping(split) = 1 THEN 'Total' ELSE split END AS split, count(DISTINCT tile_id) AS tiles, count(*) AS pixels, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1, count(*) FILTER (target = 2) AS n2, round(100.0::DOUBLE * count(*) FILTER (target = 0) / count(*), 6) AS pct0, round(100.0::DOUBLE * count(*) FILTER (target = 1) / count(*), 6) AS pct1, round(100.0::DOUBLE * count(*) FILTER (target = 2) / count(*), 6) AS pct2 FROM px JOIN splits USING (tile_id) GROUP BY ROLLUP (split)")
def split_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.split_table(pixels(spark, sf_dir), splits(spark, sf_dir))
    return t.withColumns({f"pct{c}": F.col(f"pct{c}").cast("double") for c in range(3)})


@query(f"WITH {PX}, {SPLITS}, c AS (SELECT target AS class_id, count(*) AS n FROM px SEMI JOIN (SELECT tile_id FROM splits WHERE split = 'train') s USING (tile_id) WHERE target < 2 GROUP BY 1), w AS (SELECT class_id, n, 1 / sqrt(n / CAST(sum(n) OVER () AS DOUBLE)) AS i FROM c) SELECT class_id, n, round(i / sum(i) OVER (), 9) AS weight FROM w")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_weights(metrics.class_statistics(pixels(spark, sf_dir), splits(spark, sf_dir))))


METRICS_SQL = f"""{PX}, {CM}, m AS (SELECT tile_id, class_id, CAST(sum(n) FILTER (true_id = class_id AND pred_id = class_id) AS BIGINT) AS tp, CAST(sum(n) FILTER (true_id <> class_id AND pred_id = class_id) AS BIGINT) AS fp,
  CAST(sum(n) FILTER (true_id = class_id AND pred_id <> class_id) AS BIGINT) AS fn, CAST(sum(n) FILTER (true_id <> class_id AND pred_id <> class_id) AS BIGINT) AS tn FROM cm, (SELECT unnest([0,1,2]) AS class_id) GROUP BY 1, 2),
k AS (SELECT *, tp + fn AS support, tp / nullif(tp + fp + fn, 0) AS iou, 2 * tp / nullif(2 * tp + fp + fn, 0) AS dice, tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM m)"""


@query(f"WITH {PX}, {CM} SELECT * FROM cm")
def confusion_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(pixels(spark, sf_dir))


@query(f'WITH {METRICS_SQL} SELECT tile_id, class_id, tp, fp, fn, tn, support, round(iou, 9) AS iou, round(dice, 9) AS dice, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(specificity, 9) AS specificity, round(accuracy, 9) AS accuracy FROM k')
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_metrics(metrics.confusion(pixels(spark, sf_dir))))


MEANS = ", ".join(f"round(avg({x}), 9) AS macro_{x}, round(sum({x} * support) / nullif(sum(support) FILTER ({x} IS NOT NULL), 0), 9) AS weighted_{x}" for x in ("iou", "dice", "precision", "recall"))


@query(f"""WITH {METRICS_SQL}, s AS (SELECT tile_id, {MEANS}, round(sum(tp) / nullif(sum(tp) + sum(fp) + sum(fn), 0), 9) AS micro_iou, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 9) AS micro_dice, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 9) AS micro_precision,
  round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 9) AS micro_recall, round(sum(tp) / sum(support), 9) AS accuracy, max(iou) FILTER (class_id = 0) AS c0, max(iou) FILTER (class_id = 1) AS c1 FROM k GROUP BY 1)
SELECT * EXCLUDE (c0, c1), round(c0, 9) AS c0_iou, round(c1, 9) AS c1_iou, round(2 * c0 * c1 / (c0 + c1 + 1e-8), 9) AS harmonic_iou FROM s""")
def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.summary_metrics(metrics.class_metrics(metrics.confusion(pixels(spark, sf_dir)))))


@query(f"""WITH {PX}, u AS (SELECT tile_id, count(*) FILTER (target < 2 AND pred < 2) AS a, count(*) FILTER (target < 2 OR pred < 2) AS b, count(*) FILTER ((target < 2) = (pred < 2)) AS c, count(*) AS n FROM px GROUP BY 1)
SELECT tile_id, round(a / nullif(b, 0), 9) AS pore_union_iou, round(c / n, 9) AS agreement FROM u""")
def pore_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pore_union(metrics.confusion(pixels(spark, sf_dir))))


@query(f"""WITH {PX} SELECT tile_id, CAST(grouping(tile_id) AS INTEGER) AS pooled, count(*) AS pixels, count(*) FILTER (target < 2 AND v < 100) AS pore_in, count(*) FILTER (target < 2 AND v >= 100) AS pore_out, count(*) FILTER (target = 2 AND v < 100) AS mineral_in, count(*) FILTER (target = 2 AND v >= 100) AS mineral_out,
  count(*) FILTER (target = 0 AND v >= 100) AS c0_outside, count(*) FILTER (target = 1 AND v >= 100) AS c1_outside, count(*) FILTER ((target < 2) <> (v < 100)) AS mismatched, count(*) FILTER ((target < 2) = (v < 100)) AS matched, round(count(*) FILTER ((target < 2) <> (v < 100)) / count(*), 9) AS mismatch_rate FROM px GROUP BY ROLLUP (tile_id)""")
def gate_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.gate_diagnostic(pixels(spark, sf_dir)).withColumn("pooled", F.col("pooled").cast("int")))


@query(f"""WITH {PX}, {CM}, r AS (SELECT CASE WHEN grouping(tile_id) = 1 THEN 'pooled' ELSE 'tile' END AS scope, CAST(tile_id AS VARCHAR) AS tile, true_id, pred_id, sum(n) AS n FROM cm GROUP BY ROLLUP (true_id, pred_id, tile_id) HAVING grouping(true_id, pred_id, tile_id) IN (0, 1)),
m AS (SELECT scope, tile, class_id, sum(n) FILTER (true_id = class_id AND pred_id = class_id) AS tp, sum(n) FILTER (true_id <> class_id AND pred_id = class_id) AS fp, sum(n) FILTER (true_id = class_id AND pred_id <> class_id) AS fn FROM r, (SELECT unnest([0,1,2]) AS class_id) GROUP BY ALL)
SELECT scope, tile, class_id, unnest(['iou', 'dice', 'precision', 'recall']) AS metric, round(unnest([tp / nullif(tp + fp + fn, 0), 2 * tp / nullif(2 * tp + fp + fn, 0), tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0)]), 9) AS value FROM m""")
def tile_and_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.tile_and_pooled(metrics.confusion(pixels(spark, sf_dir))))


def seeded_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of three made-up methods: seeded ones mark by l_linestatus in one of three ways, one has no seed."""
    px = pixels(spark, sf_dir)
    ways = F.array(*[F.struct(F.lit(m).alias("method_id"), F.lit(s).cast("int").alias("seed")) for m, s in (("A", 1), ("A", 2), ("B", 1), ("B", 2), ("C", None))])
    p = px.withColumn("w", F.explode(ways)).select("tile_id", "y", "x", "target", "w.*", F.col("pred").alias("base"))
    shift = (F.col("y") + F.col("x") * F.coalesce("seed", F.lit(3))) % F.when(F.col("method_id") == "A", 5).when(F.col("method_id") == "B", 4).otherwise(3) == 0
    return metrics.confusion(p.withColumn("pred", F.when(shift, (F.col("base") + 1) % 3).otherwise(F.col("base"))), ["method_id", "seed", "tile_id"]).withColumnRenamed("tile_id", "tile")


SEEDED = f"""{PX}, ways(method_id, seed, m, s) AS (VALUES ('A', 1, 5, 1), ('A', 2, 5, 2), ('B', 1, 4, 1), ('B', 2, 4, 2), ('C', NULL, 3, 3)),
sp AS (SELECT method_id, CAST(seed AS INTEGER) AS seed, tile_id AS tile, target, CASE WHEN (y + x * s) % m = 0 THEN (pred + 1) % 3 ELSE pred END AS pred FROM px, ways),
scm AS (SELECT method_id, seed, tile, t AS true_id, q AS pred_id, count(*) FILTER (target = t AND pred = q) AS n FROM sp, (SELECT unnest([0,1,2]) AS t), (SELECT unnest([0,1,2]) AS q) GROUP BY ALL)"""


@query(f"WITH {SEEDED}, p AS (SELECT method_id, true_id, pred_id, CAST(sum(n) AS BIGINT) AS n FROM scm GROUP BY ALL) SELECT method_id, true_id, pred_id, n, round(n / sum(n) OVER (PARTITION BY method_id, true_id), 9) AS row_fraction, CASE WHEN true_id = pred_id THEN 'correct' ELSE 'error' END AS outcome FROM p")
def method_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.method_confusion(seeded_confusion(spark, sf_dir)))


IOUS = """i AS (SELECT method_id, seed, class_id, sum(n) FILTER (true_id = class_id AND pred_id = class_id) / sum(n) FILTER (true_id = class_id OR pred_id = class_id) AS value FROM scm, (SELECT unnest([0,1,2]) AS class_id) GROUP BY ALL)"""


def seed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = seeded_confusion(spark, sf_dir).groupBy("method_id", "seed", "true_id", "pred_id").agg(F.sum("n").alias("n"))
    m = metrics.class_metrics(pooled, ["method_id", "seed"])
    return m.select("method_id", "seed", F.concat(F.lit("iou"), F.col("class_id").cast("string")).alias("metric"), F.col("iou").alias("value"))


@query(f"WITH {SEEDED}, {IOUS} SELECT method_id, 'iou' || class_id AS metric, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd FROM i GROUP BY ALL")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.seed_summary(seed_values(spark, sf_dir)))


@query(f"""WITH {SEEDED}, {IOUS} SELECT a.method_id, a.seed, 'iou' || a.class_id AS metric, round(r.value - a.value, 9) AS difference FROM i a JOIN i r ON r.method_id = 'A' AND r.seed = a.seed AND r.class_id = a.class_id WHERE a.method_id <> 'A'
UNION ALL SELECT a.method_id, a.seed, 'iou' || a.class_id, round(r.v - a.value, 9) FROM i a JOIN (SELECT class_id, avg(value) AS v FROM i WHERE method_id = 'A' GROUP BY 1) r USING (class_id) WHERE a.seed IS NULL""")
def seed_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = seed_values(spark, sf_dir)
    cols = ["method_id", "seed", "metric", "difference"]
    return rounded(pairing.contrast_by_seed(v, "A").select(*cols).unionByName(pairing.contrast_by_mean(v, "A").select(*cols)))


@query(f"""WITH {SEEDED}, w AS (SELECT method_id, seed, tile, sum(n) FILTER (true_id = 0 AND pred_id = 1) AS c0_as_c1, sum(n) FILTER (true_id = 1 AND pred_id = 0) AS c1_as_c0, sum(n) FILTER (true_id < 2 AND pred_id = 2) AS pore_as_mineral, sum(n) FILTER (true_id = 2 AND pred_id < 2) AS mineral_as_pore,
  sum(n) FILTER (true_id = 0 AND pred_id = 0) / nullif(sum(n) FILTER (true_id = 0 OR pred_id = 0), 0) AS c0, sum(n) FILTER (true_id = 1 AND pred_id = 1) / nullif(sum(n) FILTER (true_id = 1 OR pred_id = 1), 0) AS c1 FROM scm GROUP BY ALL),
h AS (SELECT *, 2 * c0 * c1 / (c0 + c1 + 1e-8) AS h FROM w)
SELECT a.method_id, a.seed, a.tile, CAST(a.c0_as_c1 AS BIGINT) AS c0_as_c1, CAST(a.c1_as_c0 AS BIGINT) AS c1_as_c0, CAST(a.pore_as_mineral AS BIGINT) AS pore_as_mineral, CAST(a.mineral_as_pore AS BIGINT) AS mineral_as_pore, round(a.h, 9) AS harmonic_iou,
  CASE WHEN a.c0 IS NULL OR a.c1 IS NULL THEN 'undefined' WHEN abs(a.c0 - a.c1) <= 1e-15 THEN 'tie' WHEN a.c0 < a.c1 THEN 'C0' ELSE 'C1' END AS worst_class,
  round(CASE WHEN a.method_id <> 'A' THEN coalesce(r.h, CASE WHEN a.seed IS NULL THEN m.v END) - a.h END, 9) AS contrast
FROM h a LEFT JOIN h r ON r.method_id = 'A' AND r.seed = a.seed AND r.tile = a.tile LEFT JOIN (SELECT tile, CASE WHEN count(*) = count(h) THEN avg(h) END AS v FROM h WHERE method_id = 'A' GROUP BY 1) m ON m.tile = a.tile""")
def tile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = audit.tile_errors(seeded_confusion(spark, sf_dir), "A")
    return rounded(e.select("method_id", "seed", "tile", "c0_as_c1", "c1_as_c0", "pore_as_mineral", "mineral_as_pore", "harmonic_iou", "worst_class", "contrast"))


# Curves and losses


@query(f"WITH {SC}, o AS (SELECT target, unnest(probs) AS p, unnest([0, 1, 2]) AS class_id FROM sc) SELECT class_id, CAST(least(floor(p * 4096), 4095) AS INTEGER) AS bin_id, count(*) FILTER (target = class_id) AS pos, count(*) FILTER (target <> class_id) AS neg FROM o GROUP BY 1, 2")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_histogram(scored(spark, sf_dir))


@query(f"""WITH {SC}, o AS (SELECT target, unnest(probs) AS p, unnest([0, 1, 2]) AS class_id FROM sc), h AS (SELECT class_id, CAST(least(floor(p * 4096), 4095) AS INTEGER) AS bin_id, count(*) FILTER (target = class_id) AS pos, count(*) FILTER (target <> class_id) AS neg FROM o GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER d / sum(pos) OVER e AS tpr, sum(neg) OVER d / sum(neg) OVER e AS fpr, sum(pos) OVER d / (sum(pos) OVER d + sum(neg) OVER d) AS prec FROM h WINDOW d AS (PARTITION BY class_id ORDER BY bin_id DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY class_id)),
l AS (SELECT *, coalesce(lag(tpr) OVER w, 0) AS t0, coalesce(lag(fpr) OVER w, 0) AS f0, coalesce(lag(prec) OVER w, 1) AS p0 FROM c WINDOW w AS (PARTITION BY class_id ORDER BY bin_id DESC))
SELECT class_id, round(sum((fpr - f0) * (tpr + t0) / 2), 9) AS roc_auc, round(sum((tpr - t0) * prec), 9) AS average_precision, round(sum((tpr - t0) * (prec + p0) / 2), 9) AS pr_auc FROM l GROUP BY 1""")
def roc_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.curves(metrics.score_histogram(scored(spark, sf_dir))))


@query(f"""WITH {SC}, b AS (SELECT tile_id, probs[1] AS s, CAST(target = 0 AS INTEGER) AS l FROM sc), g AS (SELECT tile_id, s, sum(l) AS pos, sum(1 - l) AS neg FROM b GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY tile_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp FROM g)
SELECT tile_id, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM c GROUP BY 1 HAVING sum(pos) > 0 AND sum(neg) > 0""")
def exact_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("tile_id", F.get("probs", F.lit(0)).alias("score"), (F.col("target") == 0).cast("int").alias("label"))
    return rounded(curves.roc(s, ["tile_id"]))


@query(f"""WITH {SC}, o AS (SELECT tile_id, pixel, target, unnest(probs) AS p, unnest([0, 1, 2]) AS c FROM sc), e AS (SELECT *, CAST(target = c AS INTEGER) AS fg, abs(CAST(target = c AS INTEGER) - p) AS e FROM o),
s AS (SELECT *, sum(fg) OVER (PARTITION BY tile_id, c) AS g, sum(fg) OVER w AS cf, sum(1 - fg) OVER w AS cb FROM e WINDOW w AS (PARTITION BY tile_id, c ORDER BY e DESC, pixel ROWS UNBOUNDED PRECEDING)),
j AS (SELECT *, 1 - (g - cf) / (g + cb) AS j FROM s WHERE g > 0), d AS (SELECT *, j - coalesce(lag(j) OVER (PARTITION BY tile_id, c ORDER BY e DESC, pixel), 0) AS dj FROM j)
SELECT tile_id, round(avg(l), 9) AS lovasz FROM (SELECT tile_id, c, sum(e * dj) AS l FROM d GROUP BY 1, 2) GROUP BY 1""")
def lovasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.lovasz(scored(spark, sf_dir)))


@query(f"""WITH {SC}, o AS (SELECT tile_id, target, unnest(probs) AS p, unnest([0, 1, 2]) AS class_id FROM sc), d AS (SELECT tile_id, class_id, (2 * sum(p) FILTER (target = class_id) + 1) / (sum(p) + count(*) FILTER (target = class_id) + 1) AS dice FROM (SELECT tile_id, target, class_id, p FROM o) GROUP BY 1, 2),
f AS (SELECT tile_id, class_id, coalesce(dice, 1 / (sp + 1)) AS dice FROM d JOIN (SELECT tile_id, class_id, sum(p) AS sp FROM o GROUP BY 1, 2) USING (tile_id, class_id))
SELECT tile_id, class_id, round(dice, 9) AS dice FROM f UNION ALL SELECT tile_id, -1, round(avg(dice), 9) FROM f GROUP BY 1""")
def soft_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.soft_dice(scored(spark, sf_dir), ["tile_id"]))


@query(f"""WITH {SC}, q AS (SELECT tile_id, greatest(probs[target + 1], 1e-7) AS p, [0.5, 0.3, 0.2][target + 1]::DOUBLE AS w FROM sc) SELECT tile_id, round(avg(-ln(p)), 9) AS cross_entropy, round(avg(w * (1 - p) ** 2 * -ln(p)), 9) AS focal, round(sum(w * -ln(p)) / sum(w), 9) AS weighted_cross_entropy, count(*) AS pixels FROM q GROUP BY 1""")
def focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.log_losses(scored(spark, sf_dir), ["tile_id"], alpha=[0.5, 0.3, 0.2]))


@query(f"""WITH {SC}, o AS (SELECT tile_id, CASE WHEN target = c THEN -[0.5, 0.3, 0.2][c + 1]::DOUBLE * (1 - p) ** 2 * ln(greatest(p, 1e-7)) ELSE -[1.0, 2.0, 0.5][c + 1]::DOUBLE * p ** 4 * ln(greatest(1 - p, 1e-7)) END AS t, pixel FROM (SELECT tile_id, pixel, target, unnest(probs) AS p, unnest([0, 1, 2]) AS c FROM sc)) SELECT tile_id, round(sum(t) / count(DISTINCT pixel), 9) AS asymmetric_focal FROM o GROUP BY 1""")
def asymmetric_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.asymmetric_focal(scored(spark, sf_dir), ["tile_id"], alpha_pos=[0.5, 0.3, 0.2], alpha_neg=[1.0, 2.0, 0.5]))


@query(f"""WITH {SC}, o AS (SELECT tile_id, CAST(target = c AS DOUBLE) AS t, p, c FROM (SELECT tile_id, target, unnest(probs) AS p, unnest([0, 1, 2]) AS c FROM sc)), s AS (SELECT tile_id, c, sum(p * t) AS tp, sum(p) AS p, sum(t) AS t FROM o GROUP BY 1, 2), i AS (SELECT tile_id, (tp + 1e-6) / (tp + 0.7::DOUBLE * (p - tp) + 0.3::DOUBLE * (t - tp) + 1e-6) AS i FROM s)
SELECT tile_id, round(avg(i), 9) AS tversky, round(avg(greatest(1 - i, 0) ** 2), 9) AS focal_tversky FROM i GROUP BY 1""")
def tversky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.tversky(scored(spark, sf_dir)))


OVERLAP = f"""{SC}, o AS (SELECT tile_id, CAST(target = c AS DOUBLE) AS t, p, c FROM (SELECT tile_id, target, unnest(probs) AS p, unnest([0, 1, 2]) AS c FROM sc)),
s AS (SELECT tile_id, c, sum(p * t) AS tp, sum(p) AS p, sum(t) AS t, sum(t) / count(*) AS share FROM o GROUP BY 1, 2)"""


@query(f"""WITH {OVERLAP}, i AS (SELECT tile_id, c, (tp + 1e-6) / (tp + CASE WHEN share < 0.01 THEN 0.7::DOUBLE WHEN share < 0.2 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * (p - tp) + CASE WHEN share < 0.01 THEN 0.3::DOUBLE WHEN share < 0.2 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END * (t - tp) + 1e-6) AS i, [100, 10, 1][c + 1] AS w FROM s)
SELECT tile_id, round(sum(w * i) / sum(w), 9) AS tversky, round(sum(w * greatest(1 - i, 0) ** 2) / sum(w), 9) AS focal_tversky FROM i GROUP BY 1""")
def adaptive_tversky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.tversky(scored(spark, sf_dir), adaptive=True, weights=[100, 10, 1]))


def with_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh pixel has the ignored target."""
    return scored(spark, sf_dir).withColumn("target", F.when(F.col("pixel") % 7 == 0, -100).otherwise(F.col("target")))


@query(f"""WITH {SC}, w AS (SELECT tile_id, target, list_position(probs, list_max(probs)) - 1 AS a, greatest(probs[target + 1], 1e-7) AS p FROM sc WHERE pixel % 7 <> 0),
g AS (SELECT tile_id, avg(CASE WHEN a < 2 AND target = 2 THEN 10.0::DOUBLE WHEN a < 2 AND a = target THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * (1 - p) ** 2 * -ln(p)) AS focal, avg(CASE WHEN a < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM w GROUP BY 1)
SELECT tile_id, round(focal, 9) AS focal, round(r, 9) AS pore_ratio, round(focal * CASE WHEN r > 0.15::DOUBLE THEN 1 + 10 * (r - 0.15::DOUBLE) ELSE 1 END, 9) AS score FROM g""")
def sparse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.sparse_score(with_ignored(spark, sf_dir)))


@query(f"""WITH {SC}, p AS (SELECT tile_id, probs[1] AS p0, probs[2] AS p1, probs[3] AS p2, CAST(target = 0 AS DOUBLE) AS t0, CAST(target = 1 AS DOUBLE) AS t1, CAST(target = 2 AS DOUBLE) AS t2 FROM sc WHERE pixel % 7 <> 0),
q AS (SELECT *, p0 + p1 AS u, t0 + t1 AS v, p0 / (p0 + p1) * (t0 + t1) AS c0, p1 / (p0 + p1) * (t0 + t1) AS c1 FROM p),
d AS (SELECT tile_id, 1 - (2 * sum(p0 * t0) + 1e-6) / (sum(p0) + sum(t0) + 1e-6) AS l0, 1 - (2 * sum(p1 * t1) + 1e-6) / (sum(p1) + sum(t1) + 1e-6) AS l1, 1 - (2 * sum(p2 * t2) + 1e-6) / (sum(p2) + sum(t2) + 1e-6) AS l2,
  1 - (2 * sum(u * v) + 1e-6) / (sum(u) + sum(v) + 1e-6) AS lu, 1 - (2 * sum(c0 * t0) + 1e-6) / (sum(c0) + sum(t0) + 1e-6) AS k0, 1 - (2 * sum(c1 * t1) + 1e-6) / (sum(c1) + sum(t1) + 1e-6) AS k1 FROM q GROUP BY 1),
w AS (SELECT 1 / sqrt(0.04::DOUBLE) AS w0, 1 / sqrt(0.96::DOUBLE) AS w1), e AS (SELECT tile_id, (l0 + l1 + l2) / 3 AS region, lu AS pore_union, (w0 * k0 + w1 * k1) / (w0 + w1) AS conditional FROM d, w)
SELECT tile_id, round(region, 9) AS region, round(pore_union, 9) AS pore_union, round(conditional, 9) AS conditional, round(0.5::DOUBLE * region + 0.25::DOUBLE * pore_union + 0.25::DOUBLE * conditional, 9) AS loss FROM e""")
def hierarchical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(losses.hierarchical_score(with_ignored(spark, sf_dir), (4, 96), ["tile_id"], weights=(2.0, 1.0, 1.0)))


@query("""WITH u AS (SELECT vec_id, vec_id // 64 AS block, label % 4 AS label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM u),
c AS (SELECT a.block, list_dot_product(a.e, b.e) / (a.l * b.l) / 0.07::DOUBLE AS s, a.label = b.label AND a.vec_id <> b.vec_id AS same FROM n a JOIN n b USING (block))
SELECT block, round(sum(CASE WHEN same THEN s + 1 ELSE greatest(1 - s, 0) END) / count(*), 6) AS separation, CAST(sqrt(count(*)) AS BIGINT) AS n FROM c GROUP BY 1""")
def pair_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).cast("bigint").alias("b"), F.pmod("label", F.lit(4)).alias("label"), "embedding")
    return rounded(losses.pair_separation(e, "b"), 6)


# Bootstrap


DRAWS = """ord AS (SELECT tile, row_number() OVER (ORDER BY tile) - 1 AS k FROM (SELECT DISTINCT tile_id AS tile FROM px)), tt AS (SELECT count(*) AS t FROM ord),
dr AS (SELECT rep, tile, count(*) AS times FROM (SELECT rep, ('0x' || substr(md5('77:' || rep || ':' || slot), 1, 12))::BIGINT % t AS k FROM range(200) r(rep), tt, LATERAL (SELECT unnest(range(t)) AS slot)) JOIN ord USING (k) GROUP BY 1, 2)"""


@query(f"""WITH {PX}, {CM}, {DRAWS}, s AS (SELECT rep, true_id, pred_id, sum(n * times) AS n FROM cm JOIN dr ON cm.tile_id = dr.tile GROUP BY ALL),
i AS (SELECT rep, class_id, sum(n) FILTER (true_id = class_id AND pred_id = class_id) / nullif(sum(n) FILTER (true_id = class_id OR pred_id = class_id), 0) AS value FROM s, (SELECT unnest([0,1,2]) AS class_id) GROUP BY ALL)
SELECT class_id, 'iou' AS metric, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high, count(value) AS n_finite, count(*) AS n_reps FROM i GROUP BY 1""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bootstrap.bootstrap(metrics.confusion(pixels(spark, sf_dir)), 200, 77, by="hash")
    return rounded(b.where("metric = 'iou'").withColumns({"low": F.col("low"), "high": F.col("high")}))


@query()
def bootstrap_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics, 5,000 replicates, draws by splits."""
    return rounded(bootstrap.bootstrap(metrics.confusion(pixels(spark, sf_dir))))


@query()
def paired_bootstrap_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.paired_bootstrap(seeded_confusion(spark, sf_dir), "A", tile="tile"))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.paired_bootstrap(seeded_confusion(spark, sf_dir), "A", 100, 19, tile="tile", by="hash"))


# Selection


@query(f"""WITH {LOG}, k AS (SELECT *, max((score, tie_breaker, -val_loss)) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lg), i AS (SELECT *, b IS NULL OR (score, tie_breaker, -val_loss) > b AS improved FROM k)
SELECT run_id, CAST(epoch AS INTEGER) AS epoch, improved, CASE WHEN b IS NULL THEN 'first' WHEN NOT improved THEN 'none' WHEN score > struct_extract_at(b, 1) THEN 'score' WHEN tie_breaker > struct_extract_at(b, 2) THEN 'tie_breaker' ELSE 'val_loss' END AS reason,
  CAST(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS INTEGER) AS best_epoch FROM i""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.running_best(epoch_log(spark, sf_dir)).drop("score", "tie_breaker", "val_loss")  # the table's own, rounded


@query(f"""WITH {LOG}, k AS (SELECT *, max((score, tie_breaker, -val_loss)) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lg), i AS (SELECT *, b IS NULL OR (score, tie_breaker, -val_loss) > b AS improved FROM k),
w AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS best FROM i) SELECT run_id, CAST(min(epoch) FILTER (epoch - best >= 5) AS INTEGER) AS stop_epoch, CAST(max(epoch) AS INTEGER) AS last_epoch, CAST(arg_min(best, epoch) FILTER (epoch - best >= 5) AS INTEGER) AS best_epoch FROM w GROUP BY 1""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.early_stop(epoch_log(spark, sf_dir), 5)


@query("SELECT p_partkey, round(a, 4) AS a, round(b, 4) AS b FROM (SELECT p_partkey, nullif(p_retailprice % 97, 0) AS a, nullif(p_size % 7, 0)::DOUBLE AS b FROM part) t ORDER BY t.a DESC NULLS LAST, t.b DESC NULLS LAST, p_partkey LIMIT 20")
def run_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_retailprice") % 97, F.lit(0.0)).alias("a"), F.nullif(F.col("p_size") % 7, F.lit(0)).cast("double").alias("b"))
    return selection.rank_runs(p, "a", "b")


@query(f"""WITH {SC}, l AS (SELECT tile_id, avg(-ln(greatest(probs[target + 1], 1e-7))) AS loss FROM sc GROUP BY 1) SELECT tile_id, round(loss, 9) AS loss FROM l ORDER BY l.loss DESC, tile_id LIMIT 5""")
def hard_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.hard_examples(scored(spark, sf_dir), 5))


@query(f"""WITH {SC}, l AS (SELECT tile_id, pixel, -ln(greatest(probs[target + 1], 1e-7)) AS loss FROM sc), r AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY loss DESC, pixel) AS k, count(*) OVER (PARTITION BY tile_id) AS n FROM l) SELECT tile_id, pixel, round(loss, 9) AS loss FROM r WHERE k <= greatest(floor(n * 0.2::DOUBLE), least(4, n))""")
def keep_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("tile_id", "pixel", (-F.log(F.greatest(F.get("probs", F.col("target")), F.lit(1e-7)))).alias("loss"))
    return rounded(selection.keep_hard(s, 0.2, 4, "tile_id", "loss", "pixel"))


# Pairing and governance


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS splits, 'in several splits' AS finding FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1
UNION ALL SELECT o_custkey, max(o_orderstatus), 'repeated in a split' FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1 AND count(*) > 1""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.check_leakage(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("split")), "o_custkey")


@query("""WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 <> 0)
SELECT k AS ident, 'not assigned' AS finding FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'unknown' FROM b ANTI JOIN a USING (k)""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a finished order against customers, with some of either left out."""
    o, c = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_custkey % 5 <> 0"), table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    return audit.check_complete(o.select(F.col("o_custkey").alias("ident")), c.select(F.col("c_custkey").alias("id")), "ident")


@query("""WITH a AS (SELECT p_name AS name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_name AS name FROM part WHERE p_partkey % 3 = 0) SELECT name, 'missing' AS finding FROM (SELECT name FROM a EXCEPT ALL SELECT name FROM b) UNION ALL SELECT name, 'unexpected' FROM (SELECT name FROM b EXCEPT ALL SELECT name FROM a)""")
def name_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey")
    return audit.diff_names(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN '*' ELSE 'price' END AS "column", CASE WHEN o_orderkey % 10 = 0 THEN 'missing in b' ELSE 'differs' END AS finding FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    b = o.where("k % 10 <> 0").withColumn("price", F.when(F.col("k") % 7 == 0, F.col("price") + 1).when(F.col("k") % 11 == 0, F.col("price") * (1 + 1e-12)).otherwise(F.col("price")))
    return pairing.reconcile(o, b, ["k"], ["status"], ["price"])


@query("""SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS variants FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""")
def constancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.check_constant(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderpriority"])


def leaks_sql() -> str:
    """The first match of each pattern; RE2 has no look-ahead, so the one that needs it says what may come first."""
    parts = []
    for name, pattern in audit.LEAK_PATTERNS.items():
        plain = pattern.replace("(?![<$\\{])[^'\\\"]{8,}", "[^'\\\"<$\\{][^'\\\"]{7,}").replace("'", "''")
        parts.append(f"SELECT doc_id AS path, '{name}' AS pattern, text, regexp_extract(text, '{plain}') AS m FROM documents")
    before = "left(text, strpos(text, m) - 1)"
    return f"""SELECT path, pattern, CAST(1 + length({before}) - length(replace({before}, chr(10), '')) AS INTEGER) AS line, m AS "match" FROM ({' UNION ALL '.join(parts)}) WHERE m <> ''"""


@query(leaks_sql())
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leak patterns over all texts."""
    return audit.scan_patterns(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("""SELECT split_part(url, '/', 3) AS host, count(*) AS files, sha256(string_agg(page_id || chr(0) || octet_length(encode(html)) || chr(0) || sha256(html), chr(10) ORDER BY page_id || chr(0) || octet_length(encode(html)) || chr(0) || sha256(html))) AS digest, sha256(string_agg(CAST(page_id AS VARCHAR), chr(10) ORDER BY CAST(page_id AS VARCHAR))) AS names_digest FROM pages GROUP BY 1""")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.col("page_id").cast("string").alias("name"), F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha256"))
    return metrics.corpus_digest(p, ["host"])


@query("""SELECT split_part(url, '/', 3) AS host, count(*) AS files, sha256(string_agg(page_id || chr(0) || html || chr(0), '' ORDER BY CAST(page_id AS VARCHAR))) AS image_digest, sha256('["' || string_agg(CAST(page_id AS VARCHAR), '","' ORDER BY CAST(page_id AS VARCHAR)) || '"]') AS names_digest FROM pages GROUP BY 1""")
def host_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the bytes of each host's pages."""
    p = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.col("page_id").cast("string").alias("name"), F.col("html").alias("content"))
    return metrics.byte_digest(p, ["host"])


@query("""SELECT DISTINCT 'brand-' || substr(sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}'), 1, 16) AS id, p_brand, p_size FROM part""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()
    return p.select(F.concat(F.lit("brand-"), F.substring(F.sha2(canonical_json(["p_size", "p_brand"]), 256), 1, 16)).alias("id"), "p_brand", "p_size")


@query()
def json_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"k": 1, "k": '), F.col("event_id").cast("string"), F.lit("}"))).otherwise(F.col("props")).alias("props"))
    return audit_json(e, "props", "event_id")


# Raster


@query(f"""WITH {PX}, t AS (SELECT tile_id, max(y) + 1 AS h, 24 AS w FROM px GROUP BY 1), yy AS (SELECT tile_id, w, h, unnest(list_sort(list_distinct(list_append(range(0, h - 10 + 1, 7), h - 10)))) AS y0 FROM t), xx AS (SELECT *, unnest(list_sort(list_distinct(list_append(range(0, w - 10 + 1, 7), w - 10)))) AS x0 FROM yy)
SELECT tile_id, CAST(dense_rank() OVER (PARTITION BY tile_id ORDER BY y0) - 1 AS INTEGER) AS "row", CAST(dense_rank() OVER (PARTITION BY tile_id ORDER BY x0) - 1 AS INTEGER) AS col, CAST(y0 AS INTEGER) AS y0, CAST(x0 AS INTEGER) AS x0 FROM xx""")
def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pixels(spark, sf_dir).groupBy("tile_id").agg((F.max("y") + 1).alias("height")).withColumn("width", F.lit(24))
    return grid.patch_grid(t, 10, 3).select("tile_id", "row", "col", "y0", "x0")


@query()
def stitched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    t = px.groupBy("tile_id").agg((F.max("y") + 1).alias("height")).withColumn("width", F.lit(24))
    c = grid.cut(px, grid.patch_grid(t, 10, 3)).withColumn("value", (F.col("patch_row") * 1000 + F.col("patch_col")).cast("int"))
    return grid.stitch(c)


PAD = "p AS (SELECT tile_id, y, x, CAST(v AS DOUBLE) AS v, max(x) OVER (PARTITION BY tile_id, y) AS mx, max(y) OVER (PARTITION BY tile_id, x) AS my FROM px)"
REFLECT = lambda c, m: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > {m} THEN 2 * {m} + 1 - ({c}) ELSE {c} END"


@query(f"""WITH {PX}, {PAD}, hx AS (SELECT a.tile_id, a.y, a.x, sum(b.v) / 3 AS v FROM (SELECT tile_id, y, x, {REFLECT('x + d', 'mx')} AS sx FROM p, (SELECT unnest([-1, 0, 1]) AS d)) a JOIN p b ON b.tile_id = a.tile_id AND b.y = a.y AND b.x = a.sx GROUP BY ALL),
hy AS (SELECT *, max(y) OVER (PARTITION BY tile_id, x) AS my FROM hx) SELECT a.tile_id, a.y, a.x, round(sum(b.v) / 3, 6) AS v FROM (SELECT tile_id, y, x, {REFLECT('y + d', 'my')} AS sy FROM hy, (SELECT unnest([-1, 0, 1]) AS d)) a JOIN hy b ON b.tile_id = a.tile_id AND b.x = a.x AND b.y = a.sy GROUP BY ALL""")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.box_mean(pixels(spark, sf_dir), 3), 6)


@query()
def gaussian_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.gaussian(pixels(spark, sf_dir), 1.0), 6)


@query()
def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.sobel(pixels(spark, sf_dir)), 6)


@query(f"""WITH {PX}, m AS (SELECT tile_id, y, x, v < 100 AS mask FROM px) SELECT a.tile_id, a.y, a.x, count(*) FILTER (b.mask) = 9 AS eroded, bool_or(b.mask) AS dilated FROM m a JOIN m b ON a.tile_id = b.tile_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL""")
def erode_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pixels(spark, sf_dir).withColumns({"eroded": F.col("v") < 100, "dilated": F.col("v") < 100})
    return filters.dilate(filters.erode(m, 3, "eroded"), 3, "dilated").select("tile_id", "y", "x", "eroded", "dilated")


FLOOD = """on_ AS (SELECT tile_id, y, x, y * 16777216 + x AS k FROM px WHERE v < 100),
flood AS (SELECT tile_id, k, k AS l FROM on_ UNION SELECT b.tile_id, b.k, a.l FROM flood a JOIN on_ b ON a.tile_id = b.tile_id AND abs(b.y - a.k // 16777216) <= 1 AND abs(b.x - a.k % 16777216) <= 1 AND a.l < b.k),
reg AS (SELECT tile_id, k, min(l) AS region_id FROM flood GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {PX}, {FLOOD} SELECT tile_id, CAST(k // 16777216 AS INTEGER) AS y, CAST(k % 16777216 AS INTEGER) AS x, CAST(region_id AS BIGINT) AS region_id FROM reg")
def gate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).select("tile_id", "y", "x", (F.col("v") < 100).alias("mask"))
    return components.components(px).select("tile_id", "y", "x", "region_id")


@query(f"WITH RECURSIVE {PX}, {FLOOD}, s AS (SELECT tile_id, region_id, count(*) AS area, min(k // 16777216) AS y0, min(k % 16777216) AS x0, max(k // 16777216) AS y1, max(k % 16777216) AS x1, round(avg(k // 16777216), 9) AS cy, round(avg(k % 16777216), 9) AS cx FROM reg GROUP BY 1, 2) SELECT cy, cx, tile_id, CAST(region_id AS BIGINT) AS region_id, area, CAST(y0 AS INTEGER) AS y0, CAST(x0 AS INTEGER) AS x0, CAST(y1 AS INTEGER) AS y1, CAST(x1 AS INTEGER) AS x1, count(*) OVER (PARTITION BY tile_id) AS regions, max(area) OVER (PARTITION BY tile_id) AS largest FROM s")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).select("tile_id", "y", "x", (F.col("v") < 100).alias("mask"))
    return rounded(components.component_stats(components.components(px)))


AREA_RULE = f"""{PX}, {FLOOD}, ar AS (SELECT tile_id, k, count(*) OVER (PARTITION BY tile_id, region_id) AS a FROM reg), cls AS (SELECT px.tile_id, y, x, target, CASE WHEN v >= 100 THEN 2 WHEN a < 25 THEN 0 ELSE 1 END AS pred FROM px LEFT JOIN ar ON ar.tile_id = px.tile_id AND ar.k = px.y * 16777216 + px.x),
cm AS (SELECT tile_id, t AS true_id, q AS pred_id, count(*) FILTER (target = t AND pred = q) AS n FROM cls, (SELECT unnest([0,1,2]) AS t), (SELECT unnest([0,1,2]) AS q) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {AREA_RULE}, r AS (SELECT CASE WHEN grouping(tile_id) = 1 THEN 'pooled' ELSE 'tile' END AS scope, CAST(tile_id AS VARCHAR) AS tile, true_id, pred_id, sum(n) AS n FROM cm GROUP BY ROLLUP (true_id, pred_id, tile_id) HAVING grouping(true_id, pred_id, tile_id) IN (0, 1)),
m AS (SELECT scope, tile, class_id, sum(n) FILTER (true_id = class_id AND pred_id = class_id) AS tp, sum(n) FILTER (true_id <> class_id AND pred_id = class_id) AS fp, sum(n) FILTER (true_id = class_id AND pred_id <> class_id) AS fn FROM r, (SELECT unnest([0,1,2]) AS class_id) GROUP BY ALL)
SELECT scope, tile, class_id, unnest(['iou', 'dice', 'precision', 'recall']) AS metric, round(unnest([tp / nullif(tp + fp + fn, 0), 2 * tp / nullif(2 * tp + fp + fn, 0), tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0)]), 9) AS value FROM m""")
def area_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship chain: gate, regions, size rule, confusion counts, metrics by tile and pooled."""
    found = components.classify_by_area(pixels(spark, sf_dir).drop("pred"), 25)
    return rounded(metrics.tile_and_pooled(metrics.confusion(found)))


@query()
def cutoff_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(components.sweep_cutoffs(pixels(spark, sf_dir), [25, 50, 100, 200, 300, 500, 1000], splits(spark, sf_dir)))


@query()
def ring_insides(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("ring", F.col("v") < 130)
    return components.classify_by_ring(components.inside_rings(px)).select("tile_id", "y", "x", "inside", "pred")


@query()
def region_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.annotations(pixels(spark, sf_dir), 4).select("tile_id", "annotation_id", "category_id", "area", F.to_json("bbox").alias("bbox"), F.size("runs").alias("n_runs"))


@query(f"""WITH {PX} SELECT a.tile_id, a.y, a.x, round(sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 9) AS distance FROM (SELECT * FROM px WHERE v < 100) a LEFT JOIN (SELECT * FROM px WHERE v >= 100) b ON a.tile_id = b.tile_id GROUP BY ALL""")
def gate_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distance.distance(pixels(spark, sf_dir).withColumn("mask", F.col("v") < 100))
    return rounded(d.where("mask").select("tile_id", "y", "x", "distance"))


@query()
def grown_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("mask", F.col("v") < 100)
    return distance.seeded_regions(px, distance.markers(px, least=1.0, separation=3))


@query()
def watershed_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers, flood, the region-size rule and its metrics: per tile and pooled."""
    rated = distance.classify_by_watershed(pixels(spark, sf_dir), 12, least=1.0, separation=3)
    return rounded(metrics.tile_and_pooled(metrics.confusion(rated)))


BOUNDARY = f"""{PX}, b0 AS (SELECT tile_id, y, x, target < 2 AS t, pred < 2 AS p FROM px), b1 AS (SELECT a.tile_id, a.y, a.x, a.t AND count(*) FILTER (b.t) < 9 AS bt, a.p AND count(*) FILTER (b.p) < 9 AS bp FROM b0 a JOIN b0 b ON a.tile_id = b.tile_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.tile_id, a.y, a.x, a.t, a.p),
b2 AS (SELECT a.tile_id, a.y, a.x, a.bt, a.bp, bool_or(b.bt) AS nt, bool_or(b.bp) AS np FROM b1 a JOIN b1 b ON a.tile_id = b.tile_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL)"""


@query(f"WITH {BOUNDARY} SELECT tile_id, count(*) FILTER (bp) AS boundary_pred, count(*) FILTER (bp AND nt) AS boundary_pred_hit, count(*) FILTER (bt) AS boundary_true, count(*) FILTER (bt AND np) AS boundary_true_hit FROM b2 GROUP BY 1")
def boundary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.boundary_counts(pixels(spark, sf_dir))


@query()
def boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.boundary_f1(pixels(spark, sf_dir), 0))


@query()
def tile_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.tile_diagnostics(pixels(spark, sf_dir)))


@query()
def topology_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.topology_diff(pixels(spark, sf_dir), 1, 2))


@query()
def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.difficulty(pixels(spark, sf_dir)))


@query()
def hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distance.hausdorff(pixels(spark, sf_dir), 1))


@query(f"""WITH RECURSIVE {PX}, {FLOOD}, e AS (SELECT *, min(y) OVER w AS ya, max(y) OVER w AS yb, min(x) OVER w AS xa, max(x) OVER w AS xb FROM px WINDOW w AS (PARTITION BY tile_id)),
j AS (SELECT r.tile_id, r.region_id, e.target, e.y, e.x, e.y IN (ya, yb) OR e.x IN (xa, xb) AS edge FROM reg r JOIN e ON e.tile_id = r.tile_id AND e.y * 16777216 + e.x = r.k),
s AS (SELECT tile_id, region_id, min(y // 8) <> max(y // 8) OR min(x // 8) <> max(x // 8) AS crosses, bool_or(edge) AS censored, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM j GROUP BY 1, 2)
SELECT target AS label, count(*) AS pixels, count(*) FILTER (crosses) AS crossing, count(*) FILTER (censored) AS censored, count(*) FILTER (n0 > 0 AND n1 > 0) AS mixed, count(*) FILTER ((n0 > n1 AND target = 0) OR (n0 <= n1 AND target = 1)) AS majority_agrees FROM j JOIN s USING (tile_id, region_id) GROUP BY 1""")
def context_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.context_audit(pixels(spark, sf_dir), 8)


RINGS = """ring AS (SELECT p_partkey AS "order", CAST(p_size AS BIGINT) AS tile_id, CAST(p_partkey % 3 AS INTEGER) AS class_id, list_transform(range(6), lambda k: {'x': p_partkey * (7 * k + 3) % 23, 'y': p_partkey * (5 * k + 1) % 19}) AS points FROM part),
edge AS (SELECT "order", tile_id, class_id, unnest(list_transform(range(1, 7), lambda k: {'ax': points[k].x::DOUBLE, 'ay': points[k].y::DOUBLE, 'qx': points[k % 6 + 1].x::DOUBLE, 'qy': points[k % 6 + 1].y::DOUBLE}), recursive := true) FROM ring)"""


@query(f"""WITH {RINGS}, cell AS (SELECT e.*, y, x FROM edge e, range(19) a(y), range(23) b(x)),
hit AS (SELECT "order", tile_id, class_id, y, x, count(*) FILTER (WHERE (ay > y) <> (qy > y) AND x < (qx - ax) * (y - ay) / nullif(qy - ay, 0) + ax) % 2 = 1
  OR bool_or(abs((qx - ax) * (y - ay) - (qy - ay) * (x - ax)) < 1e-9 AND x BETWEEN least(ax, qx) AND greatest(ax, qx) AND y BETWEEN least(ay, qy) AND greatest(ay, qy)) AS h FROM cell GROUP BY ALL)
SELECT tile_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, arg_max(class_id, "order") AS class_id FROM hit WHERE h GROUP BY 1, 2, 3""")
def filled_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross themselves, one of each part, filled one over the other on the raster of its size."""
    key = F.col("p_partkey").cast("bigint")
    point = lambda k: F.struct((key * (7 * k + 3) % 23).alias("x"), (key * (5 * k + 1) % 19).alias("y"))
    rings = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("tile_id"), key.alias("order"), (key % 3).cast("int").alias("class_id"), F.array(*[point(k) for k in range(6)]).alias("points"))
    tiles = rings.select("tile_id").distinct().select("tile_id", F.lit(19).alias("height"), F.lit(23).alias("width"))
    return contours.rasterise(rings, tiles)


@query()
def region_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlines of the pore regions as simplified polygons."""
    return contours.polygons(pixels(spark, sf_dir), (0, 1), 2.0).select("tile_id", "annotation_id", "category_id", "region_id", "area", F.to_json("bbox").alias("bbox"), F.to_json("segmentation").alias("segmentation"))


@query(f"""WITH {PX}, e AS (SELECT tile_id, max(y) - 7 AS ym, max(x) - 7 AS xm FROM px GROUP BY 1), w AS (SELECT tile_id, y0 * 2 AS y0, x0 * 2 AS x0 FROM e, range(400) a(y0), range(12) b(x0) WHERE y0 * 2 <= ym AND x0 * 2 <= xm),
r AS (SELECT w.tile_id, w.y0, w.x0, count(*) FILTER (target = 0) / 64.0::DOUBLE AS ratio FROM w JOIN px p ON p.tile_id = w.tile_id AND p.y BETWEEN w.y0 AND w.y0 + 7 AND p.x BETWEEN w.x0 AND w.x0 + 7 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ratio DESC, y0, x0) AS b, row_number() OVER (PARTITION BY tile_id ORDER BY md5(concat_ws(':', tile_id, y0, x0))) AS d, max(ratio) OVER (PARTITION BY tile_id) AS m FROM r)
SELECT tile_id, y0, x0, ratio FROM k WHERE CASE WHEN m >= 0.2 THEN b ELSE d END = 1""")
def smart_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.smart_crop(pixels(spark, sf_dir), 8, 0.2))


@query(f"""WITH {SC}, d AS (SELECT tile_id, pixel, probs, pixel // 20 AS i FROM sc), q AS (SELECT tile_id, i // 5 AS y, i % 5 AS x, probs FROM d), u AS (SELECT a.tile_id, (abs(a.probs[1] - b.probs[1]) + abs(a.probs[2] - b.probs[2])) / 2 AS g FROM q a JOIN q b ON a.tile_id = b.tile_id AND a.x = b.x AND a.y = b.y + 1),
l AS (SELECT a.tile_id, (abs(a.probs[1] - b.probs[1]) + abs(a.probs[2] - b.probs[2])) / 2 AS g FROM q a JOIN q b ON a.tile_id = b.tile_id AND a.y = b.y AND a.x = b.x + 1)
SELECT t.tile_id, round(coalesce((SELECT avg(g) FROM u WHERE u.tile_id = t.tile_id), 0) + coalesce((SELECT avg(g) FROM l WHERE l.tile_id = t.tile_id), 0), 9) AS smoothness FROM (SELECT DISTINCT tile_id FROM q) t""")
def smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("i", F.floor(F.col("pixel") / 20))
    return rounded(filters.smoothness(s.select("tile_id", F.floor(F.col("i") / 5).alias("y"), (F.col("i") % 5).alias("x"), "probs")))


@query()
def pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.features(pixels(spark, sf_dir)), 6)


# Samples and models


@query(f"""WITH {PX}, r AS (SELECT *, row_number() OVER (PARTITION BY tile_id, target ORDER BY md5('7:' || tile_id || ':' || target || ':' || y || ':' || x), y, x) AS k, count(*) OVER (PARTITION BY tile_id, target) AS n FROM px) SELECT tile_id, y, x, target, round(n / least(n, 10), 9) AS weight FROM r WHERE k <= 10""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.stratified_sample(pixels(spark, sf_dir), 10, 7).select("tile_id", "y", "x", "target", "weight"))


@query("""WITH r AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY md5('42:' || s_suppkey), s_suppkey) AS k, count(*) OVER () AS t FROM supplier) SELECT id, CASE WHEN k <= greatest(1, round(t * 0.1::DOUBLE)) THEN 'test' WHEN k <= 2 * greatest(1, round(t * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_split(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query()
def forest_group_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve features of sampled gate pixels, and forests of default size, each without one series."""
    px = pixels(spark, sf_dir).join(splits(spark, sf_dir).select("tile_id", "series"), "tile_id")
    rows = sampling.assemble_samples(px, 5, 20260821).drop("v").join(compare.features(px).where("v < 100"), ["tile_id", "y", "x"])
    _, means = sampling.group_cv(rows, "series", compare.FEATURES)
    return rounded(means)


@query()
def forest_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of the training tiles' samples, its classes inside the gate of the test tiles, and their confusion."""
    px = pixels(spark, sf_dir).join(splits(spark, sf_dir).select("tile_id", "split"), "tile_id")
    train = px.where("split = 'train'")
    rows = sampling.assemble_samples(train, 10, 20260821).drop("v").join(compare.features(train).where("v < 100"), ["tile_id", "y", "x"])
    model = sampling.fit_forest(rows, compare.FEATURES)
    rated = sampling.predict_gated(model, compare.features(px.where("split = 'test'"), keep=["target"]))
    return metrics.confusion(rated)


# Augmentation


@query()
def symmetries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.augment_symmetry(pixels(spark, sf_dir), 3).select("tile_id", "y", "x", "v", "target")


@query()
def grid_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.grid_mask(pixels(spark, sf_dir), 4, 0.3, 11).select("tile_id", "y", "x", "v", "masked")


@query()
def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.mosaic(pixels(spark, sf_dir), 16, 5)


@query()
def mixed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(augment.mixup(pixels(spark, sf_dir), 5, 0.6, 0).drop("lam"))


@query()
def cut_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.cutmix(pixels(spark, sf_dir), 5, 0.6).drop("lam")


@query()
def beta_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each pair from the arcsine law."""
    return rounded(augment.mixup(pixels(spark, sf_dir), 5, alpha=0.5), 6)


@query()
def copy_pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.copy_paste(pixels(spark, sf_dir), 5).select("tile_id", "y", "x", "v", "target", "pasted")


# Row expressions


@query(f"""WITH {SC} SELECT pixel, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred, CAST(floor(probs[1] * 255 + 0.5::DOUBLE) AS INTEGER) AS q, CAST(CASE WHEN list_position(probs, list_max(probs)) - 1 = target THEN 0 ELSE target + 1 END AS INTEGER) AS error, abs(probs[1] + probs[2] + probs[3] - 1) <= 2e-6 AS fine,
  CASE WHEN abs(probs[1] - probs[2]) <= 1e-15 THEN 'tie' WHEN probs[1] < probs[2] THEN 'C0' ELSE 'C1' END AS worst FROM sc""")
def probability_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("pred", argmax_class(F.col("probs")))
    p: Column = F.col("probs")
    return s.select("pixel", "pred", quantise(F.get(p, F.lit(0))).alias("q"), error_category(F.col("target"), F.col("pred")).alias("error"), check_probs(p).alias("fine"), worst_class(F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("worst"))


@query(f"WITH {PX} SELECT tile_id, round(avg((v / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE), 9) AS mean, CAST(round(100.0::DOUBLE * count(*) FILTER (v < 100) / count(*), 4) AS DOUBLE) AS dark FROM px GROUP BY 1")
def normalised_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pixels(spark, sf_dir).groupBy("tile_id").agg(F.avg(normalise(F.col("v"))).alias("mean"), F.count_if(gate(F.col("v"))).alias("d"), F.count("*").alias("n"))
    return g.select("tile_id", F.round("mean", 9).alias("mean"), pct(F.col("d"), F.col("n"), 4).cast("double").alias("dark"))


# More of the counting, pairing and governance operators


@query(f"WITH {PX} SELECT target AS class_id, count(*) AS pixels, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM px GROUP BY 1")
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.prevalence(pixels(spark, sf_dir)))


@query(f"WITH {PX}, {CM} SELECT tile_id, CAST(true_id = 2 AS INTEGER) AS true_id, CAST(pred_id = 2 AS INTEGER) AS pred_id, CAST(sum(n) AS BIGINT) AS n FROM cm GROUP BY ALL")
def merged_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.merge_classes(metrics.confusion(pixels(spark, sf_dir)), metrics.PORE_VS_MINERAL)


@query(f"WITH {METRICS_SQL}, w AS (SELECT *, support / (sum(support) OVER (PARTITION BY tile_id) + 1e-8) AS w FROM (SELECT tile_id, support, tp / (tp + fp + fn + 1e-8) AS iou FROM k)) SELECT tile_id, round(sum(w * iou), 9) AS frequency_iou, round(avg(iou), 9) AS mean_iou FROM w GROUP BY 1")
def frequency_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.frequency_weighted(metrics.class_metrics(metrics.confusion(pixels(spark, sf_dir)), undefined="eps")))


@query(f"WITH {PX}, {SPLITS}, p AS (SELECT series, target AS t, pred AS q FROM px JOIN splits USING (tile_id)), i AS (SELECT series, class_id, coalesce(count(*) FILTER (t = class_id AND q = class_id) / nullif(count(*) FILTER (t = class_id OR q = class_id), 0), 0) AS v FROM p, (SELECT unnest([0, 1]) AS class_id) GROUP BY ALL), g AS (SELECT series, max(v) FILTER (class_id = 0) AS a, max(v) FILTER (class_id = 1) AS b FROM i GROUP BY 1) SELECT round(avg(a), 9) AS c0_iou, round(avg(b), 9) AS c1_iou, round(avg(2 * a * b / (a + b + 1e-8)), 9) AS harmonic_iou, count(*) AS groups FROM g")
def series_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cm = metrics.confusion(pixels(spark, sf_dir)).join(splits(spark, sf_dir).select("tile_id", "series"), "tile_id")
    return rounded(metrics.group_metrics(cm, "series"))


@query("SELECT c_custkey, ordinal FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders)")
def order_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return integers(selection.ordinal(o, ["o_orderdate", "o_orderkey"], ["c_custkey"]), ["ordinal"]).select("c_custkey", "ordinal")


@query("SELECT o_custkey AS k, CAST(min(o_orderkey % 7) AS BIGINT) AS least, CAST(max(o_orderkey % 7) AS BIGINT) AS most, count(*) AS n FROM orders GROUP BY 1 HAVING min(o_orderkey % 7) <> 1 OR max(o_orderkey % 7) <> count(*) OR count(DISTINCT o_orderkey % 7) <> count(*)")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 7).alias("ordinal"))
    return selection.check_contiguous(o, ["k"])


@query("WITH s AS (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS k, count(*) OVER () AS t FROM supplier) SELECT s_name FROM s WHERE t <= 5 OR k IN (SELECT floor(i * (t - 1) / 4.0::DOUBLE) FROM range(5) r(i))")
def spread_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.spread_sample(table(spark, sf_dir, "supplier").select("s_name"), 5, "s_name")


@query("""WITH n AS (SELECT p_name || ' ' || p_partkey AS k, p_partkey FROM part WHERE p_name LIKE 's%' OR p_name LIKE 'l%'), a AS (SELECT k FROM n WHERE p_partkey % 2 = 0), b AS (SELECT k FROM n WHERE p_partkey % 3 = 0)
SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'mask only' ELSE 'file only' END AS finding FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
UNION ALL SELECT '*', 'count ' || n FROM (SELECT count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b)) WHERE n <> 7""")
def held_out_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), "p_partkey")
    return pairing.discover(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"), ["s", "l"], 7)


@query("SELECT page_id AS path, sha256(html) AS a_sha256, sha256(html || 'x') AS b_sha256 FROM pages WHERE page_id % 9 = 0 AND html IS NOT NULL")
def byte_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    b = p.withColumn("content", F.when(F.col("path") % 9 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return audit.diff_bytes(p, b)


@query("""SELECT p_partkey AS k, 'p_size' AS "column", 'not positive' AS finding FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, 'p_discount', 'not unit' FROM part WHERE p_retailprice / 1000 NOT BETWEEN 0 AND 1""")
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 7).alias("p_size"), (F.col("p_retailprice") / 1000).alias("p_discount"), F.col("p_name"))
    return audit.check_records(p, {"p_size": "positive", "p_discount": "unit", "p_name": "text"}, "k")


@query("""SELECT p_brand, p_type, count(*) AS copies, sha256('{"p_brand":' || to_json(p_brand) || ',"p_type":' || to_json(p_type) || '}') AS identity FROM part GROUP BY 1, 2""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return audit.dedupe_by_identity(p, ["p_partkey"])


@query("""WITH p AS (SELECT CASE page_id % 11 WHEN 3 THEN '../' WHEN 5 THEN '/' ELSE '' END || regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 4 = 1 THEN '.PDF' ELSE '' END AS path FROM pages)
SELECT path, 'forbidden path' AS finding FROM p WHERE path LIKE '%/fr/%' UNION ALL SELECT path, 'diagnostic asset' FROM p WHERE path LIKE 'm.%' OR path LIKE '%page=%'
UNION ALL SELECT path, 'misplaced PDF' FROM p WHERE lower(path) LIKE '%.pdf' AND NOT starts_with(path, 'docs/')
UNION ALL SELECT path, 'unsafe path' FROM p WHERE path LIKE '../%' OR path LIKE '/%' OR path LIKE '%//%' OR path LIKE '%/'""")
def path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as relative paths, some of them made unsafe or into PDFs; most are clean."""
    start = F.when(F.col("page_id") % 11 == 3, "../").when(F.col("page_id") % 11 == 5, "/").otherwise("")
    end = F.when(F.col("page_id") % 4 == 1, ".PDF").otherwise("")
    p = table(spark, sf_dir, "pages").select(F.concat(start, F.regexp_replace("url", "^[a-z]+://", ""), end).alias("path"))
    return audit.audit_paths(p, ["*/fr/*"], ["m.*", "*page=*"], "docs")


@query("SELECT o_orderpriority AS candidate, count(*) FILTER (o_orderstatus = 'F') AS successes, count(*) FILTER (o_orderstatus <> 'F') AS failures, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (o_orderstatus <> 'F') AS failed_seeds FROM orders GROUP BY 1")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("candidate"), F.col("o_orderkey").alias("seed"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure").alias("outcome"))
    return selection.outcome_summary(o).withColumn("failed_seeds", F.array_join(F.transform("failed_seeds", lambda k: k.cast("string")), ","))


@query()
def boundary_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distance.boundary_weights(pixels(spark, sf_dir)).select("tile_id", "y", "x", "boundary_weight", "band"))


@query()
def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return rounded(compare.curriculum(px.select("tile_id").distinct(), compare.difficulty(px), 20, 60))
