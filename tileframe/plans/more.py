"""SQL for raster queries that plans.queries registers without, and queries of operators that it has none for."""

from __future__ import annotations

from tileframe.operators.raster.filters import gaussian_kernel
from tileframe.plans.queries import BOUNDARY, DRAWS, ORACLES, PX, SEEDED, SPLITS

# Windows in SQL: each pixel meets the taps of a kernel; places are reflected with a period of two lines.

FLAT = "p AS (SELECT tile_id, y, x, CAST(v AS DOUBLE) AS v, v / 255.0::DOUBLE AS g, CAST(v < 100 AS DOUBLE) AS dark, count(*) OVER (PARTITION BY tile_id, y) AS nx, count(*) OVER (PARTITION BY tile_id, x) AS ny FROM px)"


def fold(place: str, n: str) -> str:
    m = f"((({place}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"least({m}, 2 * {n} - 1 - {m})"


def conv(name: str, value: str, kx: list[float], ky: list[float]) -> str:
    """CTEs that end in ``name`` (tile_id, y, x, r): the value filtered along rows, then columns."""
    def taps(kernel: list[float]) -> str:
        r = len(kernel) // 2
        return f"(SELECT unnest({list(range(-r, r + 1))}) AS d, unnest({[float(w) for w in kernel]}::DOUBLE[]) AS w)"

    return f"""{name}_x AS (SELECT a.tile_id, a.y, a.x, a.ny, sum(a.w * b.{value}) AS r FROM (SELECT tile_id, y, x, ny, w, {fold('x + d', 'nx')} AS s FROM p, {taps(kx)}) a JOIN p b ON b.tile_id = a.tile_id AND b.y = a.y AND b.x = a.s GROUP BY ALL),
{name} AS (SELECT a.tile_id, a.y, a.x, sum(a.w * b.r) AS r FROM (SELECT tile_id, y, x, w, {fold('y + d', 'ny')} AS s FROM {name}_x, {taps(ky)}) a JOIN {name}_x b ON b.tile_id = a.tile_id AND b.x = a.x AND b.y = a.s GROUP BY ALL)"""


G1, G3, D1 = gaussian_kernel(1.0), gaussian_kernel(3.0), gaussian_kernel(1.0, 2)
STEP, SMOOTH = [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]


def box(n: int) -> list[float]:
    return [1 / n] * n


ORACLES["gaussian_filter"] = f"WITH {PX}, {FLAT}, {conv('c', 'v', G1, G1)} SELECT tile_id, y, x, round(r, 6) AS v FROM c"
SOBEL = f"{conv('gx', 'v', STEP, SMOOTH)}, {conv('gy', 'v', SMOOTH, STEP)}"
ORACLES["sobel"] = f"WITH {PX}, {FLAT}, {SOBEL} SELECT gx.tile_id, gx.y, gx.x, round(sqrt(gx.r ** 2 + gy.r ** 2), 6) AS sobel FROM gx JOIN gy USING (tile_id, y, x)"


def flood(name: str, mask: str, four: bool = False) -> str:
    """CTEs that end in ``name`` (tile_id, y, x, region_id): the least key of the pixels of the mask that are connected."""
    near = "abs(b.y - a.k // 16777216) + abs(b.x - a.k % 16777216) <= 1" if four else "abs(b.y - a.k // 16777216) <= 1 AND abs(b.x - a.k % 16777216) <= 1"
    return f"""{name}_on AS (SELECT tile_id, y, x, y * 16777216 + x AS k FROM px WHERE {mask}),
{name}_f AS (SELECT tile_id, k, k AS l FROM {name}_on UNION SELECT b.tile_id, b.k, a.l FROM {name}_f a JOIN {name}_on b ON a.tile_id = b.tile_id AND {near} AND a.l < b.k),
{name} AS (SELECT tile_id, CAST(k // 16777216 AS INTEGER) AS y, CAST(k % 16777216 AS INTEGER) AS x, min(l) AS region_id FROM {name}_f GROUP BY ALL)"""


ORACLES["pixel_features"] = f"""WITH RECURSIVE {PX}, {flood('reg', 'v < 100')}, {FLAT}, {conv('a1', 'g', G1, G1)}, {conv('a3', 'g', G3, G3)}, {conv('m7', 'g', box(7), box(7))}, {conv('m31', 'g', box(31), box(31))}, {conv('gx', 'g', STEP, SMOOTH)}, {conv('gy', 'g', SMOOTH, STEP)},
{conv('l1', 'g', D1, G1)}, {conv('l2', 'g', G1, D1)}, {conv('dk', 'dark', box(15), box(15))}, sq AS (SELECT tile_id, y, x, nx, ny, g * g AS q FROM p), {conv('q7', 'q', box(7), box(7)).replace('FROM p,', 'FROM sq,').replace('JOIN p b', 'JOIN sq b')}, {conv('q31', 'q', box(31), box(31)).replace('FROM p,', 'FROM sq,').replace('JOIN p b', 'JOIN sq b')},
ds AS (SELECT a.tile_id, a.y, a.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM (SELECT * FROM px WHERE v < 100) a LEFT JOIN (SELECT * FROM px WHERE v >= 100) b ON a.tile_id = b.tile_id GROUP BY a.tile_id, a.y, a.x),
ar AS (SELECT tile_id, y, x, count(*) OVER (PARTITION BY tile_id, region_id) AS a FROM reg), sz AS (SELECT tile_id, count(*) AS n, sqrt((max(y) + 1) ** 2 + (max(x) + 1) ** 2) AS dg FROM px GROUP BY 1)
SELECT px.tile_id, px.y, px.x, px.v, round(px.v / 255.0::DOUBLE, 6) AS gray, round(a1.r, 6) AS gaussian_1, round(a3.r, 6) AS gaussian_3, round(m7.r, 6) AS mean_7, round(sqrt(greatest(q7.r - m7.r ** 2, 0)), 6) AS std_7, round(m31.r, 6) AS mean_31, round(sqrt(greatest(q31.r - m31.r ** 2, 0)), 6) AS std_31,
  round(sqrt(gx.r ** 2 + gy.r ** 2), 6) AS sobel, round(l1.r + l2.r, 6) AS log_1, round(ln(1 + CASE WHEN px.v >= 100 THEN 0 ELSE coalesce(ds.d, dg) END) / ln(1 + dg), 6) AS distance, round(dk.r, 6) AS dark_15, round(coalesce(ln(1 + ar.a) / ln(1 + n), 0), 6) AS area
FROM px JOIN a1 USING (tile_id, y, x) JOIN a3 USING (tile_id, y, x) JOIN m7 USING (tile_id, y, x) JOIN q7 USING (tile_id, y, x) JOIN m31 USING (tile_id, y, x) JOIN q31 USING (tile_id, y, x) JOIN gx USING (tile_id, y, x) JOIN gy USING (tile_id, y, x)
  JOIN l1 USING (tile_id, y, x) JOIN l2 USING (tile_id, y, x) JOIN dk USING (tile_id, y, x) JOIN sz USING (tile_id) LEFT JOIN ds USING (tile_id, y, x) LEFT JOIN ar USING (tile_id, y, x)"""

ORACLES["stitched_values"] = f"""WITH {PX}, t AS (SELECT tile_id, max(y) + 1 AS h FROM px GROUP BY 1), yy AS (SELECT tile_id, y0, row_number() OVER (PARTITION BY tile_id ORDER BY y0) - 1 AS r FROM (SELECT tile_id, unnest(list_distinct(list_append(range(0, h - 10 + 1, 7), h - 10))) AS y0 FROM t)),
xx AS (SELECT x0, row_number() OVER (ORDER BY x0) - 1 AS c FROM (SELECT unnest([0, 7, 14]) AS x0)) SELECT px.tile_id, y, x, CAST(max(r * 1000 + c) AS INTEGER) AS value FROM px JOIN yy ON yy.tile_id = px.tile_id AND y >= y0 AND y < y0 + 10 JOIN xx ON x >= x0 AND x < x0 + 10 GROUP BY ALL"""

ORACLES["ring_insides"] = f"""WITH RECURSIVE {PX}, {flood('reg', 'v >= 130', True)}, e AS (SELECT *, y IN (min(y) OVER w, max(y) OVER w) OR x IN (min(x) OVER w, max(x) OVER w) AS edge FROM px WINDOW w AS (PARTITION BY tile_id)),
o AS (SELECT tile_id, region_id FROM reg JOIN e USING (tile_id, y, x) GROUP BY 1, 2 HAVING NOT bool_or(edge)), i AS (SELECT tile_id, y, x FROM reg SEMI JOIN o USING (tile_id, region_id))
SELECT px.tile_id, px.y, px.x, i.y IS NOT NULL AS inside, CASE WHEN v < 100 AND i.y IS NULL THEN 1 WHEN v < 100 THEN 0 ELSE 2 END AS pred FROM px LEFT JOIN i ON i.tile_id = px.tile_id AND i.y = px.y AND i.x = px.x"""


def boundary_sql(mask: str) -> str:
    """BOUNDARY with another class: pixels of ``mask`` of which the 3 x 3 square isn't whole."""
    return BOUNDARY.replace("target < 2 AS t, pred < 2 AS p", f"target {mask} AS t, pred {mask} AS p")


F1 = """CASE WHEN bp = 0 AND bt = 0 THEN 1.0 WHEN bp = 0 THEN 0.0 ELSE bph / CAST(bp AS DOUBLE) END AS pr, CASE WHEN bp = 0 AND bt = 0 THEN 1.0 WHEN bt = 0 THEN 0.0 ELSE bth / CAST(bt AS DOUBLE) END AS re"""
COUNTS = "cb AS (SELECT tile_id, count(*) FILTER (bp) AS bp, count(*) FILTER (bp AND nt) AS bph, count(*) FILTER (bt) AS bt, count(*) FILTER (bt AND np) AS bth FROM b2 GROUP BY 1)"
ORACLES["boundary_f1"] = f"""WITH {boundary_sql('= 0')}, {COUNTS}, d AS (SELECT *, {F1} FROM cb) SELECT tile_id, bp AS boundary_pred, bph AS boundary_pred_hit, bt AS boundary_true, bth AS boundary_true_hit, round(pr, 9) AS "precision", round(re, 9) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1 FROM d"""
ORACLES["hausdorff"] = f"""WITH {boundary_sql('= 1')}, d AS (SELECT a.tile_id, 'p' AS side, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM (SELECT * FROM b1 WHERE bp) a JOIN (SELECT * FROM b1 WHERE bt) b USING (tile_id) GROUP BY a.tile_id, a.y, a.x
UNION ALL SELECT a.tile_id, 't', sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) FROM (SELECT * FROM b1 WHERE bt) a JOIN (SELECT * FROM b1 WHERE bp) b USING (tile_id) GROUP BY a.tile_id, a.y, a.x),
q AS (SELECT tile_id, quantile_cont(d, 0.95) AS q FROM d GROUP BY tile_id, side) SELECT t.tile_id, round(coalesce(max(q), 0), 9) AS hausdorff FROM (SELECT DISTINCT tile_id FROM px) t LEFT JOIN q USING (tile_id) GROUP BY 1"""
ORACLES["boundary_weights"] = f"""WITH {PX}, s AS (SELECT a.tile_id, a.y, a.x, a.target < 2 AND count(*) FILTER (b.target < 2) < 9 AS edge, bool_or(b.target < 2) AND bool_or(b.target = 2) AS band FROM px a JOIN px b ON a.tile_id = b.tile_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.tile_id, a.y, a.x, a.target),
d AS (SELECT a.tile_id, a.y, a.x, a.band, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM s a LEFT JOIN (SELECT * FROM s WHERE edge) b ON a.tile_id = b.tile_id AND abs(a.y - b.y) <= 5 AND abs(a.x - b.x) <= 5 GROUP BY ALL)
SELECT tile_id, y, x, round(CASE WHEN d <= 5 THEN 3 - 2 * d / 5 ELSE 1 END, 9) AS boundary_weight, band FROM d"""
SIZES = "(SELECT tile_id, count(*) AS a FROM {0} GROUP BY tile_id, region_id)"
ORACLES["tile_diagnostics"] = f"""WITH RECURSIVE {boundary_sql('< 2')}, {COUNTS}, {flood('t0', 'target = 0')}, {flood('p0', 'pred = 0')}, {flood('t1', 'target = 1')}, {flood('p1', 'pred = 1')},
n AS (SELECT tile_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (target = 0) AS a0, count(*) FILTER (pred = 0) AS b0, count(*) FILTER (target = 1) AS a1, count(*) FILTER (pred = 1) AS b1 FROM px GROUP BY 1),
c AS (SELECT n.*, coalesce((SELECT count(*) FROM {SIZES.format('t0')} s WHERE s.tile_id = n.tile_id), 0) AS ct, coalesce((SELECT count(*) FROM {SIZES.format('p0')} s WHERE s.tile_id = n.tile_id), 0) AS cp, coalesce((SELECT max(a) FROM {SIZES.format('t1')} s WHERE s.tile_id = n.tile_id), 0) AS lt, coalesce((SELECT max(a) FROM {SIZES.format('p1')} s WHERE s.tile_id = n.tile_id), 0) AS lp FROM n),
d AS (SELECT tile_id, (b0 - a0) / n AS e0, (b1 - a1) / n AS e1, lp / nullif(CAST(b1 AS DOUBLE), 0) - lt / nullif(CAST(a1 AS DOUBLE), 0) AS el, (cp - ct) * 1e6 / n AS em FROM c), f AS (SELECT tile_id, {F1} FROM cb)
SELECT tile_id, round(e0, 9) AS c0_area_error, round(abs(e0), 9) AS c0_area_abs_error, round(e1, 9) AS c1_area_error, round(abs(e1), 9) AS c1_area_abs_error, round(el, 9) AS largest_share_error, round(abs(el), 9) AS largest_share_abs_error, round(em, 9) AS per_megapixel_error, round(abs(em), 9) AS per_megapixel_abs_error,
  round(pr, 9) AS boundary_precision, round(re, 9) AS boundary_recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS boundary_f1 FROM d JOIN f USING (tile_id)"""
ORACLES["region_annotations"] = f"""WITH RECURSIVE {PX}, {flood('r0', 'target = 0')}, {flood('r1', 'target = 1')}, r AS (SELECT 0 AS c, * FROM r0 UNION ALL SELECT 1, * FROM r1),
b AS (SELECT *, x - lag(x) OVER (PARTITION BY tile_id, c, region_id, y ORDER BY x) AS gap FROM r),
s AS (SELECT tile_id, c, region_id, count(*) AS area, min(y) AS ya, max(y) AS yb, min(x) AS xa, max(x) AS xb, count(*) FILTER (gap IS NULL OR gap > 1) AS runs FROM b GROUP BY ALL HAVING count(*) >= 4)
SELECT tile_id, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY c, region_id) AS INTEGER) AS annotation_id, c AS category_id, area, '[' || xa || ',' || ya || ',' || (xb - xa + 1) || ',' || (yb - ya + 1) || ']' AS bbox, CAST(runs AS INTEGER) AS n_runs FROM s"""
ORACLES["cutoff_sweep"] = f"""WITH RECURSIVE {PX}, {SPLITS}, {flood('reg', 'v < 100')}, ar AS (SELECT tile_id, y, x, count(*) OVER (PARTITION BY tile_id, region_id) AS a FROM reg), k AS (SELECT unnest([25, 50, 100, 200, 300, 500, 1000]) AS cutoff),
m AS (SELECT cutoff, series, target, CASE WHEN v >= 100 THEN 2 WHEN a < cutoff THEN 0 ELSE 1 END AS pred, count(*) AS n FROM px JOIN splits USING (tile_id) LEFT JOIN ar USING (tile_id, y, x), k GROUP BY ALL),
i AS (SELECT cutoff, series, coalesce(sum(n) FILTER (target = 0 AND pred = 0) / nullif(sum(n) FILTER (target = 0 OR pred = 0), 0), 0) AS i0, coalesce(sum(n) FILTER (target = 1 AND pred = 1) / nullif(sum(n) FILTER (target = 1 OR pred = 1), 0), 0) AS i1 FROM m GROUP BY 1, 2),
g AS (SELECT cutoff, avg(i0) AS c0, avg(i1) AS c1, avg(2 * i0 * i1 / (i0 + i1 + 1e-8)) AS h, count(*) AS groups FROM i GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY h DESC, least(c0, c1) DESC, cutoff) AS rank FROM g)
SELECT cutoff, round(c0, 9) AS c0_iou, round(c1, 9) AS c1_iou, round(h, 9) AS harmonic_iou, groups, CAST(rank AS INTEGER) AS rank, rank = 1 AS selected FROM r"""


def draw_sql(*parts: str) -> str:
    """A uniform number of a seed and columns, by their MD5."""
    return f"(CAST('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


EXTENT = "e AS (SELECT tile_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY 1)"
ORACLES["symmetries"] = f"""WITH {PX}, {EXTENT}, k AS (SELECT px.*, h, w, CAST(floor({draw_sql("'3'", 'tile_id')} * 8) AS INTEGER) AS k FROM px JOIN e USING (tile_id)),
t AS (SELECT *, CASE k // 2 WHEN 0 THEN y WHEN 1 THEN w - 1 - x WHEN 2 THEN h - 1 - y ELSE x END AS ty, CASE k // 2 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN w - 1 - x ELSE h - 1 - y END AS tx, CASE WHEN (k // 2) % 2 = 1 THEN h ELSE w END AS tw FROM k)
SELECT tile_id, CAST(ty AS INTEGER) AS y, CAST(CASE WHEN k % 2 = 1 THEN tw - 1 - tx ELSE tx END AS INTEGER) AS x, v, target FROM t"""
ORACLES["grid_masked"] = f"""WITH {PX}, c AS (SELECT *, y // 4 AS cy, x // 4 AS cx FROM px), r AS (SELECT *, max(CAST(target = 0 AS INTEGER)) OVER (PARTITION BY tile_id, cy, cx) AS rare, {draw_sql("'11'", 'tile_id', 'cy', 'cx')} < 0.3::DOUBLE AS gone FROM c)
SELECT tile_id, y, x, CASE WHEN gone AND rare = 0 THEN 0 ELSE v END AS v, gone AND rare = 0 AS masked FROM r"""
PAIRED = f"""{PX}, {EXTENT}, o AS (SELECT *, {draw_sql("'5'", 'tile_id')} AS d FROM e), n AS (SELECT tile_id, h, w, coalesce(lead(tile_id) OVER g, first_value(tile_id) OVER g) AS other FROM o WINDOW g AS (PARTITION BY h, w ORDER BY d, tile_id)),
j AS (SELECT a.*, n.other, n.h, n.w, coalesce(b.v, a.v) AS v2, coalesce(b.target, a.target) AS t2 FROM px a JOIN n USING (tile_id) LEFT JOIN px b ON b.tile_id = n.other AND b.y = a.y AND b.x = a.x)"""
ORACLES["mixed_up"] = f"""WITH {PAIRED} SELECT tile_id, other, y, x, round(CASE WHEN target = 0 THEN CAST(v AS DOUBLE) WHEN t2 = 0 THEN CAST(v2 AS DOUBLE) ELSE 0.6::DOUBLE * v + (1 - 0.6::DOUBLE) * v2 END, 9) AS v, CASE WHEN target = 0 OR t2 = 0 THEN 0 ELSE target END AS target FROM j"""
ORACLES["beta_mixed"] = f"""WITH {PAIRED}, q AS (SELECT *, sin(pi() / 2 * {draw_sql("'5'", "'lam'", 'tile_id')}) ** 2 AS lam FROM j)
SELECT tile_id, other, y, x, round(lam * v + (1 - lam) * v2, 6) AS v, CASE WHEN lam > 0.5 THEN target ELSE t2 END AS target, round(lam, 6) AS lam FROM q"""
ORACLES["cut_mixed"] = f"""WITH {PAIRED}, r AS (SELECT *, floor(h * sqrt(1 - 0.6::DOUBLE)) AS rh, floor(w * sqrt(1 - 0.6::DOUBLE)) AS rw FROM j), q AS (SELECT *, floor({draw_sql("'5'", "'y'", 'tile_id')} * (h - rh + 1)) AS y0, floor({draw_sql("'5'", "'x'", 'tile_id')} * (w - rw + 1)) AS x0 FROM r),
i AS (SELECT *, y >= y0 AND y < y0 + rh AND x >= x0 AND x < x0 + rw AS inside FROM q) SELECT tile_id, other, y, x, CASE WHEN inside THEN v2 ELSE v END AS v, CASE WHEN inside THEN t2 ELSE target END AS target FROM i"""
ORACLES["smart_crop"] = f"""WITH {PX}, {EXTENT}, s AS (SELECT tile_id, y0, x0 FROM (SELECT *, unnest(range(0, h - 8 + 1, 2)) AS y0 FROM e WHERE h >= 8 AND w >= 8), (SELECT unnest(range(0, 24, 2)) AS x0) WHERE x0 <= w - 8),
r AS (SELECT s.tile_id, s.y0, s.x0, count(*) FILTER (target = 0) / 64.0::DOUBLE AS ratio FROM s JOIN px ON px.tile_id = s.tile_id AND y >= y0 AND y < y0 + 8 AND x >= x0 AND x < x0 + 8 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ratio DESC, y0, x0) AS b, row_number() OVER (PARTITION BY tile_id ORDER BY md5(tile_id || chr(58) || y0 || chr(58) || x0)) AS d, max(ratio) OVER (PARTITION BY tile_id) AS m FROM r)
SELECT tile_id, CAST(y0 AS INTEGER) AS y0, CAST(x0 AS INTEGER) AS x0, round(ratio, 9) AS ratio FROM k WHERE CASE WHEN m >= 0.2 THEN b ELSE d END = 1"""
DIFFICULTY = f"""{PX}, {flood('reg', 'target = 0')}, gr AS (SELECT tile_id, y, x, target, lag(target) OVER v AS u, lead(target) OVER v AS d, lag(target) OVER h AS l, lead(target) OVER h AS r FROM px WINDOW v AS (PARTITION BY tile_id, x ORDER BY y), h AS (PARTITION BY tile_id, y ORDER BY x)),
s AS (SELECT tile_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (target = 0) AS c0, count(*) FILTER (target = 1) AS c1, count(*) FILTER (target = 2) AS c2, count(*) FILTER (coalesce(d, target) <> coalesce(u, target) OR coalesce(r, target) <> coalesce(l, target)) AS g FROM gr GROUP BY 1),
f AS (SELECT tile_id, count(*) FILTER (a < 100) / CAST(count(*) AS DOUBLE) AS few FROM (SELECT tile_id, count(*) AS a FROM reg GROUP BY tile_id, region_id) GROUP BY 1),
df AS (SELECT tile_id, (c0 + c1) / n AS pd, CASE WHEN c0 > 0 AND c1 > 0 AND c2 > 0 THEN 3 * list_stddev_pop([c0 / n, c1 / n, c2 / n]) ELSE 1 END AS ci, coalesce(c0 / nullif(CAST(c0 + c1 AS DOUBLE), 0), 0) AS dr, g / n AS bc, coalesce(few, 0) AS sc FROM s LEFT JOIN f USING (tile_id)),
dd AS (SELECT *, greatest(0, least(1, 0.15::DOUBLE * pd + 0.25::DOUBLE * ci + 0.2::DOUBLE * dr + 0.2::DOUBLE * bc + 0.2::DOUBLE * sc)) AS dif FROM df)"""
ORACLES["difficulty"] = f"WITH RECURSIVE {DIFFICULTY} SELECT tile_id, round(pd, 9) AS pore_density, round(ci, 9) AS class_imbalance, round(dr, 9) AS disconnected_ratio, round(bc, 9) AS boundary_complexity, round(sc, 9) AS small_component_ratio, round(dif, 9) AS difficulty FROM dd"
#: Epoch 20 of 60 with a warm-up of 5 is in the second of four stages, 15 / 55 of the way.
ORACLES["curriculum"] = f"WITH RECURSIVE {DIFFICULTY}, q AS (SELECT quantile_cont(dif, 0.6) AS q FROM dd) SELECT tile_id, round(dif, 9) AS difficulty, round(1 + dif * 15 / 55.0::DOUBLE, 9) AS weight FROM dd, q WHERE dif <= q"

ORACLES["json_audit"] = """SELECT CAST(event_id AS VARCHAR) AS key, 'duplicate key k' AS finding FROM events WHERE event_id % 50 = 0 UNION ALL SELECT CAST(event_id AS VARCHAR), CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'not JSON' ELSE 'root is not an object' END FROM events
WHERE event_id % 50 <> 0 AND (props IS NULL OR NOT json_valid(props) OR json_type(props) <> 'OBJECT')"""
ORACLES["paired_bootstrap"] = f"""WITH {SEEDED}, {DRAWS.replace("'77:'", "'19:'").replace('range(200)', 'range(100)')}, s AS (SELECT method_id, seed, rep, true_id, pred_id, sum(n * times) AS n FROM scm JOIN dr USING (tile) GROUP BY ALL),
k AS (SELECT method_id, seed, rep, class_id, CAST(sum(n) FILTER (true_id = class_id AND pred_id = class_id) AS DOUBLE) AS tp, CAST(sum(n) FILTER (true_id <> class_id AND pred_id = class_id) AS DOUBLE) AS fp, CAST(sum(n) FILTER (true_id = class_id AND pred_id <> class_id) AS DOUBLE) AS fn FROM s, (SELECT unnest([0, 1, 2]) AS class_id) GROUP BY ALL),
i AS (SELECT *, tp / nullif(tp + fp + fn, 0) AS iou FROM k), r AS (SELECT method_id, seed, rep, class_id, unnest(['iou', 'dice', 'precision', 'recall']) AS metric, unnest([iou, 2 * tp / nullif(2 * tp + fp + fn, 0), tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0)]) AS value FROM i
UNION ALL SELECT method_id, seed, rep, -1, unnest(['macro_iou', 'accuracy', 'harmonic_iou']), unnest([m, a, 2 * c0 * c1 / (c0 + c1 + 1e-8)]) FROM (SELECT method_id, seed, rep, avg(iou) AS m, sum(tp) / nullif(sum(tp + fn), 0) AS a, max(iou) FILTER (class_id = 0) AS c0, max(iou) FILTER (class_id = 1) AS c1 FROM i GROUP BY ALL)),
f AS (SELECT * FROM r WHERE method_id = 'A'), m AS (SELECT rep, class_id, metric, CASE WHEN count(*) = count(value) THEN avg(value) END AS ref FROM f GROUP BY ALL),
b AS (SELECT r.method_id, r.rep, r.class_id, r.metric, f.value - r.value AS d FROM r JOIN f ON r.method_id <> 'A' AND r.seed = f.seed AND r.rep = f.rep AND r.class_id = f.class_id AND r.metric = f.metric UNION ALL SELECT r.method_id, r.rep, r.class_id, r.metric, m.ref - r.value FROM r JOIN m ON r.seed IS NULL AND r.method_id <> 'A' AND r.rep = m.rep AND r.class_id = m.class_id AND r.metric = m.metric),
p AS (SELECT method_id, rep, class_id, metric, CASE WHEN count(*) = count(d) THEN avg(d) END AS d FROM b GROUP BY ALL)
SELECT method_id, class_id, metric, CASE WHEN count(d) = count(*) THEN round(quantile_cont(d, 0.025), 9) END AS low, CASE WHEN count(d) = count(*) THEN round(quantile_cont(d, 0.975), 9) END AS high, count(d) AS n_finite, count(*) AS n_reps FROM p GROUP BY ALL"""
ORACLES["topology_diff"] = f"""WITH RECURSIVE {PX}, {flood('tf', 'target = 1')}, {flood('tb', 'target <> 1')}, {flood('pf', 'pred = 1')}, {flood('pb', 'pred <> 1')},
s AS (SELECT 't' AS side, 'fg' AS kind, * FROM {SIZES.format('tf')} UNION ALL SELECT 't', 'bg', * FROM {SIZES.format('tb')} UNION ALL SELECT 'p', 'fg', * FROM {SIZES.format('pf')} UNION ALL SELECT 'p', 'bg', * FROM {SIZES.format('pb')}),
c AS (SELECT p.tile_id, count(*) FILTER (side = 't' AND kind = 'fg') AS nt, count(*) FILTER (side = 'p' AND kind = 'fg') AS np, count(*) FILTER (side = 't' AND kind = 'bg') AS bt, count(*) FILTER (side = 'p' AND kind = 'bg') AS bp FROM (SELECT DISTINCT tile_id FROM px) p LEFT JOIN s USING (tile_id) GROUP BY 1),
b AS (SELECT *, max(a) OVER (PARTITION BY tile_id) AS top, count(*) OVER (PARTITION BY tile_id, side) AS m FROM s WHERE kind = 'fg' AND a >= 2),
h AS (SELECT tile_id, least(floor(a * 19 / top), 18) AS bin, coalesce(sum(1 / (m * top / 19.0::DOUBLE)) FILTER (side = 't'), 0) AS t, coalesce(sum(1 / (m * top / 19.0::DOUBLE)) FILTER (side = 'p'), 0) AS p FROM b GROUP BY 1, 2),
e AS (SELECT tile_id, sum(abs(t - p)) AS l1, sum(t) AS st, sum(p) AS sp FROM h GROUP BY 1),
d AS (SELECT c.*, abs(np - nt) / greatest(nt, 1)::DOUBLE AS cd, CASE WHEN coalesce(st, 0) = 0 THEN 0 WHEN sp = 0 THEN 1 ELSE l1 END AS se FROM c LEFT JOIN e USING (tile_id))
SELECT tile_id, nt AS regions_true, np AS regions_pred, round(cd, 9) AS component_diff, round(se, 9) AS size_error, abs((np - bp) - (nt - bt)) AS euler_diff, round(cd + se, 9) AS connectivity_score FROM d"""
ORACLES["mosaics"] = f"""WITH {PX}, e AS (SELECT tile_id, max(y) + 1 AS h, max(x) + 1 AS w, count(*) FILTER (target = 0) AS m FROM px GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY substr(md5('5' || chr(58) || tile_id), 1, 12), tile_id) AS k, count(*) OVER () AS t FROM e),
g AS (SELECT *, (k - 1) // 4 AS mosaic_id FROM r UNION ALL SELECT *, (t - 1) // 4 FROM r WHERE t % 4 > 0 AND k <= 4 - t % 4 AND (t - 1) // 4 <> (k - 1) // 4),
q AS (SELECT *, row_number() OVER (PARTITION BY mosaic_id ORDER BY m DESC, tile_id) - 1 AS q FROM g),
o AS (SELECT q.*, oy, ox FROM q, range(8) a(oy), range(8) b(ox))
SELECT o.mosaic_id, CAST(oy + q // 2 * 8 AS INTEGER) AS y, CAST(ox + q % 2 * 8 AS INTEGER) AS x, o.tile_id, v, target FROM o JOIN px ON px.tile_id = o.tile_id AND px.y = oy * h // 8 AND px.x = ox * w // 8"""
ORACLES["copy_pasted"] = f"""WITH RECURSIVE {PX}, {EXTENT}, {flood('r0', 'target = 0')},
m AS (SELECT r.tile_id, r.region_id, p.v, r.y + CAST(floor(({draw_sql("'5'", "'y'", 'r.tile_id', 'r.region_id')} - 0.5::DOUBLE) * h) AS INTEGER) AS y, r.x + CAST(floor(({draw_sql("'5'", "'x'", 'r.tile_id', 'r.region_id')} - 0.5::DOUBLE) * w) AS INTEGER) AS x FROM r0 r JOIN e USING (tile_id) JOIN px p ON p.tile_id = r.tile_id AND p.y = r.y AND p.x = r.x),
b AS (SELECT DISTINCT m.tile_id, m.region_id FROM m LEFT JOIN px p ON p.tile_id = m.tile_id AND p.y = m.y AND p.x = m.x WHERE p.v IS NULL OR p.target = 0),
n AS (SELECT tile_id, y, x, arg_min(v, region_id) AS v FROM m ANTI JOIN b USING (tile_id, region_id) GROUP BY 1, 2, 3)
SELECT p.tile_id, p.y, p.x, coalesce(n.v, p.v) AS v, CASE WHEN n.v IS NULL THEN p.target ELSE 0 END AS target, n.v IS NOT NULL AS pasted FROM px p LEFT JOIN n ON n.tile_id = p.tile_id AND n.y = p.y AND n.x = p.x"""
