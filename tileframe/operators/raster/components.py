"""Connected regions: within a band of a tile's rows by union of row runs in one Arrow group, across bands by alternating stars over the regions that meet there."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.functions import GATE, MINERAL
from tileframe.operators.metrics import confusion, group_metrics
from tileframe.operators.selection import select_cutoff
from tileframe.operators.storage import materialise

#: Rows of a tile that are labelled in one group.
BAND = 1024
KEY_BITS = 24


def pixel_key(y: Column, x: Column) -> Column:
    return F.shiftleft(y.cast("bigint"), KEY_BITS).bitwiseOR(x.cast("bigint"))


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (least node reachable) for the nodes of edges a, b of any orderable type, by alternating large and small stars."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "stars")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"regions did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_runs(px: DataFrame, mask: str, within: Sequence[str] = ()) -> DataFrame:
    """The pixels of the mask with x0, where their horizontal run starts."""
    on = px.where(F.col(mask).cast("boolean"))
    w = Window.partitionBy("tile_id", *within, "y").orderBy("x")
    on = on.withColumn("_g", F.col("x") - F.row_number().over(w))
    return on.withColumn("x0", F.min("x").over(Window.partitionBy("tile_id", *within, "y", "_g"))).drop("_g")


def label_runs(y: np.ndarray, x: np.ndarray, reach: int) -> np.ndarray:
    """For each pixel, the least pixel key of its region. Runs of one row touch those of the next that overlap them within the reach."""
    order = np.lexsort([x, y])
    y, x = y[order].astype("int64"), x[order].astype("int64")
    begins = np.append(True, (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1)) if len(y) else np.empty(0, bool)
    first = np.flatnonzero(begins)
    row, x0, x1 = y[first], x[first], x[np.append(first[1:], len(y)) - 1]
    width = int(x.max(initial=0)) + 3
    low = np.searchsorted(row * width + x1, (row + 1) * width + x0 - reach)
    count = np.maximum(np.searchsorted(row * width + x0, (row + 1) * width + x1 + reach, "right") - low, 0)
    a = np.repeat(np.arange(len(first)), count)
    b = np.arange(len(a)) + np.repeat(low - (np.cumsum(count) - count), count)
    label = np.arange(len(first))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(y), "int64")
    out[order] = (row[label] << KEY_BITS | x0[label])[np.cumsum(begins) - 1]
    return out


def components(px: DataFrame, mask: str = "mask", connectivity: int = 8, within: Sequence[str] = ()) -> DataFrame:
    """The mask's pixels (those with coordinates) with region_id, the least pixel key of their region. ``within`` keeps regions apart by more columns, such as the class.

    A group holds at most BAND rows of a tile; tiles of more rows are put together along the seams.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    reach, names = (1 if connectivity == 8 else 0), ["tile_id", *within]
    on = px.where(F.col(mask).cast("boolean") & F.col("y").isNotNull() & F.col("x").isNotNull())

    def label(table: pa.Table) -> pa.Table:
        found = label_runs(table.column("y").to_numpy(), table.column("x").to_numpy(), reach)
        return table.drop_columns(["_band"]).append_column("region_id", pa.array(found))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in on.schema.fields)
    labelled = on.withColumn("_band", F.floor(F.col("y") / BAND)).groupBy(*names, "_band").applyInArrow(label, f"{fields}, region_id bigint")
    if on.where(F.col("y") >= BAND).isEmpty():
        return labelled
    labelled = materialise(labelled, "regions")
    node = lambda region: F.struct(*names, F.col(region).alias("key"))
    above = labelled.where(F.col("y") % BAND == BAND - 1).select(*names, (F.col("y") + 1).alias("y"), F.explode(F.sequence(F.col("x") - reach, F.col("x") + reach)).alias("x"), F.col("region_id").alias("_other"))
    below = labelled.where(F.col("y") % BAND == 0).select(*names, "y", "x", "region_id")
    edges = above.join(below, [*names, "y", "x"]).select(node("region_id").alias("a"), node("_other").alias("b")).distinct()
    roots = star_components(edges).select(*[F.col(f"node.{n}").alias(n) for n in names], F.col("node.key").alias("region_id"), F.col("root.key").alias("_root"))
    out = labelled.join(roots, [*names, "region_id"], "left").withColumn("region_id", F.coalesce("_root", "region_id")).drop("_root")
    return out.select(*labelled.columns)


def component_stats(c: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """area, bounding box and centroid of each region, and the tile's number of regions and largest area."""
    s = c.groupBy(*keys, "region_id").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    w = Window.partitionBy(*keys)
    return s.withColumns({"regions": F.count("*").over(w), "largest": F.max("area").over(w)})


def drop_small(c: DataFrame, n: int, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Without the regions of fewer than n pixels."""
    keep = c.groupBy(*keys, "region_id").agg(F.count("*").alias("_a")).where(F.col("_a") >= n).drop("_a")
    return c.join(keep, [*keys, "region_id"], "left_semi")


def with_area(px: DataFrame, regions: DataFrame) -> DataFrame:
    """All pixels with region_id and area (NULL outside regions)."""
    areas = regions.groupBy("tile_id", "region_id").agg(F.count("*").alias("area"))
    labelled = regions.select("tile_id", "y", "x", "region_id").join(areas, ["tile_id", "region_id"])
    return px.join(labelled, ["tile_id", "y", "x"], "left")


def area_rule(area: Column, inside: Column, cutoff: Column | int) -> Column:
    """0 in regions strictly below the cutoff, else 1; mineral outside the gate; a gated pixel without a region is an error."""
    unassigned = F.raise_error(F.lit("a gated pixel is unassigned")).cast("int")
    return F.when(~inside, F.lit(MINERAL)).when(area.isNull(), unassigned).when(area < cutoff, 0).otherwise(1)


def classify_by_area(px: DataFrame, cutoff: int, t: int = GATE) -> DataFrame:
    """px (with v) with pred by the region-size rule over 8-connected gate regions."""
    gated = px.withColumn("mask", F.col("v") < t)
    found = with_area(gated.drop("mask"), components(gated.select("tile_id", "y", "x", "mask")))
    return found.withColumn("pred", area_rule(F.col("area"), F.col("v") < t, cutoff))


def sweep_cutoffs(px: DataFrame, cutoffs: Sequence[int], series: DataFrame, t: int = GATE) -> DataFrame:
    """cutoff, mean IoUs over series, rank and selected. px has v and target; regions are counted before the cutoffs multiply them."""
    gated = px.withColumn("mask", F.col("v") < t)
    found = with_area(px, components(gated.select("tile_id", "y", "x", "mask"))).join(series.select("tile_id", "series"), "tile_id")
    # One row for each (series, area, class): all that a cutoff needs.
    counts = found.withColumn("inside", F.col("v") < t).groupBy("series", "inside", "area", "target").agg(F.count("*").alias("n"))
    each = counts.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs]))).withColumn("pred", area_rule(F.col("area"), F.col("inside"), F.col("cutoff")))
    cm = confusion(each, ["cutoff", "series"], weight="n")
    return select_cutoff(group_metrics(cm, "series", ["cutoff"]))


def inside_rings(px: DataFrame, ring: str = "ring") -> DataFrame:
    """Pixels with inside: those of 4-connected regions of the ring's complement that don't touch the tile's edge."""
    extent = Window.partitionBy("tile_id")
    p = px.withColumn("_m", ~F.col(ring).cast("boolean"))
    edge = (F.col("y") == F.min("y").over(extent)) | (F.col("y") == F.max("y").over(extent)) | (F.col("x") == F.min("x").over(extent)) | (F.col("x") == F.max("x").over(extent))
    p = p.withColumn("_edge", edge)
    c = components(p.select("tile_id", "y", "x", "_m", "_edge"), "_m", 4)
    closed = c.groupBy("tile_id", "region_id").agg(F.bool_or("_edge").alias("open")).where("not open")
    hit = c.join(closed, ["tile_id", "region_id"]).select("tile_id", "y", "x", F.lit(True).alias("_in"))
    return p.drop("_m", "_edge").join(hit, ["tile_id", "y", "x"], "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")


def classify_by_ring(px: DataFrame, t: int = GATE) -> DataFrame:
    """px with v and inside: gate outside rings 1, gate inside 0, else 2."""
    dark = F.col("v") < t
    return px.withColumn("pred", F.when(dark & ~F.col("inside"), 1).when(dark, 0).otherwise(MINERAL))


def annotations(px: DataFrame, min_area: int = 20, label: str = "target", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Regions of each class of min_area pixels or more: annotation_id, tile, category, bbox, area and row runs as geometry."""
    p = px.where(F.col(label).isin(*classes)).withColumn("mask", F.lit(True)).withColumn("category_id", F.col(label).cast("int"))
    c = components(p.select("tile_id", "y", "x", "mask", "category_id"), within=["category_id"])
    runs = with_runs(c.withColumn("m", F.lit(True)), "m", ["category_id", "region_id"]).groupBy("tile_id", "category_id", "region_id", "y", "x0").agg(F.count("*").alias("length"))
    a = runs.groupBy("tile_id", "category_id", "region_id").agg(F.sum("length").alias("area"), F.min("y").alias("y0"), F.min("x0").alias("left"), F.max("y").alias("y1"), F.max(F.col("x0") + F.col("length") - 1).alias("right"), F.array_sort(F.collect_list(F.struct("y", F.col("x0").alias("x"), "length"))).alias("runs")).where(F.col("area") >= min_area)
    box = F.array("left", "y0", F.col("right") - F.col("left") + 1, F.col("y1") - F.col("y0") + 1)
    order = Window.partitionBy("tile_id").orderBy("category_id", "region_id")
    return a.select("tile_id", F.row_number().over(order).alias("annotation_id"), "category_id", "region_id", "area", box.alias("bbox"), "runs")


def context_audit(px: DataFrame, patch: int, label: str = "target", t: int = GATE) -> DataFrame:
    """Of the gate's pixels of each class: how many lie in regions that cross patch seams, touch a tile edge, or hold both labels; and the regions' majority label."""
    e = Window.partitionBy("tile_id")
    edge = (F.col("y") == F.min("y").over(e)) | (F.col("y") == F.max("y").over(e)) | (F.col("x") == F.min("x").over(e)) | (F.col("x") == F.max("x").over(e))
    p = px.select("tile_id", "y", "x", "v", F.col(label).alias("label"), edge.alias("edge")).withColumn("mask", F.col("v") < t)
    c = components(p)
    cell = F.struct(F.floor(F.col("y") / patch), F.floor(F.col("x") / patch))
    s = c.groupBy("tile_id", "region_id").agg(F.min(cell).alias("a"), F.max(cell).alias("b"), F.min(F.floor(F.col("x") / patch)).alias("xa"), F.max(F.floor(F.col("x") / patch)).alias("xb"), F.bool_or("edge").alias("censored"), F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    s = s.select("tile_id", "region_id", ((F.col("a") != F.col("b")) | (F.col("xa") != F.col("xb"))).alias("crosses"), "censored", ((F.col("n0") > 0) & (F.col("n1") > 0)).alias("mixed"), F.when(F.col("n0") > F.col("n1"), 0).otherwise(1).alias("majority"))
    j = c.join(s, ["tile_id", "region_id"])
    return j.groupBy("label").agg(F.count("*").alias("pixels"), F.count_if("crosses").alias("crossing"), F.count_if("censored").alias("censored"), F.count_if("mixed").alias("mixed"), F.count_if(F.col("majority") == F.col("label")).alias("majority_agrees"))
