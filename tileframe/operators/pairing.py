"""Joins between tiles, masks, indexes, manifests, patches, series and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileframe.functions import category_id, is_close


def pair_masks(tiles: DataFrame, masks: DataFrame, suffix: str = "_mask") -> tuple[DataFrame, DataFrame]:
    """Pairs by stem (mask ``<stem>_mask``) with whether shapes agree, and what has no partner. Both have tile_id, height and width."""
    m = masks.select(F.regexp_replace("tile_id", f"{suffix}$", "").alias("tile_id"), F.col("height").alias("mask_height"), F.col("width").alias("mask_width"))
    both = tiles.select("tile_id", "height", "width").join(m, "tile_id", "full_outer")
    paired = both.where(F.col("height").isNotNull() & F.col("mask_height").isNotNull()).withColumn("same_shape", (F.col("height") == F.col("mask_height")) & (F.col("width") == F.col("mask_width")))
    alone = both.where(F.col("height").isNull() | F.col("mask_height").isNull()).select("tile_id", F.when(F.col("height").isNull(), "mask").otherwise("tile").alias("side"))
    return paired, alone


def pair_index(images: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index images that have a tile of their file's stem, and those that have none."""
    named = images.withColumn("tile_id", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    have = tiles.select("tile_id").distinct()
    return named.join(have, "tile_id", "left_semi"), named.join(have, "tile_id", "left_anti")


def resolve_manifest(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """split, ident and image_id: an ident is an image id, else a file name, else a digit string; NULL where unknown."""
    m = manifest if "is_text" in manifest.columns else manifest.withColumn("is_text", F.lit(True))
    number = F.when(F.col("ident").rlike("^[0-9]+$"), F.col("ident").try_cast("bigint"))
    by_id = images.select(F.col("id").alias("_id")).distinct()
    by_name = images.groupBy(F.col("file_name").alias("_name")).agg(F.min("id").alias("_by_name"))
    out = m.withColumn("_number", number).join(by_name, F.col("ident") == F.col("_name"), "left").join(by_id, F.col("_number") == F.col("_id"), "left")
    image = F.when(~F.col("is_text"), F.col("_id")).otherwise(F.coalesce("_by_name", "_id"))
    return out.select("split", "ident", image.alias("image_id"))


def map_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame, num_classes: int = 3) -> tuple[DataFrame, DataFrame]:
    """Annotations of known images with their class, and those whose image or category is unknown or out of range."""
    classes = categories.select(F.col("id").alias("category_id"), category_id(F.col("name")).alias("class_id"))
    joined = annotations.join(classes, "category_id", "left").join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id", "left")
    fine = F.col("class_id").isNotNull() & (F.col("class_id") < num_classes) & F.col("file_name").isNotNull()
    return joined.where(fine), joined.where(~F.coalesce(fine, F.lit(False)))


def assign_patches(px: DataFrame, patches: DataFrame) -> DataFrame:
    """Pixels of each patch (half-open y0, x0, y1, x1): each row of a patch meets the pixels of that row by equality, and its columns are cut out."""
    rows = patches.withColumn("y", F.explode(F.expr("sequence(y0, y1 - 1)"))).select("tile_id", "patch_id", F.col("row").alias("patch_row"), F.col("col").alias("patch_col"), "y0", "x0", "x1", "y")
    return px.join(rows, ["tile_id", "y"]).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))).drop("x1").select("tile_id", "y", "x", *[c for c in px.columns if c not in ("tile_id", "y", "x")], "patch_id", "patch_row", "patch_col", "y0", "x0")


def assign_series(files: DataFrame, series: DataFrame) -> DataFrame:
    """file, series and matches: a stem belongs to s if it is s or starts with ``s_``. Anything but one match is an error to look at.

    Each prefix of the stem that ends before an underscore is looked up, so this is an equi join.
    """
    parts = F.split("stem", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    tried = files.select("stem").distinct().select("stem", F.explode(F.array_distinct(prefixes)).alias("series"))
    hits = tried.join(series.select("series").distinct(), "series").groupBy("stem").agg(F.min("series").alias("series"), F.count("*").alias("matches"))
    return files.select("stem").distinct().join(hits, "stem", "left").select("stem", F.when(F.col("matches") == 1, F.col("series")).alias("series"), F.coalesce("matches", F.lit(0)).alias("matches"))


def contrast_by_seed(df: DataFrame, reference: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """reference_value and difference (reference less method) at the same seed; df has method_id, seed, value and ``by``."""
    ref = df.where(F.col("method_id") == reference).select("seed", *by, F.col("value").alias("reference_value"))
    return df.where(F.col("method_id") != reference).join(ref, ["seed", *by]).withColumn("difference", F.col("reference_value") - F.col("value"))


def contrast_by_mean(df: DataFrame, reference: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """The same for methods without a seed, against the reference's mean over its seeds (NULL if any of them is)."""
    ref = df.where(F.col("method_id") == reference).groupBy(*by).agg(F.when(F.count("*") == F.count("value"), F.avg("value")).alias("reference_value"))
    return df.where((F.col("method_id") != reference) & F.col("seed").isNull()).join(ref, list(by)).withColumn("difference", F.col("reference_value") - F.col("value"))


def check_grid(df: DataFrame, candidates: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """candidate, seed and finding (missing, extra or repeated) against the full grid of two short lists."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(c, s) for c in candidates for s in seeds], "candidate string, seed int")
    have = df.groupBy("candidate", "seed").agg(F.count("*").alias("n"))
    both = grid.withColumn("planned", F.lit(True)).join(have, ["candidate", "seed"], "full_outer")
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("planned").isNull(), "extra").when(F.col("n") > 1, "repeated")
    return both.withColumn("finding", finding).where("finding is not null").select("candidate", "seed", "finding")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], exact: Sequence[str] = (), close: Sequence[str] = (), rel: float = 1e-9, abs_: float = 1e-12) -> DataFrame:
    """keys, column and finding (missing in a or b, or differs) for each cell that two tables disagree on; NULL agrees with NULL."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in (*exact, *close)], F.lit(1).alias("in_a"))
    right = b.select(*[F.col(k).alias(f"b_key_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in (*exact, *close)], F.lit(1).alias("in_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"b_key_{k}"))
    both = left.join(right, on, "full_outer")
    same = {c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in exact} | {c: is_close(F.col(f"a_{c}"), F.col(f"b_{c}"), rel, abs_) for c in close}
    findings = [F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~s, F.struct(F.lit(c).alias("column"), F.lit("differs").alias("finding"))) for c, s in same.items()]
    whole = F.when(F.col("in_a").isNull(), F.struct(F.lit("*").alias("column"), F.lit("missing in a").alias("finding"))).when(F.col("in_b").isNull(), F.struct(F.lit("*").alias("column"), F.lit("missing in b").alias("finding")))
    named = [F.coalesce(F.col(k), F.col(f"b_key_{k}")).alias(k) for k in keys]
    return both.select(*named, F.explode(F.filter(F.array(whole, *findings), lambda x: x.isNotNull())).alias("f")).select(*keys, "f.column", "f.finding")


def discover(files: DataFrame, masks: DataFrame, prefixes: Sequence[str], expected: int | None = None) -> DataFrame:
    """Findings of the held-out names that start with a prefix: in one tree only, or another number than expected."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("name").startswith(p)
    a, b = files.where(wanted).select("name").distinct(), masks.where(wanted).select("name").distinct()
    both = a.withColumn("f", F.lit(1)).join(b.withColumn("m", F.lit(1)), "name", "full_outer")
    out = both.where(F.col("f").isNull() | F.col("m").isNull()).select("name", F.when(F.col("f").isNull(), "mask only").otherwise("file only").alias("finding"))
    if expected is not None:
        n = both.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("*").alias("name"), F.concat(F.lit("count "), F.col("n").cast("string")).alias("finding"))
        out = out.unionByName(n)
    return out
