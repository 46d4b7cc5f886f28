"""Scans. Every reader declares its schema; what can't be read is a row to look at, not a failure, unless a contract says otherwise."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileframe.functions import parse_float, run_group, run_name

COCO_SCHEMA = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int>>, "
    "annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, segmentation: array<array<double>>, area: double, bbox: array<double>, iscrowd: int>>, "
    "categories array<struct<id: bigint, name: string>>"
)
#: Column, section and key of each number of a run summary (fixed names).
SUMMARY_NUMBERS = (
    ("epochs_trained", "training_config", "epochs_trained"), ("batch_size", "training_config", "batch_size"), ("learning_rate", "training_config", "learning_rate"),
    ("best_val_loss", "final_metrics", "best_val_loss"), ("best_pore_iou", "final_metrics", "best_pore_iou"), ("final_mean_iou", "final_metrics", "final_mean_iou"),
    ("final_pore_iou", "final_metrics", "final_pore_iou"), ("final_background_iou", "final_metrics", "final_background_iou"), ("final_val_acc", "final_metrics", "final_val_acc"),
    ("total_training_time_s", "final_metrics", "total_training_time"),
)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_tiles(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Pixels of all images of a folder: tile_id, y, x, v for one channel, and r, g, b for colour images (v NULL).

    An unreadable image is one row with NULL y, x and v, or nothing with drop_invalid.
    """
    raw = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path).select("image.*")
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda k: F.conv(F.hex(F.substring("data", k, 1)), 16, 10).cast("smallint"))
    tiles = raw.select(stem(F.col("origin")).alias("tile_id"), "width", "nChannels", F.when(F.col("nChannels") > 0, bytes_).alias("flat"))
    # One row of the tile at a time, so that no whole tile is copied for each pixel.
    rows = tiles.select("tile_id", "width", "nChannels", F.posexplode_outer(F.when(F.col("flat").isNotNull(), F.transform(F.sequence(F.lit(0), F.expr("size(flat) div (width * nChannels)") - 1), lambda y: F.slice("flat", (y * F.col("width") * F.col("nChannels") + 1).cast("int"), (F.col("width") * F.col("nChannels")).cast("int"))))).alias("y", "row"))
    pixels = rows.select("tile_id", "y", "nChannels", F.posexplode_outer(F.when(F.col("row").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.slice("row", x * F.col("nChannels") + 1, F.col("nChannels"))))).alias("x", "c"))
    colour = F.col("nChannels") >= 3
    return pixels.select("tile_id", "y", "x", F.when(F.col("nChannels") == 1, F.get("c", F.lit(0))).alias("v"), *[F.when(colour, F.get("c", F.lit(k))).alias(n) for k, n in ((2, "r"), (1, "g"), (0, "b"))], F.when(F.col("nChannels") == 4, F.get("c", F.lit(3))).alias("a"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, size and sha256 of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_coco(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, DataFrame]:
    """images, annotations and categories of one index (plain or .gz), or of several: images and annotations of all, categories of the first path."""
    every = [paths] if isinstance(paths, str) else list(paths)
    docs = [spark.read.schema(COCO_SCHEMA).json(p, multiLine=True) for p in every]
    out = {}
    for name in ("images", "annotations", "categories"):
        used = docs if name != "categories" else docs[:1]
        parts = [d.select(F.explode(name).alias("x")).select("x.*") for d in used]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        out[name] = whole
    return out


def read_manifest(spark: SparkSession, path: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """split, ident (as text) and is_text of a split manifest. A missing split or a boolean ident is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    lists = raw.select(F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.try_element_at("m", F.lit(s)).alias("list")) for s in splits])).alias("x")).select("x.*")
    missing = F.raise_error(F.concat(F.lit("manifest lacks split "), F.col("split")))
    # Elements are kept as raw JSON text, so that numbers, strings and booleans stay apart.
    items = lists.select("split", F.when(F.col("list").isNull(), missing.cast("string")).otherwise(F.col("list")).alias("list"))
    each = items.select("split", F.explode(F.regexp_extract_all("list", F.lit(r'"(?:[^"\\]|\\.)*"|[^\s,\[\]]+'), F.lit(0))).alias("raw"))
    wrong = F.raise_error(F.concat(F.lit("manifest ident must not be "), F.col("raw")))
    ident = F.when(F.col("raw").isin("true", "false", "null"), wrong.cast("string")).when(F.col("raw").startswith('"'), F.from_json(F.concat(F.lit('{"x":'), F.col("raw"), F.lit("}")), "x string").getField("x")).otherwise(F.col("raw"))
    return each.select("split", ident.alias("ident"), F.col("raw").startswith('"').alias("is_text"))


def read_run_summaries(spark: SparkSession, path: str, name: str = "training_summary.json") -> DataFrame:
    """run_name, group, summary_path, early_stopped and the numbers of all run summaries below a folder; files that aren't JSON objects are left out.

    A summary has the objects final_metrics and training_config; a number that is absent, not finite or no number is NULL, and numbers may be text.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select("value", F.col("_metadata.file_path").alias("summary_path"))
    section = lambda x: F.from_json(F.try_element_at("m", F.lit(x)), "map<string, string>")
    read = files.select("summary_path", F.from_json("value", "map<string, string>").alias("m")).where("m is not null")
    read = read.withColumns({x: section(x) for x in ("final_metrics", "training_config")})
    numbers = [parse_float(F.try_element_at(part, F.lit(key))).alias(column) for column, part, key in SUMMARY_NUMBERS]
    stopped = F.coalesce(F.lower(F.try_element_at("training_config", F.lit("early_stopped"))) == "true", F.lit(False))
    return read.select(run_name(F.col("summary_path")).alias("run_name"), run_group(F.col("summary_path")).alias("group"), "summary_path", stopped.alias("early_stopped"), *numbers)


def read_contract_csv(spark: SparkSession, path: str, schema: str, exact: Sequence[str] | None = None, required: Sequence[str] = (), allowed: Sequence[str] | None = None) -> DataFrame:
    """A CSV file whose header keeps a contract; a wrong header, a short or long row, or no row is an error. schema types the columns it names."""
    header = spark.read.option("header", "false").csv(path).first()
    names = list(header) if header else []
    wrong = []
    if not names or len(set(names)) != len(names):
        wrong.append("header is empty or repeats a name")
    if exact is not None and names != list(exact):
        wrong.append(f"header is {names}, not {list(exact)}")
    if absent := [x for x in required if x not in names]:
        wrong.append(f"lacks {absent}")
    if allowed is not None and (more := [x for x in names if x not in allowed]):
        wrong.append(f"has {more}")
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
    full = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    read = spark.read.schema(full).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    if read.isEmpty():
        raise ValueError(f"{path}: no rows")
    return read


def json_faults(text: str | None) -> list[str]:
    """What strict reading holds against one document."""
    faults = []

    def pairs(items: list) -> dict:
        times = Counter(k for k, _ in items)
        faults.extend(f"duplicate key {k}" for k in sorted(k for k, n in times.items() if n > 1))
        return dict(items)

    try:
        root = json.loads(text if text is not None else "", object_pairs_hook=pairs, parse_constant=lambda c: faults.append(f"constant {c}"))
    except (ValueError, RecursionError):
        return [*faults, "not JSON"]
    return faults if isinstance(root, dict) else [*faults, "root is not an object"]


def audit_json(df: DataFrame, col: str, key: str) -> DataFrame:
    """key and finding: duplicate keys, NaN or Infinity, a root that is no object, text that is no JSON, bytes that aren't UTF-8."""
    picked = df.select(F.col(key).cast("string").alias("key"), F.col(col).cast("binary").alias("doc"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, doc in zip(frame["key"], frame["doc"], strict=True):
                try:
                    rows += [(k, x) for x in json_faults(None if doc is None else bytes(doc).decode("utf-8"))]
                except UnicodeDecodeError:
                    rows.append((k, "not UTF-8"))
            yield pd.DataFrame(rows, columns=["key", "finding"])

    return picked.mapInPandas(run, "key string, finding string")


def synthetic_tiles(spark: SparkSession, n: int, size: int) -> DataFrame:
    """tile_id, y, x, v and mask of closed-form tiles 1 to n."""
    side = F.sequence(F.lit(0), F.lit(size - 1))
    grid = spark.range(1, n + 1).select(F.col("id").alias("tile_id"), F.explode(side).alias("y")).select("tile_id", "y", F.explode(side).alias("x"))
    i, y, x = F.col("tile_id"), F.col("y"), F.col("x")
    mask = F.when((2 * x + y + i) % 5 == 0, 1).when((x + y + i) % 7 == 0, 0).otherwise(255)
    return grid.withColumns({"v": ((17 * x + 29 * y + 31 * i) % 256).cast("smallint"), "mask": mask.cast("smallint")})


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """pattern: trimmed lines but blanks and comments; an absolute pattern, one with a dot-dot part, or none at all is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("pattern")).where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    bad = lines.where(F.col("pattern").startswith("/") | F.array_contains(F.split("pattern", "/"), "..")).limit(5).collect()
    if bad or lines.isEmpty():
        raise ValueError(f"{path}: " + (f"unsafe patterns {[r.pattern for r in bad]}" if bad else "no patterns"))
    return lines
