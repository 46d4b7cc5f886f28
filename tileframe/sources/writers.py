"""Sinks: metric tables, report documents, write-once outputs and one folder per tile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_float(x: Column, digits: int = 12) -> Column:
    """At most ``digits`` significant digits without trailing zeros; NULL and non-finite values are blank."""
    text = F.format_string(f"%.{digits - 1}e", x)
    power = F.regexp_extract(text, "e([+-][0-9]+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.regexp_extract(text, "^(.*)e", 1), r"\.?0+$", "")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    digits_only = F.regexp_replace(F.regexp_replace(plain, "^-", ""), r"\.", "")
    sign = F.when(x < 0, "-").otherwise("")
    whole = F.concat(sign, F.when(power >= F.length(digits_only) - 1, F.rpad(digits_only, power + 1, "0")).otherwise(F.concat(F.substring(digits_only, 1, power + 1), F.lit("."), F.substring(digits_only, power + 2, 40))))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits_only)
    shown = F.when(x == 0, "0").when(power.between(0, digits - 1), whole).when(power.between(-4, -1), small).otherwise(F.concat(plain, exponent))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "").otherwise(shown)


def metric_csv(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The columns as they are written: floats shortened, NULL blank."""
    kinds = dict(df.dtypes)
    return df.select(*[(short_float(F.col(x)) if kinds[x] in ("double", "float") else F.coalesce(F.col(x).cast("string"), F.lit(""))).alias(x) for x in fields])


def write_metric_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    metric_csv(df, fields).write.csv(path, header=True, emptyValue="")


def json_report(df: DataFrame) -> DataFrame:
    """One JSON object for each row, non-finite numbers as null."""
    fine = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*fine), {"ignoreNullFields": "false"}).alias("value"))


def write_json_report(df: DataFrame, path: str) -> None:
    json_report(df).write.text(path)


def write_coco(documents: DataFrame, path: str) -> None:
    """COCO documents (a column ``json``), one a file."""
    documents.select("json").write.option("maxRecordsPerFile", 1).text(path)


def write_once(df: DataFrame, path: str) -> None:
    """Refuses an output that exists."""
    df.write.mode("errorifexists").parquet(path)


def write_tiles(df: DataFrame, path: str) -> None:
    """One folder per tile; rows of a tile are brought together first, so that a task writes few files."""
    df.repartition("tile_id").sortWithinPartitions("tile_id", "y", "x").write.partitionBy("tile_id").parquet(path)
