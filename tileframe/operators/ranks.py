"""Ranks over whole tables without one task for all rows: rows are dealt into buckets that keep the order, ranked in each, and the counts of the buckets before are added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.operators.storage import materialise


def _with_offsets(dealt: DataFrame, within: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Adds _k, from 1, and _t, the number of rows, of each group of ``within``; dealt has _b, a bucket. Few rows a group are summed up: one for each bucket."""
    counts = dealt.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*(within or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*within, "_b", before.alias("_o"), F.sum("_n").over(group).alias("_t"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*within, "_b").orderBy(*order)))
    return ranked.join(counts, [*within, "_b"]).withColumn("_k", F.col("_r") + F.col("_o")).drop("_r", "_o", "_b")


def ranked_by_hash(df: DataFrame, key: Column, ties: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Adds _k and _t in the order of a hexadecimal hash: its first three digits are the bucket."""
    dealt = df.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, 3))
    return _with_offsets(dealt, within, ["_h", *ties]).drop("_h")


def ranked_by_value(df: DataFrame, order: str) -> DataFrame:
    """Adds _k and _t in the order of a column: ranges of it are the buckets."""
    ranged = materialise(df.repartitionByRange(F.col(order)).withColumn("_b", F.spark_partition_id()), "ranges")
    return _with_offsets(ranged, (), [order])


def running_sums(df: DataFrame, order: str, values: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds <value>_upto and <value>_all: sums of integers up to each row (with its equals in the order) and over all rows. Ranges of the
    order are summed apart; the sums of the ranges before, one row a range, are added."""
    way = F.desc_nulls_last(order) if descending else F.asc_nulls_first(order)
    ranged = materialise(df.repartitionByRange(way).withColumn("_b", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_b").agg(*[F.sum(v).alias(f"_s{k}") for k, v in enumerate(values)])
    line = Window.partitionBy(F.lit(0))
    before = [F.coalesce(F.sum(f"_s{k}").over(line.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o{k}") for k in range(len(values))]
    offsets = sums.select("_b", *before, *[F.sum(f"_s{k}").over(line).alias(f"{v}_all") for k, v in enumerate(values)])
    upto = Window.partitionBy("_b").orderBy(way).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({f"_u{k}": F.sum(v).over(upto) for k, v in enumerate(values)}).join(offsets, "_b")
    return out.withColumns({f"{v}_upto": F.col(f"_u{k}") + F.col(f"_o{k}") for k, v in enumerate(values)}).select(*df.columns, *[f"{v}_{x}" for v in values for x in ("upto", "all")])
