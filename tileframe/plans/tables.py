"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one raster per supplier, 24 pixels wide: tile_id, y, x, v, target and pred."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    p = li.withColumn("pos", pos).withColumn("v", (F.col("l_quantity") * 5).cast("int"))
    target = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    pred = F.when(F.col("v") >= 100, 2).when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return p.select(F.col("l_suppkey").cast("bigint").alias("tile_id"), F.floor(F.col("pos") / WIDTH).cast("int").alias("y"), (F.col("pos") % WIDTH).cast("int").alias("x"), "v", target.alias("target"), pred.alias("pred"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, series and split of each supplier, whole series to a split."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("tile_id"), F.col("s_nationkey").cast("int").alias("series"))
    return s.withColumn("split", F.when(F.col("series") % 10 == 0, "val").when(F.col("series") % 5 == 1, "test").otherwise("train"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as predicted probabilities: tile_id, pixel, target and probs (softmax of three components)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pixel"), F.pmod(F.col("vec_id"), F.lit(20)).alias("tile_id"), F.pmod("label", F.lit(3)).cast("int").alias("target"), *[F.exp(F.get("embedding", F.lit(k)).cast("double") * 8).alias(f"e{k}") for k in range(3)])
    total = F.col("e0") + F.col("e1") + F.col("e2")
    return e.select("tile_id", "pixel", "target", F.array(*[F.col(f"e{k}") / total for k in range(3)]).alias("probs"))


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as training logs: one run per user, epochs in time order. Tenths are rounded as SQL does, on the product with ten: Spark's own rounding goes by
    the digits of the number, which may lie just below a half where its product doesn't."""
    e = table(spark, sf_dir, "events").where("value is not null and user_id is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("run_id"), F.row_number().over(w).alias("epoch"), F.round("value", 0).alias("score"), (F.round(F.col("value") % 7 * 10, 0) / 10).alias("tie_breaker"), (F.col("event_id") % 11).cast("double").alias("val_loss"))
