"""Proportional stratified interleaving: shards of equal row counts that each match the mixture of sources.

Rows are shuffled by a seeded hash and ranked within their source; a row's place among all rows is that of its fractional rank
(rank - u) / (rows of the source), where u from 0 to 1 is drawn from a hash of the row, ties by hash and source; the order is cut
into shards whose sizes differ by one row at most. Since each row of a source has an interval of its own, every stretch of the order holds
each source in proportion, up to one row at either end; since u is drawn, many sources of one row (the hosts of a crawl) are spread
over all shards and don't meet at one rank. Ranks come from counts of hash buckets plus a rank within a bucket, about sqrt(rows)
of either, so that a source that holds a third of all rows is ranked by many tasks.

A NULL source is a source of its own. NULL and empty texts have no bytes and crc32 0. Repeated rows each get a slot; which of
two equal rows comes first doesn't matter. An empty table gives no rows. Only the id, text and source columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = 1 << 40


def _hash(seed: int, first: int = 1) -> Column:
    """40 bits, from a hexadecimal digit on, of the md5 of seed and id: the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")), first, 10), 16, 10).cast("bigint")


def _offsets(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket of its keys, and all rows of the keys: about sqrt(rows) buckets for each key at most."""
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select(*keys, bucket, before.alias("_before"), F.sum("_n").over(over).alias("_all"))


def interleave(docs: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", overhead: int = 16) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot (place in the shard, from 0) and place (among all rows, from 0)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + overhead).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_t"),
    ).withColumns({"_h": _hash(seed), "_u": _hash(seed, 11)})
    buckets = max(1, math.isqrt(docs.count()))
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("_b", F.floor(F.col("_h") * F.lit(buckets) / SPACE).cast("int"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "_t", "size")))
    ranked = ranked.join(_offsets(rows, ["_s"], "_b"), ["_s", "_b"]).withColumn("_f", (F.col("_r") + F.col("_before") - F.col("_u") / float(SPACE)) / F.col("_all").cast("double"))
    ranked = ranked.drop("_b", "_before", "_all", "_r").withColumn("_c", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)).cast("int"))
    placed = ranked.withColumn("_p", F.row_number().over(Window.partitionBy("_c").orderBy("_f", "_h", "_s", "doc_id", "_t", "size")))
    placed = placed.join(_offsets(ranked, [], "_c"), "_c").withColumn("place", (F.col("_p") + F.col("_before") - 1).cast("bigint"))
    shard = F.expr(f"place * {shards} div _all")
    first = F.expr(f"({shard_expr(shards)} * _all + {shards} - 1) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("place") - first).cast("bigint").alias("slot"), "place")


def shard_expr(shards: int) -> str:
    return f"(place * {shards} div _all)"
