"""Token-id files: Parquet with one list of ids per document, in ascending id order over all files.

Columns: ``part`` (number of the range), ``doc_id``, ``local_start`` (ids before it in its part), ``n_tokens``, ``ids``. Files are
written with dictionary encoding for ids (their values repeat) and delta encodings for the numbers (writer version 2), small
pages with page indexes, and row groups of a set size, so that reading n_tokens or a range of doc_id touches few pages.

NULL and empty texts have only the end id. NULL doc_ids come first. Rows with equal doc_ids are ordered by the hash of the text;
equal rows are each kept. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tileframe.llm.common import slices
from tileframe.llm.tokens import GROUP_BYTES, worker_pieces

#: Files of one output at most.
MOST_PARTS = 200_000
FILE_SCHEMA = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"


def parts_for(docs: DataFrame, part_bytes: int) -> int:
    """At least spark.sql.shuffle.partitions, and more where the planner's size of the input asks for it."""
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-planned // part_bytes)))


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    partitions: int | None = None, part_bytes: int = 256 << 20, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10,
) -> None:
    """Range-partition by id, encode each range in order and write it. Each part's rows lie in one file, in order."""
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions or parts_for(picked, part_bytes)
    ordered = picked.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part_id, start = TaskContext.get().partitionId(), 0
        pieces = worker_pieces(tokenizer_path, False)
        for part in slices(batches, "text", GROUP_BYTES):
            found = pieces.texts(part.column("text"))
            flat = np.insert(found.flat, np.cumsum(found.lengths), end_id)
            offsets = np.cumsum(np.concatenate([[0], found.lengths + 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(part.num_rows, part_id, "int32")), part.column("doc_id"), pa.array(start + offsets[:-1]), pa.array(found.lengths + 1), pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(flat))],
                ["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])

    writer = ordered.mapInArrow(run, FILE_SCHEMA).write
    for key, value in {
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes), "parquet.dictionary.page.size": str(1 << 20), "parquet.column.index.truncate.length": "64", "compression": "zstd",
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if asked for, ids. Starts come from the metadata columns alone."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row for each part, of which there are at most MOST_PARTS: a running sum over so few is one small task.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = totals.select("part", before.alias("before"))
    out = files.join(F.broadcast(sums), "part").withColumn("start", F.col("before") + F.col("local_start"))
    return out.select("doc_id", "start", "n_tokens", *(["ids"] if with_ids else []))


def ids_crc32(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
