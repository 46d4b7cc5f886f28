"""What the text operators share: tables, the shared working folder, and batches balanced by bytes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one of our own only where that is unset (tests, local mode)."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(context, "_tileframe_dir", None)
        if base is None:
            base = context._tileframe_dir = tempfile.mkdtemp(prefix="tileframe-")
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tileframe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner real sizes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; NULL keys go to fold 0 of an empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche, on arrays of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_bytes(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Consecutive groups of texts, each of about ``limit`` characters; a longer text is a group of its own."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and what they keep counts beside later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def slices(batches: Iterable[pa.RecordBatch], text_col: str, limit: int, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about ``limit`` bytes of text and at most ``rows`` rows; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy().astype("int64"))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + limit, "right"))))
            yield batch.slice(at, stop - at)
            at = stop
        release()
