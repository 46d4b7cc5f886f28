"""The shared working folder, for results that loops come back to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and all is local."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(context, "_tileframe_dir", None)
        if base is None:
            base = context._tileframe_dir = tempfile.mkdtemp(prefix="tileframe-")
    return base


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner real sizes."""
    path = f"{shared_dir(df.sparkSession)}/tileframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
