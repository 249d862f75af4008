"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once below spark.checkpoint.dir and read back; a temporary folder where that is unset,
    which a cluster's executors couldn't read: there it must be set.

    Cuts the plan where several operators read the same rows, and survives lost executors.
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
