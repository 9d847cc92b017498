"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows, written under spark.checkpoint.dir and read back, so that later steps neither repeat them nor carry their plan.

    A session on one machine without that setting gets a temporary folder; on
    a cluster it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="steps-"))
        root = context.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
