"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from threadlake.plans.lineage import ensure_checkpoint_dir, settled

__all__ = ["checkpoint_folder", "ensure_checkpoint_dir", "settled", "stored"]


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all machines share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(frame: DataFrame) -> DataFrame:
    """The frame's rows, written as Parquet in the checkpoint folder and read again.

    For many rows: checkpoints aren't compressed, columns of a table are.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
