"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir. Where it is unset, a temporary folder serves a session of one machine; on a cluster that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def settled(frame: DataFrame) -> DataFrame:
    """The frame's rows, computed once and kept in the checkpoint folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
