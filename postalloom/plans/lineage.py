"""Cutting a plan off at a written copy, for loops and shared inputs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this run.

    It is under the session's ``spark.checkpoint.dir``. Only where none is set, as in tests on a local
    master, a folder of this machine is taken; elsewhere that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="postalloom-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so later uses read it instead of repeating its plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
