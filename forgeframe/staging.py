"""Cutting lineage in loops: checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read from there.

    Where that is unset, a temporary folder is taken, but only if all runs on this machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir names no folder: executors need one that all of them share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="forgeframe-checkpoints-"))
    return df.checkpoint(eager=True)
