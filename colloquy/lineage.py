"""Cutting lineage: checkpoints in the folder that the cluster names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; local mode without that setting makes a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not named:
            named = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        # Spark makes a folder of its own for this application in it, which goes with the application
        own = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return df.checkpoint(eager=True)
