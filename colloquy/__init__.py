"""Colloquy: conversation analytics as DataFrame-to-DataFrame operators on Spark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile


def settle(spark) -> None:
    """Unions keep no partitioning of their parts: Spark 4.1 plans some that can't run ("unequal numbers of partitions")."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark) -> None:
    """Send this package to the executors, once for each context, for their Python workers; see ``settle``."""
    settle(spark)
    sc = spark.sparkContext
    if getattr(sc, "_colloquy_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="colloquy-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "colloquy_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, dirs, files in os.walk(here):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._colloquy_shipped = True
