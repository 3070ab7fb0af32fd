"""What a session needs: the package on its executors, and a folder to write to."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, unless PYTHONPATH already leads them to it."""
    context = spark.sparkContext
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    name = "lumenseq_package.zip"
    if str(ROOT) not in on_path and not any(x.endswith(name) for x in context._python_includes):
        folder = os.path.realpath(tempfile.mkdtemp(prefix="lumenseq-"))
        made = shutil.make_archive(os.path.join(folder, name[:-4]), "zip", ROOT, "lumenseq")
        context.addPyFile(made)
    return spark


def materialized(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
