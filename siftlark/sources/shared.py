"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local session without that setting (tests) gets a folder of its own, removed at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="siftlark-engine-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        folder = Path(_own_dirs[app]).as_uri()
    return f"{folder.rstrip('/')}/siftlark/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and lost executors do not matter."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uncounted(side: DataFrame) -> DataFrame:
    """``side`` of a join that nobody counted, to be sorted and merged: Spark itself would broadcast it by the size of its files, which columns of repeated values make a hundredth of what the rows need in memory."""
    return side.hint("merge")
