"""Helpers shared by the corpus operators: the shared folder, cut lineage, skew-safe joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: At most this many groups are ever treated as heavy, whatever the size of the input.
HEAVY_GROUPS = 1000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own, removed at exit. On
    a cluster such a folder would be another one on every machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="siftlark-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return Path(_own_dirs[app]).as_uri()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/siftlark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors do not matter."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(df: DataFrame) -> list[str]:
    """Column names of ``df`` that may hold dots or backticks, ready for ``select``."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Join every row to the single row of its group, however large a group is.

    ``groups`` has unique non-null ``key`` values and the group's row count in ``size``. Groups
    with more than a thousandth of all rows number at most ``HEAVY_GROUPS``; that proven bound
    lets them be broadcast. All other groups are small enough for a shuffle join.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    bound = max(total // HEAVY_GROUPS, 1)
    heavy = F.broadcast(groups.where(F.col(size) > bound))
    light = groups.where(F.col(size) <= bound)
    hot = rows.join(heavy, key)
    cold = rows.join(heavy.select(key), key, "left_anti").join(light, key)
    return hot.unionByName(cold)
