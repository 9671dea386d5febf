"""Places for files that queries write and read back: the folder in ``spark.checkpoint.dir``, or a temporary one in local sessions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/readloom/{label}-{uuid.uuid4().hex}"
    if spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="readloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}/{label}-{uuid.uuid4().hex}"


def mounted(spark: SparkSession, label: str) -> str:
    """A new folder, as a plain path, for what writes files by path: the shared folder has to be mounted everywhere."""
    path = scratch(spark, label)
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: files by name need a folder that is mounted on all machines")
    path = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(path)
    return path
