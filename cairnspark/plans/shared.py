"""Folders that all executors reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only where that is unset and Spark is local."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    folder = f"{base.rstrip('/')}/cairnspark-{sc.applicationId}"
    if folder not in _HELD:
        _HELD.add(folder)
        if folder.startswith(("/", "file:")):  # a local disk; a store's folder goes by its own rules
            atexit.register(shutil.rmtree, "/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_HELD: set[str] = set()
