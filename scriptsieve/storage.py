"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where it is unset, a temporary folder. A cluster without it is refused."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="scriptsieve-")
    return _LOCAL[sc.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
