"""The folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as a URI. Where it is unset a temporary folder is set, on a local
    master only: on a cluster the executors could not see it, so that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") if "://" in base or base.startswith("/") else "file://" + os.path.abspath(base)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
