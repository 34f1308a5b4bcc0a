"""The folder that driver and executors share, for files that the engine itself writes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path under spark.checkpoint.dir of the session; only on a local master under a temporary folder."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(conf or '/tmp/checkpoints/local').rstrip('/')}/{kind}-{uuid.uuid4().hex}"
