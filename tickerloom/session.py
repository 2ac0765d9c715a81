"""Session defaults and the shared folder used for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tickerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew handling and UTC; on a cluster pass no master.

    ``spark.sql.shuffle.partitions`` is left to the cluster's configuration unless given:
    AQE coalesces small partitions, so a generous number is safe at any scale.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``, else the session's warehouse,
    which all executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
