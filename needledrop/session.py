"""SparkSession for the library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "needledrop", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the master comes from spark-submit instead."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
