"""Shuffles into as many partitions as the size of a table asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a table, as its plan states them, that one task gets.
TASK_BYTES = 8 << 20


def parts(rows: DataFrame) -> int:
    """The partitions that the size of a table asks for."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = -(-size // TASK_BYTES) if size < 1 << 50 else 1  # beyond: Spark doesn't know
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size)


def dealt(rows: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """rows by keys, in as many partitions as keep each small whatever the size of the table (of like, if given): what a task sorts has a bound."""
    return rows.repartition(parts(like or rows), *keys)
