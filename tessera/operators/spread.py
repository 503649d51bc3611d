"""Parallelism for Python stages over small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTES_PER_TASK = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew over all cores if its estimated size is less than a task's share each.

    A file of few megabytes is one partition, and one Python worker would parse all of it. Large inputs
    have partitions enough and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * BYTES_PER_TASK else df
