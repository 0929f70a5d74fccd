"""Small files over all cores: a file with few row groups would otherwise be one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files for which a task of its own pays.
SHARE = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over more tasks where its scan has fewer than there are cores and bytes enough for them.

    A large table has more tasks than cores already and stays as it is: nothing is shuffled then.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = min(cores, size // SHARE)
    if tasks <= 1 or df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= tasks:
        return df
    return df.repartition(int(tasks))
