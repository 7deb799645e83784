"""What can be said about a plan before it runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Nodes that leave rows in the partition that their file gives them.
_IN_PLACE = frozenset({"Project", "Filter", "FileScan", "ColumnarToRow", "Generate", "Expand", "Union"})


def only_scans(df: DataFrame) -> bool:
    """Whether ``df`` is made of file scans and deterministic expressions without a shuffle: its partitions are the same in every run."""
    execution = df._jdf.queryExecution()
    if not execution.optimizedPlan().deterministic():
        return False
    plan = execution.executedPlan().toString()
    return {m[1] for m in re.finditer(r"^[\s:+\-*]*(?:\(\d+\) )?([A-Za-z]+)", plan, re.MULTILINE)} <= _IN_PLACE


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is a scan of fewer partitions than there are cores.

    For work that costs much more than moving the rows. An input of that few partitions is small, so what is shuffled
    here does not grow with the data. A stream is left as it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if only_scans(df) and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df
