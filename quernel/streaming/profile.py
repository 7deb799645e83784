"""Quality states of a table that arrives in loads, kept up to date without reading old rows again.

Each micro-batch is profiled once and its frequency states are written to a folder of its own, named after the batch, so
a batch that is run again after a failure replaces what it wrote before. The states of all batches add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernel.operators.quality import Rule, frequency_states


def keep_states(rows: DataFrame, by: str, rules: Sequence[Rule], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing the states of a streaming DataFrame below ``path``; with ``available_now`` it ends by itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        frequency_states(batch, by, rules).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kept_states(spark: SparkSession, by: str, path: str) -> DataFrame:
    """The states of all batches put together; like ``frequency_states`` over all rows that have arrived."""
    return spark.read.parquet(path).groupBy(by, "column_name", "value").agg(F.sum("n").alias("n"))
