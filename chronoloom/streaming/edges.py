"""Streaming twins of batch operators: the same results from files that arrive in micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events in each tumbling day; a watermark lets finished days leave the state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Times count in whole seconds, like all edges' t; an event that comes gap or more after the one before begins a session.

    Spark's session windows go on at a pause of exactly the gap, hence the microsecond less. Rows without a time are in no session.
    """
    seconds = stream.withColumn("ts", F.date_trunc("second", "ts"))
    return seconds.withWatermark("ts", late).groupBy("src", F.session_window("ts", f"{gap} -1 microsecond").alias("w")).agg(F.count("*").alias("n"))


def limit_violations(stream: DataFrame, k: int, window: int) -> DataFrame:
    """Per source: the queue of recent times is the state; a violation is counted when it reaches k, and it empties.

    Rows of a micro-batch are taken in time order, so the result equals the batch fold if batches come in time order.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        queue, count = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for t in sorted(pd.concat(list(frames))["t"]):
            queue = [x for x in queue if x >= t - window] + [int(t)]
            if len(queue) >= k:
                queue, count = [], count + 1
        state.update((queue, count))
        yield pd.DataFrame({"src": [key[0]], "violations": [count]})

    return stream.groupBy("src").applyInPandasWithState(fold, "src bigint, violations bigint", "queue array<bigint>, count bigint", "update", "NoTimeout")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run what is there to the end and return the sink's rows."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
