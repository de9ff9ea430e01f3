"""Runs a streaming query over what its source holds now, and gives its rows as a table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from tessarine.shared import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return work_path(spark, label)


def keep_state(spark: SparkSession) -> None:
    """State of processors is kept in RocksDB, which they need."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _writer(stream: DataFrame, mode: str, out: str):
    spark = stream.sparkSession
    keep_state(spark)
    return stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "log"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a stream up to now, through a Parquet sink. Update and complete modes keep each batch's rows."""
    out = scratch(stream.sparkSession, "sink")
    _writer(stream, mode, out).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_idle(stream: DataFrame, mode: str = "append", poll_seconds: float = 0.3) -> DataFrame:
    """The same for state on processing time, which runs batches without end: it stops after the first one without input."""
    out = scratch(stream.sparkSession, "sink")
    query = _writer(stream, mode, out).trigger(processingTime="0 seconds").start()
    while query.isActive and not any(p["numInputRows"] == 0 for p in query.recentProgress):
        time.sleep(poll_seconds)
    if query.exception() is not None:
        raise query.exception()
    query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_windows(stream: DataFrame) -> tuple[DataFrame, int]:
    """Rows of windows that the watermark has closed, and how many input rows came too late for theirs."""
    out = scratch(stream.sparkSession, "sink")
    query = _writer(stream, "append", out).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema).parquet(out), late
