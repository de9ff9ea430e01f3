"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the session's checkpoint folder; a local one of our own only where the master is local."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        there = sc._jsc.sc().getCheckpointDir()
        if there.isEmpty():
            if not is_local(spark):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
            there = sc._jsc.sc().getCheckpointDir()
        base = there.get()
    return base.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what was written there goes when the driver's Python ends, if not freed before."""
    if not _made:
        atexit.register(_clear, spark)
    path = f"{shared_dir(spark)}/tessarine-{uuid.uuid4().hex[:12]}-{label}"
    _made.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _clear(spark: SparkSession) -> None:
    try:
        for path in list(_made):
            _delete(spark, path)
    except Exception:  # the session is already gone: the folder's owner clears it
        return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._tessarine_path = path
    return kept


def free(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads."""
    for kept in tables:
        path = getattr(kept, "_tessarine_path", None)
        if path in _made:
            _delete(kept.sparkSession, path)
            _made.discard(path)
