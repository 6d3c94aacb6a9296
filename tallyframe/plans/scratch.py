"""Where plans cut their lineage: checkpoints and tables in the folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset and all runs on one machine (tests) a fresh folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="tallyframe-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


_TABLES: dict[str, str] = {}


def table_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one, deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        _TABLES[app] = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _TABLES[app])
    return _TABLES[app]


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which later plans read column by column."""
    path = f"{table_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
