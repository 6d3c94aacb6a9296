"""Incremental ingest: files that arrive in a folder become records batch by batch.

The engine itself is batch; this is the streaming front of it. Each micro-batch of files is parsed and
laid out like a batch read, and appended to a table of records from which sides are reconciled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.grids import tables
from ..sources.files import OUT, parse_frames

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the records of new files under ``path`` to the Parquet table ``target``."""
    arriving = spark.readStream.format("binaryFile").schema(FILES).load(path).select("path", "content")

    def store(batch: DataFrame, number: int) -> None:
        cells = batch.mapInPandas(parse_frames(), OUT).where("warning is null")
        tables(cells).write.mode("append").parquet(target)

    writer = arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
