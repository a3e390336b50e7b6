"""Results of newly landed records: a file stream, run to its present end, that writes to several sinks, each batch exactly once.

A batch's results are computed once and written aside, then each sink takes its columns into a folder named by the stream and the batch's number, which
replaces what an interrupted run of the same batch left there. Spark repeats a batch under its number until all sinks have it, so a crash between two sinks
changes nothing, and no batch reads what earlier ones wrote. Only where another stream wrote to the same target are its keys left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folders(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def landed(spark: SparkSession, target: str, sink: str) -> DataFrame:
    """All rows of a sink."""
    return spark.read.option("basePath", f"{target}/{sink}").parquet(f"{target}/{sink}").drop("stream", "batch")


def incremental(spark: SparkSession, source: DataFrame, key: str, job: Callable[[DataFrame], DataFrame], sinks: dict[str, list[str]], target: str, checkpoint: str, stream: str) -> None:
    """Runs the stream to its present end. job makes the results of a batch in one pass; sinks: name -> its columns, the key among them. `stream` names the
    checkpoint: the same name with a new checkpoint would replace the batches of the old one."""
    names = list(sinks)

    def land(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        for other in folders(own, f"{target}/{names[-1]}"):  # the last sink, as it has what all have
            if other != f"stream={stream}":
                batch = batch.join(own.read.parquet(f"{target}/{names[-1]}/{other}").select(key), key, "left_anti")
        aside = f"{target}/_aside/{stream}"
        job(batch).write.mode("overwrite").parquet(aside)
        both = own.read.parquet(aside)
        for name in names:
            both.select(*sinks[name]).write.mode("overwrite").parquet(f"{target}/{name}/stream={stream}/batch={number}")

    source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compacted(spark: SparkSession, target: str, sink: str, to: str, files: int | None = None) -> DataFrame:
    """All batches of a sink as one table of few files, in another folder; they stay as they are, since the stream may repeat its last one."""
    rows = landed(spark, target, sink)
    (rows.coalesce(files) if files else rows).write.mode("overwrite").parquet(to)
    return spark.read.schema(rows.schema).parquet(to)
