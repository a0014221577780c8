"""Following a stream into a folder, each batch once: a batch is a folder named by its number, so a batch that is run again after a crash takes its own place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def into(stream: DataFrame, folder: str, checkpoint: str, forever: bool = False, each: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "update") -> StreamingQuery:
    """Writes what each(batch, number) makes of each batch to folder/batch=<number>: all that is there now, or as it comes."""

    def write(batch: DataFrame, number: int) -> None:
        made = each(batch, number) if each else batch
        made.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    how = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (how.trigger(processingTime="1 second") if forever else how.trigger(availableNow=True)).start()


def written(spark: SparkSession, folder: str) -> DataFrame:
    """What the batches so far have written, with their numbers."""
    return spark.read.parquet(folder)


def new_artifacts(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """ST6: a stream (doc_id, page, kind, content) of the artifacts <folder>/<doc>/p<page>.<kind>.json; its checkpoint knows which have been read, so a rerun takes the new ones alone."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", f"p*.{kind}.json").load(f"{folder}/*/")
    path = F.col("_metadata.file_path")
    doc = F.url_decode(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1))
    page = F.regexp_extract(path, r"/p(\d+)\.[^/]+$", 1).cast("int")
    return files.select(doc.alias("doc_id"), page.alias("page"), F.lit(kind).alias("kind"), F.col("value").alias("content"))
