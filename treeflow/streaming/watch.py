"""Files as a stream: each micro-batch of new files runs through a program."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.execute import execute
from ..plans.graph import RuleGraph
from ..plans.model import Options


def units_stream(spark: SparkSession, folder: str, extension: str, files_per_batch: int = 10_000) -> DataFrame:
    """path, content of files as they appear under folder."""
    read = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").option("maxFilesPerTrigger", files_per_batch)
    return read.schema("value string").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def run_stream(units: DataFrame, graph: RuleGraph, options: Options, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Executes the program over every micro-batch and hands its summary to sink(summary, batch id).

    Rules that reach other files see the files of their own batch.
    """
    writer = units.writeStream.foreachBatch(lambda batch, k: sink(execute(batch, graph, options), k)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
