"""New container files as they arrive: the batch plan over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codicil.operators.decode import Factory
from codicil.plans.convert import conversion_report, convert
from codicil.sources.files import SCHEMA


def stream(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files of a directory as a stream (path, length, content); each file once."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(directory).select("path", "length", "content")


def convert_stream(files: DataFrame, target: str, checkpoint: str, strategy: str | Factory | None = None, available_now: bool = True) -> StreamingQuery:
    """Append reports and documents of new files to a Parquet table (path, report columns, pdf); exactly once by Spark's file sink."""
    converted = convert(files, strategy)
    rows = conversion_report(converted, "path", "decoded.pdf")
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
