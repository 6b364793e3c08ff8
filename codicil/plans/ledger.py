"""A ledger of runs: what was converted, with what outcome, so that a run takes up only what is new or failed.

The ledger is a folder of runs; a run is a published job (sources.publish), and its
manifest has a row for each file: path, digest of the content, options, output, status
code and error. A run counts once it is committed. What a lost driver left is ended when
the next run begins. The exit status is that of the last outcome of each file.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codicil.operators import report
from codicil.plans import convert as plan
from codicil.plans import outputs
from codicil.sources import publish, shared

COLUMNS = "path string, file string, digest string, options string, code int, error string, run string, at timestamp, part string, size bigint, sha256 string"


def _runs(spark: SparkSession, ledger: str) -> list[str]:
    fs, at = shared._fs(spark, f"{ledger}/runs")
    return sorted(s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else []


def read(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of committed runs."""
    done = [r for r in _runs(spark, ledger) if shared.exists(spark, f"{r}/{publish.COMMITTED}")]
    if not done:
        return spark.createDataFrame([], COLUMNS)
    return reduce(DataFrame.unionByName, [spark.read.schema(COLUMNS).parquet(*(f"{r}/{publish.MANIFEST}" for r in done))])


def latest(spark: SparkSession, ledger: str) -> DataFrame:
    """The last outcome of each file."""
    order = Window.partitionBy("file").orderBy(F.desc("at"), F.desc("run"))
    return read(spark, ledger).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def exit_status(spark: SparkSession, ledger: str) -> DataFrame:
    """code (the greatest, the exit code), any_failed, files over the last outcomes."""
    return latest(spark, ledger).agg(F.coalesce(F.max("code"), F.lit(report.OK)).alias("code"), F.coalesce(F.bool_or(F.col("code") == report.FAILED), F.lit(False)).alias("any_failed"), F.count(F.lit(1)).alias("files"))


def recover(spark: SparkSession, ledger: str) -> dict[str, str]:
    """End runs that were left: each run with `committed` or `rolled back`."""
    return {r: publish.recover(spark, r) for r in _runs(spark, ledger) if not shared.exists(spark, f"{r}/{publish.COMMITTED}")}


def todo(files: DataFrame, ledger: str, options: str = "") -> DataFrame:
    """files (path, content) that no committed run has converted, with `digest`: new paths, new contents, other options, or failed before."""
    done = read(files.sparkSession, ledger).where(F.col("code") != report.FAILED).select(F.col("file").alias("_file"), F.col("digest").alias("_digest"), F.col("options").alias("_options")).distinct()
    named = files.withColumn("digest", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    return named.join(done, (F.col("path") == F.col("_file")) & (F.col("digest") == F.col("_digest")) & (F.col("_options") == options), "left_anti")


def run(files: DataFrame, ledger: str, output: str | None = None, name: str | None = None, **options) -> DataFrame:
    """Convert what is to do of files (path, content), publish the documents, and enter the outcomes; gives this run's rows.

    output is a folder, or null for places beside the inputs. options go to
    plans.convert.convert. A run of a name that is committed already does nothing.
    """
    spark = files.sparkSession
    recover(spark, ledger)
    name = name or uuid.uuid4().hex[:12]
    job = f"{ledger}/runs/{name}"
    said = ",".join(f"{k}={v}" for k, v in sorted(options.items()))
    if not shared.exists(spark, f"{job}/{publish.COMMITTED}"):
        left = outputs.plan(todo(files, ledger, said), output, output is not None)
        done = plan.convert(left, **options)
        rows = done.select(
            F.col("output").alias("path"), F.col("path").alias("file"), "digest", F.lit(said).alias("options"), F.col("code").cast("int").alias("code"), F.col("error.code").alias("error"), F.lit(name).alias("run"),
            F.current_timestamp().alias("at"), F.col("decoded.pdf").alias("content"),
        )
        try:
            publish.stage(rows, job, force=True, staging=f"{output}/.codicil-{name}" if output else None)
        except BaseException:
            publish.recover(spark, job)
            raise
        publish.publish(spark, job)
    return spark.read.schema(COLUMNS).parquet(f"{job}/{publish.MANIFEST}")


def run_stream(files: DataFrame, ledger: str, checkpoint: str, output: str | None = None, available_now: bool = True, **options) -> StreamingQuery:
    """The same for a stream of files: each micro-batch is a run of its own, and one that is repeated does nothing twice."""

    def batch(df: DataFrame, number: int) -> None:
        run(df, ledger, output, f"batch-{number}", **options)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
