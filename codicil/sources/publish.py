"""Writing many files by manifest: staged first, published once the manifest is whole.

Tasks write files under a staging folder beside their targets; what they wrote is a
table, the manifest, which Spark's own commit makes whole or not at all. Publishing
moves each staged file to its target and may be repeated: a file that was moved already
is known by its size and digest. So a task, an executor or the driver can be lost at any
point, and `recover` ends the job: it publishes what has a manifest and removes what has
none. Nothing is left in target folders by lost attempts, since all they wrote lies under
the staging folder.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codicil.sources import shared, stores

MANIFEST, STAGING, COMMITTED = "manifest", "staging", "committed"


class Conflict(FileExistsError):
    """A target that is there already."""


def _common_folder(low: str, high: str) -> str:
    """The folder that all paths between two lie under."""
    return os.path.commonprefix([low, high]).rpartition("/")[0] or "/"


def _kept(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "content")


def stage(rows: DataFrame, job: str, force: bool = False, staging: str | None = None) -> DataFrame:
    """Write rows (path, content, ...) to the staging folder and the manifest to the job's; gives the manifest.

    The manifest has all columns but content, and part, size, sha256. A row with null
    content or path has no part and writes no file. Without force a target that exists
    is a Conflict. Repeated paths are written each, and the last to be published stays.
    """
    spark = rows.sparkSession
    if staging is None:
        ends = rows.where("content IS NOT NULL AND path IS NOT NULL").selectExpr("min(path) AS low", "max(path) AS high").first()
        staging = f"{_common_folder(ends['low'], ends['high'])}/.codicil-{uuid.uuid4().hex[:12]}" if ends["low"] is not None else ""
    spark.createDataFrame([(staging,)], "folder string").write.mode("overwrite").parquet(f"{job}/{STAGING}")
    names = [f.name for f in rows.schema if f.name != "content"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A name of its own for each attempt: two attempts of a task never write one file.
        attempt, n = uuid.uuid4().hex, 0
        for batch in batches:
            parts, sizes, digests = [], [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if path is None or not content.is_valid:
                    parts.append(None), sizes.append(None), digests.append(None)
                    continue
                if not force and _kind(path) is not None:
                    raise Conflict(f"{path} exists already; force overwrites")
                parts.append(f"{staging}/{attempt}-{n}")
                n += 1
                store, inner = stores.opened(parts[-1])
                if n == 1:
                    store.make_folder(inner.rpartition("/")[0])
                data = content.as_buffer()
                store.write(inner, data)
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(parts, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*names, "part", "size", "sha256"])

    written = rows.select(*names, "content").mapInArrow(write, _kept(rows) + ", part string, size bigint, sha256 string")
    written.write.parquet(f"{job}/{MANIFEST}")
    return spark.read.parquet(f"{job}/{MANIFEST}")


def _kind(path: str) -> str | None:
    store, inner = stores.opened(path)
    return store.kind(inner)


def _is(path: str, size: int, sha256: str) -> bool:
    store, inner = stores.opened(path)
    if store.kind(inner) != "file" or store.size(inner) != size:
        return False
    found = hashlib.sha256()
    with store.reader(inner) as f:
        while block := f.read(1 << 20):
            found.update(block)
    return found.hexdigest() == sha256


def move(part: str, path: str, size: int, sha256: str) -> str:
    """Publish one file: `moved`, or `there` if an earlier try moved it. A file that is neither staged nor published is an error."""
    store, staged = stores.opened(part)
    if store.kind(staged) is None:
        if _is(path, size, sha256):
            return "there"
        raise FileNotFoundError(f"{path}: neither staged as {part} nor published")
    _, target = stores.opened(path)
    store.make_folder(target.rpartition("/")[0])
    store.move(staged, target)
    return "moved"


def publish(spark: SparkSession, job: str) -> DataFrame:
    """Move what the manifest names, mark the job committed, remove the staging folder. May be repeated; gives the manifest."""
    manifest = spark.read.parquet(f"{job}/{MANIFEST}")
    if not shared.exists(spark, f"{job}/{COMMITTED}"):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [move(*(batch.column(c)[i].as_py() for c in ("part", "path", "size", "sha256"))) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["done"])

        todo = manifest.where("part IS NOT NULL").select("part", "path", "size", "sha256")
        counts = {r["done"]: r["count"] for r in todo.mapInArrow(run, "done string").groupBy("done").count().collect()}
        spark.createDataFrame([(counts.get("moved", 0), counts.get("there", 0))], "moved bigint, there bigint").write.mode("overwrite").parquet(f"{job}/{COMMITTED}")
    _remove_staging(spark, job)
    return manifest


def _remove_staging(spark: SparkSession, job: str) -> None:
    for r in spark.read.parquet(f"{job}/{STAGING}").collect():  # one row
        if r["folder"] and _kind(r["folder"]) == "folder":
            store, inner = stores.opened(r["folder"])
            store.remove(inner)


def recover(spark: SparkSession, job: str) -> str:
    """End a job that was left: `committed` if its manifest is whole, else `rolled back`, with nothing written."""
    if shared.exists(spark, f"{job}/{MANIFEST}/_SUCCESS"):
        publish(spark, job)
        return "committed"
    if shared.exists(spark, f"{job}/{STAGING}"):
        _remove_staging(spark, job)
    shared.delete(spark, job)
    return "rolled back"


def write(rows: DataFrame, force: bool = False, job: str | None = None) -> DataFrame:
    """Write rows (path, content, ...), each to its own file; gives the manifest. A job that fails leaves no target changed."""
    spark = rows.sparkSession
    job = job or shared.path(spark, "publish")
    try:
        stage(rows, job, force)
    except BaseException:
        recover(spark, job)
        raise
    return publish(spark, job)
