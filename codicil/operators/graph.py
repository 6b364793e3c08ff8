"""Documents' objects as a graph: references as edges, and what roots reach."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions import pdfbytes
from codicil.sources import shared


def edges(pdfs: DataFrame) -> DataFrame:
    """file, number, name, target of every reference in the objects' dictionaries of documents (file, pdf).

    Of an object with several definitions the last one counts, as in a document that was
    updated. Generations above 0 count as the same object. Payloads are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, pdf in zip(batch.column("file"), batch.column("pdf"), strict=True):
                rows = [(number, name, target) for number, found in pdfbytes.dictionaries(pdf.as_py() or b"").items() for name, target, _ in pdfbytes.references(found)]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), pa.string()), *(pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True))], ["file", "number", "name", "target"])

    return pdfs.select("file", "pdf").mapInArrow(run, "file string, number bigint, name string, target bigint")


def objects(pdfs: DataFrame) -> DataFrame:
    """file, number of every object that a document defines."""
    rows = pdfs.select("file", F.explode(F.arrow_udf(_numbers, "array<bigint>")("pdf")).alias("number"))
    return rows.distinct()


def _numbers(pdf: pa.Array) -> pa.Array:
    return pa.array([sorted(pdfbytes.dictionaries(p.as_py() or b"")) for p in pdf], pa.list_(pa.int64()))


def reach(links: DataFrame, roots: DataFrame, key: tuple[str, ...] = ("file",), node: str = "number", target: str = "target") -> DataFrame:
    """key, node, steps of all nodes that roots (key, node) reach along links (key, node, target), the roots with 0 steps.

    Semi-naive: each round joins only what the round before found first, and leaves out
    what is known; a round's finds are written, so that lost executors cost no earlier
    round. Cycles end, since nothing is found twice. Rounds are as many as the longest
    of the shortest ways. Null nodes reach nothing.
    """
    own = [*key, node]
    edges_ = shared.save(links.select(*own, F.col(target).alias("_target")).where(F.col(node).isNotNull() & F.col("_target").isNotNull()).distinct(), "edges")
    frontier = shared.save(roots.select(*own).where(F.col(node).isNotNull()).distinct().withColumn("steps", F.lit(0)), "frontier")
    parts = [frontier]
    while not parts[-1].isEmpty():
        known = parts[0]
        for p in parts[1:]:
            known = known.unionAll(p)
        found = parts[-1].join(edges_, own).select(*key, F.col("_target").alias(node)).distinct()
        parts.append(shared.save(found.join(known.select(*own), own, "left_anti").withColumn("steps", F.lit(len(parts))), "frontier"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    out = shared.save(whole, "reach")
    shared.drop(edges_, *parts)
    return out


def classified(pdfs: DataFrame) -> DataFrame:
    """file, number, class of every object: page for what pages' contents reach, font for what fonts reach, else misc; page goes first.

    /Parent is followed by none of them, for it leads back to everything.
    """
    links = shared.save(edges(pdfs), "references")
    down = links.where("name <> 'Parent'")
    page = reach(down, links.where("name = 'Contents'").select("file", F.col("target").alias("number"))).select("file", "number", F.lit("page").alias("_page"))
    font = reach(down, links.where("name LIKE 'FontFile%' OR name = 'Font' OR name = 'FontDescriptor'").select("file", F.col("target").alias("number"))).select("file", "number", F.lit("font").alias("_font"))
    joined = objects(pdfs).join(page, ["file", "number"], "left").join(font, ["file", "number"], "left")
    return joined.select("file", "number", F.coalesce("_page", "_font", F.lit("misc")).alias("class"))
