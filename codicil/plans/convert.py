"""From files to documents and reports: parse, resolve, decode, report. No shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.bytesx import le_uint, piece
from codicil.operators import decode, report, roles, sections


def inspect(files: DataFrame) -> DataFrame:
    """Parsed and resolved containers; nothing is decoded."""
    return roles.resolve(sections.parse(files))


def inspect_heads(heads: DataFrame) -> DataFrame:
    """The same of files of which header, table and small sections were read (sources.containers.heads), with algorithm_id and key from them."""
    found = roles.resolve(sections.parse(heads, "head", "length"))
    own = lambda role: F.expr(f"get(filter(small, s -> s.idx = {role}.idx), 0).data")
    return found.withColumn("algorithm_id", F.when(F.col("error").isNull(), F.coalesce(le_uint(own("algorithm")), F.lit(0)))).withColumn("key", own("body_key"))


def convert(files: DataFrame, strategy: str | decode.Factory | None = None, verify: bool = True, exact_name: bool = False, bounds: str = "keyword") -> DataFrame:
    """files (path, content, ...) with report columns and `decoded.pdf`; a file that can't be read has `error` instead.

    strategy: None follows each file's algorithm id; "none", "ofb" or "cfb64" forces a
    mode; a callable makes a decode.Strategy of the file key. verify=False leaves the
    self-check out. exact_name reads /Length only where the name ends there. bounds: how payloads' bounds are found, see decode.decode.
    """
    return report.with_report(decode.decode(inspect(files), strategy, verify, exact_name, bounds=bounds))


def conversion_report(converted: DataFrame, *keys: str) -> DataFrame:
    """One flat row a file, without its bytes."""
    d = "decoded."
    return converted.select(
        *keys, "code", "clean", "error", "guessed", sections.version_text(F.col("version")).alias("version"), F.size("sections").alias("n_sections"), "algorithm_id",
        F.col(d + "strategy").alias("strategy"), F.col(d + "forced").alias("forced"), F.col(d + "key_source").alias("key_source"), F.col(d + "key_len").alias("key_len"),
        F.length(d + "pdf").alias("body_len"), F.size(d + "streams").alias("n_streams"), F.col(d + "stream_bytes").alias("stream_bytes"), F.col(d + "encrypt").alias("encrypt"),
        F.col(d + "check.flate_streams").alias("flate_streams"), F.col(d + "check.flate_ok").alias("flate_ok"), F.col(d + "check.inflated_bytes").alias("inflated_bytes"),
        F.col(d + "check.bad_total").alias("bad_total"), F.col(d + "check.mismatch_total").alias("mismatch_total"), "layout_complaints", "notes", "complaints",
    )


#: What a binary column can hold.
LARGEST = (1 << 31) - 1 - (1 << 16)


def _inflate(limit: int):
    import zlib

    kind = pa.struct([("data", pa.binary()), ("reason", pa.string())])

    def run(data: pa.Array) -> pa.Array:
        out = []
        for x in data:
            x = x.as_py()
            if x is None:
                out.append(None)
                continue
            z = zlib.decompressobj()
            try:
                plain = z.decompress(x, limit)
                reason = None if z.eof else "too large for a row" if len(plain) >= limit else "truncated deflate stream" if x else "empty stream"
            except zlib.error as e:
                reason = str(e)
            out.append({"data": plain if reason is None else None, "reason": reason})
        return pa.array(out, kind)

    return F.arrow_udf(run, "struct<data:binary,reason:string>").asNondeterministic()


def inflated(data: Column, limit: int = LARGEST) -> Column:
    """Struct (data, reason) of a zlib stream: its plain bytes, or why there are none; null for null."""
    return _inflate(limit)(data)


def inflated_pieces(payloads: DataFrame, *keys: str, size: int = 1 << 20) -> DataFrame:
    """keys, piece (from 0), data, reason: the plain bytes of zlib streams (column raw) in rows of at most `size` bytes.

    For payloads that inflate beyond a row: a worker holds one piece of output at a time.
    A payload's last row has `reason`: null if the stream was whole, else why it ended;
    pieces before it are what was inflated till then. A null payload has no row, one that
    inflates to nothing or to no byte before it fails has one row without data.
    """
    import zlib
    from collections.abc import Iterator

    kinds = {f.name: f for f in payloads.select(*keys).schema}
    ddl = ", ".join(f"`{k}` {kinds[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("raw")[i]
                if not raw.is_valid:
                    continue
                own = [batch.column(k).slice(i, 1) for k in keys]
                held, piece, reason, z = b"", 0, None, zlib.decompressobj()
                rest: bytes | memoryview = memoryview(raw.as_buffer())

                def row(data: bytes | None, why: str | None, last: bool, own=own) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([*own, pa.array([piece], pa.int32()), pa.array([data], pa.binary()), pa.array([why], pa.string()), pa.array([last])], [*keys, "piece", "data", "reason", "last"])

                try:
                    while not z.eof:
                        out = z.decompress(rest, size)
                        rest = z.unconsumed_tail
                        if not out:
                            reason = "truncated deflate stream" if len(raw.as_buffer()) else "empty stream"
                            if not z.eof:
                                break
                            reason = None
                        elif held:
                            yield row(held, None, False)
                            piece, held = piece + 1, out
                        else:
                            held = out
                except zlib.error as e:
                    reason = str(e)
                yield row(held or None, reason, True)

    return payloads.select(*keys, "raw").mapInArrow(run, f"{ddl}, piece int, data binary, reason string, last boolean")


def payloads(converted: DataFrame, *keys: str, inflate: bool = True, limit: int = LARGEST) -> DataFrame:
    """One row a payload: keys, idx, number, generation, flate, boundary, raw, data, reason.

    data is the inflated payload, null where that fails; `reason` says why, and tells a
    payload of over `limit` bytes, by default what a row can hold, from one that does
    not inflate. Both are null for a payload that is not deflated.
    """
    names = [k.split(".")[-1] for k in keys]
    rows = converted.select(*keys, F.col("decoded.pdf").alias("_pdf"), F.explode("decoded.streams").alias("_s"))
    rows = rows.select(*names, "_s.idx", "_s.number", "_s.generation", "_s.flate", "_s.boundary", piece(F.col("_pdf"), F.col("_s.start"), F.col("_s.end") - F.col("_s.start")).alias("raw"))
    return rows.withColumn("_i", inflated(F.when(F.col("flate"), F.col("raw")), limit)).select("*", "_i.data", "_i.reason").drop("_i") if inflate else rows
