"""Writing containers: the fixtures of tests and queries. Shares no code with the reading side but the ciphers."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions import kernels

KEY = b"0123456789abcdefABCDEFGH"
IDS = {"none": 0, "ofb": 1, "cfb64": 2}
#: Bytes of payloads that are sealed together.
TOGETHER = 2 << 20


def stored(data: bytes) -> bytes:
    """A zlib stream of stored blocks, whose size follows from the data's: 2 + 5 for each 65,535 bytes begun + n + 4."""
    parts = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
    blocks = (struct.pack("<BHH", i == len(parts) - 1, len(p), len(p) ^ 0xFFFF) + p for i, p in enumerate(parts))
    return b"\x78\x01" + b"".join(blocks) + zlib.adler32(data).to_bytes(4, "big")


def pdf(payloads: list[bytes], declared: list[int | None] | None = None, lock: str = "/Encrypt 9 0 R", flate: bool = True) -> tuple[bytes, list[tuple[int, int]]]:
    """A document with one stream object for each payload, and the payloads' ranges, closing line end included."""
    out, ranges = bytearray(b"%PDF-1.5\r"), []
    for i, data in enumerate(payloads):
        size = len(data) if declared is None or declared[i] is None else declared[i]
        out += b"%d 0 obj\r<<%s/Length %d>>\rstream\r\n" % (i + 1, b"/Filter/FlateDecode " if flate else b"", size)
        ranges.append((len(out), len(out) + len(data) + 1))
        out += data + b"\rendstream\rendobj\r"
    out += b"trailer\r<</Size %d /Root 1 0 R %s>>\rstartxref\r0\r%%%%EOF" % (len(payloads) + 1, lock.encode())
    return bytes(out), ranges


def container(sections: list[tuple[int, bytes]], version: bytes = b"\x00\x00\x03\x00", labelled: bool = False, gap: int = 0, tail: bytes = b"") -> bytes:
    """Header, table and sections (type, bytes) one after the other."""
    start = 31 + 17 * len(sections)
    head = bytearray(start)
    head[:11] = b"Founder CEB"
    head[11] = 0x20 if labelled else 0
    head[12 : 12 + len(version)] = version
    if len(version) <= 4:
        struct.pack_into("<I", head, 16, 17 * len(sections))
    struct.pack_into("<HH", head, 20, len(sections), 1)
    at, body = start + gap, bytearray(gap)
    for i, (ty, data) in enumerate(sections):
        struct.pack_into("<IIB", head, 31 + 17 * i, at, len(data), ty)
        at += len(data)
        body += data
    return bytes(head + body) + tail


def seal(document: bytes, ranges: list[tuple[int, int]], mode: str = "cfb64", key: bytes = KEY, blob: bytes | None = None, algorithm: int | None = None, types: tuple[int, ...] = (3, 4, 5, 16), **options) -> bytes:
    """Encrypt the payload ranges, then the whole, and wrap it up."""
    return wrap(document, ranges, kernels.many(kernels.ENCRYPT[mode], key, [document[s:e] for s, e in ranges]), mode, key, blob, algorithm, types, **options)


def wrap(document: bytes, ranges: list[tuple[int, int]], encrypted: list[bytes], mode: str, key: bytes = KEY, blob: bytes | None = None, algorithm: int | None = None, types: tuple[int, ...] = (3, 4, 5, 16), **options) -> bytes:
    """The container of a document whose payloads are encrypted already."""
    body = bytearray(document)
    for (s, e), new in zip(ranges, encrypted, strict=True):
        body[s:e] = new
    number = IDS[mode] if algorithm is None else algorithm
    parts = [kernels.apply_body(key[:16], bytes(body)).tobytes(), key[:16], key if blob is None else blob, struct.pack("<I", number)]
    return container(list(zip(types, parts, strict=True)), **options)


def _sealer(plain_blocks: bool, wrong_types: bool, flate: bool):
    types = (2, 7, 1, 34) if wrong_types else (3, 4, 5, 16)

    def run(payloads: pa.Array, modes: pa.Array, shift: pa.Array, keys: pa.Array, blobs: pa.Array, flags: pa.Array) -> pa.Array:
        rows = list(zip(payloads, modes.to_pylist(), shift.to_pylist(), keys.to_pylist(), blobs.to_pylist(), flags.to_pylist(), strict=True))
        done, part, held = [], [], 0
        for row in rows:
            part.append((row[0].as_py(), *row[1:]))
            held += sum(len(t or b"") for t in part[-1][0] or [])
            if held >= TOGETHER:
                done.append(seal_all(part))
                part, held = [], 0
        return pa.concat_arrays([*done, seal_all(part)])

    def seal_all(given: list[tuple]) -> pa.Array:
        rows, parts = [], {}
        for texts, mode, more, key, _, _ in given:
            packed = [t or b"" for t in texts or []] if not flate else [stored(t or b"") if plain_blocks else zlib.compress(t or b"", 6) for t in texts or []]
            document, ranges = pdf(packed, [len(p) + more for p in packed] if more else None, flate=flate)
            rows.append((bytearray(document), ranges, mode, key))
            parts.setdefault(mode, []).extend((key, document[s:e]) for s, e in ranges)
        # The payloads of a mode are encrypted together, whatever their keys.
        done = {m: iter(kernels.encrypt_parts(m, [k for k, _ in p], [x for _, x in p])) for m, p in parts.items()}
        for body, ranges, mode, _ in rows:
            for s, e in ranges:
                body[s:e] = next(done[mode])
        sealed_ = kernels.apply_bodies([k[:16] for *_, k in rows], [bytes(b) for b, *_ in rows])
        out = []
        for body, (_, _, mode, key), (*_, blob, flag) in zip(sealed_, rows, given, strict=True):
            cut = [body, key[:16], key if blob is None else blob, struct.pack("<I", IDS[mode] | flag)]
            out.append(container(list(zip(types, cut, strict=True))))
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()


def sealed(
    rows: DataFrame, payloads: Column, mode: Column | str, shift: Column | int = 0, plain_blocks: bool = False, wrong_types: bool = False, key: Column | bytes = KEY, blob: Column | None = None, flags: Column | int = 0, flate: bool = True
) -> DataFrame:
    """rows with a container `content` of the payloads (array of strings or binaries), and `length`.

    shift is added to the declared lengths; plain_blocks stores instead of deflating;
    wrong_types gives every section a type code that is not its role's. key is each
    container's key of 24 bytes, blob what stands in its place, flags are added to the
    algorithm id. flate=False takes payloads as they are.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    blob = F.lit(None).cast("binary") if blob is None else blob
    content = _sealer(plain_blocks, wrong_types, flate)(payloads.cast("array<binary>"), as_column(mode), as_column(shift).cast("int"), as_column(key), blob, as_column(flags).cast("bigint"))
    return rows.withColumn("content", content).withColumn("length", F.length("content").cast("bigint"))
