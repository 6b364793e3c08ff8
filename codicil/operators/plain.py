"""A second reader of containers, in plain serial Python, by rules of its own.

It tells sections by their lengths alone and takes the first of several, finds the
encryption reference however far its end is, and shares no parsing and no cipher
code with the other one. It is slow and is there to check the other against.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codicil.functions import kernels as fixed

#: Bytes of documents that are handed on together.
TOGETHER = 2 << 20
ROLE_LENGTHS = {"body_key": (16,), "key_blob": (24, 64), "algorithm": (4,)}


def sections(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the table's entries."""
    if data[:11] != b"Founder CEB":
        raise ValueError("not a container")
    number = lambda at, size: int.from_bytes(data[at : at + size], "little")
    return [(number(31 + 17 * i, 4), number(35 + 17 * i, 4)) for i in range(number(20, 2))]


def roles(found: list[tuple[int, int]]) -> dict[str, int]:
    """Index of each role's section: the longest is the body, the others go by their lengths; the first of equal ones."""
    body = max(range(len(found)), key=lambda i: (found[i][1], -i))
    out = {"body": body}
    for role, lengths in ROLE_LENGTHS.items():
        for i, (_, size) in enumerate(found):
            if i != body and size in lengths:
                out[role] = i
                break
    return out


def first_layer(key: bytes, data: bytes) -> bytes:
    """The body cipher, byte after byte, begun anew each block."""
    out = bytearray()
    for start in range(0, len(data), fixed.BODY_BLOCK):
        box, j = bytearray(range(256)), 0
        for i in range(256):
            j = (j + box[i] + (key[i % 16] | fixed.KEY_MASK)) % 256
            box[i], box[j] = box[j], box[i]
        j = 0
        for i, byte in enumerate(data[start : start + fixed.BODY_BLOCK], 1):
            at = i % 256
            held = box[at]
            j = (j + held) % 256
            box[at] = box[j]
            box[j] = box[held]
            out.append(byte ^ box[(box[at] + box[j]) % 256])
    return bytes(out)


def _bits(value: int, width: int) -> list[int]:
    return [value >> (width - 1 - i) & 1 for i in range(width)]


def _value(bits: list[int]) -> int:
    return int("".join(map(str, bits)), 2)


_START = [row + 8 * column for row in (2, 4, 6, 8, 1, 3, 5, 7) for column in range(7, -1, -1)]


def _round_keys(key: bytes) -> list[list[int]]:
    bits = _bits(int.from_bytes(key, "big"), 64)
    chosen = [bits[i - 1] for i in fixed.KEY_FIRST]
    low, high, out = chosen[:28], chosen[28:], []
    for n in fixed.ROTATIONS:
        low, high = low[n:] + low[:n], high[n:] + high[:n]
        both = low + high
        out.append([both[i - 1] for i in fixed.KEY_SECOND])
    return out


def _mixed(half: list[int], key: list[int]) -> list[int]:
    out = []
    for i in range(8):
        six = [half[(4 * i - 1 + k) % 32] ^ key[6 * i + k] for k in range(6)]
        line = fixed.BOXES[i].split()[2 * six[0] + six[5]]
        out += _bits(int(line[_value(six[1:5])], 16), 4)
    return [out[i - 1] for i in fixed.SPREAD]


def _once(block: list[int], keys: list[list[int]]) -> list[int]:
    block = [block[i - 1] for i in _START]
    low, high = block[:32], block[32:]
    for key in keys:
        low, high = high, [a ^ b for a, b in zip(low, _mixed(high, key), strict=True)]
    out = [0] * 64
    for place, bit in zip(_START, high + low, strict=True):
        out[place - 1] = bit
    return out


def block_cipher(key: bytes, block: bytes) -> bytes:
    """One block by encrypting, decrypting and encrypting again."""
    key = key if len(key) == 24 else key + key[:8]
    bits = _bits(int.from_bytes(block, "big"), 64)
    for i, backwards in ((0, False), (8, True), (16, False)):
        keys = _round_keys(key[i : i + 8])
        bits = _once(bits, keys[::-1] if backwards else keys)
    return _value(bits).to_bytes(8, "big")


def payload(mode: int, key: bytes, data: bytes) -> bytes:
    """Decrypt a payload, in mode 1 by the output's feedback and in mode 2 by the text's; every 256 bytes it begins anew."""
    out = bytearray()
    for start in range(0, len(data) if mode else 0, fixed.WINDOW):
        feedback = key[:8]
        window = data[start : start + fixed.WINDOW]
        for i in range(0, len(window), 8):
            pad = block_cipher(key, feedback)
            part = window[i : i + 8]
            out += bytes(a ^ b for a, b in zip(part, pad, strict=False))
            feedback = pad if mode == 1 else part
    return bytes(out) if mode else data


def unwrapped(blob: bytes) -> bytes:
    modulus, result = int(fixed.MODULUS and bytes.fromhex(fixed.MODULUS)[::-1].hex(), 16), 1
    base = int.from_bytes(blob[::-1], "big")
    for bit in bin(int(bytes.fromhex(fixed.EXPONENT)[::-1].hex(), 16))[2:]:
        result = result * result % modulus
        if bit == "1":
            result = result * base % modulus
    plain = result.to_bytes(64, "big")[::-1]
    return plain[4 : 4 + int.from_bytes(plain[:4], "little")]


def document(data: bytes) -> bytes:
    """The document in a container."""
    found = sections(data)
    place = roles(found)
    cut = {role: data[found[i][0] : found[i][0] + found[i][1]] for role, i in place.items()}
    pdf = bytearray(first_layer(cut["body_key"], cut["body"]))
    mode, key = int.from_bytes(cut.get("algorithm", b""), "little"), cut.get("key_blob", b"")
    if mode >> 31 or len(key) == 64:
        key = unwrapped(key)
    at = 0
    while (at := pdf.find(b"stream", at)) >= 0:
        end = pdf.find(b"endstream", at)
        if end < 0:
            break
        at += 6
        while at < end and pdf[at] in b"\r\n":
            at += 1
        pdf[at:end] = payload(mode & 0x7FFFFFFF, key, bytes(pdf[at:end]))
        at = end + 9
    lock = pdf.rfind(b"/Encrypt")
    if lock > 0 and (end := pdf.find(b"R", lock)) > 0:
        pdf[lock : end + 1] = b" " * (end + 1 - lock)
    return bytes(pdf)


def parse(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, role, idx, offset, len of the sections that play a role. A file that is no container gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(key).to_pylist(), batch.column(content), strict=True):
                try:
                    found = sections(data.as_py() or b"")
                except ValueError:
                    continue
                rows += [(k, role, i, *found[i]) for role, i in roles(found).items()] if found else []
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [batch.schema.field(key).type, pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], [key, "role", "idx", "offset", "len"])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, role string, idx int, offset bigint, len bigint")


def convert(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, pdf of containers; null for a file that is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            start = held = 0
            for i, data in enumerate(batch.column(content)):
                try:
                    out.append(document(data.as_py() or b""))
                except ValueError:
                    out.append(None)
                held += len(out[-1] or b"")
                # Documents are handed on as they come, so that a batch is not held twice.
                if held >= TOGETHER or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(start, len(out)), pa.array(out, pa.binary())], [key, "pdf"])
                    out, start, held = [], i + 1, 0

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, pdf binary")
