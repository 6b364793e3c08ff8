"""Finding payloads, object headers, declared lengths and the trailer's reference in PDF bytes."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

# Fixed values of the file format.
SPACE = rb"[\x00\t\n\x0c\r ]"
OPEN, CLOSE = b"stream", b"endstream"
LOCKED = b"/Encrypt"
REFERENCE_REACH = 64
TAIL = 2048

_HEADER = re.compile(rb"(?<![0-9])([0-9]+)" + SPACE + rb"+([0-9]+)" + SPACE + rb"+obj")
_SKIP = re.compile(SPACE + rb"*")
_NUMBER = re.compile(rb"[0-9]+")
_LINE_ENDS = re.compile(rb"[\r\n]*")
_CLOSING = re.compile(rb"[\r\n]{0,2}(endstream)")
_LENGTH = re.compile(rb"/Length" + SPACE + rb"*([0-9]+)")
_REST = re.compile(SPACE + rb"*([0-9]+)" + SPACE + rb"*R")


@dataclass(frozen=True)
class Payload:
    """One stream object: its bytes, its dictionary's, and the object it belongs to."""

    idx: int
    start: int
    end: int
    dict_start: int
    dict_end: int
    number: int | None = None
    generation: int | None = None

    @property
    def size(self) -> int:
        return self.end - self.start


def payload_ranges(pdf: bytes) -> list[tuple[int, int, int]]:
    """(keyword, start, end) of each payload in file order, by keywords alone."""
    out, at = [], pdf.find(OPEN)
    while at >= 0:
        if pdf[at - 1 : at] == b"d":
            at = pdf.find(OPEN, at + len(OPEN))
            continue
        end = pdf.find(CLOSE, at)
        if end < 0:
            break
        start = _LINE_ENDS.match(pdf, at + len(OPEN)).end()
        out.append((at, min(start, end), end))
        at = pdf.find(OPEN, end + len(CLOSE))
    return out


def starts(pdf: bytes, keyword: int, end: int) -> tuple[int, int, list[int]]:
    """Where a payload may begin: after all line ends (the scan's rule), after the one line end that the PDF standard has, and all of them, 0, 1 and 2 bytes on included."""
    first = keyword + len(OPEN)
    last = min(_LINE_ENDS.match(pdf, first).end(), end)
    one = min(first + (2 if pdf[first : first + 2] == b"\r\n" else 1 if pdf[first : first + 1] in (b"\r", b"\n") else 0), last)
    return last, one, list(dict.fromkeys([last, one, *(first + k for k in (2, 1, 0) if first + k <= last)]))


def ranges_by_length(pdf: bytes, declared: dict[int, int]) -> list[tuple[int, int, int]]:
    """payload_ranges, but a payload ends at the closing keyword that its declared length leads to, where it leads to one.

    declared has lengths by the place of the opening keyword. Keywords inside such a payload are its bytes.
    """
    out, at = [], pdf.find(OPEN)
    while at >= 0:
        if pdf[at - 1 : at] == b"d":
            at = pdf.find(OPEN, at + len(OPEN))
            continue
        end = pdf.find(CLOSE, at)
        if end < 0:
            break
        length = declared.get(at)
        if length is not None and length < len(pdf):
            _, one, places = starts(pdf, at, len(pdf))
            for start in dict.fromkeys([one, *places]):
                m = _CLOSING.match(pdf, start + length)
                if m:
                    end = m.start(1)
                    break
        start = _LINE_ENDS.match(pdf, at + len(OPEN)).end()
        out.append((at, min(start, end), end))
        at = pdf.find(OPEN, end + len(CLOSE))
    return out


def object_headers(pdf: bytes) -> list[tuple[int, int, int]]:
    """(end, number, generation) of each `N G obj`, payload bytes included."""
    found = ((m.end(), _number(m[1], 32), _number(m[2], 16)) for m in _HEADER.finditer(pdf))
    return [h for h in found if h[1] is not None and h[2] is not None]


def live_headers(pdf: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Headers whose keyword is in no payload; ranges are disjoint and in order."""
    starts = [s for s, _ in ranges]

    def inside(at: int) -> bool:
        k = bisect_right(starts, at)
        return k > 0 and at < ranges[k - 1][1]

    return [h for h in object_headers(pdf) if not inside(h[0] - 3)]


def scan(pdf: bytes) -> list[Payload]:
    """Payloads with the last live header at or before each one's keyword."""
    return attributed(pdf, payload_ranges(pdf))


def scan_by_length(pdf: bytes, exact_name: bool = False) -> list[Payload]:
    """The same with ends by declared lengths, until these find no more keywords inside payloads."""
    found = scan(pdf)
    while True:
        objects = first_objects(pdf, found)
        lengths = {p.dict_end: declared_length(pdf, p, objects, exact_name) for p in found}
        again = attributed(pdf, ranges_by_length(pdf, {k: n for k, n in lengths.items() if n is not None}))
        if len(again) >= len(found):
            return again
        found = again


def admitted(pdf: bytes, payload: Payload, declared: int | None) -> list[int]:
    """Starts that the declared length admits, up to two bytes of line ends at the end being no part of it; all where it admits none."""
    last, _, places = starts(pdf, payload.dict_end, payload.end)
    fit = [s for s in places if declared is not None and 0 <= payload.end - s - declared <= 2]
    return fit or places


def attributed(pdf: bytes, ranges: list[tuple[int, int, int]]) -> list[Payload]:
    """Payloads of the ranges, each with the last live header at or before its keyword."""
    headers = live_headers(pdf, [(s, e) for _, s, e in ranges])
    ends, out = [h[0] for h in headers], []
    for i, (keyword, start, end) in enumerate(ranges):
        k = bisect_right(ends, keyword)
        at, number, generation = headers[k - 1] if k else (keyword, None, None)
        out.append(Payload(i, start, end, at, keyword, number, generation))
    return out


def declared_length(pdf: bytes, payload: Payload, objects: dict[tuple[int, int], int], exact_name: bool = False) -> int | None:
    """What the dictionary says, through one reference; None if it says nothing that can be read.

    `objects` has the end of the first live header of each object. exact_name skips
    longer names that begin alike, which the format's own tools don't.
    """
    at = payload.dict_start
    while True:
        k = pdf.find(b"/Length", at, payload.dict_end)
        if k < 0:
            return None
        at = k + 7
        if not exact_name or not (pdf[at : at + 1].isalnum() and at < payload.dict_end):
            break
    m = _LENGTH.match(pdf, k)
    first = _number(m[1], 64) if m else None
    if first is None:
        return None
    rest = _REST.match(pdf, m.end())
    generation = _number(rest[1], 16) if rest else None
    if generation is not None and first < 1 << 32:
        header = objects.get((first, generation))
        value = _NUMBER.match(pdf, _SKIP.match(pdf, header).end()) if header is not None else None
        return _number(value[0], 64) if value else None
    return first


def _number(digits: bytes, bits: int) -> int | None:
    """A decimal number of any length, if it fits into so many bits."""
    digits = digits.lstrip(b"0") or b"0"
    return int(digits) if len(digits) <= 20 and int(digits) < 1 << bits else None


def first_objects(pdf: bytes, payloads: list[Payload]) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}
    for end, number, generation in live_headers(pdf, [(p.start, p.end) for p in payloads]):
        out.setdefault((number, generation), end)
    return out


def agrees(pdf: bytes, payload: Payload, declared: int) -> bool:
    """Equal, or longer by at most two bytes that are line ends."""
    more = payload.size - declared
    return more == 0 or 0 < more <= 2 and not pdf[payload.start + declared : payload.end].strip(b"\r\n")


def length_mismatches(pdf: bytes, payloads: list[Payload], exact_name: bool = False) -> list[tuple[Payload, int]]:
    objects, out = first_objects(pdf, payloads), []
    for p in payloads:
        declared = declared_length(pdf, p, objects, exact_name)
        if declared is not None and not agrees(pdf, p, declared):
            out.append((p, declared))
    return out


def unlock(pdf: bytearray) -> tuple[str, int | None, int | None]:
    """Blank the last encryption reference in place: (kind, at, length)."""
    at = pdf.rfind(LOCKED)
    if at < 0:
        return "absent", None, None
    end = pdf.find(b"R", at, at + REFERENCE_REACH)
    if end < 0:
        return "malformed", at, None
    pdf[at : end + 1] = b" " * (end + 1 - at)
    return "blanked", at, end + 1 - at


_OBJECT = re.compile(rb"(?<![0-9])([0-9]+)\s+([0-9]+)\s+obj\b")


def object_streams(pdf: bytes) -> list[tuple[int, int, int, bytes]]:
    """(number, start, size, dictionary) by another rule: from object headers on, passing over objects that end before a stream."""
    out, keyword, closed = [], -1, -1
    for m in _OBJECT.finditer(pdf):
        # Both places only move on, so the document is read once.
        if keyword < m.end():
            keyword = pdf.find(OPEN, m.end())
            if keyword < 0:
                break
        if 0 <= closed < m.end() or closed < 0:
            closed = pdf.find(b"endobj", m.end())
            closed = closed if closed >= 0 else len(pdf)
        if closed < keyword:
            continue
        start = _LINE_ENDS.match(pdf, keyword + len(OPEN)).end()
        out.append((int(m[1]), start, pdf.find(CLOSE, start) - start, pdf[m.end() : keyword]))
    return out


_NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]+)" + SPACE + rb"*(\[?)")
_ONE = re.compile(SPACE + rb"*([0-9]+)" + SPACE + rb"+([0-9]+)" + SPACE + rb"+R(?![A-Za-z0-9])")


def references(dictionary: bytes) -> list[tuple[str, int, int]]:
    """(name, number, generation) of each reference that a name has as its value or in its list."""
    out = []
    for m in _NAME.finditer(dictionary):
        at, name = m.end(), m[1].decode("latin-1")
        while found := _ONE.match(dictionary, at):
            number, generation = _number(found[1], 32), _number(found[2], 16)
            if number is not None and generation is not None:
                out.append((name, number, generation))
            at = found.end()
            if not m[2]:
                break
    return out


def dictionaries(pdf: bytes) -> dict[int, bytes]:
    """What each object has before its stream or end, by the object's number; of several definitions the last."""
    payloads = payload_ranges(pdf)
    keywords, out = [k for k, _, _ in payloads], {}
    for end, number, _ in live_headers(pdf, [(s, e) for _, s, e in payloads]):
        closed = pdf.find(b"endobj", end)
        k = bisect_right(keywords, end)
        stop = min(keywords[k] if k < len(keywords) else len(pdf), closed if closed >= 0 else len(pdf))
        out[number] = pdf[end:stop]
    return out
