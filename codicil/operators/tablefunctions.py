"""Payloads, object headers and streams of other rules as SQL table functions.

After `register(spark)`, `FROM files f, LATERAL pdf_payloads(f.pdf) p` gives a row a
payload. The columns follow the arguments: `pdf_payloads(pdf, detail => true)` adds the
object each payload belongs to, its dictionary's bytes and its declared length, and
`bounds => 'length'` finds ends by declared lengths.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BinaryType, BooleanType, DataType, DecimalType, IntegerType, LongType, StringType, StructType

from codicil.functions import pdfbytes

_PAYLOAD: list[tuple[str, DataType]] = [("idx", IntegerType()), ("keyword", LongType()), ("start", LongType()), ("end", LongType())]
_DETAIL: list[tuple[str, DataType]] = [("dict_start", LongType()), ("number", LongType()), ("generation", IntegerType()), ("dict", BinaryType()), ("declared", DecimalType(20, 0)), ("agrees", BooleanType())]


def _schema(columns: list[tuple[str, DataType]]) -> StructType:
    out = StructType()
    for name, kind in columns:
        out = out.add(name, kind)
    return out


def _document(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.dataType, BinaryType):
        raise ValueError(f"{name} takes a binary, not a {argument.dataType.simpleString()}")


def _constant(argument: AnalyzeArgument | None, name: str, kinds: tuple[type, ...], default):
    if argument is None:
        return default
    if not argument.isConstantExpression or not isinstance(argument.value, kinds):
        raise ValueError(f"`{name}` must be a constant")
    return argument.value


@udtf
class PayloadFunction:
    """idx, keyword, start, end of a document's payloads; more with detail. A null document has none."""

    @staticmethod
    def analyze(pdf: AnalyzeArgument, detail: AnalyzeArgument | None = None, bounds: AnalyzeArgument | None = None) -> AnalyzeResult:
        _document(pdf, "pdf_payloads")
        if _constant(bounds, "bounds", (str,), "keyword") not in ("keyword", "length"):
            raise ValueError("`bounds` is keyword or length")
        return AnalyzeResult(_schema(_PAYLOAD + _DETAIL if _constant(detail, "detail", (bool,), False) else _PAYLOAD))

    def eval(self, pdf: bytes | None, detail: bool = False, bounds: str = "keyword"):
        if pdf is None:
            return
        pdf = bytes(pdf)
        if not detail and bounds == "keyword":
            for i, r in enumerate(pdfbytes.payload_ranges(pdf)):
                yield (i, *r)
            return
        found = pdfbytes.scan(pdf) if bounds == "keyword" else pdfbytes.scan_by_length(pdf)
        objects = pdfbytes.first_objects(pdf, found) if detail else {}
        for p in found:
            row = (p.idx, p.dict_end, p.start, p.end)
            if detail:
                n = pdfbytes.declared_length(pdf, p, objects)
                row += (p.dict_start, p.number, p.generation, pdf[p.dict_start : p.dict_end], None if n is None else Decimal(n), None if n is None else pdfbytes.agrees(pdf, p, n))
            yield row


@udtf
class HeaderFunction:
    """at (the header's end), number, generation, value (an integer that follows it) of each `N G obj`."""

    @staticmethod
    def analyze(pdf: AnalyzeArgument) -> AnalyzeResult:
        _document(pdf, "pdf_headers")
        return AnalyzeResult(_schema([("at", LongType()), ("number", LongType()), ("generation", IntegerType()), ("value", DecimalType(20, 0))]))

    def eval(self, pdf: bytes | None):
        pdf = bytes(pdf or b"")
        for end, number, generation in pdfbytes.object_headers(pdf):
            m = pdfbytes._NUMBER.match(pdf, pdfbytes._SKIP.match(pdf, end).end())
            value = pdfbytes._number(m[0], 64) if m else None
            yield end, number, generation, None if value is None else Decimal(value)


@udtf
class ObjectFunction:
    """number, start, size, dict of streams by the rule that begins at object headers."""

    @staticmethod
    def analyze(pdf: AnalyzeArgument) -> AnalyzeResult:
        _document(pdf, "pdf_objects")
        return AnalyzeResult(_schema([("number", LongType()), ("start", LongType()), ("size", LongType()), ("dict", BinaryType())]))

    def eval(self, pdf: bytes | None):
        yield from pdfbytes.object_streams(bytes(pdf or b""))


@udtf
class ReferenceFunction:
    """name, number, generation of each `/Name N G R`, and of each member of `/Name [N G R ...]`, in a dictionary."""

    @staticmethod
    def analyze(dictionary: AnalyzeArgument) -> AnalyzeResult:
        _document(dictionary, "pdf_references")
        return AnalyzeResult(_schema([("name", StringType()), ("number", LongType()), ("generation", IntegerType())]))

    def eval(self, dictionary: bytes | None):
        yield from pdfbytes.references(bytes(dictionary or b""))


FUNCTIONS = {"pdf_payloads": PayloadFunction, "pdf_headers": HeaderFunction, "pdf_objects": ObjectFunction, "pdf_references": ReferenceFunction}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


#: `streams` in SQL, over a view of documents (file string, pdf binary).
STREAMS_SQL = """
WITH payloads AS (SELECT f.file, p.* FROM {pdfs} f, LATERAL pdf_payloads(f.pdf) p),
headers AS (SELECT f.file, h.at, h.number, h.generation FROM {pdfs} f, LATERAL pdf_headers(f.pdf) h),
points AS (
    SELECT file, at - 3 AS pos, 1 AS kind, at, number, generation, CAST(NULL AS BIGINT) AS `end` FROM headers
    UNION ALL SELECT file, start, 0, NULL, NULL, NULL, `end` FROM payloads),
covered AS (SELECT *, last_value(`end`) IGNORE NULLS OVER (PARTITION BY file ORDER BY pos, kind ROWS UNBOUNDED PRECEDING) AS cover FROM points),
live AS (SELECT file, at, number, generation FROM covered WHERE kind = 1 AND (cover IS NULL OR pos >= cover)),
merged AS (
    SELECT file, at AS pos, 0 AS kind, struct(at, number, generation) AS h, NULL AS p FROM live
    UNION ALL SELECT file, keyword, 1, NULL, struct(idx, keyword, start, `end`) FROM payloads),
owned AS (SELECT *, last_value(h) IGNORE NULLS OVER (PARTITION BY file ORDER BY pos, kind ROWS UNBOUNDED PRECEDING) AS own FROM merged)
SELECT file, p.idx, p.start, p.`end`, coalesce(own.at, p.keyword) AS dict_start, p.keyword AS dict_end, own.number, own.generation FROM owned WHERE kind = 1
"""
