"""Notes, complaints, status and text of a conversion, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.bytesx import grouped, printable, wrap

from . import sections as S
from .decode import REPORTED

OK, FAILED, WARNED = 0, 1, 3
EXTERNAL_FONTS = "fonts are named but not embedded: the container never held them, and a viewer without them puts others in their place"


def _who(x: str) -> str:
    return f"if({x}.number IS NULL, 'object unknown', concat('object ', {x}.number, ' ', {x}.generation))"


def check_complaints(check: str = "decoded.check") -> Column:
    """What the self-check found wrong, in words; empty if nothing."""
    bad = f"transform({check}.bad, b -> concat('  payload ', b.idx, ' (', {_who('b')}, ', ', b.len, ' bytes at offset ', b.start, '): ', b.reason))"
    wrong = f"transform({check}.mismatches, m -> concat('  payload ', m.idx, ' (', {_who('m')}, '): ', m.declared, ' bytes declared, ', m.scanned, ' found'))"
    none = "cast(array() AS array<string>)"
    return F.expr(
        f"""if({check} IS NULL, {none}, concat(array_compact(array(
            if({check}.pdf_header, null, 'the output does not begin with `%PDF-`'),
            if({check}.eof, null, 'the output has no `%%EOF` near its end'),
            if({check}.unlocked, null, 'the output still has an `/Encrypt` key'),
            if({check}.bad_total = 0, null, concat({check}.bad_total, ' of ', {check}.flate_streams, ' /FlateDecode payloads do not inflate: the output is incomplete, mostly because of a wrong mode; --force-mode tries another')))),
            if({check}.bad_total = 0, {none}, {bad}),
            if({check}.bad_total > {REPORTED}, array(concat('  ... and ', {check}.bad_total - {REPORTED}, ' more')), {none}),
            if({check}.mismatch_total = 0, {none}, array(concat({check}.mismatch_total, ' payload(s) differ in length from their /Length: the keyword scan cut them elsewhere'))),
            if({check}.mismatch_total = 0, {none}, {wrong})))"""
    )


def check_clean(check: str = "decoded.check") -> Column:
    return F.expr(f"{check}.pdf_header AND {check}.eof AND {check}.unlocked AND {check}.bad_total = 0 AND {check}.mismatch_total = 0")


def with_report(decoded: DataFrame) -> DataFrame:
    """Adds layout_complaints, notes, complaints, clean and code (0 clean, 1 failed, 3 converted with complaints)."""
    df = decoded.withColumn("layout_complaints", F.when(F.size("sections") > 0, S.layout_complaints()).otherwise(F.expr("cast(array() AS array<string>)")))
    fonts = F.when(F.col("decoded.check.fonts_external"), F.array(F.lit(EXTERNAL_FONTS))).otherwise(F.expr("cast(array() AS array<string>)"))
    df = df.withColumn("notes", F.concat("parse_notes", "role_notes", fonts))
    torn = F.expr("if(decoded.encrypt.kind = 'malformed', array(concat('`/Encrypt` at offset ', decoded.encrypt.at, ' has no `R` within 64 bytes and was left')), cast(array() AS array<string>))")
    df = df.withColumn("complaints", F.when(F.col("error").isNull(), F.concat("layout_complaints", torn, check_complaints())))
    df = df.withColumn("clean", F.coalesce(F.size("complaints") == 0, F.lit(False)))
    return df.withColumn("code", F.when(F.col("error").isNotNull(), FAILED).when(F.col("clean"), OK).otherwise(WARNED))


def exit_codes(report: DataFrame, *keys: str) -> DataFrame:
    """max(code), by which a warning hides a failure, and beside it whether any file failed."""
    return report.groupBy(*keys).agg(F.max("code").alias("exit_code"), F.max((F.col("code") == FAILED).cast("int")).alias("any_failed"))


def summary(source: Column, target: Column) -> Column:
    check = F.when(F.col("decoded.check").isNotNull(), F.concat(F.lit(", "), F.col("decoded.check.flate_ok").cast("string"), F.lit("/"), F.col("decoded.check.flate_streams").cast("string"), F.lit(" flate payloads inflate"))).otherwise(F.lit(""))
    return F.concat(source, F.lit(" -> "), target, F.lit("\n  "), grouped(F.col("file_size")), F.lit(" -> "), grouped(F.length("decoded.pdf")), F.lit(" B, "), F.size("decoded.streams").cast("string"), F.lit(" payloads"), check, F.lit("\n"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"  {name:<18}: "), value, F.lit("\n"))


def section_lines() -> Column:
    """A line for each section."""
    names = ", ".join(f"{k}, '{v}'" for k, v in S.TYPES.items())
    return F.expr(f"array_join(transform(sections, s -> format_string('    type %3d %-16s offset %9d  len %9d\\n', s.ty, coalesce(element_at(map({names}), s.ty), 'unrecognised'), s.offset, s.len)), '')")


def detail(verbose: int = 1) -> Column:
    """The report of one file; sections too from verbosity 2 on."""
    d = "decoded."
    algorithm = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("algorithm_id"), 8, "0")), F.when(F.col("algorithm_id") >= 1 << 31, F.lit(" (the key is wrapped)")).otherwise(F.lit("")))
    key = F.when(F.col(d + "key_source") == "not needed", F.lit("not needed")).otherwise(F.concat(F.col(d + "key_len").cast("string"), F.lit(" bytes, "), F.col(d + "key_source")))
    lock = F.expr("CASE decoded.encrypt.kind WHEN 'blanked' THEN concat(decoded.encrypt.len, ' bytes blanked at offset ', decoded.encrypt.at) WHEN 'absent' THEN 'absent' ELSE concat('MALFORMED at offset ', decoded.encrypt.at, ', left') END")
    found = F.expr("concat(decoded.check.flate_ok, '/', decoded.check.flate_streams, ' flate payloads inflate (', format_number(decoded.check.inflated_bytes, 0), ' B), ', decoded.check.mismatch_total, ' lengths differ')")
    noted = F.array_join(F.transform(F.flatten(F.transform("notes", lambda n: wrap(n, 68))), lambda x: F.concat(F.lit(f"  {'note':<18}: "), x, F.lit("\n"))), "")
    parts = [
        _line("container version", S.version_text(F.col("version"))), _line("algorithm id", algorithm), _line("payload cipher", F.concat(F.col(d + "strategy"), F.when(F.col(d + "forced"), F.lit(" [forced]")).otherwise(F.lit("")))),
        _line("key", key), _line("/Encrypt", lock), _line("payload bytes", F.concat(grouped(F.col(d + "stream_bytes")), F.lit(" B in "), F.size(d + "streams").cast("string"), F.lit(" payloads"))),
        F.when(F.col(d + "check").isNotNull(), _line("self-check", found)).otherwise(F.lit("")), noted,
    ]
    if verbose > 1:
        parts += [F.lit("  sections:\n"), section_lines()]
    return F.concat(*parts)


def metadata_dump(resolved: DataFrame, path: str = "path", content: str = "content", producer_by_shape: bool = False) -> DataFrame:
    """path, dump, code of files parsed and resolved but not decoded. A file whose roles are unclear is dumped with the reason."""
    parsed = F.col("version").isNotNull()
    absent = "'absent'"
    roles = F.expr(f"concat('body=', body.len, ' B, body_key=', body_key.len, ' B, key_blob=', coalesce(concat(key_blob.len, ' B'), {absent}), ', algorithm=', coalesce(concat('0x', lower(_alg)), 'absent (payloads are not encrypted)'))")
    four = F.col(content).substr(F.col("algorithm.offset").cast("int") + 1, F.lit(4))
    df = resolved.withColumn("_alg", F.hex(_reversed(four)))
    producer = S.raw_of_type(S.PRODUCER, content)
    if producer_by_shape:
        shaped = F.expr("get(filter(sections, s -> s.len = 150), 0)")
        producer = F.coalesce(F.when(shaped.isNotNull(), F.col(content).substr(shaped["offset"].cast("int") + 1, shaped["len"].cast("int"))), producer)
    lines = lambda label, items: F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"  {label:<13}: "), x, F.lit("\n"))), "")
    xml = S.raw_of_type(S.XML_META, content)
    text = F.concat(
        F.col(path), F.lit("\n  file size    : "), grouped(F.col("file_size")), F.lit(" B\n  version      : "), S.version_text(F.col("version")), F.lit("\n  sections     : "), F.size("sections").cast("string"), F.lit("\n"), section_lines(),
        F.lit("  resolved     : "), F.when(F.col("error").isNull(), roles).otherwise(F.concat(F.lit("FAILED: "), F.col("error.message"))), F.lit("\n"),
        F.when(F.col("error").isNull(), lines("note", F.concat("role_notes", "parse_notes"))).otherwise(F.lit("")), lines("warning", S.layout_complaints()),
        F.when(xml.isNotNull(), F.concat(F.lit("  xml metadata : "), F.length(xml).cast("string"), F.lit(" B, GBK (not decoded)\n"))).otherwise(F.lit("")),
        F.when(producer.isNotNull(), F.concat(F.lit("  producer     : "), printable(producer), F.lit("\n"))).otherwise(F.lit("")),
    )
    return df.select(path, F.when(parsed, text).alias("dump"), F.when(parsed, OK).otherwise(FAILED).alias("code"), "error")


def _reversed(four: Column) -> Column:
    return F.concat(*[F.substring(four, i, 1) for i in (4, 3, 2, 1)])


#: The step that gives an error of each code.
LAYERS = {
    "NOT_A_CONTAINER": "header", "TRUNCATED": "header", "UNSUPPORTED_VERSION": "header", "BAD_SECTION_TABLE": "table", "MISSING_SECTION": "roles", "UNKNOWN_ALGORITHM": "key",
    "BAD_KEY_LENGTH": "key", "UNWRAP_FAILED": "key", "BODY_LAYER_FAILED": "body", "LENGTH_CHANGED": "payloads", "TOO_LARGE": "file",
}


def with_cause(converted: DataFrame, path: Column) -> DataFrame:
    """Adds `cause` (path, layer, beneath) of a file's error: the step that failed and what it was told by the one beneath, if any."""
    pairs = [F.lit(x) for pair in LAYERS.items() for x in pair]
    layer = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("error.code")), F.lit("unknown"))
    cause = F.struct(path.alias("path"), layer.alias("layer"), F.col("decoded.cause").alias("beneath"))
    return converted.withColumn("cause", F.when(F.col("error").isNotNull(), cause))
