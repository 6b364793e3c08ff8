"""More of the driver's queries: files, wrapped and own keys, faulty containers, reports, and the smaller operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil import synth
from codicil.functions import bytesx
from codicil.operators import decode, evidence, plain, report, sections, streams
from codicil.plans import convert as plan
from codicil.plans import outputs
from codicil.sources import files, shared, sink, stores

# A key and its wrapped form, a known answer of the format.
WRAPPED_KEY = bytes.fromhex("a1e7f815671f82812870e2315352f1569a4cb39584f08b03")
BLOB = bytes.fromhex("a2c8c0244570858b23ccaf50cd41862fd3b0a159f4101be7d1208abcfe5e2df4237032acf107c5130792876aff1cda946b5ecb70e0332ade601950ef1aa8fac4")
#: Name and offset in the header of what a fault changes.
_COUNT_AT, _VERSION_AT, _TABLE_AT = 20, 14, 31


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def own_key() -> Column:
    """A key of 24 bytes for each document."""
    return F.concat(F.unhex(F.md5(F.col("doc_id").cast("string"))), F.substring(F.unhex(F.md5(F.concat(F.lit("k"), F.col("doc_id").cast("string")))), 1, 8))


def _mode() -> Column:
    return F.expr("element_at(array('none', 'ofb', 'cfb64'), cast(pmod(doc_id, 3) AS int) + 1)")


def _folder(spark: SparkSession) -> str:
    """A new folder that executors and driver share, as files' paths begin."""
    path = shared.path(spark, "files")
    store, inner = stores.opened(path)
    store.make_folder(inner)
    return inner if stores.on_disk(path) else path


def _removed(folder: str) -> None:
    store, inner = stores.opened(folder)
    store.remove(inner)


def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with keys of their own written as files, listed, read, converted by declared lengths, written to planned outputs, and read again."""
    folder = _folder(spark)
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), _mode(), plain_blocks=True, key=own_key())
    sink.write_files(sealed.select(F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"), F.lit(".v1.ceb")).alias("path"), "content"))
    found = files.read(spark, folder, pattern="*.ceb").withColumn("path", outputs.normal(F.col("path")))
    planned = outputs.refuse_unsafe(outputs.plan(found.select("path")))
    done = files.with_size_errors(plan.convert(found, bounds="length")).join(planned, "path")
    sink.write_documents(done)
    pdfs = files.read(spark, folder, pattern="*.pdf").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("content").alias("pdf"))
    rows = streams.streams(pdfs).join(pdfs, "file")
    inflated = plan.inflated(bytesx.piece(F.col("pdf"), F.col("start"), F.col("end") - F.col("start")))
    out = rows.select("file", "number", F.length("pdf").cast("long").alias("pdf_bytes"), F.decode(inflated["data"], "UTF-8").alias("text"))
    # The files are deleted before the rows leave, so they are held as a table.
    kept = f"{folder}.parquet"
    out.write.parquet(kept)
    _removed(folder)
    return spark.read.schema(out.schema).parquet(kept)


def own_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each container. Some payloads begin with what looks like a line end once they are encrypted, so lengths tell where they begin."""
    out = plan.convert(synth.sealed(_dealt(spark, sf_dir), F.array("text"), _mode(), key=own_key()), bounds="length")
    return plan.payloads(out, "doc_id", "code").select("doc_id", "code", F.decode("data", "UTF-8").alias("text"))


def wrapped_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are wrapped; every second container doesn't say so, and is told by its blob's length."""
    docs = _dealt(spark, sf_dir)
    marked = F.when(F.col("doc_id") % 2 == 0, F.lit(1 << 31)).otherwise(0)
    sealed = synth.sealed(docs, F.array("text"), F.expr("element_at(array('ofb', 'cfb64'), cast(pmod(doc_id, 2) AS int) + 1)"), key=F.lit(WRAPPED_KEY), blob=F.lit(BLOB), flags=marked)
    rows = plan.payloads(plan.convert(sealed), "doc_id", "algorithm_id", "decoded.key_source", "decoded.key_len", "decoded.strategy")
    mode = F.regexp_extract("strategy", "^[^,]*", 0)
    return rows.select("doc_id", "algorithm_id", "key_source", F.col("key_len").cast("long").alias("key_len"), mode.alias("mode"), F.decode("data", "UTF-8").alias("text"))


def _patched(at: int, data: bytes) -> Column:
    return F.overlay("content", F.lit(data), at + 1, len(data))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with a fault that goes by doc_id."""
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), "cfb64", plain_blocks=True)
    far, none = (10**9).to_bytes(4, "little"), bytes(2)
    entry = lambda i: _TABLE_AT + 17 * i
    faults = [
        F.col("content"),
        F.overlay("content", F.lit(b"PK"), 1, 2),
        F.overlay("content", F.lit(b"@XDA"), 1, 4),
        F.substring("content", 1, 25),
        _patched(_VERSION_AT, b"\x09"),
        _patched(_COUNT_AT, none),
        F.substring("content", F.lit(1), (F.pmod("doc_id", F.lit(60)) + 32).cast("int")),
        F.lit(b""),
        # The key blob's entry ends past the file: dropped, so no key can be found.
        _patched(entry(2), far),
        # The body key's.
        _patched(entry(1), far),
        # The id's last bytes of the file, and a body key that is not its own.
        F.overlay("content", F.lit(b"\x07\x00\x00\x00"), F.length("content") - 3, 4),
        F.overlay("content", F.lit(b"W" * 16), F.length("content") - 43, 16),
        # The id says that the key is wrapped, and it isn't.
        F.overlay("content", F.lit(b"\x02\x00\x00\x80"), F.length("content") - 3, 4),
    ]
    chosen = faults[0]
    for i, f in enumerate(faults):
        chosen = F.when(F.pmod("doc_id", F.lit(len(faults))) == i, f).otherwise(chosen)
    return sealed.withColumn("content", chosen).withColumn("length", F.length("content").cast("bigint"))


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, in words, and the exit status."""
    out = plan.convert(_faulty(spark, sf_dir))
    said = F.coalesce(F.regexp_extract("error.message", "the file has ([0-9]+)", 1), F.lit(""))
    return out.select("doc_id", F.col("error.code").alias("error"), said.alias("said"), "code", F.size("sections").alias("n_sections"), F.size("notes").alias("n_notes"))


def error_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cause beneath an error, where there is one, and the layer that gave it."""
    out = report.with_cause(plan.convert(_faulty(spark, sf_dir)), F.concat(F.lit("/in/"), F.col("doc_id").cast("string")))
    return out.select("doc_id", "cause.path", "cause.layer", (F.col("cause.beneath").isNotNull()).alias("has_beneath"))


def layout_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps before the first section, a later start, and bytes after the last."""
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), "none", plain_blocks=True)
    # The body key's entry is made shorter in every third container, bytes are put behind every fourth.
    content = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.concat("content", F.lit(b"tail"))).otherwise(F.col("content"))
    content = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.overlay(content, F.lit(b"\x0f"), _TABLE_AT + 17 + 4 + 1, 1)).otherwise(content)
    out = sections.parse(sealed.withColumn("content", content))
    return out.select("doc_id", F.array_join(sections.layout_complaints(), "; ").alias("complaints"))


def section_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over section rows, by a window."""
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), "none", plain_blocks=True)
    content = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.overlay("content", F.lit(b"\x0f"), _TABLE_AT + 17 + 4 + 1, 1)).otherwise(F.col("content"))
    rows = sections.sections(sections.parse(sealed.withColumn("content", content)), "doc_id")
    return sections.gaps(rows, "doc_id").select("doc_id", F.col("idx").cast("long").alias("idx"), "end", "next_offset")


def labelled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with a version label instead of a number: printable labels are taken, others refused."""
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), "none", plain_blocks=True)
    label = F.expr("element_at(array(encode('2.99D', 'UTF-8'), encode('v7!', 'UTF-8'), X'0141', X'20'), cast(pmod(doc_id, 4) AS int) + 1)")
    padded = F.substring(F.concat(label, F.lit(bytes(8))), 1, 8)
    head = F.concat(F.substring("content", 1, 11), F.lit(b"\x20"), padded, F.substring("content", 21, 1 << 30))
    out = plan.conversion_report(plan.convert(sealed.withColumn("content", head)), "doc_id")
    return out.select("doc_id", "version", "code", F.col("error.code").alias("error"), F.size("notes").alias("n_notes"), "n_streams", "stream_bytes")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a conversion's report, a row for each of its lines, in order."""
    out = plan.convert(synth.sealed(_dealt(spark, sf_dir), F.array("text"), _mode(), plain_blocks=True))
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"))
    text = F.concat(report.summary(path, F.concat(path, F.lit(".pdf"))), report.detail(2))
    rows = out.select("doc_id", F.posexplode(F.split(F.regexp_replace(text, "\n+$", ""), "\n")).alias("line", "text"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), "text")


def metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is printed of a container that is not decoded."""
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), _mode(), plain_blocks=True)
    rows = report.metadata_dump(plan.inspect(sealed.withColumn("path", F.concat(F.lit("/in/"), F.col("doc_id").cast("string")))))
    return rows.select("path", F.posexplode(F.split(F.regexp_replace("dump", "\n+$", ""), "\n")).alias("line", "text"), "code").select("path", F.col("line").cast("long").alias("line"), "text", "code")


def raw_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the first section of a type: here the algorithm id, and one that no container has."""
    out = plan.inspect(synth.sealed(_dealt(spark, sf_dir), F.array("text"), _mode(), plain_blocks=True))
    return out.select("doc_id", F.hex(sections.raw_of_type(sections.ALGORITHM)).alias("algorithm"), F.hex(sections.raw_of_type(sections.KEY_BLOB, unclaimed_only=True)).alias("unclaimed_blob"), sections.raw_of_type(sections.XML_META).isNull().alias("no_xml"))


def _pdf(*parts: Column | str) -> Column:
    return F.concat(*(F.encode(F.lit(p), "UTF-8") if isinstance(p, str) else p for p in parts))


def _indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose length stands in another object, at times a wrong one, and whose stream is text in hex digits."""
    data = F.encode(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "UTF-8")
    said = F.length(data) + F.when(F.pmod("doc_id", F.lit(5)) == 0, 7).otherwise(0)
    pdf = _pdf("%PDF-1.4\n1 0 obj\n<</Length 2 0 R>>\nstream\n", data, "\nendstream\nendobj\n2 0 obj\n", F.encode(said.cast("string"), "UTF-8"), "\nendobj\n3 0 obj\n5 endobj\nstream\nshort\nendstream")
    return _dealt(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), pdf.alias("pdf"))


def length_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths found through references, by an equi-join with the first live header."""
    pdfs = _indirect(spark, sf_dir)
    payloads = streams.payload_rows(pdfs)
    live = streams.live(streams.header_rows(pdfs), payloads)
    first = payloads.where("idx = 0").select("file", "idx", F.lit(2).cast("bigint").alias("number"), F.lit(0).alias("generation"))
    lost = payloads.where("idx = 1").select("file", "idx", F.lit(9).cast("bigint").alias("number"), F.lit(0).alias("generation"))
    found = streams.resolve_references(first.unionByName(lost), live)
    return found.select(F.col("file").cast("bigint").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("long").alias("value"))


def object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams by the rule that begins at object headers."""
    rows = streams.object_rows(_indirect(spark, sf_dir))
    return rows.select(F.col("file").cast("bigint").alias("doc_id"), "number", "start", "size")


def refused_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the pages' outputs would be written over an input, are shared, or are there already."""
    name = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".v2"))
    path = F.concat(F.lit("/in/./x/../"), name, F.when(F.pmod("page_id", F.lit(3)) == 0, ".pdf").otherwise(".ceb"))
    planned = outputs.plan(_table(spark, sf_dir, "pages").select("page_id", path.alias("path")))
    over = outputs.overwritten_inputs(planned).select("page_id", F.lit(True).alias("overwritten"))
    shared = outputs.collisions(planned).select("output", "inputs")
    have = outputs.existing(planned, planned.where("pmod(page_id, 4) = 0").select(F.col("output").alias("path"))).select("page_id", F.lit(True).alias("there"))
    out = planned.join(over, "page_id", "left").join(shared, "output", "left").join(have, "page_id", "left")
    return out.select("page_id", "output", F.coalesce("overwritten", F.lit(False)).alias("overwritten"), F.coalesce("inputs", F.lit(1)).cast("long").alias("inputs"), F.coalesce("there", F.lit(False)).alias("there"))


def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses in order, with their places."""
    listed = outputs.listing(_table(spark, sf_dir, "pages").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path")))
    return listed.select(F.col("place").cast("long").alias("place"), "path")


def byte_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last places, numbers, white space and printable forms in the texts' bytes."""
    data = F.encode("text", "UTF-8")
    number = bytesx.read_uint(_pdf("ab", F.encode(F.col("doc_id").cast("string"), "UTF-8"), " x"), F.lit(2))
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select(
        "doc_id", bytesx.find(data, "the").cast("long").alias("first"), bytesx.rfind(data, "the").cast("long").alias("last"), bytesx.has(data, b"qu").alias("has_qu"), number["value"].alias("number"),
        number["next"].cast("long").alias("next"), bytesx.skip_space(_pdf("  \t\n", data), F.lit(1)).cast("long").alias("after_space"), bytesx.grouped(F.length(data) * 1000).alias("grouped"), F.md5(bytesx.printable(data)).alias("printable_md5"),
    )


def wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversations' turns on lines of 40 characters: the words again, and whether lines fit and could take no more."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", bytesx.wrap(F.coalesce("text", F.lit("")), 40).alias("lines"))
    fits = F.forall("lines", lambda x: (F.char_length(x) <= 40) | ~F.contains(x, F.lit(" ")))
    more = F.sequence(F.lit(1), F.greatest(F.size("lines") - 1, F.lit(1)))
    full = F.forall(more, lambda i: F.get("lines", i).isNull() | (F.char_length(F.get("lines", i - 1)) + 1 + F.char_length(F.regexp_extract(F.get("lines", i), "^[^ ]*", 0)) > 40))
    return rows.select("conv_id", "turn", F.md5(F.array_join("lines", " ")).alias("words_md5"), fits.alias("fits"), full.alias("full"))


def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least place in a window at which the two feedback modes differ; later ones are chance."""
    raw = _table(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("raw"), F.lit(synth.KEY).alias("key"))
    return evidence.first_differences(raw).agg(F.min("offset").cast("long").alias("offset"))


def ambiguous_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads too short to tell the modes apart, among others of 24 bytes."""
    size = F.when(F.pmod("doc_id", F.lit(17)) <= 8, F.pmod("doc_id", F.lit(17))).otherwise(24).cast("int")
    raw = F.encode(F.substring(F.lpad(F.col("doc_id").cast("string"), 24, "x"), F.lit(1), size), "UTF-8")
    return evidence.ambiguous(_table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), F.lit(synth.KEY).alias("key")), "doc_id")


def sizes_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflated sizes of payloads in each mode, and whether the right mode's is a /Length1 that is wrong in every seventh."""
    out = plan.convert(synth.sealed(_dealt(spark, sf_dir), F.array("text"), "cfb64", plain_blocks=True), strategy="none", verify=False)
    raw = plan.payloads(out, "doc_id", "text", inflate=False)
    said = F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) + F.when(F.pmod("doc_id", F.lit(7)) == 0, 1).otherwise(0)
    dictionary = _pdf("<</Length 5 /Length1 ", F.encode(said.cast("string"), "UTF-8"), ">>")
    sized = evidence.sizes_by_mode(raw.select("doc_id", "raw", F.lit(synth.KEY).alias("key"), dictionary.alias("dict")), "doc_id", "dict")
    return sized.select("doc_id", "ofb", "cfb64", "cfb8", evidence.agrees_with_length1(F.col("dict"), F.col("cfb64")).alias("length1_agrees"))


def bitmap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests drawn as bitmaps of eleven pixels a row."""
    rows = evidence.bitmap_rows(_table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("data")), 11, "doc_id")
    return rows.select("doc_id", F.col("row").cast("long").alias("row"), "pixels")


def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first layer alone: id, key and what the body begins with."""
    rows = decode.first_layer(plan.inspect(synth.sealed(_dealt(spark, sf_dir), F.array("text"), _mode(), plain_blocks=True, key=own_key())))
    return rows.select("doc_id", "algorithm_id", F.hex("key").alias("key_hex"), F.decode(F.substring("body", 1, 8), "ISO-8859-1").alias("begins"), F.length("body").cast("long").alias("body_bytes"))


def plain_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second reader's sections and roles: by length alone, the first of equal ones."""
    rows = plain.parse(synth.sealed(_dealt(spark, sf_dir), F.array("text"), "none", plain_blocks=True), "doc_id")
    return rows.select("doc_id", "role", F.col("idx").cast("long").alias("idx"), "offset", "len")


def plain_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second reader's documents, of pages that stand in containers as they are."""
    sealed = synth.sealed(_table(spark, sf_dir, "pages").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), F.array("html"), "none")
    out = plain.convert(sealed, "page_id")
    pdfs = out.select(F.col("page_id").cast("string").alias("file"), "pdf")
    rows = streams.streams(pdfs).join(pdfs, "file")
    inflated = plan.inflated(bytesx.piece(F.col("pdf"), F.col("start"), F.col("end") - F.col("start")))
    return rows.select(F.col("file").cast("bigint").alias("page_id"), F.sha2(inflated["data"], 256).alias("sha256"), bytesx.has(F.col("pdf"), b"/Encrypt").alias("locked"))


QUERIES = {
    f.__name__: f
    for f in (
        file_round_trip, own_keys, wrapped_key, error_codes, error_causes, layout_warnings, section_gaps, labelled_headers, report_lines, metadata_lines, raw_sections, length_references, object_scan,
        refused_outputs, sorted_listing, byte_searches, wrapped_text, first_difference, ambiguous_payloads, sizes_by_mode, bitmap_lines, layer_report, plain_parse, plain_conversion,
    )
}

_N = "octet_length(encode(coalesce(text, '')))"
_STORED = f"(6 + 5 * greatest(1, cast(ceil({_N} / 65535.0) AS BIGINT)) + {_N})"
_BODY = f"({_STORED} + length(cast({_STORED} AS VARCHAR)) + 9 + 8 + 30 + 11 + 18 + 64)"
_MODE = "['none', 'ofb', 'cfb64'][doc_id % 3 + 1]"
_SECTIONS = """[printf('    type %3d %-16s offset %9d  len %9d', 3, 'PDF body', 99, b), printf('    type %3d %-16s offset %9d  len %9d', 4, 'RC4 key', 99 + b, 16),
            printf('    type %3d %-16s offset %9d  len %9d', 5, '3DES key blob', 115 + b, 24), printf('    type %3d %-16s offset %9d  len %9d', 16, 'algorithm id', 139 + b, 4)]"""

ORACLES = {
    "file_round_trip": f"SELECT doc_id || '.v1.pdf' AS file, CAST(1 AS BIGINT) AS number, {_BODY} AS pdf_bytes, coalesce(text, '') AS text FROM documents",
    "own_keys": "SELECT doc_id, 0 AS code, coalesce(text, '') AS text FROM documents",
    "wrapped_key": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2147483649 ELSE 2 END AS algorithm_id, 'wrapped' AS key_source, CAST(24 AS BIGINT) AS key_len,
        CASE WHEN doc_id % 2 = 0 THEN '3DES-OFB' ELSE '3DES-CFB64' END AS mode, coalesce(text, '') AS text FROM documents""",
    "error_codes": """SELECT doc_id, [NULL, 'NOT_A_CONTAINER', 'NOT_A_CONTAINER', 'TRUNCATED', 'UNSUPPORTED_VERSION', 'BAD_SECTION_TABLE', 'TRUNCATED', 'NOT_A_CONTAINER', 'MISSING_SECTION', 'MISSING_SECTION',
        'UNKNOWN_ALGORITHM', 'BODY_LAYER_FAILED', 'BAD_KEY_LENGTH'][f + 1] AS error, CASE f WHEN 3 THEN '25' WHEN 6 THEN CAST(32 + doc_id % 60 AS VARCHAR) ELSE '' END AS said, CASE WHEN f = 0 THEN 0 ELSE 1 END AS code,
        CASE WHEN f IN (8, 9) THEN 3 WHEN f IN (0, 10, 11, 12) THEN 4 END AS n_sections, CASE WHEN f IN (8, 9) THEN 1 ELSE 0 END AS n_notes FROM (SELECT doc_id, doc_id % 13 AS f FROM documents)""",
    "error_causes": """SELECT doc_id, CASE WHEN f > 0 THEN '/in/' || doc_id END AS path, [NULL, 'header', 'header', 'header', 'header', 'table', 'header', 'header', 'roles', 'roles', 'key', 'body', 'key'][f + 1] AS layer, f = 12 AS has_beneath
        FROM (SELECT doc_id, doc_id % 13 AS f FROM documents)""",
    "layout_warnings": f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'sections at ' || (99 + b) || ' (+15) and ' || (115 + b) || ' do not meet' END,
        CASE WHEN doc_id % 4 = 0 THEN 'the last section ends at ' || (143 + b) || ', the file at ' || (147 + b) END], lambda x: x IS NOT NULL), '; ') AS complaints FROM (SELECT doc_id, {_BODY} AS b FROM documents)""",
    "section_gaps": f"SELECT doc_id, CAST(1 AS BIGINT) AS idx, 114 + {_BODY} AS \"end\", 115 + {_BODY} AS next_offset FROM documents WHERE doc_id % 3 = 0",
    "labelled_headers": f"""SELECT doc_id, CASE f WHEN 0 THEN '2.99D' WHEN 1 THEN 'v7!' END AS version, CASE WHEN f < 2 THEN 0 ELSE 1 END AS code, CASE WHEN f >= 2 THEN 'UNSUPPORTED_VERSION' END AS error,
        CASE WHEN f < 2 THEN 1 ELSE 0 END AS n_notes, CASE WHEN f < 2 THEN 1 END AS n_streams, CASE WHEN f < 2 THEN {_STORED} + 1 END AS stream_bytes FROM (SELECT doc_id, text, doc_id % 4 AS f FROM documents)""",
    "report_lines": f"""WITH d AS (SELECT doc_id, {_N} AS n, {_STORED} AS s, {_BODY} AS b, {_MODE} AS mode, '/in/' || doc_id AS p FROM documents),
        l AS (SELECT doc_id, list_concat([p || ' -> ' || p || '.pdf', '  ' || format('{{:,}}', 143 + b) || ' -> ' || format('{{:,}}', b) || ' B, 1 payloads, 1/1 flate payloads inflate', '  container version : 3',
            '  algorithm id      : 0x0000000' || (doc_id % 3), '  payload cipher    : ' || CASE mode WHEN 'none' THEN 'none (payloads are not encrypted)' ELSE '3DES-' || upper(mode) || ', started anew with the key''s first 8 bytes every 256 bytes' END,
            '  key               : ' || CASE mode WHEN 'none' THEN 'not needed' ELSE '24 bytes, direct' END, '  /Encrypt          : 14 bytes blanked at offset ' || (b - 34), '  payload bytes     : ' || format('{{:,}}', s + 1) || ' B in 1 payloads',
            '  self-check        : 1/1 flate payloads inflate (' || format('{{:,}}', n) || ' B), 0 lengths differ', '  sections:'], {_SECTIONS}) AS lines FROM d)
        SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS text FROM l""",
    "metadata_lines": f"""WITH d AS (SELECT doc_id, {_BODY} AS b FROM documents),
        l AS (SELECT doc_id, list_concat(['/in/' || doc_id, '  file size    : ' || format('{{:,}}', 143 + b) || ' B', '  version      : 3', '  sections     : 4'], {_SECTIONS},
            ['  resolved     : body=' || b || ' B, body_key=16 B, key_blob=24 B, algorithm=0x0000000' || (doc_id % 3)]) AS lines FROM d)
        SELECT '/in/' || doc_id AS path, unnest(range(0, len(lines))) AS line, unnest(lines) AS text, 0 AS code FROM l""",
    "raw_sections": "SELECT doc_id, '0' || (doc_id % 3) || '000000' AS algorithm, CAST(NULL AS VARCHAR) AS unclaimed_blob, true AS no_xml FROM documents",
    "length_references": f"SELECT doc_id, CAST(0 AS BIGINT) AS idx, 2 * {_N} + CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 0 END AS value FROM documents",
    "object_scan": f"SELECT doc_id, CAST(1 AS BIGINT) AS number, CAST(CASE WHEN {_N} = 0 THEN 43 ELSE 42 END AS BIGINT) AS start, CASE WHEN {_N} = 0 THEN 0 ELSE 2 * {_N} + 1 END AS size FROM documents",
    "refused_outputs": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || '.v2' AS name FROM pages)
        SELECT page_id, '/in/./x/../' || name || '.pdf' AS output, name IN (SELECT name FROM p WHERE page_id % 3 = 0) AND page_id % 3 = 0 AS overwritten, count(*) OVER (PARTITION BY name) AS inputs, name IN (SELECT name FROM p WHERE page_id % 4 = 0) AS there FROM p""",
    "sorted_listing": "SELECT row_number() OVER (ORDER BY path) - 1 AS place, path FROM (SELECT url || '#' || page_id AS path FROM pages)",
    "byte_searches": """WITH d AS (SELECT doc_id, text, instr(text, 'the') AS i, strlen(text) AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CASE WHEN i > 0 THEN strlen(substr(text, 1, i - 1)) END AS first, CASE WHEN i > 0 THEN n - 3 - strlen(string_split(text, 'the')[-1]) END AS last, contains(text, 'qu') AS has_qu, doc_id AS number, 2 + length(CAST(doc_id AS VARCHAR)) AS next,
        4 + strlen(regexp_extract(text, '^[\t\n\f\r ]*')) AS after_space, format('{:,}', n * 1000) AS grouped, md5(trim(regexp_replace(text, '[^!-~]+', ' ', 'g'), ' ')) AS printable_md5 FROM d""",
    "wrapped_text": "SELECT conv_id, turn, md5(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> ''), ' ')) AS words_md5, true AS fits, true AS \"full\" FROM conversations",
    "first_difference": "SELECT CAST(8 AS BIGINT) AS \"offset\"",
    "ambiguous_payloads": "SELECT doc_id FROM documents WHERE doc_id % 17 <= 8",
    "sizes_by_mode": f"SELECT doc_id, CAST(NULL AS BIGINT) AS ofb, {_N} AS cfb64, CAST(NULL AS BIGINT) AS cfb8, doc_id % 7 <> 0 AS length1_agrees FROM documents",
    "bitmap_lines": """SELECT doc_id, r AS "row", translate(left(format('{:016b}', CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 4 * r + 1, 4) AS INTEGER)), 11), '01', '.#') AS pixels FROM documents, range(0, 8) AS t(r)""",
    "layer_report": f"SELECT doc_id, doc_id % 3 AS algorithm_id, upper(md5(CAST(doc_id AS VARCHAR))) AS key_hex, '%PDF-1.5' AS begins, {_BODY} AS body_bytes FROM documents",
    "plain_parse": f"""SELECT doc_id, role, CAST(idx AS BIGINT) AS idx, o + CASE WHEN idx > 0 THEN {_BODY} ELSE 0 END AS "offset", CASE WHEN idx = 0 THEN {_BODY} ELSE n END AS len
        FROM documents, (VALUES ('body', 0, 99, 0), ('body_key', 1, 99, 16), ('key_blob', 2, 115, 24), ('algorithm', 3, 139, 4)) AS r(role, idx, o, n)""",
    "plain_conversion": "SELECT page_id, sha256(html) AS sha256, false AS locked FROM pages",
}
