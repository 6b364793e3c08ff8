"""Container header and section table as column expressions over the file's bytes.

Nothing is exploded or shuffled: a file stays one row, its sections an array. All
fields are read from the hex digits of the header alone, so a body's bytes are not
touched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.bytesx import le_hex

# Fixed values of the container format.
MAGIC = b"Founder CEB"
SIBLING_MAGIC = b"@XDA"
HEADER, ENTRY = 31, 17
COUNT_LIMIT = 64
VERSION = 3
TYPES = {0: "XML metadata", 3: "PDF body", 4: "RC4 key", 5: "3DES key blob", 16: "algorithm id", 255: "producer info"}
XML_META, PDF_BODY, BODY_KEY, KEY_BLOB, ALGORITHM, PRODUCER = TYPES

SECTION = "struct<idx:int,ty:int,offset:bigint,len:bigint>"


def type_name(ty: Column) -> Column:
    """Name of a section's type code."""
    pairs = [x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*pairs), lambda k, _: k == ty)), F.lit(0)), F.lit("unrecognised"))


def _error(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def no_error() -> Column:
    return F.lit(None).cast("struct<code:string,message:string>")


def parse(files: DataFrame, content: str = "content", size: str | None = None) -> DataFrame:
    """Adds file_size, version, label, count, sections, parse_notes, error to files with a binary column.

    `error` is a struct (code, message), null for a container that can be read; the
    first failing check names it: magic, header length, version, count, table length,
    no usable entry. Entries that end past the file are dropped with a note, empty
    ones kept. Null content is an empty file. size names a column with the file's length
    where content has its first bytes only.
    """
    c = F.coalesce(F.col(content), F.lit(b""))
    head = HEADER + ENTRY * (COUNT_LIMIT - 1)
    df = files.withColumn("_h", F.hex(F.substring(c, 1, head))).withColumn("file_size", F.length(c).cast("bigint") if size is None else F.col(size).cast("bigint"))
    df = df.withColumn("_raw", F.regexp_extract(F.decode(F.substring(c, 13, 8), "ISO-8859-1"), "^[^\\x00]*", 0))
    df = df.withColumn("_numeric", F.expr("substr(_h, 23, 2) = '00'")).withColumn("_v", F.expr(le_hex("_h", "14", 2))).withColumn("count", F.expr(le_hex("_h", "20", 2)).cast("int"))
    entry = (
        f"named_struct('idx', i, 'ty', cast({le_hex('_h', f'({HEADER} + {ENTRY} * i + 8)', 1)} AS int), "
        f"'offset', {le_hex('_h', f'({HEADER} + {ENTRY} * i)', 4)}, 'len', {le_hex('_h', f'({HEADER} + {ENTRY} * i + 4)', 4)})"
    )
    table_end = F.lit(HEADER) + F.col("count") * ENTRY
    usable = (F.col("file_size") >= HEADER) & F.col("count").between(1, COUNT_LIMIT - 1) & (F.col("file_size") >= table_end)
    df = df.withColumn("_all", F.when(usable, F.expr(f"transform(sequence(0, count - 1), i -> {entry})")))
    df = df.withColumn("sections", F.expr(f"coalesce(filter(_all, s -> s.offset + s.len <= file_size), cast(array() AS array<{SECTION}>))"))
    magic_hex = MAGIC.hex().upper()
    size = F.col("file_size").cast("string")
    error = (
        F.when(
            ~F.expr(f"startswith(_h, '{magic_hex}')"),
            _error(
                "NOT_A_CONTAINER",
                F.concat(
                    F.lit(f"the file does not begin with `{MAGIC.decode()}` but with bytes "), F.lower(F.expr(f"substr(_h, 1, {2 * len(MAGIC)})")),
                    F.when(F.expr(f"startswith(_h, '{SIBLING_MAGIC.hex().upper()}')"), F.lit(" (`@XDA` begins CEBX, a different format)")).otherwise(F.lit("")),
                ),
            ),
        )
        .when(F.col("file_size") < HEADER, _error("TRUNCATED", F.concat(F.lit(f"truncated header: {HEADER} bytes needed, the file has "), size)))
        .when(F.col("_numeric") & (F.col("_v") != VERSION), _error("UNSUPPORTED_VERSION", F.concat(F.lit("container version "), F.col("_v").cast("string"), F.lit(f" is not known; {VERSION} is"))))
        .when(~F.col("_numeric") & ~F.col("_raw").rlike("^[!-~]+$"), _error("UNSUPPORTED_VERSION", F.lit("the version label is not printable")))
        .when(~F.col("count").between(1, COUNT_LIMIT - 1), _error("BAD_SECTION_TABLE", F.concat(F.lit("the header counts "), F.col("count").cast("string"), F.lit(f" sections, not 1 to {COUNT_LIMIT - 1}"))))
        .when(F.col("file_size") < table_end, _error("TRUNCATED", F.concat(F.lit("truncated section table: "), table_end.cast("string"), F.lit(" bytes needed, the file has "), size)))
        .when(F.size("sections") == 0, _error("BAD_SECTION_TABLE", F.concat(F.lit("none of "), F.col("count").cast("string"), F.lit(" table entries lies inside the file"))))
    )
    df = df.withColumn("error", error)
    dropped = F.col("count") - F.size("sections")
    first = F.expr("array_min(transform(sections, s -> s.offset))")
    notes = F.array_compact(
        F.array(
            F.when(~F.col("_numeric"), F.concat(F.lit("labelled header, version `"), F.col("_raw"), F.lit("`"))),
            F.when(dropped > 0, F.concat(dropped.cast("string"), F.lit(" of "), F.col("count").cast("string"), F.lit(" table entries end past the file and are left out"))),
            F.when(first < table_end, F.concat(F.lit("section data begins at "), first.cast("string"), F.lit(", inside the header and table of "), table_end.cast("string"), F.lit(" bytes: the last type byte is data"))),
        )
    )
    ok = F.col("error").isNull()
    df = df.withColumn("parse_notes", F.when(ok, notes).otherwise(F.expr("cast(array() AS array<string>)")))
    version = F.struct(
        F.when(F.col("_numeric"), "numeric").otherwise("labelled").alias("kind"), F.when(F.col("_numeric"), F.col("_v").cast("int")).alias("numeric"), F.when(~F.col("_numeric"), F.col("_raw")).alias("label")
    )
    df = df.withColumn("version", F.when(ok, version)).withColumn("sections", F.when(ok, F.col("sections")))
    return df.drop("_h", "_raw", "_numeric", "_v", "_all")


def version_text(version: Column) -> Column:
    return F.coalesce(version["label"], version["numeric"].cast("string"))


def sections(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row a section: the key columns, idx, ty, type_name, offset, len, end."""
    rows = parsed.select(*keys, F.explode("sections").alias("s"))
    return rows.select(*keys, "s.*").withColumn("type_name", type_name(F.col("ty"))).withColumn("end", F.col("offset") + F.col("len"))


def layout_complaints(sections_: str = "sections", size: str = "file_size") -> Column:
    """Neighbours in offset order that leave a gap or overlap, and a last section that ends before the file."""
    by_offset = f"array_sort(transform({sections_}, s -> named_struct('offset', s.offset, 'idx', s.idx, 'len', s.len)))"
    last = "get(b, size(b) - 1).offset + get(b, size(b) - 1).len"
    apart = "get(b, i).offset + get(b, i).len <> get(b, i + 1).offset"
    words = "concat('sections at ', get(b, i).offset, ' (+', get(b, i).len, ') and ', get(b, i + 1).offset, ' do not meet')"
    pairs = f"if(size(b) > 1, transform(sequence(0, size(b) - 2), i -> if({apart}, {words}, null)), cast(array() AS array<string>))"
    tail = f"array(if({last} <> {size}, concat('the last section ends at ', {last}, ', the file at ', {size}), null))"
    # The sorted array is bound to a name, so that it is sorted once.
    named = f"get(transform(array({by_offset}), b -> array_compact(concat({pairs}, {tail}))), 0)"
    return F.expr(f"if(size({sections_}) > 0, {named}, cast(array() AS array<string>))")


def gaps(rows: DataFrame, key: str) -> DataFrame:
    """The adjacency check over section rows: key, idx, end, next_offset of sections that the next one does not follow."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("offset", "idx")
    return rows.withColumn("next_offset", F.lead("offset").over(order)).where("end <> next_offset").select(key, "idx", "end", "next_offset")


def small_of_type(ty: int, small: str = "small") -> Column:
    """The same of sections that were read by themselves (idx, ty, offset, data)."""
    return F.expr(f"get(filter({small}, s -> s.ty = {ty}), 0).data")


def raw_of_type(ty: int, content: str = "content", unclaimed_only: bool = False) -> Column:
    """Bytes of the first section with a type code. unclaimed_only passes over sections that have a role."""
    claimed = " AND NOT array_contains(array(body.idx, body_key.idx, key_blob.idx, algorithm.idx), s.idx)" if unclaimed_only else ""
    s = F.expr(f"get(filter(sections, s -> s.ty = {ty}{claimed}), 0)")
    return F.when(s.isNotNull(), F.col(content).substr(s["offset"].cast("int") + 1, s["len"].cast("int")))
