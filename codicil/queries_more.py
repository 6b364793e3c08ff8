"""Queries of payload bounds, table functions, prefix scans, eliminating sweeps, object graphs, ranged reads, ledgers and published files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil import synth
from codicil.functions import bytesx
from codicil.operators import decode, graph, plain, streams, tablefunctions
from codicil.plans import convert as plan
from codicil.plans import ledger as plan_ledger
from codicil.queries_files import _BODY, _N, _STORED, BLOB, WRAPPED_KEY, _dealt, _folder, _mode, _removed, _table, own_key
from codicil.sources import containers, publish, shared


def payload_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that begin with line ends or hold closing keywords: by declared lengths, and by keywords alone."""
    text = F.concat(F.lit("x"), F.coalesce("text", F.lit("")))
    kind = F.pmod("doc_id", F.lit(4))
    payload = F.when(kind == 1, F.concat(F.lit("\n"), text)).when(kind == 2, F.concat(F.lit("\r\n\r\n"), text))
    payload = payload.when(kind == 3, F.concat(text, F.lit("\nendstream\nendobj\n7 0 obj\nstream\n"), text)).otherwise(text)
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array(payload), "none", flate=False)
    by_keyword = plan.convert(sealed).select("doc_id", F.size("decoded.streams").cast("long").alias("keyword_payloads"), F.col("decoded.stream_bytes").alias("keyword_bytes"))
    rows = plan.payloads(plan.convert(sealed, bounds="length"), "doc_id", "code", "decoded.stream_bytes", inflate=False)
    found = rows.select("doc_id", "code", "idx", "boundary", "stream_bytes", F.sha2("raw", 256).alias("sha256"))
    return found.join(by_keyword, "doc_id")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, pdf: a document for each conversation, a stream for each turn."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    out = plan.convert(synth.sealed(turns.select("conv_id", F.col("t.text").alias("texts")), F.col("texts"), "none", plain_blocks=True), verify=False)
    return out.select(F.col("conv_id").cast("string").alias("file"), F.col("decoded.pdf").alias("pdf"))


def streams_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads and their objects by SQL text with lateral table functions."""
    tablefunctions.register(spark)
    view = f"pdfs_{uuid.uuid4().hex[:12]}"
    _turns(spark, sf_dir).createOrReplaceTempView(view)
    rows = spark.sql(tablefunctions.STREAMS_SQL.format(pdfs=view))
    return rows.select(F.col("file").cast("bigint").alias("conv_id"), F.col("idx").cast("long").alias("idx"), (F.col("end") - F.col("start")).alias("size"), "number", F.col("generation").cast("long").alias("generation"))


def payload_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same function with columns that its arguments add: declared lengths, and whether they agree."""
    tablefunctions.register(spark)
    view = f"pdfs_{uuid.uuid4().hex[:12]}"
    _turns(spark, sf_dir).createOrReplaceTempView(view)
    rows = spark.sql(f"SELECT f.file, p.* FROM {view} f, LATERAL pdf_payloads(f.pdf, detail => true, bounds => 'length') p")
    return rows.select(F.col("file").cast("bigint").alias("conv_id"), F.col("idx").cast("long").alias("idx"), "number", F.col("declared").cast("long").alias("declared"), "agrees", F.contains("dict", F.lit(b"/FlateDecode")).alias("flate"))


def one_file_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the headers and line items as the payloads of one long document, attributed by the prefix scan in spans."""
    orders = _table(spark, sf_dir, "orders").select(F.lit("all").alias("file"), (F.col("o_orderkey") * 100).alias("at"), F.col("o_orderkey").alias("number"), F.lit(0).alias("generation"))
    place = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 - 35
    items = _table(spark, sf_dir, "lineitem").select(F.lit("all").alias("file"), F.col("l_linenumber").cast("int").alias("idx"), place.alias("keyword"), (place + 1).alias("start"), (place + 5).alias("end"))
    rows = streams.attribute(items, orders, span=1 << 14)
    return rows.select(F.col("dict_end").alias("keyword"), F.col("idx").cast("long").alias("idx"), "number")


def object_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of documents with pages, contents and a font, by what references reach; every page leads back to the others by /Parent."""
    k = F.pmod("doc_id", F.lit(4)) + 1
    text = lambda c: F.encode(c, "UTF-8")
    pages = F.sequence(F.lit(1), k.cast("int"))
    kids = F.array_join(F.transform(pages, lambda i: F.concat((i * 10).cast("string"), F.lit(" 0 R"))), " ")
    page = lambda i: F.concat((i * 10).cast("string"), F.lit(" 0 obj\n<</Parent 2 0 R /Resources 3 0 R /Contents "), (i * 10 + 1).cast("string"), F.lit(" 0 R>>\nendobj\n"), (i * 10 + 1).cast("string"), F.lit(" 0 obj\n<</Length 9>>\nstream\n5 0 obj /Contents 1 0 R\n"), F.coalesce("text", F.lit("")), F.lit("\nendstream\nendobj\n"))
    pdf = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<</Pages 2 0 R>>\nendobj\n2 0 obj\n<</Kids ["), kids, F.lit("]>>\nendobj\n3 0 obj\n<</Font 4 0 R>>\nendobj\n4 0 obj\n<</FontDescriptor 5 0 R>>\nendobj\n5 0 obj\n<</FontFile2 6 0 R>>\nendobj\n6 0 obj\n<<>>\nstream\nx\nendstream\nendobj\n"),
        F.array_join(F.transform(pages, page), ""),
    )
    rows = graph.classified(_dealt(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), text(pdf).alias("pdf")))
    return rows.select(F.col("file").cast("bigint").alias("doc_id"), "number", "class")


def reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some customers reach where each leads to the one of half its number, and in how many steps."""
    people = _table(spark, sf_dir, "customer")
    links = people.select(F.lit("all").alias("file"), F.col("c_custkey").alias("number"), F.expr("c_custkey div 2").alias("target"))
    rows = graph.reach(links, people.where("c_custkey % 97 = 0").select(F.lit("all").alias("file"), F.col("c_custkey").alias("number")))
    return rows.select("number", F.col("steps").cast("long").alias("steps"))


def payload_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads inflated in pieces of a thousand bytes, and put together again."""
    out = plan.convert(synth.sealed(_dealt(spark, sf_dir), F.array("text"), "ofb"), verify=False)
    pieces = plan.inflated_pieces(plan.payloads(out, "doc_id", inflate=False), "doc_id", size=1000)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("data").alias("hex")))), lambda x: F.coalesce(x["hex"], F.lit(""))), "")
    rows = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max(F.length("data")).cast("long").alias("longest"), F.sha2(F.unhex(whole), 256).alias("sha256"), F.count("reason").alias("failed"))
    return rows.select("doc_id", "pieces", F.coalesce("longest", F.lit(0).cast("long")).alias("longest"), "sha256", "failed")


def _containers(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """path, content of the documents' containers in a folder, each with its own key."""
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), _mode(), plain_blocks=True, key=own_key())
    return sealed.select(F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"), F.lit(".ceb")).alias("path"), "content", "doc_id")


def _id(path: str) -> Column:
    return F.regexp_extract(path, "([0-9]+)[.][a-z]+$", 1).cast("bigint")


def heads_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers inspected by their heads and small sections, and what was read of them."""
    folder = _folder(spark)
    publish.write(_containers(spark, sf_dir, folder).select("path", "content"))
    found = plan.inspect_heads(containers.heads(spark, folder, pattern="*.ceb").where("length > 100"))
    out = shared.save(found.select(_id("path").alias("doc_id"), "length", F.size("sections").cast("long").alias("n_sections"), "algorithm_id", F.hex("key").alias("key_hex"), "bytes_read"), "heads")
    _removed(folder)
    return out


def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written by manifest; the job is published anew as if the driver had been lost, and changes nothing."""
    folder, job = _folder(spark), shared.path(spark, "publish")
    publish.write(_containers(spark, sf_dir, folder).select(F.regexp_replace("path", "/([^/]*)$", "/below/$1").alias("path"), "content", "doc_id"), job=job)
    shared.delete(spark, f"{job}/{publish.COMMITTED}")
    publish.recover(spark, job)
    again = spark.read.parquet(f"{job}/{publish.COMMITTED}").selectExpr("moved AS moved_again", "there")
    files_ = containers.read(spark, folder, "path", "length")
    out = shared.save(files_.select(_id("path").alias("doc_id"), "length").crossJoin(F.broadcast(again)), "published")  # one row
    _removed(folder)
    return out


def ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over containers of which a third is cut off in the first: later runs take up what failed and what is new alone."""
    folder = _folder(spark)
    ledger = f"{shared.path(spark, 'ledger')}"
    whole = shared.save(_containers(spark, sf_dir, f"{folder}/in"), "containers")
    cut = whole.withColumn("content", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.substring("content", 1, 60)).otherwise(F.col("content"))).where("pmod(doc_id, 5) <> 0")
    out = f"{folder}/out"
    runs = [plan_ledger.run(x.select("path", "content"), ledger, out, name, bounds="length").count() for name, x in (("1", cut), ("2", whole), ("3", whole))]
    rows = plan_ledger.latest(spark, ledger).select(_id("file").alias("doc_id"), "run", "code", F.lit(runs[2]).alias("third_run"))
    sizes = containers.read(spark, out, "path", "length").select(_id("path").alias("doc_id"), F.col("length").alias("pdf_bytes"))
    saved = shared.save(rows.join(sizes, "doc_id", "left").select("doc_id", "run", "code", F.col("third_run").cast("long").alias("third_run"), "pdf_bytes"), "ledger-rows")
    shared.drop(whole)
    _removed(folder)
    return saved


def plain_ciphers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second reader on both ciphers, with keys as they are and wrapped: benchmark items."""
    items = _table(spark, sf_dir, "benchmark").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    mode = F.when(F.pmod("item_id", F.lit(2)) == 0, "ofb").otherwise("cfb64")
    blob = F.when(F.pmod("item_id", F.lit(3)) == 0, F.lit(BLOB)).otherwise(F.lit(WRAPPED_KEY))
    pdfs = plain.convert(synth.sealed(items, F.array("text"), mode, key=F.lit(WRAPPED_KEY), blob=blob), "item_id").select(F.col("item_id").cast("string").alias("file"), "pdf")
    rows = streams.streams(pdfs).join(pdfs, "file")
    inflated = plan.inflated(bytesx.piece(F.col("pdf"), F.col("start"), F.col("end") - F.col("start")))
    return rows.select(F.col("file").cast("bigint").alias("item_id"), F.sha2(inflated["data"], 256).alias("sha256"), bytesx.has(F.col("pdf"), b"/Encrypt").alias("locked"))


class Raised(decode.Strategy):
    """Capitals for small letters, where a payload's object, dictionary and key are what they should be."""

    name = "capitals"

    def __init__(self, key: bytes):
        self.key = key

    def decrypt(self, info: decode.StreamInfo, data: bytes) -> bytes:
        known = info.number == info.index + 1 and info.generation == 0 and info.dict_has(b"/Length") and not info.dict_has(b"/Filter") and info.file_key == self.key == synth.KEY and info.size == len(data)
        return data.upper() if known else data


def custom_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads decoded by a strategy of the caller's, which sees each one's object, dictionary and key."""
    payload = lambda tag: F.concat(F.lit(tag), F.coalesce("text", F.lit("")))
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array(payload("a"), payload("b")), "none", flate=False)
    rows = plan.payloads(plan.convert(sealed, strategy=Raised), "doc_id", "decoded.strategy", "decoded.key_source", inflate=False)
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "strategy", "key_source", F.sha2("raw", 256).alias("sha256"))


def complaint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of declared lengths that are wrong and of bytes behind the last section, in order."""
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), "ofb", shift=F.expr("if(doc_id % 7 = 0, 5, 0)"), plain_blocks=True)
    tailed = sealed.withColumn("content", F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat("content", F.lit(b"tail"))).otherwise(F.col("content")))
    out = plan.convert(tailed)
    return out.select("doc_id", "code", "clean", F.array_join("complaints", "\n").alias("complaints"))


def font_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name fonts, with and without a font inside."""
    k = F.pmod("doc_id", F.lit(4))
    payload = F.concat(F.when(k > 0, "/BaseFont /Some ").otherwise(""), F.when(k == 3, "/FontFile2 1 0 R ").otherwise(""), F.coalesce("text", F.lit("")))
    out = plan.convert(synth.sealed(_dealt(spark, sf_dir), F.array(payload), "none", flate=False))
    return out.select("doc_id", F.col("decoded.check.fonts_external").alias("external"), F.size("notes").cast("long").alias("n_notes"))


def odd_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections without bytes, which stay in the table, and sections that begin inside it, which is noted."""
    sealed = synth.sealed(_dealt(spark, sf_dir), F.array("text"), "none", plain_blocks=True)
    third = 31 + 17 * 2
    empty = F.overlay("content", F.lit(bytes(4)), third + 4 + 1, 4)
    early = F.overlay("content", F.lit(b"\x32\x00\x00\x00"), third + 1, 4)
    changed = F.when(F.pmod("doc_id", F.lit(3)) == 0, empty).when(F.pmod("doc_id", F.lit(3)) == 1, early).otherwise(F.col("content"))
    out = plan.convert(sealed.withColumn("content", changed))
    return out.select(
        "doc_id", F.size("sections").cast("long").alias("n_sections"), F.expr("size(filter(sections, s -> s.len = 0))").cast("long").alias("empty"), F.array_join("parse_notes", "; ").alias("notes"), F.size("layout_complaints").cast("long").alias("n_complaints"), F.col("error").isNull().alias("converted")
    )


QUERIES = {f.__name__: f for f in (payload_bounds, streams_sql, payload_details, one_file_attribution, object_classes, reached, payload_pieces, heads_read, published_files, ledger_runs, plain_ciphers, custom_strategy, complaint_texts, font_notes, odd_sections)}

_TURN_N = "octet_length(encode(coalesce(text, '')))"
_TURN_STORED = f"(6 + 5 * greatest(1, cast(ceil({_TURN_N} / 65535.0) AS BIGINT)) + {_TURN_N})"

ORACLES = {
    "payload_bounds": f"""SELECT doc_id, 0 AS code, 0 AS idx, CASE WHEN k IN (1, 2) THEN 'length' ELSE 'keyword' END AS boundary, strlen(p) AS stream_bytes, sha256(p) AS sha256,
        CAST(CASE WHEN k = 3 THEN 2 ELSE 1 END AS BIGINT) AS keyword_payloads, CASE k WHEN 1 THEN strlen(p) - 1 WHEN 2 THEN strlen(p) - 4 WHEN 3 THEN 2 * {_N} + 4 ELSE strlen(p) END AS keyword_bytes
        FROM (SELECT doc_id, text, doc_id % 4 AS k, CASE doc_id % 4 WHEN 1 THEN chr(10) || t WHEN 2 THEN chr(13) || chr(10) || chr(13) || chr(10) || t
            WHEN 3 THEN t || replace('|endstream|endobj|7 0 obj|stream|', '|', chr(10)) || t ELSE t END || chr(13) AS p FROM (SELECT doc_id, text, 'x' || coalesce(text, '') AS t FROM documents))""",
    "streams_sql": f"""SELECT conv_id, row_number() OVER w - 1 AS idx, {_TURN_STORED} + 1 AS size, row_number() OVER w AS number, CAST(0 AS BIGINT) AS generation
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)""",
    "payload_details": f"""SELECT conv_id, row_number() OVER w - 1 AS idx, row_number() OVER w AS number, {_TURN_STORED} AS declared, true AS agrees, true AS flate
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)""",
    "one_file_attribution": """SELECT i.keyword, i.idx, o.number FROM (SELECT l_orderkey * 100 + l_linenumber * 10 - 35 AS keyword, CAST(l_linenumber AS BIGINT) AS idx FROM lineitem) i
        ASOF LEFT JOIN (SELECT o_orderkey * 100 AS at, o_orderkey AS number FROM orders) o ON i.keyword >= o.at""",
    "object_classes": """SELECT doc_id, CAST(n AS BIGINT) AS number, c AS class FROM documents, (VALUES (1, 'misc'), (2, 'misc'), (3, 'misc'), (4, 'font'), (5, 'font'), (6, 'font')) AS t(n, c)
        UNION ALL SELECT doc_id, CAST(10 * i + j AS BIGINT), CASE j WHEN 0 THEN 'misc' ELSE 'page' END FROM documents, range(1, 5) AS p(i), range(0, 2) AS q(j) WHERE i <= doc_id % 4 + 1""",
    "reached": """WITH RECURSIVE r(number, steps) AS (SELECT c_custkey, CAST(0 AS BIGINT) FROM customer WHERE c_custkey % 97 = 0
        UNION SELECT c_custkey // 2, steps + 1 FROM r JOIN customer ON c_custkey = number WHERE number > 0) SELECT number, min(steps) AS steps FROM r GROUP BY number""",
    "payload_pieces": f"SELECT doc_id, greatest(1, CAST(ceil({_N} / 1000.0) AS BIGINT)) AS pieces, least({_N}, 1000) AS longest, sha256(coalesce(text, '')) AS sha256, CAST(0 AS BIGINT) AS failed FROM documents",
    "heads_read": f"""SELECT doc_id, 143 + {_BODY} AS length, CAST(4 AS BIGINT) AS n_sections, doc_id % 3 AS algorithm_id, upper(md5(CAST(doc_id AS VARCHAR))) AS key_hex,
        least(1102, 143 + {_BODY}) + 44 + CASE WHEN {_BODY} <= 4096 THEN {_BODY} ELSE 0 END AS bytes_read FROM documents""",
    "published_files": f"SELECT doc_id, 143 + {_BODY} AS length, CAST(0 AS BIGINT) AS moved_again, (SELECT count(*) FROM documents) AS there FROM documents",
    "ledger_runs": f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN '2' ELSE '1' END AS run, 0 AS code, CAST(0 AS BIGINT) AS third_run, {_BODY} AS pdf_bytes FROM documents""",
    "plain_ciphers": "SELECT item_id, sha256(text) AS sha256, false AS locked FROM benchmark",
    "custom_strategy": """SELECT doc_id, CAST(i AS BIGINT) AS idx, 'capitals' AS strategy, 'direct' AS key_source,
        sha256(translate(['a', 'b'][i + 1] || coalesce(text, '') || chr(13), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS sha256 FROM documents, range(0, 2) AS r(i)""",
    "complaint_texts": f"""SELECT doc_id, CASE WHEN said = '' THEN 0 ELSE 3 END AS code, said = '' AS clean, said AS complaints FROM (SELECT doc_id, array_to_string(list_filter([
        CASE WHEN doc_id % 5 = 0 THEN 'the last section ends at ' || (143 + {_BODY.replace(_STORED, 's')} + g) || ', the file at ' || (147 + {_BODY.replace(_STORED, 's')} + g) END,
        CASE WHEN doc_id % 7 = 0 THEN '1 payload(s) differ in length from their /Length: the keyword scan cut them elsewhere' END,
        CASE WHEN doc_id % 7 = 0 THEN '  payload 0 (object 1 0): ' || (n + 5) || ' bytes declared, ' || (n + 1) || ' found' END], lambda x: x IS NOT NULL), chr(10)) AS said
        FROM (SELECT doc_id, {_STORED} AS n, length(CAST({_STORED} + CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END AS VARCHAR)) - length(CAST({_STORED} AS VARCHAR)) AS g, {_STORED} AS s FROM documents))""",
    "font_notes": "SELECT doc_id, doc_id % 4 IN (1, 2) AS external, CAST(CASE WHEN doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS BIGINT) AS n_notes FROM documents",
    "odd_sections": """SELECT doc_id, CAST(4 AS BIGINT) AS n_sections, CAST(CASE WHEN k = 0 THEN 1 ELSE 0 END AS BIGINT) AS empty, CASE WHEN k = 1 THEN 'section data begins at 50, inside the header and table of 99 bytes: the last type byte is data' ELSE '' END AS notes,
        CAST([1, 2, 0][k + 1] AS BIGINT) AS n_complaints, true AS converted FROM (SELECT doc_id, doc_id % 3 AS k FROM documents)""",
}
