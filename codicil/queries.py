"""Queries over the driver's tables and the SQL that must give the same rows.

The first group seals the tables' texts into containers and recovers them by the
whole pipeline. The second exercises, on other tables, the relational idioms that
the pipeline rests on; those are not features of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil import queries_files, queries_more, synth
from codicil.functions import bytesx
from codicil.operators import evidence, idioms, report, roles, sections, streams
from codicil.plans import convert as plan
from codicil.plans import outputs

FORCED_WRONG = {"cfb64": "ofb", "ofb": "cfb64"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, mode="cfb64", **options) -> DataFrame:
    # The tables are one small file each; sealing is made parallel by hand.
    docs = _table(spark, sf_dir, "documents").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return synth.sealed(docs, F.array("text"), mode, **options)


def _mixed():
    return F.expr("element_at(array('none', 'ofb', 'cfb64'), cast(doc_id % 3 AS int) + 1)")


def _roundtrip(mode):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = plan.convert(_documents(spark, sf_dir, _mixed() if mode == "mixed" else mode))
        return plan.payloads(out, "doc_id").select("doc_id", F.decode("data", "UTF-8").alias("text"))

    return query


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section rows of containers whose sizes follow from the texts."""
    parsed = sections.parse(_documents(spark, sf_dir, "none", plain_blocks=True))
    return sections.sections(parsed, "doc_id").select("doc_id", F.col("idx").cast("int").alias("idx"), "ty", "type_name", "offset", "len", "end")


def roles_scrambled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles where every type code is wrong, and the number of notes."""
    out = roles.resolve(sections.parse(_documents(spark, sf_dir, "none", plain_blocks=True, wrong_types=True)))
    return out.select("doc_id", "body.idx", F.col("body_key.idx").alias("key_idx"), F.col("key_blob.idx").alias("blob_idx"), F.col("algorithm.idx").alias("algorithm_idx"), F.size("role_notes").alias("notes"), "guessed")


def roles_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over exploded section rows."""
    rows = sections.sections(sections.parse(_documents(spark, sf_dir, "none", plain_blocks=True, wrong_types=True)), "doc_id")
    return roles.roles_by_rank(rows, "doc_id")


def conversation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a payload: a document for each conversation, a stream for each turn."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    out = plan.convert(synth.sealed(turns.select("conv_id", F.col("t.text").alias("texts")), F.col("texts"), "ofb"))
    rows = plan.payloads(out, "conv_id")
    return rows.select("conv_id", F.col("idx").cast("long").alias("idx"), "number", F.col("generation").cast("long").alias("generation"), F.decode("data", "UTF-8").alias("text"))


def payload_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same attribution by table functions, an interval anti-join and an as-of join."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    out = plan.convert(synth.sealed(turns.select("conv_id", F.col("t.text").alias("texts")), F.col("texts"), "none"), verify=False)
    rows = streams.streams(out.select(F.col("conv_id").cast("string").alias("file"), F.col("decoded.pdf").alias("pdf")))
    return rows.select(F.col("file").cast("bigint").alias("conv_id"), F.col("idx").cast("long").alias("idx"), "number", F.col("generation").cast("long").alias("generation"))


def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan.convert(_documents(spark, sf_dir, _mixed()))
    check = "decoded.check."
    return out.groupBy("lang").agg(
        F.sum(check + "flate_streams").alias("flate"), F.sum(check + "flate_ok").alias("ok"), F.sum(check + "bad_total").alias("bad"), F.sum(check + "inflated_bytes").alias("inflated_bytes"), F.count_if("clean").alias("clean")
    )


def wrong_mode_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing passes under the other feedback mode."""
    out = plan.convert(_documents(spark, sf_dir, "cfb64", plain_blocks=True), strategy=FORCED_WRONG["cfb64"])
    return out.select("doc_id", F.col("decoded.check.flate_ok").alias("flate_ok"), "clean", "code")


def mode_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payloads, short ones and those of null texts too, that inflate for each of the three modes and restart interval."""
    out = plan.convert(_documents(spark, sf_dir, "cfb64", plain_blocks=True), strategy="none", verify=False)
    raw = plan.payloads(out, "doc_id", inflate=False).where("flate").select("raw", F.lit(synth.KEY).alias("key"))
    return evidence.mode_sweep(raw, evidence.grid(spark)).select("mode", F.col("chunk").cast("long").alias("chunk"), "tried", "inflating")


def sweep_by_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts, with candidates ruled out by prefixes of payloads."""
    out = plan.convert(_documents(spark, sf_dir, "cfb64", plain_blocks=True), strategy="none", verify=False)
    raw = plan.payloads(out, "doc_id", inflate=False).where("flate").select("raw", F.lit(synth.KEY).alias("key"))
    return evidence.sweep_by_elimination(raw).select("mode", F.col("chunk").cast("long").alias("chunk"), "tried", "inflating")


def status_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan.convert(_documents(spark, sf_dir, "ofb", shift=F.expr("if(doc_id % 7 = 0, 5, 0)")))
    return report.exit_codes(out, "source")


def length_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared lengths that are wrong on purpose in every seventh document."""
    out = plan.convert(_documents(spark, sf_dir, "none", shift=F.expr("if(doc_id % 7 = 0, 5, 0)"), plain_blocks=True))
    rows = out.select("doc_id", F.explode("decoded.check.mismatches").alias("m"))
    return rows.select("doc_id", F.col("m.scanned").alias("scanned"), F.col("m.declared").cast("bigint").alias("declared"))


def encrypt_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the trailer's reference was blanked."""
    out = plan.convert(_documents(spark, sf_dir, "none", plain_blocks=True), verify=False)
    pdf = F.col("decoded.pdf")
    return out.select("doc_id", F.col("decoded.encrypt.kind").alias("kind"), F.col("decoded.encrypt.at").alias("at"), F.col("decoded.encrypt.len").alias("len"), F.length(pdf).cast("long").alias("pdf_bytes"), F.startswith(pdf, F.lit(b"%PDF-")).alias("header"), bytesx.has(F.substring(pdf, -2048, 2048), b"%%EOF").alias("eof"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of recovered pages."""
    pages = synth.sealed(_table(spark, sf_dir, "pages").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), F.array("html"), "cfb64")
    return plan.payloads(plan.convert(pages, verify=False), "page_id").select("page_id", F.sha2("data", 256).alias("sha256"), F.length("data").cast("long").alias("n_bytes"))


def hex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = bytesx.hex_encode(F.encode("text", "UTF-8"))
    spaced = F.concat_ws(" ", F.substring(coded, 1, 10), F.substring(coded, 11, 1 << 30))
    return docs.select("doc_id", F.md5(bytesx.hex_decode(spaced)).alias("md5"), F.length(coded).cast("long").alias("digits"), bytesx.hex_decode(F.concat(F.lit("a"), coded)).isNull().alias("odd_refused"))


def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output paths of the pages' addresses, and which outputs collide or would overwrite an input."""
    planned = outputs.plan(_table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".v2.ceb")).alias("path")))
    hit = outputs.collisions(planned).select("output", "inputs")
    return planned.join(hit, "output", "left").select("page_id", "output", F.coalesce("inputs", F.lit(1)).cast("long").alias("inputs"))


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view at or before it."""
    events = _table(spark, sf_dir, "events")
    kinds = [r[0] for r in events.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(2).collect()]
    left, right = events.where(F.col("event_type") == kinds[0]).select("user_id", "ts", "event_id"), events.where(F.col("event_type") == kinds[-1]).select("user_id", "ts", F.col("event_id").alias("seen"))
    return idioms.as_of(left, right, ["user_id"], "ts", ["seen"], "seen").select("user_id", "event_id", F.col("asof_seen").alias("seen"))


def interval_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that no span of 3 from a returned line covers."""
    lines = _table(spark, sf_dir, "lineitem")
    points = lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), "l_partkey")
    spans = lines.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("s")).withColumn("e", F.col("s") + 3)
    return idioms.outside(points, spans, "l_orderkey", "n", "s", "e")


def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the first order of theirs."""
    orders = _table(spark, sf_dir, "orders")
    return idioms.first_match(_table(spark, sf_dir, "customer").select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority"), ["c_custkey"], "o_orderkey", "o_orderpriority")


def semi_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that some line returns."""
    lines = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return _table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idioms.repeated(_table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


def argmax_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order in the greatest whole thousand of price; of equals the last."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("thousands"), "o_orderkey", "o_orderstatus")
    return idioms.last_of_largest(orders, "o_custkey", "thousands", "o_orderkey")


def adjacent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer whose status is not that of the next."""
    return idioms.followed_by_other(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey"], "o_orderstatus")


def first_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first documents of each language and how many more there are."""
    return idioms.first_few(_table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 5).select("lang", "doc_id", F.col("place").cast("long").alias("place"), "total", "more")


def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).otherwise(0)).alias("kept_quantity"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the sets of keys that refer to them."""
    objects = _table(spark, sf_dir, "supplier").select(F.lit("f").alias("file"), F.col("s_suppkey").alias("number"))
    lines = _table(spark, sf_dir, "lineitem").select(F.lit("f").alias("file"), F.col("l_suppkey").alias("number"), "l_returnflag", "l_quantity")
    out = evidence.classes(objects, lines.where("l_returnflag = 'R' AND l_quantity > 49"), lines.where("l_quantity > 48"))
    return out.select("number", "class")


def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by return flag of each status, as columns."""
    return _table(spark, sf_dir, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))


_N = "octet_length(encode(text))"
_STORED = f"(6 + 5 * greatest(1, cast(ceil({_N} / 65535.0) AS BIGINT)) + {_N})"
#: A document's bytes: fixed parts, the payload, and the digits of its length.
_BODY = f"({_STORED} + length(cast({_STORED} AS VARCHAR)) + 9 + 8 + 30 + 11 + 18 + 64)"

QUERIES = {
    "roundtrip_none": _roundtrip("none"), "roundtrip_ofb": _roundtrip("ofb"), "roundtrip_cfb64": _roundtrip("cfb64"), "roundtrip_mixed": _roundtrip("mixed"),
    "sections": section_rows, "roles_scrambled": roles_scrambled, "roles_ranked": roles_ranked, "streams": conversation_payloads, "payload_attribution": payload_attribution,
    "verify_counts": verify_counts, "wrong_mode_detected": wrong_mode_detected, "mode_sweep": mode_sweep, "status_by_source": status_by_source, "length_mismatch": length_mismatch, "encrypt_patch": encrypt_patch,
    "digest": digest, "hex_round_trip": hex_round_trip, "output_plan": output_plan, "asof_events": asof_events, "interval_anti": interval_anti, "first_match_join": first_match_join, "semi_join_keys": semi_join_keys,
    "sweep_by_elimination": sweep_by_elimination, "repeated_texts": repeated_texts, "argmax_last": argmax_last, "adjacent_status": adjacent_status, "first_five": first_five, "conditional_counts": conditional_counts, "classified": classified, "pivot_counts": pivot_counts, **queries_files.QUERIES, **queries_more.QUERIES,
}

_TURNS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS idx, text FROM conversations"
_TEXTS = "SELECT doc_id, text FROM documents"
ORACLES = {
    **{f"roundtrip_{m}": _TEXTS for m in ("none", "ofb", "cfb64", "mixed")},
    "sections": f"""WITH d AS (SELECT doc_id, {_BODY} AS b FROM documents),
        s AS (SELECT doc_id, 0 AS idx, 3 AS ty, 'PDF body' AS type_name, 99 AS "offset", b AS len FROM d
        UNION ALL SELECT doc_id, 1, 4, 'RC4 key', 99 + b, 16 FROM d UNION ALL SELECT doc_id, 2, 5, '3DES key blob', 115 + b, 24 FROM d UNION ALL SELECT doc_id, 3, 16, 'algorithm id', 139 + b, 4 FROM d)
        SELECT doc_id, idx, ty, type_name, "offset", len, "offset" + len AS "end" FROM s""",
    "roles_scrambled": "SELECT doc_id, 0 AS idx, 1 AS key_idx, 2 AS blob_idx, 3 AS algorithm_idx, 4 AS notes, false AS guessed FROM documents",
    "roles_ranked": "SELECT doc_id, role, idx FROM documents, (VALUES ('body', 0), ('body_key', 1), ('key_blob', 2), ('algorithm', 3)) AS r(role, idx)",
    "streams": f"SELECT conv_id, idx, idx + 1 AS number, CAST(0 AS BIGINT) AS generation, text FROM ({_TURNS})",
    "payload_attribution": f"SELECT conv_id, idx, idx + 1 AS number, CAST(0 AS BIGINT) AS generation FROM ({_TURNS})",
    "verify_counts": f"SELECT lang, count(*) AS flate, count(*) AS ok, CAST(0 AS BIGINT) AS bad, CAST(sum({_N}) AS BIGINT) AS inflated_bytes, count(*) AS clean FROM documents GROUP BY lang",
    "wrong_mode_detected": "SELECT doc_id, 0 AS flate_ok, false AS clean, 3 AS code FROM documents",
    "mode_sweep": f"""WITH d AS (SELECT {_STORED} AS m FROM (SELECT coalesce(text, '') AS text FROM documents))
        SELECT mode, CAST(chunk AS BIGINT) AS chunk, count(*) AS tried, count(*) FILTER (mode = 'cfb64' AND (chunk = 256 OR m <= least(chunk, 256))) AS inflating
        FROM d, (VALUES ('ofb'), ('cfb64'), ('cfb8')) AS m(mode), (VALUES (8), (16), (32), (64), (128), (256), (512), (1073741824)) AS c(chunk) GROUP BY mode, chunk""",
    "status_by_source": "SELECT source, max(CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END) AS exit_code, 0 AS any_failed FROM documents GROUP BY source",
    "length_mismatch": f"SELECT doc_id, {_STORED} + 1 AS scanned, {_STORED} + 5 AS declared FROM documents WHERE doc_id % 7 = 0",
    "encrypt_patch": f"SELECT doc_id, 'blanked' AS kind, {_BODY} - 34 AS at, 14 AS len, {_BODY} AS pdf_bytes, true AS header, true AS eof FROM documents",
    "digest": "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS n_bytes FROM pages",
    "hex_round_trip": f"SELECT doc_id, md5(text) AS md5, 2 * {_N} AS digits, true AS odd_refused FROM documents",
    "output_plan": """WITH p AS (SELECT page_id, '/in/' || regexp_replace(url, '^[a-z]+://', '') || '.v2.pdf' AS output FROM pages)
        SELECT page_id, output, count(*) OVER (PARTITION BY output) AS inputs FROM p""",
    "asof_events": """WITH k AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY event_type),
        l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = (SELECT event_type FROM k WHERE r = 1)),
        r AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = (SELECT event_type FROM k WHERE r = 2) GROUP BY user_id, ts)
        SELECT l.user_id, l.event_id, r.seen FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "interval_anti": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, l_partkey FROM lineitem a WHERE NOT EXISTS
        (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R' AND a.l_linenumber >= b.l_linenumber AND a.l_linenumber < b.l_linenumber + 3)""",
    "first_match_join": "SELECT c_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "semi_join_keys": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "repeated_texts": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "argmax_last": """SELECT o_custkey, thousands, o_orderkey, o_orderstatus FROM (SELECT o_custkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, o_orderkey, o_orderstatus,
        row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
    "adjacent_status": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_value FROM orders) WHERE next_value <> o_orderstatus",
    "first_five": """SELECT lang, doc_id, place, total, greatest(total - 5, 0) AS more FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY lang) AS total FROM documents) WHERE place <= 5""",
    "conditional_counts": """SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS discounted,
        CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(trunc(l_quantity) AS BIGINT) ELSE 0 END) AS BIGINT) AS kept_quantity FROM lineitem GROUP BY l_linestatus""",
    "classified": """SELECT s_suppkey AS number, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) THEN 'page'
        WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48) THEN 'font' ELSE 'misc' END AS class FROM supplier""",
    "pivot_counts": "SELECT l_linestatus, " + ", ".join(f"nullif(count(*) FILTER (l_returnflag = '{f}'), 0) AS {f}" for f in "ANR") + " FROM lineitem GROUP BY l_linestatus",
    **queries_files.ORACLES, **queries_more.ORACLES,
}
ORACLES["sweep_by_elimination"] = ORACLES["mode_sweep"]
