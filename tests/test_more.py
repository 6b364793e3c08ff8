"""Prefix scans, table functions, eliminating sweeps, object graphs and payloads in pieces, against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from codicil import synth
from codicil.functions import kernels, pdfbytes
from codicil.operators import evidence, graph, streams, tablefunctions
from codicil.plans import convert as plan


def documents():
    r = random.Random(5)
    out = []
    for i in range(12):
        payloads = [r.choice([zlib.compress(r.randbytes(r.randrange(400))), b"7 0 obj inside " * r.randrange(4), b""]) for _ in range(r.randrange(9))]
        pdf, _ = synth.pdf(payloads, flate=bool(i % 2))
        out.append((f"f{i}", b"9 0 obj\nendobj\n" * r.randrange(5) + pdf))
    return [*out, ("none", None), ("empty", b""), ("words", b"stream endstream 1 0 obj stream\nendstream obj")]


@pytest.mark.parametrize("span", [1, 64, 1 << 20])
def test_attribution_in_spans_is_the_scan(spark, span):
    pdfs = spark.createDataFrame(documents(), "file string, pdf binary")
    payloads, headers = streams.payload_rows(pdfs), streams.header_rows(pdfs)
    alive = streams.live(headers, payloads, span)
    got = sorted(tuple(r) for r in streams.attribute(payloads, alive, span).select("file", "idx", "start", "end", "dict_start", "dict_end", "number", "generation").collect())
    want = sorted((f, p.idx, p.start, p.end, p.dict_start, p.dict_end, p.number, p.generation) for f, pdf in documents() for p in pdfbytes.scan(pdf or b""))
    assert got == want
    heads = {(f, *h) for f, pdf in documents() if pdf for h in pdfbytes.live_headers(pdf, [(s, e) for _, s, e in pdfbytes.payload_ranges(pdf)])}
    assert {tuple(r) for r in alive.select("file", "at", "number", "generation").collect()} == heads


def test_one_file_is_dealt_to_all_tasks(spark):
    headers = spark.range(200_000).select(F.lit("one").alias("file"), (F.col("id") * 40).alias("at"), F.col("id").alias("number"), F.lit(0).alias("generation"), F.lit(None).cast("decimal(20,0)").alias("value"))
    payloads = spark.range(0, 200_000, 3).select(F.lit("one").alias("file"), F.col("id").cast("int").alias("idx"), (F.col("id") * 40 + 10).alias("keyword"), (F.col("id") * 40 + 17).alias("start"), (F.col("id") * 40 + 30).alias("end"))
    found = streams.attribute(payloads, headers)
    assert found.where("number <> idx OR dict_start <> idx * 40L").count() == 0 and found.count() == 66_667
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 60_000


def test_null_files_are_files_of_their_own(spark):
    rows = spark.createDataFrame([(None, 1, 0, 5), (None, 9, 0, None), ("a", 1, 0, None), (None, 3_000_000, 0, None)], "file string, pos bigint, kind int, v int")
    got = {(r["file"], r["pos"]): r["x"] for r in streams.carried(rows, "v", "x").collect()}
    assert got == {(None, 1): 5, (None, 9): 5, ("a", 1): None, (None, 3_000_000): 5}


def test_table_functions_are_the_operators(spark):
    pdfs = spark.createDataFrame(documents(), "file string, pdf binary")
    pdfs.createOrReplaceTempView("some_pdfs")
    tablefunctions.register(spark)
    got = spark.sql(tablefunctions.STREAMS_SQL.format(pdfs="some_pdfs")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, streams.streams(pdfs).collect()))
    headers = spark.sql("SELECT f.file, h.* FROM some_pdfs f, LATERAL pdf_headers(f.pdf) h")
    assert sorted(map(tuple, headers.collect()), key=repr) == sorted(map(tuple, streams.header_rows(pdfs).collect()), key=repr)
    objects = spark.sql("SELECT f.file, o.* FROM some_pdfs f, LATERAL pdf_objects(f.pdf) o")
    assert sorted(map(repr, objects.collect())) == sorted(map(repr, streams.object_rows(pdfs).collect()))
    plain, detailed = spark.sql("SELECT * FROM pdf_payloads(X'00')"), spark.sql("SELECT * FROM pdf_payloads(X'00', detail => true)")
    assert set(detailed.columns) - set(plain.columns) == {"dict_start", "number", "generation", "dict", "declared", "agrees"}
    for wrong in ("pdf_payloads('text')", "pdf_payloads(X'00', bounds => 'guess')", "pdf_payloads(X'00', detail => 3)"):
        with pytest.raises(Exception, match="binary|bounds|constant"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_references_of_a_dictionary():
    found = pdfbytes.references(b"<</Kids [3 0 R\n4 0 R 5 1 R] /Parent 2 0 R/Length 77 /F1 6 0 Rx /Contents 8 0 R/Count 3 0>>")
    assert found == [("Kids", 3, 0), ("Kids", 4, 0), ("Kids", 5, 1), ("Parent", 2, 0), ("Contents", 8, 0)]


def test_elimination_is_the_sweep_for_a_tenth_of_the_bytes():
    r = random.Random(2)
    words = [f"w{r.randrange(3000)}" for _ in range(400)]
    spent = naive = 0
    for i in range(24):
        key, mode = r.randbytes(24), ("ofb", "cfb64")[i % 2]
        plain = zlib.compress(" ".join(r.choices(words, k=r.choice([1, 20, 300, 4000]))).encode(), 6)
        data = kernels.ENCRYPT[mode](key, plain)
        got, n = evidence.eliminated(data, key, ("ofb", "cfb64"), evidence.CHUNKS)
        assert got == {(m, c): kernels.inflate(evidence._decrypted(m, data, key, c))[0] for m in ("ofb", "cfb64") for c in evidence.CHUNKS}
        spent, naive = spent + n, naive + len(data) * len(got)
    assert spent < naive / 5
    big = kernels.ENCRYPT["cfb64"](synth.KEY, zlib.compress(" ".join(r.choices(words, k=60_000)).encode(), 6))
    got, n = evidence.eliminated(big, synth.KEY, evidence.MODES, evidence.CHUNKS)
    assert n < len(big) * len(got) / 10 and [k for k, v in got.items() if v] == [("cfb64", 256)]


@pytest.mark.parametrize("plain", [b"", b"x", b"stored " * 90])
def test_elimination_on_short_and_stored_payloads(plain):
    for mode in ("ofb", "cfb64"):
        data = kernels.ENCRYPT[mode](synth.KEY, synth.stored(plain))
        got, _ = evidence.eliminated(data, synth.KEY, evidence.MODES, evidence.CHUNKS)
        assert got == {(m, c): kernels.inflate(evidence._decrypted(m, data, synth.KEY, c))[0] for m in evidence.MODES for c in evidence.CHUNKS}
    assert evidence.eliminated(b"", synth.KEY, ("ofb",), (8,)) == ({("ofb", 8): None}, 0)


def test_reach_on_random_graphs(spark):
    r = random.Random(9)
    edges = [(f"g{r.randrange(3)}", r.randrange(60), r.randrange(60)) for _ in range(150)] + [("g0", 5, 5), ("g1", None, 3), ("g1", 3, None)]
    roots = [("g0", 1), ("g0", 1), ("g1", 2), ("g2", 99), ("g1", None)]
    want = {(g, n): 0 for g, n in roots if n is not None}
    front = set(want)
    while front:
        front = {(g, b) for g, a, b in edges if (g, a) in front and b is not None} - set(want)
        want |= {n: max(want.values()) + 1 for n in front}
    found = graph.reach(spark.createDataFrame(edges, "file string, number long, target long"), spark.createDataFrame(roots, "file string, number long"))
    assert {(x["file"], x["number"]): x["steps"] for x in found.collect()} == want and found.count() == len(want)
    assert graph.reach(spark.createDataFrame(edges, "file string, number long, target long"), spark.createDataFrame([], "file string, number long")).collect() == []


def test_classes_of_a_document(spark):
    pdf = (
        b"1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]/Count 1>> endobj 3 0 obj <</Parent 2 0 R/Contents [4 0 R 5 0 R]/Resources 6 0 R>> endobj "
        b"4 0 obj <</Length 3>> stream\n9 0 obj /Contents 1 0 R\nendstream endobj 5 0 obj <</Length 7 0 R>> stream\nx\nendstream endobj 6 0 obj <</Font 8 0 R>> endobj 7 0 obj 1 endobj "
        b"8 0 obj <</FontDescriptor 10 0 R>> endobj 10 0 obj <</FontFile2 11 0 R>> endobj 11 0 obj <<>> stream\nf\nendstream endobj 2 0 obj <</Kids[3 0 R]/Extra 12 0 R>> endobj"
    )
    pdfs = spark.createDataFrame([("a", pdf), ("b", None)], "file string, pdf binary")
    assert {r["number"]: r["class"] for r in graph.classified(pdfs).collect()} == {1: "misc", 2: "misc", 3: "misc", 4: "page", 5: "page", 6: "misc", 7: "page", 8: "font", 10: "font", 11: "font"}
    links = {tuple(r) for r in graph.edges(pdfs).collect()}
    assert ("a", 2, "Extra", 12) in links and ("a", 3, "Contents", 5) in links and not any(n == 9 for _, n, _, _ in links)


def test_payloads_in_pieces(spark):
    big = random.Random(1).randbytes(70_000) * 30
    rows = [(1, zlib.compress(big)), (2, zlib.compress(b"")), (3, zlib.compress(big)[:-9]), (4, b"no zlib"), (5, None), (6, b""), (7, zlib.compress(b"abc") + b"more"), (8, zlib.compress(b"z" * 65536))]
    found = plan.inflated_pieces(spark.createDataFrame(rows, "k int, raw binary"), "k", size=1 << 16).orderBy("k", "piece").collect()
    whole = {}
    for r in found:
        whole.setdefault(r["k"], []).append(r)
        assert r["data"] is None or len(r["data"]) <= 1 << 16
    assert {k: [r["piece"] for r in v] for k, v in whole.items()} == {k: list(range(len(v))) for k, v in whole.items()}
    assert all([r["last"] for r in v] == [False] * (len(v) - 1) + [True] for v in whole.values())
    data = {k: b"".join(r["data"] or b"" for r in v) for k, v in whole.items()}
    why = {k: v[-1]["reason"] for k, v in whole.items()}
    assert data[1] == big and data[2] == b"" and data[7] == b"abc" and data[8] == b"z" * 65536 and sorted(whole) == [1, 2, 3, 4, 6, 7, 8]
    assert why[1] is why[2] is why[7] is why[8] is None and why[3] == "truncated deflate stream" and why[6] == "empty stream" and "incorrect header" in why[4]
    assert big.startswith(data[3]) and len(data[3]) > len(big) * 0.9


def test_a_payload_beyond_a_row_in_little_memory():
    """Three billion bytes, without Spark: the generator alone, and what the process grows by."""
    import resource

    import pyarrow as pa

    z = zlib.compressobj(1)
    block = bytes(1 << 24)
    raw = b"".join([z.compress(block) for _ in range(180)] + [z.flush()])

    class Rows:
        schema = []

        def select(self, *names):
            return self

        def mapInArrow(self, run, ddl):
            return run(iter([pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])]))

    before, size, last = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, None
    for batch in plan.inflated_pieces(Rows()):
        size += len(batch.column("data")[0].as_buffer())
        last = batch
    assert size == 180 << 24 and last.column("last")[0].as_py() and last.column("reason")[0].as_py() is None
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    assert hashlib.sha256(raw).digest()
