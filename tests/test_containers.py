"""Containers: parsing, roles, decoding, attribution, reports, planning and the command line."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from codicil import cli, synth
from codicil.functions import bytesx, pdfbytes
from codicil.operators import decode, report, roles, sections, streams
from codicil.plans import convert, outputs
from codicil.sources import sink

TEXT = zlib.compress(b"hello, container " * 20)
KEY = synth.KEY
WRAPPED_KEY = bytes.fromhex("a1e7f815671f82812870e2315352f1569a4cb39584f08b03")
BLOB = bytes.fromhex("a2c8c0244570858b23ccaf50cd41862fd3b0a159f4101be7d1208abcfe5e2df4237032acf107c5130792876aff1cda946b5ecb70e0332ade601950ef1aa8fac4")
PARTS = [(3, b"B" * 100), (4, b"k" * 16), (5, b"t" * 24), (16, b"\x02\0\0\0")]


def files(spark, *contents):
    return spark.createDataFrame([(f"/in/f{i}.x", len(c or b""), bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "path string, length long, content binary")


def ordered(df, *columns):
    return [tuple(r) for r in df.orderBy("path").select(*columns).collect()]


def test_errors_of_parsing(spark):
    good = synth.container(PARTS)
    cut = bytearray(good)
    struct.pack_into("<I", cut, 31 + 17 * 3, 10**6)
    wild = bytearray(good)
    for i in range(4):
        struct.pack_into("<I", wild, 31 + 17 * i, 10**6)
    many = bytearray(good)
    struct.pack_into("<H", many, 20, 5000)
    none = bytearray(good)
    struct.pack_into("<H", none, 20, 0)
    four = bytearray(good)
    four[14] = 4
    cases = [good, b"", None, b"PK\x03\x04" * 20, b"@XDA" * 20, good[:20], bytes(four), bytes(many), bytes(none), good[:60], bytes(wild), bytes(cut), synth.container(PARTS, b"2.99D\0\0\0", True), synth.container(PARTS, b"\x01\0", True)]
    rows = ordered(sections.parse(files(spark, *cases)).withColumn("path", F.lpad(F.regexp_extract("path", "[0-9]+", 0), 2, "0")), "error.code", "error.message", F.size("sections"), "parse_notes")
    want = [None, "NOT_A_CONTAINER", "NOT_A_CONTAINER", "NOT_A_CONTAINER", "NOT_A_CONTAINER", "TRUNCATED", "UNSUPPORTED_VERSION", "BAD_SECTION_TABLE", "BAD_SECTION_TABLE", "TRUNCATED", "BAD_SECTION_TABLE", None, None, "UNSUPPORTED_VERSION"]
    assert [r[0] for r in rows] == want
    assert "XDA" in rows[4][1] and "truncated" in rows[5][1]
    assert rows[11][2] == 3 and len(rows[11][3]) == 1
    assert rows[12][3] == ["labelled header, version `2.99D`"]


def test_roles(spark):
    wrong = [(2, b"B" * 100), (7, b"k" * 16), (1, b"t" * 64), (34, b"\x01\0\0\0")]
    two = [(3, b"B" * 100), (9, b"a" * 16), (4, b"b" * 16), (5, b"t" * 24)]
    neither = [(3, b"B" * 100), (9, b"a" * 16), (8, b"b" * 16)]
    tie = [(3, b"A" * 100), (3, b"B" * 100), (4, b"k" * 16)]
    lost = [(3, b"B" * 100), (5, b"t" * 24)]
    decoy = [(3, b""), (2, b"B" * 64), (4, b"k" * 16)]
    rows = ordered(roles.resolve(sections.parse(files(spark, *map(synth.container, (PARTS, wrong, two, neither, tie, lost, decoy))))), "body.idx", "body_key.idx", "key_blob.idx", "algorithm.idx", F.size("role_notes"), "guessed", "error.code")
    assert rows == [(0, 1, 2, 3, 0, False, None), (0, 1, 2, 3, 4, False, None), (0, 2, 3, None, 1, True, None), (0, 1, None, None, 2, True, None), (1, 2, None, None, 0, False, None), (0, None, 1, None, 0, False, "MISSING_SECTION"), (1, 2, None, None, 1, False, None)]


def test_layout_complaints(spark):
    gap = bytearray(synth.container(PARTS))
    struct.pack_into("<I", gap, 31 + 17 + 4, 15)
    rows = ordered(sections.parse(files(spark, synth.container(PARTS), bytes(gap), synth.container(PARTS, tail=b"x"))).withColumn("c", sections.layout_complaints()), F.size("c"))
    assert [r[0] for r in rows] == [0, 1, 1]


def sealed(mode="cfb64", payloads=(TEXT,), declared=None, lock="/Encrypt 9 0 R", **options):
    return synth.seal(*synth.pdf(list(payloads), declared, lock), mode=mode, **options)


def test_round_trips(spark):
    cases = [sealed("none"), sealed("ofb"), sealed("cfb64"), sealed("cfb64", key=WRAPPED_KEY, blob=BLOB, algorithm=0x80000002), sealed("none", version=b"2.99D\0\0\0", labelled=True)]
    out = convert.convert(files(spark, *cases))
    rows = ordered(out, "code", "clean", "decoded.key_source", "decoded.encrypt.kind", "decoded.check.flate_ok", "decoded.pdf")
    plain = synth.pdf([TEXT])[0].replace(b"/Encrypt 9 0 R", b" " * 14)
    assert [r[:5] for r in rows] == [(0, True, s, "blanked", 1) for s in ("not needed", "direct", "direct", "wrapped", "not needed")]
    assert all(bytes(r[5]) == plain for r in rows)


def test_refusals_and_wrong_modes(spark):
    bad_key = synth.container([(3, b"%PDF-nothing" * 30), (4, b"w" * 16), (16, bytes(4))])
    no_blob = synth.container([p for p in PARTS if p[0] != 5])
    cases = [sealed(algorithm=0x80000009), bad_key, no_blob, sealed(blob=b"?" * 64, algorithm=2)]
    rows = ordered(convert.convert(files(spark, *cases)), "code", "error.code", "error.message")
    assert [r[:2] for r in rows] == [(1, "UNKNOWN_ALGORITHM"), (1, "BODY_LAYER_FAILED"), (1, "BODY_LAYER_FAILED"), (1, "UNWRAP_FAILED")]
    assert "0x80000009" in rows[0][2] and "--force-mode" in rows[0][2]
    wrong = ordered(convert.convert(files(spark, sealed("cfb64"), sealed("ofb", algorithm=2))), "code", F.expr("exists(complaints, c -> c LIKE '%do not inflate%')"))
    assert wrong == [(0, False), (3, True)]
    forced = ordered(convert.convert(files(spark, sealed("cfb64", algorithm=0x80000009)), strategy="cfb64"), "code", "decoded.forced")
    assert forced == [(1, None)]  # the flag says wrapped, the blob is not


def test_custom_strategy(spark):
    class Blank(decode.Strategy):
        name = "blank"

        def __init__(self, key):
            self.key = key

        def decrypt(self, info, data):
            assert info.number == 1 and info.dict_has(b"/FlateDecode") and len(info.file_key) == 24
            return bytes(len(data))

    class Short(Blank):
        def decrypt(self, info, data):
            return b""

    out = ordered(convert.convert(files(spark, sealed()), strategy=Blank, verify=False), "decoded.strategy", "decoded.check", "code")
    assert out == [("blank", None, 0)]
    assert ordered(convert.convert(files(spark, sealed()), strategy=Short), "error.code") == [("LENGTH_CHANGED",)]
    with pytest.raises(ValueError):
        convert.convert(files(spark, sealed()), strategy="rot13")


def test_lengths_and_lists(spark):
    seven = sealed("none", [TEXT] * 7, [1] * 7)
    junk = sealed("none", [b"junk" * 5] * 8)
    rows = ordered(convert.convert(files(spark, seven, junk)), "decoded.check.mismatch_total", F.size("decoded.check.mismatches"), "decoded.check.bad_total", F.size("decoded.check.bad"), F.expr("exists(complaints, c -> c LIKE '%and 3 more%')"))
    assert rows == [(7, 5, 0, 0, False), (0, 0, 8, 5, True)]


def test_declared_lengths():
    doc = b"%PDF-1.4\n1 0 obj\n<</Length 2 0 R>>\nstream\nABCDE\nendstream\nendobj\n2 0 obj\n5\nendobj\n3 0 obj\n<</Length1 9 /Length 3>>stream\nabc\nendstream\n4 0 obj <</Length 99 0 R>> stream\nxyz\nendstream"
    payloads = pdfbytes.scan(doc)
    objects = pdfbytes.first_objects(doc, payloads)
    # the second has /Length1 before /Length: by the short name no number follows
    assert [pdfbytes.declared_length(doc, p, objects) for p in payloads] == [5, 1, None]
    assert pdfbytes.declared_length(doc, payloads[1], objects, exact_name=True) == 3
    assert [p.number for p, _ in pdfbytes.length_mismatches(doc, payloads)] == [3]
    assert pdfbytes.length_mismatches(doc, payloads, exact_name=True) == []


def test_scan_rules():
    doc = b"1 0 obj<<>>stream\r\n\n\rA obj 7 0 obj \nendstream endobj 70000 70000 obj x 12 1\x00obj stream endstream stream never ends"
    found = pdfbytes.scan(doc)
    assert [(doc[p.start : p.end], p.number, p.generation) for p in found] == [(b"A obj 7 0 obj \n", 1, 0), (b" ", 12, 1)]
    assert pdfbytes.scan(b"stream no end") == [] and pdfbytes.scan(b"") == []


def test_unlock():
    for text, kind in ((b"<</Encrypt 9 0 R /Encrypt 8 0 R>>", "blanked"), (b"<</Encrypt " + b"x" * 80 + b"R", "malformed"), (b"<<>>", "absent")):
        doc = bytearray(text)
        assert pdfbytes.unlock(doc)[0] == kind and len(doc) == len(text)
        assert kind == "blanked" or bytes(doc) == text


def test_attribution_by_joins_is_that_of_the_scan(spark):
    docs = {"a": b"1 0 obj<<>>stream\nA 7 0 obj \nendstream endobj stream\nx\nendstream", "b": b"stream\nq\nendstream 3 1 obj stream endstream", "c": b"", "d": synth.pdf([TEXT] * 4)[0]}
    got = streams.streams(spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "file string, pdf binary")).collect()
    want = [(k, p.idx, p.start, p.end, p.dict_start, p.dict_end, p.number, p.generation) for k, v in docs.items() for p in pdfbytes.scan(v)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_column_helpers(spark):
    df = spark.createDataFrame([(bytearray(b"ab\x00 12x ab"), "0a 0B\n0c")], "b binary, h string")
    b = F.col("b")
    row = df.select(bytesx.find(b, "ab"), bytesx.rfind(b, "ab"), bytesx.find(b, "zz"), bytesx.hex_decode(F.col("h")), bytesx.hex_decode(F.lit("abc")), bytesx.hex_decode(F.lit("zz")), bytesx.le_uint(F.lit(b"\x01\x02")), bytesx.read_uint(b, F.lit(4)), bytesx.skip_space(b, F.lit(2)), bytesx.grouped(F.lit(5158838)), bytesx.printable(b), bytesx.wrap(F.lit("one two three four five"), 9), bytesx.wrap(F.lit(""), 9), bytesx.find(b, "ab", 1)).first()
    assert tuple(row[:3]) == (0, 8, None) and bytes(row[3]) == b"\n\x0b\x0c" and row[4] is None and row[5] is None
    assert row[6] == 0x201 and tuple(row[7]) == (12, 6) and row[8] == 4 and row[9] == "5,158,838" and row[10] == "ab 12x ab"
    assert row[11] == ["one two", "three", "four five"] and row[12] == [] and row[13] == 8


def test_output_planning(spark):
    paths = spark.createDataFrame([("/in/a-v2.5-7.ceb",), ("/in/.hidden",), ("/in/b",)], "path string")
    assert [r[0] for r in outputs.plan(paths).select("output").collect()] == ["/in/a-v2.5-7.pdf", "/in/.hidden.pdf", "/in/b.pdf"]
    assert outputs.plan(paths, "/out", True).first()["output"] == "/out/a-v2.5-7.pdf"
    same = spark.createDataFrame([("/in/a.ceb",), ("/in/a.x",)], "path string")
    for frame, target, code in ((same, None, "OUTPUT_COLLISION"), (spark.createDataFrame([("/in/x/../a.pdf",)], "path string"), "/in/a.pdf", "OUTPUT_IS_INPUT"), (same, "/out.pdf", "OUTPUT_NOT_A_DIRECTORY")):
        with pytest.raises(outputs.PlanError) as e:
            outputs.refuse_unsafe(outputs.plan(frame, target), target, target is None)
        assert e.value.code == code


def test_file_sink(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / "a"), bytearray(b"\0\xff")), (str(tmp_path / "b"), None)], "path string, content binary")
    sink.write_files(rows)
    assert (tmp_path / "a").read_bytes() == b"\0\xff" and (tmp_path / "b").read_bytes() == b"" and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(Exception, match="exists already"):
        sink.write_files(rows)
    sink.write_files(rows, force=True)
    writer = sink.FileWriter(False)
    with pytest.raises(FileExistsError):
        writer.write(iter([(str(tmp_path / "new"), b"x"), (str(tmp_path / "a"), b"y")]))
    lost = tmp_path / f".gone.{writer.job}-0-0"
    lost.write_bytes(b"half")
    writer.commit([writer.write(iter([(str(tmp_path / "new"), b"x")]))])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "new"]


def test_command_line(spark, tmp_path, capfd):
    good, warned = tmp_path / "good.ceb", tmp_path / "warned.v2.ceb"
    good.write_bytes(sealed())
    warned.write_bytes(sealed("ofb", algorithm=2))
    bad = tmp_path / "bad.ceb"
    bad.write_bytes(b"PK")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run(good, "-vv") == 0
    assert (tmp_path / "good.pdf").read_bytes().startswith(b"%PDF-")
    assert "sections:" in capfd.readouterr().out
    assert run(good) == 1 and "exists already" in capfd.readouterr().err
    assert run(good, warned, bad, "-fq") == 3
    said = capfd.readouterr()
    assert said.out == "" and "INCOMPLETE" in said.err and (tmp_path / "warned.v2.pdf").exists()
    assert run(good, warned, bad, "-f", "--strict-exit") == 1
    assert run("--dump-meta", good, bad) == 1
    assert "resolved" in capfd.readouterr().out
    assert run(warned, "-f", "--force-mode=ofb") == 0
    assert run(tmp_path / "none.ceb") == 1
    for wrong in ([], ["-q", "-v", "a"], ["--nope", "a"], ["-j0", "a"], ["--force-mode", "x", "a"]):
        assert cli.main(wrong, spark) == 1


def test_report_columns(spark):
    out = convert.convert(files(spark, sealed(), b"PK", sealed("none", lock="/Encrypt " + "x" * 80)))
    flat = {r["path"]: r for r in convert.conversion_report(out, "path").collect()}
    assert [flat[f"/in/f{i}.x"]["code"] for i in range(3)] == [0, 1, 3]
    assert report.exit_codes(out).first() == (3, 1)


def test_stream_of_files(spark, tmp_path):
    from codicil.streaming import incremental

    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / name).write_bytes(sealed())
        incremental.convert_stream(incremental.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("code").count() == 2


def test_both_scans_agree_on_plain_documents():
    doc, ranges = synth.pdf([TEXT] * 3)
    assert [(n, s, size) for n, s, size, _ in pdfbytes.object_streams(doc)] == [(i + 1, s, e - s) for i, (s, e) in enumerate(ranges)]
    assert pdfbytes.object_streams(b"1 0 obj 5 endobj stream x endstream") == []


def test_evidence(spark):
    from codicil.operators import evidence

    texts = [zlib.compress(bytes(range(256)) * 4 + bytes([i]), 0) for i in range(5)]
    from codicil.functions import kernels

    rows = spark.createDataFrame([(i, bytearray(kernels.cfb64_encrypt(KEY, t)), bytearray(KEY)) for i, t in enumerate(texts)], "n int, raw binary, key binary")
    swept = {(r["mode"], r["chunk"]): (r["tried"], r["inflating"]) for r in evidence.mode_sweep(rows, evidence.grid(spark)).collect()}
    assert len(swept) == 24 and all(v == (5, 5 if k == ("cfb64", 256) else 0) for k, v in swept.items())
    assert [r[0] for r in evidence.first_differences(rows).collect()] == [8]
    assert evidence.ambiguous(rows, "n").count() == 0
    sizes = evidence.sizes_by_mode(rows, "n").collect()
    assert all(r["cfb64"] == 1025 and r["ofb"] is None and r["cfb8"] is None for r in sizes)
    pdfs = spark.createDataFrame([("f", bytearray(b"/Contents 4 0 R /FontFile2 9 0 R /Contents 4 0 R"))], "file string, pdf binary")
    objects = spark.createDataFrame([("f", 4), ("f", 9), ("f", 5)], "file string, number long")
    found = evidence.classes(objects, evidence.references(pdfs, "Contents"), evidence.references(pdfs, "FontFile2")).collect()
    assert {r["number"]: r["class"] for r in found} == {4: "page", 9: "font", 5: "misc"}
    assert evidence.bitmap_text(b"\xa0\x40", 3) == ["#.#", ".#."]


def test_metadata(spark):
    extra = [*PARTS, (0, b"<xml/>"), (255, b"Maker\x00\x00 3.2 \x01" + b" " * 136)]
    out = convert.inspect(files(spark, synth.container(extra), synth.container([PARTS[0]])))
    rows = report.metadata_dump(out, producer_by_shape=True).orderBy("path").collect()
    assert "xml metadata : 6 B" in rows[0]["dump"] and "producer     : Maker 3.2" in rows[0]["dump"] and "algorithm=0x00000002" in rows[0]["dump"]
    assert "FAILED" in rows[1]["dump"] and rows[1]["code"] == 0
    assert bytes(out.select(sections.raw_of_type(0, unclaimed_only=True)).first()[0]) == b"<xml/>"


def test_the_second_reader_agrees(spark):
    """Containers at random, read by the whole pass and by the serial reader, which share no cipher and no parser."""
    import random

    from codicil.operators import plain

    r, cases = random.Random(7), []
    for i in range(24):
        mode = ("none", "ofb", "cfb64")[i % 3]
        key = bytes(r.randrange(256) for _ in range(24))
        payloads = [zlib.compress(bytes(r.randrange(256) for _ in range(r.randrange(0, 700)))) for _ in range(r.randrange(1, 4))]
        wrapped = i % 5 == 0 and mode != "none"
        cases.append(synth.seal(*synth.pdf(payloads), mode=mode, key=WRAPPED_KEY if wrapped else key, blob=BLOB if wrapped else None, version=b"v2.5\0\0\0\0" if i % 4 == 0 else b"\0\0\3\0", labelled=i % 4 == 0))
    got = ordered(convert.convert(files(spark, *cases)).withColumn("path", F.lpad(F.regexp_extract("path", "[0-9]+", 0), 2, "0")), "decoded.pdf", "code")
    assert [(bytes(pdf), code) for pdf, code in got] == [(plain.document(c), 0) for c in cases]


def test_block_cipher_of_the_second_reader():
    from codicil.operators import plain

    # A published known answer of the cipher, with three equal keys.
    key = bytes.fromhex("133457799bbcdff1")
    assert plain.block_cipher(key * 3, bytes.fromhex("0123456789abcdef")).hex() == "85e813540f0ab405"


def test_too_large_is_not_the_same_as_broken(spark):
    rows = convert.convert(files(spark, sealed("none", [TEXT, b"junk" * 9, zlib.compress(b"")[:-5]])))
    got = [(r["data"] is not None, r["reason"]) for r in convert.payloads(rows, "path").orderBy("idx").collect()]
    assert got[0] == (True, None) and not got[1][0] and got[1][1].startswith("Error") and not got[2][0]
    got = convert.payloads(rows, "path", limit=10).orderBy("idx").first()
    assert got["data"] is None and got["reason"] == "too large for a row"


def test_many_keys_at_once():
    import random

    from codicil.functions import kernels

    r = random.Random(2)
    keys = [bytes(r.randrange(256) for _ in range(r.choice([16, 24]))) for _ in range(120)]
    parts = [bytes(r.randrange(256) for _ in range(r.randrange(0, 600))) for _ in keys]
    for mode, one in (("ofb", kernels.ofb), ("cfb64", kernels.cfb64_decrypt), ("none", lambda k, p: p)):
        for reset in (256, 64) if mode != "none" else (256,):
            assert kernels.decrypt_parts(mode, keys, parts, reset) == [one(k, p, reset) if mode != "none" else p for k, p in zip(keys, parts, strict=True)]
    assert kernels.apply_bodies(keys, parts) == [kernels.apply_body(k, p).tobytes() for k, p in zip(keys, parts, strict=True)]
