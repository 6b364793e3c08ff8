"""Payload bounds by declared lengths and by what inflates, against the rule of keywords alone."""

from __future__ import annotations

import random
import zlib

import pytest

from codicil import synth
from codicil.functions import kernels, pdfbytes
from codicil.operators import decode


def opened(payloads, mode="none", key=synth.KEY, bounds="length", flate=True, declared=None, **options):
    document, ranges = synth.pdf(payloads, declared, flate=flate)
    body = bytearray(document)
    for s, e in ranges:
        body[s:e] = kernels.ENCRYPT[mode](key, document[s:e]) if mode != "none" else document[s:e]
    return decode.decode_body(kernels.apply_body(key[:16], bytes(body)).tobytes(), key[:16], key, synth.IDS[mode], bounds=bounds, **options)


def unlucky(mode, ends):
    """A key under which a zlib stream's ciphertext begins with these line ends."""
    r = random.Random(7)
    plain = zlib.compress(b"words of a text, " * 40, 6)
    for _ in range(300_000):
        key = r.randbytes(24)
        if kernels.ENCRYPT[mode](key, plain[:8])[: len(ends)] == ends:
            return key, plain
    raise AssertionError("no key")


@pytest.mark.parametrize("mode", ["ofb", "cfb64"])
@pytest.mark.parametrize("ends", [b"\r", b"\n"])
def test_a_ciphertext_that_begins_with_a_line_end(mode, ends):
    key, plain = unlucky(mode, ends)
    lost = opened([plain, plain], mode, key, "keyword")
    assert lost["check"]["flate_ok"] == 0 and {s["boundary"] for s in lost["streams"]} == {"keyword"}
    found = opened([plain, plain], mode, key)
    assert found["check"]["flate_ok"] == 2 and found["check"]["mismatch_total"] == 0
    assert [found["pdf"][s["start"] : s["end"]] for s in found["streams"]] == [plain + b"\r"] * 2
    assert {s["boundary"] for s in found["streams"]} == {"inflate"}


def test_without_a_length_inflating_decides():
    key, plain = unlucky("ofb", b"\n")
    document, ranges = synth.pdf([plain])
    body = bytearray(document.replace(b"/Length", b"/Lenght"))
    for s, e in ranges:
        body[s:e] = kernels.ofb(key, document[s:e])
    found = decode.decode_body(kernels.apply_body(key[:16], bytes(body)).tobytes(), key[:16], key, 1, bounds="length")
    assert found["check"]["flate_ok"] == 1 and found["streams"][0]["boundary"] == "inflate"


def test_ordinary_files_are_the_same_by_both_rules():
    r = random.Random(3)
    for mode in ("none", "ofb", "cfb64"):
        payloads = [zlib.compress(r.randbytes(r.randrange(0, 2000)), 6) for _ in range(12)]
        a, b = (opened(payloads, mode, bounds=x) for x in ("keyword", "length"))
        if all(s["boundary"] == "keyword" for s in b["streams"]):
            assert a == b
        assert b["check"]["flate_ok"] == 12


def test_closing_keywords_inside_a_payload():
    inner = b"a text of\nendstream\nendobj\n9 0 obj\n<</Length 3>>\nstream\nxyz\nendstream\nendobj\n" * 3
    found = opened([inner, b"second"], flate=False)
    assert [found["pdf"][s["start"] : s["end"]] for s in found["streams"]] == [inner + b"\r", b"second\r"]
    assert [s["number"] for s in found["streams"]] == [1, 2]
    assert len(opened([inner, b"second"], flate=False, bounds="keyword")["streams"]) == 5


def test_lengths_that_lead_nowhere_change_nothing():
    payloads = [zlib.compress(b"abc" * n, 6) for n in (1, 50, 700)]
    wrong = [len(p) + 5 for p in payloads]
    a, b = (opened(payloads, bounds=x, declared=wrong) for x in ("keyword", "length"))
    assert a == b and a["check"]["mismatch_total"] == 3
    huge = [10**19, 0, 3]
    assert opened(payloads, declared=huge)["streams"] == opened(payloads, bounds="keyword", declared=huge)["streams"]


def test_payloads_of_line_ends_only_and_of_nothing():
    found = opened([b"\r\n\r\n", b"", b"\n"], flate=False)
    assert [found["pdf"][s["start"] : s["end"]] for s in found["streams"]] == [b"\r\n\r\n\r", b"\r", b"\n\r"]
    assert [s["boundary"] for s in found["streams"]] == ["length", "length", "length"]


def test_numbers_of_any_length():
    zeros = b"0" * 5000
    pdf = b"%PDF-\n" + zeros + b"1 " + zeros + b"0 obj\n<</Length " + zeros + b"3>>\nstream\nabc\nendstream"
    (p,) = pdfbytes.scan(pdf)
    assert (p.number, p.generation) == (1, 0)
    assert pdfbytes.declared_length(pdf, p, {}) == 3
    assert pdfbytes.object_headers(b"9" * 30 + b" 0 obj") == []


def test_many_headers_without_a_stream_are_read_once():
    pdf = b"".join(b"%d 0 obj\n5\nendobj\n" % i for i in range(200_000)) + b"7 0 obj\n<<>>\nstream\nabc\nendstream\nendobj"
    assert pdfbytes.object_streams(pdf) == [(7, len(pdf) - 20, 4, b"\n<<>>\n")]


def test_an_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError, match="bounds"):
        decode.decode(spark.range(1), bounds="guess")
