"""The contract's queries against brute force: on a fixture of awkward rows and on the smallest table."""

from __future__ import annotations

import brute
import pytest

from codicil.llm import decontam, media_tiles, near_dedup, pii, queries, substring, tokens_wavelet

LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(3000))
BASE = [f"Tok{i}" for i in range(120)]
THUE = "a"
while len(THUE) < 2048:
    THUE += THUE.translate({97: 98, 98: 97})
OTHER = THUE.translate({97: 98, 98: 97})
AWKWARD = [
    (5, None),
    (1, ""),
    (2, " \t\n "),
    (3, "one two three"),
    (4, "ONE two three"),
    (7, LONG),
    (8, LONG + " tail"),
    (9, " ".join(BASE)),
    (10, " ".join([*BASE[:60], "changed", *BASE[61:]])),
    (11, "pre fix " + " ".join(BASE[20:100])),
    (12, "Écrit à bob.o'neil+x@mail.example.org, don't call +49 (30) 1234-5678 or 192.168.1.300 or 10.0.0.1. 4111 1111 1111 1111 card ﬁn Σ"),
    (13, "a@b@c.d.e x@y. 1.2.3.4.5.6.7.8 4111-1111-1111-1112 +1 23 <|endoftext|> 中文   é\x1cz İstanbul's"),
    (12, "same id, other text"),
    (None, "no id at all but words"),
    (20, "x" * 300_000),
    (21, " ".join(BASE)),
    (21, " ".join(BASE)),
    (-3, " ".join(BASE[:55])),
    (30, THUE),
    (31, OTHER),
    (32, " ".join([*BASE[60:85], THUE, *BASE[85:110]]).replace("Tok", "tok")),
    (33, " ".join([*BASE[60:85], OTHER, *BASE[85:110]]).replace("Tok", "tok")),
    (34, "0" * 5000 + "1.1.1.1 and " + "9" * 5000 + ".1.1.1"),
]
ITEMS = [(1, "Tok1 tok2, tok3 tok4"), (2, " ".join(BASE[30:50])), (3, None), (4, ""), (5, "ONE, two... three"), (None, "no id at ALL but words"), (6, "café never here")]


def frames(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} long, text string").repartition(3)
    # columns of other tables' names must not disturb
    return df.selectExpr(key, "text", "'x' AS row", "1 AS n", "2L AS id", "'k' AS key", "3L AS label", "'en' AS lang", "'src' AS source", "4L AS n_chars")


def same(got, want):
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want)


def case(spark, sf_dir, kind):
    if kind == "awkward":
        return frames(spark, AWKWARD, "doc_id"), AWKWARD, frames(spark, ITEMS, "item_id"), ITEMS
    if kind == "empty":
        return frames(spark, [], "doc_id"), [], frames(spark, [], "item_id"), []
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return docs, [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], items, [(r[0], r[1]) for r in items.select("item_id", "text").collect()]


kinds = pytest.mark.parametrize("kind", ["awkward", "empty", "table"])


@kinds
def test_op1(spark, sf_dir, kind):
    docs, rows, _, _ = case(spark, sf_dir, kind)
    got = tokens_wavelet.encode_corpus(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    same(got, brute.op1(rows))


@kinds
def test_op2(spark, sf_dir, kind):
    docs, rows, _, _ = case(spark, sf_dir, kind)
    got = media_tiles.media_features(media_tiles.store_text_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature").collect()
    same(got, brute.op2(rows))


@kinds
def test_op3(spark, sf_dir, kind):
    docs, rows, _, _ = case(spark, sf_dir, kind)
    got = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    same(got, brute.op3(rows))


@kinds
def test_op4(spark, sf_dir, kind):
    docs, rows, _, _ = case(spark, sf_dir, kind)
    want = brute.op4([(d, t) for d, t in rows if d is not None])
    for options in ({}, {"group": 1}):  # the second sends every shared prefix to the longer one
        got = substring.remove_repeats(docs, **options).where("doc_id IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        same(got, want)


@kinds
def test_op7(spark, sf_dir, kind):
    docs, rows, items, own = case(spark, sf_dir, kind)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    own = [("" if i is None else i, t) for i, t in own]
    same(decontam.contamination(docs, items).select(*columns).collect(), brute.op7(rows, own))
    same(decontam.contamination(docs, items, block_bytes=40).select(*columns).collect() if kind == "awkward" else [], brute.op7(rows, own) if kind == "awkward" else [])


@kinds
def test_op9(spark, sf_dir, kind):
    docs, rows, _, _ = case(spark, sf_dir, kind)
    got = pii.detect(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    same(got, brute.op9(rows))


def test_queries_name_their_columns(spark, sf_dir):
    assert {"doc_id", "held_out", "score", "predicted"} <= set(queries.op10_toxicity(spark, sf_dir).columns)
