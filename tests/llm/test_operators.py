"""Parts of the operators against plain definitions."""

from __future__ import annotations

import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.llm import decontam, edit_counts, media_tiles, mixing, near_dedup, pii, substring, tokens_wavelet, toxicity


def test_wavelet_access_rank_select():
    r = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 2000):
        ids = r.integers(0, 300, n).astype(np.uint16)
        shard = tokens_wavelet.Shard(tokens_wavelet.Shard.pack([7, None], [n // 2, n - n // 2], ids, 9))
        m = shard.matrix()
        assert (shard.ids() == ids).all() and shard.doc_ids == [7, None]
        for t in (0, 5, 299, 511):
            at = np.flatnonzero(ids == t).tolist()
            assert m.count(t) == len(at) and m.occurrences(t) == at
            for i in (0, n // 3, n):
                assert m.rank(t, i) == int((ids[:i] == t).sum())
        assert [m.access(i) for i in range(0, n, 97)] == ids[::97].tolist()
        with pytest.raises(IndexError):
            m.access(n)


def test_a_word_is_encoded_as_it_is_looked_up():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens_wavelet.WORD_TOKENIZER)
    cache = tokens_wavelet.WordCache(tokens_wavelet.WORD_TOKENIZER)
    for word in ("straightforwardly", "Upper", "añoñés", "tail.", "MIXED,;", "it's", "2024", "a1b", "日本", "ß", "I\u0307x"):
        ids = np.frombuffer(cache.known[word.encode()], cache.kind).tolist()
        assert ids == library.encode(word, add_special_tokens=False).ids and word.encode() in cache.known
    held = cache.held
    cache.encode("Upper tail. it's straightforwardly".encode())
    assert cache.held == held == sum(len(k) + len(v) + cache.ENTRY for k, v in cache.known.items())



def test_word_cache_is_the_library():
    cache = tokens_wavelet.WordCache(tokens_wavelet.WORD_TOKENIZER, limit=20_000)
    texts = ["Hello, world!! don't we'll x's", "ÉCOLE Œuvre straße İx ﬁn é́a ñandú,", "a b c\x1cd 12 345abc <|endoftext|>", "日本語 テキスト mixed٣", "", " ".join(f"Wörd{i}x. plain{i}" for i in range(300))]
    for t in texts * 2:
        assert cache.encode(t.encode()).tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids
        held = sum(len(k) + len(v) + cache.ENTRY for k, v in cache.known.items())
        assert cache.held == held <= 20_000


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    cache = tokens_wavelet.WordCache(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Two  spaces and\nlines, which this one keeps"
    assert not cache.by_words and cache.encode(text.encode()).tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


def _bmp(pixels, depth, palette=()):
    h, w = pixels.shape[:2]
    rows = b""
    for r in pixels[::-1]:
        bits = "".join(f"{int(v):0{depth}b}" for v in r)
        bits += "0" * (-len(bits) % 32)
        rows += int(bits, 2).to_bytes(len(bits) // 8, "big")
    table = b"".join(bytes((b, g, r, 0)) for r, g, b in palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(table) + len(rows), 0, 0, 54 + len(table), 40, w, h, 1, depth, 0, len(rows), 0, 0, len(palette), 0) + table + rows


def test_media_decoding():
    rgb = np.random.default_rng(2).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media_tiles.decode_image(media_tiles.encode_bmp(rgb)) == rgb).all()
    assert (media_tiles.decode_image(media_tiles.encode_ppm(rgb)) == rgb).all()
    assert (media_tiles.decode_netpbm(b"P3 7 5\n#c\n255\n" + b" ".join(b"%d" % v for v in rgb.ravel())) == rgb).all()
    assert media_tiles.decode_netpbm(b"P1\n3 2\n101\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media_tiles.decode_netpbm(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media_tiles.decode_netpbm(b"P2 2 1 9 3 4").tolist() == [[3, 4]]
    assert media_tiles.decode_netpbm(b"P5 2 1 65535\n\x01\x02\x03\x04").tolist() == [[258, 772]]
    for depth in (1, 4, 8):
        index = np.arange(35).reshape(5, 7) % (1 << depth)
        palette = [(i, 2 * i % 256, 3 * i % 256) for i in range(min(1 << depth, 200))]
        index %= len(palette)
        assert media_tiles.decode_bmp(_bmp(index, depth, palette)).tolist() == [[list(palette[i]) for i in row] for row in index]
    lost = bytearray(_bmp(np.zeros((2, 2), int), 8, [(1, 2, 3)]))
    struct.pack_into("<I", lost, 14, 10**6)
    for bad in (b"", b"P6 9 9 255\n", b"BM", b"P7", media_tiles.encode_bmp(rgb)[:60], b"P5 x", b"P4 1 1", b"P2 1 1 9 x", b"P3 1 1 9 1 2 -3", b"P2 1 1 9 99999999999999999999999", b"P2 1 1 9 10", b"P5 1 1 9\n\x0a", b"P5 " + b"1" * 5000 + b" 1 255\n", bytes(lost)):
        with pytest.raises(media_tiles.MediaError):
            media_tiles.decode_image(bad)


def test_area_resize_is_the_mean_over_areas():
    x = np.random.default_rng(3).random((6, 9, 1)) * 255
    small = media_tiles.area_resize(x, 3, 3)
    assert np.allclose(small[:, :, 0], x[:, :, 0].reshape(3, 2, 3, 3).mean((1, 3)))
    assert np.allclose(media_tiles.area_resize(np.full((5, 7, 3), 9.0), 4, 11), 9)
    for h, w, th, tw in ((1, 64, 8, 9), (7, 5, 3, 11), (9000, 64, 8, 9)):
        x = np.random.default_rng(h).integers(0, 256, (h, w, 3)).astype(np.uint8)
        fine = np.zeros((th, tw, 3))
        for i in range(th):
            for j in range(tw):
                part = [np.clip(np.minimum(np.arange(1, n + 1), (k + 1) * n / t) - np.maximum(np.arange(n), k * n / t), 0, None) * t / n for k, n, t in ((i, h, th), (j, w, tw))]
                fine[i, j] = np.einsum("i,j,ijc->c", *part, x.astype(float))
        assert np.allclose(media_tiles.area_resize(x, th, tw), fine)
    assert media_tiles.difference_hash(np.tile(np.arange(9, dtype=np.uint8), (8, 1))) == "ff" * 8


def test_tiles_with_unreadable_media(spark):
    rgb = np.full((10, 12, 3), 77, np.uint8)
    rows = spark.createDataFrame([(1, bytearray(media_tiles.encode_bmp(rgb))), (2, None), (3, bytearray(b"?"))], "media_id long, content binary")
    got = {r["media_id"]: r for r in media_tiles.tiles(rows, 4, 4).collect()}
    assert (media_tiles.from_npy(bytes(got[1]["tile"])) == 77).all() and got[1]["error"] is None
    assert got[2]["error"] and got[3]["error"] and got[2]["tile"] is None
    scaled = spark.createDataFrame([(1, bytearray(b"P2 2 1 9 0 9")), (2, bytearray(b"P4 1 1")), (3, bytearray(b"P5 2 1 1000\n\x00\x00\x03\xe8"))], "media_id long, content binary")
    got = {r["media_id"]: r for r in media_tiles.tiles(scaled, 1, 2).collect()}
    assert media_tiles.from_npy(bytes(got[1]["tile"])).tolist() == [[0, 255]] and got[2]["error"] and media_tiles.from_npy(bytes(got[3]["tile"])).tolist() == [[0, 65535]]


def test_edits_follow_whole_encoding():
    code = edit_counts.encoding()
    count = lambda x: len(code.encode_ordinary(x))
    r = random.Random(4)
    alphabet = ["word ", "Ünï ", "x", " ", "\n", "12", "'s", "...", " ", "aa bb cc ", "é"]
    for n in (0, 1, 40, 400):
        text = "".join(r.choice(alphabet) for _ in range(n))
        tree = edit_counts.TokenTree(text, count, 16)
        assert tree.total == count(text)
        for _ in range(25):
            a, b = sorted(r.randrange(len(text) + 5) for _ in range(2))
            b = min(b, a + 30)
            new = "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 200])))
            text = text[:a] + new + text[max(a, b) :] if a <= len(text) else text + new
            tree.edit(a, b, new)
            assert tree.text == text and tree.total == count(text)


def test_recount_with_given_edits(spark):
    rows = [(1, "one two three four", [(4, 7, "2"), (0, 3, "")]), (2, None, None), (3, "", []), (4, "abc", [(1, 99, "Z"), (None, 2, "q")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>")
    code = edit_counts.encoding()
    got = {r["doc_id"]: r for r in edit_counts.recount(frame, size=4).collect()}
    for d, after in ((1, " 2 three four"), (2, ""), (3, ""), (4, "aZ")):
        assert got[d]["n_tokens_after"] == len(code.encode_ordinary(after)) and got[d]["n_chars_after"] == len(after)


def test_mixing_edges(spark):
    rows = [(i, "a" if i % 3 else None, 10, "t") for i in range(900)] + [(1000 + i, "b", 1, None) for i in range(30)] + [(None, "b", None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string")
    for name in ("rate", "_n", "n", "_part", "part", "_source", "own_source", "n_copies", "copy", "key"):
        docs = docs.withColumn(name, F.lit(f"kept {name}"))
    out = mixing.mix(docs, {"a": 1.0, "b": 2.0, "": 0.0})
    got = {r["source"]: r["size"] for r in out.groupBy("source").agg(F.sum("n_chars").alias("size")).collect()}
    total = 9030
    assert None not in got and abs(got["a"] - total / 3) < 600 and abs(got["b"] - total * 2 / 3) < 900
    assert out.columns == [*docs.columns, "mix_rate", "mix_copy", "mix_key"] and out.where("_n = 'kept _n' AND _part = 'kept _part' AND _source = 'kept _source'").count() == out.count() > 0
    with pytest.raises(ValueError):
        mixing.mix(out)
    back = mixing.rearrange(out.drop("mix_rate", "mix_copy", "mix_key").repartition(5))
    assert back.columns == docs.columns and [r["doc_id"] for r in back.collect()] == [r["doc_id"] for r in out.collect()]
    keys = [r["mix_key"] for r in out.collect()]
    assert keys == sorted(keys)
    assert mixing.mix(docs, {}).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    again = mixing.mix(docs.repartition(7), {"a": 1.0, "b": 2.0, "": 0.0})
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_poisson_is_the_inverse_distribution(spark):
    from math import exp, factorial

    rows = [(u / 500 + 0.001, rate) for u in range(500) for rate in (0.0, 0.3, 2.5, 16.0)]
    got = spark.createDataFrame(rows, "u double, rate double").select("u", "rate", mixing.poisson(F.col("u"), F.col("rate")).alias("n")).collect()
    for r in got:
        cdf = lambda n: sum(exp(-r["rate"]) * r["rate"] ** k / factorial(k) for k in range(n + 1))  # noqa: B023, E731
        assert cdf(r["n"]) > r["u"] - 1e-9 and (r["n"] == 0 or cdf(r["n"] - 1) <= r["u"] + 1e-9)


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"Contact Zyxander at bob@example.org today the thing number {i}") for i in range(3)]
    rows += [(10 + i, f"the thing today number {i} contact someone") for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert "term:8:16" in got[0]["spans"] and "email:20:35" in got[0]["spans"] and got[99]["spans"] == "" and got[10]["n_term"] == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0].startswith("Contact <NAME>  <EMAIL>") and clean[10] == rows[3][1] and clean[99] is None


def test_terms_of_whole_documents(spark):
    far = " ".join(f"common{i}" for i in range(90))
    rows = [(i, f"Zyxander {far} bob@example.org {far} last zyxander, {far}") for i in range(8)]
    rows += [(20, f"zyxander {far} bob and nobody"), *((30 + i, f"{far} bob last {i}") for i in range(900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    for d, t in rows:
        at = [f"term:{m.start()}:{m.end()}" for m in re.finditer("zyxander", t.lower())]
        assert [s for s in got[d].split(",") if s.startswith("term")] == at


def test_sanitise_null_and_shared_ids(spark):
    rows = [(None, "mail a@example.org", 1), (None, "or b@example.org now", 2), (5, "c@example.org", 3), (5, "write to d@example.org", 4), (5, "nothing here", 5), (6, None, 6), (5, "c@example.org", 7)]
    got = {r["n"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()}
    assert got == {1: "mail <EMAIL>", 2: "or <EMAIL> now", 3: "<EMAIL>", 4: "write to <EMAIL>", 5: "nothing here", 6: None, 7: "<EMAIL>"}


def test_grammar():
    events = toxicity.clause_events
    assert events("TI")["insult_targeted"] == 0 and events("RI")["insult_reported"] == 1 and events("NI")["insult_negated"] == 1 and events("NooooI")["insult"] == 1
    assert events("PI")["insult_targeted"] == 1 and events("IoP")["insult_targeted"] == 1 and events("IoooooooP")["insult_targeted"] == 0
    model = toxicity.Model({"idiot": 5.0}, {"blorb": 4.0})
    reader = toxicity.Reader(model)
    assert reader.events("You idiot.")[3] > 0 and reader.events("idiotic thing").sum() == 0 and reader.events("BLORBing!")[0] > 0
    assert reader.events("").sum() == 0 and toxicity.Reader(toxicity.Model()).events("kind words").sum() == 0


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out")
    r = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("accuracy"), F.expr("sum(predicted * toxic) / sum(toxic)").alias("recall"), F.expr("sum(predicted * toxic) / sum(predicted)").alias("precision")).first()
    assert r["accuracy"] > 0.97 and r["recall"] > 0.85 and r["precision"] > 0.95, r


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "You will die, I kill you")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_clean_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 1), (None, "a b c d e f g h i j k", 2), (2, "other", 3)], "doc_id long, text string, _bad int")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    kept = decontam.clean(docs, items)
    assert kept.columns == ["doc_id", "text", "_bad"] and [r["_bad"] for r in kept.collect()] == [3]
    many = docs.selectExpr("*", "1 AS n_words", "2 AS hit_spans", "3 AS hit_items", "map('a', 1) AS m")
    again = decontam.clean(many, items).collect()
    assert [tuple(r) for r in again] == [(2, "other", 3, 1, 2, 3, {"a": 1})]


def test_keep_one_of_each_group(spark):
    base = [f"word{i}" for i in range(60)]
    near = " ".join(["other", *base[1:]])
    text = " ".join(base)
    rows = [(5, text, 1), (5, text, 2), (3, near, 3), (None, text, 4), (None, "alone and without an id at all", 5), (7, None, 6), (7, "", 7), (8, "short", 8), (9, "SHORT", 9), (3, "same id, another text of its own", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int")
    for frame in (docs, docs.selectExpr("*", "1 AS t1", "2 AS id", "3 AS label", "4 AS n")):
        kept = near_dedup.keep_one(frame)
        assert kept.columns == frame.columns and sorted(r["_gone"] for r in kept.collect()) == [3, 5, 6, 7, 8, 10]
    twice = spark.createDataFrame([(1, text, 1), (1, text, 2), (1, text, 3), (2, text, 4)], "doc_id long, text string, _gone int")
    assert [r["doc_id"] for r in near_dedup.keep_one(twice).collect()] == [1]
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_reported_speech():
    reader = toxicity.Reader(toxicity.Model({"idiot": 5.0}))
    place = {e: i for i, e in enumerate(toxicity.EVENTS)}
    reported = ['he said: "you are an idiot"', "he said, you are an idiot", "he said you are an idiot", '"you are an idiot", he said', '"You are an idiot!" he said.', "you idiot, he said.", "Er sagte: „du idiot“"]
    plain = ["You are an idiot.", "he said hello, you are an idiot", 'she said "hello". you idiot', "you are not nice, you idiot", '"hello" you idiot. he said']
    for t in reported:
        assert reader.events(t)[place["insult_reported"]] > 0 and reader.events(t)[place["insult"]] == 0, t
    for t in plain:
        assert reader.events(t)[place["insult"]] > 0 and reader.events(t)[place["insult_reported"]] == 0, t


def test_kept_trees_encode_only_what_changes(spark):
    code = edit_counts.encoding()
    text = " ".join(f"plain words number {i}" for i in range(3000))
    rows = [(1, text, [(50_000, 50_005, "new")]), (1, text, []), (2, None, [(0, 0, "start")]), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>").withColumn("n_tokens", F.lit("clash"))
    first = edit_counts.edit_trees(edit_counts.grow_trees(docs))
    second = edit_counts.edit_trees(first.withColumn("edits", F.expr("array(struct(cast(9 AS bigint) AS start, cast(12 AS bigint) AS `end`, 'x' AS text))")))
    for r in [*first.collect(), *second.collect()]:
        assert r["n_tokens"] == len(code.encode_ordinary(r["text"])) and sum(r["leaf_chars"]) == len(r["text"]) and sum(r["leaf_tokens"]) == r["n_tokens"]
        assert r["chars_encoded_again"] < 6 * edit_counts.LEAF


def test_masking_edits_on_the_table(spark, sf_dir):
    code, rows = edit_counts.encoding(), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for d, t in docs.collect():
        t, after, at, n = t or "", [], 0, 0
        for s, kind, e in pii.base_spans(t):
            if s >= at:
                after += [t[at:s], f"<{pii.KINDS[kind]}>"]
                at, n = e, n + 1
        after = "".join(after) + t[at:]
        rows.append((d, len(code.encode_ordinary(t)), n, len(code.encode_ordinary(after)), len(after)))
    got = edit_counts.recount(docs, edit_counts.mask_entities).select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_suffix_trees_against_all_windows():
    r = random.Random(6)
    base = [f"w{r.randrange(30)}" for _ in range(400)]
    texts, doc, first, lead, n = [], [], [], [], []
    anchor = base[100:108]
    for d in range(40):
        own = list(base)
        for _ in range(r.randrange(0, 5)):
            own[r.choice([i for i in range(70, 140) if not 100 <= i < 108])] = f"x{r.randrange(5)}"
        start = r.randrange(88, 101)
        stop = r.randrange(120, 140)
        texts.append(" ".join(own[start:stop]).encode())
        doc.append(r.randrange(12))
        first.append(start)
        lead.append(100 - start)
        n.append(min(100 - start, stop - start - 20) + 1 if stop - start >= 20 else 0)
    doc, lead, n = np.array(doc), np.array(lead), np.array(n)
    assert anchor == texts[0].decode().split()[lead[0] : lead[0] + 8]
    found, low, high = substring._repeated(doc, lead, n, texts, 20, 8)
    got = {int(i): (int(a), int(b)) for i, a, b in zip(found, low, high, strict=True)}
    words = [t.split() for t in texts]
    least = {}
    windows = [(i, s, (int(lead[i]) - s, tuple(words[i][s : s + 20]))) for i in range(40) for s in range(n[i])]
    for i, _, w in windows:
        least[w] = min(least.get(w, 99), doc[i])
    want = {}
    for i, s, w in windows:
        if least[w] < doc[i]:
            a, b = want.get(i, (s, s))
            want[i] = (min(a, s), max(b, s))
    assert got == want and len(want) > 5


def test_nodes_are_common_prefixes():
    r = np.random.default_rng(4)
    rows = r.integers(0, 2, (60, 7)).astype(np.int32)
    rows[rng_ends := r.integers(0, 8, 60) <= 2, 5:] = -1
    tree = substring.SubTree(rows)
    for depth in range(8):
        node = tree.nodes(depth)
        for i in range(60):
            for j in range(60):
                same = (rows[i, :depth] == rows[j, :depth]).all() and (rows[i, :depth] >= 0).all()
                assert (node[i] == node[j]) == bool(same or i == j), (depth, i, j)
    assert rng_ends.any()


def test_very_long_numbers_are_no_crash():
    assert pii.base_spans("0" * 5000 + "1.1.1.1") == [(0, 1, 5007)] and pii.base_spans("9" * 5000 + ".1.1.1") == []


def test_secrets(spark):
    key = "a7898f631d0c339a0d2af2f50c7613fcfdcec734"
    rows = [(1, f'key = "{key}" and {"ab1" * 12} and {"x" * 50} and longword{"y" * 30}'), (2, f"mail {key}@example.org"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert got[1]["spans"] == f"secret:7:{7 + len(key)}" and got[1]["n_private"] == 1 and got[1]["base"] == ""
    assert got[2]["n_secret"] == 0 and got[2]["n_email"] == 1 and got[3]["n_private"] == 0
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}[1].startswith('key = "<SECRET>" and ab1ab1')


def test_images_without_pixels_are_black_tiles(spark):
    r = random.Random(4)
    heads = [b"P1 3 0", b"P1 0 0\n", b"P2 0 2 9", b"P3 2 0 255 ", b"P4 0 3", b"P4 0 3\n", b"P4 3 0\n", b"P5 0 0 255", b"P5 5 0 255", b"P6 0 5 255\n", b"P5 0 1 65535\n"]
    noise = [bytes(r.choice(b"P1234567 \n#0259BM\xff\x00") for _ in range(r.randrange(24))) for _ in range(600)]
    noise += [b"P%d %d %d %d\n" % (r.randrange(1, 7), r.randrange(3), r.randrange(3), r.choice([0, 1, 9, 255, 256, 70000])) + r.randbytes(r.randrange(30)) for _ in range(600)]
    bmp = bytearray(media_tiles.encode_bmp(np.zeros((2, 2, 3), np.uint8)))
    for _ in range(600):
        own = bytearray(bmp)
        for _ in range(r.randrange(1, 4)):
            own[r.randrange(len(own))] = r.choice([0, 1, 2, 4, 8, 255])
        noise.append(bytes(own))
    rows = [(i, bytearray(x)) for i, x in enumerate([*heads, *noise])]
    got = {x["media_id"]: x for x in media_tiles.tiles(spark.createDataFrame(rows, "media_id long, content binary"), 2, 2).collect()}
    assert len(got) == len(rows)
    for i in range(len(heads)):
        assert got[i]["error"] is None and not media_tiles.from_npy(bytes(got[i]["tile"])).any() and got[i]["dhash"] == "0" * 16, heads[i]
    assert all((x["tile"] is None) == (x["error"] is not None) for x in got.values())


@pytest.mark.parametrize("kind", ["chinese", "code", "commas", "digits", "signs"])
def test_one_edit_encodes_little_in_any_script(kind):
    r = random.Random(6)
    unit = {
        "chinese": lambda: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(r.randrange(3, 20))) + r.choice("，。；"), "code": lambda: r.choice(["snake_case_name", "x+=1;", "foo(bar)", "_"]),
        "commas": lambda: r.choice(["one", "two"]) + ",\n", "digits": lambda: str(r.randrange(10**9)) + r.choice("|/"), "signs": lambda: r.choice(["'s", "don't", "--", "e\u0301", "\u0939\u093f", " ", "  \n", "a'"]),
    }[kind]
    text = "".join(unit() for _ in range(15_000))
    code = edit_counts.encoding()
    count = lambda x: len(code.encode_ordinary(x))
    assert sum(map(count, edit_counts.cut(text))) == count(text)
    tree = edit_counts.TokenTree(text, count)
    for _ in range(12):
        tree.encoded, at = 0, r.randrange(len(text))
        new, end = unit() if r.random() < 0.6 else "", at + r.randrange(12)
        tree.edit(at, end, new)
        text = text[:at] + new + text[end:]
        assert tree.text == text and tree.total == count(text) and tree.encoded < len(text) * 0.05
