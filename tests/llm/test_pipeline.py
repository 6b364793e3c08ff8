"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import brute

import corpus_pipeline
from codicil.llm import mixing, toxicity


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        before, rows = docs.collect(), out.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            bad = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
            assert bad and {r["doc_id"] for r in rows} == {r["doc_id"] for r in before} - bad
        if name == "near_dedup":
            assert {r["doc_id"] for r in rows} == {r[0] for r in brute.op3([(r["doc_id"], r["text"]) for r in before]) if r[3]}
        if name == "decontamination":
            items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert {r["doc_id"] for r in rows} == {r[0] for r in brute.op7([(r["doc_id"], r["text"]) for r in before], items) if not r[5]}
        if name == "mixing":
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in mixing.mix(docs).collect())
        docs = spark.createDataFrame(rows, docs.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    # In the mixture's order, which was lost in between.
    mixture = brute.mixture_order([(r["doc_id"], r["text"]) for r in rows])
    assert sorted(map(tuple, final)) == sorted(brute.op1(mixture, by_id=False))
    assert [r["doc_id"] for r in sorted(final, key=lambda r: r["start"])] == [d for d, _ in mixture] != sorted(d for d, _ in mixture)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, final))


def test_stages_on_awkward_rows(spark):
    """Null and empty texts, null, shared and repeated ids, an empty table: no stage fails, and columns stay."""
    sf_dir = "/root/testdata/sf0.001"
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (None, "some words without an id here", "en", "a", 29), (3, "three words here", None, "b", 16), (3, "three words here", None, "b", 16), (3, "other words of a shared id", "de", "b", 26), (4, "x" * 200_000, "en", "c", 200_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            got = out.collect()
            if name == "tokens":
                assert len(got) == docs.count() and sum(r["n_tokens"] for r in got) == max((r["start"] + r["n_tokens"] for r in got), default=0)
                break
            assert out.columns == docs.columns, name
            if name == "near_dedup":
                want = [r for i, r in enumerate(given) if i != 4]
                assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
            if name in ("toxicity", "decontamination"):
                assert len(got) == docs.count()
            docs = spark.createDataFrame(got, docs.schema)
