"""Raw documents to token shards: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codicil.llm import common, decontam, mixing, near_dedup, tokens_wavelet, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold.

    Each row is judged by its own text, whatever its doc_id; a null or empty text has no
    event and stays. An empty table gives no rows; without labels of both kinds the
    grammar's prior weights judge.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, of several the one with the smallest text hash.

    Rows without words (null or empty texts) are duplicates of nothing and stay. A null
    doc_id comes after all others. An empty table gives no rows.
    """
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark window occurs, each judged by its own text, whatever its doc_id.

    Null and empty texts have no words and stay; an empty benchmark removes nothing.
    """
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weight: each row as many times as drawn, in global random order.

    A null source is a source of its own; sources without characters give no rows. Rows
    that share a doc_id are drawn alike, and a null one as an empty id.
    """
    return mixing.mix(docs).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet shards in the mixture's global order, and the index read back from them: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are a document of the end id alone; an empty table gives no rows.
    """
    return tokens_wavelet.encode_corpus(mixing.rearrange(docs), arranged=True).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Scores, sketches and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
