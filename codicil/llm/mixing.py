"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets the mean repetition rate that brings its expected size to its
share of the mixture. A document's count is the inverse of the Poisson
distribution at a uniform number hashed from its id and the seed; the copies are
then shuffled over the whole mixture by another hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rates above this are drawn as a sum of independent parts of at most this rate.
PART = 16.0
#: The distribution is inverted up to this count; for a rate of PART more than this has a probability under 2**-50.
TERMS = 64


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 of the seed and the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def poisson(u: Column, rate: Column) -> Column:
    """The count n at which the Poisson distribution function first exceeds u, for rates up to PART."""
    start = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        more = state["n"].eqNullSafe(k - 1) & (u >= state["cdf"])
        return F.when(more, F.struct(k.alias("n"), p.alias("p"), (state["cdf"] + p).alias("cdf"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["n"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None, size: Column, total: float | None = None) -> DataFrame:
    """source, docs, size, weight, rate. Sources not in `weights` have weight 0; None gives every source the same weight.

    `total` is the size of the mixture, by default that of docs. A null source is a
    source of its own, named null in `weights` by the key "".
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(size).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        own = F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce("source", F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
        weighed = sizes.withColumn("weight", own)
    sums = weighed.where("size > 0").agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    target = F.lit(float(total)) if total is not None else F.col("all_size")
    return weighed.crossJoin(F.broadcast(sums)).select(
        "source", "docs", "size", "weight", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * target / F.col("size")).otherwise(0.0).alias("rate")
    )


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name = f"_{name}"
    return name


def _key(seed: int, doc_id: Column, copy: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(doc_id.cast("string"), F.lit("")), copy.cast("string")))


def _dealt(keyed: DataFrame, by: list[str]) -> DataFrame:
    """Range-partitioned and sorted by a uniform MD5 key, the first of `by`: its first digits deal equal ranges without a pass to sample it."""
    n, part = common.shuffle_partitions(keyed.sparkSession), _fresh(keyed, "part")
    place = F.floor(F.conv(F.substring(by[0], 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * n).cast("int")
    return keyed.withColumn(part, place).repartitionById(n, part).drop(part).sortWithinPartitions(*by)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 17, size: Column | None = None, total: float | None = None) -> DataFrame:
    """Each row of docs as many times as drawn, in global random order.

    Columns: those of docs, then mix_rate, mix_copy (from 1), mix_key; the order of
    the mixture is that of (mix_key, doc_id, mix_copy), and the result is
    range-partitioned and sorted so. docs must not have columns of these three names.
    `size` measures a row (default: n_chars, null as 0) against the weights. Rows
    that share a doc_id draw the same count, share their keys and have no defined order
    among themselves. A null doc_id draws as an empty id. An empty table, or weights
    that are all 0, give no rows.
    """
    if taken := {"mix_rate", "mix_copy", "mix_key"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {min(taken)}")
    size = F.coalesce(F.col("n_chars"), F.lit(0)) if size is None else size
    source, n = _fresh(docs, "own_source"), _fresh(docs, "n_copies")
    rate = rates(docs, weights, size, total).select(F.col("source").alias(source), F.col("rate").alias("mix_rate"))
    rate = F.broadcast(rate) if common.small(rate, 100_000) else rate
    drawn = docs.join(rate, docs["source"].eqNullSafe(F.col(source))).drop(source)
    # A rate over PART is the sum of equal parts of at most PART, each with a draw of its own.
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART)).cast("int")
    part = F.col("mix_rate") / parts
    count = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, i: a + poisson(uniform(seed, F.col("doc_id"), i), part))
    copies = drawn.withColumn(n, count).where(F.col(n) > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    return _dealt(copies.withColumn("mix_key", _key(seed, F.col("doc_id"), F.col("mix_copy"))), ["mix_key", "doc_id", "mix_copy"])


def rearrange(mixture: DataFrame, seed: int = 17) -> DataFrame:
    """A mixture that was stored without its keys, again in the global order that mix() gave it.

    The copies of a row are equal, so numbering them anew gives them the same keys.
    Rows that share a doc_id and differ in text are numbered each for itself, as mix()
    does; a null doc_id counts as an empty id, and an empty table stays empty.
    """
    names = mixture.columns
    text, copy, key = (_fresh(mixture, x) for x in ("text_hash", "copy", "key"))
    own = Window.partitionBy("doc_id", text).orderBy(F.lit(1))
    numbered = mixture.withColumn(text, F.sha2("text", 256)).withColumn(copy, F.row_number().over(own))
    return _dealt(numbered.withColumn(key, _key(seed, F.col("doc_id"), F.col(copy))), [key, "doc_id", copy, text]).select(names)
