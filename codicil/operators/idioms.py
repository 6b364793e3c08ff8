"""Relational idioms that the pipeline rests on, for any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], tie: str) -> DataFrame:
    """Backward as-of join: each left row with `take` of the last right row (by `on`, then `tie`) at or before its `on`.

    One merge in order of a union of both, so one shuffle on the keys and no range join.
    """
    picked = F.struct(*take)
    kind = right.select(picked.alias("r")).schema["r"].dataType
    rows = right.select(*by, on, F.lit(0).alias("_kind"), F.col(tie).cast("bigint").alias("_tie"), picked.alias("_r"), F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("_l"))
    probes = left.select(*by, on, F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_tie"), F.lit(None).cast(kind).alias("_r"), F.struct("*").alias("_l"))
    order = Window.partitionBy(*by).orderBy(on, "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = rows.unionByName(probes).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_kind = 1")
    return merged.select("_l.*", *(F.col(f"_r.{t}").alias(f"asof_{t}") for t in take))


def outside(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """Interval anti-join: points in no half-open span of their key. Spans of a key may overlap."""
    row = F.struct("*")
    kind = points.select(row.alias("p")).schema["p"].dataType
    merged = spans.select(by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_end"), F.lit(None).cast(kind).alias("_p")).unionByName(
        points.select(by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(spans.schema[end].dataType).alias("_end"), row.alias("_p"))
    )
    order = Window.partitionBy(by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return merged.withColumn("_reach", F.max("_end").over(order)).where("_kind = 1 AND (_reach IS NULL OR _at >= _reach)").select("_p.*")


def last_of_largest(rows: DataFrame, by: str, size: str, order: str) -> DataFrame:
    """Argmax in which of equal sizes the last in order wins, without sorting a group: the greatest (size, order, row)."""
    rest = [c for c in rows.columns if c not in (by, size, order)]
    best = rows.groupBy(by).agg(F.max(F.struct(size, order, *rest)).alias("_b"))
    return best.select(by, *(F.col(f"_b.{c}").alias(c) for c in (size, order, *rest)))


def first_match(references: DataFrame, targets: DataFrame, on: list[str], order: str, take: str) -> DataFrame:
    """Equi-join with the first target of each key; references without one go."""
    first = targets.groupBy(*on).agg(F.min_by(take, order).alias(take))
    return references.join(first, on)


def followed_by_other(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Adjacent-row check: rows whose value differs from that of the next row, with it."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("next_value", F.lead(value).over(w)).where(F.col("next_value").isNotNull() & (F.col(value) != F.col("next_value")))


def first_few(rows: DataFrame, by: str, order: list[Column | str], k: int) -> DataFrame:
    """The first k of each group with `place`, `total` and `more`."""
    w = Window.partitionBy(by).orderBy(*order)
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    ranked = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return ranked.join(total, by).withColumn("more", F.greatest(F.col("total") - k, F.lit(0).cast("bigint")))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
