"""Connected groups from candidate buckets, without listing the pairs of a bucket.

Members that share a bucket are candidates. Three rounds test them: each member
against the leader of its buckets that meets most others; then the members of
buckets that still span several groups against the bucket's leader; then, of
buckets that still span several groups, all pairs of members of different groups
that an exact bound doesn't exclude. A pair within a group needs no test, so the
result is that of testing all pairs of all buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

Verify = Callable[[DataFrame], DataFrame]
Possible = Callable[[Column, Column], Column]
#: Members of an open bucket on one side of a task's pairs.
GRID = 1000


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(links: DataFrame) -> DataFrame:
    """id, label of each node of links (a, b): the smallest id of its component.

    Alternates large-star and small-star steps, each of two joins on a node with
    minima combined before the shuffle, until the edges stay as they are. Each
    step is written out and the one before it deleted.
    """
    edges = common.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _print(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(least, large["u"] == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after_edges = common.save(joined.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        after = _print(after_edges)
        common.drop(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionAll(roots)
    out.saved_path = edges.saved_path
    return out


def meeting(buckets: DataFrame) -> DataFrame:
    """The rows of the buckets (key, id) that hold more than one id. A hot key is combined before the shuffle."""
    shared = buckets.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key")
    return common.join_small(buckets, common.save(shared, "keys"), "key", "left_semi")


def _scored(members: DataFrame, *own: str) -> DataFrame:
    """Members with the sum of their buckets' sizes. What a group varies from meets most of the others."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    scores = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("score"))
    return members.join(scores, "id").select("key", "id", "score", *own)


def _spanning(members: DataFrame, labels: DataFrame, *own: str) -> DataFrame:
    """key, id, label, head, own columns of the buckets that span several groups; the head is the member with the best score."""
    labelled = members.join(labels, "id", "left").select("key", "id", "score", F.coalesce("label", "id").alias("label"), *own)
    heads = labelled.groupBy("key").agg(F.max(F.struct("score", "id", "label")).alias("head"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key", "head")
    return labelled.join(heads, "key").select("key", "id", "label", "head", *own)


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def link(buckets: DataFrame, verify: Verify, attributes: DataFrame | None, possible: Possible, start: tuple[DataFrame, DataFrame, DataFrame] | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """id, label of every linked member of buckets (key, id) of two members or more.

    verify takes pairs (a, b), a < b, each once, and returns those that are links.
    attributes (id, x) holds what `possible` needs of two members to tell, by a bound
    and never by an estimate, that they can't be a link; such pairs are not formed.
    own are columns of buckets that tell so for a member in its bucket; without
    attributes (None) `possible` gets structs of these alone, which keeps rows short.
    start is a first round made elsewhere: the pairs that it tested, its links and
    their labels, all written. Buckets within one label may then be left out.
    """
    members = common.save(_scored(buckets.distinct(), *own), "members")
    if start:
        tested, links, labels = start
    else:
        best = F.max(F.struct("head.score", "head.id"))
        heads = members.groupBy("key").agg(F.max(F.struct("score", "id")).alias("head"))
        first = members.join(heads, "key").groupBy("id").agg(best.alias("best")).where("id <> best.id")
        tested = common.save(first.select(*_ordered(F.col("id"), F.col("best.id"))).distinct(), "pairs")
        links = common.save(verify(tested), "links")
        labels = connected(links)
    spent = [members, tested, links]

    others = _spanning(members, labels).where("label <> head.label")
    second = common.save(others.select(*_ordered(F.col("id"), F.col("head.id"))).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    spent.append(second)
    if not second.isEmpty():
        tested = tested.unionAll(second)
        found = common.save(verify(second), "links")
        spent.append(found)
        if not found.isEmpty():
            links = links.unionAll(found)
            spent.append(labels)
            labels = connected(links)

    open_ = _spanning(members, labels, *own)
    open_ = open_.select("key", "id", "label", F.struct(*own).alias("x")) if attributes is None else open_.select("key", "id", "label").join(attributes, "id")
    open_ = common.save(open_, "open")
    # A bucket's pairs are dealt over a grid: each member of the left to one of its parts, of the right to all.
    parts = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GRID).cast("int").alias("parts"))
    dealt = open_.join(parts, "key")
    left = dealt.select("key", F.col("id").alias("i"), F.col("label").alias("p"), "x", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    right = dealt.select("key", F.col("id").alias("j"), F.col("label").alias("q"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, (left["key"] == right["key"]) & (left["part"] == right["part"]) & (F.col("p") != F.col("q")) & (F.col("i") < F.col("j")) & possible(F.col("x"), F.col("y")))
    third = common.save(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    spent += [open_, third]
    if not third.isEmpty():
        found = common.save(verify(third), "links")
        spent.append(found)
        if not found.isEmpty():
            spent.append(labels)
            labels = connected(links.unionAll(found))
    common.drop(*spent)
    return labels
