"""Near duplicates by SetSketch registers.

A text's set is its distinct 5-word shingles. Each shingle proposes values to the
registers in ascending order, so a register is settled by the first level that
reaches it; the value is truncated to a power of the base, which keeps registers
mergeable (by maximum) and, for a base near 1, equal with about the probability
of the Jaccard similarity. Equal sets are one class. Bands of registers give
candidate classes; a pair's similarity is estimated by maximum likelihood from
how many registers are greater, less and equal, and what could reach the
threshold is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, components, textscan

SHINGLE = 5
THRESHOLD = 75
#: Registers (a prime, so that any step visits all), base, rate, greatest register value.
REGISTERS, BASE, RATE, TOP = 97, 1.001, 20.0, (1 << 16) - 1
#: 32 bands of 3: two sets with similarity 0.75 share none with a probability under 3e-8.
BANDS, ROWS = 32, 3
#: A pair estimated below this is not confirmed: over five standard deviations under the threshold.
ESTIMATE = 0.5
#: 64-bit words of the parity bitmaps; the narrow one is the wide one folded.
NARROW, WIDE = 8, 64
U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and the n+1 row offsets."""
    starts, ends, bounds = textscan.words(data, offsets, textscan.SPACE)
    h = textscan.word_hashes(data, starts, ends, True)
    at = textscan.run_starts(bounds, k)
    values = [textscan.runs(h, k)[at]] if len(at) else []
    rows = [np.searchsorted(bounds, at, "right") - 1] if len(at) else []
    n = np.diff(bounds)
    for short in range(1, k):
        own = np.flatnonzero(n == short)
        if len(own):
            values.append(textscan.runs(h, short)[bounds[own]] ^ U(short))
            rows.append(own)
    if not values:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    x, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, row = x[keep], row[keep]
    return x, np.searchsorted(row, np.arange(len(offsets))).astype(np.int64)


def registers(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint16 registers of each row's set; a row without shingles has zeros."""
    m, n = REGISTERS, len(bounds) - 1
    low = np.full(n * m, np.inf)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    place = (x % U(m)).astype(np.int64)
    step = ((x >> U(20)) % U(m - 1)).astype(np.int64) + 1
    seed, level = x, 0
    while len(row):
        seed = textscan.mix(seed + U(0x9E3779B97F4A7C15))
        value = level + (seed >> U(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(low, row * m + place, value)
        level += 1
        unsettled = np.isinf(low).reshape(n, m).any(1)
        if level == m:
            break
        more = unsettled[row]
        row, place, step, seed = row[more], place[more], step[more], seed[more]
        place = (place + step) % m
    gone = np.isinf(low)
    low[gone] = 0.5
    exponential = -np.log1p(-low / m) / RATE
    k = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP)
    k[gone] = 0
    return k.astype(np.uint16).reshape(n, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    """One key for each band of each row; the band's number is part of it."""
    parts = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = textscan.mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from registers and exact set sizes, by a bounded search."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        more, less = p(u - v * j), p(v - u * j)
        return above * np.log(more) + below * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    lo, hi, g = np.zeros_like(u), top.copy(), (5**0.5 - 1) / 2
    for _ in range(24):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        right = likelihood(x) < likelihood(y)
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
    return (lo + hi) / 2


def _totals(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set: a sum and an exclusive or."""
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textscan.mix(x ^ U(0xA5A5A5A5A5A5A5A5)))])
    b = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(textscan.mix(x * U(0xC2B2AE3D27D4EB4F)))])
    return a[bounds[1:]] - a[bounds[:-1]], b[bounds[1:]] ^ b[bounds[:-1]]


def _lists(grid: np.ndarray) -> pa.ListArray:
    """Rows of a uint64 grid as arrays of longs."""
    n, width = grid.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(textscan.signed(np.ascontiguousarray(grid)).ravel()))


#: Tell rows apart by doc_id and text.
_TEXT = (F.xxhash64, lambda text: F.xxhash64(F.lit(7), text))
_SKETCH = "doc_id long, t1 long, t2 long, n_shingles long, h1 long, h2 long, keys array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole):
            x, bounds = shingle_sets(*common.text_bytes(batch.column("text")))
            h1, h2 = _totals(x, bounds)
            keys = _lists(bands(registers(x, bounds)))
            own = ["doc_id", "t1", "t2"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(np.diff(bounds)), pa.array(textscan.signed(h1)), pa.array(textscan.signed(h2)), keys], [*own, "n_shingles", "h1", "h2", "keys"])


def odd_sketch(x: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps of each row's set: `words` 64-bit words. Two sets differ in at least as many elements as their bitmaps in bits."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    bit = (textscan.mix(x + U(0x632BE59BD9B4E019)) % U(64 * words)).astype(np.int64)
    counts = np.bincount(row * (64 * words) + bit, minlength=n * 64 * words) & 1
    return np.packbits(counts.astype(np.uint8).reshape(n, 64 * words), axis=1, bitorder="little").view(np.uint64)


def _differ(x: Column, y: Column, name: str, words: int) -> Column:
    out = F.lit(0)
    for i in range(words):
        out = out + F.bit_count(x[f"{name}{i}"].bitwiseXOR(y[f"{name}{i}"]))
    return out


def _possible(threshold: int):
    """Whether two sets can reach the threshold: by size, then by parity bitmaps of 512 and of 4096 bits.

    J = o / (s - o) for an overlap o of sizes that sum to s, and the sets differ in
    s - 2 o elements; a bitmap's difference is a lower bound of that.
    """

    def possible(x: Column, y: Column) -> Column:
        small, large, total = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"]), x["n"] + y["n"]
        room = total * (100 - threshold)
        wide = F.aggregate(F.zip_with(x["wide"], y["wide"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)
        return (100 * small >= threshold * large) & ((100 + threshold) * _differ(x, y, "o", NARROW) <= room) & ((100 + threshold) * wide <= room)

    return possible


_REHASH = "text string, n_shingles long, h1 long, h2 long, wide array<long>, narrow array<long>"


def _rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole):
            x, bounds = shingle_sets(*common.text_bytes(batch.column("text")))
            h1, h2 = _totals(x, bounds)
            wide = odd_sketch(x, bounds, WIDE)
            narrow = np.bitwise_xor.reduce(wide.reshape(-1, WIDE // NARROW, NARROW), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(np.diff(bounds)), pa.array(textscan.signed(h1)), pa.array(textscan.signed(h2)), _lists(wide), _lists(narrow)], ["text", "n_shingles", "h1", "h2", "wide", "narrow"])


def shingle_words(text: bytes, k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """A text's set as words."""
    words = bytes(textscan.LOWER[np.frombuffer(text, np.uint8)]).split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def _confirm(threshold: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text_a", common.SLICE_BYTES // 2):
                texts = [batch.column(c).cast(pa.large_binary()) for c in ("text_a", "text_b")]
                xa, ba = shingle_sets(*common.text_bytes(texts[0]))
                xb, bb = shingle_sets(*common.text_bytes(texts[1]))
                na, nb = np.diff(ba), np.diff(bb)
                near = 100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)
                near[near] = similarity(registers(xa, ba)[near].astype(int), registers(xb, bb)[near].astype(int), na[near], nb[near]) >= min(ESTIMATE, threshold / 100 - 0.25)
                last = None, set()  # pairs come by their first text
                for i in np.flatnonzero(near).tolist():
                    shared = len(np.intersect1d(xa[ba[i] : ba[i + 1]], xb[bb[i] : bb[i + 1]], assume_unique=True))
                    near[i] = 100 * shared >= threshold * (na[i] + nb[i] - shared)
                    if near[i]:  # by hashes; what decides are the words
                        first = texts[0][i].as_py()
                        last = last if last[0] == first else (first, shingle_words(first))
                        other = shingle_words(texts[1][i].as_py())
                        shared = len(last[1] & other)
                        near[i] = 100 * shared >= threshold * (len(last[1]) + len(other) - shared)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return confirm


def _components(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (doc_id, t1, t2, n_shingles, h1, h2); classes of equal sets (h1, h2, n_shingles, rep, label), rep the smallest
    doc_id and label a number of the component; tables to delete once both are read."""
    texts = docs.select("doc_id", *(f(F.col("text")).alias(f"t{i}") for i, f in enumerate(_TEXT, 1)), "text")
    sketches = common.save(texts.mapInArrow(_sketch, _SKETCH), "sketches")
    own = ["h1", "h2", "n_shingles"]
    grouped = sketches.where("n_shingles > 0").groupBy(*own).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    # Numbers given once and written, so that no later reading can give others.
    classes = common.save(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    meeting = common.save(components.meeting(classes.select(F.explode("keys").alias("key"), "id")), "meeting")
    wanted = classes.join(meeting.select("id").distinct(), "id").select("id", "rep", *own)
    wanted = common.save(wanted, "wanted")
    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    texts = common.join_small(docs.select("doc_id", "text"), reps, "doc_id", "left_semi").unionAll(docs.where("doc_id IS NULL").select("doc_id", "text"))
    texts = common.join_small(texts.mapInArrow(_rehash, _REHASH), wanted.select("id", *own), own, "inner")
    texts = common.save(texts.groupBy("id").agg(F.first("text").alias("text"), F.first("n_shingles").alias("n"), F.first("wide").alias("wide"), F.first("narrow").alias("narrow")), "texts")
    narrow = [F.get("narrow", F.lit(i)).alias(f"o{i}") for i in range(NARROW)]
    attributes = texts.select("id", F.struct("n", "wide", *narrow).alias("x"))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(threshold), "a long, b long")

    labels = components.link(meeting, verify, attributes, _possible(threshold))
    common.drop(meeting, wanted, texts)
    whole = classes.select("id", "rep", *own).join(labels, "id", "left").select(*own, "rep", F.coalesce("label", "id").alias("label"))
    return sketches.drop("keys"), whole, [sketches, classes, labels]


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of docs.

    A row with fewer than 5 words has its whole sequence as one shingle; a row
    without words (null, empty) has none and is linked with nothing. component_id is
    the smallest doc_id reachable over links of at least `threshold` percent; rows
    that share a doc_id are told apart by their texts, and all those that bear the
    component's id are kept. A row with a null doc_id has a null component unless
    linked with one that has an id; it is kept if its component is null. Columns
    other than doc_id and text are ignored; an empty table gives no rows.
    """
    own = ["h1", "h2", "n_shingles"]
    sketches, whole, _ = _components(docs, threshold)
    lowest = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    whole = whole.join(lowest, "label").select(*own, "component_id")
    rows = sketches.where("n_shingles > 0").select("doc_id", *own).join(whole, own)
    alone = sketches.where("n_shingles = 0").select("doc_id", *own, F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, of which one stays of each component.

    It is the row with the smallest doc_id, a null one after all others, and of several
    such rows the one with the smallest text hash; of equal ones any one. Rows without
    words are duplicates of nothing and all stay. An empty table stays empty.
    """
    own = ["h1", "h2", "n_shingles"]
    sketches, whole, spent = _components(docs, threshold)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t1", "t2")
    rows = sketches.where("n_shingles > 0").select("doc_id", "t1", "t2", *own).join(whole.select(*own, "label"), own).select("label", place.alias("place"))
    heads = rows.groupBy("label").agg(F.min("place").alias("head"))
    judged = rows.groupBy("label", "place").agg(F.count(F.lit(1)).alias("n")).join(heads, "label").select("place.doc_id", "place.t1", "place.t2", "n", F.col("place").eqNullSafe(F.col("head")).alias("stays"))
    judged = common.save(judged.where("n > 1 OR NOT stays"), "duplicates")
    common.drop(*spent)
    # Names that no column of docs has.
    tag = "key_" + "_".join(sorted(docs.columns, key=len)[-1:])
    names = [f"{tag}_{c}" for c in ("t1", "t2")]
    keyed = docs.select("*", *(f(F.col("text")).alias(n) for f, n in zip(_TEXT, names, strict=True)))

    def among(side: DataFrame, how: str) -> DataFrame:
        side = side.select(F.col("doc_id").alias(f"{tag}_id"), "t1", "t2")
        side = F.broadcast(side) if common.small(side, 500_000) else side
        same = keyed["doc_id"].eqNullSafe(side[f"{tag}_id"]) & (keyed[names[0]] == side["t1"]) & (keyed[names[1]] == side["t2"])
        return keyed.join(side, same, how)

    left = among(judged, "left_anti").drop(*names)
    again = judged.where("stays")
    if again.isEmpty():
        return left
    # Equal rows of doc_id and text, of which one stays.
    order = Window.partitionBy(keyed["doc_id"], *names).orderBy(F.lit(1))
    first = among(again, "left_semi").withColumn(f"{tag}_place", F.row_number().over(order)).where(F.col(f"{tag}_place") == 1)
    return left.unionByName(first.select(docs.columns))
