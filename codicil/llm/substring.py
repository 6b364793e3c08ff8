"""Repeated passages by prefix-partitioned suffix trees over words.

Suffixes are sampled: of the 16-word prefixes inside each 50-word window the one
with the least hash is the window's anchor, so equal windows have equal anchors
at the same place. The corpus' suffixes at anchors are partitioned by that
prefix. A prefix held by one document only is a leaf and goes no further. The
others are streamed, with the words of their windows, to the task of their prefix,
which builds two trees over whole groups: of the suffixes that begin at the anchor,
and of the words before it read backwards. A tree is the sorted suffixes and the
words that neighbours have in common; the runs that share a depth are its nodes.
Windows are equal if they are under one node of each tree, at depths that add up to
the window, so words decide and not hashes. Windows around one anchor overlap: what
an earlier document has of them is one stretch, and stretches joined are the maximal
repeats. Where too many suffixes share a prefix to be one group, the prefix is made
longer: their windows are partitioned by all 50 words, with minima combined before
the shuffle.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textscan

WINDOW = 50
PREFIX = 16
#: Suffixes under one prefix that make a group for one task: some 50 MB of words, and as much again for each tree.
GROUP = 100_000
#: Suffixes over which trees are built at once; a group is never divided.
TREE_ROWS = 4096
#: Bits a shared prefix gets in the filter that is broadcast, and the filter's greatest size (32 MB).
BITS_EACH, MOST_BITS = 16, 28
U = np.uint64


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, prefix: int):
    """Word spans and row offsets; each window's first word and anchor word; hashes of prefixes."""
    starts, ends, bounds = textscan.words(data, offsets, textscan.SPACE)
    h = textscan.word_hashes(data, starts, ends, False)
    at = textscan.run_starts(bounds, window)
    short = textscan.runs(h, prefix)
    if not len(at):
        return starts, ends, bounds, h, at, at, short
    span = window - prefix + 1
    view = np.lib.stride_tricks.sliding_window_view(short, span)
    least = np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 16):  # views of several rows are not copied whole
        a, b = at[i], at[min(i + (1 << 16), len(at)) - 1] + 1
        least[i : i + (1 << 16)] = view[a:b].argmin(1)[at[i : i + (1 << 16)] - a]
    return starts, ends, bounds, h, at, at + least, short


def _sample(window: int, prefix: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole):
                _, _, bounds, _, at, anchor, short = _anchors(*common.text_bytes(batch.column("text")), window, prefix)
                own = np.unique(anchor)  # anchors of different rows are different words
                row = np.searchsorted(bounds, own, "right") - 1
                doc = np.asarray(batch.column("doc_id"))
                yield pa.RecordBatch.from_arrays([pa.array(textscan.signed(short[own]) if len(own) else np.empty(0, np.int64)), pa.array(doc[row].astype(np.int64))], ["prefix", "doc_id"])

    return sample


def _filter(prefixes: DataFrame, count: int) -> tuple[int, bytes]:
    """Bits set at the shared prefixes' hashes, put together on the executors; of bounded size."""
    bits = min(MOST_BITS, max(16, int(count * BITS_EACH).bit_length()))
    place = f"shiftrightunsigned(prefix, {64 - bits})"
    words = prefixes.select(F.expr(f"cast(shiftright({place}, 6) AS int)").alias("w"), F.expr(f"shiftleft(1L, cast({place} & 63 AS int))").alias("b"))
    out = np.zeros((1 << bits) // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r["w"]] = r["b"]
    return bits, out.tobytes()


_SUFFIXES = "prefix long, doc_id long, first long, lead int, n_windows int, words binary"


def _suffixes(shared, window: int, prefix: int):
    """The sampled suffixes whose prefix may be shared, each with the words of its windows.

    `first` is the place of the first word in its document, `lead` the anchor's among the words.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = shared.value
        packed = np.frombuffer(packed, np.uint8)
        for whole in batches:
            for batch in common.slices(whole):
                data, offsets = common.text_bytes(batch.column("text"))
                starts, ends, bounds, _, at, anchor, short = _anchors(data, offsets, window, prefix)
                if not len(at):
                    continue
                place = short[anchor] >> U(64 - bits)
                keep = np.flatnonzero(packed[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8) & 1)
                if not len(keep):
                    continue
                a, first = anchor[keep], at[keep]
                cut = np.flatnonzero(np.diff(a) != 0) + 1  # windows of an anchor are consecutive
                lead = np.concatenate([[0], cut])
                n = np.diff(np.append(lead, len(a)))
                a, first = a[lead], first[lead]
                row = np.searchsorted(bounds, a, "right") - 1
                text, doc = data.tobytes(), np.asarray(batch.column("doc_id")).astype(np.int64)
                spans = zip(starts[first].tolist(), ends[first + n + window - 2].tolist(), strict=True)
                cols = [textscan.signed(short[a]), doc[row], first - bounds[row], (a - first).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([text[s:e] for s, e in spans], pa.binary())], ["prefix", "doc_id", "first", "lead", "n_windows", "words"])

    return emit


class SubTree:
    """A suffix tree of rows of word numbers, in which a negative number ends a row: the rows in order and what neighbours share."""

    def __init__(self, rows: np.ndarray):
        n, self.depth = rows.shape
        packed = np.ascontiguousarray(rows.astype(">i4")).view(np.dtype((np.void, 4 * max(self.depth, 1)))).ravel() if self.depth else np.zeros(n, "V1")
        self.order = np.argsort(packed, kind="stable")
        ordered = rows[self.order]
        same = (ordered[1:] == ordered[:-1]) & (ordered[1:] >= 0)
        self.common = np.where(same.all(1), self.depth, same.argmin(1)) if self.depth else np.zeros(max(n - 1, 0), np.int64)

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the number of the node over it at a depth: rows with the same number share as many words."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.common < depth)
        return out


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as numbers, one text after the other, and the n+1 offsets. The words of one text are held at a time."""
    numbers: dict[bytes, int] = {}
    flat, ends = array("i"), [0]
    for t in texts:
        flat.extend([numbers.setdefault(w, len(numbers)) for w in t.split()])
        ends.append(len(flat))
    return np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32), np.array(ends, np.int64)


def _repeated(doc: np.ndarray, lead: np.ndarray, n_windows: np.ndarray, texts: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a window that a smaller document has, and the first and last such window of each."""
    ids, bounds = _numbered(texts)
    n, count = len(texts), np.diff(bounds)

    def rows(start: np.ndarray, step: int, depth: int, left: np.ndarray) -> np.ndarray:
        place = start[:, None] + step * np.arange(depth)
        return np.where(np.arange(depth) < left[:, None], ids[np.clip(place, 0, max(len(ids) - 1, 0))], -1)

    after = SubTree(rows(bounds[:-1] + lead, 1, window, count - lead))
    before = SubTree(rows(bounds[:-1] + lead - 1, -1, window - prefix, lead))
    low, high = np.full(n, window, np.int64), np.full(n, -1, np.int64)
    for left in range(window - prefix + 1):  # the words of a window that stand before the anchor
        own = np.flatnonzero((left <= lead) & (left > lead - n_windows))
        if len(own) < 2:
            continue
        node = after.nodes(window - left)[own] * (n + 1) + before.nodes(left)[own]
        order = np.lexsort((doc[own], node))
        node, own = node[order], own[order]
        new = np.concatenate([[True], node[1:] != node[:-1]])
        least = doc[own][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = own[doc[own] > least]
        low[hit] = np.minimum(low[hit], lead[hit] - left)
        high[hit] = np.maximum(high[hit], lead[hit] - left)
    found = np.flatnonzero(high >= 0)
    return found, low[found], high[found]


_COVER = "doc_id long, spans array<long>"


def _grow(window: int, prefix: int):
    def grown(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        doc, first, lead, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "first", "lead", "n_windows"))
        at, low, high = _repeated(doc, lead, n, rows.column("words").to_pylist(), window, prefix)
        spans = np.stack([first[at] + low, first[at] + high + window], 1).ravel()
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 2), pa.array(spans))], ["doc_id", "spans"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            start = 0
            prefixes = batch.column("prefix").to_numpy()
            while start < len(prefixes):
                # The next place, from TREE_ROWS rows on, at which a group ends.
                stop = min(len(prefixes), start + max(TREE_ROWS - size, 0))
                last = prefixes[stop - 1] if stop > start else held[-1].column("prefix")[-1].as_py()
                other = np.flatnonzero(prefixes[stop:] != last)
                full = size + stop - start >= TREE_ROWS and len(other) > 0
                stop = stop + int(other[0]) if full else len(prefixes)
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                size, start = size + stop - start, stop
                if full:
                    yield grown(held)
                    held, size = [], 0
        if held:
            yield grown(held)

    return grow


def _union(spans: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, spans: pieces of the maximal repeats of each document that an earlier one has.

    Spans are word positions start, end, ...; one row for each suffix that hits. A
    row with a null doc_id is no document. A row that shares its doc_id with another
    is one with it in order: neither takes words from the other.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    sampled = texts.mapInArrow(_sample(window, prefix), "prefix long, doc_id long")
    counts = sampled.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = common.save(counts.where("low < high").select("prefix", "n"), "prefixes")
    many = shared.count()
    if not many:
        return spark.createDataFrame([], _COVER)
    held = spark.sparkContext.broadcast(_filter(shared, many))
    suffixes = texts.mapInArrow(_suffixes(held, window, prefix), _SUFFIXES)
    # Prefixes over `group` suffixes are at most (sampled suffixes / group) many.
    hot = shared.where(F.col("n") > group).select("prefix")
    if hot.isEmpty():
        cool, long_ = suffixes, None
    else:
        suffixes = common.save(suffixes, "suffixes")
        cool, long_ = common.join_small(suffixes, hot, "prefix", "left_anti"), common.join_small(suffixes, hot, "prefix", "left_semi")
    n = common.shuffle_partitions(spark)
    grown = cool.repartition(n, "prefix").sortWithinPartitions("prefix").mapInArrow(_grow(window, prefix), _COVER)
    if long_ is None:
        return grown
    text = F.array_join(F.slice("w", F.col("i") + 1, F.lit(window)), " ")
    split = long_.select("doc_id", "first", F.split(F.decode("words", "UTF-8"), "[ \\t-\\r]+").alias("w"), F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("i"))
    leaves = split.select("doc_id", (F.col("first") + F.col("i")).alias("at"), F.sha2(text, 256).alias("node"))
    leaves = common.save(leaves, "leaves")
    deep = leaves.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("node", "low")
    hits = leaves.join(deep, "node").where("doc_id > low")
    return grown.unionByName(hits.select("doc_id", F.array("at", F.col("at") + window).alias("spans")))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_union(s) for s in batch.column("spans").to_pylist()], pa.list_(pa.int64()))], ["doc_id", "spans"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            union, at, kept = _union(spans) if spans else [], 0, []
            for s, e in zip(union[::2], union[1::2], strict=True):
                kept += words[at:s]
                at = e
            kept = b" ".join(kept + words[at:] if union else words)
            rows.append((len(words), sum(union[1::2]) - sum(union[::2]), hashlib.sha256(kept).hexdigest(), union, kept.decode() if union else None))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (word spans), kept_text (null where nothing goes).

    Each word inside a window that starts in a document with a smaller doc_id too is
    removed; windows are those of the input. Null and empty texts have no words. A
    row of docs gives a row; an empty table gives none.
    """
    spans = repeats(docs, window, **options).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = common.save(spans.mapInArrow(_merge, _COVER).select(F.col("doc_id").alias("_id"), "spans"), "repeats")
    sizes = spans.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("spans")).alias("m")).first()
    # 16 MB at most when broadcast; otherwise documents are shuffled to their spans.
    if sizes["n"] <= 300_000 and (sizes["m"] or 0) <= 1_500_000:
        spans = F.broadcast(spans)
    rows = docs.select("doc_id", "text").join(spans, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_rewrite, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<long>, kept_text string")
