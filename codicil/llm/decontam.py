"""Benchmark decontamination as a prefix-filtered set join over windows of words.

An item is cut into windows of WINDOW words, a window into shingles of SHINGLE
words. Containment of a whole window needs all its shingles, so the prefix that
must match is its rarest shingle in the corpus. Documents are probed for those
shingles; a hit's place in the window gives the window's place in the document
(positional bound), which must fit (length bound); the words are then compared
byte by byte.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textscan

WINDOW = 10
SHINGLE = 5
#: Item texts of one block, in bytes. An index is broadcast; a larger benchmark is joined block by block.
BLOCK_BYTES = 8 << 20


class Windows:
    """All windows of a block of items, as places in its words: distinct word sequences and the items that have them.

    Everything is an array over the block's words or windows; no window's text is copied.
    """

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW, shingle: int = SHINGLE):
        raw = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.cumsum([0, *(len(t) for _, t in items)])
        starts, ends, bounds = textscan.words(raw, offsets, textscan.NOT_ALNUM)
        hashes = textscan.word_hashes(raw, starts, ends, True)
        low = textscan.LOWER[raw].tobytes()
        #: The words, one space apart, and where each begins and ends.
        self.words = b" ".join(low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
        sizes = ends - starts
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes
        self.names = ["" if item is None else str(item) for item, _ in items]
        counts = np.diff(bounds)
        lengths = np.minimum(counts, window)
        per_item = np.where(counts > 0, counts - lengths + 1, 0)
        owner = np.repeat(np.arange(len(items)), per_item)
        first = np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item, per_item) + bounds[:-1][owner]
        length = lengths[owner]
        keys = np.zeros(len(first), np.uint64)
        for n in np.unique(length):
            own = length == n
            keys[own] = textscan.runs(hashes, int(n))[first[own]]
        order = np.lexsort((owner, keys, length))
        kind = self._kinds(first, length, keys, order)
        #: Of each distinct window: its first word and length; and the items that have it, window by window.
        new = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.empty(0, np.int64)
        self.first, self.length = first[order][new], length[order][new]
        self.owner_from, self.owner = np.append(new, len(order)), owner[order]
        #: Windows of each size of shingle and number of shingles, with these.
        self.shingles: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in np.unique(self.length):
            k, own = min(shingle, int(n)), np.flatnonzero(self.length == n)
            at = self.first[own][:, None] + np.arange(int(n) - k + 1)
            self.shingles.append((k, own, textscan.runs(hashes, k)[at]))

    def text(self, first: int, length: int) -> bytes:
        return self.words[self.begin[first] : self.end[first + length - 1]]

    def _kinds(self, first: np.ndarray, length: np.ndarray, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        """A number for each window in order, the same for the same words; windows of one hash are compared by their words."""
        if not len(order):
            return np.empty(0, np.int64)
        new = np.concatenate([[True], (np.diff(keys[order]) != 0) | (np.diff(length[order]) != 0)])
        cuts = np.append(np.flatnonzero(new), len(order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                texts = [self.text(int(first[i]), int(length[i])) for i in order[a:b]]
                if any(t != texts[0] for t in texts):  # different words of one hash
                    by_text = sorted(range(b - a), key=lambda i, texts=texts: texts[i])
                    order[a:b] = order[a:b][by_text]
                    new[a + 1 : b] = [texts[x] != texts[y] for x, y in zip(by_text[1:], by_text[:-1], strict=True)]
        return np.cumsum(new)

    def all_shingles(self) -> dict[int, np.ndarray]:
        by_k: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, _, own in self.shingles:
            by_k[k].append(own.ravel())
        return {k: np.unique(np.concatenate(v)) for k, v in by_k.items()}


@dataclass
class Probe:
    """The necessary prefix shingles of a block: for each size k, sorted hashes and (window, offset) runs."""

    keys: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    window: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    windows: Windows


def _probe(windows: Windows, counts: dict[int, np.ndarray]) -> Probe:
    """The rarest shingle of each window, of equally rare ones the first; counts go by all_shingles()."""
    every, rows = windows.all_shingles(), defaultdict(list)
    for k, own, hashes in windows.shingles:
        at = counts[k][np.searchsorted(every[k], hashes)].argmin(1)
        rows[k].append((hashes[np.arange(len(own)), at], own, at))
    windows.shingles = []
    keys, first, window, offset = {}, {}, {}, {}
    for k, parts in rows.items():
        h, own, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((own, h))
        keys[k], start = np.unique(h[order], return_index=True)
        first[k] = np.append(start, len(h))
        window[k], offset[k] = own[order], at[order]
    return Probe(keys, first, window, offset, windows)


def _among(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of values that are among the sorted keys, and their places there."""
    bits = max(12, min(24, int(len(keys) * 16).bit_length()))
    seen = np.zeros(1 << bits, bool)
    seen[keys >> textscan.U(64 - bits)] = True
    some = np.flatnonzero(seen[values >> textscan.U(64 - bits)])
    place = np.minimum(np.searchsorted(keys, values[some]), len(keys) - 1)
    ok = keys[place] == values[some]
    return some[ok], place[ok]


def _scan(batch: pa.RecordBatch, text: str = "text"):
    data, offsets = common.text_bytes(batch.column(text))
    starts, ends, bounds = textscan.words(data, offsets, textscan.NOT_ALNUM)
    return data, starts, ends, bounds, textscan.word_hashes(data, starts, ends, True)


def _counter(shingles: dict[int, np.ndarray]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(keys), np.int64) for k, keys in shingles.items()}
        for whole in batches:
            for batch in common.slices(whole):
                _, _, _, bounds, hashes = _scan(batch)
                for k, keys in shingles.items():
                    at = textscan.run_starts(bounds, k)
                    _, place = _among(textscan.runs(hashes, k)[at] if len(at) else np.empty(0, np.uint64), keys)
                    totals[k] += np.bincount(place, minlength=len(keys))
        for k, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(textscan.signed(shingles[k][some])), pa.array(n[some])], ["k", "h", "n"])

    return count


def _matcher(shared, text: str, spans: str, items: str, n_words: str):
    """Adds a block's hits to the columns `spans` and `items` of the rows; the other columns pass through."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe: Probe = shared.value
        windows = probe.windows
        for whole in batches:
            for batch in common.slices(whole, text):
                data, starts, ends, bounds, hashes = _scan(batch, text)
                found_spans, found_items = batch.column(spans).to_pylist(), [set(x) for x in batch.column(items).to_pylist()]
                for k, keys in probe.keys.items():
                    at = textscan.run_starts(bounds, k)
                    if not len(at):
                        continue
                    some, place = _among(textscan.runs(hashes, k)[at], keys)
                    at = at[some]
                    rows = np.searchsorted(bounds, at, "right") - 1
                    for i, row, p in zip(at.tolist(), rows.tolist(), place.tolist(), strict=True):
                        for x in range(probe.first[k][p], probe.first[k][p + 1]):
                            w = probe.window[k][x]
                            s = i - int(probe.offset[k][x])
                            e = s + int(windows.length[w])
                            if s < bounds[row] or e > bounds[row + 1]:
                                continue
                            found = b" ".join(textscan.LOWER[data[starts[j] : ends[j]]].tobytes() for j in range(s, e))
                            if found == windows.text(int(windows.first[w]), e - s):
                                found_spans[row] += [s - int(bounds[row]), e - int(bounds[row])]
                                found_items[row].update(windows.names[o] for o in windows.owner[windows.owner_from[w] : windows.owner_from[w + 1]])
                made = {n_words: pa.array(np.diff(bounds)), spans: pa.array(found_spans, pa.list_(pa.int64())), items: pa.array([sorted(x) for x in found_items], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return match


def _covered(spans: list[int]) -> list[int]:
    """Union of intervals given as start, end, start, end, ..."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            union = _covered(spans)
            names = sorted(set(items))
            rows.append((union, sum(union[1::2]) - sum(union[::2]), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), names))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "hit_spans", "n_hit", "n_items", "items_sha256", "items"])


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in blocks of bounded size, fetched a partition at a time."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where(F.length("text") > 0).toLocalIterator():
        text = r["text"].encode()
        block.append((r["item_id"], text))
        held += len(text)
        if held >= limit:
            yield block
            block, held = [], 0
    yield block


def _matched(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_bytes: int, names: tuple[str, str, str]) -> DataFrame:
    """docs and its hits, in columns of the names given: words, spans, items."""
    n_words, spans, items = names
    hits = docs.select("*", F.lit(0).cast("long").alias(n_words), F.expr(f"cast(array() AS array<bigint>) AS `{spans}`"), F.expr(f"cast(array() AS array<string>) AS `{items}`"))
    schema = hits.schema
    for block in _blocks(benchmark, block_bytes):
        windows = Windows(block, window, shingle)
        every = windows.all_shingles()
        counts = docs.select("text").mapInArrow(_counter(every), "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).toArrow()
        rarity = {k: np.zeros(len(keys), np.int64) for k, keys in every.items()}
        size, hashes, n = (counts[c].to_numpy() for c in ("k", "h", "n"))
        for k, keys in every.items():
            rarity[k][np.searchsorted(keys, hashes[size == k].view(np.uint64))] = n[size == k]
        probe = docs.sparkSession.sparkContext.broadcast(_probe(windows, rarity))
        hits = hits.mapInArrow(_matcher(probe, "text", spans, items, n_words), schema)
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hit_spans, n_hit, n_items, items_sha256, items, contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.
    Null and empty texts have no words: they are never contaminated and contaminate
    nothing. hit_spans is the union of matched windows as word positions start,
    end, ... Items that share an id count as one; a null id counts as an empty one.
    Each row of docs gives a row, whatever its doc_id; an empty benchmark hits nothing.

    A block of the benchmark at a time is held and broadcast; each adds its hits to
    the rows as they pass, without a shuffle.
    """
    hits = _matched(docs.select("doc_id", "text"), benchmark, window, shingle, block_bytes, ("n_words", "spans", "items")).drop("text")
    out = hits.mapInArrow(_summary, "doc_id long, n_words long, hit_spans array<long>, n_hit long, n_items long, items_sha256 string, items array<string>")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns unchanged, in which no window occurs.

    Each row is judged by its own text in the pass that reads it, whatever its doc_id,
    null and shared ones too; null and empty texts stay. No join, no shuffle.
    """
    have, names = {c.lower() for c in docs.columns}, []
    for name in ("n_words", "hit_spans", "hit_items"):
        while name in have:
            name = f"_{name}"
        names.append(name)
    hits = _matched(docs, benchmark, window, shingle, block_bytes, tuple(names))
    return hits.where(F.size(names[1]) == 0).select(docs.columns)
