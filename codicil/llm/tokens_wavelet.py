"""Token ids of a corpus in wavelet-matrix files.

Documents are dealt to shards by ranges of doc_id. A shard's ids, in document
order, are kept as a wavelet matrix: one bit plane for each bit of an id, each
with a rank directory and compressed by itself, so that access, rank, select
and count touch few bytes of the plane they need. Spark's writer stores one file
image a row and commits a task's files at once, so a lost executor only costs
its tasks.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"WMX1"
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Ids after which a shard's file is closed; bounds a task's memory.
SHARD_IDS = 1 << 21
BLOCK_BITS = 512
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Normaliser and pre-tokenizer of the tokenizers that may be given a text's words one by one.
_BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class _Known(dict):
    """Ids of words, in bytes; a word that isn't there is encoded and kept as it is looked up."""

    def __init__(self, new: Callable[[bytes], bytes]):
        super().__init__()
        self.new = new

    def __missing__(self, word: bytes) -> bytes:
        return self.new(word)


class WordCache:
    """Encodes texts with a library tokenizer by way of their words.

    A tokenizer whose pre-tokens never cross white space is given words: texts are cut
    at ASCII white space; each new word is encoded once and kept. Plain Latin words
    with an optional tail of points go to the library's BPE model as the pre-token
    that its own normaliser makes of them, all others through the whole library. Any
    other tokenizer is given whole texts. `limit` bounds the bytes of what is kept.
    """

    #: Bytes that a kept entry takes beside its key and value: two headers and a place in the table.
    ENTRY = 160
    #: Words of a text between two looks at what is held.
    PART = 1 << 16

    def __init__(self, path: str, limit: int = 128 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.kind).char
        form = json.loads(self.tokenizer.to_str())
        self.by_words = (form["normalizer"], form["pre_tokenizer"]) == _BY_WORDS and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in form["added_tokens"])
        self.limit, self.held = limit, 0
        self.known = _Known(self._new)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
        self.mapped = {ord(c): level.pre_tokenize_str(c)[0][0] for c in latin}

    def _whole(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _keep(self, word: bytes, ids: bytes) -> bytes:
        self.known[word] = ids
        self.held += len(word) + len(ids) + self.ENTRY
        return ids

    def _letters(self, run: str) -> bytes:
        """A run of lower-case letters, in the form that the library's pre-tokenizer gives them."""
        return array(self.code, [t.id for t in self.model.tokenize(run)]).tobytes()

    def _run(self, run: str) -> bytes:
        """A run of letters, which is kept as the word that it is in lower case."""
        run = run.lower()
        word = run.encode()
        found = self.known.get(word)
        return self._keep(word, self._letters(run.translate(self.mapped))) if found is None else found

    def _new(self, word: bytes) -> bytes:
        """Encode a word and keep it."""
        if word.isalpha() and word.islower():  # ASCII letters, which stand for themselves
            return self._keep(word, self._letters(word.decode()))
        text = word.decode("utf-8", "replace")
        if m := _SIMPLE.fullmatch(text):
            run, tail = m.groups()
            ids = self._run(run) + (self._tail(tail) if tail else b"")
            if word in self.known:  # a run of letters keeps itself
                return ids
        else:
            ids = self._whole(text)
        return self._keep(word, ids)

    def _tail(self, tail: str) -> bytes:
        word = tail.encode()
        found = self.known.get(word)
        return self._keep(word, self._whole(tail)) if found is None else found

    def _shrink(self) -> None:
        """Keep the first entries, up to half of the bytes: the first to come are the frequent ones."""
        old, self.known, self.held = self.known, _Known(self._new), 0
        for word, ids in old.items():
            if self.held >= self.limit // 2:
                break
            self._keep(word, ids)

    def encode(self, text: bytes) -> np.ndarray:
        if not self.by_words:
            return np.frombuffer(self._whole(text.decode("utf-8", "replace")), self.kind)
        words, out = text.split(), []
        for i in range(0, len(words), self.PART):
            out.append(b"".join(map(self.known.__getitem__, words[i : i + self.PART])))
            if self.held > self.limit:
                self._shrink()
        return np.frombuffer(b"".join(out), self.kind)


_encoders: dict[str, WordCache] = {}


def encoder(path: str) -> WordCache:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordCache(path)
    return _encoders[path]


class WaveletMatrix:
    """Succinct sequence of ids with access, rank, select, count and whole decoding."""

    def __init__(self, planes: list[bytes], ranks: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.ranks, self.zeros, self.n = planes, ranks, zeros, n
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        for level in reversed(range(levels)):
            bits = (ids >> ids.dtype.type(level)) & ids.dtype.type(1) != 0
            plane = np.packbits(bits, bitorder="little")
            planes.append(plane.tobytes())
            padded = np.zeros(-(-len(plane) // 64) * 64, np.uint8)
            padded[: len(plane)] = plane
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            low = ids[~bits]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[bits]])
        return cls(planes, ranks, zeros, len(ids))

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK_BITS
        at = block * BLOCK_BITS // 8
        rest = int.from_bytes(self.planes[level][at : at + BLOCK_BITS // 8], "little") & ((1 << (i - block * BLOCK_BITS)) - 1)
        return int(self.ranks[level][block]) + rest.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return self.planes[level][i >> 3] >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        for level in range(self.levels):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        if token >> self.levels:
            return 0
        start, end = self._range(token, min(i, self.n))
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _place(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th bit of this kind in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._place(level, i - self.zeros[level] if bit else i, bit)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self, kind: type) -> np.ndarray:
        """All ids, from the last plane up."""
        ids = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            bits = np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[~bits], back[bits] = ids[: self.zeros[level]], ids[self.zeros[level] :]
            back |= bits.astype(kind) << kind(self.levels - 1 - level)
            ids = back
        return ids


class Shard:
    """One file: header, document table, planes. Each part is compressed by itself."""

    HEAD = struct.Struct("<4sBBxxQQ")

    def __init__(self, blob: bytes):
        magic, self.levels, self.width, self.n, self.docs = self.HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        parts = 3 + 2 * self.levels
        sizes = struct.unpack_from(f"<{parts}Q", blob, self.HEAD.size)
        at = self.HEAD.size + 8 * parts
        self._parts = []
        for s in sizes:
            self._parts.append(blob[at : at + s])
            at += s

    def _part(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._parts[i])

    @property
    def doc_ids(self) -> list[int | None]:
        ids, known = np.frombuffer(self._part(0), np.int64), np.frombuffer(self._part(2), np.uint8)
        return [int(i) if k else None for i, k in zip(ids, known, strict=True)]

    @property
    def counts(self) -> np.ndarray:
        return np.frombuffer(self._part(1), np.int64)

    def matrix(self) -> WaveletMatrix:
        planes = [self._part(3 + 2 * i) for i in range(self.levels)]
        ranks = [np.frombuffer(self._part(4 + 2 * i), np.uint32) for i in range(self.levels)]
        return WaveletMatrix(planes, ranks, [self.n - int(r[-1]) for r in ranks], self.n)

    def ids(self) -> np.ndarray:
        return self.matrix().decode(np.uint16 if self.width == 2 else np.uint32)

    @classmethod
    def pack(cls, doc_ids: list[int | None], counts: list[int], ids: np.ndarray, levels: int) -> bytes:
        matrix, z = WaveletMatrix.build(ids, levels), zstandard.ZstdCompressor(level=1)
        parts = [np.array([i or 0 for i in doc_ids], np.int64).tobytes(), np.array(counts, np.int64).tobytes(), np.array([i is not None for i in doc_ids], np.uint8).tobytes()]
        for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
            parts += [plane, ranks.tobytes()]
        parts = [z.compress(p) for p in parts]
        return cls.HEAD.pack(MAGIC, levels, ids.dtype.itemsize, len(ids), len(doc_ids)) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


_SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, file binary"


def _packer(path: str, end_id: int, limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        levels = max(int(code.tokenizer.get_vocab_size() - 1), end_id).bit_length()
        part, seq, docs, counts, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        end = np.array([end_id], code.kind)

        def shut():
            rows = [[part], [seq], [len(docs)], [held], [Shard.pack(docs, counts, np.concatenate(ids), levels)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["part", "seq", "n_docs", "n_ids", "file"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary()), strict=True):
                own = code.encode(text.as_py() or b"")
                docs.append(doc.as_py())
                counts.append(len(own) + 1)
                ids += [own, end]
                held += len(own) + 1
                if held >= limit:
                    yield shut()
                    seq, docs, counts, ids, held = seq + 1, [], [], [], 0
        if docs:
            yield shut()

    return pack


def write_shards(docs: DataFrame, path: str, tokenizer: str = WORD_TOKENIZER, end_id: int = END_ID, shard_ids: int = SHARD_IDS, arranged: bool = False) -> DataFrame:
    """Write docs (doc_id, text) as wavelet shards under `path`; return their table.

    Null texts count as empty; each document ends with end_id. Documents are in
    ascending doc_id order over (part, seq), a null doc_id first; rows that share a
    doc_id are in the order of their texts. With `arranged` they stay in the order of
    docs, partition after partition. Other columns are ignored. A document is never
    split over files.
    """
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text")
    if not arranged:
        ordered = ordered.repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_packer(tokenizer, end_id, shard_ids), _SHARD_SCHEMA).write.option("compression", "uncompressed").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(_SHARD_SCHEMA).parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.column("file")[i].as_py())
            ids, counts, docs = shard.ids().astype("<u4"), shard.counts, shard.doc_ids
            ends = np.cumsum(counts)
            raw = memoryview(ids).cast("B")
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int32)) for c in ("part", "seq")]
                + [pa.array(docs, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_index(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, part, seq.

    Starts add three sums: ids of earlier partitions (one row a partition), of the
    partition's earlier files, of the file's earlier documents.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("file_start"))
    starts = files.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("file_start")).alias("shard_start"))
    rows = shards.mapInArrow(_unpack, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def encode_corpus(docs: DataFrame, tokenizer: str = WORD_TOKENIZER, end_id: int = END_ID, arranged: bool = False) -> DataFrame:
    """Write docs to wavelet shards in the shared folder and return the index read from them.

    An empty table gives no files and no rows.
    """
    return read_index(write_shards(docs, common.new_path(docs.sparkSession, "wavelet"), tokenizer, end_id, arranged=arranged))
