"""Token counts that follow edits without encoding a document again.

A document's text is cut into leaves where a run of letters, digits or other signs
ends, which is a pre-token boundary whatever stands around it, in any script. (A run of
thousands of letters without any sign is one pre-token to the tokenizer, and one leaf.) A segment tree holds the sums
of the leaves' characters and tokens. An edit replaces the leaves that it touches
and one leaf on either side, encodes that region only, and updates the sums above.
Trees are kept as columns beside the text, so that a later round of edits encodes
nothing but what it touches.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, pii

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
LEAF = 512
# Characters whose kind (letter, digit, other) is the same in all versions of Unicode that a tokenizer may be built with.
_OLD = r"\x21-\u052F\u0590-\u05F2\u0600-\u06FF\u0900-\u0963\u0E01-\u0E3A\u1E00-\u1FFF\u2010-\u2027\u3001-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\uFF01-\uFF5E"
#: Where a run of letters, of digits or of other signs ends: the tokenizer's pattern ends a pre-token there, whatever stands around. Not after an apostrophe, which may begin a contraction, nor after white space.
_CUT = regex.compile(
    rf"(?<=[{_OLD}--\s])(?=[{_OLD}\s])(?:(?<=\p{{L}})(?!\p{{L}})|(?<=\p{{N}})(?!\p{{N}})|(?<=[^\s\p{{L}}\p{{N}}'])(?=[\s\p{{L}}\p{{N}}]))", regex.V1
)
Edit = tuple[int, int, str]

_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str = BYTE_TOKENIZER, pattern: str = public_tokenizers.PATTERN):
    """The worker's encoder for a rank file, kept between tasks."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def cut(text: str, size: int = LEAF) -> list[str]:
    """Leaves of at least `size` characters, but for the last."""
    out, at = [], 0
    while m := _CUT.search(text, at + size):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at < len(text) else out


class TokenTree:
    """A text with its token count, under edits."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = LEAF):
        self.count, self.size, self.encoded = count, size, 0
        self._build(cut(text, size))

    @classmethod
    def restore(cls, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int], size: int = LEAF) -> TokenTree:
        """The tree that kept() described; nothing is encoded."""
        tree, at, leaves = cls("", count, size), 0, []
        for n in chars:
            leaves.append(text[at : at + n])
            at += n
        tree._build(leaves, tokens)
        return tree

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves with text."""
        own = [i for i, x in enumerate(self.leaves) if x]
        return [len(self.leaves[i]) for i in own], [self.tokens[self.width + i] for i in own]

    def _measure(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return self.count(leaf)

    def _build(self, leaves: list[str], known: list[int] | None = None) -> None:
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.leaves = leaves + [""] * (self.width - len(leaves))
        counts = known or [self._measure(x) for x in leaves]
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (x, n) in enumerate(zip(leaves, counts, strict=True)):
            self.chars[self.width + i], self.tokens[self.width + i] = len(x), n
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, text: str) -> None:
        i = self.width + leaf
        self.leaves[leaf], self.chars[i], self.tokens[i] = text, len(text), self._measure(text) if text else 0
        while i := i // 2:
            self._sum(i)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and its offset there; past the end, the last leaf with text."""
        at = min(at, max(0, self.chars[1] - 1))
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.width, at

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end (clipped to the text)."""
        n = self.chars[1]
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        first, inside = self._leaf(start)
        if start >= n:
            inside = len(self.leaves[first])
        last, _ = self._leaf(max(start, end - 1))
        low, high = first - 1, last + 1
        while low > 0 and not self.leaves[low]:
            low -= 1
        while high < self.width - 1 and not self.leaves[high]:
            high += 1
        low, high = max(0, low), min(self.width - 1, high)
        before = sum(len(x) for x in self.leaves[low:first])
        region = "".join(self.leaves[low : high + 1])
        at = before + inside
        parts = cut(region[:at] + new + region[at + end - start :], self.size)
        room = high - low + 1
        if len(parts) > 4 * room:  # much was put in: a wider tree, of which only the region is encoded
            known = self.tokens[self.width : self.width + low], self.tokens[self.width + high + 1 : 2 * self.width]
            self._build(self.leaves[:low] + parts + self.leaves[high + 1 :], [*known[0], *map(self._measure, parts), *known[1]])
            return
        share = -(-len(parts) // room) if parts else 1
        for i in range(room):
            self._set(low + i, "".join(parts[i * share : (i + 1) * share]))


def mask_entities(text: str) -> list[Edit]:
    """An edit for each e-mail address, IP address, card and phone number; of overlapping ones the first."""
    out: list[Edit] = []
    for s, kind, e in pii.base_spans(text):
        if not out or s >= out[-1][1]:
            out.append((s, e, f"<{pii.KINDS[kind]}>"))
    return out


_TREES = "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"
_EDITED = f"{_TREES}, n_tokens_before long, n_edits long, chars_encoded_again long"
_INTS = pa.list_(pa.int32())


def _counter(path: str) -> Callable[[str], int]:
    code = encoding(path)
    return lambda x: len(code.encode_ordinary(x))


def _grower(path: str, size: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for whole in batches:
            for batch in common.slices(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                trees = [TokenTree(t, count, size) for t in texts]
                kept = list(zip(*(t.kept() for t in trees), strict=True)) or [[], []]
                cols = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([t.total for t in trees], pa.int64()), *(pa.array(list(k), _INTS) for k in kept)]
                yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c) for c in extra)], ["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", *extra])

    return run


def grow_trees(docs: DataFrame, path: str = BYTE_TOKENIZER, size: int = LEAF) -> DataFrame:
    """doc_id, text, n_tokens, leaf_chars, leaf_tokens: the trees of whole texts, a row for each row of docs; no shuffle.

    A null text counts as empty, and an empty one has no leaves. A column `edits` goes
    along, other columns are ignored; an empty table gives no rows.
    """
    extra = [c for c in docs.columns if c == "edits"]
    schema = StructType([*StructType.fromDDL(_TREES).fields, *(docs.schema[c] for c in extra)])
    return docs.select("doc_id", "text", *extra).mapInArrow(_grower(path, size, extra), schema)


def _editor(path: str, propose: Callable[[str], list[Edit]] | None, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for whole in batches:
            for batch in common.slices(whole):
                rows = []
                given = batch.column("edits").to_pylist() if propose is None else [None] * batch.num_rows
                for doc, text, chars, tokens, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "leaf_chars", "leaf_tokens")), given, strict=True):
                    edits = propose(text) if propose else [(e["start"], e["end"], e["text"] or "") for e in own or [] if e and e["start"] is not None and e["end"] is not None]
                    tree = TokenTree.restore(text, chars, tokens, count, size)
                    before = tree.total
                    for start, end, new in sorted(edits, reverse=True):
                        tree.edit(start, end, new)
                    rows.append((doc, tree.text, tree.total, *tree.kept(), before, len(edits), tree.encoded))
                names = [f.split()[0] for f in _EDITED.split(", ")]
                kinds = [pa.int64(), pa.string(), pa.int64(), _INTS, _INTS, pa.int64(), pa.int64(), pa.int64()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def edit_trees(trees: DataFrame, propose: Callable[[str], list[Edit]] | None = None, path: str = BYTE_TOKENIZER, size: int = LEAF) -> DataFrame:
    """Trees after edits, with the columns of grow_trees and n_tokens_before, n_edits, chars_encoded_again; no shuffle.

    Edits are proposed by a function of the text or, without one, come from a column
    `edits` of structs (start, end, text), in code points of the text, not
    overlapping. Positions past the text's end are clipped to it; edits with a null
    position are left out. Only leaves that an edit touches, and their neighbours, are
    encoded, so the result can be edited again at the cost of the new edits.
    """
    columns = ["doc_id", "text", "leaf_chars", "leaf_tokens"]
    return trees.select(*columns, *([] if propose else ["edits"])).mapInArrow(_editor(path, propose, size), _EDITED)


def recount(docs: DataFrame, propose: Callable[[str], list[Edit]] | None = None, path: str = BYTE_TOKENIZER, size: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, chars_encoded_again, edited_sha256, a row for each row of docs.

    Trees are grown and written to the shared folder, and the edits follow them (see
    edit_trees). A null text counts as empty; rows that share a doc_id are each
    counted; other columns are ignored.
    """
    trees = common.save(grow_trees(docs.select("doc_id", "text", *([] if propose else ["edits"])), path, size), "trees")
    after = edit_trees(trees, propose, path, size)
    return after.select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), F.char_length("text").cast("long").alias("n_chars_after"), "chars_encoded_again", F.sha2(F.encode("text", "UTF-8"), 256).alias("edited_sha256")
    )
