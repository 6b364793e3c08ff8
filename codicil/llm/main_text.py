"""Main text of web pages: boosted trees over the features of a page's nodes, decoded from the top down.

A node is kept if text of the article is in it. Trees score each node by its subtree, names, depth, neighbours and
parent; of all labellings in which nothing is kept below a dropped node, the likeliest is taken, so that choices about
an element and its parts can't contradict each other.

The trees are fitted on the driver to a bounded sample: texts of at most SAMPLE pages (of at most SAMPLE_CHARS
characters each, the smallest hashes of their html) in LAYOUTS drawn layouts, and those pages themselves where
elements that say what they are (article, main, nav, footer ...) label them. Tables without such pages teach layouts
with invented words.

Defined cases. Null html is empty, and an empty page or one without main text has an empty text. Pages are judged one
by one: rows that repeat give the same text. Pages of any length and depth are read whole; elements over 500 deep are
siblings. Only page_id, url and html are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosted, page_layouts
from .common import slices
from .html_nodes import COUNTS, Nodes, Tree, assemble, features, read

SAMPLE = 120
SAMPLE_CHARS = 40_000
LAYOUTS = 500
SEED = 13
#: Occurrences of a name before it counts.
KNOWN = 4
#: Bytes of html that are read together.
TOGETHER = 2 << 20

# Fixed values of HTML: elements that say what they are.
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav footer aside form dialog menu".split())
OTHER_NAMES = frozenset("ad ads advert nav menu footer sidebar comment comments cookie notice share related".split())


@dataclass(frozen=True)
class Model:
    trees: boosted.Trees
    tags: dict[str, float]
    tokens: dict[str, float]


def _marked(nodes: Nodes) -> np.ndarray:
    """Which runs of text are main, by their marks."""
    out = np.zeros(len(nodes.page), bool)
    for node, _, value in nodes.texts:
        out[node] |= page_layouts.MARK in value
    return out


def _said(nodes: Nodes) -> np.ndarray:
    """Which runs of text are main, by elements that say so."""
    state = np.zeros(len(nodes.page), np.int8)  # 1 in an article, 2 in something else
    for i, (p, t, names) in enumerate(zip(nodes.parent, nodes.tag, nodes.tokens, strict=True)):
        state[i] = 2 if (p >= 0 and state[p] == 2) or t in OTHER_TAGS or not OTHER_NAMES.isdisjoint(names) else 1 if t in MAIN_TAGS or p >= 0 and state[p] == 1 else 0
    return (state == 1) & (np.array(nodes.tag) == "#text")


def _log_odds(pairs: list[tuple[str, bool]], least: int) -> dict[str, float]:
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for name, label in pairs:
        seen[name][label] += 1
    return {k: float(np.log((b + 1) / (a + 1))) for k, (a, b) in sorted(seen.items()) if a + b >= least}


def paragraphs(sources: list[str]) -> list[str]:
    """Texts of sampled pages' articles, block by block."""
    nodes = Nodes()
    for i, s in enumerate(sources):
        read(i, s, nodes)
    return [b for t in assemble(nodes, _said(nodes), len(sources)) for b in t.split("\n\n") if b]


def fit_sources(sources: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Model:
    """A model from sampled pages."""
    nodes = Nodes()
    drawn = page_layouts.pages(paragraphs(sources), layouts, seed)
    for i, s in enumerate(drawn):
        read(i, s, nodes)
    split = len(nodes.page)
    for i, s in enumerate(sources):
        read(layouts + i, s.replace(page_layouts.MARK, ""), nodes)
    main = _marked(nodes)
    main[split:] = _said(nodes)[split:]
    tree = Tree(nodes)
    own = np.array(nodes.counts, float)[:, COUNTS.index("chars")]
    y = tree.up(np.where(main, 1.0, 0.0)) > 0
    # Sampled pages in which nothing says what it is teach nothing.
    whole = np.zeros(layouts + len(sources), bool)
    whole[np.array(nodes.page)[y]] = True
    used = whole[np.array(nodes.page)] & (tree.parent >= 0) & (tree.up(own) > 0)
    pick = np.flatnonzero(used)
    tags = _log_odds([(nodes.tag[i], bool(y[i])) for i in pick if nodes.tag[i] != "#text"], 1)
    tokens = _log_odds([(t, bool(y[i])) for i in pick for t in nodes.tokens[i]], KNOWN)
    x = features(nodes, tree, tags, tokens)
    return Model(boosted.fit(x[pick], y[pick].astype(float), np.log1p(tree.up(own))[pick]), tags, tokens)


def fit(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS, seed: int = SEED) -> Model:
    short = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64("html").alias("h")).where(F.length("html").between(1, SAMPLE_CHARS))
    # Hashes first, so that no task sends pages that are not taken; copies of a page count once.
    least = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = short.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if least else []
    return fit_sources([r["html"] for r in rows], layouts, seed)


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    nodes = Nodes()
    for i, s in enumerate(sources):
        read(i, s or "", nodes)
    tree = Tree(nodes)
    kept = tree.decode(np.where(tree.parent < 0, 0.0, model.trees.logits(features(nodes, tree, model.tags, model.tokens))))
    return assemble(nodes, kept, len(sources))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    model = model or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", TOGETHER):
                texts = main_texts(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind['page_id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string, n_chars long")
