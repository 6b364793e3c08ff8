"""Groups of near copies, hubs and hot keys at small size; registers, bitmaps and components against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa

from codicil.llm import common, components, near_dedup


def _family(n: int, seed: int, words: int = 120) -> list[tuple[int, str]]:
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(r.randrange(0, 9)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(own[: r.randrange(80, words + 1)])))
    return out


def test_a_family_of_near_copies(spark):
    rows = _family(150, 1) + [(1000 + i, t) for i, t in _family(60, 2)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.op3(rows))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(205, 203), (203, 209)]
    got = {r["id"]: r["label"] for r in components.connected(spark.createDataFrame([(a, b) for a, b in links], "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {203: 203, 205: 203, 209: 203}
    assert got == want


def _sets(texts):
    return near_dedup.shingle_sets(*common.text_bytes(pa.array(texts)))


def test_registers_estimate_similarity_and_merge():
    a, b = " ".join(f"t{i}" for i in range(1000)), " ".join(f"t{i}" for i in range(150, 1150))
    x, bounds = _sets([a, b, a + " " + b])
    regs = near_dedup.registers(x, bounds).astype(int)
    n = np.diff(bounds)
    found = near_dedup.similarity(regs[:1], regs[1:2], n[:1], n[1:2])[0]
    assert abs(found - 846 / 1146) < 0.2
    union = np.unique(np.concatenate([x[: bounds[1]], x[bounds[1] : bounds[2]]]))
    whole = near_dedup.registers(union, np.array([0, len(union)]))[0]
    # registers that both sets filled at all are those of the union
    assert (near_dedup.merge(regs[0], regs[1]) == whole).mean() > 0.95


def test_bitmaps_never_exceed_the_difference():
    texts = [t for _, t in _family(40, 3)]
    x, bounds = _sets(texts)
    wide = near_dedup.odd_sketch(x, bounds, 64)
    sets = [set(x[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]
    for i in range(0, 40, 3):
        for j in range(40):
            assert int(np.bitwise_count(wide[i] ^ wide[j]).sum()) <= len(sets[i] ^ sets[j])
