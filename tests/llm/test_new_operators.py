"""Clusters, phrases and main texts against brute force: on awkward rows, on small tables, and on drawn pages."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codicil.llm import boosted, collocations, html_nodes, main_text, page_layouts, queries, yinyang
from codicil.llm.common import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(got, want):
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want)


# --- clusters


def brute_clusters(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    wide = [i for i, v in kept if any(abs(x) >= 1 << 28 for x in v)]
    kept = [(i, v) for i, v in kept if not any(abs(x) >= 1 << 28 for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), q in zip(kept, of, strict=True) if q == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    final = [(i, *near(v)) for i, v in kept]
    total, per = sum(f[1] for f in final), Counter()
    for _, d, j in final:
        per[j] += d
    if not c:
        return [(i, None, None, None, None, None) for i in wide]
    return [(i, j, d, per[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in final] + [(i, None, None, None, None, None) for i in wide]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return df.selectExpr("vec_id", "embedding", "1 AS v", "'c' AS cluster", "2.0D AS upper", "3L AS distance", "4 AS label")


def test_clusters_of_the_smallest_table(spark, sf_dir):
    rows = [(r[0], r[1]) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    same(queries.op11_yinyang_clusters(spark, sf_dir).collect(), brute_clusters(rows, 40, 5, 64))


@pytest.mark.parametrize("seed", range(3))
def test_clusters_with_ties_repeats_and_faulty_vectors(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.randint(-2, 2) / 4 for _ in range(3)]) for i in range(150)]  # many equal distances
    rows += [(7, rows[7][1]), (7, rows[7][1]), (7, [0.0, 0.0, 0.5]), (None, [0.25, 0.0, -0.25])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, math.nan, 2.0]), (905, [math.inf, 0.0, 0.0]), (906, [1e300, 0.0, 0.0])]
    same(yinyang.cluster(vectors(spark, rows), k=25, rounds=4, dimensions=3).collect(), brute_clusters(rows, 25, 4, 3))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 1.5]), (2, [0.5, 1.5]), (3, [-4.0, 2.0])]
    same(yinyang.cluster(vectors(spark, rows), k=5, rounds=2, dimensions=2).collect(), brute_clusters(rows, 5, 2, 2))
    assert yinyang.cluster(vectors(spark, []), dimensions=2).collect() == []
    same(yinyang.cluster(vectors(spark, [(1, [1e9, 0.0])]), dimensions=2).collect(), [(1, None, None, None, None, None)])


def test_bounds_spare_most_looks_and_change_nothing():
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (30, 8))
    v = np.concatenate([c + r.integers(-60, 60, (100, 8)) for c in centres])
    c = v[:: len(v) // 30][:30].astype(np.int64)
    groups = yinyang.group_centroids(c, 5)
    cluster, upper, lower, _ = yinyang.scan_all(v, c, groups)
    for _ in range(4):
        after = np.array([v[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(len(c))])
        moved, c = np.sqrt(((after - c) ** 2.0).sum(1)), after
        cluster, upper, lower = yinyang.scan_some(v, cluster, upper, lower, c, groups, moved)
        d = yinyang.squared(v, c)
        assert (cluster == d.argmin(1)).all()
        roots = np.sqrt(d.astype(float))
        assert (upper >= roots[np.arange(len(v)), cluster]).all()
        roots[np.arange(len(v)), cluster] = np.inf
        assert (lower <= np.stack([roots[:, groups == g].min(1) for g in range(groups.max() + 1)], 1)).all()
    assert (lower.min(1) > upper).mean() > 0.8


def test_wide_components_are_exact():
    v = np.array([[(1 << 28) - 1, 5], [-(1 << 28) + 1, 6]], np.int64)
    assert yinyang.squared(v, v).tolist() == [[0, (2 * ((1 << 28) - 1)) ** 2 + 1], [(2 * ((1 << 28) - 1)) ** 2 + 1, 0]]


# --- phrases


def brute_phrases(docs, least, top=2000, longest=5):
    counts = {}
    for text, lang in docs:
        g = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    g[tuple(w[i : i + k])] += 1
    out = []
    for lang, g in counts.items():
        n = sum(v for p, v in g.items() if len(p) == 1)
        found = {p: v for p, v in g.items() if len(p) > 1 and v >= least}
        gone = {p[i:j] for p, v in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * v >= 100 * g[p[i:j]]}
        rows = []
        for p, v in found.items():
            if p not in gone:
                score, k = min((1000 * v * n // (g[p[:k]] * g[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -v, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        out += [(lang, i + 1, p.decode(), -v, left, right, n, -s) for i, (s, v, p, left, right) in enumerate(sorted(rows)[:top])]
    return out


AWKWARD = (
    [("a b a b a b", "en"), (None, "en"), ("", None), ("A\tB  c, d e. f g\x0bh i\x0cj k\r\nl m", None), ("  ,;:!?  ", "fr"), ("été   x\x1cy été   x\x1cy", "fr"), ("a a a a a a a", "de")]
    + [("the quick brown fox jumps over it; the quick brown fox", "en")] * 4
    + [("Red Hot. red hot red hot", "en"), ("word" * 5000 + " long long", "en"), ("b " * 3000, "de"), ("x y", "und"), ("x y", None)]
)


@pytest.mark.parametrize("names", [2_000_000, 0])
def test_phrases_of_awkward_rows(spark, names):
    docs = spark.createDataFrame(AWKWARD, "text string, lang string").repartition(3).selectExpr("text", "lang", "1 AS id", "'w' AS word", "2L AS n", "3 AS doc_id")
    same(collocations.mine(docs, least=2, names=names).collect(), brute_phrases(AWKWARD, 2))
    same(collocations.mine(docs, least=2, top=3, names=names).collect(), brute_phrases(AWKWARD, 2, 3))


def test_phrases_of_a_table_by_both_joins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = brute_phrases([(r[0], r[1]) for r in docs.select("text", "lang").collect()], 12)
    assert len(want) > 100
    for names in (2_000_000, 0):
        same(collocations.mine(docs, least=12, names=names).collect(), want)


def test_phrases_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).collect() == []


def test_pairs_are_summed_alike_for_large_numbers():
    a, b = np.array([5, 1, 5, 1, 5]), np.array([2, 2, 2, 3, 2])
    for shift in (0, 1 << 40):
        x, y, n = collocations._summed(a + shift, b + shift, np.ones(5, np.int64))
        assert list(zip((x - shift).tolist(), (y - shift).tolist(), n.tolist(), strict=True)) == [(1, 2, 1), (1, 3, 1), (5, 2, 3)]


def test_collapse_keeps_one_gap():
    assert collocations._collapse(np.array([-1, -1, 3, -1, -1, 4, 5, -1])).tolist() in ([3, -1, 4, 5], [-1, 3, -1, 4, 5, -1], [3, -1, 4, 5, -1])


# --- main text


def article(source):
    """Blocks of the one article of the tables' pages."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)
    blocks = re.split(r"</?(?:p|h\d)[^>]*>", inner[1] if inner else "")
    return "\n\n".join(b for b in (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in blocks) if b)


def test_main_text_of_the_smallest_table(spark, sf_dir):
    want = [(r["page_id"], r["url"], article(r["html"] or "")) for r in table(spark, sf_dir, "pages").collect()]
    same(queries.op13_main_text(spark, sf_dir).collect(), [(*w, len(w[2])) for w in want])


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return main_text.fit(table(spark, sf_dir, "pages"))


def test_held_out_layouts(spark, sf_dir, model):
    texts = main_text.paragraphs([r["html"] for r in table(spark, sf_dir, "pages").orderBy("page_id").collect()])
    drawn = page_layouts.pages(texts, 300, 4711)
    nodes = html_nodes.Nodes()
    for i, s in enumerate(drawn):
        html_nodes.read(i, s, nodes)
    want = [t.replace(page_layouts.MARK, "") for t in html_nodes.assemble(nodes, main_text._marked(nodes), len(drawn))]
    got = main_text.main_texts([s.replace(page_layouts.MARK, "") for s in drawn], model)
    lost = sum(sum((Counter(w.split()) - Counter(g.split())).values()) for g, w in zip(got, want, strict=True))
    more = sum(sum((Counter(g.split()) - Counter(w.split())).values()) for g, w in zip(got, want, strict=True))
    words = sum(len(w.split()) for w in want)
    assert lost / words < 0.01 and more / words < 0.01


PROSE = "It was late when the first of the boats came in, and nobody on the quay had expected it. They stood there, quietly, until the lamps were lit."


def test_a_page_written_by_hand(model):
    page = f"""<html><head><title>Quay</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
    <div class="cookie-notice"><p>We use cookies to make this better for you.</p><button>Yes</button></div>
    <div id="menu"><ul><li><a href="/a">Home</a><li><a href="/b">News</a><li><a href="/c">About</a></ul></div>
    <div class="post-content"><h1>At the quay</h1><p>{PROSE}<p>Second &amp; last:&nbsp;{PROSE} <a href="/l">{PROSE[:20]}</a><div class="ad">Buy lamps now</div><p>{PROSE}</div>
    <div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten lamps</a></ul></div>
    <section id="comments"><div class="comment"><p>I was there too, and it was just like this.</p></div></section>
    <form action="/s"><label>Search</label><input></form><footer>&copy; The Quay</footer></body></html>"""
    assert main_text.main_texts([page], model) == ["\n\n".join(["At the quay", PROSE, f"Second & last: {PROSE} {PROSE[:20]}", PROSE])]


def test_awkward_pages(spark, model):
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000
    many = "<p><b>" * 20_000
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "no markup"), (5, "<"), (6, "<p"), (7, "<!-- never closed <p>x</p>"), (8, "<script>var x = 1"), (9, '<a href="x>' * 3000), (10, deep), (11, many), (None, "<article><p>" + PROSE)]
    rows += [(12, "<article>" + f"<p>{PROSE}</p>" * 3000 + "</article>")] * 2
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "'u' AS url", "html", "'t' AS text", "1 AS n_chars", "2 AS page").repartition(2)
    got = {(r["page_id"], r["text"]) for r in main_text.extract(df, model).collect()}
    assert {t for i, t in got if i in (1, 2, 3)} == {""}
    assert (None, PROSE) in got
    assert (12, "\n\n".join([PROSE] * 3000)) in got
    assert main_text.extract(df, model).count() == len(rows)
    assert main_text.extract(df.limit(0)).collect() == []


def test_layouts_alone_teach_where_pages_say_nothing(spark):
    empty = spark.createDataFrame([(1, "u", "<div>x</div>")], "page_id long, url string, html string")
    learned = main_text.fit(empty, layouts=150)
    assert main_text.main_texts([f"<nav><a href='/'>Home</a></nav><article><p>{PROSE}</p><p>{PROSE}</p></article><footer>Copyright</footer>"], learned) == [f"{PROSE}\n\n{PROSE}"]


def test_reader_follows_open_ends():
    def blocks(source):
        nodes = html_nodes.Nodes()
        html_nodes.read(0, source, nodes)
        return html_nodes.assemble(nodes, np.ones(len(nodes.page), bool), 1)[0].split("\n\n")

    assert blocks("<p>a<b>b<br>c<p>d</b>e") == ["ab c", "de"]
    assert blocks("<ul><li>a<ul><li>b</ul><li>c</ul>d") == ["a", "b", "c", "d"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a b", "c"]
    assert blocks("a<!-- <p> -->b<!-->c<? x ?>d</ e>f") == ["abcdf"]
    assert blocks("<TITLE>t</TITLE>x &lt;b&gt; &amp;amp; &eacute; &#x41;&nosuch;") == ["x <b> &amp; é A&nosuch;"]
    assert blocks("<p title='a>b' data-x=don't>one</p><textarea><p>no</textarea>two<style>p{}</style>") == ["one", "two"]
    assert blocks("<dl><dt>t<dd>d<dt>u</dl><h2>h</h2>x<hr>y") == ["t", "d", "u", "h", "x", "y"]


def test_no_node_is_kept_below_a_dropped_one_and_none_does_better():
    r = np.random.default_rng(3)
    for _ in range(30):
        nodes = html_nodes.Nodes()
        for i in range(9):
            nodes.new(0, int(r.integers(-1 if not i else 0, max(i, 1))) if i else -1, "div", ())
        tree, logits = html_nodes.Tree(nodes), r.normal(0, 1, 9)
        best = -np.inf
        for bits in range(512):
            y = (bits >> np.arange(9)) & 1
            if all(y[p] >= y[i] for i, p in enumerate(nodes.parent) if p >= 0):
                best = max(best, float((y * logits).sum()))
        kept = tree.decode(logits)
        assert all(kept[p] >= kept[i] for i, p in enumerate(nodes.parent) if p >= 0)
        assert abs(float((kept * logits).sum()) - best) < 1e-9


def test_trees_learn_what_no_single_feature_says():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosted.fit(x[:2000], y[:2000], np.ones(2000), trees=30, depth=3)
    assert ((trees.logits(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.93
