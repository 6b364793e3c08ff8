"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer (words and word beginnings) turns a sentence into symbols:
insult, threat, target, negation, report, clause end, quotation mark. Three small
transducers read the symbols: one marks insults within the reach of a negation, one
those in reported speech, with its verb before it or after, one those that a target
stands by. The four are composed; running them over a sentence gives its events, and
weights learned from labels turn a document's events into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a fit reads at most, taken by a hash of their ids.
FIT_ROWS = 8_000
THRESHOLD = 0.7
#: Probability that any entry of the lexicon is there by chance.
CHANCE = 0.1
_STEMS = range(3, 9)

# Closed-class words of the grammar, English, German, French and Spanish.
TARGETS = frozenset("you your yours u ur they them she he these those du dich dir ihr euch dein sie er tu te toi vous ton votre il elle ils elles tú usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not no never isn't aren't don't nobody neither nor nicht kein keine keinen nie niemals ne pas jamais aucun aucune sin nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say called calls quoted wrote claims claimed reported reportedly sagte sagt nannte schrieb behauptet dit disait appelé écrit affirme dijo dice llamó escribió afirma".split())
THREATS = frozenset("kill murder hurt destroy beat shoot stab strangle töten umbringen ermorden verletzen tuer assassiner frapper détruire matar asesinar golpear destruir".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, CLAUSE, QUOTE = SYMBOLS = "ITPNRo,q"
EVENTS = ("insult", "insult_negated", "insult_reported", "insult_targeted", "threat", "threat_targeted", "threat_negated", "threat_reported")
#: Weights before any label is seen; the fit is drawn to them.
PRIOR = (2.0, 0.5, 1.0, 2.5, 0.5, 1.5, 0.1, 0.3)
_NEGATION_REACH = 3
_TARGET_REACH = 4

#: Words that may stand between a quotation or clause and the verb after it that reports it.
_REPORT_REACH = 3

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MARK = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[,;:\"“”„«»]")
#: A sentence ends at these, and at a quotation mark right after one only by what follows it.
_SENTENCE = re.compile(r"[.!?\n]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic transducer: arcs[state, symbol] is the next state and the marks put out."""

    start: object
    arcs: dict[tuple[object, str], tuple[object, tuple[str, ...]]]

    def compose(self, other: Transducer) -> Transducer:
        """Both reading the same symbols side by side, their marks joined."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        symbols = {s for _, s in self.arcs} & {s for _, s in other.arcs}
        while todo:
            a, b = at = todo.pop()
            for s in symbols:
                (x, out), (y, more) = self.arcs[a, s], other.arcs[b, s]
                arcs[at, s] = ((x, y), out + more)
                if (x, y) not in seen:
                    seen.add((x, y))
                    todo.append((x, y))
        return Transducer(start, arcs)

    def run(self, symbols: str) -> Iterator[tuple[str, tuple[str, ...]]]:
        state = self.start
        for s in symbols:
            state, marks = self.arcs[state, s]
            yield s, marks


def _negation() -> Transducer:
    """Reaches a few words on, within the clause."""
    arcs = {}
    for left in range(_NEGATION_REACH + 1):
        for s in SYMBOLS:
            after = _NEGATION_REACH if s == NEGATION else 0 if s == CLAUSE else max(0, left - (s != QUOTE))
            arcs[left, s] = (after, ("negated",) if left and s in "IT" else ())
    return Transducer(0, arcs)


def _report() -> Transducer:
    """Reported speech: the rest of a clause after the verb, a quotation or clause that the verb introduces, and those that it follows.

    States: (quoted, reported, reach). `reach` is what is left of the words in which a
    verb after a quotation or clause reports it, or, right after a verb, -1. A mark
    "kept" ends what a verb may still report, "late" reports it.
    """
    start, arcs = (False, False, 0), {}
    todo, seen = [start], {start}
    while todo:
        at = todo.pop()
        quoted, reported, reach = at
        for s in SYMBOLS:
            marks: tuple[str, ...] = ()
            if s == QUOTE:
                # Opening takes the verb's report with it; closing leaves room for a verb.
                after = (not quoted, reported and not quoted, 0 if not quoted or reported else _REPORT_REACH)
                marks = () if quoted else ("kept",)
            elif s == CLAUSE and quoted:
                after = at
            elif s == CLAUSE:
                # Right after the verb what it reports begins; else a verb may come.
                after = (False, reach == -1, 0 if reach == -1 else _REPORT_REACH)
            elif s == REPORT and not quoted:
                marks = ("late",) if reach > 0 else ()
                after = (False, True, -1)
            elif s in "IT" and not quoted and reach > 0:
                marks, after = ("kept",), (False, reported, 0)
            else:
                after = (quoted, reported, reach if quoted else max(0, reach - 1))
            if s in "IT" and reported:
                marks += ("reported",)
            arcs[at, s] = (after, marks)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer(start, arcs)


def _target() -> Transducer:
    """Keeps how far back the last target and the last untargeted insult or threat are, within the clause."""
    start, arcs = (0, "", 0), {}
    for near in range(_TARGET_REACH + 1):
        for wait in ("", "I", "T"):
            for age in range(_TARGET_REACH + 1) if wait else (0,):
                for s in SYMBOLS:
                    marks, n, w, a = (), max(0, near - 1), wait, age - 1 if wait else 0
                    if s == TARGET:
                        marks, n, w, a = ((f"late:{wait}",) if wait else ()), _TARGET_REACH, "", 0
                    elif s in "IT":
                        marks, w, a = (("targeted",), "", 0) if near else ((), s, _TARGET_REACH)
                    elif s == CLAUSE:
                        n, w, a = start
                    elif s == QUOTE:
                        n, w, a = near, wait, age
                    elif wait and a < 0:
                        w, a = "", 0
                    arcs[(near, wait, age), s] = ((n, w, a), marks)
    return Transducer(start, arcs)


GRAMMAR = _negation().compose(_report()).compose(_target())


def clause_events(symbols: str) -> Counter:
    """What the grammar finds in a sentence given as symbols."""
    out: Counter = Counter()
    waiting: list[str] = []  # of the insults and threats that a verb may still report
    for s, marks in GRAMMAR.run(symbols):
        for m in marks:
            if m == "late":
                for name in waiting:
                    out[name] -= 1
                    out[f"{name}_reported"] += 1
            if m in ("late", "kept"):
                waiting = []
            if m.startswith("late:"):
                out["insult_targeted" if m[5:] == INSULT else "threat_targeted"] += 1
        if s in "IT":
            name = "insult" if s == INSULT else "threat"
            if "negated" in marks:
                out[f"{name}_negated"] += 1
            elif "reported" in marks:
                out[f"{name}_reported"] += 1
            else:
                out[name] += 1
                waiting.append(name)
            if "targeted" in marks:
                out[f"{name}_targeted"] += 1
    return out


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    weights: tuple[float, ...] = PRIOR
    strength: float = 0.5

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's symbol and weight."""
        if word in self.words:
            return INSULT, self.words[word]
        for n in _STEMS:
            if len(word) > n and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        for kind, known in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in known:
                return kind, 0.0
        return OTHER, 0.0

    def read(self, sentence: str) -> tuple[str, float]:
        """The lexicon transducer: a sentence's symbols, and the greatest weight met."""
        out, most = [], 0.0
        for mark in _MARK.findall(sentence):
            if not mark[0].isalpha():
                out.append(CLAUSE if mark in ",;:" else QUOTE)
                continue
            symbol, weight = self.symbol(mark)
            out.append(symbol)
            most = max(most, weight)
        return "".join(out), most

    def score(self, events: np.ndarray) -> float:
        x = self.bias + float(np.dot(self.weights, events[:-1])) + self.strength * events[-1]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


class Reader:
    """Finds the sentences of a text that hold an insult or threat and reads them."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.find = model, ahocorasick.Automaton()
        for w in [*model.words, *model.stems, *THREATS]:
            self.find.add_word(w, len(w))
        self.any = len(self.find) > 0
        if self.any:
            self.find.make_automaton()

    def events(self, text: str) -> np.ndarray:
        """log(1 + n) of each event, then the greatest lexicon weight met."""
        out = np.zeros(len(EVENTS) + 1)
        if not text or not self.any:
            return out
        low, total, most, done = text.lower(), Counter(), 0.0, -1
        for end, size in self.find.iter(low):
            if end < done or (end >= size and low[end - size].isalpha()):
                continue
            start = _sentence_start(low, max(0, done), end)
            done = _sentence_end(low, end)
            symbols, weight = self.model.read(low[start:done])
            most = max(most, weight)
            total += clause_events(symbols)
        for i, name in enumerate(EVENTS):
            out[i] = math.log1p(total[name])
        out[-1] = most
        return out


def _sentence_start(text: str, low: int, end: int) -> int:
    return max(low, *(1 + text.rfind(c, low, end) for c in ".!?\n"))


def _sentence_end(text: str, at: int) -> int:
    """A point or mark before a closing quotation mark doesn't end the sentence if a small letter or comma follows."""
    while stop := _SENTENCE.search(text, at):
        at = stop.end()
        if text[at : at + 1] not in ('"', "”", "»") or not (text[at + 1 : at + 2] == "," or text[at + 2 : at + 3].isalpha()):
            return stop.start()
    return len(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word and word beginning, the toxic and other documents of a task that hold it."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in (part for whole in batches for part in common.slices(whole)):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            for key in {f"w{w}" for w in words} | {f"s{w[:n]}" for w in words for n in _STEMS if len(w) > n}:
                counts[key][0 if toxic == 1 else 1] += 1
    items = list(counts.items())
    for i in range(0, len(items), 50_000):
        part = items[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["key", "toxic", "other"])


def _lexicon(rows: list[tuple[str, int, int]], toxic: int, other: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words, and beginnings at the greatest length that keeps their documents; longer ones under a chosen one go."""
    weight = {k: math.log((t + 0.5) / (toxic + 1)) - math.log((o + 0.5) / (other + 1)) for k, t, o in rows}
    count = {k: t for k, t, _ in rows}
    children = defaultdict(list)
    for k in count:
        if k[0] == "s" and len(k) > 1 + _STEMS[0]:
            children[k[:-1]].append(k)
        if k[0] == "w":
            for n in _STEMS:
                if len(k) > 1 + n:
                    children["s" + k[1 : 1 + n]].append(k)
    words, stems = {}, {}
    for key in sorted((k for k in count if k[0] == "s"), key=len):
        if any(key[1:n] in stems for n in range(1 + _STEMS[0], len(key) + 1)) or any(key[1:] == w[: len(key) - 1] for w in words):
            continue
        while True:
            best = max(children[key], key=lambda c: (count[c], c[0] == "w"), default=None)
            if best is None or count[best] < 0.9 * count[key]:
                break
            key = best
            if key[0] == "w":
                break
        (words if key[0] == "w" else stems)[key[1:]] = weight[key]
    for key in count:
        w = key[1:]
        if key[0] == "w" and w not in words and not any(w[:n] in stems for n in _STEMS if len(w) > n):
            words[w] = weight[key]
    return words, stems


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the prior weights."""
    a = np.column_stack([np.ones(len(x)), x])
    prior = np.array([-2.0, *PRIOR, 0.5])
    pull = np.array([0.01, *[0.5] * (len(prior) - 1)])
    beta = prior.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (y - p) - pull * (beta - prior)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _reading(shared):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for whole in batches:
            for batch in common.slices(whole):
                rows = [reader.events(t or "").tolist() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "events"])

    return read


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn lexicon and weights from at most `rows` labelled documents that aren't held out.

    Rows with a null doc_id or label are left out; of labels that share a doc_id any
    toxic one counts. With no labels of both kinds the prior grammar comes back.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = common.save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    n = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model()
    keys = sample.mapInArrow(_features, "key string, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    keys = common.save(keys, "toxic-keys")
    # The chance that as many of a key's documents are toxic, times the keys that could have had it (Bonferroni).
    share, both = n[True] / (n[True] + n[False]), F.col("toxic") + F.col("other")
    odds = F.lit(0.0) + F.col("toxic") * math.log(1 / share) - F.col("other") * F.log(both.cast("double"))
    telling = keys.where((F.col("toxic") >= 9 * F.col("other")) & (odds >= math.log(keys.count() / CHANCE)))
    # In at least log(keys / CHANCE) / log(1 / share) of the sample's toxic documents each: bounded with the sample.
    top = sorted((r["key"], r["toxic"], r["other"]) for r in telling.toLocalIterator())
    words, stems = _lexicon(top, n[True], n[False])
    model = Model(words, stems)
    seen = sample.mapInArrow(_reading(spark.sparkContext.broadcast(model)), "toxic int, events array<double>").groupBy("toxic", "events").count().collect()
    x = np.array([r["events"] for r in seen for _ in range(r["count"])])
    y = np.array([float(r["toxic"] == 1) for r in seen for _ in range(r["count"])])
    beta = _fit(x, y)
    return Model(words, stems, float(beta[0]), tuple(float(b) for b in beta[1:-1]), float(beta[-1]))


def _scorer(shared, columns: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in (part for whole in batches for part in common.slices(whole)):
            events = [reader.events(t or "") for t in batch.column("text").to_pylist()]
            scores = pa.array([reader.model.score(e) for e in events], pa.float64())
            found = [pa.array([round(math.expm1(e[i])) for e in events], pa.int64()) for i in range(len(EVENTS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), scores, *found], [*columns, "score", *EVENTS])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the counts of clause events, a row for each row of docs.

    Null and empty texts have no events and get the score of the bias. A null
    doc_id counts as not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{e} long" for e in EVENTS)
    out = docs.select("doc_id", "text").mapInArrow(_scorer(shared, ["doc_id"]), f"doc_id long, score double, {kinds}")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *EVENTS)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns unchanged, that score below the threshold; one pass, no shuffle."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        at = names.index("text")
        for batch in (part for whole in batches for part in common.slices(whole)):
            ok = [reader.model.score(reader.events(t or "")) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
