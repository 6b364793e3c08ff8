"""Personal data: patterns, and terms that by corpus statistics give the found entities away.

Patterns find the protected entities, and the information that a token's characters
carry finds secrets. The words of a document that holds an entity
are candidate terms. Over the corpus, counted in whole documents, a term's pointwise mutual information with the entity,
divided by the entity's information content, says what share of the entity the
term discloses: PMI(t; e) / IC(e) = log(N n_te / n_t n_e) / log(N / n_e). Terms at
or over a threshold are spans too wherever they stand, with the entity or without; text is sanitised by generalising what has a
class (a number, an upper-case name) and removing the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textscan

KINDS = ("email", "ip", "card", "phone", "term", "secret")
TERM, SECRET = 4, 5
DISCLOSURE = 0.9
#: Bits of information for each character from which a long token of letters and digits is a secret.
SECRET_BITS = 3.0
#: Documents in which a term must stand with the entity for its estimate to count.
SUPPORT = 2
_BITS = 22

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
_WORD = re.compile(r"[^ \t-\r]+")
#: ASCII but letters, digits and the underscore, at either end of a word.
_EDGES = re.compile(r"^[\x00-/:-@\[-^`{-\x7f]+|[\x00-/:-@\[-^`{-\x7f]+$")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the patterns' matches, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def secrets(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Long tokens of letters and digits, such as keys, whose characters carry much information each, outside the base spans (start, kind, end)."""
    out, i, reach = [], 0, 0
    for m in _SECRET.finditer(text):
        token = m[0]
        if not (_DIGIT.search(token) and any(c.isalpha() for c in token)):
            continue
        counts = Counter(token).values()
        if sum(n * math.log2(len(token) / n) for n in counts) < SECRET_BITS * len(token):
            continue
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start():
            out.append((m.start(), SECRET, m.end()))
    return out


def _term(word: str) -> str:
    return _EDGES.sub("", word.lower())


def _outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that share no character with the spans, which are in order."""
    i, covered = 0, 0
    for m in _WORD.finditer(text):
        word = m[0]
        term = _term(word)
        if not term or len(word.lower()) != len(word):
            continue
        a = m.start() + word.lower().find(term)
        b = a + len(term)
        while i < len(spans) and spans[i][0] < b:
            covered = max(covered, spans[i][2])
            i += 1
        # A span that begins before b and ends after a; words come in order.
        if covered <= a:
            yield term, a, b


def term_hash(terms: list[str]) -> np.ndarray:
    data = "\n".join(terms).encode()
    buf = np.frombuffer(data, np.uint8)
    lengths = np.array([len(t.encode()) for t in terms], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    return textscan.word_hashes(buf, ends - lengths, ends, False) if terms else np.empty(0, np.uint64)


_FOUND = "doc_id long, row string, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:long,kind:int,end:long>>, secrets array<struct<start:long,kind:int,end:long>>, entities array<string>, terms array<struct<h:long,term:string>>"


def _row() -> Column:
    """Tells rows apart by doc_id and text; null for a null text, which has no spans."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.col("text")), 256)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    words = pa.list_(pa.struct([("h", pa.int64()), ("term", pa.string())]))
    for whole in batches:
        for batch in common.slices(whole):
            counts, base, hidden, entities, terms = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text) if text else []
                own = sorted({t for t, _, _ in _outside(text, spans)}) if spans else []
                hashes = textscan.signed(term_hash(own)).tolist() if own else []
                counts.append([sum(k == i for _, k, _ in spans) for i in range(4)])
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                hidden.append([{"start": s, "kind": k, "end": e} for s, k, e in secrets(text, spans)] if text else [])
                entities.append(sorted({f"{KINDS[k]}:{text[s:e].lower()}" for s, k, e in spans}))
                terms.append([{"h": h, "term": t} for h, t in zip(hashes, own, strict=True)])
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(n[:, i]) for i in range(4)), pa.array(base, span), pa.array(hidden, span), pa.array(entities, pa.list_(pa.string())), pa.array(terms, words)], ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base", "secrets", "entities", "terms"])


def _marker(bitmap, bits: int):
    """Places, outside all entities, of the words whose hashes are in the bitmap: row, term, start, end."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for whole in batches:
            for batch in common.slices(whole):
                texts = batch.column("text").to_pylist()
                data, starts, ends, h, row = _hashed(texts)
                some = np.flatnonzero(seen[h >> textscan.U(64 - bits)])
                wanted: dict[int, set[str]] = {}
                for i in some.tolist():
                    wanted.setdefault(int(row[i]), set()).add(bytes(data[starts[i] : ends[i]]).decode())
                rows, out = batch.column("row").to_pylist(), []
                for r, own in wanted.items():
                    out += [(rows[r], *place) for place in _outside(texts[r], base_spans(texts[r])) if place[0] in own]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["row", "term", "start", "end"])

    return mark


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes of texts, and start, end, hash and row of each word without the punctuation at its ends."""
    data, offsets = common.text_bytes(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    starts, ends, bounds = textscan.words(data, offsets, textscan.SPACE)
    starts, ends = _trim(data, starts, ends)
    return data, starts, ends, textscan.word_hashes(data, starts, ends, False), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _frequencies(bitmap, bits: int):
    """Documents that hold each candidate term, over the texts of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        held, keys, sums = 0, [], []

        def merged():
            h, at = np.unique(np.concatenate(keys), return_inverse=True)
            return h, np.bincount(at, np.concatenate(sums)).astype(np.int64)

        for whole in batches:
            for batch in common.slices(whole):
                _, _, _, h, row = _hashed(batch.column("text").to_pylist())
                some = np.flatnonzero(seen[h >> textscan.U(64 - bits)])
                order = some[np.lexsort((row[some], h[some]))]
                h, row = h[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                u, n = np.unique(h[first], return_counts=True)
                keys.append(u)
                sums.append(n)
                held += len(u)
                if held > 2_000_000:
                    h, n = merged()
                    keys, sums, held = [h], [n], 0
        if keys:
            h, n = merged()
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(textscan.signed(h[i : i + 100_000])), pa.array(n[i : i + 100_000])], ["h", "n_t"])

    return count


_EDGE = np.ones(256, bool)
_EDGE[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at their ends (an all-punctuation word comes out empty)."""
    if not len(starts):
        return starts, ends
    edge = _EDGE[data]
    place = np.arange(len(data))
    right = np.maximum.accumulate(np.where(edge, -1, place))
    left = np.minimum.accumulate(np.where(edge, len(data), place)[::-1])[::-1]
    s, e = left[starts], right[ends - 1] + 1
    empty = (s >= ends) | (e <= starts)
    return np.where(empty, starts, s), np.where(empty, starts, e)


def _bitmap(terms: DataFrame) -> tuple[bytes, int]:
    """Filter of the terms' hashes, put together by bitwise or on the executors, and the bits of a hash that it takes."""
    bits = min(26, max(_BITS, terms.count().bit_length() + 4))
    place = F.expr(f"shiftrightunsigned(h, {64 - bits})")
    words = terms.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 AS int))").alias("b"))
    out = np.zeros((1 << bits) // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r["w"]] = r["b"]
    return out.tobytes(), bits


def disclosing_terms(found: DataFrame, docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """entity, term, h, n_te, n_t, n_e, disclosure, of pairs at or over the threshold, from counts over whole documents.

    n_te is n_e at most, so a term in more than n_e (N / n_e) ^ (1 - threshold) documents
    can't reach the threshold; pairs are formed of the others only.
    """
    total = found.count()
    each = found.where("size(base) > 0").select("uid", F.explode("entities").alias("entity"))
    entities = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support)
    entities = common.save(entities.withColumn("most", F.col("n_e") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1.0 - threshold)) * (1 + 1e-9)), "pii-entities")
    mine = common.save(common.join_small(each, entities, "entity", "inner"), "pii-held")
    words = found.where("size(terms) > 0").select("uid", "terms").join(mine.select("uid").distinct(), "uid", "left_semi").select("uid", F.explode("terms").alias("c")).select("uid", "c.h", "c.term")
    words = common.save(words, "pii-words")
    bitmap, bits = _bitmap(words.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("h"))
    terms = docs.select("text").mapInArrow(_frequencies(docs.sparkSession.sparkContext.broadcast(bitmap), bits), "h long, n_t long").groupBy("h").agg(F.sum("n_t").alias("n_t"))
    most = entities.agg(F.max("most")).first()[0] or 0.0
    rare = common.save(terms.where((F.col("n_t") >= support) & (F.col("n_t") <= most)), "pii-terms")
    pairs = common.join_small(words, rare, "h", "inner").join(mine, "uid").where(F.col("n_t") <= F.col("most"))
    scored = pairs.groupBy("entity", "term", "h", "n_t", "n_e").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    n, content = F.lit(float(total)), F.log2(F.lit(float(total)) / F.col("n_e"))
    n_t = F.greatest("n_t", "n_te")
    share = F.when(content > 0, F.log2(n * F.col("n_te") / (n_t * F.col("n_e"))) / content).otherwise(0.0)
    return scored.withColumn("disclosure", share).where(F.col("disclosure") >= threshold).select("entity", "term", "h", "n_te", "n_t", "n_e", "disclosure")


def _joined(spans: str) -> str:
    kinds = ",".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform(array_sort({spans}), s -> concat(element_at(array({kinds}), s.kind + 1), ':', s.start, ':', s.end)))"


def detect(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, n_private (all but terms), base_sha256, base, spans, span_list.

    Spans are kind:start:end in code points. Null texts have none. Rows that are the
    same in doc_id and text have the same spans; an empty table gives no rows. A
    term must be lower-cased without changing its length to be a span.
    """
    return _detect(docs, threshold, support).drop("row")


def _detect(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """What detect() gives, and `row`."""
    docs = docs.select("doc_id", _row().alias("row"), "text")
    found = common.save(docs.mapInArrow(_find, _FOUND).withColumn("uid", F.monotonically_increasing_id()), "pii-base")
    told = common.save(disclosing_terms(found, docs, threshold, support).select("term", "h").distinct(), "pii-told")
    bitmap, bits = _bitmap(told.select("h"))
    places = docs.select("row", "text").mapInArrow(_marker(docs.sparkSession.sparkContext.broadcast(bitmap), bits), "row string, term string, start long, end long")
    places = common.join_small(places, told.select("term"), "term", "inner")
    terms = common.save(places.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(TERM).alias("kind"), "end")).alias("terms")), "pii-places")
    none = F.expr("cast(array() AS array<struct<start:bigint,kind:int,end:bigint>>)")
    rows = common.join_small(found.drop("entities", "terms", "uid"), terms, "row", "left", 50_000).withColumn("terms", F.coalesce("terms", none))
    rows = rows.withColumn("span_list", F.array_sort(F.concat("base", "secrets", "terms"))).withColumn("n_term", F.size("terms").cast("long")).withColumn("n_secret", F.size("secrets").cast("long"))
    joined = F.expr(_joined("base"))
    private = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_secret")
    return rows.select("row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "n_term", private.alias("n_private"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("base"), F.expr(_joined("span_list")).alias("spans"), "span_list")


def _rewrite(text: str, spans: list[dict]) -> str:
    """Entities become <KIND>; terms a number or a name's class, else nothing. Overlaps go with the first span."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] < at:
            at = max(at, s["end"])
            continue
        piece = text[s["start"] : s["end"]]
        kind = KINDS[s["kind"]]
        new = f"<{kind.upper()}>" if kind != "term" else "<NUMBER>" if piece.isdigit() else "<NAME>" if piece[:1].isupper() else ""
        out += [text[at : s["start"]], new]
        at = s["end"]
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with `text` sanitised, its other columns unchanged; each row by the spans of its own doc_id and text, null and shared ids too."""
    # Names longer than any of docs, so that they are no column's.
    tag = max(map(len, docs.columns)) * "_" + "_"
    key, row, held = (tag + x for x in ("key", "row", "spans"))
    spans = _detect(docs, **options).where("size(span_list) > 0").select(F.col("row").alias(row), F.col("span_list").alias(held)).dropDuplicates([row])
    joined = docs.withColumn(key, _row()).join(spans, F.col(key) == F.col(row), "left").drop(key, row)
    schema = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_rewrite(t, s) if t and s else t for t, s in zip(batch.column("text").to_pylist(), batch.column(held).to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return joined.mapInArrow(rewrite, schema)
