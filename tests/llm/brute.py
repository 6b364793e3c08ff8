"""Plain single-machine versions of the contract's queries."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import defaultdict
from fractions import Fraction

import public_tokenizers
from tokenizers import Tokenizer

sys.set_int_max_str_digits(0)  # parts of addresses may be of any length
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mixture_order(docs, seed=17):
    """The global order of a mixture, by a hash of the id and the copy's number."""
    seen, keyed = defaultdict(int), []
    for doc, text in docs:
        seen[doc, text] += 1
        keyed.append((hashlib.md5(f"order {seed}|{doc}|{seen[doc, text]}".encode()).hexdigest(), doc, text))
    return [(doc, text) for _, doc, text in sorted(keyed, key=lambda k: k[:2])]


def op1(docs, by_id=True):
    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())) if by_id else docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def npy(rows, width):
    """An array file of 8-bit samples, written by hand."""
    head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({len(rows) // (3 * width)}, {width}, 3), }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode() + rows


def difference(rows, width):
    """Hex digits of which of 8 x 9 area means is darker than its right neighbour; areas by exact fractions."""
    height = len(rows) // (3 * width)
    lines = [[sum(rows[3 * (y * width + x) : 3 * (y * width + x) + 3]) for x in range(width)] for y in range(height)]

    def means(values, target):
        n, out = len(values), []
        for k in range(target):
            low, high = Fraction(k * n, target), Fraction((k + 1) * n, target)
            out.append(sum(values[i] * (min(i + 1, high) - max(i, low)) for i in range(int(low), -(-high.numerator // high.denominator))) / (high - low))
        return out

    columns = [means(list(c), 8) for c in zip(*lines, strict=True)]
    tile = [[round(v / 3) for v in means(list(row), 9)] for row in zip(*columns, strict=True)]
    bits = "".join(str(int(a < b)) for row in tile for a, b in zip(row, row[1:], strict=False))
    return f"{int(bits, 2):016x}"


def op2(docs):
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = npy(full, 64)
        out.append((doc, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), difference(full, 64)))
    return out


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def op3(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for own in holders.values():
        for i in own[1:]:
            for j in own:
                if j >= i:
                    break
                a, b = find(i), find(j)
                if a != b:
                    n = len(sets[i] & sets[j])
                    if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                        root[a] = b
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low.get(find(i)), d == low.get(find(i))) for i, (d, _) in enumerate(docs)]


def op4(docs):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def op7(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = pattern.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = pattern.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        total += x // 10 + x % 10
    return total % 10 == 0


def op9(docs):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    out = []
    for d, t in docs:
        spans = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok(m[0])]
        spans.sort()
        out.append((d, *(sum(s[3] == k for s in spans) for k in kinds), sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))))
    return out
