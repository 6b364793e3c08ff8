"""Recovering the document inside a container: one Arrow pass over each body.

The pass undoes the body cipher, takes the payload ranges while payloads are still
encrypted, decodes each with the chosen strategy, blanks the trailer's reference
and, if asked to, inflates payloads and compares declared lengths. Bytes cross to
Python once and come back once. Rows that have an error already send no bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions import kernels, pdfbytes
from codicil.functions.bytesx import le_uint, piece

# Fixed values of the container format.
WRAPPED = 0x80000000
MODES_BY_ID = {0: "none", 1: "ofb", 2: "cfb64"}
MODE_NAMES = {"ofb": "3DES-OFB", "cfb64": "3DES-CFB64"}
REPORTED = 5


class Refusal(Exception):
    """A file that can't be decoded: code and message of its error column."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class StreamInfo:
    """What a strategy knows of a payload."""

    index: int
    offset: int
    size: int
    number: int | None
    generation: int | None
    dictionary: bytes
    file_key: bytes

    def dict_has(self, needle: bytes) -> bool:
        return needle in self.dictionary


class Strategy:
    """Decodes payloads; subclasses must give as many bytes as they take."""

    name = "none (payloads are not encrypted)"

    def decrypt(self, info: StreamInfo, data: bytes) -> bytes:
        return data

    def decrypt_all(self, infos: list[StreamInfo], data: list[bytes]) -> list[bytes]:
        """All payloads of a file; for strategies that gain by it."""
        return [self.decrypt(i, d) for i, d in zip(infos, data, strict=True)]


class TripleDesStrategy(Strategy):
    def __init__(self, key: bytes, mode: str, reset: int = kernels.WINDOW):
        kernels.triple_des(key)
        kernels._check_reset(reset)
        self.key, self.mode, self.reset, self._run = key, mode, reset, kernels.DECRYPT[mode]
        self.name = f"{MODE_NAMES[mode]}, started anew with the key's first 8 bytes every {reset} bytes"

    def decrypt(self, info: StreamInfo, data: bytes) -> bytes:
        return self._run(self.key, data, self.reset)

    def decrypt_all(self, infos: list[StreamInfo], data: list[bytes]) -> list[bytes]:
        return kernels.many(self._run, self.key, data, self.reset)


Factory = Callable[[bytes], Strategy]
#: Named strategies that take the file key, for `strategy=`.
STRATEGIES: dict[str, Factory] = {
    "none": lambda key: Strategy(),
    "ofb": lambda key: TripleDesStrategy(key, "ofb"),
    "cfb64": lambda key: TripleDesStrategy(key, "cfb64"),
}


def mode_of(algorithm: int) -> str:
    """The mode that an algorithm id names; only its top bit is another flag."""
    mode = MODES_BY_ID.get(algorithm & ~WRAPPED)
    if mode is None:
        known = ", ".join(f"{k} ({v})" for k, v in MODES_BY_ID.items())
        raise Refusal("UNKNOWN_ALGORITHM", f"algorithm id {algorithm:#010x} is not known; low bits can be {known}; a forced mode (--force-mode none, ofb or cfb64) goes round it")
    return mode


def recover_key(blob: bytes | None, algorithm: int) -> tuple[bytes, str]:
    if blob is None:
        raise Refusal("MISSING_SECTION", "no section can be the key blob; a file that a licence server opens has none and is out of scope")
    if algorithm & WRAPPED or len(blob) == kernels.RSA_BYTES:
        try:
            return kernels.unwrap_key(blob), "wrapped"
        except kernels.KeyLengthError as e:
            raise Refusal("BAD_KEY_LENGTH", str(e)) from e
        except kernels.UnwrapError as e:
            raise Refusal("UNWRAP_FAILED", str(e)) from e
    return blob, "direct"


def choose(strategy: str | Factory | None, algorithm: int, blob: bytes | None) -> tuple[Strategy, bytes, str]:
    """Strategy, key and the key's source. None follows the algorithm id, a name forces a mode, a callable gets the key."""
    if callable(strategy):
        key, source = recover_key(blob, algorithm)
        return strategy(key), key, source
    mode = mode_of(algorithm) if strategy is None else strategy
    if mode == "none":
        return Strategy(), b"", "not needed"
    key, source = recover_key(blob, algorithm)
    try:
        return STRATEGIES[mode](key), key, source
    except kernels.KeyLengthError as e:
        raise Refusal("BAD_KEY_LENGTH", str(e)) from e


PAYLOAD = "struct<idx:int,start:bigint,end:bigint,dict_start:bigint,dict_end:bigint,number:bigint,generation:int,flate:boolean,boundary:string>"
CHECK = (
    "struct<pdf_header:boolean,eof:boolean,unlocked:boolean,flate_streams:int,flate_ok:int,inflated_bytes:bigint,bad_total:int,"
    "bad:array<struct<idx:int,number:bigint,generation:int,start:bigint,len:bigint,reason:string>>,mismatch_total:int,"
    "mismatches:array<struct<idx:int,number:bigint,generation:int,scanned:bigint,declared:decimal(20,0)>>,fonts_external:boolean>"
)
DECODED = (
    f"struct<pdf:binary,code:string,message:string,cause:string,strategy:string,forced:boolean,key_source:string,key_len:int,streams:array<{PAYLOAD}>,"
    f"stream_bytes:bigint,encrypt:struct<kind:string,at:bigint,len:int>,check:{CHECK}>"
)


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


Verdict = tuple[int, str | None]


def is_flate(pdf: bytes, p: pdfbytes.Payload) -> bool:
    return p.size > 0 and b"/FlateDecode" in pdf[p.dict_start : p.dict_end]


def check(pdf: bytes, payloads: list[pdfbytes.Payload], exact_name: bool = False, verdicts: dict[int, Verdict] | None = None) -> dict:
    """What holds of a recovered document, whatever was done to it. verdicts has what is known of payloads by their number."""
    from decimal import Decimal

    flate = [p for p in payloads if is_flate(pdf, p)]
    bad, total, good = [], 0, 0
    for p in flate:
        size, reason = (verdicts or {}).get(p.idx) or kernels.inflate(pdf[p.start : p.end])
        if reason is None:
            good, total = good + 1, total + size
        else:
            bad.append({"idx": p.idx, "number": p.number, "generation": p.generation, "start": p.start, "len": p.size, "reason": reason})
    wrong = pdfbytes.length_mismatches(pdf, payloads, exact_name)
    return {
        "pdf_header": pdf.startswith(b"%PDF-"), "eof": b"%%EOF" in pdf[-pdfbytes.TAIL :], "unlocked": pdfbytes.LOCKED not in pdf, "flate_streams": len(flate), "flate_ok": good, "inflated_bytes": total,
        "bad_total": len(bad), "bad": bad[:REPORTED], "mismatch_total": len(wrong),
        "mismatches": [{"idx": p.idx, "number": p.number, "generation": p.generation, "scanned": p.size, "declared": Decimal(d)} for p, d in wrong[:REPORTED]],
        "fonts_external": b"/BaseFont" in pdf and b"/FontFile" not in pdf,
    }


@dataclass
class _File:
    """A file on its way through the pass."""

    plain: bytes
    run: Strategy
    key: bytes
    source: str
    payloads: list[pdfbytes.Payload]
    #: Which rule chose a payload's start, by its number, where it was not the scan's; and what inflating said.
    boundaries: dict[int, str] = field(default_factory=dict)
    verdicts: dict[int, Verdict] = field(default_factory=dict)

    @property
    def full(self) -> list[pdfbytes.Payload]:
        return [p for p in self.payloads if p.size]

    def cut(self) -> list[bytes]:
        return [self.plain[p.start : p.end] for p in self.full]


#: How a payload's bounds are found: by keywords alone, or by /Length and by what inflates too.
BOUNDS = ("keyword", "length")


def _opened(plain: bytes, blob: bytes | None, algorithm: int, strategy: str | Factory | None, bounds: str, exact_name: bool) -> _File:
    if not plain.startswith(b"%PDF-"):
        raise Refusal("BODY_LAYER_FAILED", f"the body does not begin with `%PDF-` but with bytes {plain[:8].hex()}: another section holds its key, or the cipher is another")
    run, file_key, source = choose(strategy, algorithm, blob)
    if bounds == "keyword":
        return _File(plain, run, file_key, source, pdfbytes.scan(plain))
    f = _File(plain, run, file_key, source, pdfbytes.scan_by_length(plain, exact_name))
    objects = pdfbytes.first_objects(plain, f.payloads)
    for i, p in enumerate(f.payloads):
        if not is_flate(plain, p):
            # Nothing but the length can tell: the standard's one line end, if the length admits it.
            _, one, _ = pdfbytes.starts(plain, p.dict_end, p.end)
            fit = pdfbytes.admitted(plain, p, pdfbytes.declared_length(plain, p, objects, exact_name))
            start = one if one in fit else fit[0]
            if start != p.start and len(fit) < len(pdfbytes.starts(plain, p.dict_end, p.end)[2]):
                f.payloads[i], f.boundaries[p.idx] = replace(p, start=start), "length"
    return f


def _info(f: _File, p: pdfbytes.Payload) -> StreamInfo:
    return StreamInfo(p.idx, p.start, p.size, p.number, p.generation, f.plain[p.dict_start : p.dict_end], f.key)


def _by_itself(f: _File) -> list[bytes]:
    return f.run.decrypt_all([_info(f, p) for p in f.full], f.cut())


def _resolved(f: _File, decoded: list[bytes], exact_name: bool) -> list[bytes]:
    """Payloads that don't inflate from the scan's start, from another start that their length admits and that inflates.

    Most files have none, and cost nothing but the verdicts, which the self-check takes over.
    """
    out, objects, place = list(decoded), None, {p.idx: i for i, p in enumerate(f.payloads)}
    for k, p in enumerate(f.full):
        if not is_flate(f.plain, p):
            continue
        f.verdicts[p.idx] = kernels.inflate(out[k])
        if f.verdicts[p.idx][1] is None:
            continue
        objects = pdfbytes.first_objects(f.plain, f.payloads) if objects is None else objects
        fit = pdfbytes.admitted(f.plain, p, pdfbytes.declared_length(f.plain, p, objects, exact_name))
        for start in fit:
            if start == p.start:
                continue
            other = replace(p, start=start)
            plain = f.run.decrypt(_info(f, other), f.plain[start : p.end])
            verdict = kernels.inflate(plain)
            if verdict[1] is None:
                out[k], f.verdicts[p.idx], f.payloads[place[p.idx]] = plain, verdict, other
                f.boundaries[p.idx] = "length" if len(fit) == 1 else "inflate"
                break
    return out


def _finished(f: _File, decoded: list[bytes], forced: bool, verify: bool, exact_name: bool) -> dict:
    pdf = bytearray(f.plain)
    for p, new in zip(f.full, decoded, strict=True):
        if len(new) != p.size:
            raise Refusal("LENGTH_CHANGED", f"strategy `{f.run.name}` made {len(new)} of {p.size} bytes in payload {p.idx}")
        pdf[p.start : p.end] = new
    kind, at, size = pdfbytes.unlock(pdf)
    out = bytes(pdf)
    streams = [
        {"idx": p.idx, "start": p.start, "end": p.end, "dict_start": p.dict_start, "dict_end": p.dict_end, "number": p.number, "generation": p.generation, "flate": b"/FlateDecode" in out[p.dict_start : p.dict_end], "boundary": f.boundaries.get(p.idx, "keyword")}
        for p in f.payloads
    ]
    return {
        "pdf": out, "code": None, "message": None, "cause": None, "strategy": f.run.name, "forced": forced, "key_source": f.source, "key_len": len(f.key), "streams": streams,
        "stream_bytes": sum(p.size for p in f.payloads), "encrypt": {"kind": kind, "at": at, "len": size}, "check": check(out, f.payloads, exact_name, f.verdicts) if verify else None,
    }


Given = tuple[bytes, bytes, bytes | None, int]


def decode_bodies(files: list[Given], strategy: str | Factory | None = None, verify: bool = True, exact_name: bool = False, bounds: str = "keyword") -> list[dict | Refusal]:
    """The pass over files (body, body key, key blob, algorithm id), each with its own keys, whose bytes are worked on together."""
    out: list = [None if len(key) == 16 else Refusal("BAD_KEY_LENGTH", f"body key of {len(key)} bytes, not 16") for _, key, _, _ in files]
    fit = [i for i, o in enumerate(out) if o is None]
    opened: dict[int, _File] = {}
    for i, plain in zip(fit, kernels.apply_bodies([files[i][1] for i in fit], [files[i][0] for i in fit]), strict=True):
        try:
            opened[i] = _opened(plain, files[i][2], files[i][3], strategy, bounds, exact_name)
        except Refusal as e:
            out[i] = e
    decoded: dict[int, list[bytes]] = {}
    together: dict[tuple[str, int], list[int]] = {}
    for i, f in opened.items():
        if type(f.run) is TripleDesStrategy and f.run.mode in ("ofb", "cfb64"):
            together.setdefault((f.run.mode, f.run.reset), []).append(i)
        else:
            decoded[i] = _by_itself(f)
    for (mode, reset), own in together.items():
        cut = [opened[i].cut() for i in own]
        keys = [opened[i].run.key for i, parts in zip(own, cut, strict=True) for _ in parts]
        made = iter(kernels.decrypt_parts(mode, keys, [p for parts in cut for p in parts], reset))
        decoded.update((i, [next(made) for _ in parts]) for i, parts in zip(own, cut, strict=True))
    for i, f in opened.items():
        try:
            own = decoded.pop(i)
            out[i] = _finished(f, own if bounds == "keyword" else _resolved(f, own, exact_name), isinstance(strategy, str), verify, exact_name)
        except Refusal as e:
            out[i] = e
    return out


def decode_body(body: bytes, key: bytes, blob: bytes | None, algorithm: int, strategy: str | Factory | None = None, verify: bool = True, exact_name: bool = False, bounds: str = "keyword") -> dict:
    """One file's pass, as a plain function."""
    (found,) = decode_bodies([(body, key, blob, algorithm)], strategy, verify, exact_name, bounds)
    if isinstance(found, Refusal):
        raise found
    return found


#: Bytes of bodies that are decoded together.
TOGETHER = 2 << 20


def _udf(strategy: str | Factory | None, verify: bool, exact_name: bool, bounds: str):
    kind = _arrow(DECODED)

    def refused(e: Refusal) -> dict:
        return dict.fromkeys([f.name for f in kind]) | {"code": e.code, "message": str(e), "cause": str(e.__cause__) if e.__cause__ else None}

    def run(body: pa.Array, key: pa.Array, blob: pa.Array, algorithm: pa.Array) -> pa.Array:
        done: list[pa.Array] = []
        part: list[Given | None] = []
        held = 0

        def flush() -> None:
            # Rows of a part become Arrow at once, so that a batch's documents are held once.
            found = iter(decode_bodies([p for p in part if p is not None], strategy, verify, exact_name, bounds))
            rows = [None if p is None else refused(x) if isinstance(x := next(found), Refusal) else x for p in part]
            done.append(pa.array(rows, kind))

        for i, b in enumerate(body):
            part.append((b.as_py(), key[i].as_py() or b"", blob[i].as_py(), algorithm[i].as_py() or 0) if b.is_valid else None)
            held += len(part[-1][0]) if b.is_valid else 0
            if held >= TOGETHER:
                flush()
                part, held = [], 0
        flush()
        return pa.concat_arrays(done)

    # Not deterministic to Catalyst, so that no filter or projection above makes it run twice.
    return F.arrow_udf(run, DECODED).asNondeterministic()


def first_layer(resolved: DataFrame, content: str = "content") -> DataFrame:
    """Adds algorithm_id, key and body (decrypted; null with an error): the first layer alone, payloads as they are."""

    def strip(body: pa.Array, key: pa.Array) -> pa.Array:
        done: list[pa.Array] = []
        part: list[tuple[bytes, bytes] | None] = []
        held = 0

        def flush() -> None:
            fit = [p for p in part if p is not None]
            plain = iter(kernels.apply_bodies([k for _, k in fit], [b for b, _ in fit]))
            done.append(pa.array([None if p is None else next(plain) for p in part], pa.binary()))

        for b, k in zip(body, key, strict=True):
            whole = b.is_valid and k.is_valid and len(k.as_py()) == 16
            part.append((b.as_py(), k.as_py()) if whole else None)
            held += len(part[-1][0]) if whole else 0
            if held >= TOGETHER:
                flush()
                part, held = [], 0
        flush()
        return pa.concat_arrays(done)

    c = F.when(F.col("error").isNull(), F.col(content))
    cut = lambda role: piece(c, F.col(f"{role}.offset"), F.col(f"{role}.len"))
    df = resolved.withColumn("algorithm_id", F.when(F.col("error").isNull(), F.coalesce(le_uint(cut("algorithm")), F.lit(0))))
    return df.withColumn("key", cut("body_key")).withColumn("body", F.arrow_udf(strip, "binary").asNondeterministic()(cut("body"), cut("body_key")))


def decode(resolved: DataFrame, strategy: str | Factory | None = None, verify: bool = True, exact_name: bool = False, content: str = "content", bounds: str = "keyword") -> DataFrame:
    """Adds algorithm_id and `decoded` to resolved containers and moves its error to `error`.

    bounds="keyword": a payload begins after all line ends that follow its keyword, and
    ends at the next closing one. bounds="length": it ends where its declared length
    leads to a closing keyword; if it does not inflate, it begins at the other line end
    that its length admits and from which it inflates. `decoded.streams.boundary` names
    the rule that chose a start: keyword, length or inflate.
    """
    if bounds not in BOUNDS:
        raise ValueError(f"bounds is one of {', '.join(BOUNDS)}")
    if isinstance(strategy, str) and strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}, a callable or None")
    c = F.when(F.col("error").isNull(), F.col(content))
    cut = lambda role: piece(c, F.col(f"{role}.offset"), F.col(f"{role}.len"))
    algorithm: Column = F.coalesce(le_uint(cut("algorithm")), F.lit(0))
    df = resolved.withColumn("algorithm_id", F.when(F.col("error").isNull(), algorithm))
    df = df.withColumn("decoded", _udf(strategy, verify, exact_name, bounds)(cut("body"), cut("body_key"), cut("key_blob"), F.col("algorithm_id")))
    failed = F.when(F.col("decoded.code").isNotNull(), F.struct(F.col("decoded.code").alias("code"), F.col("decoded.message").alias("message")))
    return df.withColumn("error", F.coalesce(F.col("error"), failed))
