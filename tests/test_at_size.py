"""What held on small tables only: chance in sweeps, places in listings, keys by the thousand."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from codicil import synth
from codicil.functions import kernels
from codicil.operators import decode, evidence
from codicil.plans import outputs


def _chance() -> bytes:
    """A payload with its closing line end, 17 bytes of stream, that inflates from a restart every 16 bytes though it is encrypted with none."""
    for i in range(4000):
        raw = kernels.cfb64_encrypt(synth.KEY, synth.stored(b"%06d" % i) + b"\r")
        if evidence.eliminated(raw, synth.KEY, ("cfb64",), (16,))[0]["cfb64", 16] is not None:
            return raw
    raise AssertionError("one in 256 is expected")


def test_what_inflates_by_chance_is_not_counted(spark):
    rows = spark.createDataFrame([(bytearray(_chance()), bytearray(synth.KEY))], "raw binary, key binary")
    want = {("cfb64", c) for c in (32, 64, 128, 256, 512, evidence.WHOLE)}
    for swept in (evidence.mode_sweep(rows, evidence.grid(spark)), evidence.sweep_by_elimination(rows)):
        assert {(r["mode"], r["chunk"]) for r in swept.where("inflating > 0").collect()} == want


def test_payloads_tried_together_are_each_by_itself():
    r = random.Random(5)
    cells = [(m, c) for m in evidence.MODES for c in evidence.CHUNKS]
    keys = [r.randbytes(24) for _ in range(40)]
    plain = [r.randbytes(r.choice([0, 1, 5, 30, 245, 700, 5000])) for _ in keys]
    data = [kernels.ENCRYPT[("ofb", "cfb64")[i % 2]](k, synth.stored(p)) for i, (k, p) in enumerate(zip(keys, plain, strict=True))]
    found, _ = evidence.tried([*data, None, b""], [*keys, keys[0], keys[0]], [cells] * (len(data) + 2))
    assert found[-2:] == [[None] * len(cells)] * 2
    for d, k, sizes in zip(data, keys, found, strict=False):
        assert dict(zip(cells, sizes, strict=True)) == evidence.eliminated(d, k, evidence.MODES, evidence.CHUNKS)[0]


def test_keys_of_many_payloads_are_worked_on_together():
    r = random.Random(6)
    keys = [r.randbytes(r.choice([16, 24])) for _ in range(60)]
    parts = [r.randbytes(r.choice([0, 1, 8, 255, 256, 257, 3000])) for _ in keys]
    for mode in kernels.MODES:
        done = kernels.encrypt_parts(mode, keys, parts)
        assert done == [kernels.ENCRYPT[mode](k, p) for k, p in zip(keys, parts, strict=True)]
        assert kernels.decrypt_parts(mode, keys, done) == parts


def test_places_of_a_listing_that_is_sampled(spark):
    rows = spark.range(0, 60_000, 1, 3).selectExpr("concat('/in/', sha2(cast(id AS string), 256)) AS path")
    found = sorted((r["path"], r["place"]) for r in outputs.listing(rows).collect())
    assert [place for _, place in found] == list(range(60_000))


def test_a_batch_is_worked_on_in_parts(spark):
    r = random.Random(7)
    n, size = 4000, 6000
    texts = pa.array([[r.randbytes(size)] for _ in range(n)], pa.list_(pa.binary()))
    same = lambda x, kind: pa.array([x] * n, kind)
    tracemalloc.start()
    sealed = synth._sealer(True, False, True).func(texts, same("cfb64", pa.string()), same(0, pa.int32()), same(synth.KEY, pa.binary()), same(None, pa.binary()), same(0, pa.int64()))
    sealing = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    # One section of these containers is the body, at 99.
    bodies = pa.array([c.as_py()[99:-44] for c in sealed], pa.binary())
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    out = decode._udf(None, True, False, "keyword").func(bodies, same(synth.KEY[:16], pa.binary()), same(synth.KEY, pa.binary()), same(2, pa.int64()))
    decoding = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    print("MB sealing, decoding", sealing >> 20, decoding >> 20)
    assert len(out) == n and all(x["check"]["flate_ok"] == 1 for x in out.slice(0, 3).to_pylist())
    # A batch of 24 MB.
    assert sealing < 60 << 20 and decoding < 60 << 20
