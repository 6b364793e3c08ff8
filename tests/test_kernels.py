"""Known-answer vectors of the byte kernels."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from codicil.functions import kernels as k

KEY = bytes.fromhex("a1e7f815671f82812870e2315352f1569a4cb39584f08b03")
RAMP = bytes(i % 256 for i in range(768))


def test_body_keystream():
    assert k.body_keystream(KEY[:16], 64).tobytes().hex() == "52be918b84e8454a21be38e8c272b1be6b9ebb406efbd2a64f46199e80b72a987611eb0b46c88a611e62810d8218f5dd4f97ac88163f12c56be07b2f2063285c"
    assert k.body_keystream(b"key", 32).tobytes().hex() == "213a9a0e08743cf6536c9b40a485d84b40d04ead032ac26875c7d2bdbe3be683"


def test_body_keystream_degenerates_and_restarts():
    stream = k.body_keystream(KEY[:16])
    assert round(float(np.mean(stream == 0x45)), 4) == 0.9733
    assert int((stream[:1024] == 0x45).sum()) < 100
    out = k.apply_body(KEY[:16], bytes(200_000))
    assert (out[:65536] == out[65536:131072]).all() and (out[131072:] == out[: 200_000 - 131072]).all()
    assert k.apply_body(KEY[:16], out.tobytes()).tobytes() == bytes(200_000)
    assert len(k.apply_body(KEY[:16], b"")) == 0


def test_triple_des_block():
    cipher = k.TripleDes(bytes.fromhex("0123456789abcdef23456789abcdef01456789abcdef0123"))
    block = np.frombuffer(bytes.fromhex("5468652071756663"), ">u8").astype(np.uint64)
    assert cipher.encrypt(block).astype(">u8").tobytes().hex() == "a826fd8ce53b855f"


@pytest.mark.parametrize(
    ("function", "data", "start"),
    [
        (k.cfb64_decrypt, bytes(8), "8ebbb5121ed7ec0e"),
        (k.ofb, bytes(8), "8ebbb5121ed7ec0e"),
        (k.cfb64_decrypt, bytes(600), "8ebbb5121ed7ec0e8203f6bb705c64448203f6bb705c64448203f6bb705c64448203f6bb705c64448203f6bb705c64448203f6bb705c64448203f6bb705c6444"),
        (k.ofb, bytes(600), "8ebbb5121ed7ec0e4ed688541b569e67dc86a936fd628de2ece0db40eeacbeca5fe0416037dada71ca29bc8a0b29f886390ac2d2e8e10a9454b1a2cad541b21e"),
        (k.cfb64_decrypt, RAMP, "8ebab7111ad2ea092b77c40946f63a6bc1518b14a0efa0f77e1f1fb30da790535ba079fbcb7b20f94932d29c65aa0a672315e61d98d25ee5a650159605d58ae2"),
        (k.cfb64_encrypt, RAMP, "8ebab7111ad2ea092bd71bd68d9951f18d75da78f244ad1e110c998889b4aff9fa82a3b28dabf4f2eb3408244a78756210530e34a63594fb3e089852c1c97936"),
        (k.cfb64_decrypt, RAMP[:13], "8ebab7111ad2ea092b77c40946"),
        (k.cfb64_encrypt, RAMP[:13], "8ebab7111ad2ea092bd71bd68d"),
    ],
)
def test_chaining_vectors(function, data, start):
    assert function(KEY, data)[: len(start) // 2].hex() == start


def test_windows_restart():
    out = k.cfb64_decrypt(KEY, bytes(600))
    assert out[:256] == out[256:512] and out[512:] == out[:88]


def test_modes_agree_on_the_first_block_of_a_window_only():
    a, b = k.cfb64_decrypt(KEY, RAMP), k.ofb(KEY, RAMP)
    for w in range(0, 768, 256):
        assert a[w : w + 8] == b[w : w + 8] and a[w + 8] != b[w + 8]


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 255, 256, 257, 1000])
@pytest.mark.parametrize("mode", k.MODES)
def test_round_trip(mode, size):
    data = bytes(i % 251 for i in range(size))
    assert k.DECRYPT[mode](KEY, k.ENCRYPT[mode](KEY, data)) == data


def test_cfb8_against_the_serial_definition():
    cipher = k.triple_des(KEY)
    data, out, held = bytes(range(200)) * 2, bytearray(), b""
    for i, c in enumerate(data):
        if i % 256 == 0:
            held = KEY[:8]
        pad = cipher.encrypt(np.frombuffer(held, ">u8").astype(np.uint64)).astype(">u8").tobytes()
        out.append(c ^ pad[0])
        held = held[1:] + bytes([c])
    assert k.cfb8_decrypt(KEY, data) == bytes(out)


def test_short_key_is_first_second_first():
    assert k.cfb64_decrypt(KEY[:16], bytes(32)) == k.cfb64_decrypt(KEY[:16] + KEY[:8], bytes(32))
    with pytest.raises(k.KeyLengthError):
        k.TripleDes(bytes(20))
    with pytest.raises(ValueError):
        k.ofb(KEY, bytes(8), 12)


def test_unwrap_key():
    blob = bytes.fromhex("a2c8c0244570858b23ccaf50cd41862fd3b0a159f4101be7d1208abcfe5e2df4237032acf107c5130792876aff1cda946b5ecb70e0332ade601950ef1aa8fac4")
    assert k.unwrap_key(blob) == KEY
    with pytest.raises(k.KeyLengthError):
        k.unwrap_key(bytes(32))
    with pytest.raises(k.UnwrapError):
        k.unwrap_key(bytes((i * 37 + 11) % 256 for i in range(64)))


def test_modular_power():
    n, e = (int.from_bytes(bytes.fromhex(x), "little") for x in (k.MODULUS, k.EXPONENT))
    assert pow(2, e, n).to_bytes(64, "little").hex() == "427fd61435709f268cae529c8d05c29c03120fa258448cfa362d8a3846a3bc78e38beeab8c9ba39b55e513462ec5f79811454b90e714a5698e9ed1ac44312ca4"
    assert pow(n - 1, e, n) == n - 1


def test_inflate():
    packed = zlib.compress(bytes(200_000), 0)
    assert k.inflate(packed) == (200_000, None)
    assert k.inflate(packed + b"\r\n tail")[0] == 200_000
    assert k.inflate(packed[:-5]) == (None, "truncated deflate stream")
    assert k.inflate(b"") == (None, "empty stream")
    assert k.inflate(b"not deflate")[0] is None
