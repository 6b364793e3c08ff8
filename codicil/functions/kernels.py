"""Byte kernels on numpy arrays: the body cipher, 3DES chaining, key unwrapping, inflating."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

# Fixed values of the container format and of its ciphers.
BODY_BLOCK = 65536
WINDOW = 256
KEY_MASK = 0xAA
MAX_KEY = 32
RSA_BYTES = 64
MODULUS = "91437cd83d0722ce410bd96ca80cff34895a315e25128bc32529d5f614e45097e12e450c68daf1ad8d8e740ab708564f4f317b8012c44856de567d58522497db"
EXPONENT = "f384ff17a8165a0eceb0a526f54412a99a88ec6968b5e14faf7a08bee92ffde35b18c54697d86ecc639700e642bc91757e522dc5ef4c95ccd746d2d259db00c5"

# Fixed values of the Data Encryption Standard (FIPS 46-3): substitution boxes, a row of hex digits for each box line.
BOXES = (
    "e4d12fb83a6c5907 0f74e2d1a6cb9538 41e8d62bfc973a50 fc8249175b3ea06d",
    "f18e6b34972dc05a 3d47f28ec01a69b5 0e7ba4d158c6932f d8a13f42b67c05e9",
    "a09e63f51dc7b428 d709346a285ecbf1 d6498f30b12c5ae7 1ad069874fe3b52c",
    "7de3069a1285bc4f d8b56f03472c1ae9 a690cb7df13e5284 3f06a1d8945bc72e",
    "2c417ab6853fd0e9 eb2c47d150fa3986 421bad78f9c5630e b8c71e2d6f09a453",
    "c1af92680d34e75b af427c9561de0b38 9ef528c3704a1db6 432c95fabe17608d",
    "4b2ef08d3c975a61 d0b7491ae35c2f86 14bdc37eaf680592 6bd814a7950fe23c",
    "d2846fb1a93e50c7 1fd8a374c56b0e92 7b419ce206adf358 21e74a8dfc90356b",
)
SPREAD = (16, 7, 20, 21, 29, 12, 28, 17, 1, 15, 23, 26, 5, 18, 31, 10, 2, 8, 24, 14, 32, 27, 3, 9, 19, 13, 30, 6, 22, 11, 4, 25)
KEY_FIRST = (57, 49, 41, 33, 25, 17, 9, 1, 58, 50, 42, 34, 26, 18, 10, 2, 59, 51, 43, 35, 27, 19, 11, 3, 60, 52, 44, 36, 63, 55, 47, 39, 31, 23, 15, 7, 62, 54, 46, 38, 30, 22, 14, 6, 61, 53, 45, 37, 29, 21, 13, 5, 28, 20, 12, 4)
KEY_SECOND = (14, 17, 11, 24, 1, 5, 3, 28, 15, 6, 21, 10, 23, 19, 12, 4, 26, 8, 16, 7, 27, 20, 13, 2, 41, 52, 31, 37, 47, 55, 30, 40, 51, 45, 33, 48, 44, 49, 39, 56, 34, 53, 46, 42, 50, 36, 29, 32)
ROTATIONS = (1, 1, 2, 2, 2, 2, 2, 2, 1, 2, 2, 2, 2, 2, 2, 1)


class KeyLengthError(ValueError):
    """A cipher key of a length that the cipher doesn't take."""


class UnwrapError(ValueError):
    """A key blob that doesn't unwrap to a key."""


@lru_cache(maxsize=64)
def _keystream(key: bytes, size: int) -> np.ndarray:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + (key[i % len(key)] | KEY_MASK)) & 255
        state[i], state[j] = state[j], state[i]
    out, x, y = bytearray(size), 0, 0
    for n in range(size):
        x = (x + 1) & 255
        t = state[x]
        y = (y + t) & 255
        state[x] = state[y]
        # The format's generator stores the entry at t here, not t itself.
        state[y] = state[t]
        out[n] = state[(state[x] + state[y]) & 255]
    return np.frombuffer(bytes(out), np.uint8)


def body_keystream(key: bytes, size: int = BODY_BLOCK) -> np.ndarray:
    """The first bytes of the body cipher's key stream; kept by key, at a power of two."""
    if not key:
        raise KeyLengthError("empty key")
    size = min(size, BODY_BLOCK)
    return _keystream(key, min(BODY_BLOCK, 1 << max(8, (size - 1).bit_length())))[:size]


def _keystreams(keys: list[bytes], size: int) -> np.ndarray:
    """The first bytes of the key streams of many keys, a row for each, made side by side: a step for all keys at once."""
    n = len(keys)
    lanes, state = np.arange(n), np.repeat(np.arange(256, dtype=np.uint8)[:, None], n, 1)
    longest = max(map(len, keys))
    own = np.array([[k[i % len(k)] | KEY_MASK for k in keys] for i in range(longest)], np.uint8)
    sizes = np.array([len(k) for k in keys])
    j = np.zeros(n, np.uint8)
    for i in range(256):
        at = state[i].copy()
        j = j + at + own[i % sizes, lanes]
        state[i] = state[j, lanes]
        state[j, lanes] = at
    out, y = np.empty((size, n), np.uint8), np.zeros(n, np.uint8)
    for i in range(size):
        x = (i + 1) & 255
        t = state[x].copy()
        y = y + t
        state[x] = state[y, lanes]
        state[y, lanes] = state[t, lanes]
        out[i] = state[state[x] + state[y, lanes], lanes]
    return np.ascontiguousarray(out.T)


#: Keys from which making their streams side by side is faster than one by one.
_SIDE_BY_SIDE = 96


def _stream_size(size: int) -> int:
    """Stream bytes made for a body: a power of two, one block at most."""
    return min(BODY_BLOCK, 1 << max(8, (size - 1).bit_length()))


def apply_body(key: bytes, data: bytes, stream: np.ndarray | None = None) -> np.ndarray:
    """Encrypt or decrypt a body. The cipher starts anew every block, so one block's key stream serves all."""
    body = np.frombuffer(data, np.uint8).copy()
    if len(body):
        stream = (body_keystream(key, len(body)) if stream is None else stream)[: min(len(body), BODY_BLOCK)]
        whole = len(body) // BODY_BLOCK * BODY_BLOCK
        if whole:
            body[:whole].reshape(-1, BODY_BLOCK)[:] ^= stream
        body[whole:] ^= stream[: len(body) - whole]
    return body


def apply_bodies(keys: list[bytes], bodies: list[bytes]) -> list[bytes]:
    """apply_body over many bodies, each with its key."""
    wanted: dict[bytes, int] = {}
    for k, b in zip(keys, bodies, strict=True):
        if b:
            wanted[k] = max(wanted.get(k, 0), _stream_size(len(b)))
    made: dict[bytes, np.ndarray] = {}
    for size in set(wanted.values()):
        own = [k for k, s in wanted.items() if s == size]
        for i in range(0, len(own) if len(own) >= _SIDE_BY_SIDE else 0, 1024):
            part = own[i : i + 1024]
            made.update(zip(part, _keystreams(part, size), strict=True))
    return [apply_body(k, b, made.get(k)).tobytes() for k, b in zip(keys, bodies, strict=True)]


def _spread_boxes() -> np.ndarray:
    """Each box's output already at its bits after the round permutation: 8 x 64 words."""
    out = np.zeros((8, 64), np.uint32)
    for box, text in enumerate(BOXES):
        lines = [[int(c, 16) for c in line] for line in text.split()]
        for x in range(64):
            value = lines[(x >> 4 & 2) | (x & 1)][x >> 1 & 15] << (28 - 4 * box)
            out[box, x] = sum(((value >> (32 - source)) & 1) << (31 - i) for i, source in enumerate(SPREAD))
    return out


def _permutation(order: list[int]) -> np.ndarray:
    """A permutation of 64 bits as 8 x 256 words to be combined."""
    out = np.zeros((8, 256), np.uint64)
    for i, source in enumerate(order):
        byte, bit = divmod(source - 1, 8)
        for v in range(256):
            if v >> (7 - bit) & 1:
                out[byte, v] |= np.uint64(1 << (63 - i))
    return out


_ENTER = [start - 8 * i for start in (58, 60, 62, 64, 57, 59, 61, 63) for i in range(8)]
_tables: list[np.ndarray] = []


def _constant() -> list[np.ndarray]:
    if not _tables:
        leave = [_ENTER.index(i) + 1 for i in range(1, 65)]
        _tables.extend([_spread_boxes(), _permutation(_ENTER), _permutation(leave)])
    return _tables


def _schedules(keys: list[bytes]) -> np.ndarray:
    """For each 8-byte key 16 x 8 six-bit round keys."""
    bits = np.unpackbits(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 8), axis=1)
    halves = bits[:, np.array(KEY_FIRST) - 1].reshape(-1, 2, 28)
    out = []
    for r in ROTATIONS:
        halves = np.roll(halves, -r, axis=2)
        chosen = halves.reshape(-1, 56)[:, np.array(KEY_SECOND) - 1].reshape(-1, 8, 6)
        out.append(chosen @ (1 << np.arange(5, -1, -1)))
    return np.stack(out, 1).astype(np.uint32)


def _permute(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """x: n big-endian 64-bit words."""
    parts = x.astype(">u8").view(np.uint8).reshape(-1, 8)
    out = table[0, parts[:, 0]]
    for i in range(1, 8):
        out = out | table[i, parts[:, i]]
    return out


def _full(key: bytes) -> bytes:
    if len(key) not in (16, 24):
        raise KeyLengthError(f"3DES key of {len(key)} bytes, not 16 or 24")
    return key if len(key) == 24 else key + key[:8]


def _encrypt(blocks: np.ndarray, rounds: tuple[np.ndarray, ...]) -> np.ndarray:
    """Three passes of 16 rounds; a round's keys are 8 numbers, or an array of 8 numbers for each block."""
    boxes, enter, leave = _constant()
    x = _permute(blocks, enter)
    left, right = (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)
    for schedule in rounds:
        for r in range(16):
            keys = schedule(r)
            # Bits 32, 1..5 of the half, then every four bits on.
            turned = (right >> np.uint32(1)) | (right << np.uint32(31))
            mixed = left.copy()
            for i in range(8):
                shift = 26 - 4 * i
                six = (turned >> np.uint32(shift) if shift >= 0 else (turned << np.uint32(-shift)) | (turned >> np.uint32(32 + shift))) & np.uint32(63)
                mixed ^= boxes[i][six ^ keys[i]]
            left, right = right, mixed
        left, right = right, left
    return _permute((left.astype(np.uint64) << np.uint64(32)) | right, leave)


class TripleDes:
    """EDE over many blocks at once; keys of 24 bytes, or 16 used as first, second, first."""

    def __init__(self, key: bytes):
        full = _full(key)
        self.iv = full[:8]
        first, second, third = _schedules([full[i : i + 8] for i in (0, 8, 16)])
        self.rounds = (first, second[::-1], third)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        """n native 64-bit words to n words, each the big-endian value of a block."""
        return _encrypt(blocks, tuple(s.__getitem__ for s in self.rounds))

    def chain(self, block: int, count: int) -> list[int]:
        """Each block the encryption of the one before: serial, so in plain integers."""
        boxes, enter, leave = (t.tolist() for t in _constant())
        keys = [[k.tolist() for k in schedule] for schedule in self.rounds]
        out = []
        for _ in range(count):
            x = sum(enter[i][block >> (56 - 8 * i) & 255] for i in range(8))
            left, right = x >> 32, x & 0xFFFFFFFF
            for schedule in keys:
                for k in schedule:
                    # The half with its last bit before and its first bit after: eight overlapping groups of six.
                    wide = (right & 1) << 33 | right << 1 | right >> 31
                    mixed = left
                    for i in range(8):
                        mixed ^= boxes[i][(wide >> (28 - 4 * i) & 63) ^ k[i]]
                    left, right = right, mixed
                left, right = right, left
            x = left << 32 | right
            block = sum(leave[i][x >> (56 - 8 * i) & 255] for i in range(8))
            out.append(block)
        return out


@lru_cache(maxsize=256)
def triple_des(key: bytes) -> TripleDes:
    return TripleDes(key)


def _check_reset(reset: int) -> None:
    if reset <= 0 or reset % 8:
        raise ValueError("the restart interval must be a positive multiple of 8")


_pads: dict[bytes, np.ndarray] = {}


def _pad(key: bytes, size: int) -> np.ndarray:
    """The first bytes of a key's output-feedback stream, the same for every window; kept and made longer as needed."""
    have = _pads.get(key)
    if have is None or len(have) < size:
        if len(_pads) >= 64 and key not in _pads:
            _pads.clear()
        last = triple_des(key).iv if have is None else have[-8:].tobytes()
        more = triple_des(key).chain(int.from_bytes(last, "big"), -(-(size - (0 if have is None else len(have))) // 8))
        fresh = np.array(more, np.uint64).astype(">u8").view(np.uint8)
        have = _pads[key] = fresh if have is None else np.concatenate([have, fresh])
    return have[:size]


def ofb(key: bytes, data: bytes, reset: int = WINDOW) -> bytes:
    _check_reset(reset)
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    pad = _pad(key, min(reset, -(-len(x) // 8) * 8))
    return (x ^ np.resize(pad, len(x))).tobytes() if reset < len(x) else (x ^ pad[: len(x)]).tobytes()


def _blocks(data: bytes) -> np.ndarray:
    x = np.frombuffer(data + bytes(-len(data) % 8), ">u8")
    return x.astype(np.uint64)


def cfb64_decrypt(key: bytes, data: bytes, reset: int = WINDOW) -> bytes:
    """Every block needs only the ciphertext before it, so all are done at once."""
    _check_reset(reset)
    if not data:
        return b""
    cipher, x = triple_des(key), _blocks(data)
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[:: reset // 8] = np.frombuffer(cipher.iv, ">u8")[0]
    return (x ^ cipher.encrypt(before)).astype(">u8").tobytes()[: len(data)]


def cfb64_encrypt(key: bytes, data: bytes, reset: int = WINDOW) -> bytes:
    """Serial within a window; windows side by side."""
    _check_reset(reset)
    if not data:
        return b""
    cipher, x = triple_des(key), _blocks(data)
    per = min(reset // 8, len(x))
    grid = np.zeros(-(-len(x) // per) * per, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(-1, per)
    feedback = np.full(len(grid), np.frombuffer(cipher.iv, ">u8")[0], np.uint64)
    for i in range(per):
        feedback = grid[:, i] ^ cipher.encrypt(feedback)
        grid[:, i] = feedback
    return grid.ravel()[: len(x)].astype(">u8").tobytes()[: len(data)]


def _windows(parts: list[bytes], reset: int) -> tuple[bytes, list[int]]:
    """Parts one after the other, each padded to whole windows, and where each begins."""
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += -(-len(p) // reset) * reset
    return b"".join(p + bytes(-len(p) % reset) for p in parts), starts


def many(run, key: bytes, parts: list[bytes], reset: int = WINDOW) -> list[bytes]:
    """A mode over many payloads of one key in one call: windows don't depend on each other."""
    _check_reset(reset)
    whole, starts = _windows(parts, reset)
    out = run(key, whole, reset)
    return [out[s : s + len(p)] for s, p in zip(starts, parts, strict=True)]


class KeyRing:
    """Many keys, whose blocks are encrypted together."""

    def __init__(self, keys: list[bytes]):
        self.place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        full = [_full(k) for k in self.place]
        self.iv = np.frombuffer(b"".join(k[:8] for k in full), ">u8").astype(np.uint64)
        first, second, third = (_schedules([k[i : i + 8] for k in full]) for i in (0, 8, 16))
        self.rounds = (first, second[:, ::-1], third)

    def encrypt(self, blocks: np.ndarray, owner: np.ndarray) -> np.ndarray:
        if len(self.iv) == 1:
            return _encrypt(blocks, tuple(s[0].__getitem__ for s in self.rounds))

        def keyed(schedule: np.ndarray):
            return lambda r: np.ascontiguousarray(schedule[:, r].T)[:, owner]

        return _encrypt(blocks, tuple(map(keyed, self.rounds)))

    def pads(self, size: int) -> np.ndarray:
        """The output-feedback streams of a window, a row for each key."""
        out, owner, block = [], np.arange(len(self.iv)), self.iv
        for _ in range(-(-size // 8)):
            block = self.encrypt(block, owner)
            out.append(block)
        return np.stack(out, 1).astype(">u8").view(np.uint8)[:, :size]


#: Bytes of payloads that are worked on at once.
_AT_ONCE = 512 << 10


def decrypt_parts(mode: str, keys: list[bytes], parts: list[bytes], reset: int = WINDOW) -> list[bytes]:
    """Many payloads, each with its key, in one of the modes none, ofb and cfb64; keys and payloads are worked on together."""
    _check_reset(reset)
    if mode == "none" or not parts:
        return list(parts)
    ring = KeyRing(keys)
    pads = ring.pads(reset) if mode == "ofb" else None
    out, i = [], 0
    while i < len(parts):
        j, held = i, 0
        while j < len(parts) and (j == i or held + len(parts[j]) <= _AT_ONCE):
            held += len(parts[j]) + reset
            j += 1
        whole, starts = _windows(parts[i:j], reset)
        n = [-(-len(p) // reset) for p in parts[i:j]]
        owner = np.repeat([ring.place[k] for k in keys[i:j]], n)
        if not len(owner):
            plain = b""
        elif mode == "ofb":
            plain = (np.frombuffer(whole, np.uint8).reshape(-1, reset) ^ pads[owner]).tobytes()
        else:
            x = np.frombuffer(whole, ">u8").astype(np.uint64).reshape(-1, reset // 8)
            before = np.concatenate([ring.iv[owner][:, None], x[:, :-1]], 1).ravel()
            plain = (x.ravel() ^ ring.encrypt(before, np.repeat(owner, reset // 8))).astype(">u8").tobytes()
        out += [plain[s : s + len(p)] for s, p in zip(starts, parts[i:j], strict=True)]
        i = j
    return out


def encrypt_parts(mode: str, keys: list[bytes], parts: list[bytes], reset: int = WINDOW) -> list[bytes]:
    """Many payloads, each with its key, encrypted in one of the modes none, ofb and cfb64; all windows of all keys side by side."""
    if mode != "cfb64" or not parts:
        return decrypt_parts(mode, keys, parts, reset)
    _check_reset(reset)
    ring = KeyRing(keys)
    out, i = [], 0
    while i < len(parts):
        j, held = i, 0
        # A step is one block of each window, so that many windows are worth their room.
        while j < len(parts) and (j == i or held + len(parts[j]) <= 8 * _AT_ONCE):
            held += len(parts[j]) + reset
            j += 1
        whole, starts = _windows(parts[i:j], reset)
        grid = np.frombuffer(whole, ">u8").astype(np.uint64).reshape(-1, reset // 8)
        owner = np.repeat([ring.place[k] for k in keys[i:j]], [-(-len(p) // reset) for p in parts[i:j]]).astype(np.int64)
        feedback = ring.iv[owner]
        for block in range(reset // 8 if len(owner) else 0):
            feedback = grid[:, block] ^ ring.encrypt(feedback, owner)
            grid[:, block] = feedback
        done = grid.astype(">u8").tobytes()
        out += [done[s : s + len(p)] for s, p in zip(starts, parts[i:j], strict=True)]
        i = j
    return out


def feedback_pads(keys: list[bytes], parts: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """For each payload what cipher feedback without a restart is combined with, a 64-bit word a block, and the word that stands at restarts."""
    ring, out, i = KeyRing(keys), [], 0
    place = [ring.place[k] for k in keys]
    fresh = ring.encrypt(ring.iv, np.arange(len(ring.iv))) if keys else None
    while i < len(parts):
        j, held = i, 0
        while j < len(parts) and (j == i or held + len(parts[j]) <= _AT_ONCE):
            held += len(parts[j])
            j += 1
        n = np.array([-(-len(p) // 8) for p in parts[i:j]], np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        x = np.frombuffer(b"".join(p + bytes(-len(p) % 8) for p in parts[i:j]), ">u8").astype(np.uint64)
        owner = np.array(place[i:j], np.int64)
        before = np.concatenate([np.zeros(min(1, len(x)), np.uint64), x[:-1]])
        some = n > 0
        before[starts[:-1][some]] = ring.iv[owner[some]]
        pads = ring.encrypt(before, np.repeat(owner, n))
        out += [(pads[a:b], int(fresh[o])) for a, b, o in zip(starts[:-1].tolist(), starts[1:].tolist(), place[i:j], strict=True)]
        i = j
    return out


def decrypt_prefixes(mode: str, keys: list[bytes], parts: list[bytes], resets: list[int]) -> list[bytes]:
    """Many payloads or beginnings of them, each with its key and restart interval, in one of the modes ofb, cfb64 and cfb8; blocks are worked on together."""
    out: list[bytes] = []
    if mode == "ofb":
        return [ofb(k, p, r) for k, p, r in zip(keys, parts, resets, strict=True)]
    i, size = 0, 1 if mode == "cfb8" else 8
    while i < len(parts):
        j, held = i, 0
        while j < len(parts) and (j == i or held + len(parts[j]) <= _AT_ONCE * size // 16):
            held += len(parts[j])
            j += 1
        # Each part stands behind its first block of feedback.
        sizes = np.array([-(-len(p) // 8) * 8 for p in parts[i:j]], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(p + bytes(-len(p) % 8) for p in parts[i:j]), np.uint8)
        ring = KeyRing(keys[i:j])
        owner = np.array([ring.place[k] for k in keys[i:j]], np.int64)
        if mode == "cfb64":
            x = data.view(">u8").astype(np.uint64)
            n = sizes // 8
            inside = np.arange(len(x)) - np.repeat(starts[:-1] // 8, n)
            before = np.concatenate([np.zeros(min(1, len(x)), np.uint64), x[:-1]])
            owners = np.repeat(owner, n)
            new = inside % np.repeat(np.array(resets[i:j], np.int64) // 8, n) == 0
            before[new] = ring.iv[owners[new]]
            plain = (x ^ ring.encrypt(before, owners)).astype(">u8").tobytes()
        else:
            inside = np.arange(len(data)) - np.repeat(starts[:-1], sizes)
            owners = np.repeat(owner, sizes)
            at = inside % np.repeat(np.maximum(np.array(resets[i:j], np.int64), 8), sizes)
            iv = ring.iv.astype(">u8").view(np.uint8).reshape(-1, 8)
            back = np.arange(len(data))[:, None] - 8 + np.arange(8)
            held_ = np.where(at[:, None] + np.arange(8) < 8, iv[owners[:, None], np.minimum(at[:, None] + np.arange(8), 7)], data[np.maximum(back, 0)])
            pad = ring.encrypt(np.ascontiguousarray(held_).view(">u8").ravel().astype(np.uint64), owners)
            plain = (data ^ (pad >> np.uint64(56)).astype(np.uint8)).tobytes()
        out += [plain[s : s + len(p)] for s, p in zip(starts.tolist(), parts[i:j], strict=False)]
        i = j
    return out


def cfb8_decrypt(key: bytes, data: bytes, reset: int = WINDOW) -> bytes:
    """8-bit feedback, a candidate that the mode sweep tries."""
    _check_reset(reset)
    if not data:
        return b""
    x = np.frombuffer(data, np.uint8)
    cipher, out = triple_des(key), np.empty(len(x), np.uint8)
    iv = np.frombuffer(cipher.iv, np.uint8)
    step = max(reset, 8)
    for start in range(0, len(x), 1 << 16):  # bounded working memory; a piece starts with what came before it
        end = min(len(x), start + (1 << 16))
        at = np.arange(start, end)
        own = at // step * step
        window = at[:, None] - 8 + np.arange(8)
        held = np.where(window < own[:, None], iv[np.clip(window - own[:, None] + 8, 0, 7)], x[np.maximum(window, 0)])
        pad = cipher.encrypt(np.ascontiguousarray(held).view(">u8").ravel().astype(np.uint64))
        out[start:end] = x[start:end] ^ (pad >> np.uint64(56)).astype(np.uint8)
    return out.tobytes()


MODES = ("none", "ofb", "cfb64")
DECRYPT = {"none": lambda key, data, reset=WINDOW: data, "ofb": ofb, "cfb64": cfb64_decrypt, "cfb8": cfb8_decrypt}
ENCRYPT = {"none": lambda key, data, reset=WINDOW: data, "ofb": ofb, "cfb64": cfb64_encrypt}


def unwrap_key(blob: bytes) -> bytes:
    """Key of a wrapped blob: a modular power of it holds a length and the key, all little-endian."""
    if len(blob) != RSA_BYTES:
        raise KeyLengthError(f"wrapped key of {len(blob)} bytes, not {RSA_BYTES}")
    value = pow(int.from_bytes(blob, "little"), int.from_bytes(bytes.fromhex(EXPONENT), "little"), int.from_bytes(bytes.fromhex(MODULUS), "little"))
    plain = value.to_bytes(RSA_BYTES, "little")
    size = int.from_bytes(plain[:4], "little")
    if not 0 < size <= MAX_KEY:
        raise UnwrapError(f"unwrapped length {size} is not that of a key (1 to {MAX_KEY}); the blob may be wrapped for another key pair")
    return plain[4 : 4 + size]


def inflate(data: bytes) -> tuple[int | None, str | None]:
    """Inflated size, or the reason why there is none. Output is dropped as it comes."""
    if not data:
        return None, "empty stream"
    z, size = zlib.decompressobj(), 0
    try:
        while not z.eof:
            piece = z.decompress(data, 1 << 16)
            size += len(piece)
            data = z.unconsumed_tail
            if not data and not piece and not z.eof:
                return None, "truncated deflate stream"
    except zlib.error as e:
        return None, str(e)
    return size, None
