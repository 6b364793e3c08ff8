"""Column expressions over binary data: integers, slices, searches, hex, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le_hex(digits: str, at: str, size: int) -> str:
    """SQL for the little-endian unsigned integer of `size` bytes at byte `at` of data given in hex digits."""
    pairs = ", ".join(f"substr({digits}, 2 * ({at} + {i}) + 1, 2)" for i in reversed(range(size)))
    return f"try_cast(conv(concat({pairs}), 16, 10) AS bigint)"


def le_uint(data: Column, size: int = 4) -> Column:
    """Little-endian unsigned integer of a binary's first bytes, zero-padded; null for null."""
    digits = F.rpad(F.hex(F.substring(data, 1, size)), 2 * size, "0")
    parts = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def piece(data: Column, offset: Column, length: Column) -> Column:
    """Bytes of a section."""
    return data.substr(offset.cast("int") + 1, length.cast("int"))


def latin1(data: Column) -> Column:
    """One character for each byte, so that string functions give byte positions."""
    return F.decode(data, "ISO-8859-1")


def find(data: Column, needle: str, start: Column | int = 0) -> Column:
    """0-based position of the first occurrence at or after `start`; null if there is none."""
    at = F.locate(needle, latin1(data), 1) if isinstance(start, int) and not start else F.call_function("locate", F.lit(needle), latin1(data), (start if isinstance(start, Column) else F.lit(start)) + 1)
    return F.when(at > 0, at - 1)


def rfind(data: Column, needle: str) -> Column:
    """0-based position of the last occurrence; null if there is none."""
    text = latin1(data)
    tail = F.substring_index(text, needle, -1)
    return F.when(F.contains(data, F.lit(needle.encode())), F.length(text) - F.length(tail) - len(needle))


def has(data: Column, needle: bytes) -> Column:
    return F.contains(data, F.lit(needle))


def hex_decode(text: Column) -> Column:
    """Bytes of hex digits in which ASCII white space is ignored; null for a bad digit or an odd count."""
    digits = F.regexp_replace(text, r"[\t\n\x0C\r ]", "")
    return F.when(F.length(digits) % 2 == 0, F.try_to_binary(digits, F.lit("hex")))


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def read_uint(data: Column, start: Column) -> Column:
    """Struct (value, next) of the unsigned decimal at a byte; null if there is none or it passes a long."""
    digits = F.regexp_extract(latin1(data).substr(start + 1, F.lit(40)), "^[0-9]+", 0)
    value = digits.try_cast("bigint")
    return F.when((digits != "") & value.isNotNull(), F.struct(value.alias("value"), (start + F.length(digits)).alias("next")))


def skip_space(data: Column, start: Column) -> Column:
    """The first byte at or after `start` that is not NUL, tab, newline, form feed, return or space."""
    rest = F.substring(latin1(data), start + 1, F.length(data))
    return start + F.length(F.regexp_extract(rest, "^[\\x00\\t\\n\\x0C\\r ]*", 0))


def grouped(n: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(n, 0)


def printable(data: Column) -> Column:
    """Graphic ASCII characters, everything else as single spaces."""
    return F.trim(F.regexp_replace(latin1(data), "[^!-~]+", " "))


def wrap(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, cut at white space; a longer word stays whole."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    none = F.expr("cast(array() AS array<string>)")

    def add(state: Column, word: Column) -> Column:
        last = F.element_at(state, -1)
        fits = (F.size(state) > 0) & (F.char_length(last) + 1 + F.char_length(word) <= width)
        return F.when(fits, F.concat(F.slice(state, 1, F.size(state) - 1), F.array(F.concat_ws(" ", last, word)))).otherwise(F.concat(state, F.array(word)))

    return F.aggregate(words, none, lambda s, w: F.when(F.size(s) > 0, add(s, w)).otherwise(F.array(w)))
