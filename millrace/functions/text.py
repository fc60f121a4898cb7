"""Tolerant numbers, number formats, paths, and digests on string columns."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def str2num(x, kind: str = "decimal(38,18)") -> Column:
    """A lenient number: `$` and `,` are dropped, a leading point gets a zero, one trailing `%` divides by 100; else NULL."""
    s = F.regexp_replace(F.trim(_c(x)), r"[$,]", "")
    percent = s.endswith("%")
    s = F.when(percent, s.substr(F.lit(1), F.length(s) - 1)).otherwise(s)
    s = F.regexp_replace(s, r"^([+-]?)\.", "$10.")
    number = s.rlike(r"^[+-]?\d+\.?\d*([eE][+-]?\d+)?$")
    value = s.try_cast(kind)
    return F.when(number, F.when(percent, value / 100).otherwise(value)).cast(kind)


def is_numeric(x) -> Column:
    return str2num(x).isNotNull()


def specific_type(x) -> Column:
    """String, Big or DateTime: a number may be in brackets, have K, M, B or %; under six characters is never a date."""
    s = F.trim(_c(x))
    number = s.rlike(r"^\(?[$+-]*[\d,]*\.?\d+[KMB%]?\)?$")
    date = (F.length(s) >= 6) & s.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
    return F.when(date, "DateTime").when(number, "Big").otherwise("String")


def num_str(x, decimals: int = 2, abbreviate: bool = False) -> Column:
    """Fixed decimals, never -0; with M or B by magnitude if asked for; N/A for NULL and NaN."""
    x = _c(x).cast("double")
    size = F.abs(x)
    unit = F.when(size >= 1e9, "B").when(size >= 1e6, "M").otherwise("") if abbreviate else F.lit("")
    scaled = F.when(size >= 1e9, x / 1e9).when(size >= 1e6, x / 1e6).otherwise(x) if abbreviate else x
    shown = F.format_string(f"%.{decimals}f", scaled)
    shown = F.when(shown.rlike(r"^-0(\.0*)?$"), shown.substr(F.lit(2), F.length(shown))).otherwise(shown)
    return F.when(x.isNull() | F.isnan(x), "N/A").otherwise(F.concat(shown, unit))


def num_str_percent(x, decimals: int = 2) -> Column:
    """A hundred times the number as it is written: in binary, 0.0045 * 100 is less than 0.45."""
    x = _c(x)
    exact = x.cast("double").try_cast("decimal(38,18)")
    hundred = F.when(F.abs(x) < 1e15, F.round(exact * 100, decimals).cast("double")).otherwise(x * 100)
    shown = num_str(hundred, decimals)
    return F.when(shown == "N/A", shown).otherwise(F.concat(shown, F.lit("%")))


#: Fixed values of the presets: decimals, factor, whether M and B are used, suffix.
FORMATS = {"default": (2, 1.0, False, ""), "abbreviated": (2, 1.0, True, ""), "percent": (2, 100.0, False, "%"), "whole percent": (0, 100.0, False, "%")}


def formatted(x, preset: str = "default", width: int = 9) -> Column:
    """A number by a preset, padded on the left to a width."""
    decimals, factor, abbreviate, suffix = FORMATS[preset]
    shown = num_str(_c(x) * factor, decimals, abbreviate)
    shown = F.when(shown == "N/A", shown).otherwise(F.concat(shown, F.lit(suffix)))
    return F.when(F.length(shown) < width, F.lpad(shown, width, " ")).otherwise(shown)


def signed(x, decimals: int) -> Column:
    """Fixed decimals with a sign, but none on what rounds to 0."""
    shown = F.format_string(f"%+.{decimals}f", _c(x).cast("double"))
    return F.when(shown.rlike(r"^[+-]0(\.0*)?$"), shown.substr(F.lit(2), F.length(shown))).otherwise(shown)


def is_number_char(x) -> Column:
    """Whether a character may be part of a number."""
    return _c(x).rlike(r"^[-+0-9.,$%eE]$")


def posix_path(x) -> Column:
    return F.regexp_replace(_c(x), r"\\", "/")


def last_segment(x) -> Column:
    return F.element_at(F.split(F.regexp_replace(posix_path(x), "/+$", ""), "/"), -1)


def extension(x) -> Column:
    """What follows the last point of the last segment; empty without one."""
    return F.regexp_extract(last_segment(x), r"\.([^.]*)$", 1)


def base_name(x) -> Column:
    """The last segment without its last suffix: empty for `.rc`."""
    return F.regexp_replace(last_segment(x), r"\.[^.]*$", "")


def parent(x) -> Column:
    return F.regexp_replace(F.regexp_replace(posix_path(x), "/+$", ""), r"/?[^/]*$", "")


def segments(x) -> Column:
    return F.filter(F.split(posix_path(x), "/"), lambda s: s != "")


def reverse_path(x) -> Column:
    return F.array_join(F.reverse(segments(x)), "/")


def drop_suffix(x, suffix: str) -> Column:
    x = _c(x)
    return F.when(x.endswith(suffix), x.substr(F.lit(1), F.length(x) - len(suffix))).otherwise(x)


def starts_with_ignore_case(x, prefix: str) -> Column:
    return F.lower(_c(x)).startswith(prefix.lower())


def lookup_ignoring_case(x, values: dict[str, str]) -> Column:
    """What a map of at most 10,000 keys has for a text, whatever its case; NULL if nothing. Of keys that are equal but for their case the last counts."""
    if len(values) > 10_000:
        raise ValueError("the map is too large for a literal; join with a table")
    low = {k.lower(): v for k, v in values.items()}
    return F.try_element_at(F.create_map(*[F.lit(y) for pair in low.items() for y in pair]), F.lower(_c(x))) if low else F.lit(None).cast("string")


def strip_prefix(x, prefix: str) -> Column:
    x = _c(x)
    return F.when(x.startswith(prefix), x.substr(F.lit(len(prefix) + 1), F.length(x))).otherwise(x)


def normalize_line(x) -> Column:
    """CRLF and CR become LF, trailing white space goes."""
    return F.regexp_replace(F.regexp_replace(_c(x), "\r\n?", "\n"), r"\s+$", "")


_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))  # each byte with its bits turned round


@F.pandas_udf(T.LongType())
def cksum(values: pd.Series) -> pd.Series:
    """POSIX cksum: CRC-32, high bit first, of the bytes and their length. NULL gives NULL.

    zlib's CRC is the same polynomial, low bit first: it is asked of bytes with their bits
    turned round, and its start and end values are undone.
    """

    def one(data):
        if data is None:
            return None
        data = data.encode() if isinstance(data, str) else bytes(data)
        whole = data + len(data).to_bytes((len(data).bit_length() + 7) // 8, "little")
        crc = zlib.crc32(whole.translate(_TURNED), 0xFFFFFFFF)
        return int(f"{crc:032b}"[::-1], 2)

    return values.map(one).astype("Int64")


def md5(x) -> Column:
    return F.md5(_c(x))


def sha256(x) -> Column:
    return F.sha2(_c(x), 256)


#: The primes of the 64-bit hash.
_PRIMES = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
_P = [np.uint64(p) for p in _PRIMES]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes64(values: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each value, all values side by side.

    It has four lanes over chunks of 64 bytes (values under that have none), no merge of the
    lanes but their sum, then words of 8 bytes and single bytes, and ends in an avalanche.
    """
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")  # the values that still have something are the first ones
    size = size[order]
    start = np.append(0, np.cumsum(size)[:-1])
    data = np.frombuffer(b"".join(values[k] for k in order.tolist()) + bytes(64), np.uint8)
    chunks, words, ones = size // 64, size % 64 // 8, size % 8
    word = lambda at: data[at[:, None] + np.arange(8)].view("<u8")[:, 0]
    mixed = lambda acc, x: _turned(acc + x * _P[1], 31) * _P[0]
    with np.errstate(over="ignore"):
        lanes = np.tile(np.array([_P[0] + _P[1], _P[1], np.uint64(0), np.uint64(0) - _P[0]], np.uint64)[:, None], (1, len(size)))
        for c in range(int(chunks.max(initial=0))):
            n = int(np.searchsorted(-chunks, -c, "left"))  # values with more than c chunks
            for stripe in (0, 32):
                for lane in range(4):
                    lanes[lane, :n] = mixed(lanes[lane, :n], word(start[:n] + 64 * c + stripe + 8 * lane))
        h = np.where(chunks > 0, sum(_turned(lanes[k], bits) for k, bits in enumerate((1, 7, 12, 18))), _P[4])
        h += size.astype(np.uint64)
        for k in range(7):
            on = np.flatnonzero(words > k)
            h[on] = _turned(h[on] ^ mixed(np.uint64(0), word(start[on] + 64 * chunks[on] + 8 * k)), 27) * _P[0] + _P[3]
        for k in range(7):
            on = np.flatnonzero(ones > k)
            h[on] = _turned(h[on] ^ data[start[on] + size[on] - ones[on] + k].astype(np.uint64) * _P[4], 11) * _P[0]
        for shift, prime in ((33, _P[1]), (29, _P[2])):
            h = (h ^ (h >> np.uint64(shift))) * prime
        h ^= h >> np.uint64(32)
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(T.StringType())
def hash64(values: pd.Series) -> pd.Series:
    """The 64-bit hash of a text's UTF-8 bytes or of binary, as 16 hexadecimal digits. NULL gives NULL."""
    there = values.notna()
    found = hashes64([v.encode() if isinstance(v, str) else bytes(v) for v in values[there]])
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    out[there] = [f"{h:016x}" for h in found.tolist()]
    return out
