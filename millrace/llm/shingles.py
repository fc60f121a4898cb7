"""Word shingles as 64-bit hashes, for many texts at once and without a loop over words."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from millrace.llm.common import WHITE, mix64

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[list(WHITE)] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _A, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of several texts laid end to end with a line feed between them."""

    hashes: np.ndarray
    bounds: np.ndarray  # of each text's words, one more than texts
    feeds: np.ndarray  # line feeds before each word
    last: np.ndarray  # last byte of each word


def words(texts: list[bytes], lower: bool = True) -> Words:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in order; A to Z are lower-cased before hashing."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    blank = _BLANK[data]
    solid = np.flatnonzero(~blank)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(solid):
        return Words(np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))
    first = np.flatnonzero(np.append(True, solid[1:] != solid[:-1] + 1))  # where words start among the solid bytes
    sizes = np.diff(np.append(first, len(solid)))
    place = np.arange(len(solid)) - np.repeat(first, sizes)
    raw = data[solid]
    bits = _BYTE[_LOWER[raw] if lower else raw]
    bits *= _powers(1 << max(6, (int(sizes.max()) - 1).bit_length()))[place]
    hashes = mix64(np.add.reduceat(bits, first) + sizes.astype(np.uint64) * _B)
    at = solid[first]
    return Words(hashes, np.append(0, np.searchsorted(at, ends)), np.cumsum(data == 10)[at], raw[first + sizes - 1])


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the bound of each text's words, and the line feeds before each word in the joined texts."""
    w = words(texts, lower)
    return w.hashes, w.bounds, w.feeds


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, by differences of one running sum."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    inverse = np.uint64(pow(int(_A), -1, 1 << 64))
    down = np.full(len(hashes), inverse, np.uint64)
    down[:1] = 1
    total = np.append(np.uint64(0), np.cumsum(hashes * np.cumprod(down, dtype=np.uint64), dtype=np.uint64))
    return mix64((total[k:] - total[:n]) * _powers(1 << max(6, (n - 1).bit_length()))[:n])


def windows(hashes: np.ndarray, groups: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k adjacent words within one group (ascending numbers of lines or texts), and their groups.

    A group with fewer than k words gives one hash of them all.
    """
    n = len(hashes) - k + 1
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(groups)))
    short = np.flatnonzero(sizes < k)
    if n > 0:
        out = hashes[:n].copy()
        for j in range(1, k):
            out = out * _A + hashes[j : n + j]
        inside = groups[:n] == groups[k - 1 :]
        out, own = mix64(out[inside]), groups[:n][inside]
    else:
        out, own = np.empty(0, np.uint64), np.empty(0, groups.dtype)
    if len(short):
        whole = []
        for a, s in zip(first[short].tolist(), sizes[short].tolist()):
            h = np.uint64(s)
            with np.errstate(over="ignore"):
                for x in hashes[a : a + s]:
                    h = h * _B + x
            whole.append(h)
        out, own = np.append(out, mix64(np.array(whole, np.uint64))), np.append(own, groups[first[short]])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def sets(hashes: np.ndarray, groups: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order within each group, the groups in order, and bounds of each group's shingles."""
    h, own = windows(hashes, groups, k)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])) if len(h) else np.empty(0, bool)
    h, own = h[new], own[new]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    return h, own[first], np.append(first, len(h))


def text_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The shingle set of each whole text, sorted; empty without words."""
    h, bounds, _ = word_hashes([t or b"" for t in texts])
    h, groups, cut = sets(h, np.repeat(np.arange(len(texts)), np.diff(bounds)), k)
    out = [np.empty(0, np.uint64)] * len(texts)
    for j, g in enumerate(groups.tolist()):
        out[g] = h[cut[j] : cut[j + 1]]
    return out


def set_ids(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal sets get equal ids."""
    if len(cut) < 2:
        return np.empty(0, np.int64)
    total = np.add.reduceat(mix64(h ^ _B), cut[:-1]) + np.diff(cut).astype(np.uint64) * _A
    return mix64(total).view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
