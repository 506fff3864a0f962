"""Token sets of texts as 64-bit hashes, and what stands for parts of a set, made inside tasks.

Two sets of a and b tokens with a Jaccard similarity of t or more differ in at most
``(1 - t) / (1 + t) * (a + b)`` tokens. If hashes deal all tokens into more parts than that,
some part of both sets is the same (Arasu, Ganti and Kaushik 2006), so similar sets share
the signature of a part: the hash of its tokens, of its number and of a class of sizes.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np

from thoughtloom.functions.text import LONG_TOKENS

_MULTIPLIER, _FINALIZER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_BLOCK = 1 << 17
_LARGEST = 1 << 40
_CJK = re.compile("[一-鿿]")
_BLANK = 32
#: Bytes of a token stay, others become blanks.
_KEPT = bytes(b if re.match(rb"[a-z0-9_./:-]", bytes([b])) else _BLANK for b in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = (h ^ (h >> np.uint64(33))) * _FINALIZER
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64."""
    steps = np.full((2, n), [[_MULTIPLIER], [np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))]], np.uint64)
    steps[:, 0] = 1
    return tuple(np.cumprod(steps, axis=1))


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, its bytes being digits to the base of the multiplier."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        first = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
        block = data[first : ends[stop - 1]]
        power, inverse = _powers(max(_BLOCK, 1 << (len(block) - 1).bit_length()))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)], out=sums[1:])
        a, b = starts[at:stop] - first, ends[at:stop] - first
        out[at:stop] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        at = stop
    return mixed(out)


def _spelled(normal: str) -> bytes:
    """The tokens of a normalized text (and single characters) between blanks."""
    if not normal.isascii() and _CJK.search(normal):
        return " ".join(LONG_TOKENS.findall(normal)).encode()
    return normal.encode().translate(_KEPT)


def distinct(hashes: np.ndarray, owners: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each of ``count`` ascending owners in ascending order, and their number by owner."""
    hashes, ends = hashes.copy(), np.searchsorted(owners, np.arange(count), "right").tolist()
    for start, end in zip([0, *ends[:-1]], ends, strict=True):
        hashes[start:end].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[fresh], np.bincount(owners[fresh], minlength=count)


def token_sets(normals: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``tokens_of`` each normalized text, ascending, and their number by text."""
    spelled = [_spelled(t or "") for t in normals]
    data = np.frombuffer(b" ".join(spelled), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != _BLANK
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    whole = ends - starts >= 2
    starts, ends = starts[whole], ends[whole]
    firsts = np.cumsum([0, *[len(s) + 1 for s in spelled[:-1]]])
    return distinct(_span_hashes(data, starts, ends), np.searchsorted(firsts, starts, "right") - 1, len(normals))


def set_digests(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each set; none for an empty one."""
    ends = np.cumsum(sizes).tolist()
    return [hashlib.blake2b(hashes[b - n : b].tobytes(), digest_size=16).digest() if n else None for b, n in zip(ends, sizes.tolist(), strict=True)]


@lru_cache(maxsize=8)
def size_classes(num: int, den: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each class, and the number of parts into which its sets are dealt.

    A set of class k is similar to sets of class k - 1 or more only, if none is larger.
    """
    lows = [least]
    while lows[-1] < _LARGEST and num < den:
        lows.append(max(lows[-1] + 1, (lows[-1] - 1) * den // num + 1))
    parts = [(den - num) * 2 * (high - 1) // (den + num) + 1 for high in lows[1:]]
    return np.array(lows[:-1] or [_LARGEST]), np.array(parts or [1])


def signatures(hashes: np.ndarray, sizes: np.ndarray, salts: np.ndarray, classes, up: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set in the parts of its own class of sizes (``up`` 0) or the next (1), and their number."""
    lows, parts = classes
    family = np.searchsorted(lows, sizes, "right") - 1 + up
    count = np.where(sizes >= lows[0], parts[family], 0)
    held = np.repeat(sizes >= lows[0], sizes)
    many = np.repeat(count, sizes)[held].astype(np.uint64)
    base = np.repeat(np.cumsum(count) - count, sizes)[held]
    part = ((hashes[held] >> np.uint64(32)) * many >> np.uint64(32)).astype(np.int64)
    filled = np.bincount(base + part, minlength=int(count.sum()))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(mixed(hashes[held]), out=sums[1:])
    ends = np.cumsum(filled)
    content = sums[ends] - sums[ends - filled]
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    label = (np.repeat(family, count).astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
    return mixed(content + mixed(label + np.repeat(salts, count))), count


def salts(scopes: list) -> np.ndarray:
    """A number for each scope, so that sets of different scopes share no signature."""
    known = {s: int.from_bytes(hashlib.blake2b(str(s).encode(), digest_size=8).digest(), "little") for s in set(scopes)}
    return np.array([known[s] for s in scopes], np.uint64)
