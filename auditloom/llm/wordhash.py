"""Vectorised words and their 64-bit hashes over UTF-8 bytes.

A word's hash depends on its bytes alone. Polynomial sums with a large odd base are
taken over whole buffers, so a long text costs the same per byte as a short one; the
final mixing spreads them over all 64 bits. Texts are handled in pieces cut at blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed values of the mixing function (splitmix64).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 18

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE, np.uint64))).cumprod(dtype=np.uint64)
            _inverse = np.concatenate(([np.uint64(1)], np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64))).cumprod(dtype=np.uint64)
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def pieces(data: bytes) -> Iterator[np.ndarray]:
    """Parts of data of about PIECE bytes, cut where a blank stands."""
    buf, at = np.frombuffer(data, np.uint8), 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        while end < len(buf):
            stop = np.flatnonzero(IS_BLANK[buf[end : end + PIECE]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(buf), end + PIECE)
        yield buf[at:end]
        at = end


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~IS_BLANK[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=run[1:])
        return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """One hash for each word of data, in order; A-Z as a-z if lower."""
    out = []
    for buf in pieces(data):
        buf = _LOWER[buf] if lower else buf
        s, e = spans(buf)
        out.append(hashes(buf, s, e))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def batch_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of many texts, one after the other, and each text's word count.
    Short texts are joined, so that numpy works on buffers of PIECE bytes."""
    out, counts = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    size = first = 0

    def flush(upto: int) -> None:
        nonlocal held, size, first
        if held:
            buf = np.frombuffer(b" ".join(held), np.uint8)
            buf = _LOWER[buf] if lower else buf
            s, e = spans(buf)
            out.append(hashes(buf, s, e))
            ends = np.cumsum([len(x) + 1 for x in held])
            counts[first:upto] = np.diff(np.searchsorted(s, ends), prepend=0)
        held, size, first = [], 0, upto

    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            flush(i)
            own = word_hashes(data, lower)
            out.append(own)
            counts[i] = len(own)
            first = i + 1
            continue
        held.append(data)
        size += len(data)
        if size > PIECE:
            flush(i + 1)
    flush(len(texts))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * np.uint64(_BASE) + words[k : k + count])
    return h
