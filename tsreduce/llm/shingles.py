"""Word shingles as 64-bit hashes, a whole text at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONGEST = 4096


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers for each seed (the finalizer of splitmix64)."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The first n bytes of a little-endian lane of 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _raw(text: pa.StringScalar | str | None) -> bytes:
    if isinstance(text, pa.Scalar):
        return text.as_buffer().to_pybytes() if text.is_valid else b""
    return text.encode("utf-8", "surrogatepass") if text else b""


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first byte) of the words of bytes in lower case."""
    n = len(raw)
    raw += bytes(8)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(raw, np.uint8, n)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    lanes = np.ndarray((n + 1,), "<u8", raw, strides=(1,))  # the 8 bytes from each byte on
    h = (_A * size.astype(np.uint64)) ^ (lanes[start] & _FIRST[np.minimum(size, 8)])
    h = (h ^ (h >> np.uint64(32))) * _B
    longer, at = np.flatnonzero((size > 8) & (size <= _LONGEST)), 8
    while len(longer):
        x = h[longer] ^ (lanes[start[longer] + at] & _FIRST[np.minimum(size[longer] - at, 8)])
        h[longer] = (x ^ (x >> np.uint64(32))) * _B
        at += 8
        longer = longer[size[longer] > at]
    for i in np.flatnonzero(size > _LONGEST):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]])
    return mix(h), start


def word_starts(raw: bytes) -> np.ndarray:
    """The first byte of each word."""
    space = np.ones(len(raw) + 1, bool)
    space[1:] = _SPACE[np.frombuffer(raw, np.uint8)] if raw else True
    return np.flatnonzero(space[:-1] & ~space[1:])


def word_hashes(texts: Iterable, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words: what ASCII white space divides, A-Z lower-cased. Null has none."""
    held, size = [], 0
    for text in texts:
        held.append(_raw(text))
        size += len(held[-1])
        if size >= at_once:
            yield from _split(held)
            held, size = [], 0
    yield from _split(held)


def _split(held: list[bytes]) -> Iterator[np.ndarray]:
    if held:
        w, start = _hashes(b"\n".join(held).lower())
        ends = np.cumsum([len(r) + 1 for r in held])
        yield from np.split(w, np.searchsorted(start, ends[:-1]))


def rolling(w: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width words, from their hashes; of fewer words, the one of the whole sequence; none without words."""
    if not len(w):
        return w
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i : i + n]) * _A
        h ^= h >> np.uint64(29)
    return mix(h)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and how often each occurs."""
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(first, append=len(h))


def shingles(texts: Iterable, width: int, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each text, the hashes of its runs of width words in order; of fewer words, the one of the whole sequence."""
    held, size = [], 0
    for w in word_hashes(texts, at_once):
        held.append(w)
        size += len(w)
        if size >= at_once // 4:
            yield from _rolled(held, width)
            held, size = [], 0
    yield from _rolled(held, width)


def _rolled(held: list[np.ndarray], width: int) -> Iterator[np.ndarray]:
    if held:
        h = rolling(np.concatenate(held), width)
        at = 0
        for w in held:
            yield h[at : at + len(w) - width + 1] if len(w) >= width else rolling(w, width)
            at += len(w)


def shingle_sets(texts: Iterable, width: int) -> Iterator[np.ndarray]:
    return map(distinct, shingles(texts, width))


def digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())
