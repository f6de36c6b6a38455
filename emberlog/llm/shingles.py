"""Word-shingle sets of whole texts as sorted 64-bit hashes, in numpy, for a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)]
_SHORT = _rng.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, name: str, base: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, CHUNK + 1), base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers[name]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(raw) and not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _power(len(raw), "up", _BASE)[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[start]) * _power(len(raw) + 1, "down", _INVERSE)[start]
    h = mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(start, ends)
    return h, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than five words has its sequence as one."""
    h, counts = word_hashes(texts)
    n = max(0, len(h) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s += h[k : n + k] * _PLACE[k]
    s = mixed(s)
    out = []
    at = 0
    for c in counts.tolist():
        if c >= SHINGLE:
            own = s[at : at + c - SHINGLE + 1]
            own.sort()
            new = own[1:] != own[:-1]
            out.append(own if new.all() else np.concatenate((own[:1], own[1:][new])))
        elif c:
            x = np.full(1, _SHORT[c], np.uint64)
            for k in range(c):
                x += h[at + k : at + k + 1] * _PLACE[k]
            out.append(mixed(x))
        else:
            out.append(h[:0])
        at += c
    return out


def sets_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[int], pa.RecordBatch, list[np.ndarray]]]:
    """The shingle sets of a text column, about CHUNK bytes at a time: (row numbers, their batch, sets)."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for k, text in enumerate(batch.column(column)):
            t = (text.as_py() or "").encode()
            rows.append(k)
            texts.append(t)
            held += len(t)
            if held >= CHUNK:
                yield rows, batch, shingle_sets(texts)
                rows, texts, held = [], [], 0
        if rows:
            yield rows, batch, shingle_sets(texts)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two signed numbers; 0 and 0 for an empty one."""
    sums = np.zeros((len(sets), 2), np.int64)
    full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    if len(full):
        flat = np.concatenate([sets[k] for k in full])
        starts = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
        for j, salt in enumerate((0x51ED270B, 0x2545F491)):
            sums[full, j] = np.add.reduceat(mixed(flat, salt), starts).astype(np.int64)
    return sums
