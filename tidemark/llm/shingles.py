"""Sets of word shingles, hashed to 64 bits over whole batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` and its inverse to the powers 0..n-1."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        ones = [np.full(size, b, U) for b in (BASE, BASE_INVERSE)]
        for x in ones:
            x[0] = 1
        _powers[:] = [np.multiply.accumulate(x) for x in ones]
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, as ascending 64-bit hashes.

    Words are runs of bytes outside ``\\x20\\x09-\\x0D``; A-Z are lower-cased.
    A shorter text is one shingle of all its words; one without words has none.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    with np.errstate(over="ignore"):
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
        up, down = _power(len(raw) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(_byte_codes()[low] * up[:-1], dtype=U)])
        before = np.concatenate([[True], space[:-1]])
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        words = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
        doc_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first = np.searchsorted(starts, doc_starts)
        grams = np.zeros(max(0, len(words) - width + 1), U)
        for k in range(width):
            grams = grams * U(0xD6E8FEB86659FD93) + words[k : k + len(grams)] if len(grams) else grams
        grams = _mixed(grams)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                whole = U(b - a)
                for w in words[a:b]:
                    whole = whole * U(0xD6E8FEB86659FD93) + w
                out.append(_mixed(np.array([whole], U)))
            else:
                out.append(np.zeros(0, U))
    return out


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut to a few MB of text, or one long text."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column))).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to
