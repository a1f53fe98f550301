"""64-bit hashes of runs of words, vectorised over a text's bytes; the same in every process."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size, base = max(1 << 16, 1 << n.bit_length()), 0xD1342543DE82EF95
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def runs(flat: bytes, words: int) -> np.ndarray:
    """A hash of each run of `words` words of a text with single blanks, from prefix sums; fewer words: one of all."""
    if not flat:
        return np.empty(0, np.uint64)
    b = np.frombuffer(flat, dtype=np.uint8)
    up, down = _powers(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * up[: len(b)], dtype=np.uint64)))
    gaps = np.flatnonzero(b == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(b)]))
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = (starts, ends) if words == 1 else (starts[:1], ends[-1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * ODD)
