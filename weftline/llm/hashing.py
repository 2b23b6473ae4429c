"""64-bit hashes of words for whole batches of texts at once, in numpy, the same in every process."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 2_000_000
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
        if size > 4 * CHUNK_BYTES:  # a very long text: not kept
            out = _powers.pop("up"), _powers.pop("down")
            return out
    return _powers["up"], _powers["down"]


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, times BASE^-start, hash any span of bytes."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * up[: len(raw)], out=out[1:])
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of A-Z lower-cased texts (words are runs of bytes other than blank and 9 to 13), and the
    number of words of each text."""
    raws = [t.encode().lower() for t in texts]
    raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = prefix(raw)
    _, down = powers(len(raw) + 1)
    h = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, ends, side="left"), prepend=0)


def runs(texts: list[str], most: int = CHUNK_BYTES // 2):
    """(from, to) of runs of texts of about ``most`` characters."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)
