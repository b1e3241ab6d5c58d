"""Words of whole texts as 64-bit hashes, computed for many texts at once with numpy inside tasks."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20  # bytes hashed at once; a longer word extends its segment
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of PRIME and of its inverse, kept per process and never sent along with a function."""

    def __init__(self):
        self.held: tuple[np.ndarray, np.ndarray] | None = None

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.held is None or len(self.held[0]) < n:
            up, down = (np.cumprod(np.full(max(n, SEGMENT + 1), p, np.uint64)) for p in (PRIME, INVERSE))
            self.held = up, down
        return self.held

    def __reduce__(self):
        return Powers, ()


powers = Powers()


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a stretch of bytes."""
    edges = np.flatnonzero(np.diff(IN_WORD[data].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(data))
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])
    total = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return starts, mixed(total * down[starts])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): text k has the words ``hashes[offsets[k]:offsets[k + 1]]``.

    A word is a run of letters and digits of the lower-cased text (any byte outside ASCII counts as a letter)."""
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded])))
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        to = min(at + SEGMENT, len(data))
        while to < len(data) and IN_WORD[data[to - 1]] and IN_WORD[data[to]]:
            more = np.flatnonzero(~IN_WORD[data[to:to + SEGMENT]])
            to += int(more[0]) if len(more) else min(SEGMENT, len(data) - to)
        s, h = hashed(data[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def chunks(texts: list[str | None], size: int = 2_000_000):
    """(first, stop) ranges of texts of about ``size`` characters, each with one text at least."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
