"""Vectorised hashes of words, runs of words and byte strings over a block of texts.

A hash of a stretch is the difference of two prefix sums of a polynomial modulo 2**64 over randomly mapped symbols,
moved to position zero by a power of the base's inverse and mixed. Nothing depends on the process, so all workers agree.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
#: Random 64-bit image of each byte.
IMAGE = _RNG.integers(1, 2**64, size=256, dtype=np.uint64)
BASE = int(_RNG.integers(2**60, 2**64, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 2**64)


class _Powers:
    """Powers of a number modulo 2**64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.held = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.held) < n:
            factor = np.uint64(pow(self.base, len(self.held), 2**64))
            self.held = np.concatenate([self.held, self.held * factor])
        return self.held[:n]


_POWERS, _INVERSES = _Powers(BASE), _Powers(INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Stretches:
    """Hashes of any stretch of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _POWERS.upto(n), out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _INVERSES.upto(len(self.prefix))
        return mix((self.prefix[end] - self.prefix[start]) * back[start] + (end - start).astype(np.uint64))


def split_words(texts: list[str | None]) -> list[list[bytes]]:
    """UTF-8 words between ASCII white space, which is what bytes.split() takes."""
    return [t.encode().split() if t else [] for t in texts]


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block of texts, and the offset of each text's first word (one more at the end)."""
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    joined = np.frombuffer(b" ".join([b" ".join(w) for w in words if w]) + b" ", np.uint8)
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return Stretches(IMAGE[joined]).hash(starts, ends), offsets


def shingles(words: list[list[bytes]], n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text, sorted; a shorter text is one shingle, a text without words none."""
    hashes, offsets = word_hashes(words)
    if not len(hashes):
        return [hashes for _ in words]
    first = np.arange(len(hashes), dtype=np.int64)
    runs = Stretches(hashes)
    whole = runs.hash(first, np.minimum(first + n, len(hashes)))
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(runs.hash(np.array([a]), np.array([b])) if b > a else hashes[:0])
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value of each window of ``width`` values, the rightmost of equal ones; by doubling."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    at, reach = np.arange(n, dtype=np.int64), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] <= values[left], right, left)
        reach += step
    return at


#: Symbols of a block: positions take the low bits beside a hash.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


def blocks(lengths: list[int], window: int):
    """Lists of (sequence, start, end) that hold up to BLOCK symbols together.

    A sequence longer than a block is cut into parts that overlap by a window less one, so that each window lies in
    just one part.
    """
    held, size = [], 0
    for k, n in enumerate(lengths):
        start = 0
        while n - start >= window:
            end = min(n, start + BLOCK)
            if size + end - start > BLOCK and held:
                yield held
                held, size = [], 0
            held.append((k, start, end))
            size += end - start
            start = end - window + 1
    if held:
        yield held


def anchor_runs(symbols: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> dict[str, np.ndarray]:
    """Winnowing: which gram each window of a block's sequences selects, as runs of windows that share it.

    Of a window's grams that with the least hash is its anchor, so the anchor follows from the window's content. Arrays:
    part (index of the sequence), anchor, low and high (first and last window start of the run), all counted from the
    sequence's start; mark (hash of the gram) and context (hash of everything the run's windows cover, and how it lies
    around the anchor).
    """
    runs, n = Stretches(symbols), len(symbols)
    wide = window - gram + 1
    grams = runs.prefix[gram:] - runs.prefix[:-gram]
    grams = mix(grams * _INVERSES.upto(n + 1)[: len(grams)] + np.uint64(gram))
    packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(packed) % wide
    table = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(packed) - wide + 1], ahead[wide - 1 : len(packed)]) & _PLACE

    sizes = np.diff(offsets)
    windows = np.maximum(sizes - window + 1, 0)
    part = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets[:-1], windows)
    anchor = least[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]]) if len(first) else first
    low, high, at, of = start[first], start[last], anchor[first], part[first]
    context = mix(runs.hash(low, high + window) + (at - low).astype(np.uint64))
    base = offsets[:-1][of] if len(of) else low
    return {"part": of, "anchor": at - base, "low": low - base, "high": high - base, "mark": grams[at], "context": context}


#: A run of windows as one long: first window start, then the anchor's and the last start's distance from it.
def pack_run(low: np.ndarray, anchor: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low << 24) | ((anchor - low) << 12) | (high - low)


def unpack_run(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = run >> 24
    return low, low + ((run >> 12) & 4095), low + (run & 4095)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals [start, end) as disjoint intervals that don't touch."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
