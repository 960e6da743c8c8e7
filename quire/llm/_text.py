"""Vectorised text kernels: whole batches of texts as arrays of code points.

Texts are joined, cut into tokens by boolean arrays, and each token is known by
a 64-bit polynomial hash, so work per distinct token is done once per worker
and everything per occurrence is array arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_pw = np.ones(1, dtype=U)


def powers(n: int) -> np.ndarray:
    global _pw
    if len(_pw) < n:
        size = 1 << max(6, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _pw = np.cumprod(np.r_[U(1), np.full(size - 1, _P, dtype=U)], dtype=U)
    return _pw


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * _M1
        h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def groups(texts: list[str | None], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters; a longer text stands alone."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and total + n > chars:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined texts and each text's offset (one more at the end)."""
    lens = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    joined = "".join(t for t in texts if t)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.r_[0, np.cumsum(lens)]


def token_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Hash of each token cps[start:end]; tokens are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    stop = np.r_[starts[1:], len(cps)] if ends is None else ends
    lens = stop - starts
    if ends is None:
        body, at = cps[starts[0] :], starts - starts[0]
    else:
        keep = np.zeros(len(cps) + 1, dtype=np.int32)
        keep[starts] = 1
        keep[ends] -= 1
        inside = np.cumsum(keep[:-1]).astype(bool)
        body, at = cps[inside], np.r_[0, np.cumsum(lens)[:-1]]
    pos = np.arange(len(body), dtype=np.int64) - np.repeat(at, lens)
    pw = powers(int(lens.max()) + 1)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((body.astype(U) + U(1)) * pw[pos], at)
        return mix(h + lens.astype(U) * _M2)


class HashIndex:
    """Open-addressing table from 64-bit hashes to consecutive numbers, a whole array at a time."""

    def __init__(self, bits: int = 15) -> None:
        self.keys, self.vals, self.n = np.zeros(1 << bits, dtype=U), np.full(1 << bits, -1, dtype=np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        mask = U(len(self.keys) - 1)
        out, act = np.full(len(h), -1, dtype=np.int32), np.arange(len(h))
        slot = (h & mask).astype(np.int64)
        want = h
        while len(act):
            v = self.vals[slot]
            used = v >= 0
            hit = used & (self.keys[slot] == want)
            out[act[hit]] = v[hit]
            go = used & ~hit
            act, want, slot = act[go], want[go], (slot[go] + 1) & int(mask)
        return out

    def _place(self, h: np.ndarray, v: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (h & U(mask)).astype(np.int64)
        while len(h):
            free = self.vals[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[at], self.vals[at] = h[took], v[took]
            left = np.ones(len(h), dtype=bool)
            left[took] = False
            h, v, slot = h[left], v[left], slot[left]
            move = (self.vals[slot] >= 0)
            slot = np.where(move, (slot + 1) & mask, slot)

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that are not in the table get the next numbers."""
        if (self.n + len(h)) * 2 > len(self.keys):
            k, v = self.keys[self.vals >= 0], self.vals[self.vals >= 0]
            bits = int((self.n + len(h)) * 4).bit_length()
            self.keys, self.vals = np.zeros(1 << bits, dtype=U), np.full(1 << bits, -1, dtype=np.int32)
            self._place(k, v)
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)


class Memo:
    """Remembers what was computed for each distinct token.

    `learn` gets new tokens as strings and appends their values somewhere;
    `forget` empties that store when more than `limit` tokens are known, which
    bounds memory and costs recomputation, never results.
    """

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], limit: int = 1_500_000) -> None:
        self.learn, self.forget, self.limit, self.index = learn, forget, limit, HashIndex()

    def clear(self) -> None:
        self.index = HashIndex()
        self.forget()

    def numbers(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        if self.index.n > self.limit:
            self.clear()
        h = token_hashes(cps, starts, ends)
        found = self.index.find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            stop = (np.r_[starts[1:], len(cps)] if ends is None else ends)[at]
            raw = cps.astype("<u4", copy=False)
            self.learn([raw[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts[at].tolist(), stop.tolist(), strict=True)])
            self.index.add(new)
            found[miss] = self.index.find(h[miss])
        return found


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets; empty ranges give 0."""
    run = np.r_[np.zeros(1, dtype=np.int64 if values.dtype.kind in "iub" else np.float64), np.cumsum(values)]
    return run[offsets[1:]] - run[offsets[:-1]]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start..start+len of each range, one after the other."""
    total = int(lens.sum())
    at = np.r_[0, np.cumsum(lens)[:-1]] if len(lens) else np.zeros(0, dtype=np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lens)
