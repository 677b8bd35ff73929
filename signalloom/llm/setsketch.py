"""SetSketch registers of many sets at once, band keys and the joint likelihood estimate.

Register i of a set is the largest floor(1 - log_b h_i(x)) of its elements, where h_i(x) is exponential with
rate a, kept within 0..q+1: an exponentially spaced, truncated minimum.  Registers of a union are the larger
ones of both sets; for b near 1 two sets agree in a register about as often as their Jaccard similarity."""

from __future__ import annotations

import numpy as np

RATE = 20.0
#: Registers of single elements that are kept between batches, and the most elements taken at once.
KEPT_CELLS, AT_ONCE = 18_350_080, 24_000

_MULTIPLY = np.uint64(0xBF58476D1CE4E5B9)
_GAMMA = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    x = x + np.uint64(_GAMMA)
    x = (x ^ x >> np.uint64(30)) * _MULTIPLY
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Family:
    """Registers `first` to `first + m`, of base b and largest value q + 1."""

    def __init__(self, m: int, *, first: int = 0, base: float = 1.001, q: int = (1 << 16) - 2):
        self.m, self.base, self.q = m, base, q
        self.kind = np.uint8 if q <= 254 else np.uint16
        self.seeds = mixed(np.arange(first + 1, first + m + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.rows = np.empty((0, m), self.kind)

    def of_elements(self, x: np.ndarray) -> np.ndarray:
        """The registers of each element alone."""
        z = x[:, None] ^ self.seeds
        z = (z ^ z >> np.uint64(29)) * _MULTIPLY
        z ^= z >> np.uint64(32)
        v = ((z & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
        np.minimum(v, np.float32(1 - 2**-24), out=v)
        h = -np.log1p(-v) / np.float32(RATE)
        k = np.floor(1 - np.log(h) / np.float32(np.log(self.base)))
        return np.clip(k, 0, self.q + 1).astype(self.kind)

    def _rows(self, unique: np.ndarray) -> np.ndarray:
        """Rows of the kept table for sorted distinct elements, added where missing."""
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        new = unique[~known]
        if len(new):
            if len(self.keys) + len(new) > KEPT_CELLS // self.m:
                self.keys, self.at, self.rows, new = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, self.m), self.kind), unique
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            places = np.concatenate([self.at, np.arange(len(self.rows), len(self.rows) + len(new))])
            self.keys, self.at = keys[order], places[order]
            self.rows = np.concatenate([self.rows, self.of_elements(new)])
            at = np.searchsorted(self.keys, unique)
        return self.at[at]

    def of_sets(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers of each set of elements (all 0 for an empty one)."""
        out = np.zeros((len(sets), self.m), self.kind)
        parts = [(i, s[k : k + AT_ONCE]) for i, s in enumerate(sets) for k in range(0, len(s), AT_ONCE)]
        start = 0
        while start < len(parts):
            end, size = start, 0
            while end < len(parts) and (not size or size + len(parts[end][1]) <= AT_ONCE):
                size += len(parts[end][1])
                end += 1
            unique, inverse = np.unique(np.concatenate([s for _, s in parts[start:end]]), return_inverse=True)
            places = self._rows(unique)[inverse]
            k = 0
            for i, s in parts[start:end]:
                np.maximum(out[i], self.rows[places[k : k + len(s)]].max(axis=0), out=out[i])
                k += len(s)
            start = end
        return out


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """For each set and band one number, the band in its high and a hash of its registers in its low 32 bits."""
    n, m = registers.shape
    width = m // bands
    odd = mixed(np.arange(width, dtype=np.uint64)) | np.uint64(1)
    z = mixed((registers.reshape(n, bands, width).astype(np.uint64) * odd).sum(axis=2, dtype=np.uint64))
    return (z >> np.uint64(32) | np.arange(bands, dtype=np.uint64) << np.uint64(32)).astype(np.int64)


def _larger(x: np.ndarray, base: float) -> np.ndarray:
    return -np.log(1 - x * (base - 1) / base) / np.log(base)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets of known sizes, from how many registers are
    larger in the one, larger in the other and equal; by ternary search, the likelihood having one peak."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, r = _larger(np.maximum(u - v * j, 1e-12), base), _larger(np.maximum(v - u * j, 1e-12), base)
        return more * np.log(p) + less * np.log(r) + same * np.log(np.maximum(1 - p - r, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(24):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(x) < likelihood(y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    return (low + high) / 2


def reaches(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, base: float, least: float) -> np.ndarray:
    """Whether joint_similarity() would be at least so much: the likelihood has one peak, so it is where the likelihood
    still rises at that similarity, or where the sizes allow no more."""
    more, less = (a > b).sum(axis=1, dtype=np.int32), (a < b).sum(axis=1, dtype=np.int32)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def terms(j: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, r = _larger(np.maximum(u - v * j, 1e-12), base), _larger(np.maximum(v - u * j, 1e-12), base)
        return np.log(p), np.log(r), np.log(np.maximum(1 - p - r, 1e-12))

    low, high = terms(least - 1e-4), terms(least + 1e-4)
    rises = more * (high[0] - low[0]) + less * (high[1] - low[1]) + same * (high[2] - low[2]) >= 0
    return (least <= most) & rises
