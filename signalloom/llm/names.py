"""A classifier of capitalised word pairs as names of persons, fitted on all texts, whose pairs the certain rules label."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import regex

#: The fewest names and other pairs that a model is fitted on.
FEWEST = 40
#: Bits of a feature's number, what a weight costs each time it is used, and the probability from which a pair is a name.
BITS, DECAY, LEAST = 15, 1e-4, 0.8
#: Words seen in lower case at least so often, and as often in every so many distinct texts on average, count as common:
#: a share of all texts, as in ever more of them every name stands in lower case twice.
COMMON, TEXTS = 2, 4000
#: How many features stand around a pair, and say what it is like.
AROUND, ALIKE = 7, 12
#: Slopes are summed as whole numbers of this part of one, so that the order of pairs doesn't matter; a fit ends where none
#: is steeper than this for each use of its weight; without that after so many sums it raises.
UNIT, FLAT, MOST = 2.0**-26, 1e-6, 2000

_word = regex.compile(r"[\w'’-]+")
_lower = regex.compile(r"\p{Ll}[\p{Ll}'’-]+")
_apart = {c: " " for c in range(128) if not (chr(c).isalnum() or chr(c) in "_'-")}


@lru_cache(1 << 16)
def number(feature: str) -> int:
    return int.from_bytes(blake2b(feature.encode("utf-8", "replace"), digest_size=4).digest()) & (1 << BITS) - 1


def words(text: str) -> list[str]:
    """All words of the text, of which in_lower_case() tells those that count."""
    return text.translate(_apart).split() if text.isascii() else _word.findall(text)


def in_lower_case(word: str) -> bool:
    return _lower.fullmatch(word) is not None


def plain_features(text: str, start: int, end: int, first: str, last: str) -> tuple[list[str], list[str], bool]:
    """(what stands around a pair, what the pair is like, whether it opens a sentence), the first two as names of features."""
    left, right = text[max(0, start - 40) : start], text[end : end + 40]
    before, after = left.lower().split(), right.lower().split()
    opens = not left.strip() or left.rstrip()[-1] in ".!?:\n"
    b1, b2 = (before[-1] if before else "^"), " ".join(before[-2:])
    a1, a2 = (after[0] if right[:1].isspace() and after else right[:1] or "$"), " ".join(after[:2])
    around = [f"b1={b1}", f"b2={b2}", f"a1={a1}", f"a2={a2}", f"open={opens}", f"cap={right[:2].strip()[:1].isupper()}", f"ba={b1}|{a1}"]
    alike = [f"f3={first[-3:].lower()}", f"l3={last[-3:].lower()}", f"l4={last[-4:].lower()}", f"f2={first[:2].lower()}", f"l={len(first) // 3},{len(last) // 3}", f"up={first.isupper()},{last.isupper()}", f"hy={'-' in first},{'-' in last}"]
    return around, alike, opens


def common_features(first: str, last: str, opens: bool, common: frozenset[str]) -> list[str]:
    """What a pair is like by the words that are common in lower case."""
    low = first.lower() in common, last.lower() in common
    return [f"low={low}", f"flow={low[0]}", f"llow={low[1]}", f"llow_open={low[1]},{opens}", f"any={low[0] or low[1]},{opens}"]


class NameModel:
    """Logistic regression over hashed features."""

    def __init__(self, weights: np.ndarray, common: frozenset[str]):
        self.weights, self.common = weights, common

    @classmethod
    def none(cls, common: frozenset[str]) -> NameModel:
        """A model that takes nothing for a name."""
        weights = np.zeros((1 << BITS) + 1)
        weights[-1] = -30.0
        return cls(weights, common)

    def common_pair(self, last: str) -> bool:
        """The second word is one that texts have in lower case, so that a listed first word alone makes no name."""
        return last.lower() in self.common

    def probability(self, text: str, start: int, end: int, first: str, last: str) -> float:
        around, alike, opens = plain_features(text, start, end, first, last)
        z = float(self.weights[[number(f) for f in around + alike + common_features(first, last, opens, self.common)]].sum() + self.weights[-1])
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def uses(numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each weight is used, the last by all: every pair, a row of numbers that occurs n times, is seen whole, by
    what stands around it alone and by what it is like alone, so that neither part only remembers the listed names."""
    total = np.zeros((1 << BITS) + 1, np.int64)
    for column in numbers.T:
        np.add.at(total, column, 2 * n)
    total[-1] = 3 * n.sum()
    return total


def slopes(numbers: np.ndarray, name: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The loss's derivative by each weight, in UNITs, summed over such pairs; name: whether each is one."""
    around, alike = np.zeros(len(n)), np.zeros(len(n))
    for k, column in enumerate(numbers.T):
        z = around if k < AROUND else alike
        z += weights[column]
    part = [np.rint((1 / (1 + np.exp(-np.clip(z + weights[-1], -30, 30))) - name) / UNIT).astype(np.int64) * n for z in (around + alike, around, alike)]
    total = np.zeros(len(weights), np.int64)
    for k, column in enumerate(numbers.T):
        np.add.at(total, column, part[0] + part[1 if k < AROUND else 2])
    total[-1] = sum(p.sum() for p in part)
    return total


def _dot(x: np.ndarray, y: np.ndarray) -> float:
    return float((x * y).sum())


def fit(slope: Callable[[np.ndarray], np.ndarray], used: np.ndarray, common: frozenset[str]) -> NameModel:
    """The model of least loss, of which slope() has the slopes() over all pairs, with used as their uses().

    The loss is convex and every used weight costs something, so there is one such model.  Limited-memory BFGS; as steps
    are told by slopes alone, a step that ends on a rise half as steep as the fall it began with is halved."""
    weights = np.zeros(len(used))
    there = np.flatnonzero(used)
    often = used[there].astype(float)
    cost = np.where(there == len(used) - 1, 0.0, DECAY) * often

    def steep(w: np.ndarray) -> np.ndarray:
        weights[there] = w
        return slope(weights)[there] * UNIT + cost * w

    w, last = np.zeros(len(there)), []
    g, sums = steep(w), 1
    while np.abs(g / often).max() > FLAT:
        d, scale, back = -g, 1.0, []
        for s, y, r in reversed(last):
            back.append(r * _dot(s, d))
            d = d - back[-1] * y
        if last:
            s, y, r = last[-1]
            scale = 1 / (r * _dot(y, y / often))
        d = d / often * scale
        for (s, y, r), a in zip(last, reversed(back)):
            d = d + (a - r * _dot(y, d)) * s
        if _dot(d, g) >= 0:
            d, last = -g / often, []
        step = 1.0
        while _dot(new := steep(w + step * d), d) > 0.5 * abs(_dot(g, d)):
            step, sums = step / 2, sums + 1
        sums += 1
        if sums > MOST:
            raise RuntimeError(f"the fit of names is not at its end after {sums} sums")
        if _dot(y := new - g, d) > 0:
            last = [*last[-19:], (step * d, y, 1 / (step * _dot(y, d)))]
        w, g = w + step * d, new
    weights[there] = w
    return NameModel(weights, common)
