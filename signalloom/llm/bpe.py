"""Byte-level BPE by a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary is a public rank file (base64 token, rank), whose path is a parameter.  A text is first
cut into the vocabulary's pre-tokens; each is merged on its own, so its ids are kept and reused."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import regex

#: Fixed value: the pattern that cuts a text into pre-tokens before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer pieces are merged anew each time, so that the kept ones stay small.
KEEP_CHARS, KEEP_PIECES = 48, 400_000

_pretoken = regex.compile(PATTERN)
#: A white-space run of more than one character with a space before its last one, where a cut at every space isn't a cut between pre-tokens.
_uneven = re.compile(r"\s{2} |[^\S ]  | [^\S ]+ \s|[\x1c-\x1f\x85]")
#: An ASCII text without any of these has no such run.
_rare = ("  ", " \n", "\n ", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31)))
_segment = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
_odd_space = re.compile(r"[\x1c-\x1f]")


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank; a rank is also the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    The queue holds (rank, place, length) of possible merges.  Symbols are linked both ways by the places of
    their first bytes; an entry is stale when its left symbol is gone or the two no longer span that length."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
    queue = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, i, span = heappop(queue)
        if not alive[i] or (right := after[i]) >= n or after[right] - i != span:
            continue
        alive[right] = 0
        end = after[i] = after[right]
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i : after[end]])) is not None:
                heappush(queue, (rank, i, after[end] - i))
        if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:end])) is not None:
            heappush(queue, (rank, left, end - left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Merged(dict):
    """Pre-token to its ids, made when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, part: str) -> list[int]:
        ids = merge(part.encode("utf-8", "replace"), self.ranks)
        if len(part) <= KEEP_CHARS:
            self[part] = ids
        return ids


class _Pieces(dict):
    """Piece to the ids of the lead followed by it, made when first asked for."""

    def __init__(self, merged: _Merged, lead: str = ""):
        super().__init__()
        self.merged, self.lead = merged, lead

    def __missing__(self, piece: str) -> list[int]:
        ids = [i for part in _pretoken.findall(self.lead + piece) for i in self.merged[part]]
        if len(piece) <= KEEP_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes and decodes with one vocabulary; keeps a bounded number of pieces."""

    def __init__(self, path: str):
        self.ranks = ranks_of(path)
        self.merged = _Merged(self.ranks)
        self.pieces, self.spaced = _Pieces(self.merged), _Pieces(self.merged, " ")

    def trim(self) -> None:
        """Forget the kept pieces once they are too many."""
        for kept in (self.merged, self.pieces, self.spaced):
            if len(kept) > KEEP_PIECES:
                kept.clear()

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one.  Spellings of special tokens are ordinary text."""
        return list(self.ids(text)) if text else []

    def ids(self, text: str) -> Iterator[int]:
        """As encode(), one id after the other."""
        if (not text.isascii() or any(x in text for x in _rare)) and _uneven.search(text):
            return chain.from_iterable(map(self.pieces.__getitem__, _pretoken.findall(text)))
        head, *rest = text.split(" ")  # a cut before a single space is a cut between pre-tokens
        return chain(self.pieces[head], chain.from_iterable(map(self.spaced.__getitem__, rest)))

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        return len(self.encode(text))

    def segments(self, text: str) -> tuple[list[str], list[int]]:
        """Words with the space before them and white-space runs, in order, with the number of ids of each."""
        if _odd_space.search(text):
            found = _pretoken.findall(text)
        else:
            found = _segment.findall(text)
        return found, list(map(len, map(self.pieces.__getitem__, found)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their spellings one after the other."""
        return b"".join(map(self.spellings.__getitem__, ids)).decode("utf-8", "replace")

    @property
    def spellings(self) -> dict[int, bytes]:
        return {i: token for token, i in self.ranks.items()}
