"""Problem 8: texts over a token limit cut at natural boundaries, with overlap, by pointer doubling."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import per_batch, slices
from .bpe import KEEP_CHARS, KEEP_PIECES, Encoder
from .encoding import VOCABULARY

BATCH_BYTES = 4 << 20
#: Boundary kinds, best last.
SAME, INSIDE, WORD, SENTENCE, PARAGRAPH = range(-1, 4)
#: A segment of more ids than this may be cut inside, at steps of so many characters.
STEP_IDS, STEP_CHARS = 48, 24
#: A step of one text's characters may take so many ids: four bytes each, and as many for what is merged differently.
LEAST_LIMIT = 128

_sentence_end = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


class _Kinds(dict):
    """Segment to what it makes of the boundary after it; bounded like the encoder's pieces."""

    def __missing__(self, segment: str) -> int:
        if segment.isspace():
            kind = PARAGRAPH if "\n" in segment or "\r" in segment else SAME
        else:
            kind = SENTENCE if _sentence_end.search(segment[-4:]) else WORD
        if len(segment) <= KEEP_CHARS:
            self[segment] = kind
        return kind


def boundaries(text: str, encoder: Encoder, kinds_of: _Kinds, step_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Character places, ids before each, and kinds of every place where a piece may begin or end; and whether
    any lies inside a segment, where ids don't simply add up."""
    segments, counts = encoder.segments(text)
    kinds = np.array([PARAGRAPH, *map(kinds_of.__getitem__, segments)], np.int8)
    kinds[-1] = PARAGRAPH
    same = np.where(kinds == SAME, 0, np.arange(len(kinds)))  # after blanks within a line the boundary is of the kind before them
    kinds = kinds[np.maximum.accumulate(same)]
    starts, before = np.cumsum([0, *map(len, segments)]), np.cumsum([0, *counts])
    if not (long := np.flatnonzero(np.array(counts) > step_ids)).size:
        return starts, before, kinds, False
    at, more = [], []
    for k in long.tolist():
        segment = segments[k]
        parts = [len(encoder.encode(segment[j : j + STEP_CHARS])) for j in range(0, len(segment), STEP_CHARS)]
        before[k + 1 :] += sum(parts) - counts[k]
        at += [k + 1] * (len(parts) - 1)
        more += [(starts[k] + STEP_CHARS * (j + 1), before[k] + n) for j, n in enumerate(np.cumsum(parts[:-1]).tolist())]
    places, ids = np.array(more, np.int64).reshape(-1, 2).T
    return np.insert(starts, at, places), np.insert(before, at, ids), np.insert(kinds, at, INSIDE), True


def successors(before: np.ndarray, kinds: np.ndarray, offsets: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a piece from each boundary: where it ends, and where the next one begins (itself at the text's end).

    Texts lie one after the other; offsets are the places of their first boundaries and the total.  The end is
    the farthest boundary within the limit, moved back to the last paragraph end, or else sentence end, of the
    piece's second half.  The next begins at the first sentence start, or else word start, among the last ids
    that it may repeat, or at the end itself; it is always after this one."""
    n = len(before)
    last = np.repeat(offsets[1:] - 1, np.diff(offsets))
    here = np.arange(n)
    far = np.minimum(np.searchsorted(before, before + limit, "right") - 1, last)
    far = np.maximum(far, np.minimum(here + 1, last))
    half = np.searchsorted(before, before + limit // 2, "left")
    end, chosen = far.copy(), far == last
    for kind in (PARAGRAPH, SENTENCE, WORD):
        latest = np.maximum.accumulate(np.where(kinds >= kind, here, -1))[far]
        fits = ~chosen & (latest > here) & ((latest >= half) | (kind == WORD))
        end[fits] = latest[fits]
        chosen |= fits
    low = np.minimum(np.maximum(np.searchsorted(before, before[end] - overlap, "left"), here + 1), last)
    nxt, taken = end.copy(), np.zeros(n, bool)
    for kind in (SENTENCE, WORD):
        following = np.where(kinds >= kind, here, n)
        first = np.minimum.accumulate(following[::-1])[::-1][low]
        fits = ~taken & (first < end)
        nxt[fits] = first[fits]
        taken |= fits
    done = end == last
    nxt[done] = here[done]
    return end, nxt


def cuts(nxt: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Every boundary that the roots lead to, by squaring the successor table until nothing is added."""
    reached = np.zeros(len(nxt), bool)
    reached[roots] = True
    table = nxt
    while True:
        more = table[np.flatnonzero(reached)]
        if reached[more].all():
            return np.flatnonzero(reached)
        reached[more] = True
        table = table[table]


def _exact(text: str, starts: np.ndarray, before: np.ndarray, a: int, b: int, inside: bool, encoder: Encoder) -> int:
    """Number of ids of the piece's own text: the difference, but for the white space at its end, which is then a run of its own."""
    piece = text[starts[a] : starts[b]]
    if inside:
        return len(encoder.encode(piece))
    if not piece[-1:].isspace():
        return int(before[b] - before[a])
    run = piece[len(piece.rstrip()) :]
    return int(before[np.searchsorted(starts, starts[b] - len(run))] - before[a]) + len(encoder.encode(run))


def split_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 512, overlap: int = 64, vocabulary: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """(doc_id, piece_no from 0, char_start, char_end, n_tokens[, piece]) in order within each document.

    Each piece has at most `limit` ids of the vocabulary, counted on the piece's own text.  Pieces cover the
    whole text; each repeats at most the last `overlap` ids of the one before.  A limit under LEAST_LIMIT raises.  A text within the limit is
    one piece; null and empty texts are one empty piece.  Text without boundaries is cut between characters.

    Boundaries of all documents of a batch lie in one successor table; squaring it (pointer doubling) gives
    all greedy cuts in about log2(pieces) rounds.  Documents are independent, so nothing is shuffled.
    Repeated rows and null ids are kept; an empty table gives an empty result; other columns aren't read."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if limit < LEAST_LIMIT:
        raise ValueError(f"limit must be at least {LEAST_LIMIT}")

    def make():
        encoder, kinds_of = Encoder(vocabulary), _Kinds()

        def handle(batch: pa.RecordBatch):
            for part in slices(batch, "text", BATCH_BYTES):
                yield one(part)
                encoder.trim()
                if len(kinds_of) > KEEP_PIECES:
                    kinds_of.clear()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = part.column("id").to_pylist(), part.column("text").to_pylist()
            pieces: dict[int, list[tuple[int, int, int]]] = {}
            todo, allowed = [], limit
            for i, text in enumerate(texts):
                if (n := encoder.count(text)) <= limit:
                    pieces[i] = [(0, len(text or ""), n)]
                else:
                    todo.append(i)
            while todo:
                parts = [boundaries(texts[i], encoder, kinds_of, STEP_IDS if allowed < limit or limit - overlap < 4 * STEP_IDS else limit - overlap) for i in todo]
                span = max(int(b[-1]) for _, b, _, _ in parts) + 2 * limit  # between texts, so that none reaches into the next
                offsets = np.cumsum([0, *(len(b) for _, b, _, _ in parts)])
                before = np.concatenate([b + k * span for k, (_, b, _, _) in enumerate(parts)])
                end, nxt = successors(before, np.concatenate([x[2] for x in parts]), offsets, allowed, overlap)
                reached = cuts(nxt, offsets[:-1])
                again = []
                for k, i in enumerate(todo):
                    starts, own, _, inside = parts[k]
                    low, high = np.searchsorted(reached, offsets[k : k + 2])
                    got = []
                    for a in reached[low:high] - offsets[k]:
                        b = int(end[a + offsets[k]] - offsets[k])
                        got.append((int(starts[a]), int(starts[b]), _exact(texts[i], starts, own, a, b, inside, encoder)))
                    if got[-1][0] == got[-1][1]:
                        got.pop()
                    if any(n > limit for _, _, n in got):
                        if allowed <= 1:
                            raise ValueError("no cut keeps a piece within the limit")
                        again.append(i)
                    else:
                        pieces[i] = got
                todo, allowed = again, allowed - max(1, allowed // 16)
            rows = [(ids[i], no, a, b, n, texts[i][a:b] if with_text and texts[i] else "") for i in range(len(ids)) for no, (a, b, n) in enumerate(pieces[i])]
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            names = ["doc_id", "piece_no", "char_start", "char_end", "n_tokens", "piece"]
            return pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names[: 5 + with_text])

        return handle

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(narrow, make, "doc_id long, piece_no int, char_start int, char_end int, n_tokens int" + ", piece string" * with_text)
