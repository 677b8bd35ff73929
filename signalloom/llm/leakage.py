"""Problem 7: passages of evaluation texts inside a corpus, by the q-gram lemma and banded alignment."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import per_batch, slices

BATCH_BYTES = 4 << 20
Q = 8  # a q-gram of bytes is one 64-bit number
#: Diagonals in a band; bands overlap by half.
BAND = 64
#: Evaluation text held by a task at once; more is taken in blocks, each over the whole corpus.
BLOCK_BYTES = 4 << 20
#: Slots of the filter for each q-gram of a block, and its bounds: an item counts with the next smaller one of its own.
SLOTS, STEP, LEVELS = 12, 1.12, 8

_word = re.compile(r"[^\W_]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> bytes:
    """The words (maximal runs of letters and digits, lower case) with one space around each, as UTF-8."""
    if text.isascii():
        words = text.encode().translate(_TABLE).split()
        return b" " + b" ".join(words) + b" "
    return (" " + " ".join(_word.findall(text.lower())) + " ").encode("utf-8", "replace")


def grams(buffer: bytes) -> np.ndarray:
    """The q-gram at each byte as a number."""
    n = len(buffer) - Q + 1
    return np.ndarray((n,), "<u8", buffer, strides=(1,)) if n > 0 else np.empty(0, np.uint64)


def word_places(text: bytes) -> np.ndarray:
    """Where each word of plain() text begins, and its end."""
    return np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1


class Index:
    """q-grams of a block of evaluation texts, the places where each occurs, and what the lemma asks of each text.

    A passage of `min_words` words with at most `edits` word edits is, in the text's own bytes, at least as long as
    the shortest run of so many words.  An edit changes at most the longest word of the block with its spaces and
    the q-grams that reach into it, so on the passage's diagonals at least `least` of its q-grams are shared (one,
    where the bound is less).  A document's longer words equal none of the items' and are cut, so that the bound of
    an added word holds."""

    def __init__(self, items: list[tuple[str, bytes]], min_words: int, edits: int):
        self.items, self.min_words, self.edits = items, min_words, edits
        self.starts = np.cumsum([0, *(len(t) + 1 for _, t in items)])
        values = grams(b"\n".join(t for _, t in items) + b"\n").copy()
        # a q-gram over the end of a text isn't one
        inside = np.ones(len(values), bool)
        for end in self.starts[1:]:
            inside[max(0, end - Q) : end] = False
        at = np.flatnonzero(inside)
        order = np.argsort(values[at], kind="stable")
        self.places, self.values = at[order].astype(np.int32), values[at][order]
        places = [word_places(t) for _, t in items]
        # bytes of each item's shortest passage of that many words, with the space on either side
        self.lengths = np.array([int((p[min_words:] - p[:-min_words]).min()) + 1 if len(p) > min_words else 1 << 30 for p in places], np.int64)
        longest = max((int(np.diff(p).max()) for p in places if len(p) > 1), default=1) + 1
        self.too_long = re.compile(rb"[^ ]{%d,}" % longest), b"\x01" * longest
        #: The longest stretch of a document that a passage of that many of an item's bytes may take, and the q-grams in it.
        self.reach = self.lengths + edits * longest
        self.least = np.maximum(1, self.lengths - Q + 1 - edits * (Q + longest))
        codes: dict[bytes, int] = {}
        self.words = [np.array([codes.setdefault(w, len(codes)) for w in t.split()], np.int64) for _, t in items]
        self.codes, self.word_at = codes, [p[:-1] for p in places]
        self._filter()

    def _filter(self) -> None:
        """Bounds of the filter, and for each slot the bounds for which a q-gram with that slot counts."""
        low = int(self.least.min(initial=1 << 30))
        bounds = [low]
        while len(bounds) < LEVELS:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * STEP)))
        level = np.searchsorted(bounds, self.least, "right") - 1
        # every level goes by the smallest share and longest reach of its own items
        self.levels = [(k, int(self.least[level == k].min()), int(self.reach[level == k].max())) for k in range(LEVELS) if (level == k).any()]
        self.bits = max(16, (SLOTS * max(1, len(self.values))).bit_length())
        self.present = np.zeros(1 << self.bits, np.uint8)
        owner = np.searchsorted(self.starts, self.places, "right") - 1
        for k, _, _ in self.levels:
            self.present[self.slots(self.values[level[owner] == k])] |= np.uint8(1 << k)

    def bounded(self, text: bytes) -> bytes:
        """plain() text of a document with words longer than any of the items' cut, where edits are allowed."""
        return self.too_long[0].sub(self.too_long[1], text) if self.edits else text

    def slots(self, values: np.ndarray) -> np.ndarray:
        return (values * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def regions(self, buffer: bytes) -> np.ndarray:
        """Places of the buffer's q-grams in stretches with enough of the evaluation texts' q-grams, on whatever diagonal.

        Items of like bounds are one level with a bit of its own in every slot, so that an item with a low bound
        doesn't let more through for the others."""
        values = grams(buffer)
        if len(values) == 0 or not self.levels:
            return np.empty(0, np.int64)
        seen = self.present[self.slots(values)]
        places = np.arange(len(seen))
        wanted = np.zeros(len(seen), bool)
        for k, least, reach in self.levels:
            at = places[(seen >> np.uint8(k) & 1) == 1]
            if len(at) < least:
                continue
            # the first and last hit of every stretch of so many hits that lies close enough together
            first = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= reach - Q)
            mark = np.zeros(len(at) + 1, np.int32)
            mark[first] += 1
            mark[first + least] -= 1
            wanted[at[np.cumsum(mark[:-1]) > 0]] = True
        return np.flatnonzero(wanted)

    def shared(self, buffer: bytes, base: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, place in it, item, diagonal) of every q-gram that a document, which begins at `base` and whose
        q-grams of interest are among `at`, shares with an evaluation text."""
        values = grams(buffer)[at]
        low, high = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        times = high - low
        place = self.places[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
        owner = np.repeat(np.searchsorted(base, at, "right") - 1, times)
        doc = np.repeat(at, times) - base[owner]
        item = np.searchsorted(self.starts, place, "right") - 1
        return owner, doc, item, doc - (place - self.starts[item])

    def bands(self, owner: np.ndarray, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, document range, diagonal range) of every stretch of an overlapping band of diagonals that
        has as many shared q-grams, close enough together, as the item's bound asks for; stretches of a document
        and item that touch in both ranges are one."""
        found = []
        # document, item, band and place in one number, whose order is that of all four
        base = int(diagonal.min(initial=0)) - BAND
        widths = [int(x.max(initial=0)).bit_length() for x in (owner, item, (diagonal - base) // BAND + 1, doc)]
        if sum(widths) > 63:
            raise ValueError("too many documents and evaluation texts at once")
        for shift in (0, BAND // 2):
            key = owner
            for part, width in zip((item, (diagonal - base + shift) // BAND, doc), widths[1:]):
                key = key << width | part
            key = np.sort(key)
            last_of = np.minimum(np.arange(len(key)) + self.least[key >> widths[3] + widths[2] & (1 << widths[1]) - 1] - 1, len(key) - 1)
            fits = np.flatnonzero((key >> widths[3] == key[last_of] >> widths[3]))
            first, last, place = key[fits], key[last_of[fits]], (1 << widths[3]) - 1
            docs, ends = first & place, last & place
            items = first >> widths[3] + widths[2] & (1 << widths[1]) - 1
            bands = first >> widths[3] & (1 << widths[2]) - 1
            near = (ends - docs <= self.reach[items] - Q) & (last_of[fits] - fits == self.least[items] - 1)
            found.append(np.stack([first >> widths[3] + widths[2] + widths[1], items, bands * BAND - shift + base, docs, ends + Q])[:, near])
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))].T
        out: list[list[int]] = []
        for d, k, low, a, b in _merged(rows):
            if out and out[-1][0] == d and out[-1][1] == k and low <= out[-1][5] + 1 and a <= out[-1][3] and b >= out[-1][2]:
                out[-1][2], out[-1][3], out[-1][5] = min(a, out[-1][2]), max(b, out[-1][3]), low + BAND - 1
            else:
                out.append([d, k, a, b, low, low + BAND - 1])
        return [tuple(x) for x in out]

    def align(self, words: np.ndarray, places: np.ndarray, item: int, span: tuple[int, int], diagonals: tuple[int, int]) -> tuple[int, int]:
        """Banded alignment by words, a row of the table at once: the longest run of equal words, and the most words
        aligned with at most `edits` word edits, over pairs of words whose diagonal lies in the band widened by half
        of it.  words: the document's, numbered as the items' are, and where each begins."""
        others, at = self.words[item], self.word_at[item]
        i0, i1 = max(0, int(np.searchsorted(places, span[0])) - 1), int(np.searchsorted(places, span[1]))
        low, high = diagonals[0] - BAND // 2, diagonals[1] + BAND // 2
        j0, j1 = int(np.searchsorted(at, places[i0] - high)), int(np.searchsorted(at, places[i1 - 1] - low, "right"))
        if j1 <= j0 or i1 <= i0:
            return 0, 0
        others, at = others[j0:j1], at[j0:j1]
        gap = places[i0:i1, None] - at[None, :]
        inside = (gap >= low) & (gap <= high)
        equal = (words[i0:i1, None] == others[None, :]) & inside
        # matched[e][j + 1]: words of the best alignment that ends with this word of the item, with e edits
        matched = np.zeros((self.edits + 1, j1 - j0 + 1), np.int32)
        run, best_run, best = np.zeros(j1 - j0 + 1, np.int32), 0, 0
        for same, near in zip(equal, inside):
            run[1:] = np.where(same, run[:-1] + 1, 0)
            best_run = max(best_run, int(run.max()))
            if self.edits:
                after = np.zeros_like(matched)
                for e in range(self.edits + 1):
                    v = np.where(same, matched[e, :-1] + 1, 0)
                    if e:  # a word changed, added in the document, or left out of it
                        v = np.maximum(np.maximum(v, matched[e - 1, :-1]), np.maximum(matched[e - 1, 1:], after[e - 1, :-1]))
                    after[e, 1:] = np.where(near, v, 0)
                matched = after
                best = max(best, int(matched.max()))
        return best_run, max(best, best_run)


def _merged(rows: np.ndarray) -> list[list[int]]:
    """Rows (document, item, diagonal, from, to) in order, those of one band that overlap taken together."""
    if not len(rows):
        return []
    new = np.ones(len(rows), bool)
    reach = rows[:, 4].copy()
    same = (np.diff(rows[:, 0]) == 0) & (np.diff(rows[:, 1]) == 0) & (np.diff(rows[:, 2]) == 0)
    new[1:] = ~(same & (rows[1:, 3] <= reach[:-1]))
    starts = np.flatnonzero(new)
    return [[*map(int, rows[a, :4]), int(b)] for a, b in zip(starts, np.maximum.reduceat(rows[:, 4], starts))]


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "post_id", item_text_col: str = "body", min_words: int = 12, edits: int = 0) -> DataFrame:
    """(doc_id, post_id, run_words, aligned_words) of each document and evaluation text that share a passage.

    A passage is `min_words` consecutive words with at most `edits` words changed, added or left out; words are
    maximal runs of letters and digits in lower case and whatever stands between them doesn't matter.
    run_words is the longest run of equal words, aligned_words the most equal words of one passage.

    Method, for every number of edits: q-grams that a document shares with the evaluation texts are counted in
    windows, then in overlapping bands of diagonals; what meets the q-gram lemma's bound of its item is verified by
    banded alignment.
    The evaluation texts are the small side: they are read to the driver in blocks of at most BLOCK_BYTES,
    each of which is sent to all tasks and held against the whole corpus, so there is no shuffle at any size.

    Null, empty and shorter texts have no passage; repeated rows are reported once each; evaluation texts with
    the same words are each reported; empty tables give an empty result; other columns aren't read."""
    if min_words < 1 or edits < 0:
        raise ValueError("min_words must be positive and edits not negative")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = items.select(F.col(item_id_col).cast("string"), F.col(item_text_col).cast("string")).where(F.col(item_text_col).isNotNull())
    block: list[tuple[str, bytes]] = []
    size, out = 0, None
    for item_id, text in held.toLocalIterator():
        if len((p := plain(text)).split()) < min_words:
            continue
        block.append((item_id, p))
        size += len(p)
        if size >= BLOCK_BYTES:
            out = (found := _leaks(narrow, block, min_words, edits)) if out is None else out.unionAll(found := _leaks(narrow, block, min_words, edits))
            block, size = [], 0
    if block or out is None:
        found = _leaks(narrow, block, min_words, edits)
        out = found if out is None else out.unionAll(found)
    return out


def _leaks(narrow: DataFrame, block: list[tuple[str, bytes]], min_words: int, edits: int) -> DataFrame:
    # made once here, and unpickled once by each Python worker
    sent = narrow.sparkSession.sparkContext.broadcast(Index(block, min_words, edits))

    def make():
        index = sent.value

        def handle(batch: pa.RecordBatch):
            for part in slices(batch, "text", BATCH_BYTES):
                yield one(part)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, best = part.column("id"), {}
            texts = [index.bounded(plain(t)) if t else b"" for t in part.column("text").to_pylist()]
            gap = b"\n" * Q
            buffer = gap.join(texts) + gap
            starts = np.cumsum([0, *(len(t) + Q for t in texts)])
            at = index.regions(buffer)
            known, words = -1, None
            for d, item, a, b, low, high in index.bands(*index.shared(buffer, starts, at)) if len(at) else ():
                if d != known:
                    known, places = d, word_places(texts[d])[:-1]
                    words = np.array([index.codes.get(w, -1) for w in texts[d].split()], np.int64)
                run, aligned = index.align(words, places, item, (a, b), (low, high))
                if aligned >= min_words:
                    before = best.get((d, item), (0, 0))
                    best[d, item] = max(run, before[0]), max(aligned, before[1])
            rows = [(d, index.items[k][0], run, aligned) for (d, k), (run, aligned) in best.items()]
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["doc_id", "post_id", "run_words", "aligned_words"])

        return handle

    return per_batch(narrow, make, "doc_id long, post_id string, run_words int, aligned_words int")
