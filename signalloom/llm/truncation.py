"""Problem 1: texts cut off by field limits or mid-transfer, by length hazards and a model of text ends."""

from __future__ import annotations

import re
from hashlib import blake2b
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, per_batch, slices, written

#: Lengths on either side whose hazards are the expectation, false-discovery rate, and the fewest texts of a length.
NEIGHBOURS, RATE, LEAST = 25, 0.001, 5
#: The most significant lengths sent to all tasks; more are joined by a shuffle.
SMALL_SIDE = 200_000
#: Bytes of text counted at once, contexts and distinct words a task holds before it passes their counts on, and bits that say which are asked for.
BATCH_BYTES, HELD, KEPT_WORDS, MOST_BITS = 4 << 20, 4_000_000, 300_000, 29
#: Words of context, occurrences from which a context counts, and the share of ends under which it is unfinished.
ORDER, SUPPORT, UNFINISHED = 7, 3, 0.04
#: Share of unfinished ends that confirms a significant length as a limit.
CONFIRMED = 0.5
#: A word seen so many times more often as the beginning of longer ones is taken for a part of one.
FRAGMENT = 50

#: Characters that hold the last ORDER words.
REACH = 400

_token = regex.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_stop = re.compile(r"[.!?。！？…]['\"”’»)\]]*\s")
_finished = r"[.!?。！？…]['\"”’»)\]]*\s*$"
#: A mark that the rest was left out.
_marker = re.compile(r"(?:…|\.\.\.)\s*(?:read more|show (?:full )?\w*|more|continue reading|see more|view \w+)\s*$|[\[(](?:…|\.\.\.)[\])]\s*$|\bshow full review\s*$|\((?:more|cont(?:inued|\.)?)\)\s*$|\ufffd\s*$", re.I)
_entity = re.compile(r"&(?:#\w{0,6}|[a-z]{1,6})$", re.I)
_open_link = re.compile(r"!?\[[^\]\[\n]{0,200}$|\]\([^)\n]{0,300}$|<[a-z/!][^<>\n]{0,200}$", re.I)
_open_bracket = re.compile(r"\([^()\n]{0,120}$")
_list_item = re.compile(r"\n\s*(?:\d{1,2}[.)]|[-*•])\s*$")
_ellipsis = re.compile(r"(?:…|\.\.\.)\s*$")
_dangling = re.compile(r"[,;:–—(\[{<“«&+=/-]\s*$")
_open_mark = re.compile(r"(?<![\w*])\*\*[^*\s][^*\n]{0,80}$")
_fence = "```"
#: For the JVM, which sees the last SEEN_BACK characters: ends like a whole text's, and those of them that the marker,
#: open marks and links, list items and ellipses above match; they may match more, never less.
SEEN_BACK = 320
_whole_end = r"[.!?。！？…]['\"”’»)\]]*\z"
_lost_end = r"(?iu)[\[(](?:…|\.\.\.)[\])]\z|\(cont\.\)\z|(?:…|\.\.\.)\z|(?:\n|\A)[\s\p{Z}]*\d{1,2}\.\z|(?<![\w*])\*\*[^*\s][^*\n]{0,80}\z|\[[^\]\[\n]{0,200}\z|\]\([^)\n]{0,300}\z|<[a-z/!][^<>\n]{0,200}\z"
_removed = re.compile(r"^\s*[\[(<]?\s*(?:deleted|removed|no text|none|null|n/a)\s*[\])>]?\s*$", re.I)


def hazards(lengths: DataFrame) -> DataFrame:
    """(source, field_name, length, n, at_risk, hazard, expected, p_value, significant) from (source, field_name, length, n).

    The hazard of a length is the share of texts of at least that length that end there; at_risk is summed by a
    window from the longest down.  It is tested against the pooled hazard of the lengths within NEIGHBOURS of it
    but itself (binomial tail), and lengths are significant by Benjamini and Hochberg's rule at RATE, in each
    source and field.  A window holds one row for each length, not for each text."""
    group = Window.partitionBy("source", "field_name")
    down = group.orderBy(F.col("length").desc())
    near = group.orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    df = lengths.withColumn("at_risk", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"d": F.sum("n").over(near) - F.col("n"), "r": F.sum("at_risk").over(near) - F.col("at_risk"), "hazard": F.col("n") / F.col("at_risk")})
    # half an event more keeps lengths without neighbours from being certain
    df = df.withColumn("expected", F.least(F.lit(0.999), (F.col("d") + 0.5) / (F.col("r") + F.lit(1.0) + F.when(F.col("r") == 0, F.col("at_risk")).otherwise(0))))

    @F.pandas_udf("double")
    def tail(n: pd.Series, at_risk: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(k), int(m), float(p)) for k, m, p in zip(n, at_risk, expected)], dtype=float)

    df = df.withColumn("p_value", F.when(F.col("n") >= LEAST, tail("n", "at_risk", "expected")).otherwise(F.lit(1.0)))
    df = df.withColumns({"rank": F.row_number().over(group.orderBy("p_value", "length")), "tests": F.count("*").over(group)})
    df = df.withColumn("passed", F.max(F.when(F.col("p_value") <= F.col("rank") * RATE / F.col("tests"), F.col("rank"))).over(group))
    return df.select("source", "field_name", "length", "n", "at_risk", "hazard", "expected", "p_value", F.coalesce(F.col("rank") <= F.col("passed"), F.lit(False)).alias("significant"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at least k of n events of probability p."""
    if k <= n * p:
        return 1.0
    total, log_p, log_q = 0.0, log(p), log(1 - p)
    for i in range(k, n + 1):
        term = exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        total += term
        if term < total * 1e-12:
            break
    return min(1.0, total)


def sentences(text: str) -> list[tuple[list[str], bool]]:
    """The words of each sentence, lower case, numbers as one word, and whether a mark other than an ellipsis ends it."""
    out, words, at = [], ["<s>"], 0
    for m in _token.finditer(text):
        between, word = text[at : m.start()], m.group()
        if between != " " and len(words) > 1 and ((mark := _stop.search(between)) or "\n" in between):
            out.append((words, mark is not None and "…" not in between and ".." not in between))
            words = ["<s>"]
        words.append("#" if word.isdecimal() else word.lower())
        at = m.end()
    if len(words) > 1:
        rest = text[at:]
        out.append((words, re.search(r"[.!?。！？]", rest) is not None and "…" not in rest and ".." not in rest))
    return out


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest())


class Counts:
    """How often a sentence ends after the last few words, and how often each word occurs, summed over a task's texts.

    Every word is a labelled case: the context of up to ORDER words that end with it, beginning with the sentence
    where that is nearer, and whether the sentence ends there.  Only contexts whose bit is set in `asked` are kept,
    which are those that an open-ended text asks for and, as bits are shared, some others; nothing else is left out."""

    def __init__(self, asked: np.ndarray, bits: int):
        self.asked, self.shift = asked, np.uint64(64 - bits)
        self.known: dict[str, int] = {}
        self.hashes: list[int] = []
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.held = 0
        self.words = np.zeros((2, 0), np.int64)

    def add(self, texts: list[str]) -> None:
        known, hashes = self.known, self.hashes
        ids, lengths, wholes = [], [], []
        for text in texts:
            for words, whole in sentences(text):
                for w in words:
                    if (k := known.get(w)) is None:
                        known[w] = k = len(hashes)
                        hashes.append(_hash(w))
                    ids.append(k)
                lengths.append(len(words))
                wholes.append(whole)
        if not ids:
            return
        ids, lengths, wholes = np.array(ids), np.array(lengths), np.array(wholes)
        h = np.array(hashes, np.uint64)[ids]
        final = np.cumsum(lengths) - 1
        place = np.arange(len(h)) - np.repeat(final - lengths + 1, lengths)
        last = np.zeros(len(h), bool)
        last[final] = True
        # an end without a mark may be a loss itself; it counts for the sentence as a whole only
        unmarked = last & ~np.repeat(wholes, lengths)
        seen = np.stack([np.bincount(ids[x & (place > 0)], minlength=len(hashes)) for x in (~unmarked, unmarked)])
        seen[:, : self.words.shape[1]] += self.words
        self.words = seen
        state = np.zeros(len(h), np.uint64)
        for n in range(1, ORDER + 1):
            # the context of n words ending at each place that has as many before it in its sentence
            at = np.flatnonzero(place >= n - 1)
            state[at] = _extend(h[at - (n - 1)], state[at])
            at = at[~unmarked[at] | (place[at] == n - 1)]
            keys = state[at] + np.uint64(n)
            bit = keys >> self.shift
            hit = self.asked[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
            self.keys.append(keys[hit])
            self.ends.append(last[at[hit]])
            self.held += int(hit.sum())

    def taken(self) -> pa.RecordBatch:
        """(key, word, n, ended) of what was counted since the last time; a word's ends are those without a mark, not in n."""
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, np.uint64)
        ends = np.concatenate(self.ends) if self.ends else np.empty(0, bool)
        unique, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        ended = np.bincount(inverse, weights=ends, minlength=len(unique)).astype(np.int64)
        there = self.words.any(axis=0)
        names = [w for w, x in zip(self.known, there) if x]
        seen, unmarked = self.words[:, there]
        out = [
            pa.array(unique.view(np.int64)).cast(pa.int64()), pa.nulls(len(unique), pa.string()), pa.array(counts), pa.array(ended),
        ], [pa.nulls(len(names), pa.int64()), pa.array([w.encode("utf-8", "replace").decode() for w in names], pa.string()), pa.array(seen), pa.array(unmarked)]
        self.clear()
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
            self.hashes.clear()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], ["key", "word", "n", "ended"])


def contexts(words: list[str]) -> list[int]:
    """The contexts of the last one to ORDER words as numbers, as Counts has them."""
    h = np.array([_hash(w) for w in words], np.uint64)
    out, state = [], np.zeros(1, np.uint64)
    for n in range(1, min(ORDER, len(h)) + 1):
        state = _extend(h[-n : len(h) - n + 1], state)
        out.append(int((state + np.uint64(n)).view(np.int64)[0]))
    return out


def _extend(words: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Contexts made longer by the word before each."""
    z = (state ^ words) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ z >> np.uint64(31)


def ending(text: str) -> tuple[str, list[str]]:
    """How a text ends: `lost` (its rest was), `whole`, or by the words that the model is asked about, `style` (an
    ellipsis; without words it is one of style) or `open` (a word)."""
    if not text or text.isspace() or _removed.match(text):
        return "whole", []
    bare = text.rstrip()
    if _marker.search(text) or _entity.search(bare):
        return "lost", []
    if bare.count(_fence) % 2 or _open_mark.search(bare):
        return "lost", []
    if _open_link.search(bare):
        return "lost", []
    if _list_item.search(text):
        return "lost", []
    if m := _ellipsis.search(bare):  # of style, unless words are cut off before it
        return "style", _last_words(bare[: m.start()]) if bare[m.start() - 1 : m.start()].isalnum() else []
    if re.search(_finished, bare):
        return "whole", []
    if _open_bracket.search(bare) and not re.search(r"[:;=8][-']?[()]$", bare):
        return "lost", []
    if _dangling.search(bare):
        return "lost", []
    if not bare[-1].isalnum():
        return "whole", []  # an emoji, closing mark or the like
    return ("open", words) if (words := _last_words(bare)) else ("whole", [])


def _last_words(text: str) -> list[str]:
    found = sentences(text[-REACH:])
    return found[-1][0] if found else []


class Truncation:
    """Truncated values of text fields and how often each source truncates them.

    hazards: the tested lengths.  values(): (id, source, field_name, by_length) of the truncated values; by_length
    is true at a significant length that is confirmed as a limit, false for losses in transfer, which stop at any
    length and are told by their end alone.  report(): (source, field_name, n_values, n_truncated, n_by_length,
    share) over all not-null values.

    Lengths are characters.  Hazards and the model of text ends are counted over all values; of the model only the
    contexts that an open-ended value asks for are kept, and they are joined to it.  Null, empty, blank and removed
    values are no cases; a null source is a source of its own; repeated rows are each reported; an empty table gives
    empty results; other columns aren't read."""

    def __init__(self, df: DataFrame, *, id_col: str = "id", source_col: str = "source", fields: tuple[str, ...] = ("body", "summary")):
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), *(F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(fields)))
        stack = f"stack({len(fields)}, {', '.join(f'{k}, t{k}' for k in range(len(fields)))}) as (k, text)"
        self.values_of = rows.select("id", "source", F.expr(stack)).where("text is not null")
        names = F.array(*map(F.lit, fields))
        self.named = lambda d: d.withColumn("field_name", names[F.col("k")])
        lengths = self.named(self.values_of).groupBy("source", "field_name", F.length("text").alias("length")).agg(F.count("*").alias("n"))
        self.hazards = written(hazards(lengths), "hazards")
        self.limits = self.hazards.where("significant").select("source", "field_name", "length", F.lit(True).alias("at_limit"))
        self.small = self.limits.count() <= SMALL_SIDE

    def _open(self) -> DataFrame:
        """(id, source, field_name, length, at_limit, kind, n_words, keys, last) of the values that may be truncated; keys are the
        contexts of the last words of those that the model is asked about."""

        def make():
            def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [ending(t) for t in batch.column("text").to_pylist()]
                keys = [contexts(words) if words else None for _, words in found]
                last = [words[-1].encode("utf-8", "replace").decode() if words else None for _, words in found]
                out = batch.select(["id", "source", "field_name", "length", "at_limit"]).to_struct_array().flatten()
                out += [pa.array([k for k, _ in found], pa.string()), pa.array([len(words) for _, words in found], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(last, pa.string())]
                named = pa.RecordBatch.from_arrays(out, ["id", "source", "field_name", "length", "at_limit", "kind", "n_words", "keys", "last"])
                return named.filter(pa.array([k != "whole" for k, _ in found], pa.bool_()))

            return handle

        # a text that ends like a whole one can be truncated only by a mark that ends in the same way
        tail = F.substring("text", -SEEN_BACK, SEEN_BACK)
        doubtful = ~tail.rlike(_whole_end) | tail.rlike(_lost_end) | F.contains("text", F.lit(_fence))
        open_ = self.named(self.values_of.where(doubtful)).withColumn("length", F.length("text"))
        key = ["source", "field_name", "length"]
        marked = open_.join(F.broadcast(self.limits) if self.small else self.limits, key, "left").select("id", "text", "at_limit", *key)
        return written(per_batch(marked, make, "id long, source string, field_name string, length int, at_limit boolean, kind string, n_words int, keys array<long>, last string"), "open")

    def _counted(self, asks: DataFrame) -> DataFrame:
        """(key, word, n, ended) over all values: of the contexts in asks, among others, and of every word."""
        spark = asks.sparkSession
        keys = asks.select(F.explode("keys").alias("key"))
        bits = min(MOST_BITS, max(20, (16 * keys.count()).bit_length()))
        bit = F.shiftrightunsigned("key", 64 - bits) + 1
        rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("b")).collect()
        asked = np.zeros(1 << bits - 3, np.uint8)
        for at, part in rows:
            asked[(at - 1) * len(part) : at * len(part)] = np.frombuffer(part, np.uint8)
        sent = spark.sparkContext.broadcast(asked)

        def count(batches):
            counts = Counts(sent.value, bits)
            for batch in batches:
                for part in slices(batch, "text", BATCH_BYTES):
                    counts.add(part.column("text").to_pylist())
                    if counts.held > HELD or len(counts.known) > KEPT_WORDS:
                        yield counts.taken()
            yield counts.taken()

        parts = self.values_of.select("text").mapInArrow(count, "key long, word string, n long, ended long")
        return written(parts.groupBy("key", "word").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended")), "counts")

    def values(self) -> DataFrame:
        """A length is taken for a limit if it is significant and most of the values there that don't end like
        whole ones end unfinished by the model too; stock phrases of one length have whole ends."""
        rows = self._open().withColumn("ask", F.element_at("keys", -1))
        asks = rows.where("ask is not null").select("ask", "keys", "last", "n_words").dropDuplicates(["ask"])
        counted = self._counted(asks)
        # of the contexts that other values showed often enough, the longest; a whole sentence's cases hold the value's own end
        seen = counted.where(F.col("key").isNotNull() & (F.col("n") >= SUPPORT)).select("key", "n", "ended")
        own = (F.col("at") + 1 == F.col("n_words")).cast("int")
        best = asks.select("ask", "n_words", F.posexplode("keys").alias("at", "key")).join(seen, "key").select("ask", "at", (F.col("n") - own).alias("n"), (F.col("ended") - own).alias("ended"))
        best = best.where(F.col("n") >= SUPPORT).groupBy("ask").agg(F.max(F.struct("at", "n", "ended")).alias("best"))
        # how often the last word begins a longer one, and stands alone, inside a sentence or at an end without a mark
        wanted = asks.select("last").distinct()
        words = counted.where("word is not null").select("word", "n", "ended")
        longer = words.crossJoin(F.broadcast(wanted.agg(F.collect_set(F.length("last")).alias("sizes"))))
        longer = longer.select("n", F.explode(F.expr("transform(filter(sizes, k -> k < length(word)), k -> substring(word, 1, k))")).alias("last"))
        begun = longer.join(wanted, "last", "left_semi").groupBy("last").agg(F.sum("n").alias("begun"))
        begun = begun.join(words.select(F.col("word").alias("last"), F.col("n").alias("inside"), F.col("ended").alias("cut")), "last", "left")
        begun = begun.select("last", "begun", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("cut", F.lit(0)).alias("cut"))
        rows = rows.join(best, "ask", "left").join(begun, "last", "left")
        n, ended = F.col("best.n"), F.col("best.ended")
        # a part of a word goes on, however many values are cut there; where nothing is known, its own end says nothing for it
        part = F.coalesce(F.col("begun") > FRAGMENT * (F.col("inside") + F.when(n.isNull(), 0).otherwise(F.col("cut"))), F.lit(False))
        unfinished = part | F.coalesce((ended + 0.02) / (n + 0.5) < UNFINISHED, F.lit(False))
        alone = F.when(F.col("kind") == "lost", True).otherwise(F.col("ask").isNotNull() & unfinished)
        # whole closing words, such as a greeting, are no loss; anything else that fills the field is
        closing = F.coalesce((F.col("best.at") + 1 == F.col("n_words")) & (ended >= 0.5 * n), F.lit(False))
        there = F.coalesce("at_limit", F.lit(False)) & (alone | (F.col("kind") != "open") | ~closing)
        key = ["source", "field_name", "length"]
        judged = cut(rows.select("id", *key, alone.alias("alone"), there.alias("there")).where("alone or there"))
        confirmed = judged.where("there").groupBy(key).agg(F.avg(F.col("alone").cast("double")).alias("unfinished")).where(F.col("unfinished") >= CONFIRMED).select(*key, F.lit(True).alias("limit"))
        confirmed = F.broadcast(confirmed) if self.small else confirmed
        return judged.join(confirmed, key, "left").select("id", "source", "field_name", "alone", F.coalesce(F.col("there") & F.col("limit"), F.lit(False)).alias("by_length")).where("alone or by_length").drop("alone")

    def report(self) -> DataFrame:
        total = self.hazards.groupBy("source", "field_name").agg(F.sum("n").alias("n_values"))
        cut_off = self.values().groupBy("source", "field_name").agg(F.count("*").alias("n_truncated"), F.count_if("by_length").alias("n_by_length"))
        joined = total.join(cut_off, ["source", "field_name"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_truncated", "n_by_length")})
        return joined.withColumn("share", F.col("n_truncated") / F.col("n_values"))
