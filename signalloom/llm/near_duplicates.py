"""Problem 5: records that tell the same text with small edits, by SetSketch bands, likelihood and exact check."""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import chain
from math import ceil, log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .base import cut, per_batch, written
from .setsketch import Family, band_keys, mixed, reaches

#: Registers of a band up to so many rows, one more for every tenfold; there are as many bands as give this recall at the threshold.
WIDTH, WIDTH_ROWS, RECALL = 7, 10_000_000, 0.896
#: Registers of the joint estimate, coarser, and how many standard deviations it may lie under the threshold.
JOINT, JOINT_BASE, JOINT_Q, MARGIN = 64, 1.1, 254, 3.5
#: Classes of equal texts that a task remembers so as to send each once, and words whose hash it keeps.
SEEN, WORDS = 500_000, 400_000
#: Band keys that a task looks at together, and how many of them a key must have to be hot, which is about a fortieth of the texts.
LOOK, LOOK_HOT = 1 << 20, 320
#: More texts than this under one band key are hot too, and texts of a hot key are compared in blocks of about this size.
HOT, BLOCK = 4096, 2048
#: The most ids or keys sent to all tasks; more are joined by a shuffle.
SMALL_SIDE = 2_000_000

_word = re.compile(r"[^\W_]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


class _Hashes(dict):
    """Word to its 64-bit hash, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest())
        return h


class Shingler:
    """Texts to sets of adjacent word pairs, as 64-bit numbers."""

    def __init__(self):
        self.hashes = _Hashes()

    def words(self, text: str) -> list[bytes]:
        """Maximal runs of letters and digits in lower case."""
        if text.isascii():
            return text.encode().translate(_LOWER).split()
        return [w.encode("utf-8", "replace") for w in _word.findall(text.lower())]

    def sets(self, titles: list[str | None], bodies: list[str | None], min_words: int) -> tuple[list[int], list[np.ndarray], np.ndarray]:
        """Rows whose body has enough words, the set of word pairs of each and a signed number of each set, equal for equal sets."""
        if len(self.hashes) > WORDS:
            self.hashes.clear()
        rows, sizes, found = [], [], []
        for i, body in enumerate(bodies):
            if body and len(own := self.words(body)) >= min_words:
                words = self.words(titles[i]) + own if titles[i] else own
                if len(words) > 1:
                    rows.append(i)
                    sizes.append(len(words))
                    found.append(words)
        if not rows:
            return [], [], np.empty(0, np.int64)
        h = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(found)), np.uint64, sum(sizes))
        ends = np.cumsum(sizes)
        inside = np.ones(len(h), bool)
        inside[ends - 1] = False  # no pair reaches into the next text
        pairs = mixed(h[:-1] * np.uint64(0x9FB21C651E98DF25) + mixed(h[1:]))[inside[:-1]]
        ends -= np.arange(1, len(ends) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        for a, b in zip(starts.tolist(), ends.tolist()):
            pairs[a:b].sort()
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        new[starts] = True
        counts = np.add.reduceat(new, starts, dtype=np.int64)
        pairs = pairs[new]
        ends = np.cumsum(counts)
        starts = ends - counts
        fps = mixed(np.add.reduceat(mixed(pairs ^ np.uint64(0x5851F42D4C957F2D)), starts) + counts.astype(np.uint64)).view(np.int64)
        return rows, [pairs[a:b] for a, b in zip(starts.tolist(), ends.tolist())], fps

    def of(self, batch: pa.RecordBatch, min_words: int):
        return self.sets(batch.column("title").to_pylist(), batch.column("body").to_pylist(), min_words)


def shape(rows: int, threshold: float) -> tuple[int, int]:
    """(bands, width) for so many rows: two texts of similarity s share a band with probability 1 - (1 - s^width)^bands.

    Chance pairs grow with the square of the rows, so bands get longer with them and more, at the same recall."""
    width = WIDTH + max(0, ceil(log10(max(1, rows) / WIDTH_ROWS)))
    return max(1, ceil(log(1 - RECALL) / log(1 - min(0.999, threshold**width)))), width


def _texts(narrow: DataFrame, min_words: int, bands: int, width: int) -> DataFrame:
    """(id, fp, n, registers, keys, hot): each text that counts, and once in a task for equal texts the registers of the
    joint estimate and the band keys.  Rows without fp only name hot keys, which occur often in what a task looks at."""

    def run(batches):
        shingler, seen = Shingler(), set()
        banded, joint = Family(bands * width), Family(JOINT, first=1 << 20, base=JOINT_BASE, q=JOINT_Q)
        looked: list[np.ndarray] = []
        size = 0

        def hot() -> np.ndarray:
            keys, counts = np.unique(np.concatenate(looked), return_counts=True)
            looked.clear()
            return keys[counts >= LOOK_HOT]

        def named(keys: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"hot": keys.tolist()}], schema)

        schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("registers", pa.binary()), ("keys", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64()))])
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                if len(seen) > SEEN:
                    seen.clear()
                rows, own, fps = shingler.of(part, min_words)
                first = np.zeros(len(rows), bool)
                for k, fp in enumerate(fps.tolist()):
                    if fp not in seen:
                        seen.add(fp)
                        first[k] = True
                sets = [own[k] for k in np.flatnonzero(first)]
                keys = band_keys(banded.of_sets(sets), bands)
                registers: list[bytes | None] = [None] * len(rows)
                for i, r in zip(np.flatnonzero(first), joint.of_sets(sets)):
                    registers[i] = r.tobytes()
                ends = np.concatenate([[0], np.cumsum(first * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                columns = [part.column("id").take(pa.array(rows, pa.int64())), pa.array(fps, pa.int64()), pa.array(list(map(len, own)), pa.int64()), pa.array(registers, pa.binary()), lists, pa.nulls(len(rows), schema.field("hot").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                looked.append(keys.ravel())
                size += keys.size
                if size >= LOOK:
                    size = 0
                    if len(found := hot()):
                        yield named(found)
        if looked and len(found := hot()):
            yield named(found)

    return narrow.mapInArrow(run, "id long, fp long, n long, registers binary, keys array<long>, hot array<long>")


def _pairs_of_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different fps under an equal key, where rows are in order of both and no run is hot."""
    a, b, step = [], [], 1
    first = np.arange(len(keys))
    while True:
        first = first[: len(first)][first + step < len(keys)]
        first = first[keys[first] == keys[first + step]]
        if not len(first):
            break
        a.append(fps[first])
        b.append(fps[first + step])
        step += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _collisions(bands: DataFrame) -> DataFrame:
    """(key, a, b): pairs of texts under one band key, with a null key; texts of a hot key one by one, with its key and a null b."""

    def run(batches):
        rest = (np.empty(0, np.int64), np.empty(0, np.int64))
        hot = None  # the key whose texts are passed on one by one

        def out(keys, fps):
            nonlocal hot
            keep = np.ones(len(keys), bool)
            keep[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
            keys, fps = keys[keep], fps[keep]
            starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
            sizes = np.diff(np.append(starts, len(keys)))
            many = np.repeat((sizes > HOT) | (keys[starts] == hot if hot is not None else False), sizes)
            a, b = _pairs_of_runs(keys[~many], fps[~many])
            n = len(a)
            hot_keys, hot_fps = keys[many], fps[many]
            key = pa.array(np.concatenate([np.zeros(n, np.int64), hot_keys]), mask=np.arange(n + len(hot_keys)) < n)
            second = pa.array(np.concatenate([b, np.zeros(len(hot_keys), np.int64)]), mask=np.arange(n + len(hot_keys)) >= n)
            return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([a, hot_fps])), second], ["key", "a", "b"])

        for batch in batches:
            keys = np.concatenate([rest[0], batch.column("key").to_numpy()])
            fps = np.concatenate([rest[1], batch.column("fp").to_numpy()])
            if not len(keys):
                continue
            edge = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if len(keys) - edge > HOT:  # its texts needn't be held
                yield out(keys[:edge], fps[:edge])
                hot = int(keys[-1])
                yield out(keys[edge:], fps[edge:])
                rest = (np.empty(0, np.int64), np.empty(0, np.int64))
            elif hot is not None and keys[-1] == hot:
                yield out(keys, fps)
                rest = (np.empty(0, np.int64), np.empty(0, np.int64))
            else:
                yield out(keys[:edge], fps[:edge])
                rest = (keys[edge:], fps[edge:])
        if len(rest[0]):
            yield out(*rest)

    return bands.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "key long, a long, b long")


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """For pairs of registers and set sizes: sizes allow the threshold, and the joint likelihood estimate isn't clearly
    under it."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / JOINT) ** 0.5
    near = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    at = np.flatnonzero(near)
    near[at] = reaches(a[at], b[at], n[at], m[at], JOINT_BASE, least)
    return near


def _estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are likely."""

    def make():
        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, JOINT) for c in ("ra", "rb"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            return batch.select(["a", "b", "ida", "idb"]).filter(pa.array(likely(a, b, n, m, threshold)))

        return handle

    return per_batch(pairs, make, "a long, b long, ida long, idb long")


def _hot_pairs(hot: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ida, idb): the likely pairs of texts under hot keys (key, fp), without naming the others.

    A key's texts are dealt into blocks; every pair of blocks is compared by registers in a task of its own, which
    passes on only what is likely.  Its work is quadratic in a hot key's texts, but nothing is left out."""
    rows = hot.dropDuplicates().join(classes.select("fp", "rep", "n", "registers"), "fp")
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(sizes) if sizes.count() <= SMALL_SIDE else sizes, "key").withColumn("block", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
    cells = dealt.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    cells = cells.select("key", "fp", "rep", "n", "registers", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        fp, rep, n, block = (table.column(c).to_numpy() for c in ("fp", "rep", "n", "block"))
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, JOINT)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = [np.empty((2, 0), np.int64)]
        for x in left.tolist():
            y = right[fp[right] > fp[x]] if i == j else right
            one = np.full(len(y), x)
            good = likely(registers[one], registers[y], n[one].astype(float), n[y].astype(float), threshold)
            found.append(np.stack([one[good], y[good]]))
        x, y = np.concatenate(found, axis=1)
        swap = fp[x] > fp[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pa.table({"a": fp[x], "b": fp[y], "ida": rep[x], "idb": rep[y]})

    return cells.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, ida long, idb long")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): the exact Jaccard similarity of the pairs' texts, where it reaches the threshold."""

    def make():
        shingler = Shingler()

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.to_pydict()
            kept = {x: None for x in (*zip(rows["ta"], rows["ba"]), *zip(rows["tb"], rows["bb"]))}
            texts = list(kept)
            at, sets, _ = shingler.sets([x[0] for x in texts], [x[1] for x in texts], 1)
            for i, own in zip(at, sets):
                kept[texts[i]] = own
            similar = []
            for ta, ba, tb, bb in zip(rows["ta"], rows["ba"], rows["tb"], rows["bb"]):
                x, y = kept[ta, ba], kept[tb, bb]
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(both / (len(x) + len(y) - both))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar, pa.float64())], ["a", "b", "similarity"])
            return out.filter(pc.greater_equal(out.column("similarity"), threshold))

        return handle

    return per_batch(pairs, make, "a long, b long, similarity double")


class NearDuplicates:
    """Near-duplicate texts of a table.

    A text counts if its id isn't null and its body has at least `min_words` words (maximal runs of letters and
    digits, lower case).  Two are similar if the sets of adjacent word pairs of title, a space and body (null
    title = empty) have a Jaccard similarity of at least `threshold`.  Texts with equal sets form a class; links
    are found between classes, so copies cost nothing more however many they are.

    SetSketch registers are banded, in a shape that goes by the number of rows; classes that share a band are
    candidates, which the joint likelihood estimate thins out and an exact comparison of the texts verifies.  Keys
    that a task sees often are hot: they are kept out of the shuffle by key, and their texts compared in blocks, as
    are those of other keys of more than HOT texts.
    The candidates aren't capped.

    members: (id, fp), the class of each text that counts.  links: (a, b, similarity), between class ids, a < b.
    Repeated ids are kept as rows; null, empty and short bodies are left out; an empty table gives empty results."""

    def __init__(self, df: DataFrame, *, id_col: str = "id", title_col: str = "title", body_col: str = "body", min_words: int = 40, threshold: float = 0.6):
        narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(title_col).cast("string").alias("title"), F.col(body_col).cast("string").alias("body")).where("id is not null and body is not null")
        bands, width = shape(narrow.count(), threshold)
        texts = written(_texts(narrow, min_words, bands, width), "texts")
        self.members = texts.where("fp is not null").select("id", "fp")
        classes = texts.where("fp is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("registers").alias("registers"), F.count("*").alias("copies"))
        self.classes = classes = written(classes, "classes")
        keys = texts.where("size(keys) > 0").select("fp", F.explode("keys").alias("key"))
        hot = cut(texts.where("hot is not null").select(F.explode("hot").alias("key")).distinct())
        n_hot = hot.count()
        hot = F.broadcast(hot) if n_hot <= SMALL_SIDE else hot
        found = written(_collisions(keys.join(hot, "key", "left_anti") if n_hot else keys), "collisions")
        candidates = found.where("key is null").select("a", "b").dropDuplicates()
        side = classes.select("fp", "rep", "n", "registers")
        one, two = (side.select(F.col("fp").alias(x), F.col("rep").alias(f"id{x}"), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}")) for x in "ab")
        near = _estimated(candidates.join(one, "a").join(two, "b"), threshold)
        late = found.where("key is not null").select("key", F.col("a").alias("fp"))
        if n_hot or not late.isEmpty():
            late = late.unionAll(keys.join(hot, "key", "left_semi").select("key", "fp")) if n_hot else late
            near = near.unionAll(_hot_pairs(late, classes, threshold)).dropDuplicates(["a", "b"])
        near = cut(near)
        wanted = near.select(F.col("ida").alias("id")).unionAll(near.select(F.col("idb").alias("id"))).dropDuplicates()
        wanted = F.broadcast(wanted) if wanted.count() <= SMALL_SIDE else wanted
        # a repeated id may stand for several texts; the one of the class is told by its fingerprint
        texts = narrow.join(wanted, "id", "left_semi")
        texts = cut(_with_class(texts, min_words))
        one, two = (texts.select(F.col("fp").alias(x), F.col("title").alias(f"t{x}"), F.col("body").alias(f"b{x}")) for x in "ab")
        self.links = cut(_verified(near.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "ba", "tb", "bb"), threshold))

    def pairs(self, expand: int = 32) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all similar pairs of texts.

        The copies of a class of more than `expand` stand in links to other texts by their smallest id, and among
        themselves as one pair with it each, instead of as all their pairs."""
        copies = self.classes.select("fp", "rep", "copies")
        linked = self.links.select(F.col("a").alias("fp")).unionAll(self.links.select(F.col("b").alias("fp"))).dropDuplicates()
        needed = copies.join(linked.withColumn("linked", F.lit(True)), "fp", "left").where("linked or copies > 1")
        members = cut(self.members.select("id", "fp").join(needed, "fp"))
        several = members.where("copies > 1")
        same = several.where(F.col("copies") <= expand).select("fp", "id")
        within = same.alias("x").join(same.alias("y"), "fp").where("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
        star = several.where((F.col("copies") > expand) & (F.col("id") > F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
        ends = members.where("linked").where((F.col("copies") <= expand) | (F.col("id") == F.col("rep"))).select("fp", "id")
        one, two = (ends.select(F.col("fp").alias(x), F.col("id").alias(f"id{x}")) for x in "ab")
        across = self.links.join(one, "a").join(two, "b").where("ida <> idb").select(F.least("ida", "idb").alias("id_a"), F.greatest("ida", "idb").alias("id_b"))
        return within.unionAll(star).unionAll(across).dropDuplicates()


    def groups(self) -> DataFrame:
        """(id, group_id, class_id, links): one row for each text that counts.

        group_id is the smallest class id of the texts that are linked over any number of links, class_id the
        smallest id of the texts with an equal set, links the number of other classes linked to it."""
        reps = self.classes.select("fp", F.col("rep").alias("class_id"))
        ends = reps.withColumnRenamed("fp", "a").withColumnRenamed("class_id", "ra"), reps.withColumnRenamed("fp", "b").withColumnRenamed("class_id", "rb")
        edges = cut(self.links.select("a", "b").join(ends[0], "a").join(ends[1], "b").select("ra", "rb"))
        found = components(edges, "ra", "rb").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
        degree = edges.select(F.col("ra").alias("class_id")).unionAll(edges.select("rb")).groupBy("class_id").agg(F.count("*").alias("links"))
        rows = self.members.select("id", "fp").join(reps, "fp").join(found, "class_id", "left").join(degree, "class_id", "left")
        return rows.select("id", F.coalesce("group_id", "class_id").alias("group_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _with_class(texts: DataFrame, min_words: int) -> DataFrame:
    """(fp, title, body), once for each class and task."""

    def make():
        shingler, seen = Shingler(), set()

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(seen) > SEEN:
                seen.clear()
            rows, fps = [], []
            at, _, marks = shingler.of(batch, min_words)
            for i, fp in zip(at, marks.tolist()):
                if fp not in seen:
                    seen.add(fp)
                    rows.append(i)
                    fps.append(fp)
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), batch.column("title").take(at), batch.column("body").take(at)], ["fp", "title", "body"])

        return handle

    return per_batch(texts, make, "fp long, title string, body string").dropDuplicates(["fp"])
