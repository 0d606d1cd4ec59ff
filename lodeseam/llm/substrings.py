"""Substring dedup by repeated-phrase automata.

A word goes if a window of `window` consecutive words covers it whose word sequence also starts anywhere else.

1. Phrases: in each document, of the phrases of `phrase` words inside a window the one with the smallest hash is the
   window's anchor. Equal windows have the same anchor at the same place of theirs, and neighbouring windows share one, so
   anchors are few. Anchors are counted by partial aggregation; the words around one that occurs twice or more, as far
   as its windows reach, are a stretch (62 words at most).
2. Confirm: equal stretches are made one, with their number but without their places. Of those around one anchor, the
   windows are compared word by word; windows counted twice or more, joined where they overlap, are the recurring
   passages. An anchor with over HOT different stretches has its windows counted over all tasks, by 128-bit digests.
3. Locate: passages and the stretches of all documents meet in shards by anchor, of about HOT stretches and HOT passages
   at most: more of either are dealt out, each part of one against each of the other. A task compiles an Aho-Corasick
   automaton of the passages of some shards, SHARD_BYTES at a time, streams their stretches through it, and every word inside an occurrence goes.
   A document so visits those shards only that its phrases can reach.

Hashes decide what is compared, words what is removed: places come from the automata's matches alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_hot, save, texts

WINDOW, PHRASE = 35, 8
#: Different stretches around an anchor that one group compares, and stretches or passages that one shard holds, on average;
#: bytes of passages and stretches of one automaton; bytes of stretches that a task hands on at a time.
HOT, SHARD_BYTES, OUT_BYTES = 500, 1 << 20, 2 << 20

_B = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_B, -1, 1 << 64)
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_B, _INVERSE)):
            _POWERS[k] = np.r_[np.uint64(1), np.cumprod(np.full(size - 1, base, np.uint64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one byte of every word."""
    gap = _GAP[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True]))
    return edge[::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    first, last = spans(text)
    up, down = _powers(len(text) + 1)
    total = np.r_[np.uint64(0), np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:-1])]
    return _mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by doubling."""
    if len(h) < n:
        return h[:0]
    out, have, block, size = None, 0, h, 1
    while True:
        if n & size:
            out = block[: len(h) - n + 1] if out is None else out * np.uint64(pow(_B, size, 1 << 64)) + block[have : have + len(h) - n + 1]
            have += size
        if have == n:
            return _mix(out)
        block = block[:-size] * np.uint64(pow(_B, size, 1 << 64)) + block[size:]
        size *= 2


def anchors(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every phrase, place of every window's anchor); the first of equal ones."""
    g = rolled(h, phrase)
    if len(h) < window:
        return g, np.zeros(0, np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(g, window - phrase + 1)
    return g, wide.argmin(axis=1) + np.arange(len(wide))


def cut(stretch: bytes, window: int) -> list[bytes]:
    """The windows of a stretch, whose words stand one space apart."""
    ends = [*np.flatnonzero(np.frombuffer(stretch, np.uint8) == 32).tolist(), len(stretch)]
    firsts = [0, *(e + 1 for e in ends[:-1])]
    return [stretch[a:b] for a, b in zip(firsts, ends[window - 1 :], strict=False)]


def joined(stretch: bytes, recurs: list[bool], window: int) -> set[bytes]:
    """The passages of a stretch: its runs of recurring windows."""
    if all(recurs):
        return {stretch}
    words, out, first = stretch.split(b" "), set(), None
    for k, yes in enumerate([*recurs, False]):
        if yes and first is None:
            first = k
        elif not yes and first is not None:
            out.add(b" ".join(words[first : k + window - 1]))
            first = None
    return out


def passages(group: list[tuple[bytes, int]], window: int) -> set[bytes]:
    """The recurring passages of the (stretch, times) around one anchor, compared by their words."""
    if len(group) == 1 and group[0][1] > 1:
        return {group[0][0]}
    each, times = [cut(stretch, window) for stretch, _ in group], {}
    for windows, (_, n) in zip(each, group, strict=True):
        for w in windows:
            times[w] = times.get(w, 0) + n
    out: set[bytes] = set()
    for windows, (stretch, _) in zip(each, group, strict=True):
        out |= joined(stretch, [times[w] > 1 for w in windows], window)
    return out


def locate(passages: Iterable[bytes], stretches: Iterable[bytes]) -> Iterator[list[tuple[int, int]]]:
    """For each stretch the [first word, words] runs that lie in an occurrence of any passage, found by one automaton over
    word ids. Words of no passage are all 0, which no passage has."""
    vocabulary: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        automaton.add_word(tuple([vocabulary.setdefault(w, len(vocabulary) + 1) for w in p.split(b" ")]))
    automaton.make_automaton()
    known: dict[bytes, list[tuple[int, int]]] = {}
    for stretch in stretches:
        if stretch not in known:
            runs: list[list[int]] = []
            for last, n in automaton.iter(tuple([vocabulary.get(w, 0) for w in stretch.split(b" ")])) if vocabulary else ():
                first = last + 1 - n
                while runs and runs[-1][0] >= first:
                    runs.pop()
                if runs and runs[-1][1] >= first:
                    runs[-1][1] = last + 1
                else:
                    runs.append([first, last + 1])
            known[stretch] = [(a, b - a) for a, b in runs]
        yield known[stretch]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with two hashes of doc_id and text; rows that agree in both are the same in all that matters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))


def _stretches(rows: DataFrame, window: int, phrase: int, hashes) -> DataFrame:
    """(anchor, k1, k2, first, words): the stretches of all documents around anchors that occur twice or more."""

    def find(batches):
        for batch in batches:
            at, keys = [], []
            for t in texts(batch, 0):
                g, where = anchors(hashes(t), window, phrase)
                where = np.unique(where)
                at.append(where.astype(np.int32))
                keys.append(g[where].view(np.int64))
            sizes = np.cumsum([0, *map(len, at)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(x) if x else [], k)) for x, k in ((at, pa.int32()), (keys, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *lists], names=["k1", "k2", "at", "anchor"])

    found = save(rows.select("text", "k1", "k2").mapInArrow(find, "k1 long, k2 long, at array<int>, anchor array<long>"), "anchors")
    flat = found.select("k1", "k2", F.explode(F.arrays_zip("at", "anchor")).alias("x")).select("k1", "k2", "x.at", "x.anchor")
    twice = save(found.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    # equal rows have equal anchors: one row of them is enough to look up by
    marked = join_hot(flat, twice, ["anchor"], "n", "inner").groupBy("k1", "k2").agg(F.collect_set("at").alias("marks"))

    def rows_of(columns):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["anchor", "k1", "k2", "first", "words"])

    def around(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for text, k1, k2, marks in zip(texts(batch, 0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                g, where = anchors(hashes(text), window, phrase)
                words, marks = text.split(), set(marks)
                edge = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]).tolist()
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if (place := int(where[a])) in marks:
                        stretch = b" ".join(words[a : b + window - 1])
                        for column, x in zip(out, (int(g[place].view(np.int64)), k1, k2, a, stretch.decode()), strict=True):
                            column.append(x)
                        size += len(stretch)
                        if size >= OUT_BYTES:
                            yield rows_of(out)
                            out, size = [[], [], [], [], []], 0
            yield rows_of(out)

    cut_out = rows.select("text", "k1", "k2").join(marked, ["k1", "k2"]).select("text", "k1", "k2", "marks")
    stretches = save(cut_out.mapInArrow(around, "anchor long, k1 long, k2 long, first int, words string"), "stretches")
    drop(found, twice)
    return stretches


def _confirmed(stretches: DataFrame, window: int) -> DataFrame:
    """(anchor, words): the recurring passages of each anchor, each once."""
    different = save(stretches.groupBy("anchor", "words").agg(F.count(F.lit(1)).alias("times")), "different")
    wide = save(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("wide")).where(F.col("n") > HOT), "wide")
    told = join_hot(different, wide, ["anchor"], "n")

    def confirm(batches):
        now, group = None, []

        def rows(of):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in of], pa.int64()), pa.array([w.decode() for _, w in of], pa.string())], names=["anchor", "words"])

        for batch in batches:
            out = []
            for anchor, words, times in zip(batch.column(0).to_pylist(), texts(batch, 1), batch.column(2).to_pylist(), strict=True):
                if anchor != now:
                    out += [(now, p) for p in passages(group, window)] if group else []
                    now, group = anchor, []
                group.append((words, times))
            yield rows(out)
        if group:
            yield rows([(now, p) for p in passages(group, window)])

    cold = told.where("wide is null").select("anchor", "words", "times").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(confirm, "anchor long, words string")

    def digests(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for words, s1, s2, times in zip(texts(batch, 0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                for k, w in enumerate(cut(words, window)):
                    d = np.frombuffer(hashlib.blake2b(w, digest_size=16).digest(), "<i8")
                    for column, x in zip(out, (s1, s2, times, k, int(d[0]), int(d[1])), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["s1", "s2", "times", "at", "d1", "d2"])

    def recurring(batches):
        for batch in batches:
            out: list[list] = [[], []]
            for anchor, words, at in zip(batch.column(0).to_pylist(), texts(batch, 1), batch.column(2).to_pylist(), strict=True):
                at = set(at)
                for p in joined(words, [k in at for k in range(words.count(b" ") + 2 - window)], window):
                    out[0].append(anchor)
                    out[1].append(p.decode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["anchor", "words"])

    of_wide = told.where("wide").select("anchor", "words", "times", F.xxhash64("anchor", "words").alias("s1"), F.xxhash64(F.lit(1), "anchor", "words").alias("s2"))
    each = save(of_wide.select("words", "s1", "s2", "times").mapInArrow(digests, "s1 long, s2 long, times long, at int, d1 long, d2 long"), "windows")
    sure = save(each.groupBy("d1", "d2").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 1").drop("times"), "sure")
    marks = join_hot(each, sure, ["d1", "d2"], "rows", "inner").groupBy("s1", "s2").agg(F.collect_set("at").alias("at"))
    hot = of_wide.join(marks, ["s1", "s2"]).select("anchor", "words", "at").mapInArrow(recurring, "anchor long, words string").distinct()
    out = save(cold.unionByName(hot), "passages")
    drop(different, wide, each, sure)
    return out


def runs(rows: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hashes=word_hashes, stream=locate) -> DataFrame:
    """(k1, k2, runs): of each document with any, [first word, words] of the occurrences of recurring passages. `rows` as from
    _keyed(). stream: what finds the passages in the stretches of a shard, see locate()."""
    stretches = _stretches(rows, window, phrase, hashes)
    found = _confirmed(stretches, window)
    # Shards of anchors with much of either: `deals` parts of the stretches, each against `parts` of the passages.
    n = stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    n_passages = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_passages"))
    much = n.join(n_passages, "anchor").where((F.col("n") > HOT) | (F.col("n_passages") > HOT))
    much = save(much.select("anchor", "n", "n_passages", F.ceil(F.col("n") / HOT).cast("int").alias("deals"), F.ceil(F.col("n_passages") / HOT).cast("int").alias("parts")), "much")
    # dealt by what a row holds: a task that is run again has its rows in another order
    one, row, text = F.lit(1), F.xxhash64("k1", "k2", "first"), F.xxhash64("words")
    left = join_hot(stretches, much.drop("n_passages"), ["anchor"], "n").withColumn("deal", F.pmod(row, F.coalesce("deals", one)).cast("int"))
    left = left.select("anchor", "deal", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1)).alias("part"), "k1", "k2", "first", "words")
    right = join_hot(found, much.drop("n"), ["anchor"], "n_passages").withColumn("part", F.pmod(text, F.coalesce("parts", one)).cast("int"))
    right = right.select("anchor", F.explode(F.sequence(F.lit(0), F.coalesce("deals", one) - 1)).alias("deal"), "part", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), F.lit(-1).alias("first"), "words")
    met = left.unionByName(right).repartition("anchor", "deal", "part").sortWithinPartitions("anchor", "deal", "part", "first")

    def find(batches):
        shard, now, size = None, set(), 0
        known: set[bytes] = set()
        held: list[tuple] = []

        def streamed():
            out: list[list] = [[], [], [], []]
            for (k1, k2, first, _), places in zip(held, stream(known, [x[3] for x in held]), strict=True):
                for a, n in places:
                    for column, x in zip(out, (k1, k2, first + a, n), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["k1", "k2", "first", "n"])

        for batch in batches:
            for key, k1, k2, first, words in zip(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True), *(batch.column(k).to_pylist() for k in (3, 4, 5)), texts(batch, 6), strict=True):
                if key != shard:
                    if size >= SHARD_BYTES:
                        yield streamed()
                        known, held, size = set(), [], 0
                    shard, now = key, set()
                if first < 0:  # the passages of a shard come before its stretches
                    now.add(words)
                    known.add(words)
                    size += len(words)
                elif now:
                    held.append((k1, k2, first, words))
                    size += len(words)
        if held:
            yield streamed()

    each = met.select("anchor", "deal", "part", "k1", "k2", "first", "words").mapInArrow(find, "k1 long, k2 long, first int, n int")
    out = save(each.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("runs")), "runs")
    drop(stretches, found, much)
    return out


def _cut(docs: DataFrame, window: int, phrase: int, schema: str, result, hashes, stream) -> DataFrame:
    """result(doc_id, words, words removed as a mask, or None if there are none) for every row."""
    rows = _keyed(docs)
    found = runs(rows, window, phrase, hashes, stream)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, marks in zip(batch.column(0).to_pylist(), texts(batch, 1), batch.column(2).to_pylist(), strict=True):
                words, mask = text.split(), None
                if marks:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [m["first"] for m in marks], 1)
                    np.add.at(change, [m["first"] + m["n"] for m in marks], -1)
                    mask = np.cumsum(change[:-1]) > 0
                out.append(result(doc_id, words, mask))
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    return rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _left(words: list[bytes], mask) -> list[bytes]:
    return words if mask is None else [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]


def remove(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hashes=word_hashes, stream=locate) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): kept is the words that stay, joined by one space.

    A null or empty text has no words, and one of fewer than `window` words loses none. Rows of equal or null doc_id are
    documents of their own, and repeated rows repeat each other's windows; there are no ties, as every occurrence goes.
    Of a very long text only some 60 words are compared at a time. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """

    def result(doc_id, words, mask):
        left = _left(words, mask)
        kept = b" ".join(left)
        return {"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(left), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode()}

    return _cut(docs, window, phrase, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", result, hashes, stream)


def report(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hashes=word_hashes, stream=locate) -> DataFrame:
    """remove() without the kept texts."""

    def result(doc_id, words, mask):
        left = _left(words, mask)
        return {"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(left), "kept_sha256": hashlib.sha256(b" ".join(left)).hexdigest()}

    return _cut(docs, window, phrase, "doc_id long, n_words long, n_removed long, kept_sha256 string", result, hashes, stream)
