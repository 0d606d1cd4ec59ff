"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: by the level of their document frequency (its power of two), and within a level by hash.

1. Sets: a task hashes the n-grams of its documents. Equal sets get one label, by digest, and are one class from then on. The
   n-grams are dealt by ranges of their hashes; a range finds which ones occur in several sets, and at what level. An n-gram
   that many documents of one task have is marked there as common, which is the last level, and its documents' rows stay
   out of the range: it has no more rows for an n-gram that a third of all documents share.
2. Candidates: two sets that are similar enough share an n-gram among the first of both in the global order (rare ones
   first), and enough can still follow it in both. N-grams of one class only come first in the order and lead nowhere; a set
   of which too few others recur has no partner and is done. The rest meet by the n-grams of their prefixes.
3. Overlaps: the global order is cut into SLICES fragments of equal weight. Each counts what the two sets of a candidate pair
   share in it; a fragment in which they differ by more than the whole sets may differ rules the pair out; the counts of
   all fragments are summed by pair and held against the threshold.
4. Links become components. A group's pairs are not all made: first, each set is held against the set of its prefix n-gram's
   group that has the most common n-grams, mostly what the others are copies of. Then only groups that still have
   several components are taken up, in blocks of BLOCK sets: each block against itself, against the next, the one after,
   and so on until it has met them all, always pairs of different components only. No pair of sets with a common prefix
   n-gram is left out unless a chain of links connects them already.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, join_hot, save, texts
from .substrings import rolled, word_hashes

SIZE, PERCENT = 5, 80
#: N-grams of one range and those that a task gathers before it deals them out; documents of such a gathering from which on an
#: n-gram is common; fragments of the global order; sets in a block, and pairs that one step may make besides one block each.
RANGE, GATHER, COMMON, SLICES, BLOCK, PAIRS = 1 << 20, 1 << 20, 64, 8, 32, 1 << 22
#: Bits of a code below its level, and the level of common n-grams. A hash is known by its range and 48 bits more, of which a
#: code keeps 57 bits in all, enough to tell the n-grams of two sets apart; sizes are counted by all 64 bits.
LOW, HOT = 57, 60

DOCUMENT, SEGMENT, MARK, SHARED = range(4)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the different n-grams of the lower-cased text; fewer words are one n-gram of their number."""
    h = word_hashes(text.lower())
    if not len(h):
        return h
    short = max(0, size - len(h)) * 0x9E3779B97F4A7C15 & 2**64 - 1
    return np.unique(rolled(h, min(size, len(h))) ^ np.uint64(short))


def _label(held: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(held.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _bytes(grams: np.ndarray, bits: int) -> bytes:
    """The 48 bits behind those of the range, six bytes each."""
    return ((grams << np.uint64(bits)) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _known(data: bytes, part: int, bits: int) -> np.ndarray:
    """Hashes of a range from their bytes, as far as these tell."""
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    rest = wide.reshape(-1).view(np.uint64) << np.uint64(16)
    return (rest >> np.uint64(bits)) | (np.uint64(part << (64 - bits)) if bits else np.uint64(0))


def _codes(level: np.ndarray | int, grams: np.ndarray) -> np.ndarray:
    return ((np.asarray(level, np.uint64) << np.uint64(LOW)) | (grams >> np.uint64(64 - LOW))).view(np.int64)


def _dealt(batches: Iterable[pa.RecordBatch], bits: int, size: int, task: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, doc_id, n, a, b, owner, data, owners) from (doc_id, text). A DOCUMENT row each, with its label (a, b) and the
    owner of its set. SEGMENTs are the n-grams of a range (part) with their sets' numbers in this gathering (owner is its
    first); MARKs the common n-grams of a range, and SHARED the codes of all common n-grams of the gathering."""
    names = ["part", "kind", "doc_id", "n", "a", "b", "owner", "data", "owners"]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
    ranges, base = 1 << bits, task << 40
    docs: list[tuple] = []
    held: dict[tuple[int, int], np.ndarray] = {}
    n = 0

    def deal():
        number = {label: k for k, label in enumerate(held)}
        out = [(label[0] % ranges, DOCUMENT, d, m, *label, base + number[label] if m else None, None, None) for d, m, label in docs]
        if held:
            sizes = np.array([len(h) for h in held.values()])
            grams, owner = np.concatenate(list(held.values())), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order].astype(np.uint16)
            starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            times = np.diff(np.r_[starts, len(grams)])
            common = np.repeat(times >= COMMON, times)
            marks = grams[starts[times >= COMMON]]
            edges = (np.arange(ranges, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
            rare, whose = grams[~common], owner[~common]
            for found, kind in ((rare, SEGMENT), (marks, MARK)):
                cuts = np.r_[np.searchsorted(found, edges), len(found)]
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    span = slice(cuts[k], cuts[k + 1])
                    out.append((k, kind, None, None, None, None, base, _bytes(found[span], bits), whose[span].tobytes() if kind == SEGMENT else None))
            if len(marks):
                cut = np.uint64((1 << 64) - (1 << max(0, 16 - bits)))
                out.append(((base >> 16) % ranges, SHARED, None, None, None, None, base, _codes(HOT, grams[common] & cut).tobytes(), owner[common].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            found = shingles(text, size)
            label = _label(found)
            docs.append((doc_id, len(found), label))
            if len(found) and label not in held:
                held[label] = found
                n += len(found)
            if n >= GATHER or len(docs) >= 1 << 16:
                yield deal()
                docs, held, n, base = [], {}, 0, base + (1 << 16)
    if docs:
        yield deal()


def _range(grams: np.ndarray, owner: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, codes) of the n-grams of one whole range that recur, by owner."""
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    times = np.diff(np.r_[starts, len(grams)])
    level = np.frexp(times)[1] - 1
    level[np.isin(grams[starts], marks)] = HOT
    level = np.repeat(level, times)
    again = level > 0
    code, owner = _codes(level[again], grams[again]), owner[again]
    order = np.argsort(owner, kind="stable")
    return owner[order], code[order]


def _counted(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, a, b, owner, data, owners) of rows sorted by part: DOCUMENTs without data; of each gathering (owner is its
    first) the codes of the n-grams that recur, those of a range or those that are common, with the numbers of their sets."""
    names = ["doc_id", "n", "a", "b", "owner", "data", "owners"]

    def made(base, data, owners):
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(data), pa.int64())] * 4, pa.array(base, pa.int64()), pa.array(data, pa.binary()), pa.array(owners, pa.binary())], names=names)

    def flush():
        if segments:
            grams = np.concatenate([_known(s[0], now, bits) for s in segments])
            owner = np.concatenate([np.frombuffer(s[1], np.uint16).astype(np.int64) + s[2] for s in segments])
            who, code = _range(grams, owner, np.concatenate([_known(m, now, bits) for m in marks]) if marks else grams[:0])
            cuts = np.flatnonzero(np.r_[True, (who[1:] >> 16) != (who[:-1] >> 16)]) if len(who) else []
            spans = [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(who)], strict=True)] if len(who) else []
            yield made([int(who[x.start]) >> 16 << 16 for x in spans], [code[x].tobytes() for x in spans], [(who[x] & 0xFFFF).astype(np.uint16).tobytes() for x in spans])
        segments.clear()
        marks.clear()

    segments: list[tuple] = []
    marks: list[bytes] = []
    now = None
    for batch in batches:
        part, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        rows = batch.take(pa.array(np.flatnonzero(kind == DOCUMENT)))
        if rows.num_rows:
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in (2, 3, 4, 5, 6)), *[pa.nulls(rows.num_rows, pa.binary())] * 2], names=names)
        rows = batch.take(pa.array(np.flatnonzero(kind == SHARED)))
        if rows.num_rows:
            yield made(rows.column(6), rows.column(7), rows.column(8))
        for k in np.flatnonzero((kind == SEGMENT) | (kind == MARK)).tolist():
            if part[k] != now:
                yield from flush()
            now = int(part[k])
            data = batch.column(7)[k].as_py()
            if kind[k] == SEGMENT:
                segments.append((data, batch.column(8)[k].as_py(), batch.column(6)[k].as_py()))
            else:
                marks.append(data)
    yield from flush()


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, codes) of each set, from the rows (owner, data, owners) of whole gatherings, sorted by owner."""

    def flush():
        code = np.concatenate([np.frombuffer(d, np.int64) for d, _ in held])
        who = np.concatenate([np.frombuffer(o, np.uint16) for _, o in held])
        order = np.lexsort((code, who))
        code, who = code[order], who[order]
        heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(code)].astype(np.int32)), pa.array(code))
        return pa.RecordBatch.from_arrays([pa.array(who[heads].astype(np.int64) + now), lists], names=["cid", "codes"])

    held: list[tuple[bytes, bytes]] = []
    now = None
    for batch in batches:
        for owner, data, owners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if owner != now and held:
                yield flush()
                held = []
            now = owner
            held.append((data, owners))
    if held:
        yield flush()


def least_shared(n, percent: int):
    """The smallest part of n that a partner must share, by which it is at least as long and has so many in common."""
    return F.ceil(n * percent / 100)


class Sets:
    """The classes that may have partners: written tables of their recurring n-grams, whole and by fragment."""

    def __init__(self, found: DataFrame, classes: DataFrame, percent: int):
        self.percent = percent
        rows = found.where("data IS NOT NULL").select("owner", "data", "owners").repartition("owner").sortWithinPartitions("owner")
        codes = rows.mapInArrow(_gathered, "cid long, codes array<long>")
        few = codes.join(classes.select(F.col("owner").alias("cid"), "n"), "cid").where(F.size("codes") >= least_shared(F.col("n"), percent))
        weight = F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + F.shiftright(c, LOW)) / F.col("n")
        self.sets = save(few.select("cid", "n", "codes", weight.alias("weight")), "sets")
        self.slices = save(self._sliced(), "slices")

    def _sliced(self) -> DataFrame:
        """(cid, slice, n, codes): sets cut at pivots of the global order, between which all sets together have equally many."""
        weight = {r.l: r.c for r in self.sets.select(F.explode("codes").alias("c")).groupBy(F.shiftright("c", LOW).alias("l")).agg(F.count(F.lit(1)).alias("c")).collect()}  # under 64 levels
        total, cuts, sum_, want = sum(weight.values()), [0], 0, 1
        for at in sorted(weight):
            while want < SLICES and total * want < (sum_ + weight[at]) * SLICES:
                cuts.append((at << LOW) + ((total * want - sum_ * SLICES) * (1 << LOW)) // (weight[at] * SLICES))
                want += 1
            sum_ += weight[at]
        spans = list(zip(cuts, [*cuts[1:], (1 << 63) - 1], strict=True))
        inside = lambda lo, hi: F.filter("codes", lambda c: (c >= lo) & (c < hi))
        out = self.sets.select("cid", "n", F.posexplode(F.array(*[inside(lo, hi) for lo, hi in spans])).alias("slice", "codes"))
        return out.where(F.size("codes") > 0)

    def prefixes(self) -> DataFrame:
        """(code, cid, n, place, weight): the n-grams of each set's prefix that recur, with their places in the whole set's
        order; weight is the mean level of the set's n-grams."""
        size, need = F.size("codes"), least_shared(F.col("n"), self.percent)
        first = F.posexplode(F.slice("codes", F.lit(1), (size - need + 1).cast("int")))
        return self.sets.select("cid", "n", (F.col("n") - size).alias("alone"), "weight", first.alias("i", "code")).select("code", "cid", "n", (F.col("alone") + F.col("i")).alias("place"), "weight")

    def possible(self, a: str, b: str):
        """Whether two sets can be similar enough by their sizes, and by what can follow a common n-gram in each of them."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        need = F.ceil((n + m) * self.percent / (100 + self.percent))
        left = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (left >= need)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the different pairs (a, b) of class ids that are similar enough, by counts of all fragments."""
        pairs = save(pairs, "pairs")
        often = save(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times")), "often")
        # a set with many pairs is dealt out in copies
        copies = F.ceil(F.col("times") / 256).cast("int")
        dealt = join_hot(pairs, often.select("a", "times", copies.alias("copies")), ["a"], "times").select("a", "b", F.pmod(F.hash("b"), F.col("copies")).alias("copy"))
        right = dealt.join(self.slices.select(F.col("cid").alias("b"), "slice", F.col("n").alias("n_b"), F.col("codes").alias("in_b")), "b")
        left = self.slices.select(F.col("cid").alias("a"), "slice", F.col("n").alias("n_a"), F.col("codes").alias("in_a")).join(often.select("a", copies.alias("copies")), "a")
        left = left.select("a", "slice", "n_a", "in_a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        both = right.join(left, ["a", "copy", "slice"]).select("a", "b", "n_a", "n_b", F.size("in_a").alias("s_a"), F.size("in_b").alias("s_b"), F.size(F.array_intersect("in_a", "in_b")).alias("shared"))
        differ = F.col("s_a") + F.col("s_b") - 2 * F.col("shared")
        counted = both.where(differ * (100 + self.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - self.percent))
        total = counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max(F.col("n_a") + F.col("n_b")).alias("n"))
        out = save(total.where(F.col("shared") * (100 + self.percent) >= F.col("n") * self.percent).select("a", "b"), "linked")
        drop(pairs, often)
        return out


def roots(sets: Sets) -> DataFrame:
    """(node, root) of all class ids with a link, as in components()."""
    keys = save(sets.prefixes(), "prefixes")
    least = F.struct("weight", (-F.col("cid")).alias("cid"), "n", "place")
    stats = save(keys.groupBy("code").agg(F.count(F.lit(1)).alias("m"), F.max(least).alias("of")).where("m > 1"), "groups")
    held = join_hot(keys, stats.select("code", "m", (-F.col("of.cid")).alias("lead"), F.col("of.n").alias("lead_n"), F.col("of.place").alias("lead_place")), ["code"], "m", "inner")
    star = held.where("cid != lead").select("cid", "lead", F.struct("n", "place").alias("x"), F.struct(F.col("lead_n").alias("n"), F.col("lead_place").alias("place")).alias("y"))
    links = sets.linked(star.where(sets.possible("x", "y")).select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct())
    grouped = save(join_hot(keys, stats.select("code", "m"), ["code"], "m", "inner"), "grouped")
    drop(keys, stats, sets.sets)
    now, shift = save(components(links), "components"), 0
    while True:
        named = grouped.join(now, grouped["cid"] == now["node"], "left").select("code", "cid", "n", "place", F.coalesce("root", "cid").alias("root"))
        open_ = named.groupBy("code").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        open_ = open_.select("code", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")).where(F.col("blocks") >= 2 * shift)
        open_ = save(open_, "open")
        size, most = open_.agg(F.sum("m"), F.max("blocks")).first()
        if not size:
            return now
        further = shift + max(1, PAIRS // (BLOCK * size))
        rest = save(join_hot(named, open_, ["code"], "m", "inner").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")), "rest")
        steps = F.filter(F.sequence(F.lit(shift), F.lit(further - 1)), lambda s: 2 * s <= F.col("blocks"))
        here = rest.select("code", F.struct("cid", "n", "place", "root").alias("x"), F.explode(steps).alias("s"), "block", "blocks")
        here = here.select("code", "x", "s", F.pmod(F.col("block") + F.col("s"), F.col("blocks")).alias("block"))
        there = rest.select("code", "block", F.struct("cid", "n", "place", "root").alias("y"))
        met = here.join(there, ["code", "block"]).where((F.col("x.root") != F.col("y.root")) & sets.possible("x", "y") & ((F.col("s") > 0) | (F.col("x.cid") < F.col("y.cid"))))
        more = sets.linked(met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct())
        # components only grow and blocks are met only once, so no group that is done now is taken up again
        left = save(rest.where(F.col("blocks") >= 2 * further).select("code", "cid", "n", "place"), "grouped")
        drop(rest, open_, grouped)
        grouped = left
        if not more.isEmpty():
            old, links = links, save(links.unionByName(more), "links")
            drop(old, more, now)
            now = save(components(links), "components")
        shift = further
        if 2 * shift > most:
            return now


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles (different n-grams of `size` words) and component_id, the smallest doc_id that can
    be reached by steps between documents of which 100 * common >= percent * all n-grams.

    A text of fewer words is one n-gram, equal only to one of the same words; null, empty and wordless texts have none and
    stay alone, with their own doc_id. A very long text is read whole by one task. Repeated rows and rows of equal doc_id stay
    apart; null doc_ids never name a component unless it has no other. Other columns are ignored, whatever their names; an
    empty table gives no rows. N-grams are told apart by 64-bit hashes, sets by 128 bits.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = two.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (-(-read // (6 * RANGE)) - 1).bit_length() if read else 0  # 2**bits ranges, of about RANGE n-grams at most

    def deal(batches):
        return _dealt(batches, bits, size, TaskContext.get().partitionId())

    dealt = two.mapInArrow(deal, "part int, kind int, doc_id long, n long, a long, b long, owner long, data binary, owners binary")
    found = save(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _counted(batches, bits), "doc_id long, n long, a long, b long, owner long, data binary, owners binary"), "counted")
    rows = save(found.where("data IS NULL").select("doc_id", "n", "a", "b", "owner"), "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
    classes = save(rows.groupBy("a", "b").agg(least, F.max("n").alias("n"), F.min("owner").alias("owner"), F.count(F.lit(1)).alias("rows")), "classes")
    sets = Sets(found, classes.where("n > 0"), percent)
    drop(found)  # its n-grams now lie in the sets
    linked = roots(sets).select(F.col("node").alias("owner"), "root")
    members = classes.join(linked, "owner", "left")
    named = save(members.where("root is not null").groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("m")), "named")
    told = join_hot(members, named, ["root"], "m").select("a", "b", "rows", F.coalesce("first", "least")["doc_id"].alias("first"))
    out = join_hot(rows.drop("owner"), save(told, "told"), ["a", "b"], "rows")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))
