"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are dealt to groups by some bits of each of three blocks: two that differ in at most two bits agree in
one block. The number of bits follows the number of fingerprints, so that a group has about CROWD of them at every size.
Those of a group are sorted by their rank in the Gray code, which puts codes with few differences close together, and put
under a hierarchy: a node has the bits on which all below it agree and its parent's node doesn't, so a query adds up the
differences to the shared patterns from the top, and drops a whole group once they exceed the limit. A group with over
GROUP fingerprints, as its bits are alike, is dealt anew by pairs of 16-bit blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop, each_batch, join_hot, save, texts

MAX_BITS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints of a group on average, and of one that is not dealt anew; children of an index node; queries that are followed at once.
CROWD, GROUP, FANOUT, QUERIES = 1000, 20_000, 16, 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of the lower-cased text: bit b is set if over half of the shingles' hashes have it, counting repeated shingles."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    firsts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    lasts = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(firsts, lasts, strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batch):
        return [batch.column(0), np.array([fingerprint(t, shingle) for t in texts(batch)], dtype=np.uint64).view(np.int64)]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each_batch(run, ("doc_id", pa.int64()), ("fp", pa.int64())), "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each unsigned 64-bit code in the binary-reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchies over groups of codes; a group's codes lie side by side, sorted by Gray rank."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, fanout: int = FANOUT):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # own mask, pattern, first and last child
        self.compared = 0  # patterns that queries were compared with
        mask, value, group = np.full(len(codes), ~np.uint64(0)), codes, groups
        first, last = np.arange(len(codes)), np.arange(1, len(codes) + 1)
        while True:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            if (sizes == 1).all():
                self.levels.append((mask, value, first, last))
                self.root_of = group
                return
            offset = np.arange(len(group)) - np.repeat(starts, sizes)
            heads = np.flatnonzero(offset % fanout == 0)
            ends = np.r_[heads[1:], len(group)]
            # bits that all children have fixed, with one value
            both = np.bitwise_and.reduceat(mask, heads) & ~(np.bitwise_or.reduceat(value, heads) ^ np.bitwise_and.reduceat(value, heads))
            up = np.repeat(both, ends - heads)
            self.levels.append((mask & ~up, value, first, last))
            mask, value, group = both, value[heads] & both, group[heads]
            first, last = heads, ends

    def links(self, codes: np.ndarray, roots: np.ndarray, limit: int):
        """(query, position of a code) arrays of all pairs at most `limit` bits apart, for blocks of queries."""
        for at in range(0, len(codes), QUERIES):
            q = np.arange(at, min(at + QUERIES, len(codes)))
            node, apart = roots[q], np.zeros(len(q), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, value, first, last = self.levels[depth]
                self.compared += len(q)
                apart = apart + np.bitwise_count((codes[q] ^ value[node]) & mask[node])
                near = apart <= limit
                q, node, apart = q[near], node[near], apart[near]
                if depth:
                    n = last[node] - first[node]
                    node = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    q, apart = np.repeat(q, n), np.repeat(apart, n)
            yield q, node


def _stars(keys: np.ndarray, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For (key, code) rows with whole keys: an edge from each code to the first of its connected codes in the key."""
    order = np.lexsort((gray_rank(codes), keys))
    keys, codes = keys[order], codes[order]
    alone = np.r_[True, keys[1:] != keys[:-1]] & np.r_[keys[1:] != keys[:-1], True]
    keys, codes = keys[~alone], codes[~alone]
    if not len(keys):
        return codes, codes
    group = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
    index = GrayIndex(codes, group)
    root = np.arange(len(codes))
    changed = True
    while changed:  # the links are found anew in each round rather than kept
        before = root.copy()
        for a, b in index.links(codes, group, limit):
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        changed = (root != before).any()
    far = root != np.arange(len(codes))
    return codes[far], codes[root[far]]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masked(fps: DataFrame, masks: list[int], tag: int) -> DataFrame:
    """Each fingerprint once for every mask, with its bits there as the key and tags counted from `tag`."""
    rows = F.explode(F.array(*[F.struct(F.lit(tag + k).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks)]))
    return fps.select("fp", rows.alias("x")).select("fp", F.col("x.tag").alias("tag"), F.col("x.key").alias("key"))


def _large(keyed: DataFrame, name: str) -> DataFrame:
    return save(keyed.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("large")).where(F.col("n") > GROUP), name)


def _spans(blocks: list[int]) -> list[int]:
    """The mask of each block between two neighbouring bit numbers."""
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(blocks[:-1], blocks[1:], strict=True)]


def _fine(fps: DataFrame) -> DataFrame:
    """(fp, tag, key) by the six pairs of 16-bit blocks, which two fingerprints at most two bits apart share one of; keys with
    over GROUP fingerprints are dealt anew by pairs of blocks of the other 32 bits, after which none can have over 2**16."""
    pairs = [a | b for a, b in combinations(_spans([0, 16, 32, 48, 64]), 2)]
    keyed = _masked(fps, pairs, 0)
    large = _large(keyed, "large")
    if large.isEmpty():
        return keyed
    hot = join_hot(keyed, large, ["tag", "key"], "n")
    out = hot.where("large is null").select("fp", "tag", "key")
    for tag, (i, j) in enumerate(combinations(range(4), 2)):
        other = [m for k in range(4) if k not in (i, j) for m in _spans([16 * k, 16 * k + 8, 16 * k + 16])]
        again = [pairs[tag] | a | b for a, b in combinations(other, 2)]
        out = out.unionByName(_masked(hot.where(F.col("large") & (F.col("tag") == tag)).select("fp"), again, 64 + 8 * tag))
    return out


def _coarse(fps: DataFrame) -> DataFrame:
    """(fp, tag, key): each fingerprint by some bits of each of three blocks, of which two fingerprints at most two bits apart
    share one. There are as many bits as make groups of about CROWD, so the index of a group has the same work to do at every
    size. Fingerprints of groups over GROUP are keyed by _fine() instead."""
    bits = min(21, max(0, (-(-fps.count() // CROWD) - 1).bit_length()))
    keyed = _masked(fps, [((1 << bits) - 1) << lo for lo in ((0, 21, 42) if bits else (0,))], 1 << 10)
    large = _large(keyed, "crowds")
    if large.isEmpty():
        return keyed
    met = join_hot(keyed, large, ["tag", "key"], "n")
    crowded = save(met.where("large").select("fp").distinct(), "crowded")
    return met.where("large is null").select("fp", "tag", "key").unionByName(_fine(crowded))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that are linked by steps of at most `max_bits`
    bits (0 to 2), a code and the root of its group each. `fps` must be a written table of distinct fingerprints."""
    if not 0 <= max_bits <= 2:
        raise ValueError("three blocks are enough for two bits")
    keyed = _coarse(fps)

    def run(batches):
        held, n = [], 0

        def flush(rows):
            a, b = _stars(rows[0], rows[1], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            tag, key, fp = (np.asarray(batch.column(k)) for k in range(3))
            held.append((tag.astype(np.int64), key, fp.view(np.uint64)))
            n += len(tag)
            if n >= GROUP:
                tag, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.flatnonzero((tag != tag[-1]) | (key != key[-1]))
                cut = cut[-1] + 1 if len(cut) else 0  # the last key may go on
                if cut:
                    yield flush((_dense(tag[:cut], key[:cut]), fp[:cut]))
                held, n = [(tag[cut:], key[cut:], fp[cut:])], len(tag) - cut
        if n:
            tag, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            yield flush((_dense(tag, key), fp))

    dealt = keyed.select("tag", "key", "fp").repartition("tag", "key").sortWithinPartitions("tag", "key")
    return dealt.mapInArrow(run, "a long, b long")


def _dense(tag: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Number of the (tag, key) run that each row is in."""
    return np.cumsum(np.r_[False, (tag[1:] != tag[:-1]) | (key[1:] != key[:-1])])


def _rooted(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, n, root) of every distinct fingerprint: least is the smallest `row` struct with it, n the rows."""
    distinct = save(rows.groupBy("fp").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    found = save(links(distinct.select("fp"), max_bits).distinct(), "links")
    roots = save(components(found), "roots")
    drop(found)
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that can be reached by
    steps between fingerprints at most `max_bits` bits apart.

    A null or empty text, or one without words, has fingerprint zero, which is linked like any other; a very long one is read
    whole by one task. Repeated rows and rows of equal doc_id stay apart, at a tie they name a component alike; null doc_ids
    never name one unless it has no other. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = save(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(rows.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("row")), max_bits)
    ids = save(rooted.groupBy("root").agg(F.min("least")["doc_id"].alias("component_id"), F.count(F.lit(1)).alias("n_fps")), "components")
    named = join_hot(rooted, ids, ["root"], "n_fps").select("fp", "n", "component_id")
    return join_hot(rows, save(named, "named"), ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with one row of each near-duplicate group: that of the smallest doc_id, and of equal ids any one, the same in
    each run. A null doc_id stays only if its group has no other. Null, empty and very long texts are as in near_duplicates().
    All columns are kept, whatever their names; map columns don't tell rows apart; an empty table gives no rows."""
    names = docs.columns
    told = [F.col("row")[f.name] for f in docs.schema.fields if f.dataType.typeName() != "map"]
    whole = docs.select(F.struct(*names).alias("row")).select("row", F.xxhash64(*told).alias("h1"), F.xxhash64(F.lit(1), *told).alias("h2"))

    def run(batch):
        return [batch.column(0), batch.column(2), batch.column(3), np.array([fingerprint(t, shingle) for t in texts(batch)], dtype=np.uint64).view(np.int64)]

    fields = [(n, pa.int64()) for n in ("doc_id", "h1", "h2", "fp")]
    rows = whole.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "h1", "h2").mapInArrow(each_batch(run, *fields), "doc_id long, h1 long, h2 long, fp long")
    rows = save(rows, "fingerprints").select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2").alias("row"))
    first = save(_rooted(rows, max_bits).groupBy("root").agg(F.min("least").alias("x")).select("x.h1", "x.h2"), "first")
    # Equal rows are cut to one before the shuffle, by the limit that Spark puts below a window's rank.
    one = whole.withColumn("k", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("h1"))).where("k = 1")
    return one.join(first, ["h1", "h2"], "left_semi").select("row.*")
