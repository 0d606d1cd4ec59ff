"""Substring search by 3-grams of characters: where a set of phrases stands in all texts.

Every place of a text has one gram, the three characters from there on (behind the end come two that no text has), as one whole number.
A phrase is looked for by its rarest grams, and what stands there is then compared character by character. within() reads the texts
and needs no index: grams are counted in one pass, and in a second one each batch of texts is held against the rarest gram of each
phrase. build() makes positional postings and find() reads them: the places of a phrase's RAREST grams, moved to the phrase's start, are
intersected. Phrases of one or two characters are the grams that begin with them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .sizes import MOST, size_of, small
from .steps import cut, spread

#: Grams that a phrase is looked for by; parts of the postings by gram, and of a part by chunk.
RAREST, BUCKETS, SPREAD = 3, 64, 8
#: Bits of a character in a gram, and characters that a task works on at a time.
BITS, STEP = 21, 1 << 20


def characters(text: str) -> np.ndarray:
    """Code points plus one, as 64-bit numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


def grams(letters: np.ndarray) -> np.ndarray:
    """The gram at each place."""
    if not len(letters):
        return letters
    wide = np.r_[letters, 0, 0]
    return (wide[:-2] << 2 * BITS) | (wide[1:-1] << BITS) | wide[2:]


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about STEP characters of its column `at`: a batch has as many rows whatever their length."""
    part = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy()) // STEP
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    for first, end in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=False):
        yield batch.slice(first, end - first)


class Index(NamedTuple):
    postings: DataFrame  # gram, bucket (if stored), domain, doc_id, chunk_id, at array<int>
    grams: DataFrame | None  # gram, chunks; counted for what is asked where the index isn't stored


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values, kind))


def build(chunks: DataFrame, path: str | None = None) -> Index:
    """Postings of all grams of `chunks` (domain, doc_id, chunk_id, text). Null and empty texts have none; chunks with a null in their key are
    left out.

    Written to `path`, they are dealt by gram and, as one gram may be in all chunks, by chunk; a file holds grams in order. Without a path the
    index is for one call: the tasks that read the texts write their postings to the shared folder, in order of grams for about STEP
    characters at a time, and nothing is shuffled, as postings are many times the texts.
    """
    names = ["domain", "doc_id", "chunk_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, 3)):
            each = [grams(characters(text or "")) for text in batch.column(3).to_pylist()]
            size = [len(g) for g in each]
            if sum(size):
                gram, row = np.concatenate(each), np.repeat(np.arange(len(each)), size)
                place = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
                order = np.argsort(gram, kind="stable")
                gram, row = gram[order], row[order]
                heads = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                at = pa.array(row[heads])
                yield pa.RecordBatch.from_arrays([pa.array(gram[heads]), *(batch.column(k).take(at) for k in range(3)), _lists(place[order].astype(np.int32), heads, pa.int32())], names=["gram", *names, "at"])

    told = chunks.select(*[F.col(c).cast("string") for c in names], "text").dropna(subset=names)
    if path is None:
        # a small file may be a task's; texts are only dealt where they are few
        few = told.rdd.getNumPartitions() < told.sparkSession.sparkContext.defaultParallelism
        told = spread(told, "doc_id", "chunk_id") if few else told
    rows = told.mapInArrow(run, "gram long, domain string, doc_id string, chunk_id string, at array<int>")
    if path is None:
        return Index(cut(rows, compression="zstd"), None)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("doc_id", "chunk_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram", "doc_id", "chunk_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    held = chunks.sparkSession.read.parquet(f"{path}/postings")
    held.groupBy("gram").agg(F.count(F.lit(1)).alias("chunks")).write.mode("overwrite").parquet(f"{path}/grams")
    return load(chunks.sparkSession, path)


def load(spark, path: str) -> Index:
    """The index that build() wrote to a path."""
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/grams"))


def _cut_up(queries: DataFrame) -> DataFrame:
    """(qid, phrase, n, gram, offset): the grams of each phrase with their places in it; shorter ones one gram with less in it."""
    kind = queries.schema["qid"]

    def run(batches):
        for batch in batches:
            rows, size, found, places = [], [], [], []
            for i, phrase in enumerate(batch.column(1).to_pylist()):
                letters = characters(phrase)
                g = grams(letters)[: max(1, len(letters) - 2)]
                rows.append(np.full(len(g), i))
                size.append(np.full(len(g), len(letters)))
                found.append(g)
                places.append(np.arange(len(g)))
            if rows:
                at = pa.array(np.concatenate(rows))
                cells = [pa.array(np.concatenate(x).astype(t)) for x, t in ((size, np.int32), (found, np.int64), (places, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *cells], names=["qid", "phrase", "n", "gram", "offset"])

    shape = StructType([StructField("qid", kind.dataType), *StructType.fromDDL("phrase string, n int, gram long, offset int").fields])
    return queries.where("phrase != ''").select("qid", "phrase").distinct().mapInArrow(run, shape)


def find(index: Index, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, phrase, domain, doc_id, chunk_id, at) for `queries` (qid, phrase): all places, from 0, of each phrase in the indexed chunks.
    Only the postings of chosen grams are read, and texts only of chunks where all of those stand in the right places. Null and empty
    phrases have no rows; a phrase may overlap itself."""
    asked = cut(_cut_up(queries))
    key = ["domain", "doc_id", "chunk_id"]
    stored = index.grams is not None
    whole = asked.where("n >= 3")
    # of an index that isn't stored only the grams that are asked for are counted
    counted = index.grams if stored else index.postings.join(small(cut(whole.select("gram").distinct())), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("chunks"))
    long = whole.join(counted, "gram", "left")
    of = Window.partitionBy("qid", "phrase")
    ranked = long.withColumn("_k", F.row_number().over(of.orderBy(F.asc_nulls_first("chunks"), "offset"))).where(F.col("_k") <= RAREST)
    # a gram that no chunk has comes first
    chosen = ranked.withColumn("_lost", F.max(F.col("chunks").isNull()).over(of)).withColumn("_m", F.count(F.lit(1)).over(of)).where("NOT _lost")
    sent = small(cut(chosen.select("qid", "phrase", "n", "gram", "offset", "_m", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int").alias("bucket"))))
    met = index.postings.join(*((sent, ["gram", "bucket"]) if stored else (sent.drop("bucket"), "gram"))).select("qid", "phrase", *key, "_m", F.transform("at", lambda p: p - F.col("offset")).alias("starts"))
    all_ = met.groupBy("qid", "phrase", *key).agg(F.collect_list("starts").alias("s"), F.max("_m").alias("_m")).where(F.size("s") == F.col("_m"))
    common = all_.select("qid", "phrase", *key, F.aggregate(F.slice("s", 2, RAREST), F.get("s", F.lit(0)), F.array_intersect).alias("at")).where(F.size("at") > 0)
    texts = chunks.select(*[F.col(c).cast("string") for c in key], "text")
    starts = small(cut(common.select("qid", "phrase", *key, F.explode_outer("at").alias("start"))))
    same = F.substring("text", F.col("start") + 1, F.char_length("phrase")) == F.col("phrase")
    checked = texts.join(starts, key).where(same).groupBy("qid", "phrase", *key).agg(F.collect_list("start").alias("at"))
    short = asked.where("n < 3").select("qid", "phrase", "n", (F.col("gram")).alias("head"))
    begun = lambda rows, n, bits: rows.withColumn("head", F.shiftleft(F.shiftright("gram", bits), bits)).join(small(short.where(F.col("n") == n)), "head")
    begins = ((1, 2 * BITS), (2, BITS))
    if stored:
        one, two = (begun(index.grams, *of_).select("qid", "phrase", "gram") for of_ in begins)
        few = index.postings.join(small(cut(one.unionByName(two))), "gram")
    else:
        one, two = (begun(index.postings, *of_).select("qid", "phrase", *key, "at") for of_ in begins)
        few = one.unionByName(two)
    few = few.groupBy("qid", "phrase", *key).agg(F.flatten(F.collect_list("at")).alias("at"))
    return checked.unionByName(few).select("qid", "phrase", *key, F.array_sort("at").alias("at"))


def _counted(chunks: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(gram, chunks) of some grams: in how many texts each is."""

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                g = np.unique(grams(characters(text or "")))
                if len(g):
                    at = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                    total[at[wanted[at] == g]] += 1
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[full]), pa.array(total[full])], names=["gram", "chunks"])

    return chunks.select("text").mapInArrow(run, "gram long, chunks long").groupBy("gram").agg(F.sum("chunks").alias("chunks"))


def within(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """All columns of `chunks` with qid, phrase and at, the places from 0 of each phrase of `queries` (qid, phrase), a stated set, in the
    column `text`. The set goes to all tasks in blocks of a checked size. Null and empty phrases have no rows."""
    spark = chunks.sparkSession
    asked = cut(queries.where("phrase != ''").select("qid", "phrase").distinct())
    blocks, out = max(1, -(-size_of(asked) // (MOST // 8))), None  # a phrase has as many grams of eight bytes as characters
    shape = StructType([*chunks.schema.fields, asked.schema["qid"], asked.schema["phrase"], StructField("at", ArrayType(IntegerType()))])
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("qid", "phrase"), F.lit(blocks)) == b)
        held = block.toArrow().combine_chunks()
        if not held.num_rows:
            continue
        phrases = [characters(p) for p in held.column("phrase").to_pylist()]
        cut_up = [grams(p)[: max(1, len(p) - 2)] for p in phrases]
        counts = dict(map(tuple, _counted(chunks, np.unique(np.concatenate(cut_up))).collect()))  # grams of the block
        short = [k for k, p in enumerate(phrases) if len(p) < 3]
        rarest = {k: min((counts.get(x, 0), i) for i, x in enumerate(g.tolist())) for k, g in enumerate(cut_up) if len(phrases[k]) >= 3}
        live = sorted((int(cut_up[k][i]), i, k) for k, (n, i) in rarest.items() if n)
        part = chunks.mapInArrow(_matcher(chunks.schema.names, held, phrases, live, short), shape)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], shape) if out is None else out


def _matcher(names: list[str], held: pa.Table, phrases: list[np.ndarray], live: list[tuple[int, int, int]], short: list[int]):
    text_at = names.index("text")
    keys = np.array([g for g, _, _ in live], np.int64)
    offset, phrase = np.array([o for _, o, _ in live], np.int64), np.array([k for _, _, k in live], np.int64)
    first, last = np.searchsorted(keys, keys, "left"), np.searchsorted(keys, keys, "right")
    ids, texts = held.column("qid").combine_chunks(), held.column("phrase").combine_chunks()

    def places(letters: np.ndarray) -> dict[int, list[int]]:
        g, found = grams(letters), {}
        if len(keys):
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for p in np.flatnonzero(keys[at] == g).tolist():
                for k in range(first[at[p]], last[at[p]]):
                    want, begin = phrases[phrase[k]], p - offset[k]
                    if begin >= 0 and np.array_equal(letters[begin : begin + len(want)], want):
                        found.setdefault(int(phrase[k]), []).append(int(begin))
        for k in short:
            shift = BITS * (3 - len(phrases[k]))
            same = np.flatnonzero((g >> shift) == (grams(phrases[k])[0] >> shift))
            if len(same):
                found[k] = same.tolist()
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, text_at)):
            rows, which, at = [], [], []
            for i, text in enumerate(batch.column(text_at).to_pylist()):
                for k, where in places(characters(text)).items() if text else ():
                    rows.append(i)
                    which.append(k)
                    at.append(where)
            take, asked = pa.array(rows, pa.int64()), pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), ids.take(asked), texts.take(asked), pa.array(at, pa.list_(pa.int32()))], names=[*names, "qid", "phrase", "at"])

    return run
