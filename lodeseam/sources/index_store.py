"""A stored index of chunks that grows: segments, deletions and counts, merged when they are read.

An appended table of chunks becomes a segment: its chunks, its key postings (numbers, phrases, entities), its term counts, and the
term postings in blocks of chunks of like length, a row each, with what bounds the scores there (operators/blocks.py). A ranked search
sums the bounds of each block first, scores the most promising blocks, and then only those whose bound reaches the k-th score found.

Deleted documents are named with the segments they are deleted from, and their terms are counted off in a table of their own.
Corpus statistics are sums over segments and deletions, so they are those of an index built anew from what is left. A version of
the index is one small file; readers see the newest complete one. Of two writers of one version the second fails (a writer that
dies between its lock and its file leaves the lock, which must be removed by hand).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.vocab import BASE_B, BASE_K1, STOPWORDS
from ..operators import blocks, postings, search
from ..operators.postings import KEYED
from ..operators.sizes import small
from ..operators.steps import cut, spread


class IndexStore:
    """An index at a path that the driver and all tasks see. `chunks` tables have domain, doc_id, chunk_id, text and has_table."""

    def __init__(self, spark: SparkSession, path: str, stopwords=STOPWORDS, segment=extract.pairs_of):
        self.spark, self.path, self.stopwords, self.segment = spark, path.rstrip("/"), stopwords, segment

    # versions

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> dict:
        """The newest version: its number, segments, deletions and, by domain, chunks, terms and the mean of the terms' raw idf."""
        fs, where = self._files()
        names = sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"number": 0, "segments": [], "deletions": [], "domains": {}}
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(where, names[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, segments: list[str], deletions: list[list]) -> dict:
        after = {"number": before["number"] + 1, "segments": segments, "deletions": deletions}
        merged = self._counts(after)
        n = self._totals(after)
        raw = merged.join(F.broadcast(n), "domain").groupBy("domain").agg(F.avg(F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean"), F.max("n_chunks").alias("n_chunks"), F.max("n_terms").alias("n_terms"))
        after["domains"] = {r.domain: [r.n_chunks, r.n_terms, r["mean"]] for r in raw.collect()}  # a row a domain
        fs, where = self._files()
        fs.mkdirs(where)
        path, name = self.spark._jvm.org.apache.hadoop.fs.Path, f"{after['number']:09d}"
        if not fs.createNewFile(path(where, f"{name}.lock")):
            raise RuntimeError(f"version {after['number']} of the index is being written, or has been, by someone else")
        stream = fs.create(path(where, f"{name}.new"), True)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        fs.rename(path(where, f"{name}.new"), path(where, f"{name}.json"))
        return after

    # tables of a version

    def _union(self, kind: str, ids: list[str], empty: str) -> DataFrame:
        out = self.spark.createDataFrame([], empty) if not ids else None
        for s in ids:
            part = self.spark.read.parquet(f"{self.path}/{kind}/{s}").withColumn("segment", F.lit(s))
            out = part if out is None else out.unionByName(part)
        return out

    def _counts(self, v: dict) -> DataFrame:
        """(domain, term, df) of what is left."""
        rows = self._union("terms", [*v["segments"], *[d for d, _ in v["deletions"]]], "domain string, term string, df long, segment string")
        return rows.groupBy("domain", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def _totals(self, v: dict) -> DataFrame:
        rows = self._union("totals", [*v["segments"], *[d for d, _ in v["deletions"]]], "domain string, n_chunks long, n_terms long, segment string")
        return rows.groupBy("domain").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_terms").alias("n_terms"))

    def _live(self, rows: DataFrame, v: dict) -> DataFrame:
        """Rows of segments without those of documents that were deleted from them."""
        for name, of in v["deletions"]:
            gone = self.spark.read.parquet(f"{self.path}/deleted/{name}").select("domain", "doc_id", F.explode(F.array(*map(F.lit, of))).alias("segment"))
            rows = rows.join(small(gone), ["domain", "doc_id", "segment"], "left_anti")
        return rows

    def chunks(self, v: dict | None = None) -> DataFrame:
        """The chunks that are left."""
        v = v or self.version()
        shape = "domain string, doc_id string, chunk_id string, text string, has_table boolean, segment string"
        return self._live(self._union("chunks", v["segments"], shape), v).select(*KEYED, "text", "has_table")

    def keys(self, family: str, v: dict | None = None) -> DataFrame:
        """(domain, doc_id, chunk_id, key) postings of the numbers, phrases or entities of chunks that are left."""
        v = v or self.version()
        rows = self._union("keys", v["segments"], "domain string, doc_id string, chunk_id string, key string, family string, segment string")
        return self._live(rows.where(F.col("family") == family), v).select(*KEYED, "key")

    # changes

    def append(self, chunks: DataFrame) -> str:
        """Adds a segment of all rows; returns its name. Chunks without a term are kept and found by their keys only."""
        before, name = self.version(), uuid.uuid4().hex
        spread(chunks.select(*KEYED, "text", "has_table"), "doc_id", "chunk_id").write.parquet(f"{self.path}/chunks/{name}")
        kept = self.spark.read.parquet(f"{self.path}/chunks/{name}")
        blocks.made(kept, self.stopwords, self.segment).write.parquet(f"{self.path}/blocks/{name}")
        held = self.spark.read.parquet(f"{self.path}/blocks/{name}")
        held.select("domain", F.explode("terms").alias("t")).groupBy("domain", "t.term").agg(F.sum("t.df").alias("df")).write.parquet(f"{self.path}/terms/{name}")
        each = held.select("domain", F.explode("chunks").alias("c")).groupBy("domain")
        each.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("c.n_terms").alias("n_terms")).write.parquet(f"{self.path}/totals/{name}")
        families = {"numbers": extract.number_keys(F.col("text")), "phrases": extract.phrase_keys(F.col("text")), "entities": extract.entities(F.col("text"), F.col("domain"))}
        named = lambda keys, family: F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.lit(family).alias("family")))
        told = [named(keys, family) for family, keys in families.items()]
        # one pass over the texts; as in postings.postings(), explode_outer works out the keys once
        found = kept.select(*KEYED, F.explode_outer(F.flatten(F.array(*[F.coalesce(t, F.array().cast("array<struct<key: string, family: string>>")) for t in told]))).alias("x"))
        found.select(*KEYED, "x.key", "x.family").where("key != ''").write.partitionBy("family").parquet(f"{self.path}/keys/{name}")
        self._commit(before, [*before["segments"], name], before["deletions"])
        return name

    def delete(self, documents: DataFrame) -> str:
        """Deletes the documents (domain, doc_id), a stated set, from all segments there are; returns the deletion's name."""
        before, name = self.version(), uuid.uuid4().hex
        documents.select("domain", "doc_id").distinct().write.parquet(f"{self.path}/deleted/{name}")
        gone = self.chunks(before).join(small(self.spark.read.parquet(f"{self.path}/deleted/{name}")), ["domain", "doc_id"], "left_semi")
        tf = postings.term_frequency(gone, self.stopwords, self.segment)
        by_term = cut(tf.groupBy("domain", "term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum((F.col("nth") == 0).cast("long"))).alias("_heads"), (-F.sum("tf")).alias("_words")))
        by_term.select("domain", "term", "df").write.parquet(f"{self.path}/terms/{name}")
        by_term.groupBy("domain").agg(F.sum("_heads").alias("n_chunks"), F.sum("_words").alias("n_terms")).write.parquet(f"{self.path}/totals/{name}")
        self._commit(before, before["segments"], [*before["deletions"], [name, before["segments"]]])
        return name

    def compact(self) -> str:
        """One segment of all that is left instead of all segments and deletions. Files of older versions stay for their readers."""
        before = self.version()
        name = self.append(cut(self.chunks(before)))
        now = self.version()
        if now["segments"] != [*before["segments"], name] or now["deletions"] != before["deletions"]:
            raise RuntimeError("the index was changed meanwhile; the new segment must be deleted")
        self._commit(now, [name], [])
        return name

    # reading

    def weights(self, questions: DataFrame, v: dict, synonyms: dict | None = None, by_domain: bool = False) -> DataFrame:
        """(qid, domain, term, mean_terms, weight): terms of the questions with their times, times idf as search.idf() has it."""
        asked = search.query_terms(questions, synonyms, self.stopwords, by_domain, self.segment)
        known = self._counts_of(asked, v)
        told = self.spark.createDataFrame([(d, *x) for d, x in v["domains"].items()], "domain string, n_chunks long, n_terms long, mean double")
        raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, search.IDF_FLOOR * F.col("mean")).otherwise(raw)
        met = asked.join(known, ["domain", "term"]).join(F.broadcast(told), "domain")
        return met.select("qid", "domain", "term", (F.col("n_terms") / F.col("n_chunks")).alias("mean_terms"), (F.col("times") * idf).alias("weight"))

    def _counts_of(self, asked: DataFrame, v: dict) -> DataFrame:
        """(domain, term, df) of the questions' terms alone."""
        rows = self._union("terms", [*v["segments"], *[d for d, _ in v["deletions"]]], "domain string, term string, df long, segment string")
        met = rows.join(small(asked.select("domain", "term").distinct()), ["domain", "term"], "left_semi")
        return met.groupBy("domain", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def top_k(self, questions: DataFrame, k: int = 10, k1: float | Column = BASE_K1, b: float | Column = BASE_B, synonyms: dict | None = None, by_domain: bool = False, digits: int | None = None, read: list | None = None) -> DataFrame:
        """(qid, domain, doc_id, chunk_id, bm25, rank): the first k chunks of each question as search.bm25() and search.top_k() have them,
        scores rounded to `digits` before they are ranked. `read`, a list, is given a table (qid, blocks, blocks_read)."""
        v = self.version()
        table = self._union("blocks", v["segments"], f"{blocks.SHAPE}, segment string")
        if v["deletions"]:
            dead = self._dead(table, v)
            table = table.join(small(dead), ["segment", "block"], "left")
        else:
            table = table.withColumn("dead", F.lit(None).cast("array<int>"))
        k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
        weights = self.weights(questions, v, synonyms, by_domain).join(questions.select("qid", search._documents(questions).alias("docs")), "qid")
        return blocks.top_k(table, weights.withColumns({"k1": k1.cast("double"), "b": b.cast("double")}), questions, k, digits, read)

    def _dead(self, table: DataFrame, v: dict) -> DataFrame:
        """(segment, block, dead): places in their blocks of chunks of documents that were deleted."""
        rows, out = table.select("domain", "segment", "block", F.posexplode("chunks").alias("place", "c")).select("domain", "segment", "block", "place", "c.doc_id"), None
        for name, of in v["deletions"]:
            gone = small(self.spark.read.parquet(f"{self.path}/deleted/{name}").select("domain", "doc_id"))
            part = rows.where(F.col("segment").isin(of)).join(gone, ["domain", "doc_id"], "left_semi")
            out = part if out is None else out.unionByName(part)
        return cut(out.groupBy("segment", "block").agg(F.collect_set("place").alias("dead")))

    def tables(self) -> dict[str, DataFrame]:
        """What search.score() takes instead of texts: term frequencies and their idf, numbers, phrases and entities."""
        v = self.version()
        rows = self._union("blocks", v["segments"], f"{blocks.SHAPE}, segment string").select("domain", "segment", "chunks", F.explode("terms").alias("t"))
        rows = rows.select("domain", "segment", "t.term", F.explode(F.transform("t.items", lambda x: F.struct(F.get("chunks", x["place"]).alias("c"), x["tf"].cast("long").alias("tf")))).alias("x"))
        rows = rows.select("domain", "segment", "term", "x.c.*", "x.tf")
        tf = self._live(rows, v).select(*KEYED, "n_terms", "term", "tf")
        told = self.spark.createDataFrame([(d, *x) for d, x in v["domains"].items()], "domain string, n_chunks long, n_terms long, mean double")
        raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        terms = self._counts(v).join(F.broadcast(told), "domain").select("domain", "term", "df", F.when(raw < 0, search.IDF_FLOOR * F.col("mean")).otherwise(raw).alias("idf"), (F.col("n_terms") / F.col("n_chunks")).alias("mean_terms"))
        return {"tf": tf, "terms": terms, "numbers": self.keys("numbers", v), "phrases": self.keys("phrases", v), "entities": self.keys("entities", v)}
