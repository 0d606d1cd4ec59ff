"""Inverted indexes as long tables, one row a (domain, key, chunk)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import let
from ..functions.vocab import STOPWORDS, SYMBOL_METRICS

KEYED = ("domain", "doc_id", "chunk_id")


def postings(chunks: DataFrame, keys: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """(domain, doc_id, chunk_id, key[, columns of the chunk]), one row each."""
    # explode_outer: for explode the optimiser would work out the keys once more in a filter on their number
    return chunks.select(*KEYED, *also, F.explode_outer(F.array_distinct(keys)).alias("key")).where("key != ''")


def numeric(chunks: DataFrame) -> DataFrame:
    return postings(chunks, extract.number_keys(F.col("text")))


def phrase(chunks: DataFrame) -> DataFrame:
    return postings(chunks, extract.phrase_keys(F.col("text")))


def entity(chunks: DataFrame) -> DataFrame:
    return postings(chunks, extract.entities(F.col("text"), F.col("domain")))


def counted(words: Column) -> Column:
    """(term, tf) of an array of words, sorted by term; worked out within the row."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("long").alias("tf"))))

    return let(F.sort_array(words), runs)


def counted_terms(chunks: DataFrame, stopwords=STOPWORDS, segment=extract.pairs_of, also: tuple[str, ...] = ()) -> DataFrame:
    """(domain, doc_id, chunk_id[, columns of the chunk], n_terms, terms array of (term, tf)), a row a chunk."""
    words = let(extract.tokens(F.col("text"), stopwords, segment), lambda w: F.struct(F.size(w).cast("long").alias("n_terms"), counted(w).alias("terms")))
    return chunks.select(*KEYED, *also, words.alias("_w")).select(*KEYED, *also, F.col("_w.n_terms").alias("n_terms"), F.col("_w.terms").alias("terms"))


def term_frequency(chunks: DataFrame, stopwords=STOPWORDS, segment=extract.pairs_of) -> DataFrame:
    """(domain, doc_id, chunk_id, n_terms, nth, term, tf): one row for each term of a chunk, numbered from 0, with the number of
    all its words. Nothing is shuffled: a chunk's words are counted in its row."""
    rows = counted_terms(chunks, stopwords, segment).select(*KEYED, "n_terms", F.posexplode_outer("terms").alias("nth", "_t")).where("nth is not null")
    return rows.select(*KEYED, "n_terms", "nth", F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf"))


def lengths(chunks: DataFrame, stopwords=STOPWORDS) -> DataFrame:
    """(domain, doc_id, chunk_id, n_terms) of chunks with a term."""
    return chunks.select(*KEYED, F.size(extract.tokens(F.col("text"), stopwords)).cast("long").alias("n_terms")).where("n_terms > 0")


def inverted(chunks: DataFrame) -> DataFrame:
    """Keys between punctuation, of 2 to 20 characters."""
    return postings(chunks, F.filter(F.split("text", r"[，。、\s|\n]+"), lambda w: F.char_length(w).between(2, 20)))


def headings(chunks: DataFrame) -> DataFrame:
    """Words of two or more characters of lines behind a [标题] mark."""
    lines = F.transform(extract.found(F.col("text"), r"\[标题\]([^\n]*)", 1), lambda x: F.split(F.trim(x), r"[\s，。、|]+"))
    return postings(chunks, F.filter(F.flatten(lines), lambda w: F.char_length(w) >= 2))


def graph_numeric(chunks: DataFrame) -> DataFrame:
    return postings(chunks, extract.graph_numbers(F.col("text")))


def graph_phrases(chunks: DataFrame, entity_rows: DataFrame | None = None) -> DataFrame:
    """CJK runs cut at 10 and, of (chunk_id, name) rows, every entity name of two or more characters."""
    out = postings(chunks, extract.phrases(F.col("text"), 2, 10))
    if entity_rows is None:
        return out
    names = chunks.select(*KEYED).join(entity_rows.where(F.char_length("name") >= 2).select("chunk_id", F.col("name").alias("key")), "chunk_id").select(*KEYED, "key")
    return out.unionByName(names).distinct()


def symbols(chunks: DataFrame, metrics=SYMBOL_METRICS, keyword_cap: int = 20, number_cap: int = 10) -> DataFrame:
    """(domain, doc_id, chunk_id, page, family, symbol, weight): six families; 1.3 for chunks with a table and 1.0 for
    others, times 1.5 for metrics and 1.2 for clauses, and 1.5 for a document's tables. Keywords are capped in sorted order."""
    text = F.col("text")
    base = F.when(F.col("has_table"), 1.3).otherwise(1.0)
    families = (
        ("keyword", F.slice(extract.symbol_keywords(text), 1, keyword_cap), base),
        ("metric", extract.symbol_metrics(text, metrics), base * 1.5),
        ("period", F.array_distinct(extract.symbol_periods(text)), base),
        ("number", F.slice(extract.symbol_numbers(text), 1, number_cap), base),
        ("table", F.when(F.col("has_table"), F.array("doc_id")).otherwise(F.array().cast("array<string>")), F.lit(1.5)),
        ("clause", extract.symbol_clauses(text), base * 1.2),
    )

    def entries(family: str, keys: Column, weight: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(family).alias("family"), k.alias("symbol"), weight.cast("double").alias("weight")))

    rows = F.flatten(F.array(*(entries(*f) for f in families)))
    return chunks.where("text != ''").select(*KEYED, "page", F.explode(rows).alias("s")).select(*KEYED, "page", "s.family", "s.symbol", "s.weight")


def stats(symbol_rows: DataFrame) -> DataFrame:
    """Distinct symbols and entries of each family."""
    return symbol_rows.groupBy("family").agg(F.count_distinct("symbol").alias("unique_symbols"), F.count(F.lit(1)).alias("total_entries"))


def profiles(symbol_rows: DataFrame, entity_postings: DataFrame) -> DataFrame:
    """Metrics, periods and entities of each document."""
    of = lambda f: F.array_sort(F.collect_set(F.when(F.col("family") == f, F.col("symbol"))))
    base = symbol_rows.where(F.col("family").isin("metric", "period")).groupBy("domain", "doc_id").agg(of("metric").alias("metrics"), of("period").alias("periods"))
    names = entity_postings.groupBy("domain", "doc_id").agg(F.array_sort(F.collect_set("key")).alias("entities"))
    return base.join(names, ["domain", "doc_id"], "full")
