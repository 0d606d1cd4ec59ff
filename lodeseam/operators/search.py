"""Ranking: BM25 over a domain, additive boosts, and the choice of the first k for all questions at once.

Corpus statistics are those of the whole domain; the documents a question is about only restrict what is scored. Where
scores tie, chunks come in order of document and chunk number.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import CJK, let
from ..functions.vocab import ALIASES, BASE_B, BASE_K1, DOMAIN_SYNONYMS, DOMAINS, METRIC_SYNONYMS, STOPWORDS, STRONG_PHRASES, TABLE_BONUS
from . import postings
from .sizes import MOST, size_of
from .steps import cut

#: Share of the mean idf that a term in over half of the chunks gets.
IDF_FLOOR = 0.25


def expand(text: Column, words: Column, synonyms: dict[str, tuple[str, ...]] | None = None, most: int = 12, stopwords=STOPWORDS) -> Column:
    """Query words with those of triggers that the text contains: at most `most` extras, each also cut into words, none twice."""
    table = synonyms if synonyms is not None else {a: (n,) for a, n in ALIASES.items()} | METRIC_SYNONYMS
    return _with_extras(text, words, _entries([("", t, s) for t, s in table.items()]), most, stopwords) if table else words


def _entries(rows: list[tuple[str, str, tuple[str, ...]]]) -> Column:
    """(domain, trigger, words) rows as one literal."""
    told = json.dumps([{"d": d, "t": t, "s": list(s)} for d, t, s in rows], ensure_ascii=False)
    return F.from_json(F.lit(told), "array<struct<d: string, t: string, s: array<string>>>")


def _with_extras(text: Column, words: Column, entries: Column, most: int, stopwords) -> Column:
    def extended(t: Column, w: Column) -> Column:
        extras = F.flatten(F.transform(F.filter(entries, lambda e: F.contains(t, e["t"])), lambda e: e["s"]))
        extras = F.slice(F.array_distinct(extras), 1, most)
        more = F.flatten(F.transform(extras, lambda e: F.concat(F.array(F.lower(e)), extract.tokens(e, stopwords))))
        return F.concat(w, F.array_except(more, w))

    # text and words once for a question, not for each trigger
    return let(text, lambda t: let(words, lambda w: extended(t, w)))


def expand_by_domain(text: Column, words: Column, domain: Column, tables: dict | None = None, most: int = 15, stopwords=STOPWORDS) -> Column:
    """expand() with the synonyms of the question's own domain, at most `most` extras."""
    rows = [(d, t, s) for d, table in (DOMAIN_SYNONYMS if tables is None else tables).items() for t, s in table.items()]
    return _with_extras(text, words, F.filter(_entries(rows), lambda e: e["d"] == domain), most, stopwords) if rows else words


def _documents(questions: DataFrame) -> Column:
    """The documents a question is about, null if it is about all of its domain."""
    if "doc_ids" not in questions.columns:
        return F.lit(None).cast("array<string>")
    return F.when((F.size("doc_ids") > 0) & ~F.exists("doc_ids", lambda d: d.isNull()), F.array_distinct("doc_ids"))


def meet(found: DataFrame, asked: DataFrame, on: tuple[str, ...], scoped: bool, send=lambda rows: rows) -> DataFrame:
    """Rows of chunks (doc_id, ...) joined to rows of questions (_docs, ...) within the documents of each question. Where questions
    are about documents these are part of the key, so what lies outside is not even met. send: how the questions' rows go."""
    free = asked if not scoped else asked.where("_docs is null")
    out = found.join(send(free.drop("_docs")), list(on))
    if not scoped:
        return out
    bound = asked.where("_docs is not null").withColumn("doc_id", F.explode("_docs")).drop("_docs")
    return out.unionByName(found.join(send(bound), [*on, "doc_id"]))


def keyed(chunks: DataFrame) -> DataFrame:
    """Chunks dealt by their key: what is found for a question and a chunk is then summed where the chunk is, without a shuffle
    of hits, which are as many as chunks times questions."""
    return chunks.repartition("doc_id", "chunk_id")


def query_terms(questions: DataFrame, synonyms: dict | None = None, stopwords=STOPWORDS, by_domain: bool = False, segment=extract.pairs_of) -> DataFrame:
    """(qid, domain, term, times) of questions with `options` joined to the question text, expanded by general and, if asked for, domain
    synonyms. Words are counted within the question's row."""
    whole = F.concat_ws(" ", F.col("question"), F.array_join(F.map_values("options"), " ")) if "options" in questions.columns else F.col("question")

    def worded(t: Column) -> Column:
        words = expand(t, extract.tokens(t, stopwords, segment), synonyms, stopwords=stopwords)
        return expand_by_domain(t, words, F.col("domain"), stopwords=stopwords) if by_domain else words

    # explode_outer: for explode the optimiser would work out the words once more in a filter on their number
    asked = questions.select("qid", "domain", F.explode_outer(postings.counted(let(whole, worded))).alias("_t")).where("_t is not null")
    return asked.select("qid", "domain", F.col("_t.term").alias("term"), F.col("_t.tf").alias("times"))


def idf(tf: DataFrame) -> DataFrame:
    """(domain, term, df, idf, mean_terms): ln(N - df + 0.5) - ln(df + 0.5), or IDF_FLOOR of the domain's mean where that is negative, and
    the mean length of the domain's chunks. Terms are counted in one pass and written; the rest is made from the counts."""
    by_term = cut(tf.groupBy("domain", "term").agg(F.count(F.lit(1)).alias("df"), F.sum((F.col("nth") == 0).cast("long")).alias("_heads"), F.sum("tf").alias("_words")))
    n = by_term.groupBy("domain").agg(F.sum("_heads").alias("n_chunks"), F.sum("_words").alias("n_terms"))
    raw = by_term.join(F.broadcast(n), "domain")  # a row a domain
    raw = raw.withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("domain").agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), "domain").select("domain", "term", "df", F.when(F.col("raw") < 0, IDF_FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"), (F.col("n_terms") / F.col("n_chunks")).alias("mean_terms"))


def bm25(chunks: DataFrame, questions: DataFrame, k1: float | Column = BASE_K1, b: float | Column = BASE_B, synonyms: dict | None = None, stopwords=STOPWORDS, tf: DataFrame | None = None, by_domain: bool = False, segment=extract.pairs_of, known: DataFrame | None = None) -> DataFrame:
    """(qid, domain, doc_id, chunk_id, bm25) of every chunk in scope that shares a term with the question.

    `segment` cuts CJK runs, of chunks and questions alike (`tf` must be made with the same one); `known` is idf() of them, if it is at hand. The weights of the questions' terms, a stated set, go to the chunks if they fit a broadcast; otherwise they meet by term.
    """
    tf = postings.term_frequency(keyed(chunks), stopwords, segment) if tf is None else tf
    terms = query_terms(questions, synonyms, stopwords, by_domain, segment)
    scoped = "doc_ids" in questions.columns
    terms = terms.join(questions.select("qid", _documents(questions).alias("_docs")), "qid") if scoped else terms.withColumn("_docs", _documents(questions))
    terms = cut(terms)  # they are measured, and then joined
    fits = size_of(terms) <= MOST
    weights = terms.join(idf(tf) if known is None else known, ["domain", "term"]).select("domain", "term", "qid", "_docs", "mean_terms", (F.col("times") * F.col("idf")).alias("weight"))
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("mean_terms")))
    hits = meet(tf, weights, ("domain", "term"), scoped, F.broadcast if fits else lambda rows: rows)
    return hits.groupBy("qid", *postings.KEYED).agg(F.sum(F.col("weight") * share).alias("bm25"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The first k chunks of each question, with their rank."""
    w = Window.partitionBy("qid").orderBy(F.desc(score), "doc_id", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _context(question: Column, stopwords=STOPWORDS) -> Column:
    """Words of two or more characters that a chunk must contain for a number to count."""
    return F.array_distinct(F.filter(extract.tokens(question, stopwords), lambda w: F.char_length(w) >= 2))


def _options(questions: DataFrame) -> Column:
    return F.map_values("options") if "options" in questions.columns else F.array().cast("array<string>")


def _of_domain(name: str) -> Column:
    first = next(iter(DOMAINS.values()))[name]
    return F.coalesce(F.element_at(F.create_map(*[x for d, p in DOMAINS.items() for x in (F.lit(d), F.lit(float(p[name])))]), F.col("domain")), F.lit(float(first)))


def numbers_asked(questions: DataFrame, by_domain: bool) -> DataFrame:
    """(qid, domain, _docs, words, clause, number, of_question, key): a row for each number of a question or its options and each key it has."""
    asked = questions.select("qid", "domain", _documents(questions).alias("_docs"), _context(F.col("question")).alias("words"), F.regexp_like("question", F.lit(extract.CLAUSE)).alias("clause"), extract.number_keys(F.col("question"), False).alias("q"), F.array_distinct(F.flatten(F.transform(_options(questions), lambda o: extract.number_keys(o, False)))).alias("o"))
    rows = asked.select("qid", "domain", "_docs", "words", "clause", F.explode(F.concat(F.transform("q", lambda x: F.struct(x.alias("number"), F.lit(True).alias("of_question"))), F.transform(F.array_except("o", "q"), lambda x: F.struct(x.alias("number"), F.lit(False).alias("of_question"))))).alias("x")).select("qid", "domain", "_docs", "words", "clause", "x.number", "x.of_question")
    return rows.withColumn("key", F.explode(extract.converted(F.col("number"))) if by_domain else F.col("number"))


def large_number() -> Column:
    return F.col("number").rlike("^[0-9]{4,}") | F.contains("number", F.lit("亿")) | F.contains("number", F.lit("万元")) | F.contains("number", F.lit("百万"))


def numeric_boost(chunks: DataFrame, questions: DataFrame, by_domain: bool = True, numbers: DataFrame | None = None) -> DataFrame:
    """(qid, domain, doc_id, chunk_id, numeric) from numbers that question or options share with a chunk.

    Plain: 2.5 for a number of the question if the chunk has one of its words, 1.0 for a number of the options only if it has
    two. By domain: the domain's weight for a number of the question (of a clause question whatever the chunk has), also in
    other units; for one of the options 0.4 of it with two words, 0.8 with one word if it is large, and 250 in a table.
    """
    rows = numbers_asked(questions, by_domain)
    if numbers is None:  # the text goes along with the few numbers of a chunk
        told = keyed(chunks).select(*postings.KEYED, F.lower("text").alias("_low"), "has_table", F.explode_outer(extract.number_keys(F.col("text"))).alias("key")).where("key is not null")
    else:
        told = numbers.join(chunks.select(*postings.KEYED, F.lower("text").alias("_low"), "has_table"), list(postings.KEYED))
    hits = meet(told, rows, ("domain", "key"), "doc_ids" in questions.columns)
    met = F.size(F.filter("words", lambda w: F.contains("_low", w)))
    if by_domain:
        weight = _of_domain("numeric")
        large = large_number()
        option = F.when(large & F.col("has_table"), 250.0).when(large & (met >= 1), weight * 0.8).when(~large & (met >= 2), weight * 0.4).otherwise(0.0)
        points = F.when(F.col("of_question"), F.when(F.col("clause") | (met >= 1), weight).otherwise(0.0)).otherwise(option)
    else:
        points = F.when(F.col("of_question") & (met >= 1), 2.5).when(~F.col("of_question") & (met >= 2), 1.0).otherwise(0.0)
    # a number counts once, however many of its forms the chunk has; its points are then at hand, and no text goes along
    once = hits.select("qid", *postings.KEYED, "number", "of_question", points.alias("_points")).groupBy("qid", *postings.KEYED, "number", "of_question").agg(F.max("_points").alias("_points"))
    return once.groupBy("qid", *postings.KEYED).agg(F.sum("_points").alias("numeric"))


def phrases_asked(questions: DataFrame, by_domain: bool, strong=STRONG_PHRASES) -> DataFrame:
    """(qid, domain, _docs, key, whole) of phrases of questions and, by domain, their options; not whole are strong phrases that stand anywhere."""
    scope = _documents(questions).alias("_docs")
    if not by_domain:
        return questions.select("qid", "domain", scope, F.explode(extract.phrases(F.col("question"), 3, 10)).alias("key"), F.lit(True).alias("whole"))
    each = F.array_distinct(F.concat(extract.phrases(F.col("question"), 3, 20), F.flatten(F.transform(_options(questions), lambda o: extract.phrases(o, 3, 20)))))
    query = F.concat_ws(" ", "question", F.array_join(_options(questions), " "))
    contained = F.filter(F.array(*map(F.lit, strong)), lambda p: F.contains(query, p))
    # one list instead of a union of questions, which the optimiser would join branch by branch and so lose where hits lie
    told = lambda keys, whole: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(whole).alias("whole")))
    rows = questions.select("qid", "domain", scope, F.explode(F.concat(told(F.coalesce(each, F.array().cast("array<string>")), True), told(contained, False))).alias("x"))
    return rows.select("qid", "domain", "_docs", "x.key", "x.whole")


def phrase_points(by_domain: bool, has_table: Column, clause_words: dict[str, tuple[str, ...]] | None = None, strong=STRONG_PHRASES) -> Column:
    """What a shared phrase (domain, key, whole) gives to a chunk."""
    if not by_domain:
        return F.least(0.15 * F.char_length("key") + 0.05, F.lit(2.0))
    clause = F.lit(False)
    for domain, words in (clause_words or {}).items():
        clause = clause | ((F.col("domain") == domain) & F.col("key").isin(*words))
    weight = _of_domain("rating") * F.least(0.2 * F.char_length("key") + 0.2, F.lit(1.0)) * F.when(clause, 1.5).otherwise(1.0) + F.when(F.col("key").isin(*strong), 40.0).otherwise(0.0) + F.when(has_table, _of_domain("table_boost") * 2.0).otherwise(0.0)
    return F.when(F.col("whole"), weight).otherwise(40.0)


def phrase_boost(chunks: DataFrame, questions: DataFrame, by_domain: bool = True, phrases: DataFrame | None = None, clause_words: dict[str, tuple[str, ...]] | None = None, strong=STRONG_PHRASES) -> DataFrame:
    """(qid, domain, doc_id, chunk_id, phrase) from CJK phrases shared with a chunk.

    Plain: 0.15 a character and 0.05 (2.0 at most), of the question's runs of 3 to 10. By domain: runs of 3 to 20 of question
    and options, rating * min(0.2 * length + 0.2, 1), half more for the domain's clause words, 40 more for strong phrases and
    twice the table weight in tables; and 40 for each strong phrase that stands anywhere in the query.
    """
    if phrases is None:
        keys = postings.postings(keyed(chunks), extract.phrase_keys(F.col("text")), ("has_table",))
    else:
        keys = phrases.join(chunks.select(*postings.KEYED, "has_table"), list(postings.KEYED))
    hits = meet(keys, phrases_asked(questions, by_domain, strong), ("domain", "key"), "doc_ids" in questions.columns)
    return hits.groupBy("qid", *postings.KEYED).agg(F.sum(phrase_points(by_domain, F.col("has_table"), clause_words, strong)).alias("phrase"))


def entities_asked(questions: DataFrame, by_domain: bool) -> DataFrame:
    """(qid, domain, _docs, key): the first mentions of each question and its options, repeats included."""
    query = F.concat_ws(" ", "question", F.array_join(_options(questions), " "))
    return questions.select("qid", "domain", _documents(questions).alias("_docs"), F.explode(extract.query_entities(query, F.col("domain") if by_domain else F.lit(""), 5 if by_domain else 3)).alias("key"))


def entity_boost(chunks: DataFrame, questions: DataFrame, by_domain: bool = True, entities: DataFrame | None = None, phrases: DataFrame | None = None, guarantees: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(qid, domain, doc_id, chunk_id, entity): 1.5 for each of the first three mentions, or the domain's weight for each of the
    first five and half of it for each of its guarantee phrases in the query. A repeated mention counts again."""
    scope = _documents(questions).alias("_docs")
    keys = postings.entity(keyed(chunks)) if entities is None else entities
    query = F.concat_ws(" ", "question", F.array_join(_options(questions), " "))
    hits = meet(keys, entities_asked(questions, by_domain), ("domain", "key"), "doc_ids" in questions.columns)
    weight = _of_domain("entity") if by_domain else F.lit(1.5)
    points = hits.select("qid", *postings.KEYED, weight.alias("x"))
    if by_domain and guarantees:
        keys = postings.phrase(keyed(chunks)) if phrases is None else phrases
        listed = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, ws in guarantees.items() for w in ws])
        said = questions.select("qid", "domain", scope, F.explode(F.filter(listed, lambda s: (s["d"] == F.col("domain")) & F.contains(query, s["w"]))).alias("s")).select("qid", "domain", "_docs", F.col("s.w").alias("key"))
        points = points.unionByName(meet(keys, said, ("domain", "key"), "doc_ids" in questions.columns).select("qid", *postings.KEYED, (_of_domain("entity") * 0.5).alias("x")))
    return points.groupBy("qid", *postings.KEYED).agg(F.sum("x").alias("entity"))


def score(chunks: DataFrame, questions: DataFrame, by_domain: bool = True, stopwords=STOPWORDS, **tables) -> DataFrame:
    """(qid, domain, doc_id, chunk_id, has_table, bm25, numeric, phrase, entity, table_boost, score) of all candidates: chunks that share
    anything with the question, and all chunks of the documents it names."""
    k1, b = (_of_domain("k1"), _of_domain("b")) if by_domain else (BASE_K1, BASE_B)
    key = ["qid", *postings.KEYED]
    parts = [bm25(chunks, questions, k1, b, stopwords=stopwords, tf=tables.get("tf"), by_domain=by_domain, known=tables.get("terms")), numeric_boost(chunks, questions, by_domain, tables.get("numbers")), phrase_boost(chunks, questions, by_domain, tables.get("phrases")), entity_boost(chunks, questions, by_domain, tables.get("entities"))]
    names = ("bm25", "numeric", "phrase", "entity")
    # one sum over a union instead of three full joins
    rows = None
    for name, df in zip(names, parts, strict=True):
        df = df.select(*key, *[(F.col(name) if n == name else F.lit(0.0)).cast("double").alias(n) for n in names])
        rows = df if rows is None else rows.unionByName(df)
    if "doc_ids" in questions.columns:
        # chunks of the named documents are candidates even if nothing matches
        named = keyed(chunks.select(*postings.KEYED)).join(questions.select("qid", "domain", F.explode("doc_ids").alias("doc_id")), ["domain", "doc_id"])
        rows = rows.unionByName(named.select(*key, *[F.lit(0.0).alias(n) for n in names]))
    out = rows.groupBy(*key).agg(*[F.sum(n).alias(n) for n in names]).join(keyed(chunks.select(*postings.KEYED, "has_table")), list(postings.KEYED))
    out = out.withColumn("table_boost", F.when(F.col("has_table"), TABLE_BONUS).otherwise(0.0))
    return out.withColumn("score", F.col("bm25") + F.col("numeric") + F.col("phrase") + F.col("entity") + F.col("table_boost"))


def select(scored: DataFrame, questions: DataFrame, k: int = 8, per_document: int = 3, vectors: DataFrame | None = None) -> DataFrame:
    """The evidence of each question, ranked.

    With several doc_ids, first up to `per_document` chunks a document (per_document * documents or k in all), then the best of
    the rest up to k. If none has a table, the best remaining one with a table takes the last place; then the first row of
    `vectors` (qid, chunk_id, vec_rank) that isn't chosen takes it.
    """
    n_docs = F.size("doc_ids") if "doc_ids" in questions.columns else F.lit(0)
    df = scored.join(questions.select("qid", n_docs.alias("_docs")), "qid")
    order = (F.desc("score"), "doc_id", "chunk_id")
    if vectors is not None:
        df = df.join(vectors.select("qid", "chunk_id", "vec_rank"), ["qid", "chunk_id"], "left")
    # Of a document nothing behind its first k chunks and its first table can be chosen, but for vector hits: the windows over a whole
    # question see no more than that.
    df = df.withColumn("_in_doc", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(*order)))
    df = df.withColumn("_in_tables", F.row_number().over(Window.partitionBy("qid", "doc_id", "has_table").orderBy(*order)))
    wanted = (F.col("_in_doc") <= max(k, per_document)) | (F.col("has_table") & (F.col("_in_tables") == 1))
    df = df.where(wanted | F.col("vec_rank").isNotNull() if vectors is not None else wanted)
    quota = (F.col("_docs") > 1) & (F.col("_in_doc") <= per_document)
    df = df.withColumn("_first", quota).withColumn("_nth", F.sum(F.col("_first").cast("int")).over(Window.partitionBy("qid").orderBy(*order)))
    df = df.withColumn("_phase", F.when(F.col("_first") & (F.col("_nth") <= F.least(F.col("_docs") * per_document, F.lit(k))), 0).otherwise(1))
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_phase", *order)))
    w = Window.partitionBy("qid")
    df = df.withColumn("_chosen", F.col("rank") <= k).withColumn("_last", F.least(F.lit(k), F.count(F.lit(1)).over(w)))
    none = ~F.max(F.col("_chosen") & F.col("has_table")).over(w)
    best = F.min(F.when(~F.col("_chosen") & F.col("has_table"), F.struct((-F.col("score")).alias("s"), "doc_id", "chunk_id"))).over(w)
    swap = none & best.isNotNull()
    is_best = swap & (best["chunk_id"] == F.col("chunk_id")) & (best["doc_id"] == F.col("doc_id"))
    df = df.withColumn("_is_best", F.coalesce(is_best, F.lit(False))).withColumn("_swap", F.coalesce(swap, F.lit(False)))
    df = df.withColumn("_chosen", (F.col("_chosen") & ~(F.col("_swap") & (F.col("rank") == F.col("_last")))) | F.col("_is_best")).withColumn("rank", F.when(F.col("_is_best"), F.col("_last")).otherwise(F.col("rank")))
    if vectors is not None:
        first = F.min(F.when(~F.col("_chosen"), F.col("vec_rank"))).over(w)
        taken = F.coalesce(F.col("vec_rank") == first, F.lit(False)) & ~F.col("_chosen")
        df = df.withColumn("_taken", taken).withColumn("_any", F.max("_taken").over(w))
        df = df.withColumn("_chosen", (F.col("_chosen") & ~(F.col("_any") & (F.col("rank") == F.col("_last")))) | F.col("_taken")).withColumn("rank", F.when(F.col("_taken"), F.col("_last")).otherwise(F.col("rank")))
    return df.where("_chosen").select(*scored.columns, "rank")


def candidates(chunks: DataFrame, questions: DataFrame, k: int = 8, by_domain: bool = True, stopwords=STOPWORDS, digits: int | None = None, **tables) -> DataFrame:
    """Rows of score(), the score rounded to `digits`, of which select() chooses the first k: of questions about documents all, which are
    the chunks of these; of others those that are among the first k with or without a table, as all would be chunks times questions."""
    from . import first  # which takes the parts of the scores from here

    def every(asked: DataFrame) -> DataFrame:
        out = score(chunks, asked, by_domain, stopwords, **tables)
        return out if digits is None else out.withColumn("score", F.round("score", digits))

    if tables.get("tf") is not None:
        return every(questions)
    if "doc_ids" not in questions.columns:
        return first.scored(chunks, questions, k, by_domain, digits, stopwords=stopwords, **tables)
    about = F.coalesce(F.size("doc_ids") > 0, F.lit(False))
    bound, free = questions.where(about), questions.where(~about)
    if free.isEmpty():
        return every(questions)
    some = first.scored(chunks, free.drop("doc_ids"), k, by_domain, digits, stopwords=stopwords, **tables)
    return some if bound.isEmpty() else every(bound).unionByName(some)


def search(chunks: DataFrame, questions: DataFrame, k: int = 8, by_domain: bool = True, vectors: DataFrame | None = None, stopwords=STOPWORDS, **tables) -> DataFrame:
    """Ranked evidence with its text and score breakdown for all questions."""
    # a vector hit may have any score
    scored = candidates(chunks, questions, k, by_domain, stopwords, **tables) if vectors is None else score(chunks, questions, by_domain, stopwords, **tables)
    chosen = select(scored, questions, k, vectors=vectors)
    return chosen.join(chunks.select(*postings.KEYED, "text"), list(postings.KEYED))
