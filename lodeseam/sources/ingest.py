"""Readers: parsed documents, questions, evaluation sets and answers, as DataFrames with one explicit schema each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_latex
from ..functions.vocab import COMPOSITES
from ..operators.ranges import near
from ..operators.steps import numbered

BLOCK = "struct<type: string, text: string, html: string, markdown: string, latex: string, lines: array<struct<text: string>>>"
PAGE = f"struct<page_num: int, page: int, text: string, blocks: array<{BLOCK}>>"
DOCUMENT_BLOCKS = f"array<{BLOCK}>"
TABLE = "struct<page: int, page_num: int, markdown: string, html: string>"
DOCUMENT = f"doc_id string, filename string, path string, page_count int, full_text string, pages array<{PAGE}>, tables array<{TABLE}>"
QUESTION = "qid string, domain string, question string, options map<string, string>, answer_format string, type string, doc_ids array<string>"
EVAL_ITEM = (
    "qid string, domain string, answer_format string, question string, options array<string>, gold_answer string, gold_doc_ids array<string>, "
    "gold_chunk_ids array<string>, source_anchor string, layer string, difficulty string, capabilities array<string>, generation_note string"
)


def _json(spark: SparkSession, path: str | list[str], schema: str, lines: bool) -> DataFrame:
    """JSON rows and their file; broken rows are left out."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_broken", T.StringType())])
    df = spark.read.schema(full).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("encoding", "UTF-8").json(path)
    return df.withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).where("_broken is null").drop("_broken")


def _inject(pages: Column, tables: Column) -> Column:
    """Each page with its non-empty tables as further blocks; page numbers from either field."""
    number = lambda p: F.coalesce(p["page_num"], p["page"], F.lit(0))
    of = lambda p: F.transform(F.filter(tables, lambda t: (F.coalesce(t["page"], t["page_num"], F.lit(0)) == number(p)) & (F.length(F.coalesce(t["markdown"], t["html"], F.lit(""))) > 0)), lambda t: F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), t["html"].alias("html"), t["markdown"].alias("markdown"), F.lit(None).cast("string").alias("latex"), F.lit(None).cast("array<struct<text: string>>").alias("lines")))
    empty = F.array().cast(f"array<{BLOCK}>")
    return F.transform(pages, lambda p: F.struct(number(p).alias("page_num"), F.coalesce(p["text"], F.lit("")).alias("text"), F.concat(F.coalesce(p["blocks"], empty), of(p)).alias("blocks")))


def infer_domain(doc_id: Column, filename: Column) -> Column:
    """Domain by the first rule that fits the name; `unknown` if none does."""
    rules = ((r"^text[0-9]{2}", "financial_contracts"), (r"^annual_", "financial_reports"), (r"^[0-9]+(\.json)?$", "insurance"), (r"^(csrc|strict_v3)", "regulatory"), (r"^pack2_text", "research"))
    out = F.lit("unknown")
    for pattern, domain in reversed(rules):
        out = F.when(doc_id.rlike(pattern) | filename.rlike(pattern), domain).otherwise(out)
    return out


def documents(spark: SparkSession, path: str | list[str], domains: DataFrame | None = None, name_like: str | None = None) -> DataFrame:
    """Parsed documents, one JSON object a file, missing fields as empty ones: (doc_id, filename, path, page_count, full_text,
    pages with tables injected, domain). `domains` (doc_id, domain) goes before inference from the name; `name_like` is a
    pattern that file names must start with."""
    df = _json(spark, path, DOCUMENT, lines=False)
    if name_like:
        df = df.where(F.col("_file").rlike(f"^(?:{name_like})"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    pages = _inject(empty(F.col("pages"), f"array<{PAGE}>"), empty(F.col("tables"), f"array<{TABLE}>"))
    stem = F.regexp_replace("_file", r"\.json$", "")
    df = df.select(F.coalesce("doc_id", stem).alias("doc_id"), F.coalesce("filename", "_file").alias("filename"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("page_count", F.size(pages)).alias("page_count"), F.coalesce("full_text", F.lit("")).alias("full_text"), pages.alias("pages"))
    inferred = infer_domain(F.col("doc_id"), F.col("filename"))
    if domains is None:
        return df.withColumn("domain", inferred)
    return df.join(domains.select("doc_id", F.col("domain").alias("_told")), "doc_id", "left").withColumn("domain", F.coalesce("_told", inferred)).drop("_told")


def page_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "domain", F.explode("pages").alias("p")).select("doc_id", "domain", "p.page_num", "p.text", "p.blocks")


def document_text(docs: DataFrame, tables_first: bool = False, normalised: bool = False, chunks: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): page texts joined by line ends; full_text where there are no pages.

    tables_first: the tables' markdown goes before the pages, and empty parts are left out. normalised: LaTeX marks are taken out.
    chunks: the texts of a document's (doc_id, chunk_no, text) rows follow its pages.
    """
    tables = F.flatten(F.transform("pages", lambda p: F.transform(F.filter(p["blocks"], lambda b: b["type"] == "table"), lambda b: F.coalesce(b["markdown"], b["html"], b["text"], F.lit("")))))
    pages = F.transform("pages", lambda p: p["text"])
    text = F.array_join(F.filter(F.concat(tables, pages), lambda x: x != "") if tables_first else pages, "\n")
    out = docs.select("doc_id", F.when(F.size("pages") > 0, text).otherwise(F.col("full_text")).alias("text"))
    if chunks is not None:
        more = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), "\n").alias("_more"))
        out = out.join(more, "doc_id", "left").select("doc_id", F.concat_ws("\n", "text", "_more").alias("text"))
    return out.withColumn("text", normalize_latex(F.col("text"))) if normalised else out


def resolved(questions: DataFrame, composites: dict[str, tuple[str, ...]] = COMPOSITES) -> DataFrame:
    """Questions whose doc_ids have identifiers of several documents replaced by these, in place; each document once."""
    if not composites:
        return questions
    table = F.create_map(*[x for name, ids in composites.items() for x in (F.lit(name), F.array(*map(F.lit, ids)))])
    return questions.withColumn("doc_ids", F.array_distinct(F.flatten(F.transform("doc_ids", lambda d: F.coalesce(F.element_at(table, d), F.array(d))))))


def nearby_pages(docs: DataFrame, wanted: DataFrame, radius: int = 5) -> DataFrame:
    """For (doc_id, page) rows: the text of the pages at most `radius` away, in order. A range join by bins of pages."""
    pages = page_rows(docs).select("doc_id", "page_num", F.concat_ws("\n", "text", F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "table"), lambda b: F.coalesce(b["markdown"], b["html"], F.lit(""))), "\n")).alias("t"))
    joined = near(pages, wanted.select("doc_id", "page"), ["doc_id"], "page_num", "page", radius)
    return joined.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("s")).select("doc_id", "page", F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("text"))


def questions(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Questions of JSON arrays (or lines) in file order: an ordinal `ord` counts over all files sorted by name. A file's
    own order is kept by its row numbers."""
    df = _json(spark, path, QUESTION, lines).withColumn("answer_format", F.coalesce("answer_format", "type"))
    # numbered by ranges, so that no task has all rows
    return numbered(df.withColumn("_row", F.monotonically_increasing_id()), [], ["_file", "_row"]).withColumn("ord", (F.col("_k") + 1).cast("int")).drop("_row", "_k", "_n")


def mixed_questions(spark: SparkSession, arrays: list[str], lines: list[str]) -> DataFrame:
    """JSON arrays and JSON lines together, sorted by qid, each with its file as `_source`."""
    parts = [questions(spark, p, lines=k) for k, ps in ((False, arrays), (True, lines)) for p in ps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumnRenamed("_file", "_source").drop("ord").orderBy("qid")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the one of the largest `order`."""
    whole = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(whole, order).alias("_row")).select("_row.*")


def first_directory(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """For (doc_id) wanted and (doc_id, dir_ord, ...) files: the file in the first directory that has it."""
    w = Window.partitionBy("doc_id").orderBy("dir_ord")
    return files.join(manifest.select("doc_id"), "doc_id", "left_semi").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def domain_mapping(questions: DataFrame) -> DataFrame:
    """(doc_id, domain) from all questions; the last in file order wins."""
    return questions.select(F.explode("doc_ids").alias("doc_id"), "domain", "ord").groupBy("doc_id").agg(F.max_by("domain", "ord").alias("domain"))


def eval_items(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Evaluation items of JSON lines, options also as a map from letters; the first `most` of the file if given."""
    df = _json(spark, path, EVAL_ITEM, lines=True).where("qid is not null").drop("_file")
    letters = F.transform("options", lambda o, i: F.substring(F.lit("ABCDEFGHIJ"), i + 1, F.lit(1)))
    df = df.withColumn("option_map", F.map_from_arrays(letters, "options")).withColumn("ord", F.monotonically_increasing_id())
    return df.orderBy("ord").limit(most) if most else df


def aliases(rows: DataFrame, blacklist, stopwords) -> DataFrame:
    """Unambiguous aliases from (alias_list, definition) rows: lists are cut at 、，, ; the full name is the definition's last
    table cell if it has 指. Dropped: full names over 40 characters, aliases not of 3 to 12, listed words, and aliases of
    several full names."""
    full = F.trim(F.when(F.contains("definition", F.lit("指")), F.element_at(F.split("definition", r"\|"), -1)).otherwise(F.col("definition")))
    df = rows.select(F.explode(F.split("alias_list", "[、，,]")).alias("alias"), full.alias("full_name")).withColumn("alias", F.trim("alias"))
    df = df.where((F.char_length("full_name") <= 40) & F.char_length("alias").between(3, 12) & ~F.col("alias").isin(*blacklist, *stopwords))
    return df.groupBy("alias").agg(F.count_distinct("full_name").alias("n"), F.min("full_name").alias("full_name")).where("n = 1").drop("n")


def fingerprint(spark: SparkSession, path: str | list[str], **parameters: object) -> str:
    """md5 of the names, sizes and times of the files and of the parameters that an index depends on; no content is read."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("n"), "length", F.col("modificationTime").cast("string").alias("t"))
    listed = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", "n", F.col("length").cast("string"), "t"))), F.lit(repr(sorted(parameters.items()))))
    return files.agg(F.md5(listed).alias("f")).first()["f"]


def answers(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(qid, answer, refused, tokens) of answer files; of a repeated qid the last row."""
    schema = "qid string, answer string, refused boolean, tokens long"
    return last_wins(_json(spark, path, schema, lines).drop("_file").withColumn("_ord", F.monotonically_increasing_id()), "qid", "_ord").drop("_ord")
