"""Chunking: four strategies that are not the same, each a fold over paragraphs or blocks inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_space
from ..functions.vocab import DOMAINS
from .steps import numbered

CLAUSE_START = r"(?m)^(?=\s*(?:第[一二三四五六七八九十百千零0-9]+[条章节]|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十0-9]+[)）]|[0-9]+(?:\.[0-9]+)+\s))"


def pack_paragraphs(text: Column, most: int = 1500, least: int = 100, overlap: int = 200) -> Column:
    """Paragraphs (cut at blank lines) packed greedily while the length stays below `most`; buffers under `least` are
    dropped. Array of (text, start): starts count the kept texts joined by line ends. `overlap` has no effect."""
    return pack_list(F.filter(F.transform(F.split(text, r"\n{2,}"), strip_space), lambda p: p != ""), most, least)


def pack_list(paragraphs: Column, most: int, least: int) -> Column:
    """pack_paragraphs() of an array of paragraphs without white space at their ends, none of them empty."""
    kind = "array<struct<text: string, start: int>>"
    zero = F.struct(F.lit("").alias("buf"), F.array().cast(kind).alias("out"), F.lit(0).alias("at"))

    def flush(s: Column) -> tuple[Column, Column]:
        fits = F.char_length(s["buf"]) >= least
        out = F.when(fits, F.concat(s["out"], F.array(F.struct(s["buf"].alias("text"), s["at"].alias("start"))))).otherwise(s["out"])
        return out, F.when(fits, s["at"] + F.char_length(s["buf"]) + 1).otherwise(s["at"]).cast("int")

    def step(s: Column, p: Column) -> Column:
        out, at = flush(s)
        grow = F.char_length(s["buf"]) + F.char_length(p) < most
        joined = F.when(s["buf"] == "", p).otherwise(F.concat(s["buf"], F.lit("\n"), p))
        return F.when(grow, F.struct(joined.alias("buf"), s["out"].alias("out"), s["at"].alias("at"))).otherwise(F.struct(p.alias("buf"), out.alias("out"), at.alias("at")))

    return F.aggregate(paragraphs, zero, step, lambda s: flush(s)[0])


def clause_pieces(text: Column, most: int) -> Column:
    """A text of at most `most` characters is one piece. Others are cut where a line starts with a clause marker; a clause
    that is too long is packed by paragraphs (a single one stays whole); then neighbours join while their sum stays below `most`."""
    parts = F.filter(F.transform(F.split(text, CLAUSE_START), strip_space), lambda p: p != "")

    def pack(items: Column, glue: str) -> Column:
        zero = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, p: Column) -> Column:
            grow = (s["buf"] == "") | (F.char_length(s["buf"]) + F.char_length(p) < most)
            joined = F.when(s["buf"] == "", p).otherwise(F.concat(s["buf"], F.lit(glue), p))
            return F.when(grow, F.struct(joined.alias("buf"), s["out"].alias("out"))).otherwise(F.struct(p.alias("buf"), F.concat(s["out"], F.array(s["buf"])).alias("out")))

        return F.aggregate(items, zero, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))))

    small = F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) <= most, F.array(p)).otherwise(pack(F.filter(F.split(p, r"\n{1,}"), lambda x: x != ""), "\n"))))
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(pack(small, "\n"))


_CHUNK = "array<struct<text: string, has_table: boolean, chunk_type: string>>"


def _chunk(text: Column, table: bool, kind: str) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(table).alias("has_table"), F.lit(kind).alias("chunk_type")))


def _block_text(b: Column) -> Column:
    return F.coalesce(b["text"], F.array_join(F.transform(b["lines"], lambda x: x["text"]), "\n"), F.lit(""))


def block_chunks(page_num: Column, blocks: Column, most: int = 1500, overlap: int = 200) -> Column:
    """Chunks of one page: tables alone behind a `[表格 - 第N页]` line; text gathers, and past `most` is cut by clauses with the
    last piece carried over; formulas are led by `[公式] `. Only before a table does the tail of `overlap` characters carry over."""
    zero = F.struct(F.lit("").alias("buf"), F.array().cast(_CHUNK).alias("out"))

    def step(s: Column, b: Column) -> Column:
        table = F.concat(F.lit("[表格 - 第"), page_num.cast("string"), F.lit("页]\n"), F.coalesce(b["markdown"], b["html"], b["text"], F.lit("")))
        flushed = F.when(s["buf"] != "", F.concat(s["out"], _chunk(s["buf"], False, "text"))).otherwise(s["out"])
        tail = F.when(F.char_length(s["buf"]) > overlap, F.substring(s["buf"], F.char_length(s["buf"]) - overlap + 1, F.lit(overlap))).otherwise(F.lit(""))
        add = F.when(b["type"] == "formula", F.concat(F.lit("[公式] "), F.coalesce(b["latex"], b["text"], F.lit("")))).otherwise(_block_text(b))
        joined = F.when(s["buf"] == "", add).otherwise(F.concat(s["buf"], F.lit("\n"), add))
        pieces = clause_pieces(joined, most)
        over = F.struct(F.element_at(pieces, -1).alias("buf"), F.concat(s["out"], F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(p.alias("text"), F.lit(False).alias("has_table"), F.lit("text").alias("chunk_type")))).alias("out"))
        more = F.when(F.char_length(joined) > most, over).otherwise(F.struct(joined.alias("buf"), s["out"].alias("out")))
        return F.when(b["type"] == "table", F.struct(tail.alias("buf"), F.concat(flushed, _chunk(table, True, "table")).alias("out"))).otherwise(more)

    return F.aggregate(blocks, zero, step, lambda s: F.when(strip_space(s["buf"]) != "", F.concat(s["out"], _chunk(s["buf"], False, "text"))).otherwise(s["out"]))


def domain_chunks(text: Column, blocks: Column, most: Column, overlap: Column, least: Column) -> Column:
    """Chunks of one page as the live index has them. Without blocks every paragraph of at least `least` characters is one.
    With blocks text gathers; before a table, and where it would pass `most`, it is emitted if long enough and its last
    `overlap` characters stay in the buffer, else it is kept and grown. A table is a chunk if it is long enough."""
    zero = F.struct(F.lit("").alias("buf"), F.array().cast(_CHUNK).alias("out"))
    long = lambda t: F.char_length(strip_space(t)) >= least

    def emitted(s: Column) -> tuple[Column, Column]:
        tail = F.when((overlap > 0) & (F.char_length(s["buf"]) > overlap), F.substring(s["buf"], F.char_length(s["buf"]) - overlap + 1, overlap)).otherwise(F.lit(""))
        return F.when(long(s["buf"]), tail).otherwise(s["buf"]), F.when(long(s["buf"]), F.concat(s["out"], _chunk(strip_space(s["buf"]), False, "text"))).otherwise(s["out"])

    def step(s: Column, b: Column) -> Column:
        buf, out = emitted(s)
        table = F.coalesce(b["markdown"], b["html"], b["text"], F.lit(""))
        after_table = F.struct(buf.alias("buf"), F.when(long(table), F.concat(out, _chunk(strip_space(table), True, "table"))).otherwise(out).alias("out"))
        add = _block_text(b)
        past = (s["buf"] != "") & (F.char_length(s["buf"]) + F.char_length(add) > most)
        glue = lambda t: F.when(t == "", add).otherwise(F.concat(t, F.lit("\n"), add))
        after_text = F.when(past, F.struct(glue(buf).alias("buf"), out.alias("out"))).otherwise(F.struct(glue(s["buf"]).alias("buf"), s["out"].alias("out")))
        return F.when(b["type"] == "table", after_table).otherwise(after_text)

    packed = F.aggregate(blocks, zero, step, lambda s: F.when(long(s["buf"]), F.concat(s["out"], _chunk(strip_space(s["buf"]), False, "text"))).otherwise(s["out"]))
    plain = F.transform(F.filter(F.transform(F.split(text, r"\n{2,}"), strip_space), lambda p: F.char_length(p) >= least), lambda p: F.struct(p.alias("text"), F.lit(False).alias("has_table"), F.lit("text").alias("chunk_type")))
    return F.when(F.size(blocks) == 0, plain).otherwise(packed)


def chunks(docs: DataFrame, strategy: str = "domain") -> DataFrame:
    """(domain, doc_id, chunk_no, chunk_id, text, has_table, page, chunk_type) of documents as sources.ingest gives them.
    strategy: domain, blocks (with pack as its fallback) or pack."""
    default = next(iter(DOMAINS.values()))
    setting = lambda name: F.coalesce(F.element_at(F.create_map(*[x for d, p in DOMAINS.items() for x in (F.lit(d), F.lit(p[name]))]), F.col("domain")), F.lit(default[name]))
    if strategy == "pack":
        pages = F.array(F.struct(F.lit(1).alias("page"), F.transform(pack_paragraphs(F.col("full_text")), lambda x: F.struct(x["text"].alias("text"), F.lit(False).alias("has_table"), F.lit("text").alias("chunk_type"))).alias("c")))
    elif strategy == "blocks":
        made = F.transform("pages", lambda p: F.struct(p["page_num"].alias("page"), block_chunks(p["page_num"], p["blocks"]).alias("c")))
        packed = F.struct(F.lit(1).alias("page"), F.transform(pack_paragraphs(F.col("full_text")), lambda x: F.struct(x["text"].alias("text"), F.lit(False).alias("has_table"), F.lit("text").alias("chunk_type"))).alias("c"))
        pages = F.when(F.exists(made, lambda m: F.size(m["c"]) > 0), made).otherwise(F.array(packed))
    elif strategy == "domain":
        pages = F.transform("pages", lambda p: F.struct(p["page_num"].alias("page"), domain_chunks(p["text"], p["blocks"], setting("max_chars"), setting("overlap"), setting("min_chars")).alias("c")))
    else:
        raise ValueError(strategy)
    flat = F.flatten(F.transform(pages, lambda p: F.transform(p["c"], lambda c: F.struct(p["page"].alias("page"), c.alias("c")))))
    out = docs.select("domain", "doc_id", F.posexplode(flat).alias("chunk_no", "x"))
    return out.select("domain", "doc_id", "chunk_no", F.concat("doc_id", F.lit("_c"), F.col("chunk_no").cast("string")).alias("chunk_id"), "x.c.text", "x.c.has_table", "x.page", "x.c.chunk_type")


def positions(chunks: DataFrame, order: str = "chunk_no") -> DataFrame:
    """Adds chunk_position: the first fifth of a document's chunks (at least one) is head, the last fifth tail, the rest body."""
    df = numbered(chunks, ["doc_id"], [order])
    k, n = F.col("_k"), F.col("_n")
    head = F.greatest(F.lit(1), F.floor(n * 0.2))
    tail = F.greatest(head + 1, F.floor(n * 0.8))
    return df.withColumn("chunk_position", F.when(k < head, "head").when(k >= tail, "tail").otherwise("body")).drop("_k", "_n")
