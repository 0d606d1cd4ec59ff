"""Evaluation items made from a corpus: metric and value pairs, questions of several kinds, quality gates and samples.

Order that would be random elsewhere comes from md5 of a seed and an id, so every run and every engine agrees.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import let
from ..functions.vocab import ENTITY_METRICS
from . import substring
from .sizes import scan
from .steps import cut, numbered

UNIT = "亿元|万元|百万元|元|%|年|个月|日|天|倍|家|人"
PAIRS = "chunk_id string, doc_id string, domain string, pos int, metric string, is_vocab boolean, num string, num_core string, unit string, sentence string, entity string"


def shuffled(seed: str | int, *ids: str | Column) -> Column:
    """A key that orders rows as if at random, the same way everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i for i in ids]))


#: The column in which pairs, and items with one gold chunk, may take that chunk's text along to quality().
TEXT = "gold_text"


def metric_pairs(chunks: DataFrame, metrics: tuple[str, ...] = ENTITY_METRICS, entities: tuple[str, ...] = (), noise: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(metric, value) pairs of chunks (see PAIRS). Tables are one sentence with bars as spaces; other text is cut at 。；; and line
    ends. Numbers have two digits or more and are no years. The metric is the last vocabulary word that, with connecting words,
    ends right before the number, else the CJK characters (2 to 12) before it if no noise word is in them. with_text: with the chunk's
    text in TEXT."""
    words = "|".join(rf"\Q{m}\E" for m in sorted(metrics, key=lambda m: (-len(m), m))) or "(?!)"
    tail = rf"({words})\s*(?:共计|分别为?|约为?|为|是|达到?|不超过|[:：])*\s*$"
    number = rf"([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*({UNIT}))?"
    text = F.coalesce("text", F.lit(""))
    table = F.array(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("|"), F.lit(" ")), r"\s*[-:]{3,}\s*", " "), r"\s+", " "))
    sentences = F.when(F.contains(text, F.lit("|")), table).otherwise(F.split(text, r"[。；;\n]"))

    def listed(of: Column, which) -> Column:
        return F.get(F.filter(F.array(*map(F.lit, of)) if of else F.array().cast("array<string>"), which), F.lit(0))

    # a metric word spans at most so many numbers, and one more piece holds what a unit took of its first characters
    back = 2 + max([len(re.findall("[0-9]+", m)) for m in metrics], default=0)

    def named(found: Column) -> Column:
        run = F.regexp_extract(found, r"([\x{4e00}-\x{9fff}（）()]{2,12})$", 1)
        usable = ~run.endswith("的") & listed(noise, lambda n: F.contains(run, n)).isNull()
        return let(F.regexp_extract(found, tail, 1), lambda m: F.when(m != "", m).when(usable, run).otherwise(F.lit("")))

    def long(r: Column) -> Column:
        return (F.char_length(F.regexp_replace(r["core"], "[,.]", "")) >= 2) & ~(r["core"].rlike("^(?:19|20)[0-9]{2}$") & r["unit"].isin("", "年"))

    def read(pieces: Column, whole: Column, entity: Column) -> Column:
        part = lambda p, k: F.regexp_extract(p, rf"{number}$", k)
        numbers = F.filter(F.transform(pieces, lambda p, k: F.struct(k.alias("k"), part(p, 0).alias("told"), part(p, 1).alias("core"), part(p, 2).alias("unit"))), long)

        def pair(r: Column) -> Column:
            first = F.greatest(r["k"] - back, F.lit(0))
            near = F.array_join(F.slice(pieces, first + 1, r["k"] - first + 1), "")
            before = F.regexp_replace(F.substring(near, F.lit(1), F.char_length(near) - F.char_length(r["told"])), r"\s+$", "")
            return F.struct(named(before).alias("metric"), r["told"].alias("num"), r["core"].alias("num_core"), r["unit"].alias("unit"), whole.alias("sentence"), entity.alias("entity"))

        return F.filter(F.transform(numbers, pair), lambda r: r["metric"] != "")

    def pairs(sentence: Column) -> Column:
        # each piece goes from the end of the number before it to that of its own; what is the same for all is worked out once
        whole = F.regexp_replace(sentence, r"^\s+|\s+$", "")
        entity = F.coalesce(listed(entities, lambda e: F.contains(sentence, e)), F.lit(""))
        once = F.struct(extract.found(sentence, rf"[^0-9]*{number}").alias("pieces"), whole.alias("whole"), entity.alias("entity"))
        return let(once, lambda o: read(o["pieces"], o["whole"], o["entity"]))

    also = [F.col("text").alias(TEXT)] if with_text else []
    rows = chunks.select("chunk_id", "doc_id", "domain", *also, F.posexplode(F.flatten(F.transform(sentences, pairs))).alias("pos", "p"))
    return rows.select("chunk_id", "doc_id", "domain", "pos", "p.metric", F.col("p.metric").isin(*metrics).alias("is_vocab"), "p.num", "p.num_core", "p.unit", "p.sentence", "p.entity", *([TEXT] if with_text else []))


def value(core: Column) -> Column:
    return F.replace(core, F.lit(","), F.lit("")).cast("double")


def shown(x: Column) -> Column:
    """A number as text: whole if it is whole, else to two places, halves to even."""
    return let(F.bround(x, 2), lambda r: F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(F.format_string("%.2f", r)))


def distractors(gold: Column, pool: Column, n: int = 3) -> Column:
    """The first n different values of a pool that aren't the gold, filled with twice it, a tenth more and a tenth of it."""
    x = F.replace(gold, F.lit(","), F.lit("")).cast("double")
    fill = F.array(shown(x * 2), shown(x * 1.1), shown(x / 10))
    return F.slice(F.array_except(F.array_distinct(F.concat(F.coalesce(pool, F.array().cast("array<string>")), fill)), F.array(gold)), 1, n)


def with_options(df: DataFrame, gold: Column, wrong: Column, seed: int, key: Column) -> DataFrame:
    """Adds _o, the gold and the wrong values in shuffled order, and _l, the letter of the gold one."""
    ranked = F.array_sort(F.transform(F.concat(F.array(gold), wrong), lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key, o)).alias("h"), o.alias("o"))))
    return df.withColumn("_o", F.transform(ranked, lambda r: r["o"])).withColumn("_l", F.substring(F.lit("ABCDEFGH"), F.array_position("_o", gold).cast("int"), F.lit(1)))


def value_pool(pairs: DataFrame, most: int = 50) -> DataFrame:
    """(domain, unit, pool): up to `most` different values by unit, in shuffled order."""
    distinct = pairs.select("domain", "unit", "num_core").distinct()
    w = Window.partitionBy("domain", "unit").orderBy(shuffled(42, "num_core"), "num_core")
    return distinct.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).groupBy("domain", "unit").agg(F.array_sort(F.collect_list(F.struct("_k", "num_core"))).alias("_p")).select("domain", "unit", F.transform("_p", lambda p: p["num_core"]).alias("pool"))


def _item(df: DataFrame, layer: str, answer_format: str, question: Column, options: Column, gold: Column, difficulty: str = "medium", chunks: Column | None = None, docs: Column | None = None, anchor: Column | None = None) -> DataFrame:
    chunks = F.array("chunk_id") if chunks is None else chunks
    docs = F.array("doc_id") if docs is None else docs
    anchor = F.col("num") if anchor is None else anchor
    return df.select("domain", F.lit(layer).alias("layer"), F.lit(answer_format).alias("answer_format"), question.alias("question"), options.alias("options"), gold.alias("gold_answer"), docs.alias("gold_doc_ids"), chunks.alias("gold_chunk_ids"), anchor.alias("source_anchor"), F.lit(difficulty).alias("difficulty"), *([TEXT] if TEXT in df.columns else []))


def single_hop(pairs: DataFrame, seed: int = 42, tables: bool | None = None, layer: str = "single_hop") -> DataFrame:
    """Questions for the value of a metric in a document, from vocabulary metrics; wrong values of the same unit that aren't in the sentence."""
    # a row for each of the few units of a domain; dealt by them, all pairs would be a task's or two
    df = pairs.where("is_vocab").join(F.broadcast(value_pool(pairs)), ["domain", "unit"], "left")
    # values of a pool differ, so of those that aren't in the sentence four hold three others than the gold one; nearly all are in none
    free = lambda pool: F.slice(F.filter(pool, lambda p: ~F.contains("sentence", p)), 1, 4)
    pool = let(free(F.slice("pool", 1, 8)), lambda first: F.when(F.size(first) == 4, first).otherwise(free(F.col("pool"))))
    df = with_options(df, F.col("num_core"), distractors(F.col("num_core"), pool), seed, F.concat_ws("|", "chunk_id", "pos"))
    return _item(df, layer, "mcq", F.format_string("根据文档%s，%s为多少%s？", "doc_id", "metric", "unit"), F.col("_o"), F.col("_l"), "easy")


def multi_hop(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Questions that compare two documents' values of one metric and unit: documents in shuffled order, taken by twos. Gold are
    the chunks that hold the two facts."""
    one = pairs.where("is_vocab").withColumn("_k", F.row_number().over(Window.partitionBy("domain", "metric", "unit", "doc_id").orderBy("chunk_id", "pos"))).where("_k = 1")
    # all documents may have one metric, so none of these groups is left to one task
    one = one.select("domain", "metric", "unit", "doc_id", "chunk_id", "num_core", shuffled(seed, "doc_id").alias("_h"))
    one = cut(numbered(one, ["domain", "metric", "unit"], ["_h", "doc_id"]).withColumn("_n", F.col("_k") + 1).drop("_h", "_k"))
    a = one.where("_n % 2 = 1")
    b = one.select("domain", "metric", "unit", (F.col("_n") - 1).alias("_n"), F.col("doc_id").alias("doc_b"), F.col("chunk_id").alias("chunk_b"), F.col("num_core").alias("num_b"))
    df = a.join(b, ["domain", "metric", "unit", "_n"]).where(value(F.col("num_core")) != value(F.col("num_b")))
    gold = F.when(value(F.col("num_core")) > value(F.col("num_b")), "A").otherwise("B")
    return _item(df, "multi_hop", "mcq", F.format_string("%s与%s相比，哪一份文档的%s更高？", "doc_id", "doc_b", "metric"), F.array("doc_id", "doc_b"), gold, "hard", F.array("chunk_id", "chunk_b"), F.array("doc_id", "doc_b"), F.concat_ws(";", "num_core", "num_b"))


def temporal(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Questions for a metric's value in one of two years: pairs of one entity and metric whose sentences name different years and
    whose values differ."""
    df = pairs.where("is_vocab and entity != ''").withColumn("_y", F.regexp_extract("sentence", "(20[0-9]{2})", 1)).where("_y != ''")
    other = df.select("domain", "entity", "metric", "unit", F.col("_y").alias("_y2"), F.col("num_core").alias("num_b"), F.col("chunk_id").alias("chunk_b"))
    df = df.join(other, ["domain", "entity", "metric", "unit"]).where("_y > _y2 and num_core != num_b").drop(TEXT)  # of one of its chunks
    df = with_options(df, F.col("num_core"), distractors(F.col("num_core"), F.array("num_b")), seed, F.concat_ws("|", "chunk_id", "pos"))
    return _item(df, "temporal", "mcq", F.format_string("%s%s年的%s为多少%s？", "entity", "_y", "metric", "unit"), F.col("_o"), F.col("_l"), "hard", F.array("chunk_id", "chunk_b"))


def unanswerable(pairs: DataFrame, texts: DataFrame, hint: str, seed: int = 42) -> DataFrame:
    """Traps: a metric of another document of the domain that the asked document (doc_id, text) never names."""
    metrics = pairs.where("is_vocab").select("domain", "metric").distinct()
    docs = pairs.select("domain", "doc_id").distinct().join(texts, "doc_id")
    # a row for each word of the vocabulary in a domain
    free = docs.join(F.broadcast(metrics), "domain").where(~F.contains("text", F.col("metric"))).withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy(shuffled(seed, "doc_id", "metric"), "metric"))).where("_k = 1")
    none = F.array().cast("array<string>")
    return _item(free, "unanswerable", "mcq", F.concat(F.format_string("根据文档%s，%s为多少？", "doc_id", "metric"), F.lit(hint)), F.array(*map(F.lit, ("10", "20", "30", "40"))), F.lit("REFUSED"), "hard", none, F.array("doc_id"), F.col("metric"))


def true_false(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Statements that are true, or false by a doubled value, half and half by hash."""
    df = pairs.where("is_vocab").withColumn("_t", F.substring(shuffled(seed, "chunk_id", "pos"), 1, 1).isin(*"01234567"))
    said = F.when(F.col("_t"), F.col("num_core")).otherwise(shown(value(F.col("num_core")) * 2))
    return _item(df, "single_hop", "tf", F.format_string("文档%s中%s为%s%s。", "doc_id", "metric", said, "unit"), F.array(F.lit("正确"), F.lit("错误")), F.when(F.col("_t"), "A").otherwise("B"), "easy")


def multi_select(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Five statements on one document, three true and two with doubled values, on different metrics."""
    w = Window.partitionBy("domain", "doc_id")
    one = pairs.where("is_vocab").withColumn("_k", F.row_number().over(Window.partitionBy("domain", "doc_id", "metric").orderBy("chunk_id", "pos"))).where("_k = 1")
    one = one.withColumn("_n", F.row_number().over(w.orderBy(shuffled(seed, "metric"), "metric"))).where("_n <= 5")
    said = F.when(F.col("_n") <= 3, F.col("num_core")).otherwise(shown(value(F.col("num_core")) * 2))
    rows = one.select("domain", "doc_id", "chunk_id", "num_core", F.struct(shuffled(seed + 1, "doc_id", "metric").alias("h"), F.format_string("%s为%s%s", "metric", said, "unit").alias("o"), (F.col("_n") <= 3).alias("t")).alias("s"))
    df = rows.groupBy("domain", "doc_id").agg(F.array_sort(F.collect_list("s")).alias("_s"), F.array_sort(F.collect_set("chunk_id")).alias("_c"), F.concat_ws(";", F.array_sort(F.collect_list("num_core"))).alias("num")).where(F.size("_s") == 5)
    letters = F.array_join(F.filter(F.transform("_s", lambda s, i: F.when(s["t"], F.substring(F.lit("ABCDE"), i + 1, F.lit(1))).otherwise("")), lambda x: x != ""), "")
    return _item(df, "multi_select", "multi", F.format_string("关于文档%s，下列说法正确的有哪些？", "doc_id"), F.transform("_s", lambda s: s["o"]), letters, "hard", F.col("_c"))


# Directions of a rule and what they are turned into.
FLIPS = {"不低于": "不高于", "不高于": "不低于", "不少于": "不超过", "不超过": "不少于", "高于": "低于", "低于": "高于", "大于": "小于", "小于": "大于", "至少": "至多", "至多": "至少"}
RULE = r"([\x{4e00}-\x{9fff}]{2,12})(不低于|不高于|不少于|不超过|高于|低于|大于|小于|至少|至多)\s*([0-9]+(?:\.[0-9]+)?)\s*(亿元|万元|元|%|年|个月|日|天|倍)"


def logical_rule(chunks: DataFrame, seed: int = 42) -> DataFrame:
    """For each rule of a chunk (subject, direction, number, unit): which statement follows? The rule, and it with its number cut by a
    fifth, its direction turned, and both."""
    also = [TEXT] if TEXT in chunks.columns else []
    rules = chunks.select("domain", "doc_id", "chunk_id", *also, F.posexplode(F.regexp_extract_all("text", F.lit(RULE), F.lit(0))).alias("pos", "num"))
    g = lambda k: F.regexp_extract("num", RULE, k)
    turned = F.element_at(F.create_map(*[F.lit(x) for kv in FLIPS.items() for x in kv]), g(2))
    less = shown(g(3).cast("double") * 0.8)
    wrong = F.array(F.concat(g(1), g(2), less, g(4)), F.concat(g(1), turned, g(3), g(4)), F.concat(g(1), turned, less, g(4)))
    rules = with_options(rules, F.concat(g(1), g(2), g(3), g(4)), wrong, seed, F.concat_ws("|", "chunk_id", "pos"))
    return _item(rules, "logical_rule", "logical", F.format_string("根据文档%s的规定，下列哪一项成立？", "doc_id"), F.col("_o"), F.col("_l"), "medium")


def logical_compare(pairs: DataFrame) -> DataFrame:
    """Which of a chunk's first two values of one unit is larger?"""
    w = Window.partitionBy("chunk_id").orderBy("pos")
    df = pairs.withColumn("_n", F.row_number().over(w)).withColumn("_m", F.lead("metric").over(w)).withColumn("_v", F.lead("num_core").over(w)).withColumn("_u", F.lead("unit").over(w))
    df = df.where("_n = 1 and _u = unit and _m != metric").where(value(F.col("num_core")) != value(F.col("_v")))
    return _item(df, "logical_compare", "logical", F.format_string("文档%s中，%s与%s哪一项更大？", "doc_id", "metric", "_m"), F.array("metric", "_m"), F.when(value(F.col("num_core")) > value(F.col("_v")), "A").otherwise("B"), "medium", anchor=F.concat_ws(";", "num_core", "_v"))


def pair_join(pairs: DataFrame, ratio: float = 1e4) -> DataFrame:
    """Pairs i < j of one chunk and unit whose values differ by a factor of at most `ratio`: (chunk_id, ..., metric_b, num_b)."""
    # a chunk is one row of a table, so the pairs of one fit a window; a join would make all of them twice
    later = Window.partitionBy("chunk_id", "unit").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    seen = pairs.where("unit != '' AND chunk_id IS NOT NULL").withColumn("_later", F.collect_list(F.struct("pos", "metric", "num_core")).over(later))
    met = seen.withColumn("_b", F.explode("_later")).drop("_later").select("*", F.col("_b.pos").alias("pos_b"), F.col("_b.metric").alias("metric_b"), F.col("_b.num_core").alias("num_b")).drop("_b")
    x, y = value(F.col("num_core")), value(F.col("num_b"))
    return met.where((F.col("pos") < F.col("pos_b")) & (F.col("metric") != F.col("metric_b")) & (x > 0) & (y > 0) & (F.greatest(x, y) <= ratio * F.least(x, y)))


def calc(pairs: DataFrame, texts: DataFrame, seed: int = 42, a_chunk: int = 2) -> DataFrame:
    """Sums and differences of two values of a chunk (chunk_id, text) whose result isn't in it, at most `a_chunk` a chunk. Pairs with
    their chunk's text need no join with it."""
    df = pair_join(pairs).withColumn("_sum", F.substring(shuffled(seed, "chunk_id", "pos", "pos_b"), 1, 1).isin(*"01234567"))
    x, y = value(F.col("num_core")), value(F.col("num_b"))
    df = df.withColumn("_r", shown(F.when(F.col("_sum"), x + y).otherwise(F.abs(x - y))))
    df = (df if TEXT in df.columns else df.join(texts.select("chunk_id", F.col("text").alias("_text")), "chunk_id")).where(~F.contains(TEXT if TEXT in df.columns else "_text", F.col("_r")))
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos", "pos_b"))).where(F.col("_k") <= a_chunk)
    df = with_options(df, F.col("_r"), distractors(F.col("_r"), F.array("num_core", "num_b")), seed, F.concat_ws("|", "chunk_id", "pos", "pos_b"))
    asked = F.format_string("文档%s中，%s与%s的%s为多少%s？", "doc_id", "metric", "metric_b", F.when(F.col("_sum"), "合计").otherwise("差额"), "unit")
    return _item(df, "calc", "calc", asked, F.col("_o"), F.col("_l"), "hard", anchor=F.concat_ws(";", "num_core", "num_b"))


def anchor_forms(anchor: Column) -> Column:
    """An anchor as it is, without thousands commas, and its parts between semicolons in both forms."""
    parts = F.filter(F.transform(F.split(anchor, "[;；]"), lambda p: F.trim(p)), lambda p: p != "")
    bare = lambda a: F.regexp_replace(a, "[,，]", "")
    return F.struct(anchor.alias("whole"), bare(anchor).alias("bare"), F.transform(parts, lambda p: F.struct(p.alias("whole"), bare(p).alias("bare"))).alias("parts"))


def anchored(forms: Column, text: Column, all_but: int = 1) -> Column:
    """anchor_in_text() for forms worked out before a join."""
    there = lambda f: F.contains(text, f["whole"]) | ((f["bare"] != f["whole"]) & F.contains(text, f["bare"]))
    several = F.size(forms["parts"]) > 1
    return there(forms) | (several & (F.size(F.filter(forms["parts"], there)) >= F.greatest(F.size(forms["parts"]) - all_but, F.lit(1))))


def anchor_in_text(anchor: Column, text: Column, all_but: int = 1) -> Column:
    """The anchor, or it without thousands commas, is in the text; or, of its parts between semicolons, all but one (one at least)."""
    return let(anchor_forms(anchor), lambda forms: anchored(forms, text, all_but))


def anchor_chunks(items: DataFrame, chunks: DataFrame, all_but: int = 1) -> DataFrame:
    """(qid, columns of chunks but the text): the chunks that hold the anchor of each of `items` (qid, anchor), a stated set, as
    anchor_in_text() has it. Each form of an anchor and of its parts is looked for by its rarest 3-gram. An empty anchor is in every
    text, as an empty form of a part is; a null one in none."""
    forms = cut(items.select("qid", anchor_forms(F.col("anchor")).alias("f")).where("f.whole IS NOT NULL"))
    two = lambda f, part: F.array(*[F.struct(f[n].alias("phrase"), part.cast("int").alias("part")) for n in ("whole", "bare")])
    each = F.concat(two(F.col("f"), F.lit(-1)), F.flatten(F.transform("f.parts", lambda p, i: two(p, i))))
    looked = cut(forms.select("qid", F.size("f.parts").alias("parts"), F.explode(F.array_distinct(each)).alias("x")).select("qid", "parts", "x.phrase", "x.part"))
    rest = [c for c in chunks.columns if c != "text"]
    found = substring.within(looked, chunks).select("qid", "phrase", *rest).join(looked, ["qid", "phrase"])
    blank = looked.where("phrase = ''")
    if not blank.isEmpty():
        found = found.unionByName(scan(blank, chunks, F.col("text").isNotNull()).select("qid", "phrase", *rest, "parts", "part"))
    met = found.groupBy("qid", *rest).agg(F.max(F.col("part") < 0).alias("_whole"), F.count_distinct(F.when(F.col("part") >= 0, F.col("part"))).alias("_some"), F.max("parts").alias("_parts"))
    return met.where("_whole").select("qid", *rest).unionByName(met.where(~F.col("_whole") & (F.col("_parts") > 1) & (F.col("_some") >= F.greatest(F.col("_parts") - all_but, F.lit(1)))).select("qid", *rest))


def anchor_snippet(anchor: Column, text: Column, around: int = 80) -> Column:
    at = F.position(anchor, text)
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + F.char_length(anchor) + around))


def quality(items: DataFrame, texts: DataFrame, options: int = 4) -> DataFrame:
    """Adds reason: '' for items that pass, else options, anchor (not in its gold chunks) or leak (a trap's metric is in its document, a
    calculation's result in its chunk). Items that have the text of their one gold chunk in TEXT are judged where they are; others meet
    the texts of their gold chunks."""
    if TEXT in items.columns:
        return items.withColumn("reason", _reason(F.coalesce(TEXT, F.lit("")), options)).drop(TEXT)
    items = cut(items)
    ident = F.md5(F.to_json(F.struct(*items.columns)))
    joined = items.withColumn("_id", ident).select("*", F.explode_outer("gold_chunk_ids").alias("chunk_id")).join(texts.select("chunk_id", "text"), "chunk_id", "left")
    checked = joined.groupBy("_id").agg(F.array_join(F.collect_list("text"), "\n").alias("_t"))
    df = items.withColumn("_id", ident).join(checked, "_id").drop("_id")
    return df.withColumn("reason", _reason(F.col("_t"), options)).drop("_t")


def _reason(text: Column, options: int) -> Column:
    gold = F.element_at("options", F.instr(F.lit("ABCDEFGH"), F.col("gold_answer")).cast("int"))
    several = F.col("answer_format").isin("mcq", "calc") & (F.size("options") < F.when(F.col("layer") == "multi_hop", 2).otherwise(options))
    lacks = (F.size("gold_chunk_ids") > 0) & ~anchor_in_text(F.col("source_anchor"), text, 0)
    leak = (F.col("answer_format") == "calc") & F.contains(text, F.coalesce(gold, F.lit("\u0000")))
    return F.when(several, "options").when(lacks, "anchor").when(leak, "leak").otherwise("")


def stratified(items: DataFrame, quotas: dict[str, int], stratum: str = "layer", key: str = "question", seed: int = 42) -> DataFrame:
    """Up to each stratum's quota of items, in shuffled order; strata without a quota are left out."""
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum))
    w = Window.partitionBy(stratum).orderBy(shuffled(seed, key), key)
    # the largest quota is a number, by which each task passes on only the first rows of a stratum
    most = max(quotas.values(), default=0)
    return items.withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= most) & (F.col("_k") <= quota)).drop("_k")


def shares(total: int, parts: dict[str, float]) -> dict[str, int]:
    """Whole quotas of a total by shares; what rounding leaves goes to the first."""
    out = {k: int(total * p) for k, p in parts.items()}
    first = next(iter(out))
    out[first] += total - sum(out.values())
    return out


def counts(items: DataFrame, *by: str) -> DataFrame:
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# Characters of amounts, words of ratios, and words that no metric's name has.
MONEY_WORDS, RATIO_WORDS = ("收入", "利润", "金额", "资产", "费用", "成本", "余额"), ("收益率", "渗透率", "占有率")
NO_METRIC = ("截至", "已经", "目前", "此外", "同时", "由于", "因此", "如果", "根据", "按照")


def sane(metric: Column, number: Column, money: tuple[str, ...] = MONEY_WORDS) -> Column:
    """Whether a metric and a number go together: no percentage for an amount, and nothing else for a ratio."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(metric, w))
    share = F.trim(number).endswith("%") | F.trim(number).endswith("％")
    return ~(share & has(money)) & ~(~share & has(RATIO_WORDS))


def clean_name(metric: Column) -> Column:
    """Whether a metric's name is fit for a question: 2 to 16 characters, no brackets or punctuation, no word of NO_METRIC."""
    return F.char_length(metric).between(2, 16) & ~F.regexp_like(metric, F.lit("[（(）)：:，,、%％]")) & ~F.exists(F.array(*map(F.lit, NO_METRIC)), lambda w: F.contains(metric, w))
