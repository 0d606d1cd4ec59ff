"""Retrieval and answer metrics with grouped breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import OUTPUT_REFUSALS, TYPE_WEIGHTS

REFUSED = "REFUSED"


def first_hits(ranked: DataFrame, gold: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """`items` (qid, ...) with hit_rank: the rank of the first gold chunk among the first k, 0 if there is none."""
    hits = ranked.where(F.col("rank") <= k).join(gold, ["qid", "chunk_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("hit_rank"))
    return items.join(hits, "qid", "left").withColumn("hit_rank", F.coalesce("hit_rank", F.lit(0)).cast("int"))


def _by(df: DataFrame, by: tuple[str, ...], aggregates: list[Column]) -> DataFrame:
    """Aggregates over all rows and by each column alone: (level, value, ...)."""
    sets = [()] + [(b,) for b in by]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(*aggregates, F.grouping_id(*by).alias("_g"))
    full = (1 << len(by)) - 1
    level, value = F.lit("all"), F.lit("")
    for k, b in enumerate(by):
        here = F.col("_g") == (full ^ (1 << (len(by) - 1 - k)))
        level, value = F.when(here, b).otherwise(level), F.when(here, F.coalesce(F.col(b).cast("string"), F.lit(""))).otherwise(value)
    return grouped.select(level.alias("level"), value.alias("value"), *[c for c in grouped.columns if c not in (*by, "_g")])


def retrieval(hits: DataFrame, by: tuple[str, ...] = ("layer", "domain")) -> DataFrame:
    """(level, value, n, hit, recall, mrr) over all items and by each column. Items without gold count as misses."""
    hit = (F.col("hit_rank") > 0).cast("long")
    return _by(hits, by, [F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hit"), F.avg(hit.cast("double")).alias("recall"), F.avg(F.when(F.col("hit_rank") > 0, 1.0 / F.col("hit_rank")).otherwise(0.0)).alias("mrr")])


def refused_text(text: Column, phrases=OUTPUT_REFUSALS) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p)), F.lit(False))


def is_refused(text: Column) -> Column:
    return F.coalesce(F.regexp_like(F.trim(text), F.lit("(?i)^(refused|拒答|无法回答|无法确定|不可回答)")), F.lit(False))


def answer_letters(text: Column, valid: str = "ABCD") -> Column:
    """Letters of `valid` anywhere in the upper-case text, sorted; without any, REFUSED if it has a refusal phrase, else ''."""
    letters = F.array_join(F.filter(F.array(*map(F.lit, sorted(valid))), lambda c: F.contains(F.upper(text), c)), "")
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(letters != "", letters).when(refused_text(text), REFUSED).otherwise("")


def join_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items with their answer: '' and not refused where there is none."""
    out = items.join(answers.select("qid", "answer", "refused", "tokens"), "qid", "left")
    return out.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("refused", F.coalesce("refused", F.lit(False))).withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))


def accuracy(joined: DataFrame, by: tuple[str, ...] = ("layer", "domain")) -> DataFrame:
    """(level, value, n, correct, accuracy, trap_total, trap_refused, false_refusal, total_tokens). A trap is right if it is refused."""
    clean = lambda c: F.upper(F.replace(F.col(c), F.lit(" "), F.lit("")))
    trap, said_no = F.col("gold_answer") == REFUSED, (clean("answer") == REFUSED) | F.col("refused")
    right = F.when(trap, said_no).otherwise(~said_no & (clean("answer") == clean("gold_answer")))
    count = lambda c: F.sum(c.cast("long"))
    return _by(joined, by, [F.count(F.lit(1)).alias("n"), count(right).alias("correct"), F.avg(right.cast("double")).alias("accuracy"), count(trap).alias("trap_total"), count(trap & said_no).alias("trap_refused"), count(~trap & said_no).alias("false_refusal"), F.sum("tokens").alias("total_tokens")])


def credit(gold: Column, answer: Column, refused: Column, answer_format: Column) -> Column:
    """0 to 1: traps by refusal; several choices by (right - wrong) / gold, not below 0; others by equality."""
    said_no = refused | is_refused(answer)
    picked = F.array_distinct(F.regexp_extract_all(F.upper(answer), F.lit("[A-E]"), F.lit(0)))
    wanted = F.array_distinct(F.filter(F.split(gold, ""), lambda c: c != ""))
    right, wrong = F.size(F.array_intersect(picked, wanted)), F.size(F.array_except(picked, wanted))
    multi = F.greatest(F.lit(0.0), (right - wrong) / F.greatest(F.size(wanted), F.lit(1)))
    return F.when(gold == REFUSED, said_no.cast("double")).when(said_no, 0.0).when(answer_format == "multi", multi).otherwise((F.upper(F.trim(answer)) == gold).cast("double"))


def weighted_score(joined: DataFrame, weights: dict[str, float] = TYPE_WEIGHTS) -> DataFrame:
    """(level, value, n, credit, exact, score): overall 100 * weighted mean, and means by answer_format and domain."""
    c = credit(F.col("gold_answer"), F.col("answer"), F.col("refused"), F.col("answer_format"))
    w = F.coalesce(F.element_at(F.create_map(*[x for t, v in weights.items() for x in (F.lit(t), F.lit(v))]), F.col("answer_format")), F.lit(1.0))
    df = joined.withColumn("_c", c).withColumn("_w", w)
    return _by(df, ("answer_format", "domain"), [F.count(F.lit(1)).alias("n"), F.sum("_c").alias("credit"), F.sum((F.col("_c") == 1.0).cast("long")).alias("exact"), (100 * F.sum(F.col("_w") * F.col("_c")) / F.sum("_w")).alias("score")])


def by_capability(joined: DataFrame) -> DataFrame:
    """(capability, n, mean): an item counts for each of its capabilities; a trap once more for hallucination_control."""
    c = credit(F.col("gold_answer"), F.col("answer"), F.col("refused"), F.col("answer_format"))
    own = joined.select(F.explode(F.coalesce("capabilities", F.array(F.lit("answer_accuracy")))).alias("capability"), c.alias("c"))
    traps = joined.where(F.col("gold_answer") == REFUSED).select(F.lit("hallucination_control").alias("capability"), c.alias("c"))
    return own.unionByName(traps).groupBy("capability").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"))


def failure_mode(anchor_ok: Column, doc_hit: Column, anchor_hit: Column, rank: Column, correct: Column) -> Column:
    """The first that holds: A anchor not in the source, B document missed, C anchor missed, D anchor found late (rank over 5) and
    answered wrong, E answered wrong in spite of the evidence; OK otherwise."""
    return F.when(~anchor_ok, "A").when(~doc_hit, "B").when(~anchor_hit, "C").when(~correct & (rank > 5), "D").when(~correct, "E").otherwise("OK")


def suggestions(modes: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(failure_mode, share, suggestion) for failure modes of over `threshold` of all rows."""
    text = F.create_map(*[F.lit(x) for kv in (("A", "repair the source anchors"), ("B", "widen the document scope"), ("C", "raise recall of anchors"), ("D", "rank anchored chunks higher"), ("E", "improve the judgement of evidence")) for x in kv])
    n = modes.groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("all")).where((F.col("share") > threshold) & (F.col("failure_mode") != "OK")).select("failure_mode", "share", F.element_at(text, F.col("failure_mode")).alias("suggestion"))


def token_score(answers: DataFrame, budget: int = 5_000_000) -> DataFrame:
    """(total_tokens, score): the share of the budget left, 0 to 1."""
    total = answers.agg(F.sum("tokens").cast("long").alias("total_tokens"))
    return total.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (budget - F.col("total_tokens")) / F.lit(float(budget)))))


def report(rows: DataFrame, title: str) -> str:
    """A small result table as Markdown."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(f"{x:.4g}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows.collect()]
    return "\n".join(lines)


def merge_runs(old: DataFrame, new: DataFrame, key: str = "qid") -> DataFrame:
    """Answers of a retried run over those of an earlier one: a new row replaces the old one of its key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def two_paths(items: DataFrame, ranked: DataFrame, most: int = 15) -> DataFrame:
    """Items (qid, source_doc, source_anchor) with doc_hit, anchor_hit and recall_rank among the first `most` of ranked evidence (qid,
    doc_id, text, rank): the first rank of the source document, and whether one of its chunks has one of the anchors between
    semicolons, with or without thousands commas."""
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    parts = F.filter(F.transform(F.split(F.coalesce("source_anchor", F.lit("")), "[;；]"), lambda p: F.trim(p)), lambda p: p != "")
    rows = items.select("qid", "source_doc", parts.alias("_a")).join(ranked.where(F.col("rank") <= most), "qid").where(F.col("doc_id") == F.col("source_doc"))
    met = F.exists("_a", lambda a: F.contains("text", a) | F.contains(bare(F.col("text")), bare(a)))
    hits = rows.groupBy("qid").agg(F.min("rank").alias("recall_rank"), F.max(met).alias("anchor_hit"))
    out = items.join(hits, "qid", "left")
    return out.withColumn("doc_hit", F.col("recall_rank").isNotNull()).withColumn("anchor_hit", F.coalesce("anchor_hit", F.lit(False))).withColumn("recall_rank", F.coalesce("recall_rank", F.lit(0)).cast("int"))


def source_check(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items (qid, source_doc, source_page, source_anchor) with anchor_ok, whether one of their anchors is in the document's pages (doc_id,
    page_num, text), and page_ok, whether it is on the page named."""
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    parts = F.filter(F.transform(F.split("source_anchor", "[;；]"), lambda p: F.trim(p)), lambda p: p != "")
    rows = items.select("qid", "source_page", F.col("source_doc").alias("doc_id"), parts.alias("_a")).join(pages.select("doc_id", "page_num", "text"), "doc_id")
    met = F.exists("_a", lambda a: F.contains("text", a) | F.contains(bare(F.col("text")), bare(a)))
    found = rows.groupBy("qid").agg(F.max(met).alias("anchor_ok"), F.max(met & (F.col("page_num") == F.col("source_page"))).alias("page_ok"))
    return items.join(found, "qid", "left").withColumn("anchor_ok", F.coalesce("anchor_ok", F.lit(False))).withColumn("page_ok", F.coalesce("page_ok", F.lit(False)))
