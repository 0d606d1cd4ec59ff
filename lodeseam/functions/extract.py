"""Arrays taken from a text: number keys, phrases, clauses, entities, keywords, and the words of the ranking."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, index_form, let
from .vocab import DICTIONARY, STOPWORDS, SYMBOL_METRICS

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
NUMERAL = "一二三四五六七八九十百千"
CLAUSE = rf"第[{NUMERAL}零0-9]+\s*[条章节款项号]"
ORGANISATION = rf"[{CJK}]{{2,15}}(?:股份|集团|科技|证券|银行|保险|控股)"
# Unit factors of normalised amounts, and the words before an approximate number.
AMOUNTS = (("亿元", 100_000_000), ("万元", 10_000), ("百万元", 1_000_000), ("元", 1))
RAW_UNITS = ("亿元", "万元", "百万元", "元", "%", "亿美元")
MODIFIERS = ("约", "超过", "超", "达到")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bare(items: Column) -> Column:
    """Each item without white space inside."""
    return F.transform(items, lambda x: F.regexp_replace(x, r"\s+", ""))


def number_keys(text: Column, of_index: bool = True) -> Column:
    """Keys by which numbers are looked up: bare digits, with their unit, digits of a percentage, and digits after a
    modifier. of_index: also with `%` put directly behind, and with LaTeX escapes taken out first."""

    def keys(t: Column, units=RAW_UNITS, modifiers=MODIFIERS) -> Column:
        parts = [found(t, NUMBER), *(bare(found(t, rf"{NUMBER}\s*{u}")) for u in units), found(t, rf"({NUMBER})\s*%", 1), *(found(t, rf"{m}\s*({NUMBER})", 1) for m in modifiers)]
        if of_index:
            parts.append(F.transform(found(t, rf"({NUMBER})\s*%", 1), lambda x: F.concat(x, F.lit("%"))))
        return F.array_distinct(F.concat(*parts))

    def either(t: Column) -> Column:
        # all units but one and all modifiers are CJK; a text without CJK is not looked through for each
        return F.when(F.regexp_like(t, F.lit(f"[{CJK}]")), keys(t)).otherwise(keys(t, ("%",), ()))

    return let(index_form(text) if of_index else F.replace(text, F.lit(","), F.lit("")), either)


def amounts(text: Column) -> Column:
    """Amounts in yuan, as doubles (kept numbers, as texts of doubles differ between engines)."""

    def values(t: Column) -> Column:
        scaled = lambda u, k: F.transform(found(t, rf"({NUMBER})\s*{u}", 1), lambda x: x.cast("double") * F.lit(float(k)))
        return F.array_distinct(F.concat(*(scaled(u, k) for u, k in AMOUNTS)))

    return let(index_form(text), values)


def converted(key: Column) -> Column:
    """A decimal key and what it is in units 100, 10,000 and 1,000,000 times smaller, cut to whole numbers by double arithmetic."""
    times = lambda k: (key.cast("double") * F.lit(float(k))).cast("long").cast("string")
    return F.when(key.rlike(r"^[0-9]+\.[0-9]+$"), F.array_distinct(F.array(key, times(100), times(10_000), times(1_000_000)))).otherwise(F.array(key))


def graph_numbers(text: Column) -> Column:
    """Number keys of the graph index: percentages; amounts with their whole and short unit; comma groups; and numbers of two
    or more digits that are not years, with no digit beside them."""

    def keys(t: Column) -> Column:
        with_unit = lambda u: F.flatten(F.transform(found(t, rf"({NUMBER})\s*{u}", 1), lambda x: F.array(F.concat(x, F.lit(u)), F.concat(x, F.lit(u[0])))))
        big = [with_unit(u) for u in ("亿元", "万元")]
        groups = F.transform(found(t, r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?"), lambda x: F.replace(x, F.lit(","), F.lit("")))
        plain = F.filter(found(t, r"(?<![0-9])[0-9]{2,}(?:\.[0-9]+)?(?![0-9])"), lambda x: ~x.rlike(r"^(?:19|20)[0-9]{2}$"))
        return F.array_distinct(F.concat(F.transform(found(t, rf"({NUMBER})\s*%", 1), lambda x: F.concat(x, F.lit("%"))), *big, groups, plain))

    return let(text, keys)


def phrases(text: Column, least: int = 2, most: int = 20, stopwords=STOPWORDS) -> Column:
    """Maximal CJK runs, cut at `most` from the left, that are no stop word."""
    return F.array_distinct(F.filter(found(text, rf"[{CJK}]{{{least},{most}}}"), lambda p: ~p.isin(*stopwords)))


def clauses(text: Column) -> Column:
    return F.array_distinct(bare(found(text, CLAUSE)))


def word_runs(text: Column, n: int = 2) -> Column:
    """Distinct runs of n neighbouring words of the ranking: the phrases of texts without CJK."""

    def runs(t: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: i + (n - 1) <= F.size(t)), lambda i: F.array_join(F.slice(t, i, n), " ")))

    return let(tokens(text), runs)


def phrase_keys(text: Column) -> Column:
    """Keys of the phrase index: phrases and clause references."""
    return F.array_union(phrases(text), clauses(text))


def entities(text: Column, domain: Column) -> Column:
    """Keys of the entity index: organisations, clauses, long company names and, in insurance, products."""
    base = F.concat(found(text, ORGANISATION), bare(found(text, CLAUSE)), found(text, rf"[{CJK}]{{6,20}}(?:有限公司|股份有限公司|集团)"))
    products = F.when(domain == "insurance", found(text, rf"[{CJK}]{{2,8}}(?:险|保)")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(base, products))


def query_entities(text: Column, domain: Column, first: int) -> Column:
    """The first mentions of a query, repeats included: organisations, then clauses (regulatory) or products (insurance)."""
    none = F.array().cast("array<string>")
    more = F.when(domain == "regulatory", found(text, rf"第[{NUMERAL}0-9]+\s*[条章节款项]")).when(domain == "insurance", found(text, rf"[{CJK}]{{2,8}}(?:险|保)")).otherwise(none)
    return F.slice(F.concat(found(text, ORGANISATION), more), 1, first)


def cjk_keywords(text: Column, stopwords=STOPWORDS, least: int = 2, most: int = 8) -> Column:
    """Distinct CJK runs, longest first, otherwise in order of appearance."""
    kept = F.array_distinct(F.filter(found(text, rf"[{CJK}]{{{least},{most}}}"), lambda k: ~k.isin(*stopwords)))
    ranked = F.array_sort(F.transform(kept, lambda k, i: F.struct((-F.char_length(k)).alias("n"), i.alias("i"), k.alias("k"))))
    return F.transform(ranked, lambda s: s["k"])


def symbol_keywords(text: Column, least: int = 2, most: int = 12) -> Column:
    """Words cut between CJK and Latin characters and at punctuation, not all digits; sorted, so that a cap is the same in each run."""
    spaced = F.regexp_replace(F.regexp_replace(text, rf"([{CJK}])([0-9A-Za-z])", "$1 $2"), rf"([0-9A-Za-z])([{CJK}])", "$1 $2")
    words = F.split(F.regexp_replace(spaced, rf"[^{CJK}\p{{L}}\p{{N}}_]", " "), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= least) & (F.char_length(w) <= most) & ~w.rlike(r"^[0-9]+$"))))


def symbol_metrics(text: Column, words=SYMBOL_METRICS) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def symbol_periods(text: Column) -> Column:
    return found(text, r"20[0-9]{2}(?:年|年度)?|第[一二三四]季度|[0-9]{4}[-/][0-9]{2}(?:[-/][0-9]{2})?|(?:半年|年度)报告")


def symbol_numbers(text: Column) -> Column:
    return F.transform(found(text, r"[0-9,]+\.?[0-9]*\s*(?:万元|亿元|元|万亿|万|百万|千万)"), lambda x: F.trim(x))


def symbol_percentages(text: Column) -> Column:
    return found(text, r"[0-9.]+\s*%")


def symbol_clauses(text: Column) -> Column:
    return found(text, rf"第[{NUMERAL}0-9]+条|第[（(][一二三四五六七八九十0-9]+[)）]款|条款\s*[0-9]+|第\s*[0-9]+\s*条")


def cited_numbers(text: Column) -> Column:
    """Numbers of an answer as they are written."""
    return found(text, r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?")


def citations(text: Column) -> Column:
    """Distinct numbers of [证据N] marks, ascending."""
    return F.array_sort(F.array_distinct(F.transform(found(text, r"\[证据\s*([0-9]{1,2})\]", 1), lambda x: x.cast("int"))))


def option_anchors(option: Column) -> Column:
    """Strong anchors of an option: numbers with a unit, years and other whole numbers of four or more digits, decimals with or without
    %, clauses, a.b.c numbers and titles. A piece of a longer number is no anchor, as it would stand in many other numbers."""
    patterns = (rf"{NUMBER}\s*(?:亿元|万元|百万元|元|亿|万|年|个月|日|天|倍|%)", r"[0-9]{4,}", r"[0-9]+\.[0-9]+%?", CLAUSE, r"[0-9]+\.[0-9]+\.[0-9]+", r"《[^》]+》")
    return F.array_distinct(bare(F.concat(*(found(option, p) for p in patterns))))


def scan_keywords(question: Column, options: Column, most: int = 15) -> Column:
    """Keywords to scan whole documents for: clauses and titles of the question; numbers, years, decimals and CJK runs of all."""
    whole = F.concat_ws(" ", question, options)
    return F.slice(F.array_distinct(F.concat(bare(found(question, CLAUSE)), found(question, r"《[^》]+》"), bare(found(whole, rf"{NUMBER}\s*(?:亿元|万元|百万元|元|%|年|月|日)")), found(whole, r"[0-9]{4}"), found(whole, r"[0-9]+\.[0-9]+%?"), found(whole, rf"[{CJK}]{{2,}}"))), 1, most)


def option_keywords(option: Column, most: int = 10) -> Column:
    return F.slice(F.array_distinct(F.concat(bare(found(option, CLAUSE)), bare(found(option, rf"{NUMBER}\s*(?:亿元|万元|百万元|元|%|年|月|日)")), found(option, r"[0-9]+\.[0-9]+%?"), found(option, rf"[{CJK}]{{2,6}}"))), 1, most)


def numbers_with_unit(text: Column) -> Column:
    """Of four patterns in this order, repeats kept: thousands groups, percentages, amounts, counts."""
    patterns = (r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\s*(?:亿元|万元|元)?", rf"{NUMBER}\s*%", rf"{NUMBER}\s*(?:亿元|万元|百万元|元)", rf"{NUMBER}\s*(?:年|个月|日|天|倍|家|名)")
    return F.concat(*(found(text, p) for p in patterns))


def split_number(text: Column) -> Column:
    """(core, unit) of a number with its unit."""
    return F.struct(F.regexp_extract(text, r"^([0-9,.]+)", 1).alias("core"), F.regexp_extract(text, r"^[0-9,.]+\s*(.*)$", 1).alias("unit"))


#: Latin letters with their accented forms; numbers; CJK runs.
TOKEN = r"[a-z\x{00c0}-\x{024f}]+|[0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]+"


def pairs_of(run: Column) -> Column:
    """A CJK run as its pairs of characters: the segmenter where no dictionary is given."""
    return F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))


def by_dictionary(words=DICTIONARY):
    """A segmenter that cuts a CJK run from the left, the longest word of a dictionary first; what is between words stays whole if
    it is short (up to three characters) and becomes pairs otherwise."""
    listed = "|".join(sorted({w for w in words if w}, key=lambda w: (-len(w), w)))
    pattern = rf"(?:{listed})|(?:(?!{listed})[{CJK}])+"

    def cut(run: Column) -> Column:
        return F.flatten(F.transform(found(run, pattern), lambda w: F.when(w.isin(*words) | (F.char_length(w) <= 3), F.array(w)).otherwise(pairs_of(w))))

    return cut


def by_weights(counts: dict[str, float]):
    """A segmenter that takes the best path through the graph of a run's words: of all ways to cut it into words of a dictionary and
    single characters, the one whose words have the largest product of relative counts (a character without a count has 1); at a tie the
    one with the longer first word. Single characters without a count that stand side by side become one piece, which is cut into pairs
    if it has over three characters.

    The path is found from the right by dynamic programming over the places of the run; only words that the run contains take part.
    """
    total = sum(counts.values()) or 1.0
    weight = lambda n: math.log(n) - math.log(total)
    told = json.dumps([{"w": w, "x": weight(n)} for w, n in sorted(counts.items()) if w and n > 0], ensure_ascii=False)
    single = weight(1.0)

    def cut(run: Column) -> Column:
        size = F.char_length(run)
        words = F.transform(F.from_json(F.lit(told), "array<struct<w: string, x: double>>"), lambda e: F.struct(e["w"].alias("w"), e["x"].alias("x"), F.char_length(e["w"]).alias("n")))

        def path(near: Column) -> Column:
            # best[k]: score and first word's length of the last k characters
            def step(best: Column, k: Column) -> Column:
                here = F.filter(near, lambda e: (e["n"] <= k) & (F.substring(run, size - k + 1, e["n"]) == e["w"]))
                ways = F.transform(here, lambda e: F.struct((e["x"] + F.get(best, k - e["n"])["x"]).alias("x"), e["n"].alias("n"), F.lit(True).alias("known")))
                alone = F.struct((F.lit(single) + F.get(best, k - 1)["x"]).alias("x"), F.lit(1).alias("n"), F.lit(False).alias("known"))
                # a character with a count of its own is no unknown one
                return F.concat(best, F.array(F.array_max(F.concat(ways, F.when(F.exists(here, lambda e: e["n"] == 1), F.array().cast("array<struct<x: double, n: int, known: boolean>>")).otherwise(F.array(alone))))))

            begin = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0).alias("n"), F.lit(False).alias("known")))
            best = F.aggregate(F.sequence(F.lit(1), size), begin, step)
            none = F.array().cast("array<struct<w: string, known: boolean>>")

            def walk(all_: Column) -> Column:
                def forward(s: Column, at: Column) -> Column:
                    way = F.get(all_, size - at + 1)
                    piece = F.struct(F.substring(run, at, way["n"]).alias("w"), way["known"].alias("known"))
                    return F.when(at < s["at"], s).otherwise(F.struct((at + way["n"]).alias("at"), F.concat(s["out"], F.array(piece)).alias("out")))

                return F.aggregate(F.sequence(F.lit(1), size), F.struct(F.lit(1).alias("at"), none.alias("out")), forward, lambda s: s["out"])

            return let(best, walk)

        def joined(pieces: Column) -> Column:
            # known words stand between marks, so what is left between them are unknown characters side by side
            marked = F.array_join(F.transform(pieces, lambda p: F.when(p["known"], F.concat(F.lit("\x01"), p["w"], F.lit("\x01"))).otherwise(p["w"])), "")
            parts = F.filter(F.split(marked, "\x01"), lambda p: p != "")
            known = F.transform(F.filter(pieces, lambda p: p["known"]), lambda p: p["w"])
            return F.flatten(F.transform(parts, lambda p: F.when(F.array_contains(known, p) | (F.char_length(p) <= 3), F.array(p)).otherwise(pairs_of(p))))

        return let(let(F.filter(words, lambda e: F.contains(run, e["w"])), path), joined)

    return cut


def tokens(text: Column, stopwords=STOPWORDS, segment=pairs_of) -> Column:
    """Words of the ranking: lower-case Latin words, numbers without thousands commas, and CJK runs as `segment` cuts them, by
    default into their pairs of characters (one character stays alone). Table marks go first; repeats stay."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\[表格[^\]]*\]|\[标题\]", ""), r"(?<=[0-9]),(?=[0-9]{3})", "")
    words = F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))
    split = F.flatten(F.transform(words, lambda w: F.when(w.rlike(rf"^[{CJK}]{{2,}}$"), segment(w)).otherwise(F.array(w))))
    return F.filter(F.when(F.regexp_like(text, F.lit(f"[{CJK}]")), split).otherwise(words), lambda w: ~w.isin(*stopwords))
