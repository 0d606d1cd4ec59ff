"""Text columns: normalisation, excerpts and estimates. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
# Company suffixes, tried in this order.
SUFFIXES = ("股份有限公司", "有限责任公司", "有限公司", "集团公司", "集团", "股份", "银行", "证券", "保险", "基金")
# Units that lose the space before them.
UNITS = ("亿元", "万元", "百万元", "元", "%", "亿", "万", "年", "月", "日", "倍", "个")


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_space(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def html_to_text(html: Column) -> Column:
    """Rows become lines and cells are led by ` | `; other tags go; entities stay as they are."""
    steps = ((r"<tr[^>]*>", "\n"), (r"<t[dh][^>]*>", " | "), (r"<[^>]+>", ""), (r"\n{2,}", "\n"))
    return strip_space(reduce(lambda c, step: F.regexp_replace(c, *step), steps, html))


def normalize_entity(name: Column) -> Column:
    """A name without the first of SUFFIXES that it ends in, if anything is left."""
    out = name
    for suffix in reversed(SUFFIXES):
        fits = name.endswith(suffix) & (F.char_length(name) > len(suffix))
        out = F.when(fits, F.substring(name, F.lit(1), F.char_length(name) - len(suffix))).otherwise(out)
    return out


def normalize_latex(text: Column) -> Column:
    r"""Drops \( and \) with the spaces around them and \, ; \% and "\ " lose their backslash; no space between a digit and a unit."""
    steps = ((r"\s*\\[()]\s*", ""), (r"\\%", "%"), (r"\\,", ""), (r"\\ ", " "))
    text = F.col(text) if isinstance(text, str) else text
    # a text without a backslash has none of these marks
    plain = F.when(F.contains(text, F.lit("\\")), reduce(lambda c, step: F.regexp_replace(c, *step), steps, text)).otherwise(text)
    return F.regexp_replace(plain, rf"([0-9])\s+({'|'.join(UNITS)})", "$1$2")


def index_form(text: Column) -> Column:
    r"""The text that number keys are taken from: \( \) \, and thousands commas go, \% becomes %."""
    out = text
    for old, new in (("\\(", ""), ("\\)", ""), ("\\%", "%"), ("\\,", ""), (",", "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def plain_number(text: Column) -> Column:
    """Without ASCII and full-width thousands commas."""
    return F.trim(F.translate(text, ",，", ""))


def excerpt(text: Column, anchor: Column, width: int = 400) -> Column:
    """The first occurrence of the anchor with width / 2 characters on either side, `...` where text is cut; without an
    occurrence the first `width` characters."""
    at = F.position(anchor, text) - 1
    first = F.greatest(at - width // 2, F.lit(0))
    last = F.least(at + F.char_length(anchor) + width // 2, F.char_length(text))
    cut = F.concat(F.when(first > 0, "...").otherwise(""), F.substring(text, first + 1, last - first), F.when(last < F.char_length(text), "...").otherwise(""))
    return F.when((at < 0) | (F.char_length(anchor) == 0), F.substring(text, 1, width)).otherwise(cut)


def excerpt_number(text: Column, number: Column, width: int = 400) -> Column:
    """Like excerpt(), but the number may have thousands commas in the text."""
    digits = F.array_join(F.transform(F.filter(F.split(plain_number(number), ""), lambda d: d != ""), lambda d: F.when(d == ".", r"\.").otherwise(d)), ",*")
    return F.when(F.regexp_like(text, digits), excerpt(text, F.regexp_substr(text, digits), width)).otherwise(F.substring(text, 1, width))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def estimate_tokens(text: Column, style: str = "mixed") -> Column:
    """Token estimates by character class, cut to whole numbers. mixed: 1.5 a CJK character and 0.25 any other;
    fine: 1.0 CJK, 1.3 Latin letter runs, 0.5 digit runs, 0.3 white space, 1.0 other."""
    cjk = count_of(text, f"[{CJK}]")
    if style == "mixed":
        return (cjk * 1.5 + (F.char_length(text) - cjk) * 0.25).cast("long")
    latin, digit, space = count_of(text, "[A-Za-z]+"), count_of(text, "[0-9]"), count_of(text, r"[ \t-\r]")
    other = count_of(text, rf"[^{CJK}A-Za-z0-9 \t-\r]")
    return (cjk * 1.0 + latin * 1.3 + digit * 0.5 + other * 1.0 + space * 0.3).cast("long")


def document_of(chunk_id: Column) -> Column:
    """The part of a chunk id before its last `_c`."""
    return F.regexp_replace(chunk_id, r"_c(?!.*_c).*$", "")


def answer_text(value: Column) -> Column:
    """An answer that is either a JSON object with `answer` or the string itself."""
    return F.coalesce(F.get_json_object(value, "$.answer"), value)
