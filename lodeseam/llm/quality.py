"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than ASCII white space. No rule looks beyond the row, so nothing is shuffled; all of
it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP

# Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it on for was with as be by are this at from have not "
    "le la les de des du et un une est que en dans qui pas pour au sur ce il "
    "der die das und den dem ein eine zu von mit ist auf nicht des im sich für als "
    "el los las y se por con su al lo como una del no es"
).split()
# The symbols of the contract.
SYMBOLS = r"[#*$%&|<>]"

#: (measure, comparison that a kept document meets, bound). One row a rule; see judged() for the names.
RULES = (
    ("n_words", ">=", 50),
    ("repeat_ratio", "<=", 0.5),
    ("n_words", "<=", 1_000_000),
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 14.0),
    ("symbol_ratio", "<=", 0.1),
    ("stop_ratio", ">=", 0.02),
    ("dup_line_ratio", "<=", 0.5),
)


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often `use` has it and wherever the optimiser moves the whole."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that are found twice or more. Windows are told apart by 64-bit hashes."""
    n = F.size(words)

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def in_order(hashes: Column) -> Column:
        # equal windows stand side by side once sorted
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: covered(F.transform(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))

    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(windows, lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(in_order(hashes)))


def measures(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """A struct of the whole numbers that the rules are about."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_lines(lines: Column) -> list[Column]:
        return [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")]

    def of_words(words: Column) -> list[Column]:
        return [
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.filter(words, lambda w: w.isin(*stop_words))).cast("long").alias("n_stop_words"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        ]

    words = F.array_remove(F.split(text, WORD_GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(_let(words, lambda w: F.struct(*of_words(w))).alias("w"), _let(lines, lambda x: F.struct(*of_lines(x))).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))


def judged(text: Column, rules=RULES) -> Column:
    """A struct of MEASURES, base_failed and kept."""

    def ratios(m: Column) -> dict[str, Column]:
        n = F.greatest(m["w"]["n_words"], F.lit(1))
        return {
            "n_words": m["w"]["n_words"],
            "word_chars": m["w"]["word_chars"],
            "n_symbols": m["n_symbols"],
            "n_dup_lines": m["l"]["n_dup_lines"],
            "n_repeat_words": m["w"]["n_repeat_words"],
            "repeat_ratio": m["w"]["n_repeat_words"] / n,
            "mean_word_chars": m["w"]["word_chars"] / n,
            "symbol_ratio": m["n_symbols"] / n,
            "stop_ratio": m["w"]["n_stop_words"] / n,
            "dup_line_ratio": m["l"]["n_dup_lines"] / F.greatest(m["l"]["n_lines"], F.lit(1)),
        }

    def verdict(m: Column) -> Column:
        values = ratios(m)
        base = (values["n_words"] < 50) | (100 * values["n_repeat_words"] > 50 * values["n_words"])
        return F.struct(*[x.alias(n) for n, x in values.items()], base.alias("base_failed"), (~base & _verdict(rules, values)).alias("kept"))

    return _let(measures(text), verdict)


def _verdict(rules, values: dict[str, Column]) -> Column:
    """True where every rule of the table holds."""
    out = F.lit(True)
    for measure, sign, bound in rules:
        out = out & ((values[measure] >= bound) if sign == ">=" else (values[measure] <= bound))
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_ratio", "mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio")


def score(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed (under 50 words, or over half of them in repeated three-word windows) and kept.

    A null or empty text has no words and fails; a very long one is judged whole. Rows of equal or null doc_id and repeated
    rows are judged alone, and a value that equals a bound passes. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(F.col("text"), rules).alias("m")).select("doc_id", "m.*")


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of `docs` that pass, all columns as they are; nulls, ties and repeated rows as in score()."""
    return docs.where(judged(F.col("text"), rules)["kept"])
