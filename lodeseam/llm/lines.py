"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its number of words and its first words; words with a digit count as one variable field.
Below the path, a word stays if enough documents have it at its place, and becomes a variable field otherwise; a line
whose fixed words are fewer than a share of all of them keeps its own words. What then recurs over enough documents is
a template, and its lines are dropped, but for those of one document, so that no text is lost to the corpus. Lines that
recur over enough documents by themselves count like others. The documents of a template are those with one of its lines
and those of each recurring template, or line, that has its fixed words at their places. A document counts once for a
word at its place and once for a template, however many of its lines have it.

All counts come from partial aggregation, so the order of lines doesn't matter, and no task holds a whole leaf.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_hot, save, texts

#: Documents that make a template recur; first words in a line's path; share of fixed words that a template has.
MIN_DOCS, DEPTH, FIXED = 10, 3, 0.6

# SHUFFLED: the joins of texts with what was found in them are merge joins at every size. The found side grows with the
# corpus; sending it to all tasks while it is small would only make small runs unlike large ones.
_DIGITS = b"0123456789"


def masked(line: bytes) -> list[bytes]:
    """Words of a line, those with a digit as <*>."""
    words = line.split()
    if len(line.translate(None, _DIGITS)) != len(line):
        words = [w if len(w.translate(None, _DIGITS)) == len(w) else b"<*>" for w in words]
    return words


def _hash(words: list[bytes]) -> int:
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def _path(words: list[bytes], depth: int) -> int:
    return _hash([b"%d" % len(words), *words[:depth]])


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    key = [F.col("row")["doc_id"].cast("long"), F.col("row")["text"].cast("string")]
    return rows.select("row", key[0].alias("doc_id"), key[1].alias("text"), F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit(1), *key).alias("k2"))


def _again(side_by_side: DataFrame, unsure: DataFrame, parts: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, key, again): how many further lines with the key documents have that have several.

    side_by_side: (row_id, leaf, line) of documents' different lines in leaves where they have several; unsure: (leaf,
    line, docs, key), of lines in fewer than min_docs documents. Lines in more, with null keys, tell join_hot() what is hot.
    """
    asked = unsure.groupBy("leaf", "line").agg(F.max("docs").alias("docs"), F.collect_list("key").alias("keys"))
    asked = save(asked.unionByName(parts.where(F.col("docs") >= min_docs).select("leaf", "line", "docs"), allowMissingColumns=True), "asked")
    met = join_hot(side_by_side, asked, ["leaf", "line"], "docs", "inner").where("keys is not null")
    each = met.select("row_id", "leaf", F.explode("keys").alias("key")).groupBy("row_id", "leaf", "key").agg((F.count(F.lit(1)) - 1).alias("more"))
    return each.where("more > 0").groupBy("leaf", "key").agg(F.sum("more").alias("again"))


def _distinct(summed: DataFrame, again: DataFrame, keys: list[str], least: int) -> DataFrame:
    """`summed` with all its documents counted once, where there are `least`."""
    once = F.col("all") - F.coalesce("again", F.lit(0))
    return summed.drop("sure").join(again, keys, "left").withColumn("all", once).where(F.col("all") >= least).drop("again")


def _wider(recurring: DataFrame, open_ones: DataFrame) -> DataFrame:
    """(leaf, template, first_in): the templates whose fixed words a recurring one has as well, among others, and the first
    document of such ones.

    A leaf has as many sets of fixed places as its templates differ in; each recurring template is cut to each of them,
    and what is left is met by hash, so no two templates are compared."""
    places = open_ones.select("leaf", F.transform("fixed_at", lambda x: x["place"]).alias("places")).groupBy("leaf").agg(F.collect_set("places").alias("sets"))
    sets = save(places.join(recurring.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf"), "sets")
    cut = join_hot(recurring.select("leaf", "template", "first_of", "fixed_at"), sets, ["leaf"], "n", "inner").select("leaf", F.col("template").alias("of"), "first_of", "fixed_at", F.explode("sets").alias("places"))
    cut = cut.withColumn("left", F.filter("fixed_at", lambda x: F.array_contains(F.col("places"), x["place"]))).where("size(left) = size(places)")
    total = F.aggregate("left", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x["h"].cast("decimal(38,0)")).cast("decimal(38,0)"))
    return cut.select("leaf", "of", "first_of", F.xxhash64(F.lit("t"), total.cast("string")).alias("template")).where("template != of").groupBy("leaf", "template").agg(F.min("first_of").alias("first_in"))


def _recurring(rows: DataFrame, min_docs: int, depth: int, fixed: float) -> DataFrame:
    """(k1, k2, drops): the lines to drop of every document that has any."""

    def parse(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in texts(batch, 0):
                numbers, leaves, lines, of_leaf = [], [], [], {}
                for k, line in enumerate(text.split(b"\n")):
                    if words := masked(line):
                        numbers.append(k)
                        leaves.append(leaf := _path(words, depth))
                        lines.append(h := _hash(words))
                        turns = of_leaf.setdefault(leaf, {})
                        turns.setdefault(h, len(turns) + 1)
                turns = [of_leaf[leaf][h] if len(of_leaf[leaf]) > 1 else 0 for leaf, h in zip(leaves, lines, strict=True)]
                for column, x in zip(out, (numbers, leaves, lines, turns), strict=True):
                    column.append(x)
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (1, 2, 3, 4)), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "k1", "k2", "row_id", "at", "leaf", "line", "turn"])

    # turn: 0 for a document's only line of a leaf, else 1, 2, ... for its different lines there
    parsed = rows.select("text", "doc_id", "k1", "k2", F.monotonically_increasing_id().alias("row_id")).mapInArrow(parse, "doc_id long, k1 long, k2 long, row_id long, at array<int>, leaf array<long>, line array<long>, turn array<int>")
    found = save(parsed, "lines")
    each = found.select("doc_id", "k1", "k2", F.explode(F.array_distinct(F.arrays_zip("leaf", "line", "turn"))).alias("x")).select("doc_id", "k1", "k2", "x.leaf", "x.line", "x.turn")
    side_by_side = found.select("row_id", F.explode(F.array_distinct(F.filter(F.arrays_zip("leaf", "line", "turn"), lambda x: x["turn"] > 0))).alias("x")).select("row_id", "x.leaf", "x.line")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    # Lines with the documents that have them and the first of these; leaves with fewer documents than a template go at once.
    lines = save(each.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.sum((F.col("turn") > 1).cast("long")).alias("later"), F.min(first).alias("first")), "by_line")
    leaves = save(lines.groupBy("leaf").agg(F.sum("docs").alias("all"), F.count(F.lit(1)).alias("n")).where(F.col("all") >= min_docs), "leaves")
    alive = save(join_hot(lines, leaves.withColumn("several", F.col("n") > 1).drop("all"), ["leaf"], "n", "inner"), "alive")
    whole = alive.where(~F.col("several")).select("leaf", "line", "docs", "first")
    parts = save(alive.where("several").select("leaf", "line", "docs", "later", "first"), "parts")

    # Words of one line of each kind that is or may become part of a template, from the document that has it first.
    wanted = parts.groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")).agg(F.collect_set("line").alias("wanted"))

    def tokens(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, want in zip(texts(batch, 0), batch.column(1).to_pylist(), strict=True):
                left = set(want)
                for line in text.split(b"\n"):
                    if (words := masked(line)) and (h := _hash(words)) in left:
                        left.discard(h)
                        hashes = [_hash([w]) for w in words]
                        for column, x in zip(out, ([_path(words, depth)] * len(words), [h] * len(words), range(len(words)), hashes), strict=True):
                            column.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["leaf", "line", "place", "word"])

    holders = rows.select("text", "k1", "k2").join(wanted.hint("merge"), ["k1", "k2"])  # see SHUFFLED
    spelled = holders.select("text", "wanted").mapInArrow(tokens, "leaf long, line long, place int, word long").distinct()  # rows may repeat
    words = save(spelled.join(parts.select("leaf", "line", "docs", "later"), ["leaf", "line"]), "words")
    # Documents of a word: at most the sum over its lines, at least those of one line, and those whose first line of the leaf has it.
    summed = [F.sum("docs").alias("all"), F.greatest(F.max("docs"), F.sum(F.col("docs") - F.col("later"))).alias("sure"), F.count(F.lit(1)).alias("n")]
    kept = save(words.groupBy("leaf", "place", "word").agg(*summed).where(F.col("all") >= min_docs), "summed_words")
    spelling = F.struct("place", "word").alias("key")
    unsure = join_hot(words, kept.where(F.col("sure") < min_docs).select("leaf", "place", "word", "n", F.lit(True).alias("unsure")), ["leaf", "place", "word"], "n", "inner")
    twice = save(_again(side_by_side, unsure.select("leaf", "line", "docs", spelling), parts, min_docs).select("leaf", "key.place", "key.word", "again"), "twice")
    summed_words, kept = kept, save(_distinct(kept, twice, ["leaf", "place", "word"], min_docs), "kept")
    told = join_hot(words, kept.drop("all").withColumn("fixed", F.lit(True)), ["leaf", "place", "word"], "n")
    fixed_word = F.when(F.col("fixed"), F.xxhash64("place", "word"))
    shape = told.groupBy("leaf", "line").agg(
        F.count("fixed").alias("n_fixed"), F.count(F.lit(1)).alias("n_words"), F.xxhash64(F.lit("t"), F.sum(fixed_word.cast("decimal(38,0)")).cast("string")).alias("template"),
        F.collect_list(F.when(F.col("fixed"), F.struct("place", F.xxhash64("place", "word").alias("h")))).alias("fixed_at"),
    )
    shape = shape.where(F.col("n_fixed") >= fixed * F.col("n_words")).withColumn("fixed_at", F.array_sort("fixed_at")).withColumn("open", F.col("n_fixed") < F.col("n_words"))
    general = save(parts.join(shape, ["leaf", "line"]).select("leaf", "line", "docs", "later", "first", "template", "open", "fixed_at"), "general")
    by_template = general.groupBy("leaf", "template").agg(*summed, F.min("first").alias("first_of"), F.first("open").alias("open"), F.first("fixed_at").alias("fixed_at"))
    summed_templates = save(by_template.where(F.col("open") | (F.col("all") >= min_docs)), "summed_templates")
    doubtful = summed_templates.where((F.col("all") >= min_docs) & (F.col("sure") < min_docs)).select("leaf", "template", "n", F.lit(True).alias("unsure"))
    unsure = join_hot(general.select("leaf", "line", "docs", "template"), doubtful, ["leaf", "template"], "n", "inner")
    repeated = save(_again(side_by_side, unsure.select("leaf", "line", "docs", F.col("template").alias("key")), parts, min_docs).withColumnRenamed("key", "template"), "repeated")
    counted = save(_distinct(summed_templates, repeated, ["leaf", "template"], 0), "counted")
    wider = save(_wider(counted.where(F.col("all") >= min_docs), counted.where("open")), "wider")
    found_in = counted.select("leaf", "template", "all", "first_of", "n").join(wider, ["leaf", "template"], "left").where((F.col("all") >= min_docs) | F.col("first_in").isNotNull())
    ready = save(found_in.select("leaf", "template", "n", F.least("first_of", "first_in").alias("first")), "ready")
    general_of = join_hot(general.select("leaf", "line", "docs", "template"), ready, ["leaf", "template"], "n", "inner").select("leaf", "line", "docs", "first")
    dropped = save(whole.unionByName(general_of), "templates")

    at = found.select("k1", "k2", F.explode(F.arrays_zip("at", "leaf", "line")).alias("x")).select("k1", "k2", "x.at", "x.leaf", "x.line")
    marked = join_hot(at, dropped.select("leaf", "line", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"), "docs"), ["leaf", "line"], "docs", "inner").where("k1 != f1 or k2 != f2")
    out = save(marked.groupBy("k1", "k2").agg(F.collect_set("at").alias("drops")), "drops")
    drop(found, lines, leaves, alive, parts, words, summed_words, twice, kept, general, summed_templates, repeated, counted, wider, ready, dropped)
    return out


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, fixed: float = FIXED) -> DataFrame:
    """All rows of `docs`, all columns, with the lines of recurring templates taken out of text.

    Of a template the document of the smallest doc_id keeps its lines (of equal ids the same one in each run; a null id
    comes last). Lines without a word are never dropped, null and empty texts stay as they are, and n_chars, if there, follows
    the text. A very long text is cut to lines by one task, but its lines are counted by all. Repeated rows are documents of
    their own; those that repeat the document that keeps the lines keep them too. Columns may have any names; an empty table
    gives no rows.
    """
    rows = _keyed(docs)
    drops = _recurring(rows, min_docs, depth, fixed)
    names, mark = docs.columns, "_lodeseam_drops"
    place, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            new, sizes = batch.column(place).to_pylist(), batch.column(size).to_pylist() if size is not None else []
            for k, gone in enumerate(batch.column(len(names)).to_pylist()):
                if gone:
                    gone = set(gone)
                    new[k] = "\n".join(x for i, x in enumerate(new[k].split("\n")) if i not in gone)
                    if sizes:
                        sizes[k] = len(new[k])
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array(new, pa.string())
            if size is not None:
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.join(drops.hint("merge"), ["k1", "k2"], "left").select("row.*", F.col("drops").alias(mark)).mapInArrow(run, docs.schema)


def report(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, fixed: float = FIXED) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): lines with a word, those dropped, and the digest of the text that stays.
    A null or empty text has no lines and the digest of an empty one; very long texts, ties and repeated rows are as in clean().
    Other columns are ignored, whatever their names; an empty table gives no rows."""
    rows = _keyed(docs)
    drops = _recurring(rows, min_docs, depth, fixed)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, gone in zip(texts(batch, 1), batch.column(2).to_pylist(), strict=True):
                lines, gone = text.split(b"\n"), set(gone or ())
                out[0].append(sum(1 for x in lines if x.split()))
                out[1].append(len(gone))
                out[2].append(hashlib.sha256(b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.join(drops.hint("merge"), ["k1", "k2"], "left").select("doc_id", "text", "drops").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
