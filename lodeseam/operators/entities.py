"""Entity mentions with their places, facts of an option, and lookup tasks of a question."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import CJK, SUFFIXES
from ..functions.vocab import ENTITY_METRICS

# Patterns of each entity type, in order. The first group is the value.
PATTERNS = {
    "company": (
        r"([一-龥]{2,15}(?:股份|集团|科技|电子|银行|证券|保险|基金|控股)(?:有限公司)?(?:\([一-龥]+\))?)",
        r"([一-龥]{2,10}(?:证券|保险|银行|基金|信托|期货)(?:股份)?有限公司)",
        r"((?:中国|国家)[一-龥]{2,10}(?:有限公司|集团|公司))",
    ),
    "regulation": (
        r"(《[^》]{3,80}》)",
        r"((?:中华人民共和国)?[一-龥]{2,30}(?:法|条例|管理办法|实施细则|规定|准则|指引|规则|细则|通知|公告|意见|决定|命令|令))",
        r"((?:中国人民银行|中国证监会|银保监会|国家金融监督管理总局|国务院|财政部|国家税务总局|国家发改委)[一-龥]{2,40})",
        r"([一二三四五六七八九十百千\d]+号令)",
        r"(\d{4}年\d{1,2}月\d{1,2}日[一-龥]{2,20}(?:发布|实施|施行))",
    ),
    "amount": (r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:万)?元", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*亿元", r"(?:人民币|港币|美元)\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:万)?元?"),
    "percentage": (r"(\d+(?:\.\d+)?)\s*%", r"百分之\s*(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*个百分点"),
    "clause": (
        r"第\s*([一二三四五六七八九十百千\d]+)\s*条", r"第\s*([一二三四五六七八九十百千\d]+)\s*款", r"第\s*([一二三四五六七八九十百千\d]+)\s*章", r"第\s*([一二三四五六七八九十百千\d]+)\s*节",
        r"第\s*([一二三四五六七八九十百千\d]+)\s*项", r"(?:^|\s)(\d+(?:\.\d+){1,3})(?:\s*[|｜])", r"((?:附|附件)[一二三四五六七八九十\d]+)", r"(第[一二三四五六七八九十百千\d]+号令)",
    ),
    "product": (
        r"([一-龥]{2,15}(?:保险|基金|理财|债券|信托|资管)(?:产品|计划|账户)?)",
        r"((?:平安|人保|太保|众安|国寿|新华|泰康|太平|太平洋|中国人寿|中国平安|中国太保|中国财险)[一-龥]{2,20})",
        r"([一-龥]{2,10}(?:年金|寿险|重疾|医疗|意外|养老|分红|万能|投连|两全|定期|终身)(?:保险)?)",
        r"([一-龥]{2,15}(?:2024|2025|2026)[一-龥]{0,10}(?:款|版)?(?:保险|产品|计划)?)",
        r"([A-Za-z][一-龥]{2,15}(?:保险|产品|计划|账户)?)",
    ),
    "period": (r"(\d{4})\s*年", r"(上年|本年|当年|前年|去年|今年)", r"(上年同期|本报告期|报告期|上一报告期)"),
}
# Names of products.
BRANDS = ("智盈金生", "增益宝", "长相伴", "财富金生", "金佑人生", "国寿福", "康宁终身", "平安福", "太保寿险", "安享百万", "百万医疗")
# What comes before the value in a name, and behind it.
NAMES = {"amount": ("金额_", ""), "percentage": ("比例_", "%"), "clause": ("条款_", ""), "period": ("期间_", "")}
MENTIONS = "chunk_id string, type string, name string, value string, start int, end int"


def _short(name: str) -> str:
    return next((name[: -len(s)] for s in SUFFIXES if name.endswith(s) and len(name) > len(s)), name)


def _fixed(metrics: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """An automaton of all fixed words; each has (type, group, rank, word) entries. Of a group's words that overlap in a text, the
    one that begins first counts, and of those the one of the lowest rank: metrics don't hide each other, brands do."""
    entries: dict[str, list[tuple]] = {}
    for k, word in enumerate(dict.fromkeys(BRANDS)):
        entries.setdefault(word, []).append(("product", -1, k, word))
    for k, word in enumerate(dict.fromkeys(m for m in metrics if m)):
        entries.setdefault(word, []).append(("metric", k, 0, word))
    if not entries:
        return None
    found = ahocorasick.Automaton()
    for word, of in entries.items():
        found.add_word(word, of)
    found.make_automaton()
    return found


def _words(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[str, str, int, int]]:
    """(type, word, start, end) of the fixed words of a text, in one pass over it."""
    groups: dict[int, list[tuple]] = {}
    for last, entries in automaton.iter(text):
        for kind, group, rank, word in entries:
            groups.setdefault(group, []).append((last + 1 - len(word), rank, kind, word))
    for group in sorted(groups):
        free = 0
        for start, _, kind, word in sorted(groups[group]):
            if start >= free:
                free = start + len(word)
                yield kind, word, start, free


def _outer(found: list[tuple]) -> list[tuple]:
    """The (type, name, value, start, end) mentions that lie in no longer one of another type, in order."""
    inside, far = set(), {}  # far: the furthest end of each type, of mentions that begin before or are longer
    for span, same in itertools.groupby(sorted(range(len(found)), key=lambda i: (found[i][3], -found[i][4])), key=lambda i: found[i][3:]):
        same = list(same)
        inside.update(i for i in same if any(end >= span[1] for kind, end in far.items() if kind != found[i][0]))
        for i in same:
            far[found[i][0]] = max(span[1], far.get(found[i][0], 0))
    return [m for i, m in enumerate(found) if i not in inside]


def mentions(chunks: DataFrame, metrics: tuple[str, ...] = ENTITY_METRICS, nested: bool = True) -> DataFrame:
    """Entity mentions of chunks (chunk_id, text), see MENTIONS: eight types; a company also by its short name; one row for each
    type, name and start. Without `nested`, those that lie in a longer mention of another type are left out, as a year in the title of
    a regulation. Places need Python: Spark's regular expressions give none. All fixed words are found in one pass by an automaton;
    only open classes have patterns."""
    rules = [(kind, re.compile(p)) for kind, ps in PATTERNS.items() for p in ps]

    def of(text: str, automaton: ahocorasick.Automaton | None) -> Iterator[tuple]:
        seen = set()
        named = ((kind, m.group(1), m.start(), m.end()) for kind, rule in rules for m in rule.finditer(text))
        for kind, value, start, end in itertools.chain(named, _words(automaton, text) if automaton else ()):
            before, behind = NAMES.get(kind, ("", ""))
            names = [before + value + behind]
            if kind == "company" and (short := _short(value)) != value and len(short) >= 2:
                names.append(short)
            for name in names:
                if (kind, name, start) not in seen:
                    seen.add((kind, name, start))
                    yield kind, name, value.replace(",", "") if kind == "amount" else value, start, end

    chosen = iter if nested else lambda found: _outer(list(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _fixed(metrics)
        for batch in batches:
            rows = [(c, *m) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in chosen(of(t, automaton))]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in MENTIONS.split(", ")])

    return chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text").mapInArrow(run, MENTIONS)


def by_type(mention_rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row a key with the distinct names (companies, regulations, products, metrics) or values (others) of each type."""
    shown = F.when(F.col("type").isin("company", "metric", "regulation", "product"), F.col("name")).otherwise(F.col("value"))
    return mention_rows.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("type") == t, shown))).alias(t) for t in (*PATTERNS, "metric")])


# Words that point at documents or roles rather than facts.
POINTERS = r"第[一二两]份文档?|两份文档|两个文档|两份文件|第一份|第二份|下列|以下|上述|该等|募集说明书|本期债券|本期发行|明确指定|明确指出|明确标注|明确提到|发行人名称为|发行人|名称为|受托管理人|主承销商|簿记管理人|联席主承销商"


def key_facts(text: Column) -> Column:
    """Facts of an option in order: numbers, clauses, ratings, company names of six or more characters without leading connectors,
    and CJK runs of 5 to 15 that neither hold nor are held by an earlier fact."""
    plain = F.regexp_replace(text, POINTERS, "")
    numbers = F.filter(extract.found(text, r"[0-9]+(?:[,.0-9]*)\s*(?:%|亿元|万元|千元|元|年|个|条|款|项)?"), lambda n: F.char_length(n) >= 2)
    ratings = extract.found(text, r"(?<![A-Za-z0-9_])(?:A{1,4}|B{1,4})[+-]?(?![A-Za-z0-9_])")
    names = F.filter(F.transform(extract.found(plain, rf"[{CJK}]{{2,20}}(?:股份有限公司|有限公司|集团|公司|股份)"), lambda n: F.regexp_replace(n, "^[的为是和与及]+", "")), lambda n: F.char_length(n) >= 6)
    base = F.concat(numbers, extract.found(text, extract.CLAUSE), ratings, names)
    longer = F.aggregate(extract.found(plain, rf"[{CJK}]{{5,15}}"), base, lambda s, p: F.when(F.exists(s, lambda f: F.contains(f, p) | F.contains(p, f)), s).otherwise(F.concat(s, F.array(p))))
    return F.array_distinct(F.filter(longer, lambda f: (F.char_length(f) >= 2) & ~F.contains(f, F.lit("文档")) & ~F.contains(f, F.lit("文件"))))


def target_documents(option: Column, doc_ids: Column) -> Column:
    """(doc_id, label) that an option is about: the first, the second, both, or all where it names none."""
    first, second = F.regexp_like(option, F.lit(r"第一份|文档\s*一")), F.regexp_like(option, F.lit(r"第二份|文档\s*二"))
    both = F.regexp_like(option, F.lit("两份|两家|两个文档")) | (~first & ~second)
    pick = lambda at, label: F.transform(F.slice(doc_ids, at, 1), lambda d: F.struct(d.alias("doc_id"), F.lit(label).alias("label")))
    none = F.array().cast("array<struct<doc_id: string, label: string>>")
    return F.when(both, F.transform(doc_ids, lambda d: F.struct(d.alias("doc_id"), F.lit("all").alias("label")))).otherwise(F.concat(F.when(first, pick(1, "doc1")).otherwise(none), F.when(second, pick(2, "doc2")).otherwise(none)))


def search_tasks(questions: DataFrame) -> DataFrame:
    """(qid, kind, task, unit) lookups of a question with options: numbers and up to three phrases of each option, organisations of
    options and question, and five keywords of the question; each task once."""
    o = F.array_sort(F.map_values("options"))
    organisation = rf"[{CJK}]{{2,10}}(?:公司|集团|银行|证券|保险|基金|控股|资产)"
    raw = F.flatten(F.transform(o, lambda x: extract.found(x, r"[0-9]{4}年|[0-9]+\.[0-9]+%|[0-9]+(?:\.[0-9]+)?\s*(?:亿|万|元)")))
    row = lambda kind, task, unit=None: F.struct(F.lit(kind).alias("kind"), task.alias("task"), (F.lit(None).cast("string") if unit is None else unit).alias("unit"))
    numbers = F.transform(raw, lambda n: row("number", F.regexp_replace(n, r"\s*[年%亿元万]+$", ""), F.when(F.contains(n, F.lit("年")), "年").when(F.contains(n, F.lit("%")), "%")))
    phrases = F.transform(F.flatten(F.transform(o, lambda x: F.slice(extract.phrases(x, 2, 6), 1, 3))), lambda p: row("phrase", p))
    names = F.transform(F.concat(F.flatten(F.transform(o, lambda x: extract.found(x, organisation))), extract.found(F.col("question"), organisation)), lambda n: row("entity", n))
    keywords = F.transform(F.slice(extract.phrases(F.col("question"), 2, 8), 1, 5), lambda k: row("keyword", k))
    return questions.select("qid", F.explode(F.concat(numbers, phrases, names, keywords)).alias("t")).select("qid", "t.kind", "t.task", "t.unit").where("task != ''").dropDuplicates(["qid", "kind", "task"])
