"""Metric and value pairs against a plain version with regular expressions of their own."""

import random
import re

from lodeseam.functions.vocab import ENTITY_METRICS
from lodeseam.operators import evalset


def plain(text, metrics, entities, noise):
    words = "|".join(re.escape(m) for m in sorted(metrics, key=len, reverse=True))
    sentences = [re.sub(r"\s+", " ", re.sub(r"\s*[-:]{3,}\s*", " ", text.replace("|", " ")))] if "|" in text else re.split(r"[。；;\n]", text)
    out = []
    for s in sentences:
        for m in re.finditer(rf"([0-9][0-9,]*(?:\.[0-9]+)?)\s*({evalset.UNIT})?", s):
            core, unit = m.group(1), m.group(2) or ""
            if len(core.replace(",", "").replace(".", "")) < 2 or (re.fullmatch(r"(?:19|20)\d{2}", core) and unit in ("", "年")):
                continue
            before = s[: m.start()].rstrip()
            found = re.search(rf"({words})\s*(?:共计|分别为?|约为?|为|是|达到?|不超过|[:：])*\s*$", before)
            run = re.search(r"([一-鿿（）()]{2,12})$", before)
            metric = found.group(1) if found else run.group(1) if run and not run.group(1).endswith("的") and not any(n in run.group(1) for n in noise) else ""
            if metric:
                out.append((len(out), metric, metric in metrics, m.group(0).strip(), core, unit, s.strip(), next((e for e in entities if e in s), "")))
    return out


def test_metric_pairs(spark):
    rng = random.Random(2)
    parts = ["营业收入", "每10股", "派息", "为", "约为", "达到", "的", "增长", "（注）", "目录", "2024年", "2024", "12.5", "1,234.50", "7", "99", " ", "万元", "亿元", "%", "家", "，", "。", "；", "\n", "甲公司", "abc", ":", "---"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 12, 60]))) for _ in range(300)]
    texts += ["|指标|2024|\n|---|---|\n|净利润|12.5万元|", "每10股5元", "净利润分别为 12 亿元和15亿元", None, "", "净利润:1,234 "]
    texts += ["|" + t for t in texts[:80]]
    rows = [(str(k), "d", "x", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, domain string, text string")
    names = ("pos", "metric", "is_vocab", "num", "num_core", "unit", "sentence", "entity")
    got = {}
    for r in evalset.metric_pairs(df, entities=("乙公司", "甲公司"), noise=("目录",)).orderBy("chunk_id", "pos").collect():
        got.setdefault(r.chunk_id, []).append(tuple(r[n] for n in names))
    want = {k: p for k, _, _, t in rows if (p := plain(t or "", ENTITY_METRICS, ("乙公司", "甲公司"), ("目录",)))}
    assert got == want and len(want) > 150
