"""The whole pipeline against plain Python, stage by stage on the rows that the stage before it keeps."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_operators import brute_fingerprint, crc, encoded, roots

from lodeseam.llm import quality

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in GAP.split(text) if w]


def good(text):
    w, lines = words_of(text), [x for x in text.split("\n") if words_of(x)]
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
    chars, symbols, stop = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in quality.STOP_WORDS for x in w)
    return (
        len(w) >= 50 and 2 * len(again) <= len(w) and len(w) <= 1_000_000 and 2 * len(w) <= chars <= 14 * len(w)
        and symbols <= 0.1 * len(w) and stop >= 0.02 * len(w) and len(lines) - len(set(lines)) <= 0.5 * len(lines)
    )


def without_templates(rows, least=10):
    shape = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in words_of(line))
    docs = {d: [(x, shape(x)) for x in t.split("\n")] for d, t in rows}
    having, leaf, keeper = defaultdict(set), defaultdict(list), {}
    for d, lines in docs.items():
        for _, s in lines:
            if s:
                having[s].add(d)
    for s, ds in having.items():
        leaf[len(s), s[:3]].append((s, ds))
    for members in leaf.values():
        n, groups = defaultdict(set), defaultdict(lambda: ([], set()))
        for s, ds in members:
            for p, x in enumerate(s):
                n[p, x] |= ds
        for s, ds in members:
            t = tuple(x if len(n[p, x]) >= least else None for p, x in enumerate(s))
            if sum(x is not None for x in t) >= 0.6 * len(t):
                groups[t][0].append(s)
                groups[t][1].update(ds)
        recurring = [t for t, (_, ds) in groups.items() if len(ds) >= least]
        for t, (shapes, ds) in groups.items():
            within = [groups[u][1] for u in recurring if all(x is None or x == y for x, y in zip(t, u, strict=True))]
            if within:
                keeper.update(dict.fromkeys(shapes, min(ds.union(*within))))
    return [(d, "\n".join(x for x, s in lines if not s or keeper.get(s, d) == d)) for d, lines in docs.items()]


def one_of_each(rows):
    rows = sorted(rows)
    group = roots([brute_fingerprint(t) for _, t in rows])
    return [r for k, r in enumerate(rows) if group[k] == k]


def without_items(rows, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    windows = set()
    for t in items:
        w = cut.findall(low(t))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} - {()}
    out = []
    for d, t in rows:
        at = [(m.start(), m.end(), m[0]) for m in cut.finditer(low(t))]
        w, hit = [x for _, _, x in at], set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if len(hit) <= 0.5 * len(w):
            kept, last = [], 0
            for k in sorted(hit):
                if k - 1 not in hit:
                    kept.append(t[last : at[k][0]])
                last = at[k][1]
            out.append((d, "".join([*kept, t[last:]])))
    return out


def test_pipeline_against_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = [rows]
    for step in (lambda x: [r for r in x if good(r[1])], without_templates, one_of_each, lambda x: without_items(x, items)):
        steps.append(step(steps[-1]))
    assert all(a != b for a, b in zip(steps, steps[1:], strict=False))  # every stage has something to do
    want = Counter()
    for d, t in steps[-1]:
        ids = [*encoded(t), 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : a + 1024] if k else ids[:first]
            want[d, k, a, len(part), crc(part)] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(used) <= 1.05 * sum(r.length for r in got) / 1024 + 1
