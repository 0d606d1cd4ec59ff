"""Each operator against a plain version of its contract, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import licence_texts
from lodeseam.llm import bpe, common, decontaminate, language_id, licenses, lines, packing, quality, simhash, substrings, token_store, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    """Nulls, empty and very long texts, repeated rows, one id twice, one text often."""
    rng = random.Random(4)
    words = ["the", "Of", "a", "é", "x1", "###", "Zürich,", "don't", "　", "日本語", "end."]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9, 60, 400])))) for k in range(40)]
    rows += [(None, None), (None, ""), (41, None), (42, ""), (43, " \t\n "), (44, "word " * 30_000), (45, "a\n\nb  c\td\r\ne <|endoftext|> f"), (3, rows[3][1]), (3, "other text")]
    return rows + [(100 + k, rows[5][1]) for k in range(20)]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(df, want, *columns):
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted(want, key=key)


def clash(df, *names):
    """The table with columns of names that operators use themselves."""
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


# 1


def test_license_scan(spark):
    mit = "Copyright (c) 2020 A\nAll rights reserved.\n\n" + licence_texts.MIT.upper().replace("SUBLICENSE", "sub-license").replace(",", " ;")
    bsd = "BSD 3-Clause Licence\n© 2001 B\n" + licence_texts.BSD_2 + licence_texts.BSD_3 + licence_texts.BSD_END
    rows = [(1, mit), (2, bsd), (3, mit + " and more"), (4, None), (None, ""), (5, "prose\n  Released under the MIT licence!\nmore"), (6, "x " * 50_000)]
    got = {(r.doc_id, r.license, tuple(r.notices)) for r in licenses.scan(clash(table(spark, rows), "license", "text_sha256")).collect()}
    assert got == {(1, "MIT", ()), (2, "BSD-3-Clause", ()), (3, None, ()), (4, None, ()), (None, None, ()), (5, None, ("MIT",)), (6, None, ())}
    assert licenses.scan(table(spark, [])).count() == 0


# 2


def test_line_dedup_drops_recurring_templates_but_for_one_document(spark):
    rows = [(k, f"{'abcdefghijklm'[k] * 5} own{'x' * k}\nUser {k} logged in from host{k} at noon today\nshared footer\n\nconn opened by {'abc' * (k + 1)} to port main gate now", "en", "s", 9) for k in range(12)]
    rows += [(50, "shared footer", "en", "s", 13), (50, "shared footer", "en", "s", 13), (None, None, None, None, None), (60, "", "en", "s", 0)]
    got = {r.doc_id: r for r in lines.clean(clash(table(spark, rows, DOCS), "drops", "leaf", "row")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_chars == 9
    for k in range(1, 12):
        assert got[k].text == rows[k][1].split("\n")[0] + "\n" and got[k].n_chars == len(got[k].text)
    assert got[50].text == "" and got[None].text is None and got[60].text == ""
    assert lines.clean(table(spark, rows, DOCS)).count() == len(rows)
    report = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.report(table(spark, rows, DOCS)).collect()}
    assert report[0] == (4, 0) and report[5] == (4, 3) and report[None] == (0, 0)
    assert lines.report(table(spark, [], DOCS)).count() == 0


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("aa bb cc dd".split()) for _ in range(rng.choice([2, 5, 8]))) for _ in range(60)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(6))) for k in range(60)]
    docs = [(d, [ln.split() for ln in t.split("\n")]) for d, t in rows]
    by_line = defaultdict(set)
    for d, ls in docs:
        for w in ls:
            by_line[tuple(w)].add(d)
    leaf = defaultdict(list)
    for w, ds in by_line.items():
        leaf[(len(w), w[:3])].append((w, ds))
    keeper = {}
    for members in leaf.values():
        if sum(len(ds) for _, ds in members) < 10:
            continue
        rare = [(w, ds) for w, ds in members if len(ds) < 10]
        keeper.update({w: min(ds) for w, ds in members if len(ds) >= 10})
        if len(members) > 1:
            n = Counter()
            for w, ds in rare:
                for p, x in enumerate(w):
                    n[p, x] += len(ds)
            groups = defaultdict(list)
            for w, ds in rare:
                t = tuple(x if n[p, x] >= 10 else None for p, x in enumerate(w))
                if sum(x is not None for x in t) >= 0.6 * len(t):
                    groups[t].append((w, ds))
            for ms in groups.values():
                if sum(len(ds) for _, ds in ms) >= 10:
                    keeper.update({w: min(min(ds) for _, ds in ms) for w, _ in ms})
    want = {d: "\n".join(" ".join(w) for w in ls if tuple(w) not in keeper or keeper[tuple(w)] == d) for d, ls in docs}
    assert {r.doc_id: r.text for r in lines.clean(table(spark, rows)).collect()} == want
    assert keeper


# 3


def test_warc_round_trip(spark):
    rng = random.Random(2)
    rows = [(k, f"http://h/{k}", "<p>" + "x" * rng.choice([0, 5, 5, 900]) + "</p>") for k in range(60)]
    rows += [(70, None, None), (71, "u\r\nX: y", ""), (None, "n", "only"), (None, "m", "<p></p>"), (72, "é", "日本" * 50_000), (5, "again", rows[5][2])]
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", 1 << 60), p)
    want = []
    for p, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        response = f is None or p == f
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else f))
    index = warc.write(clash(table(spark, rows, "page_id long, url string, html string"), "sha", "first", "n"))
    same(warc.read(index), want, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(r.url for r in warc.read(index).collect()) == Counter(u for _, u, _ in rows)
    bodies = {r.page_id: r.payload for r in warc.read(index.where("record_type = 'response'")).collect()}
    assert bodies[72] == ("日本" * 50_000).encode()
    # a selection is read by few ranges, of which each stays below the bound
    some = index.where("page_id < 10")
    assert {r.page_id for r in warc.read(some, gap=0, most=600).collect()} == set(range(10))
    assert all(r.size <= 600 or len(r.offsets) == 1 for r in warc.ranges(index, 0, 600).collect())
    assert sum(len(r.offsets) for r in warc.ranges(index).collect()) == len(rows)
    # tasks are as many as the bytes to be read need
    assert warc.ranges(index, task=1 << 30).rdd.getNumPartitions() == 1 and warc.ranges(index, task=1000).rdd.getNumPartitions() > 1
    assert warc.read(warc.write(table(spark, [], "page_id long, url string, html string"))).count() == 0


def test_warc_minimum_payload_and_damage(spark):
    rows = [(1, "a", "same"), (2, "b", "same")]
    index = warc.write(table(spark, rows, "page_id long, url string, html string"), min_payload=5)
    assert {r.record_type for r in index.collect()} == {"response"}
    data = warc.record(1, "u", b"abc", warc.digest(b"abc"), None, False)
    assert warc.parse(data)[2] == b"abc"
    bad = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        warc.parse(bad.compress(zlib.decompress(data, 31).replace(b"abc\r\n", b"abd\r\n")) + bad.flush())


# 4


def test_language_id_held_out(spark):
    rng = random.Random(1)
    words = {"en": "the of and to in that".split(), "fr": "le la les des dans que".split(), "de": "der die und das mit nicht".split()}
    rows = [(k, " ".join(rng.choice(words[w] + ["zz", "qq"]) for _ in range(rng.choice([4, 30, 200]))), w) for k, w in enumerate(rng.choices(list(words), k=400))]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "the of", None), (903, "", None), (None, "und der die", "de"), (904, "the of and " * 20_000, "en")]
    docs = clash(table(spark, rows, "doc_id long, text string, lang string"), "bucket", "n")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out), sample=100)
    assert model.languages == ["de", "en", "fr"] and (model.weights == 0).mean() > 0.9
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in (900, 901, 903)] == ["und"] * 3 and got[902].lang_pred == "en" and got[904].lang_pred == "en"
    held = [(k, w) for k, _, w in rows[:400] if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and sum(got[k].lang_pred == w for k, w in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_ftrl_and_temperature_against_plain_loops():
    """Each update written out by coordinate; the temperature against a fine grid."""
    rng = random.Random(3)
    dims, langs = language_id.DIMENSIONS, 3
    data = [(np.array(sorted(rng.sample(range(50), 6))), np.array([rng.random() for _ in range(6)]), rng.randrange(langs)) for _ in range(30)]
    data = [(at, x + (at == data[0][0][0]) * y, y) for at, x, y in data]
    model = language_id.Model(["a", "b", "c"], np.ones(dims), np.zeros((dims + 1, langs)))
    language_id._ftrl(model, data)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= language_id.L1:
            return 0.0
        return -(z[i, c] - math.copysign(language_id.L1, z[i, c])) / ((language_id.BETA + math.sqrt(n[i, c])) / language_id.ALPHA + language_id.L2)

    order = np.random.default_rng(11)
    for _ in range(language_id.EPOCHS):
        for k in order.permutation(len(data)):
            at, x, y = data[k]
            entries = [*zip(at.tolist(), x.tolist(), strict=True), (dims, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in entries for c in range(langs)}
            s = [sum(v * w[i, c] for i, v in entries) for c in range(langs)]
            p = [math.exp(t) / sum(map(math.exp, s)) for t in s]
            for i, v in entries:
                for c in range(langs):
                    g = v * (p[c] - (c == y))
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / language_id.ALPHA
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    want = np.zeros((dims + 1, langs))
    for i, c in list(z):
        want[i, c] = weight(i, c)
    assert np.allclose(model.weights, want) and np.abs(want).max() > 0.1
    noisy = [(at, x, y if k % 4 else (y + 1) % langs) for k, (at, x, y) in enumerate(data)]
    language_id._calibrate(model, noisy)

    def loss(t):
        return sum(-math.log(language_id.Model(model.languages, model.idf, model.weights, t).probabilities(at, x)[y]) for at, x, y in noisy)

    best = min((math.exp(k / 100) for k in range(-300, 301)), key=loss)
    assert loss(model.temperature) <= loss(best) + 1e-6


def test_every_language_is_learned(spark):
    """Three hundred labels, of a few documents each."""
    rows = [(k, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}{x}" for x in "abc" * 3), f"l{n:03d}") for k, n in enumerate(list(range(300)) * 8)]
    model = language_id.train(table(spark, rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and sum(model.predict(t)[0] == w for _, t, w in rows[:300]) > 240


# 5


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(codes):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(codes))]


def test_simhash_against_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 44] + [(44, "word " * 3000)]
    near = " ".join(f"w{k}" for k in range(500))
    rows += [(200 + k, near + f" extra{k}") for k in range(30)]
    codes = [brute_fingerprint(t) for _, t in rows]
    found = roots(codes)
    ids = defaultdict(list)
    for (d, _), r in zip(rows, found, strict=True):
        ids[r].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    want = [(d, f"{c:016x}", least[r]) for (d, _), c, r in zip(rows, codes, found, strict=True)]
    docs = clash(table(spark, rows), "fp", "root", "n", "least")
    same(simhash.near_duplicates(docs), want, "doc_id", "fingerprint", "component_id")
    kept = [r.doc_id for r in simhash.keep_one(docs.withColumnRenamed("fp", "row")).collect()]
    assert sorted(kept, key=lambda x: (x is None, x or 0)) == sorted(least.values(), key=lambda x: (x is None, x or 0))
    assert simhash.near_duplicates(table(spark, [])).count() == 0 and simhash.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize(("group", "crowd", "top"), [(50, 1000, 19), (20_000, 1000, 19), (20_000, 40, 19), (60, 30, 19), (60, 30, 61)])
def test_simhash_index_with_crowded_keys(spark, monkeypatch, group, crowd, top):
    """Groups of all kinds: one, several, some or all of them dealt anew; bits alike or spread."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(group + crowd)
    codes = rng.integers(0, 1 << top, 1500).astype(np.uint64) << np.uint64(3)
    if top > 40:  # neighbours of half of them, anywhere
        codes = np.r_[codes, codes[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))]
    codes = np.unique(codes)
    ints = [int(c) for c in codes]
    fps = common.save(table(spark, [(int(c),) for c in codes.view(np.int64)], "fp long"), "fps")
    place = {c: i for i, c in enumerate(ints)}
    parent = list(range(len(ints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in simhash.links(fps).collect():
        a, b = sorted((find(place[r.a & 2**64 - 1]), find(place[r.b & 2**64 - 1])))
        parent[b] = a
    assert [find(i) for i in range(len(ints))] == roots(ints)


def test_gray_index_prunes_groups():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 4096).astype(np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex(codes, np.zeros(len(codes), np.int64))
    found = sum(len(q) for q, _ in index.links(codes, np.zeros(len(codes), np.int64), 2))
    assert found == len(codes) and index.compared < 0.4 * len(codes) ** 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    same(common.components(table(spark, edges, "a long, b long")), [(x, find(x)) for x in linked], "node", "root")


def test_join_hot(spark, monkeypatch):
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k is null or k < 5")
    got = common.join_hot(left, right, ["k"], "n").collect()
    tops = {r.k: r.top for r in right.collect()}
    assert len(got) == 4000 and all(r.top == tops.get(r.k) for r in got)
    assert common.join_hot(left, right, ["k"], "n", "inner").count() == left.where("k is null or k < 5").count()


# 6, 8


def encoded(text):
    from tokenizers import Tokenizer

    encoded.t = getattr(encoded, "t", None) or Tokenizer.from_file(bpe.default_path())
    return encoded.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    rng = random.Random(5)
    e = bpe.Encoder(bpe.default_path())
    texts = ["".join(rng.choice("ab'sé1 \n\t#　Z<|>.,\x1c\x00") for _ in range(rng.randrange(25))) for _ in range(4000)] + [" a", "a ", " ", "\n", "a<|endoftext|>b", "x\x00y z"]
    for t, x in zip(texts * 2, e.ids(texts * 2), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == encoded(t), repr(t)


def test_token_store_round_trip(spark):
    rows = odd_rows()
    digest = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    want, at = [], 0
    for d, t in ordered:
        ids = [*encoded(t), 0]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    shards = token_store.write(clash(table(spark, rows), "start", "file"))
    same(token_store.read(shards), want, "doc_id", "start", "n_tokens", "ids_crc32")
    assert token_store.read(token_store.write(table(spark, []))).count() == 0


@pytest.mark.parametrize("width", [1, 7, 8, 15, 16, 17, 31, 32])
def test_blocks(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 777, dtype=np.uint64).astype(np.uint32)
    ids[:20] = np.uint32((1 << 32) - 1)
    assert (token_store.decode_block(token_store.encode_block(ids)) == ids).all()
    assert (token_store.decode_block(token_store.encode_block(ids[:1])) == ids[:1]).all()


def test_store_reads_only_the_blocks_asked_for(tmp_path):
    w = token_store.ShardWriter(str(tmp_path), "s")
    ids = np.arange(50_000, dtype="<u4")
    w.add(1, ids.tobytes())
    w.close()
    r = token_store.ShardReader(w.path)
    assert r.ids(40_000, 40_010).tolist() == list(range(40_000, 40_010)) and r.ids(5, 5).tolist() == []


def test_packing(spark):
    rows = odd_rows()
    got = packing.pack(clash(table(spark, rows), "length", "sequence_id", "offset")).collect()
    want = Counter()
    for d, t in rows:
        ids = [*encoded(t), 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : a + 1024] if k else ids[:first]
            want[d, k, a, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(table(spark, [])).count() == 0
    with_ids = packing.pieces(table(spark, rows[:3]), with_ids=True).first()
    assert zlib.crc32(bytes(with_ids.ids)) == with_ids.ids_crc32


def plain_sum_of_squares(lengths, size, counted):
    """The rule as it stands: of all ways to place a piece the one after which the sum is smallest, the smallest gap at a tie."""
    gaps = []
    for length in lengths:
        ways = sorted({g for g in gaps if g >= length}) + [size]

        def after(gap):
            n = Counter(gaps)
            n[gap] -= gap != size
            n[gap - length] += 1
            return sum(k * k for g, k in n.items() if size > g >= counted)

        best = min(ways, key=lambda g: (after(g), g))
        if best != size:
            gaps.remove(best)
        gaps.append(best - length)
    return gaps


@pytest.mark.parametrize("counted", [1, 4, 16])
def test_fill_follows_the_rule(counted):
    rng = random.Random(counted)
    for top in (3, 10, 31):
        lengths = sorted((rng.randrange(1, top + 1) for _ in range(150)), reverse=True)
        sequences, offsets = packing.fill(lengths, 32, counted)
        used = Counter()
        for n, s, at in zip(lengths, sequences, offsets, strict=True):
            assert at == used[s]
            used[s] += n
        assert sorted(32 - x for x in used.values()) == sorted(plain_sum_of_squares(lengths, 32, counted))


@pytest.mark.parametrize("many", [5000, 60_000])
def test_fill_is_near_the_least(many):
    """Thousands of pieces of each length, too: every one is placed by itself."""
    rng = random.Random(6)
    top = 1023 if many < 10_000 else 20
    lengths = sorted((min(top, max(1, int(rng.lognormvariate(5.5 if top > 100 else 2, 1)))) for _ in range(many)), reverse=True)
    size = 1024 if top > 100 else 64
    used = Counter()
    for n, s in zip(lengths, packing.fill(lengths, size)[0], strict=True):
        used[s] += n
    least = -(-sum(lengths) // size)
    assert max(used.values()) <= size and len(used) <= least * 1.005 + 1 and len(used) <= len(set(packing.fill(lengths, size, 1)[0]))


def test_groups_are_packed_alone(spark):
    rows = [(k if k % 7 else None, f"word{k} " * (k % 50)) for k in range(300)]
    got = packing.pack(table(spark, rows), group=40).collect()
    assert len(got) == 300 and len({r.sequence_id >> 32 for r in got}) == 8
    assert len({(r.sequence_id, r.offset) for r in got}) == 300


# 7


def brute_substrings(rows, window):
    c = Counter()
    for _, t in rows:
        w = (t or "").encode().split()
        c.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if c[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def substring_rows():
    rows = [r for r in odd_rows() if r[0] != 44] + [(44, "word " * 2000)]
    rng = random.Random(9)
    shared = " ".join(f"s{k}" for k in range(90))
    for k in range(60):
        own = [f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(120))]
        cut = rng.randrange(len(own) + 1)
        a, b = sorted(rng.sample(range(91), 2))
        rows.append((300 + k, " ".join([*own[:cut], *shared.split()[a:b], *own[cut:]])))
    return rows


REMOVED = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize(("hot", "window", "phrase"), [(2000, 35, 8), (3, 12, 4)])
def test_substring_dedup_against_brute_force(spark, monkeypatch, hot, window, phrase):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 700)
    monkeypatch.setattr(substrings, "OUT_BYTES", 5000)
    rows = substring_rows()
    same(substrings.report(clash(table(spark, rows), "k1", "runs", "at"), window, phrase), brute_substrings(rows, window), *REMOVED)
    assert substrings.report(table(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [2000, 3])
def test_substring_dedup_with_colliding_hashes(spark, monkeypatch, hot):
    """All words have one of three hashes, so most phrases collide: only words tell windows apart."""

    def colliding(text):
        return np.array([len(w) % 3 for w in text.split()], np.uint64)

    monkeypatch.setattr(substrings, "HOT", hot)
    rows = [(d, t) for d, t in substring_rows() if d != 44]
    same(substrings.report(table(spark, rows), 12, 4, hashes=colliding), brute_substrings(rows, 12), *REMOVED)


def test_substring_places_come_from_the_automata(spark):
    rows = substring_rows()
    want = sum(n for _, _, n, _ in brute_substrings(rows, 12))

    def blind(passages, stretches):
        return [[] for _ in stretches]

    def of_one_word_less(passages, stretches):
        return [[(a, n - 1) for a, n in places] for places in substrings.locate(passages, stretches)]

    removed = lambda **k: substrings.report(table(spark, rows), 12, 4, **k).agg(F.sum("n_removed")).first()[0]
    assert removed() == want > 0 and removed(stream=blind) == 0 and 0 < removed(stream=of_one_word_less) < want


def test_automaton_finds_passages_in_stretches_they_do_not_come_from():
    found = list(substrings.locate([b"a b c", b"c d e f", b"x"], [b"z a b c d e f", b"c d e", b"x x a b", b"", b"b c a b c"]))
    assert found == [[(1, 6)], [], [(0, 2)], [], [(2, 3)]]
    assert list(substrings.locate([], [b"a b"])) == [[]]


def test_substring_kept_text(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    got = {r.doc_id: r.kept for r in substrings.remove(table(spark, [(1, f"a {passage}\tb"), (2, passage)])).collect()}
    assert got == {1: "a b", 2: ""}


# 9


def test_quality_against_brute_force(spark):
    rng = random.Random(7)
    rows = odd_rows() + [(500 + k, "\n".join(" ".join(rng.choice("the of and to x y ## zz".split()) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(20)))) for k in range(60)]
    rows += [(600, " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} the" if k % 9 == 0 else f"text{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)))]
    want = []
    for d, t in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls))
        stop = sum(x in quality.STOP_WORDS for x in w)
        n = max(1, len(w))
        kept = not base and len(w) <= 1_000_000 and 2 <= chars / n <= 14 and symbols / n <= 0.1 and stop / n >= 0.02 and dup / max(1, len(ls)) <= 0.5
        want.append((d, len(w), chars, symbols, dup, len(inside), base, kept))
    docs = clash(table(spark, rows), "n_words", "kept", "m")
    same(quality.score(docs), want, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert quality.keep(docs).count() == sum(x[-1] for x in want) and quality.keep(docs).columns == docs.columns
    assert any(x[-1] for x in want) and quality.score(table(spark, [])).count() == 0


# 10


def brute_hits(docs, items, window=10):
    cut = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (i := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= i
        found.discard(None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [30, 200_000])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.build, "__defaults__", (decontaminate.WINDOW, block))
    rng = random.Random(11)
    words = "a b c D é".split()
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 9, 10, 14, 30])))) for k in range(25) if k != 3]
    items = [(i, t) for i, t in items if len(t.split()) >= 4] + [(100, None), (101, ""), (102, "..."), (None, "no id but eleven words in all of this item here"), (None, "n n n"), (5, items[7][1])]
    docs = [(k, rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 200])))) for k in range(60)]
    docs += [(60 + k, "zz " + t + ", yy") for k, (_, t) in enumerate(items[:10])] + [(None, None), (90, ""), (91, items[0][1]), (91, items[0][1]), (92, "x no id but eleven words in all of this item here n n n")]
    monkeypatch.setattr(decontaminate, "HELD", 400)
    bench = table(spark, items, "item_id long, text string")
    same(decontaminate.scan(clash(table(spark, docs), "items", "n_hit"), bench), brute_hits(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert decontaminate.scan(table(spark, docs), table(spark, [], "item_id long, text string")).where("contaminated").count() == 0
    assert decontaminate.scan(table(spark, []), bench).count() == 0


def test_clean_cuts_spans_and_drops_documents(spark):
    passage = " ".join(f"q{k}" for k in range(12))
    clean_text = "nothing to see here at all"
    rows = [(1, "Before, " + "own " * 30 + passage.upper() + "! After.", "en", "s", 1), (2, passage + " x", "en", "s", 2), (3, clean_text, "en", "s", 3), (4, None, None, None, None)]
    got = {r.doc_id: r for r in decontaminate.clean(table(spark, rows, DOCS), table(spark, [(1, passage)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4} and got[3].text == clean_text and got[3].n_chars == 3 and got[4].text is None
    assert got[1].text == "Before, " + "own " * 30 + "! After." and got[1].n_chars == len(got[1].text)
