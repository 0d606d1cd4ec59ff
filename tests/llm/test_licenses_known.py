"""Long licences, comment marks and further digests."""

import hashlib
import os
import textwrap

import duckdb
import licence_texts
import pytest

from lodeseam.llm import licenses, queries

COMMON = "/usr/share/common-licenses"


def licence_of(spark, texts, further=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license for r in licenses.scan(rows, further).orderBy("doc_id").collect()]


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence texts on this machine")
def test_long_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"{COMMON}/{f}", encoding="utf-8").read() for f in names]
    assert licence_of(spark, texts) == list(names.values())
    apache = texts[0][: texts[0].index("   APPENDIX")]
    assert licence_of(spark, [apache, "\n".join("# " + x for x in texts[0].split("\n")), texts[0] + " more"]) == ["Apache-2.0", "Apache-2.0", None]


SHORT = {
    "MIT": "MIT License\n" + licence_texts.MIT, "BSD-2-Clause": licence_texts.BSD_2 + licence_texts.BSD_END, "BSD-3-Clause": licence_texts.BSD_2 + licence_texts.BSD_3 + licence_texts.BSD_END,
    "ISC": licence_texts.ISC + licence_texts.ISC_END, "0BSD": licence_texts.ZERO_BSD + licence_texts.ISC_END, "Zlib": licence_texts.ZLIB,
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "; ", "-- ", "% "])
@pytest.mark.parametrize("width", [40, 72])
def test_licences_behind_comment_marks_and_wrapped(spark, mark, width):
    def wrapped(text):
        lines = [x for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""])]
        return "\n".join(mark + x for x in ["Copyright 2020 X", "(c) 2021 Y", "Copyright (C) Z, Inc.", "copyright by W", "All rights reserved.", "", *lines])

    texts = [wrapped(t) for t in SHORT.values()]
    assert licence_of(spark, texts) == list(SHORT)
    assert licence_of(spark, [f"/*\r\n{t.upper()}\r\n*/" for t in texts]) == list(SHORT)
    assert licence_of(spark, [t + "\nnot" for t in texts]) == [None] * len(SHORT)


def test_own_words_on_copyright_stay(spark):
    rows = [(0, "Copyright holders agree"), (1, "agree"), (2, "Copyright 2020 A\nagree"), (3, "copyright owners  AGREE!")]
    got = [r.text_sha256 for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] != got[1] == got[2] and got[0] == hashlib.sha256(b"copyright holders agree").hexdigest()
    assert got[3] == hashlib.sha256(b"copyright owners agree").hexdigest()


def test_further_digests(spark):
    own = "The Licence of Ours\n\nDo as you like."
    digest = hashlib.sha256(b"the license of ours do as you like").hexdigest()
    known = licenses.DIGESTS[0]
    further = spark.createDataFrame([(digest, "Ours-1.0"), (digest, "Zz"), (known[1], "Not this")], "text_sha256 string, license string")
    assert licence_of(spark, [own, licence_texts.MIT, "prose", None], further) == ["Ours-1.0", "MIT", None, None]
    assert licence_of(spark, [own]) == [None]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), further).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    odd = ["Copyright 2019 A\n" + licence_texts.MIT, "# Released under the MIT License\nfavour\r\n\r\n  SPDX-License-Identifier: GPL-3.0-only", None, "", "...", "http owner owner percent", "naïve Ünïcode—text\u2028copyright 2020 x"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(odd * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op1_license_scan", "op9_quality_rules"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = duck.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
