"""DuckDB SQL of words, their counts and BM25 scores, which several queries share."""

from __future__ import annotations

_WORD = "[a-zÀ-ɏ]+|[0-9]+(?:\\.[0-9]+)?"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g')"
_TOKENS = "regexp_extract_all(" + _PLAIN + f", '{_WORD}')"
_TF = f"tok AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), tf AS (SELECT chunk_id, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
_BM25 = f"""{_TF},
len AS (SELECT chunk_id, sum(tf) AS n FROM tf GROUP BY 1), st AS (SELECT count(*) AS nn, avg(n) AS mean FROM len),
raw AS (SELECT term, count(*) AS df, ln(any_value(nn) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT CAST(item_id AS VARCHAR) AS qid, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, tf.chunk_id, any_value(tf.doc_id) AS doc_id, sum(times * idf * tf * 2.8 / (tf + 1.8 * (0.4 + 0.6 * n / mean))) AS raw_score
      FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN len ON len.chunk_id = tf.chunk_id CROSS JOIN st GROUP BY 1, 2),
scored AS (SELECT qid, doc_id, chunk_id, round(raw_score, 6) AS score FROM s),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_id) AS rank FROM scored)"""
