"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over all training documents. The weights are learned from a bounded sample of them by
follow-the-regularised-leader with elastic-net penalties, so most weights are exactly zero, and a temperature fitted on
a part held back from learning turns scores into probabilities. Whole texts are used throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_batch

DIMENSIONS, NGRAMS = 1 << 15, (1, 2, 3)
#: About so many documents a language, and about so many in all (one a language at least), are learned from, chosen by hash.
SAMPLE, SAMPLE_ALL = 1200, 12_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 3
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    """Counts of the text's character n-grams by hash bucket. Letters are lower-cased; other characters count as a space,
    runs of them as one, and the text has one at either end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters(codes)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes = np.concatenate(([np.uint64(32)], codes, [np.uint64(32)]))
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    out = np.zeros(DIMENSIONS, np.int64)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = (h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + codes[n - 1 :] + np.uint64(n == 1)
        if n in NGRAMS and len(h):
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out += np.bincount((mixed >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64), minlength=DIMENSIONS)
        h = h[:-1] if len(h) and n < max(NGRAMS) else h
    return out


_TABLE: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x30000)]))
    table = _TABLE[0]
    return np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], False)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMENSIONS + 1 rows, the last for the bias
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the text's vector, of length 1."""
        n = counts(text)
        at = np.flatnonzero(n)
        return at, self.values(at, n[at])

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Those of the vector with counts n at the indices."""
        x = (1 + np.log(n)) * self.idf[at]
        size = np.sqrt((x * x).sum())
        return x / size if size else x

    def probabilities(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights[at] + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; `und` and 0 for a null text or one without a letter, or if nothing was learned."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(*self.features(text))
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _ftrl(model: Model, data: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Follow-the-regularised-leader with per-coordinate rates, one document at a time, in a fixed shuffled order."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    random = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for k in random.permutation(len(data)):
            at, x, y = data[k]
            at, x = np.append(at, DIMENSIONS), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    model.weights[:] = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _calibrate(model: Model, data: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not data:
        return
    z = np.array([x @ model.weights[at] + model.weights[-1] for at, x, _ in data])
    y = np.array([k for _, _, k in data])

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        top = s.max(axis=1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    model.temperature = float(np.exp((a + b) / 2))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labels in `lang`, from the rows of (doc_id, text, lang) whose text has a letter and whose lang is not null.

    Document frequencies are of all these rows. Of each language about `sample` rows (fewer if there are many languages, see
    SAMPLE_ALL) are learned from, those with the smallest hash of id and text, 4 of 5 for the weights and the rest for the
    temperature. Repeated rows have one hash, and so are learned from together or not at all; very long texts count like others;
    an empty table gives a model of no language.
    """
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")

    def seen(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += counts(text) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    # A row for each bucket and task at most, then one for each bucket.
    df = rows.select("text").mapInArrow(seen, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {r["bucket"]: r["n"] for r in df}
    frequency = np.zeros(DIMENSIONS)
    for bucket, n in found.items():
        if bucket >= 0:
            frequency[bucket] = n
    total = found.get(-1, 0)
    by_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language, as the model has
    languages = sorted(r["lang"] for r in by_lang)
    model = Model(languages, np.log((1 + total) / (1 + frequency)) + 1, np.zeros((DIMENSIONS + 1, max(1, len(languages)))))
    if not languages:
        return model
    sample = min(sample, max(1, SAMPLE_ALL // len(languages)))
    share = F.create_map(*[x for r in by_lang for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))])
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    def sparse(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text, lang, r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if has_letter(text):
                    n = counts(text)
                    at = np.flatnonzero(n)
                    for column, x in zip(out, (doc, lang, r, at.astype("<u2").tobytes(), n[at].astype("<u4").tobytes()), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "lang", "r", "at", "n"])

    # of each chosen row 6 bytes for every bucket that its text has, whatever its length
    chosen = rows.where(rank < F.get(F.array(share[F.col("lang")]), F.lit(0))).select("doc_id", "text", "lang", rank.alias("r"))
    sampled = chosen.mapInArrow(sparse, "doc_id long, lang string, r double, at binary, n binary").collect()
    learn, check, number = [], [], {w: k for k, w in enumerate(languages)}
    for row in sorted(sampled, key=lambda r: (r["r"], r["doc_id"] or 0, r["lang"], r["at"])):
        at = np.frombuffer(row["at"], "<u2").astype(np.int64)
        x = model.values(at, np.frombuffer(row["n"], "<u4"))
        (check if (len(learn) + len(check)) % 5 == 4 else learn).append((at, x, number[row["lang"]]))
    _ftrl(model, learn)
    _calibrate(model, check)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone.

    A null or empty text, or one without a letter, is `und` with score 0; a very long one is read whole; at a tie the first
    language in order is taken; repeated rows get the same. Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers for each learned language

    def run(batch):
        found = [held.value.predict(t) for t in batch.column(1).to_pylist()]
        return [batch.column(0), [x for x, _ in found], [p for _, p in found]]

    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each_batch(run, *fields), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from: those whose crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
