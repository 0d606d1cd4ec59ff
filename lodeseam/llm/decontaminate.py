"""Benchmark decontamination with a generalised suffix automaton over words.

Items and documents are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. The automaton
of all items holds every word sequence in any item; a document is streamed through it once, keeping the length of the
longest suffix read so far that occurs in an item. Where that reaches `window` words, the last `window` words are a
window of some item; items shorter than that count only as a whole.
"""

from __future__ import annotations

import hashlib
import pickle

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, texts
from .storage import create, open_at

WINDOW = 10
#: Words of items in one automaton (some 1 kB each at most); with more, documents are streamed through several.
BLOCK_WORDS = 200_000
#: Bytes of documents that a task holds while it goes through several automata.
HELD = 32 << 20

_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences. State 0 is the empty sequence."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int | None]] = []  # (state, item) at each position of a long item
        wholes: list[tuple[int, int, int | None]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                if len(words) >= window:
                    ends.append((last, item))
            if 0 < len(words) < window:
                wholes.append((last, len(words), item))
        # Items of a state's longest sequence are those of all states below it in the tree of links. They are read only at the
        # states where `window` words are first reached, so each item is noted there alone.
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        self.head = [0] * len(self.next)
        for s in reversed(order):
            if self.length[s] >= window:
                up = self.link[s]
                self.head[s] = self.head[up] if self.length[up] >= window else s
        own: dict[int, set[int | None]] = {}
        for state, item in ends:
            if self.head[state]:
                own.setdefault(self.head[state], set()).add(item)
        self.items = {s: frozenset(x) for s, x in own.items()}
        # short items that end where a state is reached: (words, item) at it and at the states its links lead to
        here: dict[int, list[tuple[int, int | None]]] = {}
        for state, n, item in wholes:
            here.setdefault(state, []).append((n, item))
        self.short: list[tuple[tuple[int, int | None], ...]] = [()] * len(self.next)
        for s in reversed(order):
            self.short[s] = self.short[self.link[s]] + tuple(here.get(s, ()))
        self.any_short = bool(wholes)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Runs [first, end) of words inside occurrences of windows, merged and ascending, and the items whose windows occur."""
        nxt, link, length, window, short, any_short, head, items = self.next, self.link, self.length, self.window, self.short, self.any_short, self.head, self.items
        runs: list[list[int]] = []
        found: set[int | None] = set()
        state, n, root = 0, 0, nxt[0]
        for k, w in enumerate(words):
            if state == 0:  # mostly
                to = root.get(w)
                if to is None:
                    continue
                state, n = to, 1
            else:
                to = nxt[state].get(w)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = nxt[state].get(w)
                if to is None:
                    continue
                state, n = to, n + 1
            longest = 0
            if n >= window:
                longest = window
                found |= items[head[state]]
            if any_short:
                for m, item in short[state]:
                    if m <= n:
                        found.add(item)
                        longest = max(longest, m)
            if longest:
                first = k + 1 - longest
                while runs and runs[-1][0] >= first:
                    runs.pop()
                if runs and runs[-1][1] >= first:
                    runs[-1][1] = k + 1
                else:
                    runs.append([first, k + 1])
        return [(a, b) for a, b in runs], found


def build(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Write the automata of all items to the shared folder; returns their paths.

    Items are dealt to tasks by ranges of item_id, as many as their bytes need, and each task writes an automaton for every
    `block_words` words of its items (or one item), so that each has a bounded size. Null and empty items have no words.
    """
    spark = benchmark.sparkSession
    folder = new_folder(spark, "automata")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(batches):
        block: list[tuple[int | None, list[bytes]]] = []
        n = made = 0

        def close():
            path, out = create(folder, f"automaton-{TaskContext.get().partitionId():06d}-{made:04d}")
            out.write(pickle.dumps(Automaton(block, window)))
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                words = words_of(text)
                if block and n + len(words) > block_words:
                    yield close()
                    block, n, made = [], 0, made + 1
                if words:
                    block.append((item, words))
                    n += len(words)
        if block:
            yield close()

    # a word has some six bytes with its space; the last key lets one item_id with very many rows be dealt out
    dealt = items.repartitionByRange(max(1, -(-total // (6 * block_words))), "item_id", F.monotonically_increasing_id())
    # a row for each block; its automaton is whole in the shared folder by then
    return sorted(r.path for r in dealt.mapInArrow(write, "path string").collect())


_LOADED: dict[str, Automaton] = {}


def _load(path: str) -> Automaton:
    """One automaton is kept in memory, and so used again where it is the only one."""
    if path not in _LOADED:
        _LOADED.clear()
        with open_at(path) as f:
            _LOADED[path] = pickle.loads(f.read())
    return _LOADED[path]


def _scan_all(paths: list[str], docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int | None]]]:
    out = [([], set()) for _ in docs]
    for path in paths:
        automaton = _load(path)
        for k, words in enumerate(docs):
            runs, items = automaton.scan(words)
            if items:
                out[k] = (runs if not out[k][0] else merge(out[k][0] + runs), out[k][1] | items)
    return out


def _held(batches, column: int | str, paths: list[str]):
    """Batches put together until they have HELD bytes of text, so that of several automata each is loaded once for that
    much text; a single automaton stays loaded."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
            if len(paths) < 2 or size >= HELD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (array<long>).

    A null or empty text has no words; a very long one is streamed like others. Repeated rows and rows of equal or null
    doc_id are judged alone, equal items count as one, and there are no ties, as all items with an occurring window count.
    An item whose id is null hits words like any other, but has no id to be listed or counted by. Other columns are
    ignored, whatever their names; an empty table of documents gives no rows, one of items no hits.
    """
    paths = build(benchmark, window)

    def run(batches):
        for batch in _held(batches, 1, paths):
            docs = [words_of(t) for t in texts(batch)]
            found = _scan_all(paths, docs)
            hit = [sum(b - a for a, b in runs) for runs, _ in found]
            items = [sorted(x - {None}, key=str) for _, x in found]
            columns = [batch.column(0), [len(d) for d in docs], hit, [len(x) for x in items], [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in items], [h > 0 for h in hit], items]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.int64()))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>")


def _positions(text: bytes) -> list[tuple[int, int]]:
    """Byte range of every word."""
    folded = text.translate(_FOLD)
    out, at = [], 0
    for w in folded.split():
        at = folded.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """`docs` without benchmark passages, all columns kept. From a document with at most `max_coverage` of its words hit,
    the hit spans are cut out, from the first to the last hit word of each; other documents go. Clean ones stay as they are;
    n_chars, if there, follows the text. Null and empty texts stay as they were, repeated rows and null or equal doc_ids are
    judged alone, very long texts like others, and an empty table gives no rows."""
    paths = build(benchmark, window)
    names = docs.columns
    if "text" not in names:
        raise ValueError("docs needs a text column")
    place = names.index("text")

    def run(batches):
        for batch in _held(batches, place, paths):
            at = place
            kept = batch.column(at).to_pylist()
            raw = [t.encode() if t else b"" for t in kept]
            found = _scan_all(paths, [words_of(t) for t in raw])
            stay = []
            for k, (runs, _) in enumerate(found):
                if runs:
                    where = _positions(raw[k])
                    stay.append(sum(b - a for a, b in runs) <= max_coverage * len(where))
                    if stay[-1]:
                        out, last = [], 0
                        for a, b in runs:
                            out.append(raw[k][last : where[a][0]])
                            last = where[b - 1][1]
                        kept[k] = b"".join([*out, raw[k][last:]]).decode()
                else:
                    stay.append(True)
            batch = batch.set_column(at, "text", pa.array(kept, pa.string()))
            if "n_chars" in names:
                n = names.index("n_chars")
                kind = batch.schema.field(n).type
                batch = batch.set_column(n, "n_chars", pa.array([old if not runs or t is None else len(t) for old, t, (runs, _) in zip(batch.column(n).to_pylist(), kept, found, strict=True)], kind))
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
