"""Nearest chunks by cosine through an index of cells, with an exact way.

Vectors are scaled to length one, so that the largest cosine is the smallest distance. build() makes cells around centroids and
writes each vector in the cell it is nearest to, with the cell's radius, the largest distance to its centroid. search() reads the
cells nearest to a query; exact() then also reads every cell that, by its radius and the triangle inequality, may hold a vector
nearer than the k-th found so far, and no other. probes_for() finds how many cells a wanted recall takes.

Centroids are fitted on a bounded sample (FIT rows, by hash of the id); every vector is indexed. A cell with over PART vectors is
split by hash, so a cell that holds a third of all vectors is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.text import let
from .sizes import MOST, size_of
from .steps import cut, spread

#: Rows that centroids are fitted on at most, rounds of fitting, vectors of a part of a cell, cells at most; products of a step of by_blocks().
FIT, ROUNDS, PART, CELLS, PRODUCTS = 20_000, 6, 20_000, 4096, 1 << 22


class Index(NamedTuple):
    vectors: DataFrame  # cell, part, vec_id, unit[, scope]
    cells: DataFrame  # cell, center, radius, n, parts
    scope: str | None
    k_cells: int


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    flat = column.cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(vector: Column) -> Column:
    """The vector at length one as doubles; null for null, for one with a null or non-finite entry, and for zero."""

    def scaled(whole: Column, size: Column) -> Column:
        fit = ~F.exists(whole, lambda x: x.isNull() | F.isnan(x)) & (size > 0) & (size < float("inf"))
        return F.when(fit, F.transform(whole, lambda x: x / size))

    # the length once for a vector, not for each of its entries
    return let(F.transform(vector, lambda x: x.cast("double")), lambda w: let(F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)), lambda n: scaled(w, n)))


def _units(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*names, unit(F.col("embedding")).alias("unit")).where("unit is not null")


def _fit(sample: DataFrame, k: int, rounds: int) -> np.ndarray:
    """Centroids of length one, by rounds of distributed assignment: tasks add up their rows by cell, the driver sees sums only."""
    first = sample.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(k).select("unit").collect()  # k rows
    centers = np.array([r.unit for r in first])
    for _ in range(rounds):

        def run(batches, centers=centers):
            total = np.zeros((len(centers), centers.shape[1] + 1))
            for batch in batches:
                x = _matrix(batch.column(0))
                if len(x):
                    np.add.at(total, _cell_of(x, centers), np.c_[x, np.ones(len(x))])
            full = np.flatnonzero(total[:, -1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[full].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), lists], names=["cell", "total"])

        parts = sample.select("unit").mapInArrow(run, "cell int, total array<double>").collect()  # the sample is bounded, and so are its tasks
        total = np.zeros((len(centers), centers.shape[1] + 1))
        for r in parts:
            total[r.cell] += r.total
        size = np.linalg.norm(total[:, :-1], axis=1)
        live = size > 1e-12
        centers[live] = total[live, :-1] / size[live, None]
    return np.unique(centers, axis=0)


def _cell_of(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    step = max(1, PRODUCTS // len(centers))
    return np.concatenate([(x[at : at + step] @ centers.T).argmax(axis=1) for at in range(0, len(x), step)])


def _placed(rows: DataFrame, centers: np.ndarray, names: list[str]) -> DataFrame:
    """Each row with its nearest cell and the distance to it."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("unit"))
            if len(x):
                cell = _cell_of(x, centers)
                apart = np.linalg.norm(x - centers[cell], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(apart)], names=[*names, "unit", "cell", "distance"])

    return rows.select(*names, "unit").mapInArrow(run, f"{_kinds(rows, names)}, unit array<double>, cell int, distance double")


def _with_cells(rows: DataFrame, ids: np.ndarray, centers: np.ndarray, most: int, names: list[str]) -> DataFrame:
    """Each row with its `most` nearest cells."""
    many = min(most, len(centers))
    step = max(1, PRODUCTS // len(centers))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("unit"))
            for at in range(0, len(x), step):
                cells = ids[_first_k(x[at : at + step] @ centers.T, many)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * many), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, step).columns, lists], names=[*names, "unit", "cells"])

    return rows.select(*names, "unit").mapInArrow(run, f"{_kinds(rows, names)}, unit array<double>, cells array<int>")


def _kinds(rows: DataFrame, names: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def build(vectors: DataFrame, cells: int | None = None, scope: str | None = None, rounds: int = ROUNDS) -> Index:
    """An index over `vectors` (vec_id, embedding[, scope]), all of one length. Rows without a direction (null or zero vectors, null or
    non-finite entries) are in no cell, as they have no cosine. An empty table gives an index without cells."""
    names = ["vec_id", *([scope] if scope else [])]
    rows = cut(_units(spread(vectors.select(*names, "embedding"), "vec_id"), *names))
    n = rows.count()
    k = cells or int(min(CELLS, max(1, round(n**0.5))))
    rate = min(1.0, FIT / max(n, 1))
    sample = cut(rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)) if rate < 1 else rows
    centers = _fit(sample, k, rounds) if n else np.zeros((0, 0))
    placed = cut(_placed(rows, centers, names)) if n else rows.withColumn("cell", F.lit(0)).withColumn("distance", F.lit(0.0))
    stats = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    told = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centers.tolist())], "cell int, center array<double>")
    held = cut(stats.join(F.broadcast(told), "cell").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))  # CELLS rows at most
    dealt = placed.join(F.broadcast(held.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    return Index(cut(spread(dealt.select("cell", "part", *names, "unit"), "cell", "part").sortWithinPartitions("cell", "part")), held, scope, len(centers))


class _Nearest:
    """The k nearest that a task has found so far for each query of a block, by similarity and id."""

    def __init__(self, asked: np.ndarray, k: int, digits: int | None, kth: np.ndarray | None):
        self.asked, self.k, self.digits = asked, k, digits
        self.kth = np.full(len(asked), -np.inf) if kth is None else kth.copy()
        self.slack = 1e-9 + (10.0**-digits if digits is not None else 0.0)
        self.met, self.waiting, self.step = [], 0, max(1, len(asked))

    def rounded(self, near: np.ndarray) -> np.ndarray:
        return near if self.digits is None else np.round(near, self.digits)

    def reach(self) -> np.ndarray:
        """How far a vector may be that is as near as the k-th, with a margin for rounding."""
        return np.sqrt(np.maximum(2 - 2 * (self.kth - self.slack), 0)) + 1e-7

    def add(self, which: np.ndarray, vectors: np.ndarray, ids: pa.Array) -> None:
        """Holds vectors, in order of their ids, against some of the queries, PRODUCTS at a time."""
        step = max(1, PRODUCTS // len(vectors))
        self.step = min(self.step, step)
        for at in range(0, len(which), step):
            q = which[at : at + step]
            near = self.asked[q] @ vectors.T
            row, place = np.nonzero(near >= (self.kth[q] - self.slack)[:, None])
            if len(row) > 4 * self.k * len(q):  # no k-th is known yet, or many are as near
                first = _first_k(self.rounded(near), self.k)
                row, place = np.repeat(np.arange(len(q)), first.shape[1]), first.ravel()
            self.met.append(pa.table({"query": q[row], "vec_id": ids.take(pa.array(place)), "similarity": self.rounded(near[row, place])}))
            self.waiting += len(row)
        if self.waiting >= max(1 << 12, len(self.asked) * self.k):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        found = pa.concat_tables(self.met)
        found = found.take(pc.sort_indices(found, sort_keys=[("query", "ascending"), ("similarity", "descending"), ("vec_id", "ascending")], null_placement="at_start"))
        q, near = found.column("query").to_numpy(), found.column("similarity").to_numpy()
        nth = np.arange(len(q)) - np.searchsorted(q, q, "left")
        last = nth == self.k - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], near[last])
        self.met, self.waiting = [found.filter(pa.array(nth < self.k)).combine_chunks()], 0

    def rows(self, qids: pa.Array) -> Iterator[pa.RecordBatch]:
        self.settle()
        for found in self.met:
            q = found.column("query").to_numpy()
            for at in range(0, len(self.asked), self.step):
                a, b = np.searchsorted(q, [at, at + self.step])
                if b > a:
                    some = found.slice(a, b - a).combine_chunks()
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q[a:b])), *(some.column(c).combine_chunks() for c in ("vec_id", "similarity"))], names=["qid", "vec_id", "similarity"])


def _scan(rows: DataFrame, asked: DataFrame, k: int, digits: int | None, scope: str | None = None, cells: dict[int, tuple[np.ndarray, float]] | None = None) -> DataFrame | None:
    """(qid, vec_id, similarity) with the k nearest of `rows` (vec_id, unit[, scope][, cell]) for each of `asked`, a written table (qid,
    unit[, scope][, cells or kth]); None without queries. Queries go to all tasks in blocks of a checked size, as a matrix that each task
    multiplies with its vectors; it passes on k rows a query. A cell is read for the queries that name it, or that, by its center and radius in
    `cells`, have room there for a vector as near as their k-th."""
    blocks, out = max(1, -(-size_of(asked) // MOST)), None
    kinds = f"{_kinds(asked, ['qid'])}, {_kinds(rows, ['vec_id'])}, similarity double"
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow().combine_chunks()  # MOST bytes
        if held.num_rows:
            part = rows.mapInArrow(_scanner(held, k, digits, scope, cells), kinds)
            out = part if out is None else out.unionByName(part)
    return out


def _scanner(held: pa.Table, k: int, digits: int | None, scope: str | None, cells: dict[int, tuple[np.ndarray, float]] | None):
    qids, asked, everyone = held.column("qid").combine_chunks(), _matrix(held.column("unit").combine_chunks()), np.arange(held.num_rows)
    kth = pc.fill_null(held.column("kth"), -np.inf).to_numpy() if "kth" in held.column_names else None
    named, scopes = {}, None
    if "cells" in held.column_names:
        lists = held.column("cells").combine_chunks()
        cell, query = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
        order = np.argsort(cell, kind="stable")
        ids, starts = np.unique(cell[order], return_index=True)
        named = dict(zip(ids.tolist(), np.split(query[order], starts[1:]), strict=True))
    if scope:
        scopes = pc.unique(held.column(scope).combine_chunks()).drop_null()
        of = pc.fill_null(pc.index_in(held.column(scope).combine_chunks(), value_set=scopes), -1).to_numpy()

    def in_cells(batch: pa.RecordBatch, best: _Nearest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and rows of the batch that meet."""
        if "cell" not in batch.schema.names:
            yield everyone, np.arange(batch.num_rows)
            return
        cell = batch.column("cell").to_numpy()
        for c in np.unique(cell).tolist():
            if cells is None:
                which = named.get(c, everyone[:0])
            else:
                center, radius = cells[c]
                apart = np.sqrt(np.maximum(1 + center @ center - 2 * (asked @ center), 0))
                which = np.flatnonzero(apart - radius <= best.reach())
            if len(which):
                yield which, np.flatnonzero(cell == c)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(asked, k, digits, kth)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch.column("vec_id"), null_placement="at_start"))
            x, ids = _matrix(batch.column("unit")), batch.column("vec_id")
            code = pc.fill_null(pc.index_in(batch.column(scope), value_set=scopes), -1).to_numpy() if scope else None
            for which, some in in_cells(batch, best):
                if not scope:
                    best.add(which, x[some], ids.take(pa.array(some)))
                    continue
                for s in np.unique(code[some]).tolist():
                    mine, theirs = some[code[some] == s], which[of[which] == s]
                    if s >= 0 and len(theirs):
                        best.add(theirs, x[mine], ids.take(pa.array(mine)))
        yield from best.rows(qids)

    return run


def _best(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("vec_rank", F.row_number().over(w)).where(F.col("vec_rank") <= k)


def _queries(queries: DataFrame, vectors: DataFrame, scope: str | None) -> DataFrame:
    """(qid, unit[, scope]) of queries, scopes as the vectors have them."""
    q = queries.withColumn(scope, F.col(scope).cast(vectors.schema[scope].dataType)) if scope else queries
    return _units(q, "qid", *([scope] if scope else []))


def _asked(index: Index, queries: DataFrame, probes: int, told: list) -> DataFrame:
    """(qid, unit, cells[, scope]) of queries, with the `probes` nearest of the cells that hold something."""
    names = ["qid", *([index.scope] if index.scope else [])]
    return cut(_with_cells(_queries(queries, index.vectors, index.scope), np.array([r.cell for r in told], np.int32), np.array([r.center for r in told]), probes, names))


def _told(index: Index) -> list:
    return index.cells.orderBy("cell").collect()  # CELLS rows at most


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, digits: int | None = None) -> DataFrame:
    """(qid, vec_id, similarity, vec_rank) of the k nearest in the `probes` cells nearest to each of `queries` (qid, embedding[, scope]);
    with a scope, among vectors of the query's own one. Ties come by vec_id. Queries without a direction have no rows."""
    if not index.k_cells:
        return _empty(queries, index.vectors)
    found = _scan(index.vectors, _asked(index, queries, probes, _told(index)), k, digits, index.scope)
    return _empty(queries, index.vectors) if found is None else _best(found, k)


def exact(index: Index, queries: DataFrame, k: int = 10, probes: int = 2, digits: int | None = None) -> DataFrame:
    """search() over as many cells as it takes for the true k nearest: `probes` cells give a first k-th, then those are read whose radius
    leaves room for a vector at least as near. Similarities are compared with a margin for their rounding, `digits` included. Tasks tell from
    a cell's center which queries have room there, so no table of queries and cells is made."""
    if not index.k_cells:
        return _empty(queries, index.vectors)
    told = _told(index)
    asked = _asked(index, queries, probes, told)
    found = _scan(index.vectors, asked, k, digits, index.scope)
    if found is None:
        return _empty(queries, index.vectors)
    last = _best(found, k).groupBy("qid").agg(F.min("similarity").alias("s"), F.count(F.lit(1)).alias("c")).select("qid", F.when(F.col("c") >= k, F.col("s")).alias("kth"))
    bound = cut(asked.drop("cells").join(last, "qid", "left"))
    return _best(_scan(index.vectors, bound, k, digits, index.scope, {r.cell: (np.array(r.center), r.radius) for r in told}), k)


def _empty(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    rest = [StructField("similarity", DoubleType()), StructField("vec_rank", IntegerType())]
    return queries.sparkSession.createDataFrame([], StructType([queries.schema["qid"], vectors.schema["vec_id"], *rest]))


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true (qid, vec_id) rows that were found; 1 without any."""
    n, met = true.count(), true.join(found.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").count()
    return met / n if n else 1.0


def probes_for(index: Index, queries: DataFrame, k: int = 10, target: float = 0.95) -> int:
    """The smallest number of cells, by doubling and halving, whose search() has the target recall on the given queries."""
    true = cut(exact(index, queries, k))
    good = lambda p: recall(search(index, queries, k, p), true) >= target
    high = 1
    while high < index.k_cells and not good(high):
        high = min(2 * high, index.k_cells)
    low = high // 2
    while high - low > max(1, high // 8):
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return max(high, 1)


def _first_k(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row; of equal ones the first come."""
    if near.shape[1] <= k:
        return np.argsort(-near, axis=1, kind="stable")
    # all that are as large as the k-th: as a rule k of them, so that few are sorted
    least = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
    row, at = np.nonzero(near >= least)
    order = np.lexsort((at, -near[row, at], row))
    row, at = row[order], at[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return at[nth < k].reshape(len(near), k)


def by_blocks(queries: DataFrame, vectors: DataFrame, k: int = 10, digits: int | None = None, scope: str | None = None) -> DataFrame:
    """The k nearest of all vectors without an index, of equal scopes only if `scope` is named: the stated queries go to all tasks in blocks
    of a checked size, each task multiplies its batches with a block, PRODUCTS at a time, and keeps k rows a query."""
    names = ["vec_id", *([scope] if scope else [])]
    rows = _units(spread(vectors.select(*names, "embedding"), "vec_id"), *names)
    found = _scan(rows, cut(_queries(queries, vectors, scope)), k, digits, scope)
    return _empty(queries, vectors) if found is None else _best(found, k)
