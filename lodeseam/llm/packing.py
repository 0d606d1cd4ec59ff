"""Best-fit packing of tokenised documents by the sum of squares.

Every document is cut into pieces of at most `size` tokens (the first may be shorter). A full piece is a sequence of its
own. The others are dealt out to groups of some GROUP pieces at every scale, a task each. Its pieces are placed one by
one, from long to short: of all gaps that hold the piece, and a new sequence, each goes where the sum of the squared
counts of open sequences per gap becomes smallest; at a tie, the smallest gap. A sequence whose gap is under an eighth of
`size` is as good as full: it is filled like others, but not in the sum (the README says what counting all gaps costs).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder, no_cycles
from .common import each_batch, save, texts

SIZE, END_ID, GROUP = 1024, 2, 50_000


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every document; a null text is an empty one."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batch):
        code = encoder(path or default_path())
        out: list[list] = [[] for _ in range(6)]
        with no_cycles():
            for doc, ids in zip(batch.column(0).to_pylist(), code.ids(t.as_py() or "" for t in batch.column(1)), strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                for k in range(-(-n // size)):
                    length = (n - 1) % size + 1 if k == 0 else size
                    part = ids[4 * at : 4 * (at + length)]
                    for column, x in zip(out, (doc, k, at, length, zlib.crc32(part), part), strict=True):
                        column.append(x)
                    at += length
        return out if with_ids else out[:5]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    fields = list(zip(names, kinds, strict=True))[: 6 if with_ids else 5]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each_batch(cut, *fields), schema)


def fill(lengths: list[int], size: int = SIZE, counted: int | None = None) -> tuple[list[int], list[int]]:
    """Sequence and offset of each of `lengths` (all under `size`), placed one by one in the order given.

    counted: the shortest gap whose sequences are in the sum, an eighth of `size` if not given. Shorter gaps are filled like
    others; it only does not matter how many there are.
    """
    counted = max(1, size // 8) if counted is None else counted
    n = np.zeros(size + 1, np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    none = np.iinfo(np.int64).max
    sequences, offsets, made = [], [], 0
    for length in lengths:
        rest = size - length
        have = n[length:size]
        # change of the sum if a sequence of gap length, length + 1, ... takes the piece, or a new one
        leave, come = 1 - 2 * have, 2 * n[:rest] + 1
        leave[: max(0, counted - length)] = 0
        come[:counted] = 0
        change = np.where(have > 0, leave + come, none)
        best = int(change.argmin())
        if change[best] <= (2 * n[rest] + 1 if rest >= counted else 0) and have[best]:
            gap = length + best
            sequence = open_at[gap].pop()
            n[gap] -= 1
        else:
            gap, sequence = size, made
            made += 1
        n[gap - length] += 1
        open_at[gap - length].append(sequence)
        sequences.append(sequence)
        offsets.append(size - gap)
    return sequences, offsets


NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def place(table: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which must be a written one (it is read twice)."""
    short = table.where(F.col("length") < size).select(*NAMES[:5])
    groups = max(1, -(-short.count() // group))

    def pack_group(batches):
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.sort_by([("length", "descending")])
        sequences, offsets = fill(rows.column("length").to_pylist(), size)
        # numbers of a group are its own: no group has 2**32 sequences
        own = np.array(sequences, np.int64) + (TaskContext.get().partitionId() << 32)
        yield from rows.append_column("sequence_id", pa.array(own)).append_column("offset", pa.array(offsets, pa.int64())).combine_chunks().to_batches()

    # dealt round robin, so all groups are of one size whatever the pieces are
    packed = short.repartition(groups).mapInArrow(pack_group, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = table.where(F.col("length") == size).select(*NAMES[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the end id alone; a very long text is cut into many; repeated rows and rows
    with equal or null doc_id are packed like others; at a tie a piece goes to the smallest gap, and to a new sequence only
    if that is better than all gaps; an empty table gives no rows; other columns are ignored, whatever their names. Pieces
    of a sequence follow each other without gaps.
    """
    return place(save(pieces(docs, path, size, end_id), "pieces"), size, group)
