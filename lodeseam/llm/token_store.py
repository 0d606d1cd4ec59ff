"""Token ids in files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents. File format, all little-endian:

    magic b"LSPF1\\0\\0\\0"
    blocks: [u32 minimum][u8 width][u8 0][u16 number of values - 1][u16 number of exceptions][packed low bits,
            most significant first][u16 position of each exception][u32 high bits of each exception]
    footer: documents as zstd of [i64 doc_id or 0]*[u8 1 if null]*[u64 first id, within the shard]*, then
            [u64 offset of each block]*, [u64 bytes of the documents' part], [u64 documents], [u64 ids], [u64 blocks],
            [u64 offset of the footer], magic

The values of a block are the ids less their minimum; they are packed at the width that holds 95 of 100 of them, and the
high bits of the others are in the exception list. With the block starts, a reader decodes only the blocks it needs.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder, no_cycles
from .common import new_folder
from .storage import create, open_at

MAGIC = b"LSPF1\0\0\0"
BLOCK, PERCENTILE, END_ID = 4096, 95, 0
_HEAD, _TAIL = struct.Struct("<IBBHH"), struct.Struct("<5Q8s")


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Low `width` bits of each value, one after the other, as bytes."""
    kind = (">u1", 8) if width <= 8 else (">u2", 16) if width <= 16 else (">u4", 32)
    wide = np.unpackbits(values.astype(kind[0]).view(np.uint8)).reshape(len(values), kind[1])
    return np.packbits(wide[:, kind[1] - width :])


def _values(data: np.ndarray, n: int, width: int) -> np.ndarray:
    kind = (">u1", 8) if width <= 8 else (">u2", 16) if width <= 16 else (">u4", 32)
    wide = np.zeros((n, kind[1]), np.uint8)
    wide[:, kind[1] - width :] = np.unpackbits(data, count=n * width).reshape(n, width)
    return np.packbits(wide).view(kind[0]).astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A block of 1 to 65536 unsigned 32-bit ids."""
    least = ids.min()
    values = ids - least
    k = (len(values) * percentile + 99) // 100 - 1
    width = max(1, int(np.partition(values, k)[k]).bit_length())
    low = values if width == 32 else values & np.uint32((1 << width) - 1)
    at = np.flatnonzero(low != values)
    high = values[at] >> np.uint32(width if width < 32 else 0)
    return _HEAD.pack(int(least), width, 0, len(ids) - 1, len(at)) + _bits(low, width).tobytes() + at.astype("<u2").tobytes() + high.astype("<u4").tobytes()


def decode_block(data: bytes | memoryview) -> np.ndarray:
    least, width, _, n, odd = _HEAD.unpack_from(data)
    n += 1
    packed = (n * width + 7) // 8
    values = _values(np.frombuffer(data, np.uint8, packed, _HEAD.size), n, width)
    if odd:
        at = np.frombuffer(data, "<u2", odd, _HEAD.size + packed)
        values[at] |= np.frombuffer(data, "<u4", odd, _HEAD.size + packed + 2 * odd) << np.uint32(width)
    return values + np.uint32(least)


class ShardWriter:
    def __init__(self, folder: str, name: str, block: int = BLOCK):
        self.path, self.out = create(folder, name)
        self.block, self.at, self.n, self.open, self.waiting = block, len(MAGIC), 0, [], 0
        self.starts, self.docs, self.nulls, self.firsts = [], [], bytearray(), []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.firsts.append(self.n)
        self.n += len(ids) // 4
        self.open.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= 16 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.open), "<u4")
        upto = len(ids) if last else len(ids) - len(ids) % self.block
        for k in range(0, upto, self.block):
            self.starts.append(self.at)
            self.at += self.out.write(encode_block(ids[k : min(k + self.block, upto)]))
        self.open, self.waiting = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        docs = zstandard.compress(np.array(self.docs, "<i8").tobytes() + bytes(self.nulls) + np.array(self.firsts, "<u8").tobytes())
        self.out.write(docs + np.array(self.starts, "<u8").tobytes() + _TAIL.pack(len(docs), len(self.docs), self.n, len(self.starts), self.at, MAGIC))
        self.out.close()


class ShardReader:
    """documents() yields (doc_id, first id within the shard, ids); ids(start, stop) reads only the blocks that hold them."""

    def __init__(self, path: str, block: int = BLOCK):
        self.file = open_at(path)
        size = self.file.size()
        self.file.seek(size - _TAIL.size)
        docs_bytes, docs, self.n, blocks, at, magic = _TAIL.unpack(self.file.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard of token ids")
        self.file.seek(at)
        footer = self.file.read(size - _TAIL.size - at)
        table = zstandard.decompress(footer[:docs_bytes], max_output_size=17 * docs or 1)
        self.docs = np.frombuffer(table, "<i8", docs)
        self.nulls = np.frombuffer(table, np.uint8, docs, 8 * docs)
        self.firsts = np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
        self.starts = np.append(np.frombuffer(footer, "<u8", blocks, docs_bytes), at).astype(np.int64)
        self.block = block

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        self.file.seek(int(self.starts[a]))
        data = memoryview(self.file.read(int(self.starts[b] - self.starts[a])))
        parts = [decode_block(data[self.starts[k] - self.starts[a] : self.starts[k + 1] - self.starts[a]]) for k in range(a, b)]
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]

    def documents(self, at_once: int = 1 << 18):
        k, ends = 0, np.append(self.firsts[1:], self.n)
        while k < len(self.docs):
            last = max(k + 1, int(np.searchsorted(ends, self.firsts[k] + at_once, side="right")))
            ids = self.ids(int(self.firsts[k]), int(ends[last - 1]))
            for j in range(k, last):
                yield None if self.nulls[j] else int(self.docs[j]), int(self.firsts[j]), ids[self.firsts[j] - self.firsts[k] : ends[j] - self.firsts[k]]
            k = last


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write them to shards in ascending doc_id order; returns one row a shard:
    (shard int, file string, n_docs long, n_tokens long, start long), start being the ids of all shards before it.

    A null or empty text is the end id alone; a very long one may fill a shard's blocks but is held by one task. Null doc_ids
    come first; rows of equal doc_id follow each other in order of their texts' hashes, and repeated rows in any order, so
    that even one row very often is dealt to several tasks. Other columns are ignored, whatever their names. An empty table gives no shard.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        code, out = encoder(path or default_path()), None
        shard = TaskContext.get().partitionId()
        with no_cycles():
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), code.ids(t.as_py() or "" for t in batch.column(1)), strict=True):
                    out = out or ShardWriter(folder, f"shard-{shard:06d}")
                    out.add(doc, ids + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [out.path], "n_docs": [len(out.docs)], "n_tokens": [out.n]})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    # rows that agree in both are alike, so their order is free: a number of their own lets them be dealt to several tasks
    order = ("doc_id", "hash", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    rows, at = [], 0
    # a row for each partition; its shard is whole in the shared folder by then
    for r in sorted(dealt.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long").collect()):
        rows.append((*r, at))
        at += r.n_tokens
    return spark.createDataFrame(rows, "shard int, file string, n_docs long, n_tokens long, start long")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(d, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in ShardReader(file).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    # the shards are few and of like size: dealt round robin, one task each
    dealt = shards.select("file", "start").repartition(n)
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
