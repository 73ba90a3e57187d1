"""Packing: concatenate all documents and cut at fixed windows.

Two passes and no shuffle.  The first encodes each scan partition once and
stores its ids with a running offset inside the partition; the totals of the
partitions (one number each) give every partition its global offset; the
second cuts each document where windows of the global stream end.  A document
that crosses a window leaves one boundary record for each piece.

Nulls: a null text is an empty one (its only id is the end id); a null doc_id
is carried.  Repeated rows are packed as often as they occur.  An empty table
gives no pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, cut_before boolean, cut_after boolean"


def encoded(docs: DataFrame, tokenizer: str, keeps_space: bool, end: int, scope: str = "") -> DataFrame:
    """(part, at, n, doc_id, ids): the ids of every text, with each one's offset in its scan partition; staged."""
    common.ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        from evidra.llm import common as c

        enc, part, at = c.encoder(tokenizer, keeps_space), TaskContext.get().partitionId(), 0
        for b in common.given(batches, encodes=True):
            for i, j, ids, off in enc.encode_column(b.column("text"), end):
                raw = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((off * ids.dtype.itemsize).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch([pa.array(np.full(j - i, part, np.int32)), pa.array(at + off[:-1]), pa.array(np.diff(off)), b.column("doc_id").slice(i, j - i).cast(pa.int64()), raw], names=["part", "at", "n", "doc_id", "ids"])
                at += int(off[-1])

    out = docs.select("doc_id", "text").mapInArrow(run, "part int, at long, n long, doc_id long, ids binary")
    return common.staged(out, "ids", scope)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, keeps_space: bool = False, with_ids: bool = False, scope: str = "") -> DataFrame:
    """Pieces of documents in sequences of ``window`` ids; only the last sequence may be shorter.

    ``with_ids`` adds the ids of each piece as little-endian binary of the
    stored width.
    """
    ids = encoded(docs, tokenizer, keeps_space, end, scope)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row for each scan partition
    base, total = {}, 0
    for r in totals:
        base[r.part] = total
        total += r.n
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches):
        for b in common.given(batches):
            rows, blobs = [], []
            for part, at, n, doc, raw in zip(*(b.column(k).to_pylist() for k in ("part", "at", "n", "doc_id", "ids")), strict=True):
                width = len(raw) // n
                wide = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                first = base[part] + at
                start = 0
                while start < n:
                    seq, off = divmod(first + start, window)
                    size = min(n - start, window - off)
                    rows.append((doc, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]), n, seq, off, min(window, total - seq * window), start > 0, start + size < n))
                    if with_ids:
                        blobs.append(raw[width * start : width * (start + size)])
                    start += size
            cols = [pa.array(x) for x in zip(*rows, strict=True)]
            cols = [c.cast(pa.int64()) if i < 8 else c for i, c in enumerate(cols)]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.record_batch(cols + [pa.array(blobs, pa.binary())] * with_ids, names=names)

    return ids.mapInArrow(run, schema)


def padded_length(length: int, window: int = 2048) -> int:
    """The stored length of a sequence: ``window``, but a sequence whose length is a power of two stays as it is."""
    return length if length and length & (length - 1) == 0 else window


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
