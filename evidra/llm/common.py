"""Shared pieces: the folder all executors see, and byte-level tokenising.

The tokenising helpers work on whole Arrow string columns as one byte array,
so a batch of documents costs a few numpy passes rather than a Python loop
over words.
"""

from __future__ import annotations

import ctypes
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Text handled at once inside a task; longer documents are handled alone.
BLOCK_BYTES = 1 << 20
_STAGED: dict[str, list[str]] = {}


# ---------------------------------------------------------------- the session


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = _STAGED.setdefault("_own", [])
        if not told:
            told.append("file://" + tempfile.mkdtemp(prefix="evidra-"))
        told = told[0]
    return told.rstrip("/")


def new_dir(spark: SparkSession, name: str, scope: str = "") -> str:
    """A fresh path below the shared folder, remembered under ``scope`` for `release`."""
    path = f"{shared_dir(spark)}/evidra/{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.setdefault(scope, []).append(path)
    return path


def staged(df: DataFrame, name: str, scope: str = "", parts: int = 0, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later stages start from files, not from lineage.

    ``parts``: files at most, where the number of rows is known (`parts_for`).
    """
    spark = df.sparkSession
    path = new_dir(spark, name, scope)
    # Small row groups: a writer and a reader hold one of them in memory.
    (df.coalesce(parts) if parts else df).write.options(**({"parquet.block.size": str(16 << 20)} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """Partitions for so many rows of a few numbers: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def release(spark: SparkSession, scope: str) -> None:
    """Deletes what was staged under ``scope``. Only for tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _STAGED.pop(scope, []) if scope else []:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of a column as text, modulo ``n``: the fold of a row."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def open_fs(path: str):
    """A pyarrow file system and the path in it, for files that tasks write in the shared folder."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + os.path.abspath(path)
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, so that tasks can import it.

    Texts are long: Arrow batches of the default size are made smaller, for
    this session; sizes that the user has set stay.  So are reads of Parquet:
    a vectored one copies a whole column of a row group through memory outside
    the heap, which each reading thread then keeps.
    """
    if spark.conf.get("parquet.hadoop.vectored.io.enabled", None) is None:
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    for key, default, size in (("maxRecordsPerBatch", ("10000",), "1000"), ("maxBytesPerBatch", (None, "64MB", "67108864b", "67108864"), "2m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) in default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", size)
    staging.ship(spark)


# ------------------------------------------------------------- bytes and words


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes inside the given inclusive ranges."""
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: Fixed by the contracts: words without spaces, and words of ASCII letters, digits and all bytes of other characters.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes each, or of one document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def given(batches, encodes: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at its end the worker, which serves later tasks too, gives free memory back.

    What encoders remember stays for the next task that ``encodes``; any other task lets it go.
    """
    if not encodes:
        _ENCODERS.clear()
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def slices(batches, rows: int = 1500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what is computed for one is let go before the next."""
    for b in given(batches):
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of the maximal runs of bytes in class ``inside``; none crosses documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = inside[data]
    full = off[:-1] < off[1:]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    before[off[:-1][full]] = False
    start = np.flatnonzero(m & ~before)
    before[:-1] = m[1:]
    before[-1] = False
    before[off[1:][full] - 1] = False
    end = np.flatnonzero(m & ~before) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(n: int, held: list[np.ndarray]) -> list[np.ndarray]:
    if not held or len(held[0]) < n + 1:
        n = max(n, BLOCK_BYTES) + 1
        held[:] = []
        for b in (_BASE, _INVERSE):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            held.append(np.cumprod(p, dtype=np.uint64))
    return held


class Hasher:
    """64-bit hashes of byte ranges of one array by prefix sums of a polynomial: no loop over words.

    ``held`` keeps the tables of powers between calls; a task passes one list.
    """

    def __init__(self, data: np.ndarray, held: list[np.ndarray] | None = None):
        up, self.down = _powers(len(data), [] if held is None else held)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, held: list[np.ndarray] | None = None) -> np.ndarray:
    return Hasher(data, held).of(start, end)


def long_words(data: np.ndarray, inside: np.ndarray, held: list[np.ndarray] | None = None, size: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of one text of any length, as `words` and `word_hashes` of its ASCII lower case have them.

    The text is read in windows of ``size`` bytes; a word may span windows.
    """
    held = [] if held is None else held
    out, begun, since = [], 0, -1  # hash and start of a word that reaches the end of the window
    whole = lambda h, n: mix(h + n.astype(np.uint64))
    for at in range(0, len(data), size):
        part = LOWER[data[at : at + size]]
        start, end, _ = words(part, np.array([0, len(part)]), inside)
        h = Hasher(part, held)
        raw = (h.sums[end] - h.sums[start]) * h.down[start]
        start, end = start + at, end + at
        if since >= 0:
            if len(start) and start[0] == at:
                raw[:1] = raw[:1] * np.uint64(pow(_BASE, at - since, 1 << 64)) + np.uint64(begun)
                start[0] = since
            else:
                out.append((np.array([since]), np.array([at]), whole(np.array([begun], np.uint64), np.array([at - since]))))
            since = -1
        if len(end) and end[-1] == at + len(part):
            begun, since = int(raw[-1]), int(start[-1])
            start, end, raw = start[:-1], end[:-1], raw[:-1]
        out.append((start, end, whole(raw, end - start)))
    if since >= 0:
        out.append((np.array([since]), np.array([len(data)]), whole(np.array([begun], np.uint64), np.array([len(data) - since]))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def hashed_words(data: np.ndarray, off: np.ndarray, inside: np.ndarray, held: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, hash) of the words of a block of texts, in lower case; one text of more than a block is read in windows."""
    if len(data) > BLOCK_BYTES and len(off) == 2:
        start, end, h = long_words(data, inside, held)
        return start, end, np.zeros(len(h), np.int64), h
    low = LOWER[data]
    start, end, doc = words(low, off, inside)
    return start, end, doc, word_hashes(low, start, end, held)


# -------------------------------------------------------------------- encoding


#: Characters of more than one byte that count as space start with one of these pairs.
_WIDE_SPACE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), (0x1C, 0x1F))
_LETTER = byte_class((65, 90), (97, 122))
_MARK = byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, keeps_space: bool) -> PieceEncoder:
    """One encoder for each worker process, so that tasks share what it remembers."""
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = PieceEncoder(path, keeps_space)
    return _ENCODERS[path, keeps_space]


class PieceEncoder:
    """Encodes texts with a public tokenizer, each distinct piece once.

    The vocabularies cut a text before a single space between other
    characters, between an ASCII letter and an ASCII mark, and around a single
    line end, so the ids of a text are those of its pieces in order.  Pieces
    are found and counted by numpy; only new ones reach the tokenizer.  Where
    it keeps spaces, words behind one space go there many to a text, as their
    ids tell their bytes.  Texts with rare kinds of space are encoded whole.
    ``keep`` bounds what is remembered: beyond it, pieces that were seen once
    are forgotten.
    """

    def __init__(self, path: str, keeps_space: bool, keep: int = 300_000, together: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.kind = np.dtype("<u4" if self.tok.get_vocab_size() > 65536 else "<u2")
        self.keeps_space, self.keep, self.together = keeps_space, keep, together
        if keeps_space:  # a vocabulary of bytes: each sign of a token stands for one
            vocab = self.tok.get_vocab()
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)
            self.width[list(vocab.values())] = [len(t) for t in vocab]
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their rows below
        self.flat, self.base, self.size, self.times = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.powers: list[np.ndarray] = []

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number in each)."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), self.kind, int(size.sum())), size

    def _encode_words(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `_encode`, for words that each begin with one space and end without: ``together`` of them are one text."""
        long = stop - start
        end = np.cumsum(long)
        raw = data[np.repeat(start - end + long, long) + np.arange(end[-1])].tobytes()
        cuts = [0, *end[self.together - 1 : -1 : self.together].tolist(), len(raw)]
        ids, _ = self._encode([raw[a:z].decode() for a, z in itertools.pairwise(cuts)])
        at = np.cumsum(self.width[ids])
        last = np.minimum(np.searchsorted(at, end), len(at) - 1)
        if at[-1] == end[-1] and (at[last] == end).all():
            return ids, np.diff(last, prepend=-1)
        return self._encode([raw[a:z].decode() for a, z in zip((end - long).tolist(), end.tolist(), strict=True)])

    def _store(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Encodes and remembers new pieces, whose hashes ascend; returns their rows."""
        word = np.zeros(len(hashes), bool)
        if self.keeps_space:
            long = stop - start
            word = (data[start] == 32) & (long > 1) & (long <= 256) & ~_SPACE[data[np.minimum(start + 1, stop - 1)]] & ~_SPACE[data[stop - 1]]
        raw = data.tobytes()
        done = [self._encode([raw[a:z].decode() for a, z in zip(start[~word].tolist(), stop[~word].tolist(), strict=True)])]
        words = np.flatnonzero(word)
        done += [self._encode_words(data, start[w], stop[w]) for w in np.split(words, range(1 << 14, len(words), 1 << 14)) if len(w)]
        flat, size = (np.concatenate(x) for x in zip(*done, strict=True))
        rows = np.empty(len(hashes), np.int64)
        rows[np.argsort(word, kind="stable")] = len(self.size) + np.arange(len(hashes))
        place = np.searchsorted(self.keys, hashes)
        self.keys, self.rows = np.insert(self.keys, place, hashes), np.insert(self.rows, place, rows)
        self.base = np.concatenate([self.base, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.times = np.concatenate([self.times, np.zeros(len(size), np.int32)])
        return rows

    def _forget(self) -> None:
        kept = np.flatnonzero(self.times > 1)[-self.keep // 2 :]
        place = np.full(len(self.size), -1)
        place[kept] = np.arange(len(kept))
        rows = place[self.rows]
        self.keys, self.rows = self.keys[rows >= 0], rows[rows >= 0]
        size = self.size[kept]
        end = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.base[kept] - end + size, size) + np.arange(size.sum())]
        self.base, self.size, self.times = end - size, size, np.ones(len(kept), np.int32)

    def encode_column(self, col: pa.Array, end: int):
        """(i, j, ids, offsets) for runs of rows i to j of a text column, each text followed by ``end``; null is empty."""
        data, off = column_bytes(col)
        for i, j in blocks(off, BLOCK_BYTES // 2):  # a block takes some fifty times its bytes
            ids, size = self._block(data[off[i] : off[j]], off[i : j + 1] - off[i], end)
            yield i, j, ids, np.concatenate([[0], np.cumsum(size)])

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        padded = np.empty(n + 2, np.uint8)
        padded[0] = padded[-1] = 32
        padded[1:-1] = data
        space, letter = _SPACE[padded], _LETTER[padded]
        alone = ~space[:-2] & ~space[2:]  # other characters on both sides
        cut = np.zeros(n + 1, bool)
        cut[:-1] = ((data == 32) | (data == 10)) & alone
        cut[1:] |= (data == 10) & alone
        cut[:-1] |= letter[:-2] & _MARK[data]
        cut[off] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        if not self.keeps_space:
            start = start + (data[start] == 32)
        return start, end

    def _block(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(off) - 1
        if not len(data):
            return np.full(n, end, self.kind), np.ones(n, np.int64)
        odd = np.zeros(0, np.int64)
        if (data >= 0xC2).any():
            pair = data[:-1].astype(np.uint16) << 8 | data[1:]
            odd = np.unique(np.searchsorted(off, np.flatnonzero(np.isin(pair, [a << 8 | b for a, b in _WIDE_SPACE])), "right") - 1)
        if not self.keeps_space:
            data = LOWER[data]
        start, stop = self._pieces(data, off)
        doc = np.searchsorted(off, start, "right") - 1
        if not self.keeps_space:  # a piece that was one space may now start where its text ends
            full = start < stop
            start, stop, doc = start[full], stop[full], doc[full]
        if len(odd):
            whole = np.isin(doc, odd)
            start, stop, doc = start[~whole], stop[~whole], doc[~whole]
        hashes = word_hashes(data, start, stop, self.powers)
        order = np.argsort(hashes)
        hashes = hashes[order]
        lead = np.ones(len(hashes), bool)
        lead[1:] = hashes[1:] != hashes[:-1]
        piece = np.empty(len(hashes), np.int64)
        piece[order] = np.cumsum(lead) - 1
        hashes, first = hashes[lead], order[lead]
        if len(self.size) > self.keep:
            self._forget()
        rows = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            rows = np.where(self.keys[place] == hashes, self.rows[place], -1)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._store(hashes[new], data, start[first[new]], stop[first[new]])
        self.times[rows] += 1
        whole_ids, whole_size = self._encode([data[off[d] : off[d + 1]].tobytes().decode() for d in odd.tolist()])
        top = len(self.flat)
        flat = np.concatenate([self.flat, np.array([end], self.kind), whole_ids]) if len(odd) else np.append(self.flat, np.array([end], self.kind))
        base = np.concatenate([self.base[rows], [top], top + 1 + np.cumsum(whole_size) - whole_size])
        size = np.concatenate([self.size[rows], [1], whole_size])
        # One entry for each piece, each end, and each text encoded whole; then in the order of documents.
        ends = np.arange(n)
        entry = np.concatenate([piece, np.full(n, len(rows)), len(rows) + 1 + np.arange(len(odd))])
        owner = np.concatenate([doc * 2, ends * 2 + 1, odd * 2])
        order = np.argsort(owner, kind="stable")
        entry, owner = entry[order], owner[order] >> 1
        long = size[entry]
        total = np.cumsum(long)
        ids = flat[np.repeat(base[entry] - total + long, long) + np.arange(total[-1])]
        return ids, np.bincount(owner, long, n).astype(np.int64)
