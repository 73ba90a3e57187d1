"""Byte-level BPE encoding and decoding with a sentencepiece model that is written straight from the ranks.

`vocabulary` serialises a sentencepiece BPE model: every byte sequence of the
rank file becomes a piece (byte b is written as character 256 + b, so no piece
holds a space or a byte that is no character), its score is the negative rank,
and nothing is normalised.  Sentencepiece merges the pair of best score first
and the leftmost of equal ones, which is the order of the ranks.  A text is cut
by the pattern, each match is encoded by itself, and a match that is a piece is
that piece, as the rank files are meant.  Decoding maps ids to their pieces and
characters back to bytes.

The model (a megabyte) is broadcast: its size is that of the vocabulary, not of
the data.  A task holds one batch, and of one long text the characters, the ids
and 65,536 matches at a time; what it remembers of matches is bounded by
``keep``.  One match without a cut (a megabyte of one letter) is encoded whole,
with about 100 bytes for each of its bytes.  No shuffle.

Nulls: a null text is an empty one and has no ids; null ids decode to nothing;
a null key is carried.  Bytes that are no UTF-8 are read as U+FFFD.  Strings of
special tokens are ordinary text.  Repeated rows get equal ids, rows stay in
number, an empty table gives no rows.  Extra columns are kept; those named as a
result are replaced.  An id outside the vocabulary raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Characters of a text beyond which its matches are taken in runs.
LONG_TEXT = 1 << 20
_RUN = 1 << 16
#: Bytes as characters of a piece.
_TO_CHARS = {b: 256 + b for b in range(256)}


class Vocabulary(NamedTuple):
    """``model``: the serialised sentencepiece model; ``ranks``: the rank of each of its ids but the last, which is unknown."""

    model: bytes
    ranks: np.ndarray
    pattern: str


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A field of a protocol buffer: a length and bytes, or a number."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """From a rank file: lines of a base64 byte sequence and its rank."""
    with open(path, "rb") as f:
        ranked = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if len({t for _, t in ranked} & {bytes([b]) for b in range(256)}) < 256:
        raise ValueError("a byte-level vocabulary has a rank for every single byte")
    if len(ranked) >= 1 << 24 or len({r for r, _ in ranked}) < len(ranked) or len({t for _, t in ranked}) < len(ranked):
        raise ValueError("ranks and byte sequences must be distinct, and fewer than 2^24: scores are floats")
    normal, unknown = 1, 2
    out = bytearray()
    for i, (_, token) in enumerate(ranked):
        piece = token.decode("latin-1").translate(_TO_CHARS).encode()
        out += _field(1, _field(1, piece) + struct.pack("<Bf", 2 << 3 | 5, -float(i)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + struct.pack("<Bf", 2 << 3 | 5, 0.0) + _field(3, unknown))
    out += _field(2, _field(3, 2) + _field(4, len(ranked) + 1))  # the trainer's part: a BPE model
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))  # no prefix, no spaces removed or escaped
    return Vocabulary(bytes(out), np.array([r for r, _ in ranked], np.uint32), pattern)


class Codec:
    """Encodes and decodes with a `Vocabulary`; remembers the ids of up to ``keep`` matches."""

    def __init__(self, v: Vocabulary, keep: int = 200_000):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=v.model)
        self.unknown, self.ranks, self.keep = len(v.ranks), v.ranks, keep
        self.pattern = regex.compile(v.pattern)
        self.known: dict[str, bytes] = {}
        tokens = [self.model.id_to_piece(i).encode("utf-16-le") for i in range(self.unknown)]
        size = np.fromiter((len(t) // 2 for t in tokens), np.int64, self.unknown)
        self.bytes = (np.frombuffer(b"".join(tokens), "<u2") - 256).astype(np.uint8)
        # By rank, as ids are ranks.
        self.base, self.size = np.zeros(int(v.ranks.max()) + 1, np.int64), np.full(int(v.ranks.max()) + 1, -1, np.int64)
        self.base[v.ranks], self.size[v.ranks] = np.cumsum(size) - size, size

    def _of(self, match: str) -> bytes:
        got = self.known.get(match)
        if got is None:
            chars = match.encode().decode("latin-1").translate(_TO_CHARS)
            one = self.model.piece_to_id(chars)
            got = self.ranks[[one] if one != self.unknown else self.model.encode(chars)].astype("<u4").tobytes()
            if len(match) < 256:
                if len(self.known) >= self.keep:
                    self.known.clear()
                self.known[match] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG_TEXT:
            return b"".join(map(self._of, self.pattern.findall(text)))
        each, out = (m.group() for m in self.pattern.finditer(text)), bytearray()
        while run := b"".join(map(self._of, itertools.islice(each, _RUN))):
            out += run
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        out = []
        for at in range(0, len(ids), 4 * LONG_TEXT):
            i = np.frombuffer(ids[at : at + 4 * LONG_TEXT], "<u4")
            if i.max() >= len(self.size) or (self.size[i] < 0).any():
                raise ValueError("an id is outside the vocabulary")
            n = self.size[i]
            out.append(self.bytes[np.repeat(self.base[i] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
        return b"".join(out)


_CODECS: dict[bytes, Codec] = {}


def codec(v: Vocabulary) -> Codec:
    """One codec for each worker process, so that its tasks share what it remembers."""
    key = hashlib.sha256(v.model + v.pattern.encode() + v.ranks.tobytes()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(v)
    return _CODECS[key]


def _with_binary(df: DataFrame, source: str, target: str, of, v: Vocabulary) -> DataFrame:
    """``df`` with a binary column made by ``of(codec, value)`` from each non-null value of ``source``."""
    spark = df.sparkSession
    common.ship(spark)
    df = df.select(*[c for c in df.columns if c != target])
    sent = spark.sparkContext.broadcast(v)

    def run(batches):
        from evidra.llm import byte_bpe, common as c

        own = byte_bpe.codec(sent.value)
        for b in c.given(batches, encodes=True):
            col = b.column(source)
            col = col.cast(pa.large_binary())
            out = pa.array((of(own, x.as_buffer().to_pybytes()) if x.is_valid else b"" for x in col), pa.binary(), size=len(col))
            yield pa.record_batch([*b.columns, out], names=[*b.schema.names, target])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(target, T.BinaryType())]))


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``docs`` with ``ids``: those of ``text`` as little-endian unsigned 32-bit integers."""
    return _with_binary(docs, "text", "ids", lambda own, raw: own.encode(raw.decode("utf-8", "replace")), v)


def decode(df: DataFrame, v: Vocabulary) -> DataFrame:
    """``df`` with ``decoded``: the bytes that its ``ids`` stand for."""
    return _with_binary(df, "ids", "decoded", lambda own, raw: own.decode(raw), v)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    v = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), v).select("doc_id", "ids")
    return decode(ids, v).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
