"""Language identification with string kernels.

A text is the set of its byte n-grams of 1 to 4 bytes (ASCII lower-cased),
hashed to ``DIMS`` positions: the blended-spectrum presence kernel
k(x, y) = |x and y| / sqrt(|x| |y|).  Nystroem landmarks (a few labelled texts
of every language) turn it into a finite map, on which one-versus-rest kernel
ridge regression is solved on the driver from a bounded sample of labelled
rows.  Scoring a batch is two matrix products: presence x landmarks, kernel
values x coefficients.

The sample is chosen by a hash of doc_id and holds about ``per_language``
texts of each language, at most about ``sample_rows`` in all; only presence
bits (4 KB a text) reach the driver.  Whole texts are used throughout.

Nulls: a null text, or one without letters, is ``und`` with score 0; rows with
a null lang are not learned from.  Without labelled rows every text is
``und``.  Repeated rows get equal results; an empty table gives no rows; extra
columns are kept by `identify` unless they clash with its two outputs, which
replace them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIMS_BITS = 15
DIMS = 1 << DIMS_BITS
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A (documents x DIMS) table of n-gram presence."""
    n = len(off) - 1
    out = np.zeros(n * DIMS, bool)
    if len(data):
        low = common.LOWER[data].astype(np.uint32)
        doc = np.repeat(np.arange(n), np.diff(off))
        left = off[1:][doc] - np.arange(len(data))  # bytes up to the end of the document
        base = doc * DIMS
        gram = low
        for size, factor in enumerate(_FACTORS, 1):
            if size > 1:
                gram = (gram[:-1] << np.uint32(8)) | low[size - 1 :]
            at = (gram * np.uint32(factor)) >> np.uint32(32 - DIMS_BITS)
            inside = left[: len(gram)] >= size
            out[base[: len(gram)][inside] + at[inside]] = True
    return out.reshape(n, DIMS)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(common._LETTER[data])])
    out = count[off[1:]] > count[off[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode())
    return out


def kernel(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of presence rows against landmark rows."""
    used = np.flatnonzero(marks.any(0))
    both = bits[:, used].astype(np.float32) @ marks[:, used].T.astype(np.float32)
    size = np.sqrt(np.maximum(bits.sum(1), 1, dtype=np.float32))
    return both / size[:, None] / np.sqrt(np.maximum(marks.sum(1), 1, dtype=np.float32))


class Model:
    """Landmarks and coefficients."""

    def __init__(self, bits: np.ndarray, labels: list[str], landmarks: int, ridge: float):
        self.langs = sorted(set(labels))
        y = np.array([self.langs.index(x) for x in labels], np.int64)
        per = max(1, landmarks // max(1, len(self.langs)))
        chosen = np.concatenate([np.flatnonzero(y == k)[:per] for k in range(len(self.langs))]) if len(y) else np.zeros(0, np.int64)
        self.marks = bits[chosen]
        if not len(y):
            return
        inner = kernel(self.marks, self.marks).astype(float)
        value, vector = np.linalg.eigh((inner + inner.T) / 2)
        root = vector / np.sqrt(np.maximum(value, 1e-6))  # K^-1/2 up to a rotation
        z = np.concatenate([kernel(bits[s : s + 256], self.marks) for s in range(0, len(bits), 256)]) @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        weight = (1 / np.bincount(y, minlength=len(self.langs)))[y]  # every language counts alike
        w = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * np.eye(z.shape[1]) / len(y), z.T @ (np.eye(len(self.langs))[y] * weight[:, None]))
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(off) - 1
        names, score = ["und"] * n, np.zeros(n)
        if not self.langs or not n:
            return names, score
        values = kernel(presence(data, off), self.marks) @ self.weights + self.bias
        best = values.argmax(1)
        letters = has_letter(data, off)
        for i in np.flatnonzero(letters).tolist():
            names[i], score[i] = self.langs[best[i]], min(1.0, max(0.0, float(values[i, best[i]])))
        return names, score


def small_blocks(off: np.ndarray, rows: int = 64):
    """Ranges of at most ``rows`` documents and a block's bytes."""
    for i, j in common.blocks(off, 1 << 20):
        for k in range(i, j, rows):
            yield k, min(j, k + rows)


def fit(labelled: DataFrame, per_language: int = 400, sample_rows: int = 4000, landmarks: int = 96, ridge: float = 1e-3) -> Model:
    """A model from rows (doc_id, text, lang) without nulls in text and lang."""
    common.ship(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    want = min(per_language, max(1, sample_rows // max(1, len(counts))))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(want / n)).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "text", "lang")

    def bits(batches):
        from evidra.llm import language as m

        for b in common.given(batches):
            data, off = common.column_bytes(b.column("text"))
            for i, j in m.small_blocks(off):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ok = m.has_letter(part, cut)
                rows = np.packbits(m.presence(part, cut)[ok], axis=1)
                yield pa.record_batch([pa.array(np.asarray(b.column("doc_id").slice(i, j - i).fill_null(0))[ok]), pa.array(np.array(b.column("lang").slice(i, j - i).to_pylist(), object)[ok].tolist(), pa.string()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "lang", "bits"])

    got = sample.mapInArrow(bits, "doc_id long, lang string, bits binary").collect()
    got.sort(key=lambda r: (r.lang, r.doc_id, bytes(r.bits)))
    table = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), DIMS // 8), axis=1).astype(bool)
    return Model(table, [r.lang for r in got], landmarks, ridge)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    common.ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x DIMS bits and a small matrix: about 3 MB

    def run(batches):
        from evidra.llm import language as m

        for b in common.given(batches):
            data, off = common.column_bytes(b.column("text"))
            got = [sent.value.predict(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in m.small_blocks(off)]
            names, score = [x for n, _ in got for x in n], np.concatenate([s for _, s in got]) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(common.crc_mod("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
