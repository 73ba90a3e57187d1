"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from a bounded sample of
labelled rows (counted on Spark, the strongest terms kept); the features are
densities of that lexicon and of a short fixed list, hits near second-person
words, capitals, marks, digits and obfuscated words.  Three disjoint parts of
the sample serve the lexicon, the trees and the calibration.  Where the last part has
fewer than ``calibration_rows`` rows, or one label only, the trees learn from it
too and their own probability is the score.

The sample is chosen by a hash of doc_id: about ``sample_rows / 2`` rows of
each label (its bound, `sample_rows`, is a parameter); weights restore the
proportions.  Scoring covers every whole text.

Nulls: a null text is scored as an empty one; rows with a null label or
doc_id are not learned from; a doc_id with several labels counts as toxic if
one of them is.  Without both labels every score is the share of toxic rows
(0 without any).  Repeated rows get equal scores.  An empty table gives no
rows.  Extra columns are kept by `score`, whose outputs replace columns of
their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Common insults, and words that address a reader in the languages of the tables.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns fool jerk ugly hate imbecile cretin vermin filth"
SECOND_PERSON = "you your yours yourself u ur tu te ti tus toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes vosotros"
_LEET = common.LOWER.copy()
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    _LEET[_a] = _b
_LOOSE = common.ALNUM.copy()
_LOOSE[[ord("@"), ord("$"), ord("*")]] = True
PREFIXES = (4, 5, 6)
FEATURES = 22
_UPPER = common.byte_class((65, 90))
_DIGIT = common.byte_class((48, 57))


def fixed_hashes(text: str) -> np.ndarray:
    w = [x.encode() for x in text.split()]
    end = np.cumsum([len(x) for x in w])
    return np.sort(common.word_hashes(np.frombuffer(b"".join(w), np.uint8), end - [len(x) for x in w], end))


def _in(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 where absent."""
    if not len(sorted_hashes):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at, -1)


def tokens(data: np.ndarray, off: np.ndarray, powers: list) -> tuple:
    """(start, end, doc, word hashes, hashes of beginnings by length; 0 for words that are no longer than it)."""
    low = common.LOWER[data]
    start, end, doc = common.words(low, off, common.ALNUM)
    h = common.Hasher(low, powers)
    begins = [np.where(end - start > p, h.of(start, np.minimum(end, start + p)) ^ np.uint64(p), np.uint64(0)) for p in PREFIXES]
    return start, end, doc, h.of(start, end), begins


def features(data: np.ndarray, off: np.ndarray, lexicon: np.ndarray, weight: np.ndarray, powers: list) -> np.ndarray:
    """A (documents x FEATURES) table. ``lexicon``: sorted hashes of terms, with log odds ``weight``."""
    n = len(off) - 1
    if not len(data):
        return np.zeros((n, FEATURES), np.float32)
    start, end, doc, word, begins = tokens(data, off, powers)
    count = lambda at, w=None: np.bincount(doc[at] if len(at) else np.zeros(0, np.int64), None if w is None else w, n)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    size = np.maximum(np.diff(off), 1)
    per_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    hit = np.stack([_in(lexicon, x) for x in (word, *begins)])
    odds = np.where(hit >= 0, weight[np.maximum(hit, 0)], 0) if len(weight) else np.zeros(hit.shape)
    whole, part = np.flatnonzero(hit[0] >= 0), np.flatnonzero(hit.max(0) >= 0)
    best = odds.max(0)
    top = np.zeros(n)
    np.maximum.at(top, doc[part], best[part])
    strong = np.flatnonzero(best > 3)
    pair = np.unique(doc[part].astype(np.int64) << 32 | hit.max(0)[part]) >> 32
    distinct = np.bincount(pair, minlength=n)
    insult = np.flatnonzero(_in(fixed_hashes(INSULTS), word) >= 0)
    you = np.flatnonzero(_in(fixed_hashes(SECOND_PERSON), word) >= 0)
    bad = np.union1d(part, insult)
    near = np.zeros(0, np.int64)
    if len(you) and len(bad):
        at = np.searchsorted(you, bad)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - bad), np.abs(you[np.maximum(at - 1, 0)] - bad))
        near = bad[gap <= 5]

    # Words written with digits or signs among letters, read as letters.
    ls, le, ld = common.words(data, off, _LOOSE)
    letters = np.concatenate([[0], np.cumsum(common._LETTER[data])])
    signs = np.concatenate([[0], np.cumsum(_DIGIT[data] | np.isin(data, [64, 36, 42]))])
    mixed = np.flatnonzero((letters[le] - letters[ls] >= 2) & (signs[le] > signs[ls]))
    read = common.Hasher(_LEET[data], powers).of(ls[mixed], le[mixed])
    hidden = mixed[(_in(lexicon, read) >= 0) | (_in(fixed_hashes(INSULTS), read) >= 0)]
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = np.flatnonzero((caps[end] - caps[start] == end - start) & (end - start > 1))
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])

    return np.stack([
        np.log1p(words), count(whole), count(whole) / words, count(part), count(part) / words, top, count(part, best[part]), count(part, best[part]) / words,
        distinct, count(strong), count(strong) / words, count(insult), count(insult) / words, count(near), count(near) / words, per_doc(_UPPER[data]) / size, count(shout) / words,
        per_doc(data == 33) / size, per_doc(common._MARK[data]) / size, per_doc(_DIGIT[data]) / size,
        np.bincount(ld[mixed], minlength=n) / words + np.bincount(ld[hidden], minlength=n), per_doc(same) / size,
    ], 1).astype(np.float32)


# ------------------------------------------------------------------- the trees


class Trees:
    """Boosted trees of fixed depth for a 0/1 target, over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0):
        self.depth, self.rate = depth, rate
        mean = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        q = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)  # value > cut: to the right
        width = bins + 1
        margin = np.full(len(y), self.base)
        self.split, self.leaf = [], []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (y - p), w * p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(depth):
                k = 1 << level
                at = ((node[:, None] * x.shape[1] + np.arange(x.shape[1])) * width + q).ravel()
                shape = (k, x.shape[1], width)
                gs = np.bincount(at, np.repeat(g, x.shape[1]), k * x.shape[1] * width).reshape(shape).cumsum(2)
                hs = np.bincount(at, np.repeat(h, x.shape[1]), k * x.shape[1] * width).reshape(shape).cumsum(2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                for f, c in enumerate(self.cuts):
                    gain[:, f, len(c) :] = -1
                best = gain.reshape(k, -1).argmax(1)
                f, b = best // width, best % width
                tree.append((f, np.array([self.cuts[i][j] if j < len(self.cuts[i]) else np.inf for i, j in zip(f, b, strict=True)])))
                node = node * 2 + (q[np.arange(len(y)), f[node]] > b[node])
            gs, hs = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
            leaf = rate * gs / (hs + l2)
            margin = margin + leaf[node]
            self.split.append(tree)
            self.leaf.append(leaf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree, leaf in zip(self.split, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for f, cut in tree:
                node = node * 2 + (x[rows, f[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(value: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted monotone fit (pool adjacent violators); read between knots by interpolation."""
    order = np.argsort(value, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first and last value
    for v, t, k in zip(value[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([t, k, v, v])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, k2, _, last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * k2) / (p[1] + k2), p[1] + k2, last
    x, f = [], []
    for m, _, lo, hi in pools:
        x += [lo, hi]
        f += [m, m]
    return np.array(x), np.array(f)


class Model:
    def __init__(self, lexicon: np.ndarray, weight: np.ndarray, trees: Trees | None, knots: tuple, constant: float = 0.0):
        self.lexicon, self.weight, self.trees, self.knots, self.constant = lexicon, weight, trees, knots, constant

    def score(self, data: np.ndarray, off: np.ndarray, powers: list) -> np.ndarray:
        if self.trees is None:
            return np.full(len(off) - 1, self.constant)
        margin = self.trees.margin(features(data, off, self.lexicon, self.weight, powers))
        raw = 1 / (1 + np.exp(-margin))
        fitted = np.interp(margin, *self.knots) if len(self.knots[0]) else raw
        return np.clip(fitted + 1e-6 * (raw - 0.5), 0, 1)  # keeps the order inside a pool


# --------------------------------------------------------------------- fitting


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, terms: int = 4000, min_rows: int = 3, calibration_rows: int = 50) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    common.ship(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    constant = n.get(1, 0) / total if total else 0.0
    if len(n) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), None, (), constant)
    share = {k: min(1.0, sample_rows / 2 / v) for k, v in n.items()}
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    chosen = known.where(place < limit).select("doc_id", "toxic", (place / limit).alias("u"))
    # About sample_rows rows of 24 bytes: the documents need no shuffle.
    texts = common.staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")
    lexicon_part, tree_part = F.col("u") < 0.45, F.col("u") < 0.8

    def terms_of(batches):
        from evidra.llm import toxicity as t

        powers: list = []
        for b in common.given(batches):
            data, off = common.column_bytes(b.column("text"))
            toxic = b.column("toxic").to_numpy()
            for i, j in common.blocks(off, 1 << 20):
                _, _, doc, word, begins = t.tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], powers)
                pairs = [(doc[h != 0], h[h != 0]) for h in (word, *begins)]
                d, h = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                keep = np.ones(len(d), bool)
                keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                yield pa.record_batch([pa.array(h[keep].view(np.int64)), pa.array(toxic[i:j][d[keep]].astype(np.int32))], names=["term", "toxic"])

    sizes = {r.toxic: r.n for r in texts.where(lexicon_part).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    least = max(min_rows, n1 // 400)
    counted = texts.where(lexicon_part).mapInArrow(terms_of, "term long, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    top = counted.where(F.col("a") >= least).withColumn("odds", odds).where(F.col("odds") > 1.2).orderBy(F.desc(F.col("odds") * F.log1p("a")), "term").limit(terms).collect()
    lexicon = np.array([r.term for r in top], np.int64).view(np.uint64)
    order = np.argsort(lexicon)
    lexicon, weight = lexicon[order], np.array([r.odds for r in top])[order] if top else np.zeros(0)

    def rows_of(batches):
        from evidra.llm import toxicity as t

        powers: list = []
        for b in common.given(batches):
            data, off = common.column_bytes(b.column("text"))
            for i, j in common.blocks(off, 1 << 20):
                x = t.features(data[off[i] : off[j]], off[i : j + 1] - off[i], lexicon, weight, powers)
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), b.column("toxic").slice(i, j - i), b.column("u").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "toxic", "u", "x"])

    got = texts.where(~lexicon_part).mapInArrow(rows_of, "doc_id long, toxic int, u double, x binary").collect()  # under sample_rows rows of FEATURES numbers
    got.sort(key=lambda r: (r.u, r.doc_id))
    if len({r.toxic for r in got}) < 2:
        return Model(lexicon, weight, None, (), constant)
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), FEATURES)
    y = np.array([r.toxic for r in got], float)
    w = np.where(y == 1, 1 / share[1], 1 / share[0])
    w = w / w.mean()
    first = np.array([r.u < 0.8 for r in got])
    if len(set(y[first])) < 2 or len(set(y[~first])) < 2 or (~first).sum() < calibration_rows:
        first[:] = True
    trees = Trees(x[first], y[first], w[first])
    rest = ~first if not first.all() else first
    return Model(lexicon, weight, trees, isotonic(trees.margin(x[rest]), y[rest], w[rest]) if not first.all() else (np.zeros(0), np.zeros(0)), constant)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5)."""
    common.ship(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand terms and small trees

    def run(batches):
        powers: list = []
        for b in common.given(batches):
            data, off = common.column_bytes(b.column("text"))
            got = [sent.value.score(data[off[i] : off[j]], off[i : j + 1] - off[i], powers) for i, j in common.blocks(off)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """A model from the labels of the tables, without the held-out fifth."""
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod("doc_id", 5) != 0)
    return fit(docs, labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, trained(spark, sf_dir, docs)).select("doc_id", F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
