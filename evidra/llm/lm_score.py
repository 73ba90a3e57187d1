"""Language-model scoring by masked pseudo-likelihood.

A small bidirectional window network, written in numpy, predicts a word from
the two words on each side: the embeddings of the four places are added,
passed through tanh, and a two-level softmax gives the class of the word and
the word inside its class.  A document's score is the sum over all its words
of the log-probability of each one given both sides.

Vocabulary: words are counted over the whole corpus; the most frequent get ids
of their own in the network, all others share ``rest`` ids by hash.  A word
that shares an id has the probability of the id times its own share of the
count of all words with that id.  The probabilities of all words of the corpus
sum to one.  The counts of the most frequent of these words (``known_words`` at
most, 12 bytes each) are sent to every task; the counts of all others stay a
table: each block of texts sends its distinct rare words to them and gets their
counts back, so the model holds every word of the corpus, however many.
Training: every scan partition takes one pass of gradient steps over all its
documents from the same start, predicting every place once from its context,
and the parameters are averaged by tokens, in two rounds of sums over chunks of
the parameters, so that no task and not the driver holds more than a part of
them times the square root of the number of partitions.

A word that was not counted (a text outside the corpus) is scored like one that
occurred once.  Training depends on how the scan is split (one pass for each
partition, averaged): equal files and settings give equal scores.

Nulls: a null text, or one without words, has 0 words, log-probability 0 and
no mean.  Repeated rows get equal scores and count as often as they occur.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASSES, MEMBERS, WIDTH, SIDES = 32, 32, 16, (-2, -1, 1, 2)
VOCABULARY = CLASSES * MEMBERS
CHUNKS = 32
STEP = 8192


class Network:
    """Parameters in one array; the views below share its memory."""

    SHAPES = {"embed": (len(SIDES), VOCABULARY + 1, WIDTH), "hidden": (WIDTH,), "classes": (WIDTH, CLASSES), "class_bias": (CLASSES,), "members": (CLASSES, WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS)}
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.flat = np.zeros(self.SIZE, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            setattr(self, name, self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        if flat is None:
            rng = np.random.default_rng(7)
            self.embed[:] = rng.normal(0, 0.1, self.embed.shape)
            self.classes[:] = rng.normal(0, 0.1, self.classes.shape)
            self.members[:] = rng.normal(0, 0.1, self.members.shape)
            if counts is not None:  # start from the word frequencies
                p = (counts + 1.0).reshape(CLASSES, MEMBERS)
                self.class_bias[:] = np.log(p.sum(1) / p.sum())
                self.member_bias[:] = np.log(p / p.sum(1, keepdims=True))

    def forward(self, context: np.ndarray, word: np.ndarray, back: bool = False):
        """Log-probabilities of words (sorted by class) given rows of four context ids; with ``back`` what the gradient needs."""
        h = self.hidden + sum(self.embed[k][context[:, k]] for k in range(len(SIDES)))
        np.tanh(h, out=h)
        cls, rows = word // MEMBERS, np.arange(len(word))
        a = h @ self.classes + self.class_bias
        a -= a.max(1, keepdims=True)
        ea = np.exp(a)
        za = ea.sum(1)
        b = np.empty((len(word), MEMBERS), np.float32)
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for c in range(CLASSES):
            s, e = cuts[c], cuts[c + 1]
            if s < e:
                np.matmul(h[s:e], self.members[c], out=b[s:e])
                b[s:e] += self.member_bias[c]
        b -= b.max(1, keepdims=True)
        member = word % MEMBERS
        eb = np.exp(b)
        zb = eb.sum(1)
        logp = a[rows, cls] - np.log(za) + b[rows, member] - np.log(zb)
        return (logp, h, ea / za[:, None], eb / zb[:, None], cls, member, cuts) if back else logp

    def train(self, context: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One gradient step on a batch (sorted by class)."""
        _, h, pa_, pb, cls, member, cuts = self.forward(context, word, True)
        rows, n = np.arange(len(word)), len(word)
        pa_[rows, cls] -= 1
        pb[rows, member] -= 1
        gh = pa_ @ self.classes.T
        for c in range(CLASSES):
            s, e = cuts[c], cuts[c + 1]
            if s < e:
                gh[s:e] += pb[s:e] @ self.members[c].T
                k = rate / (e - s + 32)
                self.members[c] -= k * (h[s:e].T @ pb[s:e])
                self.member_bias[c] -= k * pb[s:e].sum(0)
        self.classes -= rate / n * (h.T @ pa_)
        self.class_bias -= rate / n * pa_.sum(0)
        gh *= 1 - h * h
        self.hidden -= rate / n * gh.sum(0)
        for k in range(len(SIDES)):
            order = np.argsort(context[:, k], kind="stable")  # 16 bits: a radix sort
            ids = context[order, k]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            size = np.diff(np.append(first, n))
            self.embed[k][ids[first]] -= rate * np.add.reduceat(gh[order], first) / (size + 32)[:, None]


def places(data: np.ndarray, off: np.ndarray, names: np.ndarray, ids: np.ndarray, rest: int, powers: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word ids, context ids, document, hash) of every word; ``names``: sorted hashes of the words with ids of their own."""
    _, _, doc, h = common.hashed_words(data, off, common.ALNUM, powers)
    if len(names):
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        own = names[at] == h
    else:
        at, own = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    word = np.where(own, ids[at] if len(ids) else 0, VOCABULARY - rest + (h % np.uint64(rest)).astype(np.int64))
    # Two places without a word between documents.
    line = np.full(len(word) + 2 * (len(off) + 1), VOCABULARY, np.uint16)
    at = np.arange(len(word)) + 2 * (doc + 1)
    line[at] = word
    return word.astype(np.uint16), np.stack([line[at + k] for k in SIDES], 1), doc, h


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): hash and number of every distinct word of the corpus."""
    common.ship(docs.sparkSession)

    def counted(got):
        h, n = (np.concatenate(x) for x in zip(*got, strict=True))
        h, at = np.unique(h, return_inverse=True)
        return h, np.bincount(at, n).astype(np.int64)

    def run(batches):
        powers, got, held = [], [], 0
        for b in common.given(batches):
            data, off = common.column_bytes(b.column("text"))
            for i, j in common.blocks(off):
                h = common.hashed_words(data[off[i] : off[j]], off[i : j + 1] - off[i], common.ALNUM, powers)[3]
                got.append(np.unique(h, return_counts=True))
                held += len(got[-1][0])
            if held > 500_000:  # merged, and handed on where many stay different
                got = [counted(got)]
                held = len(got[0][0])
                if held > 250_000:
                    yield pa.record_batch([pa.array(got[0][0].view(np.int64)), pa.array(got[0][1])], names=["word", "n"])
                    got, held = [], 0
        if got:
            h, n = counted(got)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """``words``: the counts of all words, a table; ``counts``: of each id of the network; ``known``: sorted hashes and counts of the frequent words."""

    def __init__(self, counts: DataFrame, rest: int = 256, known_words: int = 65_536):
        own = VOCABULARY - rest
        self.words = common.staged(counts, "words")
        top = self.words.orderBy(F.desc("n"), "word").limit(own).collect()  # at most VOCABULARY rows

        def shared(batches):
            total = np.zeros(rest, np.int64)
            for b in common.given(batches):
                np.add.at(total, (b.column("word").to_numpy().view(np.uint64) % np.uint64(rest)).astype(np.int64), b.column("n").to_numpy())
            yield pa.record_batch([pa.array(range(rest), pa.int32()), pa.array(total)], names=["id", "n"])

        h = np.array([r.word for r in top], np.int64).view(np.uint64)
        order = np.argsort(h)
        self.rest, self.names, self.ids = rest, h[order], order.astype(np.int64)
        self.counts = np.zeros(VOCABULARY)
        self.counts[: len(top)] = [r.n for r in top]
        for r in self.words.mapInArrow(shared, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # ``rest`` rows
            self.counts[own + r.id] = r.n
        np.subtract.at(self.counts, own + (h % np.uint64(rest)).astype(np.int64), self.counts[: len(top)])
        # Words by eighths of a doubling of their count, a few hundred rows: as many of the highest as may be sent.
        level = F.floor(F.log2("n") * 8).cast("int")
        least, room = None, known_words
        for r in self.words.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():
            room -= r.k
            if room < 0:
                break
            least = r.level
        got = self.words.where(level >= least).toArrow() if least is not None else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        word, n = (got.column(c).to_numpy() for c in ("word", "n"))
        order = np.argsort(word.view(np.uint64))
        self.known = word.view(np.uint64)[order], np.log(n[order]).astype(np.float32)


def train(docs: DataFrame, vocabulary: Vocabulary, rate: float = 1.5, masked: int = 1) -> Network:
    """The average of one pass of gradient steps over every partition; one place in ``masked`` is predicted."""
    common.ship(docs.sparkSession)
    start = Network(counts=vocabulary.counts).flat
    known = vocabulary.names, vocabulary.ids, vocabulary.rest

    def local(batches):
        from pyspark import TaskContext

        from evidra.llm import lm_score as m

        net, powers, seen, rng = m.Network(start), [], 0, np.random.default_rng(TaskContext.get().partitionId())
        for b in common.given(batches):
            data, off = common.column_bytes(b.column("text"))
            for i, j in common.blocks(off):
                word, context, _, _ = m.places(data[off[i] : off[j]], off[i : j + 1] - off[i], *known, powers)
                seen += len(word)
                chosen = rng.permutation(np.flatnonzero(common.mix(np.arange(len(word), dtype=np.uint64) + np.uint64(seen)) % np.uint64(masked) == 0))
                for s in range(0, len(chosen), m.STEP):
                    part = chosen[s : s + m.STEP]
                    part = part[np.argsort(word[part], kind="stable")]
                    net.train(context[part], word[part], rate)
        if seen:
            parts = np.array_split(net.flat.astype(np.float64) * seen, m.CHUNKS)
            k = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(range(m.CHUNKS), pa.int32()), pa.array([k] * m.CHUNKS, pa.int32()), pa.array([float(seen)] * m.CHUNKS), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["chunk", "part", "n", "sum"])

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(0)
        for x in rows.column("sum"):
            one = np.frombuffer(x.as_buffer(), np.float32)
            total = one.astype(np.float64) if not len(total) else total + one
        n = float(np.sum(rows.column("n").to_numpy()))
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "n": pa.array([n]), "sum": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    models = common.staged(docs.select("text").mapInArrow(local, "chunk int, part int, n double, sum binary"), "models")
    group = max(1, math.isqrt(models.agg(F.count("*").alias("n")).first().n // CHUNKS))
    some = models.withColumn("group", F.col("part") % group).drop("part").groupBy("chunk", "group").applyInArrow(added, "chunk int, n double, sum binary")
    got = sorted(some.groupBy("chunk").applyInArrow(added, "chunk int, n double, sum binary").collect())  # CHUNKS rows
    return Network(np.concatenate([np.frombuffer(bytes(r["sum"]), np.float32) / r.n for r in got]) if got else start)


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob): every word of every text is predicted once."""
    common.ship(docs.sparkSession)
    known = vocabulary.names, vocabulary.ids, vocabulary.rest
    of_ids = np.log(np.maximum(vocabulary.counts[VOCABULARY - vocabulary.rest :], 1))
    sent = docs.sparkSession.sparkContext.broadcast((network.flat, *vocabulary.known))  # SIZE numbers, and 12 bytes for each known word

    def run(batches):
        """For each block: a row without a word, with its documents and what the network says of them; and one for each distinct word that shares an id, with the documents of its places."""
        from pyspark import TaskContext

        from evidra.llm import lm_score as m

        flat, frequent, log_n = sent.value
        net, powers, number = m.Network(flat), [], TaskContext.get().partitionId() << 32
        for b in common.given(batches):
            data, off = common.column_bytes(b.column("text"))
            for i, j in common.blocks(off):
                word, context, doc, h = m.places(data[off[i] : off[j]], off[i : j + 1] - off[i], *known, powers)
                order = np.argsort(word, kind="stable")
                logp = np.empty(len(word), np.float64)
                for s in range(0, len(order), m.STEP):
                    part = order[s : s + m.STEP]
                    logp[part] = net.forward(context[part], word[part])
                n, total = np.bincount(doc, minlength=j - i), np.bincount(doc, logp, j - i)
                ids = b.column("doc_id").slice(i, j - i).cast(pa.int64())
                shared = np.flatnonzero(word >= m.VOCABULARY - known[2])
                if len(shared) and len(frequent):
                    distinct, at = np.unique(h[shared], return_inverse=True)
                    place = np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)
                    here = frequent[place] == distinct
                    gain = np.where(here, log_n[place] - of_ids[(distinct % np.uint64(known[2])).astype(np.int64)], 0)
                    total = total + np.bincount(doc[shared], gain[at], j - i)
                    shared = shared[~here[at]]
                yield m.block_rows(number, [None], [m.packed(ids, n, total)])
                if len(shared):
                    shared = shared[np.argsort(h[shared], kind="stable")]
                    first = np.flatnonzero(np.append(True, h[shared][1:] != h[shared][:-1]))
                    to = np.append(first, len(shared)).astype(np.int32) * 4
                    at = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(to.tobytes()), pa.py_buffer(doc[shared].astype(np.int32).tobytes())])
                    yield m.block_rows(number, h[shared][first].view(np.int64), at)
                number += 1

    def whole(rows: pa.Table) -> pa.Table:
        from evidra.llm import lm_score as m

        word = rows.column("word").combine_chunks()
        ids, n, total = m.unpacked(rows.column("at").filter(word.is_null())[0].as_py())
        rows = rows.filter(word.is_valid())
        if rows.num_rows:
            h, times = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()
            gain = np.log(times) - of_ids[(h % np.uint64(known[2])).astype(np.int64)]
            at = rows.column("at").to_pylist()
            total = total + np.bincount(np.frombuffer(b"".join(at), np.int32), np.repeat(gain, [len(x) // 4 for x in at]), len(n))
        return pa.table({"doc_id": ids, "n_words": pa.array(n), "log_prob": pa.array(total), "mean_log_prob": pa.array(total / np.maximum(n, 1), mask=n == 0)})

    blocks = common.staged(docs.select("doc_id", "text").mapInArrow(run, "block long, word long, at binary"), "scored")
    counted = blocks.where("word is not null").join(vocabulary.words, "word", "left").select("block", "word", "at", F.coalesce("n", F.lit(1)).alias("n"))
    rows = counted.unionByName(blocks.where("word is null").withColumn("n", F.lit(0).cast("long")))
    return rows.groupBy("block").applyInArrow(whole, "doc_id long, n_words long, log_prob double, mean_log_prob double")


def block_rows(block: int, word, at) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(word), block, np.int64)), pa.array(word, pa.int64()), at if isinstance(at, pa.Array) else pa.array(at, pa.binary())], names=["block", "word", "at"])


def packed(ids: pa.Array, n: np.ndarray, total: np.ndarray) -> bytes:
    """The documents of a block: id, whether it is null, words and log-probability of each."""
    return b"".join([ids.fill_null(0).to_numpy().tobytes(), n.astype(np.int64).tobytes(), total.tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes()])


def unpacked(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    k = len(raw) // 25
    ids, n, total = (np.frombuffer(raw, kind, k, 8 * k * at) for at, kind in enumerate((np.int64, np.int64, np.float64)))
    return pa.array(ids, mask=np.frombuffer(raw, bool, k, 24 * k)), n, total


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    vocabulary = Vocabulary(count_words(docs))
    return score(docs, vocabulary, train(docs, vocabulary))
