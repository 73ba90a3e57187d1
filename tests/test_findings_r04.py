"""What the review of round 4 found, one small case each."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import dedup, heads, learning, linking, neighbours, vectors
from evidra.operators.staging import cut


def test_text_head_answers_known_labels_only(spark):
    """A text far from all training texts gets one of the labels."""
    rows = [(k, ("red green" if k % 2 else "one two") + f" shared w{k % 5}", k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, t string, y int")
    model = heads.tfidf_head(df, "t", "y", characters=False)
    lr = next(s for s in model.stages if hasattr(s, "numClasses"))
    assert lr.numClasses == 2
    far = spark.createDataFrame([(1, "shared " * 50), (2, ""), (3, None), (4, "one red shared w1 w2 w3 w4")], "k long, t string")
    assert {r.predicted for r in heads.predicted(model, far, "t").collect()} <= {"0", "1"}


def test_sentences_keep_their_digits(spark):
    """The place of a sentence is not a set of characters to trim."""
    df = spark.createDataFrame([("007 0. 11.37.1\n  2 two 2 ",)], "t string")
    assert df.select(T.sentences(F.col("t"))).first()[0] == ["007 0.", "11.37.1", "2 two 2"]


def test_observations_keep_digits_of_sentences(spark):
    """Sentences of an item begin and end with the numbers of their places."""
    from evidra.operators import claims
    from evidra.plans import catalog, chain  # noqa: F401  (the catalog comes first)

    items = spark.createDataFrame([(1, "review", "", "0 for with ich 100. 1 for with ich mit 211. 2 for with ich und 322.", False)], "source_item_id long, platform string, title string, body string, is_root_story boolean")
    names = claims.Names.of(chain.catalog(spark))
    got = {r.place: r.span for r in claims.spans(items, chain.RULES, names).collect()}
    assert got[1] == "0 for with ich 100." and got[3] == "1 for with ich mit 211." and got[5] == "2 for with ich und 322."


def test_trimmed_spans_keep_their_digits(spark):
    df = spark.createDataFrame([("0 preface. 10.1.1.11 is kept. 2 or 2",)], "t string")
    span = T.trimmed_span(T.sentences(F.col("t")), lambda x: x.startswith("0 p"), lambda x: x.endswith("?"))
    assert df.select(span).first()[0] == ["10.1.1.11 is kept.", "2 or 2"]


def _plain_signature(texts):
    votes = [0] * 64
    for t in texts:
        for w in re.findall("[a-z0-9_]+", (t or "").lower()):
            h = int(hashlib.sha256(w.encode()).hexdigest()[:16], 16)
            votes = [v + (1 if h >> (63 - k) & 1 else -1) for k, v in enumerate(votes)]
    return "".join("1" if v > 0 else "0" for v in votes)


def test_simhash_shuffles_no_tokens(spark, monkeypatch):
    """Equal to a plain count, and its one exchange holds a row of sums for each text."""
    rows = [(1, "One two, TWO_3 K İ \xe9t\xe9"), (2, None), (3, "--"), (4, "a b"), (4, "b c a"), (5, "x " * 70_000 + "y")]
    out = dedup.simhash(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert {r.k: r.signature for r in out.collect()} == {k: _plain_signature([t for j, t in rows if j == k]) for k, _ in rows}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
    monkeypatch.setattr(dedup, "WINDOW", 7)
    text = "alpha beta-gamma  delta_9 " * 30
    assert [w for some in dedup._tokens(text) for w in some] == re.findall("[a-z0-9_]+", text)


def _near(n, seed=3):
    """Signatures of which many are close: few bits differ from a handful of texts."""
    rng, out = random.Random(seed), []
    base = [rng.getrandbits(64) for _ in range(4)]
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("block, bands", [(1 << 16, 0), (50, 0), (50, 9)])
def test_signature_pairs_are_found_once(spark, block, bands, monkeypatch):
    """Every pair leaves one cell alone, so found pairs are not made distinct."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    bits = _near(400)
    df = spark.createDataFrame([(k, f"{x:064b}") for k, x in enumerate(bits)], "k long, signature string").repartition(3)
    out = dedup.signature_pairs(df, "k", 6, bands)
    first = {}
    for k, x in enumerate(bits):
        first.setdefault(x, k)
    want = sorted((min(a, b), max(a, b), (x ^ y).bit_count()) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if (x ^ y).bit_count() <= 6)
    assert sorted((r.a, r.b, r.distance) for r in out.collect()) == want and len(want) > 1000
    assert out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].startswith("Project")


def test_near_groups_look_at_pairs_that_unite_only(spark, monkeypatch):
    """Pairs within one group cost no step of their own; groups equal those of all pairs."""
    bits = np.array(_near(3000, 5), np.uint64)
    label, links = np.arange(len(bits)), 0
    for p, q in dedup._close(bits, at := np.arange(len(bits)), at, 6):
        links += len(dedup._united(label, p, q))
    while (label != label[label]).any():
        label = label[label]
    assert links == len(bits) - len(np.unique(label))
    close = np.bitwise_count(bits[:, None] ^ bits[None]) <= 6
    assert (label[np.nonzero(close)[0]] == label[np.nonzero(close)[1]]).all()
    monkeypatch.setattr(dedup, "BLOCK", 700)
    df = spark.createDataFrame([(k, f"{x:064b}") for k, x in enumerate(bits.tolist())], "k long, signature string")
    got = {r.k: r.component for r in dedup.near_groups(df, "k").collect()}
    assert got == {k: int(np.flatnonzero(label == label[k]).min()) for k in range(len(bits))}


def _bayes_rows(spark):
    rng, words = random.Random(2), [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choice(words[: 10 + 7 * (k % 3)]) for _ in range(rng.randrange(9))), "xyz"[k % 3] if k % 11 else None) for k in range(60)] + [(900, "only here only", "q"), (901, None, "x")]
    return spark.createDataFrame(rows, "id long, text string, label string").repartition(3)


def _rounded(df):
    return {r[0]: (r.predicted, round(r.confidence, 9)) for r in df.collect()}


@pytest.mark.parametrize("head", [1, 5, 65_536])
def test_leave_one_out_shuffles_rare_tokens_only(spark, head, monkeypatch):
    """Bags give what tokens give, however many tokens are joined; a key on two rows counts as one text."""
    monkeypatch.setattr(learning, "HEAD", head)
    df = _bayes_rows(spark)
    df = df.unionByName(df.where("id = 7"))
    bag = learning.bags(df, "id", "text", "label")
    got = _rounded(learning.leave_one_out(df, bag, "id", "label"))
    assert got == _rounded(learning.leave_one_out(df, learning.tokens(df, "id", "text", "label"), "id", "label")) and len(got) >= 45
    assert not {"Generate", "Aggregate"} & set(re.findall(r"\w+", bag._jdf.queryExecution().optimizedPlan().toString()))


@pytest.mark.parametrize("head", [1, 5, 65_536])
def test_bayes_scores_shuffle_rare_tokens_only(spark, head, monkeypatch):
    """Scores equal the plain sums, with unknown words and rows that are not in the model."""
    monkeypatch.setattr(learning, "HEAD", head)
    df = _bayes_rows(spark).where("label is not null")
    more = df.unionByName(spark.createDataFrame([(950, "new words w1 w1", None)], df.schema))
    classes, per = learning.fit(df, learning.bags(df, "id", "text", "label"), "label")
    got = _rounded(learning.score(learning.bags(more, "id", "text", "label"), classes, per, "id", "label"))
    rows = {(r.label): (r.rows, r.total) for r in classes.collect()}
    count = {(r.label, r.token): r.n for r in per.collect()}
    v, n = len({t for _, t in count}), sum(r for r, _ in rows.values())
    for r in more.collect():
        words = re.findall(learning.WORD, r.text or "")
        log = {c: math.log((k + 1) / (n + len(rows))) + sum(math.log((count.get((c, w), 0) + 1) / (total + v)) for w in words) for c, (k, total) in rows.items()}
        best = max(log, key=lambda c: (round(log[c], 12), c))
        assert (r.id in got) == bool(words)
        if words:
            assert got[r.id] == (best, round(1 / sum(math.exp(x - log[best]) for x in log.values()), 9))


def test_all_similar_vectors_are_found(spark):
    """More vectors than the index compares in full: every pair is there, once, and vectors of different lengths never meet."""
    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(size=(1500, 8)), rng.normal(size=(30, 8)) * 0.01 + rng.normal(size=8)])
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(9000 + k, x.tolist()) for k, x in enumerate(rng.normal(size=(20, 3)))]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(5)
    got = [(r.a, r.b) for r in vectors.similar_pairs(df, "k", "v", 0.6, recall=1.0).where("kind = 'link'").collect()]
    want = set()
    for part in (range(len(v)), range(len(v), len(rows))):
        u = np.array([rows[k][1] for k in part])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        want |= {(rows[part[i]][0], rows[part[j]][0]) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.6, 1)), strict=True)}
    assert len(got) == len(set(got)) and set(got) == want
    units = cut(neighbours.units(df, "k", "v"))
    small = neighbours.all_links(units, 0.6, 8)
    assert small.count() == len(want)


def test_similar_vectors_asks_for_all_pairs(spark, tmp_path):
    """The registered query finds what its SQL finds beyond the size up to which the index compares all."""
    from evidra.plans import catalog, chain  # noqa: F401

    rng = np.random.default_rng(6)
    v = rng.normal(size=(1300, 12))
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert chain.similar_vectors(spark, str(tmp_path)).where("kind = 'link'").count() == np.triu(u @ u.T >= 0.4, 1).sum()


def test_cues_come_with_mentions(spark):
    """What stands around a mention is cut where it is found: no join with texts, the same mentions."""
    rows = [(1, "Using foo " + "x" * 30 + " foo and \xe9 on foo. in/foo"), (2, "FOO says so on it"), (3, None), (4, "foo"), (5, "on " + "y " * 10 + "foo")]
    items = spark.createDataFrame(rows, "k long, t string")
    catalog = spark.createDataFrame([("foo", "f", "p", False)], "alias string, model_id string, provider_id string, generic boolean")
    got = linking.with_cue(linking.mentions(items, catalog, "k", "t", 24), items, "k", "t", ["on ", "using "], [" says"])
    plain = linking.with_cue(linking.mentions(items, catalog, "k", "t"), items, "k", "t", ["on ", "using "], [" says"])
    assert got.columns == plain.columns and sorted(got.collect()) == sorted(plain.collect()) and got.count() > 1
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(got) == joins(plain) - 1
