"""The index, components and greedy clusters against plain loops."""

import math
import random

import numpy as np
import pytest

from evidra.operators import graph, greedy, neighbours, staging


def plain_greedy(rows, least):
    """One pass in order: the row's best cluster so far, or a new one."""
    means, firsts, sizes, out = [], [], [], {}
    for key, v in rows:
        if not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = np.array(v)
        best, score = -1, -1.0
        for i, m in enumerate(means):
            n = np.linalg.norm(m) * np.linalg.norm(v)
            s = float(m @ v / n) if len(m) == len(v) and n else 0.0
            if s > score:
                best, score = i, s
        if best >= 0 and score >= least:
            sizes[best] += 1
            means[best] = (means[best] * (sizes[best] - 1) + v) / sizes[best]
            out[key] = firsts[best], round(score, 9)
        else:
            means.append(v), firsts.append(key), sizes.append(1)
            out[key] = key, 1.0
    return out


def vectors(n, dims=16, seed=3):
    """Clusters with blurred borders, copies, one hot group of near copies, lone vectors, and odd rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 40, dims))
    rows = []
    for k in range(n):
        if k % 3 == 0:
            v = centres[0] + rng.normal(size=dims) * 0.02
        elif k % 3 == 1:
            v = centres[rng.integers(len(centres))] * rng.uniform(0.5, 2) + rng.normal(size=dims) * rng.choice([0.0, 0.2, 0.35, 0.5])
        else:
            v = rng.normal(size=dims)
        rows.append((k, v.tolist()))
    return rows + [(n, None), (n + 1, []), (n + 2, [0.0] * dims), (n + 3, [0.0] * dims), (n + 4, [1.0, 2.0]), (n + 5, [2.0, 4.0]), (n + 6, [float("nan")] * dims), (n + 7, [None] * dims)]


@pytest.mark.parametrize("target, hot, parts", [(1 << 20, 20_000, 3), (64, 100, 7)])
def test_greedy_clusters_equal_one_pass(spark, target, hot, parts, monkeypatch):
    monkeypatch.setattr(greedy, "CHUNK", 64)
    rows = vectors(2000)
    random.Random(1).shuffle(rows)
    places = {k: p for p, (k, _) in enumerate(rows)}
    df = spark.createDataFrame([(k, places[k], v) for k, v in rows], "id long, place int, v array<double>").repartition(parts, "id")
    want = plain_greedy(rows, 0.92)
    got = {r.key: (r.cluster, round(r.similarity, 9)) for r in greedy.clusters(df, "id", "v", "place", 0.92, recall=0.999, target=target, hot=hot).collect()}
    assert got.keys() == want.keys()
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert max(abs(got[k][1] - want[k][1]) for k in want) < 1e-6
    assert greedy.clusters(df.where("false"), "id", "v", "place").isEmpty()


def test_clusters_are_numbered_as_opened(spark):
    df = spark.createDataFrame([(5, 0, [1.0, 0.0]), (1, 1, [0.99, 0.01]), (9, 2, [0.0, 1.0])], "id long, place int, v array<double>")
    got = greedy.numbered(greedy.clusters(df, "id", "v", "place", 0.95), df, "id", "place").collect()
    assert sorted((r.key, r.cluster, r.number, round(r.similarity, 6)) for r in got) == [(1, 5, 1, 0.999949), (5, 5, 1, 1.0), (9, 9, 2, 1.0)]


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"path": [(k, k + 1) for k in range(200)], "star": [(500, k) for k in range(300)], "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "none": [(3, 3)]}[kind]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_links_with_and_without_signs(spark, monkeypatch):
    """All similar pairs in full comparison and in blocks; nine of ten at least by signs; a forest connects the same rows."""
    rows = vectors(600)
    units, members = neighbours.classes(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    units = units.cache()
    plain = {r.id: np.array(r.unit) for r in units.collect()}
    ids = sorted(plain)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(plain[a]) == len(plain[b]) and plain[a] @ plain[b] >= 0.8}
    found = lambda **k: {(r.a, r.b) for r in neighbours.links(units, 0.8, **k).collect()}
    assert found(tables=1, bits=0) == want
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    assert found(tables=1, bits=0) == want
    by_signs = found(tables=neighbours.plan(600, 0.8, 0.95, 64)[0], bits=4)
    assert by_signs <= want and len(by_signs) >= 0.9 * len(want)
    name = lambda edges: {frozenset(x) for x in _sets(edges)}
    assert name(found(tables=1, bits=0, forest=True)) == name(want)
    assert {r.key for r in members.collect()} == {k for k, v in rows if v and any(v) and all(x is not None and x == x for x in v)}


def _sets(edges):
    of = {}
    for a, b in edges:
        joined = of.get(a, {a}) | of.get(b, {b})
        for x in joined:
            of[x] = joined
    return list(of.values())


def test_nearest_of_other_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8).tolist(), None if k % 50 == 0 else k % 7) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    units, _ = neighbours.classes(df, "id", "v")
    got = {}
    for r in neighbours.nearest(units.join(df.select("id", "g"), "id"), "g", 3, 1, 0).collect():
        got[r.id, r["rank"]] = r.other
    m = np.array([v for _, v, _ in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    for k, _, g in rows:
        order = [j for j in np.argsort(-s[k], kind="stable").tolist() if j != k and (g is None or rows[j][2] != g)]
        assert [got[k, i + 1] for i in range(3)] == order[:3]


def test_label_features_hide_own_and_held_out_groups(spark):
    """Two clusters whose labels follow the vector; one row's thread mates and the rows that are not searched have a label of their own."""
    rows = [(k, [1.0 + 0.01 * k, float(k % 2) * 5, 0.3], k // 4, "ab"[k % 2], True) for k in range(40)]
    rows += [(100, [1.0, 0.0, 0.3], 0, "own", True), (101, [1.0, 0.0, 0.3], 77, "held", False), (102, [0.0, 0.0, 0.0], 5, "a", True), (103, None, 5, "a", True), (104, [1.0, 5.0, 0.3], None, None, True)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int, l string, train boolean")
    got = {r.id: r for r in neighbours.label_features(df, "id", "v", "g", "l", 5, "train").collect()}
    assert got.keys() == {r[0] for r in rows} - {102, 103}
    for k, _, g, l, _ in rows[:40]:
        assert got[k].neighbours == 5 and "held" not in got[k].shares and (g or "own" not in got[k].shares)
        assert got[k].label == l or not g or "own" in got[k].shares
    assert got[101].shares == {"a": 0.8, "own": 0.2} and got[101].label == "a" and abs(got[101].disagreement - 0.2) < 1e-9
    assert got[104].label == "b" and got[104].max_similarity <= 1 + 1e-9
    alone = neighbours.label_features(df.where("id = 5"), "id", "v", "g", "l").first()
    assert (alone.neighbours, alone.shares, alone.label, alone.share) == (0, None, None, None)


def test_consecutive_numbers(spark):
    df = spark.createDataFrame([(k * 37 % 101, k) for k in range(101)], "o int, k int").repartition(5)
    assert [r.n for r in staging.consecutive(df, ["o"], "n").orderBy("o").collect()] == list(range(101))
    assert staging.consecutive(df.where("false"), ["o"], "n").isEmpty()
