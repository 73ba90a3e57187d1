"""The extractor chain, heads, similar vectors and small sources against hand-made cases and brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import claims, heads, registry, vectors
from evidra.sources import files

RULES = claims.Rules(
    tasks={"coding": ("code", "repo"), "writing": ("essay",)}, aspects={"trust": ("reliable", "made up"), "regression": ("regressed", "got worse")},
    positive=("reliable", "better"), negative=("regressed", "worse", "made up"),
    flags={"firsthand": ("i used",), "comparative": ("better than", "compared"), "regression": ("regressed", "got worse"), "release": ("release",), "benchmark": ("leaderboard",)},
)
ITEM = "source_item_id string, platform string, title string, body string, is_root_story boolean, engagement map<string,double>"


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([("fox one", "fox-1", "p1"), ("owl", "owl", "p2")], "alias string, model_id string, provider_id string")


def observed(spark, catalog, *rows):
    df = spark.createDataFrame([(str(k), "reddit", *r) for k, r in enumerate(rows)], ITEM)
    return claims.observations(df, catalog, RULES).orderBy("source_item_id", "model_id").collect()


def test_observations(spark, catalog):
    got = observed(
        spark, catalog,
        ("", "I used Fox One for code and it regressed badly.", False, {"score": 10.0}),  # firsthand, negative, regression
        ("Nothing", "I used it and it got worse.", False, None),  # names nothing
        ("Fox One thoughts", "It regressed since May.", False, None),  # the title names it
        ("", "Owl release is out.", False, None),  # release only: excluded
        ("", "Is Fox One any good?", False, None),  # a question only
        ("", "> Fox One regressed. But owl is better than before.", False, None),  # a quote is cut off
        (None, None, None, None),
    )
    assert [(r.source_item_id, r.model_id) for r in got] == [("0", "fox-1"), ("2", "fox-1"), ("5", "owl")]
    a, b, c = got
    assert (a.polarity, a.evidence_type, a.claim_type, a.task, a.aspect_category, a.firsthand_flag) == (-1, "bug_regression_report", "complaint", "coding", "regression", True)
    assert a.weight == pytest.approx(1.25 * (1 + np.log1p(10) / 20)) and b.weight == 0.75 and b.span.startswith("Fox One thoughts. It regressed")
    assert c.evidence_type == "comparative_evaluation" and ">" not in c.span


def test_best_span_of_a_claim_and_cap(spark, catalog):
    body = "Owl is better. " + "Owl got worse compared with fox one in my repo and it made up things. " * 2
    got = observed(spark, catalog, ("", body, False, None))
    assert len({(r.model_id, r.evidence_type) for r in got}) == len(got) >= 2
    df = spark.createDataFrame([("x", "reddit", "", body, False, None)], ITEM)
    assert claims.observations(df, catalog, RULES, most=1).count() == 1


def test_texts():
    assert "my" not in T.FIRST_PERSON.split("|") and "found" in T.USAGE_VERBS.split("|")


def test_text_steps(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    assert [row(T.is_firsthand(F.lit(x)))[0] for x in ("We've migrated to it", "my dog", "Works in production.", "they used it", "I really would never even try it", None)] == [True, False, True, False, True, False]
    assert row(T.strip_html(F.lit("a<br>&eacute;&nbsp;&#233;&amp;lt;")))[0] == "a é\xa0é&lt;"
    issue = "## Steps\nkeep this\n- [x] done\n### owl heading\nExpected behavior: none\n```\ncode\n``` tail <!-- no -->"
    assert row(T.cleaned(F.lit("issues"), F.lit(issue), "owl"))[0] == "keep this ### owl heading tail"
    assert row(T.cleaned(F.lit("forum"), F.lit("see https://a.b/c now")))[0] == "see now"
    assert row(T.low_signal_title(F.lit(" Docs: typo")), T.low_signal_title(F.lit("Owl docs: fine")))[:] == (True, False)


def test_typed_rows_and_coverage(spark):
    df = spark.createDataFrame([("1", "nowhere", "TRUE", "2"), (None, "github", "yes", "x")], "source_item_id string, source_platform string, firsthand_flag string, polarity_score string")
    a, b = registry.typed(df).orderBy(F.desc("source_item_id")).collect()
    assert (a.source_platform, a.firsthand_flag, a.weights.firsthand_weight, a.polarity_score, a.task_category) == ("hacker_news", True, 1.25, 2, "general")
    assert (b.source_item_id, b.source_platform, b.firsthand_flag, b.weights.firsthand_weight, b.polarity_score) == ("", "github", False, 0.75, 0)
    reg = registry.flattened(spark.createDataFrame([("p", [("A-1", None)])], "id string, models array<struct<id:string,display_name:string>>"))
    rows = spark.createDataFrame([("a-1", None), ("b-2", "Q"), ("", "Q"), ("fam", None)], "model string, provider string")
    got = {(r.kind, r.value): r.n for r in registry.coverage(rows, reg, {}).collect()}
    assert got == {("status", "registry"): 1, ("status", "versioned_unregistered"): 1, ("status", "unknown"): 1, ("status", "unversioned"): 1, ("unspecified", "q"): 1, ("unspecified", "unknown"): 1, ("unregistered", "b-2"): 1}


@pytest.mark.parametrize("seed, block", [(1, 2048), (5, 17)])
def test_similar_pairs(spark, seed, block, monkeypatch):
    monkeypatch.setattr(vectors.neighbours, "BLOCK", block)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 6))
    v = [*(base[rng.integers(12)] + rng.normal(size=6) * 0.3 for _ in range(120)), base[0], base[0], np.zeros(6)]
    rows = [(k, [float(x) for x in y]) for k, y in enumerate(v)] + [(900, []), (901, None), (902, [1.0, 2.0])]
    got = vectors.similar_pairs(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 0.9).collect()
    links, classes = [(r.a, r.b) for r in got if r.kind == "link"], {r.b: r.a for r in got if r.kind == "class"}
    unit = {k: y / np.linalg.norm(y) for k, y in enumerate(v) if k != 122}
    reps = sorted({classes[k] for k in unit})
    want = {(a, b) for a in reps for b in reps if a < b and unit[a] @ unit[b] >= 0.9}
    assert set(links) == want and len(links) == len(want) and classes[121] == 120 and 901 not in classes
    assert vectors.similar_pairs(spark.createDataFrame([], "k long, v array<double>"), "k", "v", 0.9).count() == 0


def test_text_head(spark, tmp_path):
    rng = random.Random(1)
    words = {"a": "red green blue".split(), "b": "one two three".split(), "c": "cat dog cow".split()}
    rows = [(k, " ".join(rng.choice(words[c]) for _ in range(6)), c) for k, c in enumerate(rng.choices("aab" + "c", k=160))] + [(900, None, None), (901, "red", None)]
    df = spark.createDataFrame(rows, "k long, t string, y string")
    model = heads.tfidf_head(df.where("k % 4 <> 0"), "t", "y")
    heads.saved(model, f"{tmp_path}/m")
    got = heads.predicted(heads.loaded(f"{tmp_path}/m"), df, "t").where("k % 4 = 0").collect()
    assert len(got) == df.where("k % 4 = 0").count() and np.mean([r.y == r.predicted for r in got if r.y]) > 0.95 and all(0 < r.confidence <= 1 for r in got)
    one = heads.predicted(heads.tfidf_head(df.where("y = 'a'"), "t", "y"), df, "t").first()
    assert (one.predicted, one.confidence) == ("a", 1.0)


def test_hierarchical_head(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.eye(4)[k % 4] * 3 + rng.normal(size=4) * 0.2], "abcd"[k % 4]) for k in range(80)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y string")
    got = heads.hierarchical(df.where("k % 3 <> 0"), df, "v", "y", {"a": "g", "b": "g", "c": "h", "d": "h"}, "k").collect()
    assert len(got) == 80 and np.mean([r.predicted == r.y for r in got]) > 0.95 and {r.predicted_group for r in got} == {"g", "h"}


def test_comments_and_methodology(spark, tmp_path):
    issues = spark.createDataFrame([(7, "T", None, "u", "x", "/repos/o/r", ("me",), [], 0, None, None), (8, "P", None, "u", "x", None, None, [], 0, None, ("z",))], files.ISSUE_SCHEMA)
    comments = spark.createDataFrame([(1, 7, "hi", None, "2024-01-02T03:04:05Z", "x", (5, "me"), None), (2, 8, "no", None, None, None, None, None)], files.COMMENT_SCHEMA)
    (row,) = files.comment_items(comments, issues).collect()
    assert (row.source_id, row.title, row.body, row.url, row.community_id, row.thread_id, row.author, row.engagement) == ("1", "T", "hi", "u", "o/r", "7", "5", {"reactions": 0.0})
    for n in ("one", "two"):
        (tmp_path / f"{n}.json").write_text(json.dumps({"fields": {n: 1}}))
    (m,) = files.methodology(spark, [f"{tmp_path}/one.json", f"{tmp_path}/two.json"], {"aspect": 0.7}, 300).collect()
    assert m.examples == 300 and m.gates == {"aspect": 0.7} and json.loads(m.artifacts["one"])["fields"] == {"one": 1}


def test_issue_payloads(spark):
    rows = [(7, "T", "B", "u", "2024-01-02T03:04:05Z", "https://api/repos/o/r", ("me",), [("bug",), ("slow",)], 3, (5,), None), (8, "P", None, "u", "x", None, None, None, None, None, ("z",)), (9, None, None, "u", "2024-01-02T03:04:05Z", None, None, [], None, None, None)]
    got = {r.source_id: r for r in files.issue_items(spark.createDataFrame(rows, files.ISSUE_SCHEMA)).collect()}
    assert set(got) == {"7", "9"} and (got["7"].community_id, got["7"].labels, got["7"].engagement) == ("o/r", ["bug", "slow"], {"comments": 3.0, "reactions": 5.0})
    assert (got["9"].community_id, got["9"].title, got["9"].engagement) == ("github", "", {"comments": 0.0, "reactions": 0.0})


def test_review_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'two "words",\nand a line', None), ("2", "", "x")], "review_id string, evidence_text string, human_notes string")
    files.write_review_csv(df, f"{tmp_path}/c", ["review_id", "human_notes", "evidence_text", "human_task_category"])
    got = files.read_review_csv(spark, f"{tmp_path}/c").fillna("").orderBy("review_id").collect()
    assert [tuple(r) for r in got] == [("1", "", 'two "words",\nand a line', ""), ("2", "x", "", "")]


def test_snapshot_reload_is_idempotent(spark, tmp_path):
    at, df = f"{tmp_path}/s", spark.createDataFrame([("m", 1.0)], "model_id string, score double")
    files.write_snapshot(df, at, "a")
    files.write_snapshot(df, at, "b")
    files.write_snapshot(df.withColumn("score", F.lit(2.0)), at, "a")
    assert {(r.snapshot_id, r.score) for r in spark.read.parquet(at).collect()} == {("a", 2.0), ("b", 1.0)}


def test_jsonl_schema_is_not_changed(spark, tmp_path):
    from pyspark.sql import types

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n')
    schema = types.StructType([types.StructField("a", types.LongType())])
    for _ in range(2):
        got = files.read_jsonl(spark, f"{tmp_path}/x.jsonl", schema).collect()
        assert [r.a for r in got] == [1, None] and got[1]._corrupt_record == "broken" and schema.names == ["a"]


def test_homonyms_by_their_surroundings(spark, catalog):
    from evidra.operators import linking

    df = spark.createDataFrame([(1, "owl " + "x" * 100 + " bird"), (2, "an owl, that bird"), (3, "owl")], "k long, t string")
    found = linking.mentions(df, catalog.withColumn("generic", F.lit(False)), "k", "t")
    kept = linking.in_context(found, df, "k", "t", spark.createDataFrame([("owl", "bird")], "alias string, signal string"))
    assert sorted(r.k for r in found.collect()) == [1, 2, 3] and sorted(r.k for r in kept.collect()) == [1, 3]


def test_window_counts_of_a_stream(spark, tmp_path):
    from evidra.streaming import extract as stream

    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-02 00:00:00", "c")]
    spark.createDataFrame(rows, "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").coalesce(1).write.parquet(f"{tmp_path}/in")
    items = stream.read_items(spark, f"{tmp_path}/in", "ts timestamp, k string", "parquet")
    stream.append(items, lambda s: stream.window_counts(s, "k").select(F.col("window.start").alias("start"), "k", "n"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    got = {(str(r.start), r.k): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("2024-01-01 00:00:00", "a"): 2, ("2024-01-01 01:00:00", "b"): 1}  # the last window is still open
