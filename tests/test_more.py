import math
from collections import Counter

from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import corrections, intervals, learning, linking, snapshots


def test_leave_one_out_equals_refitting(spark):
    rows = [(1, "aa bb bb", "x"), (2, "bb cc", "x"), (3, "cc cc dd", "y"), (4, "dd aa", "y"), (5, "ee", "z"), (6, "", "y"), (7, "aa dd", None)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    got = {r.id: (r.predicted, round(r.confidence, 9)) for r in learning.leave_one_out(df, learning.tokens(df, "id", "text", "label"), "id", "label").collect()}
    labelled = [(i, t.split(), c) for i, t, c in rows if c is not None]
    want = {}
    for i, words, _ in labelled:
        rest = [x for x in labelled if x[0] != i]
        classes = sorted({c for _, _, c in rest})
        count = {c: Counter(w for _, ws, d in rest if d == c for w in ws) for c in classes}
        v = len({w for c in classes for w in count[c]})
        log = {c: math.log((sum(d == c for _, _, d in rest) + 1) / (len(rest) + len(classes))) + sum(math.log((count[c][w] + 1) / (sum(count[c].values()) + v)) for w in words) for c in classes}
        if words:
            best = max(log, key=lambda c: (round(log[c], 12), c))
            want[i] = (best, round(1 / sum(math.exp(x - log[best]) for x in log.values()), 9))
    assert got == want


def test_calibration_is_monotone_and_absent_for_one_outcome(spark):
    df = spark.createDataFrame([(k / 20, (k * 7 % 20) < k) for k in range(20)] + [(None, True)], "score double, right boolean")
    got = [r.calibrated for r in learning.calibrated(df.where("score is not null"), df, "score", "right").orderBy("score").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1
    assert learning.calibrated(df, df.where("right"), "score", "right").where("calibrated is not null").isEmpty()


def test_trimmed_spans(spark):
    rows = [(["> quoted", "Is it?", "It is.", "Really?"],), (["> a", "> b"],), (["Is it?", "Why?"],), (["Fine."],), ([],), (None,)]
    df = spark.createDataFrame(rows, "s array<string>")
    got = [r[0] for r in df.select(T.trimmed_span(F.col("s"), lambda x: x.startswith(">"), lambda x: x.endswith("?"))).collect()]
    assert got == [["It is."], [], ["Why?"], ["Fine."], [], None]


def test_products_need_a_cue(spark):
    items = spark.createDataFrame([(1, "I run Box in Tool now"), (2, "Tool/Box in here"), (3, "using Box, he said so"), (4, None)], "id int, text string")
    catalog = spark.createDataFrame([("box", "b", "p", False), ("tool", "t", "p", False)], "alias string, model_id string, provider_id string, generic boolean")
    found = linking.with_cue(linking.mentions(items, catalog, "id", "text"), items, "id", "text", ["in ", "using "], [" said"])
    order = spark.createDataFrame([("tool", "T", 0), ("box", "B", 1)], "alias string, entity string, priority int")
    assert [(r.id, r.entity) for r in linking.first_by_priority(found, "id", order).collect()] == [(1, "T")]


def test_rules_between_labels(spark):
    rows = spark.createDataFrame([("hearsay", "t", "a", "true"), ("integration_failure", "t", "a", "true"), (None, "t", None, None)], "evidence string, task string, aspect string, firsthand string")
    got = [(r.task, r.aspect, r.firsthand, r.firsthand_changed) for r in corrections.constrained(rows, "high_purity").collect()]
    assert got == [("t", "a", "false", True), ("api_developer_workflow", "developer_ergonomics", "true", False), ("t", None, None, False)]
    assert [r.firsthand for r in corrections.constrained(rows, "none").collect()] == ["true", "true", None]


def test_interval_of_one_block_is_its_mean(spark):
    rows = spark.createDataFrame([(1, 7, 1.0, 10.0), (1, 7, 3.0, 50.0), (2, None, 2.0, 30.0)], "m int, thread int, weight double, v double")
    got = {r.m: (r.blocks, r.low, r.high) for r in intervals.block_bootstrap(rows, ["m"], {"block": F.col("thread")}, F.col("v")).collect()}
    assert got == {1: (1, 40.0, 40.0), 2: (1, 30.0, 30.0)}


def test_snapshots_survive_the_round_trip(spark):
    cells = spark.createDataFrame([(1, 2, 50.5, 3.0, 40.0, 61.0, "ranked"), (1, 3, None, None, None, None, None)], "model_id int, aspect int, score double, ess double, ci_low double, ci_high double, tier string")
    evidence = spark.createDataFrame([(1, 2, 9, 0.5, 2), (1, 2, 8, 0.75, 1)], "model_id int, aspect int, source_item_id bigint, weight double, rank int")
    documents = snapshots.assembled(cells, evidence)
    assert sorted(tuple(r) for r in snapshots.flattened(documents).where("score is not null").collect()) == [(1, 2, 50.5, 3.0, 40.0, 61.0, "ranked")]
    assert sorted((r.ordinal, r.source_item_id, r.weight) for r in snapshots.evidence_rows(documents).collect()) == [(0, 8, 0.75), (1, 9, 0.5)]
    assert snapshots.flattened(snapshots.assembled(cells.limit(0), evidence.limit(0))).isEmpty()
