import math

import pytest
from pyspark.sql import functions as F

from evidra.operators import scoring

SCHEMA = "model_id int, aspect int, polarity int, weight double, thread_id long, author_id long, community_id long, platform int, regression_flag boolean, refusal_flag boolean, hallucination_flag boolean, firsthand_flag boolean, seq long"


def obs(spark, rows):
    out = []
    for k, r in enumerate(rows):
        base = {"model_id": 1, "aspect": 0, "polarity": 0, "weight": 1.0, "thread_id": k, "author_id": k, "community_id": k, "platform": k, "regression_flag": False, "refusal_flag": False, "hallucination_flag": False, "firsthand_flag": True, "seq": k}
        out.append(tuple((base | r).values()))
    return spark.createDataFrame(out, SCHEMA)


def test_weighted_mean_and_size(spark):
    got = scoring.cell_scores(obs(spark, [{"polarity": 2, "weight": 2.0, "thread_id": None, "author_id": None, "community_id": None, "platform": None}, {"polarity": -2, "thread_id": None, "author_id": None, "community_id": None, "platform": None}])).first()
    assert got.score == pytest.approx(200 / 3)
    assert got.ess == pytest.approx(9 / 5)


def test_flag_of_the_aspect_forces_zero(spark):
    rows = obs(spark, [{"aspect": 5, "polarity": 2, "regression_flag": True}, {"aspect": 4, "polarity": 2, "regression_flag": True}])
    assert {r.aspect: r.v for r in rows.select("aspect", scoring.score_value().alias("v")).collect()} == {5: 0.0, 4: 100.0}


def test_thread_cap_lowers_a_loud_thread(spark):
    rows = obs(spark, [{"thread_id": 7, "author_id": None, "community_id": None, "platform": None, "polarity": -2}] * 10 + [{"thread_id": 8, "author_id": None, "community_id": None, "platform": None, "polarity": 2}])
    got = scoring.cell_scores(rows).first()
    assert got.capped_n < got.weighted_n and got.score > 25 and not got.publishable


def test_caps_by_hand(spark):
    rows = obs(spark, [{"thread_id": 1, "author_id": None, "community_id": None, "platform": None, "weight": 3.0}, {"thread_id": 2, "author_id": None, "community_id": None, "platform": None, "weight": 1.0}])
    got = sorted(r.capped for r in scoring.capped(rows).collect())
    assert got == pytest.approx([0.12 * 4, 0.12 * 4])


def test_one_key_is_not_capped_and_null_keys_count(spark):
    rows = obs(spark, [{"thread_id": 1, "author_id": None, "community_id": None, "platform": None}, {"thread_id": None, "author_id": None, "community_id": None, "platform": None}])
    assert [r.capped for r in scoring.capped(rows).collect()] == [1.0, 1.0]


def plain_caps(rows, cell):
    """Cap after cap, over lists."""
    w = {r.seq: r.weight for r in rows}
    for key, cap in scoring.CAPS:
        cells = {}
        for r in rows:
            cells.setdefault(tuple(r[c] for c in cell), []).append(r)
        for own in cells.values():
            total, names = sum(w[r.seq] for r in own), {r[key] for r in own} - {None}
            sums = {k: sum(w[r.seq] for r in own if r[key] == k) for k in names}
            for r in own:
                if len(names) > 1 and r[key] is not None and sums[r[key]] > cap * total:
                    w[r.seq] *= cap * total / sums[r[key]]
    return w


@pytest.mark.parametrize("small", [True, False])
def test_caps_equal_plain_caps(spark, small, monkeypatch):
    """Null keys, null cells, one dominant key in every stage; with the factors broadcast and joined."""
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 200_000 if small else 0)
    rows = obs(spark, [{"model_id": k % 3 or None, "thread_id": (k % 11 if k % 4 else None) if k % 3 else 1, "author_id": k % 2, "community_id": k % 5 * (k % 2), "platform": k % 2, "weight": 1.0 + k / 7, "aspect": k % 2} for k in range(120)])
    want = plain_caps(rows.collect(), scoring.CELL)
    got = {r.seq: r.capped for r in scoring.capped(rows).collect()}
    assert got == pytest.approx(want) and any(want[r.seq] < r.weight for r in rows.collect())


def test_one_cell_of_all_rows_is_summed_before_it_is_shuffled(spark):
    """A third of a large table in one thread of one cell: the rows that leave the first stage are those of distinct keys, and no plan has a window."""
    many = spark.range(200_000).selectExpr(
        "1 as model_id", "0 as aspect", "cast(id % 5 - 2 as int) as polarity", "1.0D as weight", "case when id % 3 = 0 then 0 else id % 50 end as thread_id", "id % 7 as author_id", "id % 4 as community_id", "cast(id % 2 as int) as platform",
        "false as regression_flag", "false as refusal_flag", "false as hallucination_flag", "true as firsthand_flag", "id as seq",
    )
    out = scoring.cell_scores(many)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    sums = scoring._sums(many, scoring.CELL, value=scoring.score_value())
    assert sums.count() <= 2 * 50 * 7 * 4 * 5
    got = out.first()
    assert got.observations == 200_000 and got.threads == 50 and got.authors == 7 and got.capped_n < got.weighted_n == 200_000 and got.ci_low < got.score < got.ci_high


def test_wilson(spark):
    low, high = scoring.wilson(F.lit(3), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b"), *[c.alias(n) for n, c in zip("cd", scoring.wilson(F.lit(0), F.lit(0)), strict=True)]).first()
    assert 0 <= r.a < 0.3 < r.b <= 1 and (r.c, r.d) == (0, 0)
    p, n, z = 0.3, 10, 1.96
    assert r.a == pytest.approx((p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n))


def test_tiers(spark):
    r = spark.createDataFrame([(10.0,), (60.0,), (200.0,)], "n double").select(scoring.tier(F.col("n")).alias("t")).collect()
    assert [x.t for x in r] == ["insufficient", "provisional", "ranked"]


def test_overall_renormalises(spark):
    rows = spark.createDataFrame([(1, 0, 100.0), (1, 2, 0.0), (1, 7, 50.0), (2, 7, 50.0)], "model_id int, aspect int, score double")
    got = scoring.overall(rows).collect()
    assert len(got) == 1 and got[0].overall == pytest.approx(20 / 0.42) and got[0].aspects == 2
