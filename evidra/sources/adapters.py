"""Logical tables of the engine over the TPC-H-like and text tables.

Each adapter is a list of portable expressions, so that the SQL twins read the
same definitions.  Session time zone: UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLATFORMS = ("forum", "qa", "issues", "video", "review")
ASPECTS = ("quality", "speed", "reliability", "cost", "trust", "regression", "refusal", "ergonomics")

_R = "(user_id % 64)"
_M = f"case when {_R} < 1 then 0 when {_R} < 4 then 1 when {_R} < 9 then 2 when {_R} < 16 then 3 when {_R} < 25 then 4 when {_R} < 36 then 5 when {_R} < 49 then 6 else 7 end"
_A = "cast(cast(floor(value) as bigint) % 8 as int)"
_FIRST = "event_type in ('purchase', 'click')"
_PLATFORM = f"case when event_id % 11 < 8 and {_A} % 2 = 0 then 0 else cast(event_id % 5 as int) end"
#: Column: expression over ``events``.
OBSERVATIONS = {
    "source_item_id": "event_id", "published_at": "ts", "seq": "event_id", "model_id": _M, "provider_id": f"({_M}) % 3",
    "aspect": _A, "task": "cast(event_id % 10 as int)",
    "thread_id": f"case when event_id % 50 = 0 then null when event_id % 10 < 3 and ({_M}) >= 4 then 1000 else event_id % 97 end",
    "author_id": f"case when event_id % 7 < 2 and {_A} < 4 then -1 else user_id end",
    "community_id": f"case when event_id % 9 < 5 and ({_M}) % 2 = 0 then 100 else event_id % 12 end",
    "platform": _PLATFORM, "polarity": "cast(cast(floor(value) as bigint) % 5 - 2 as int)",
    "regression_flag": "event_type = 'error'", "refusal_flag": "event_type = 'view' and event_id % 4 = 0",
    "hallucination_flag": "event_type = 'signup' and event_id % 3 = 0", "firsthand_flag": _FIRST,
    "weight": f"(case when {_FIRST} then 1.25e0 else 0.75e0 end) * least(1.4e0, 1e0 + ln(1e0 + value) / 20e0) * (case {_PLATFORM} when 0 then 1.25e0 when 1 then 1.15e0 when 2 then 1.2e0 when 3 then 1e0 else 1.15e0 end)",
    "confidence": "(event_id % 89) / 88e0",
}
#: Reviews of observations: a later row wins where two exist.
REVIEWS = {
    "source_item_id": "event_id", "model_id": _M, "human_polarity": "case when event_id % 4 = 0 then null else cast(event_id % 5 - 2 as int) end",
    "human_aspect": "case when event_id % 4 = 0 or event_id % 7 > 3 then null else cast(event_id % 8 as int) end", "excluded": "event_id % 15 = 0", "seq": "event_id * 2",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} as {c}" for c, e in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each claim about a model and an aspect."""
    return table(spark, sf_dir, "events").selectExpr(*_select(OBSERVATIONS))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human reviews of a third of the observations, some of them twice."""
    events = table(spark, sf_dir, "events").where("event_id % 3 = 0")
    twice = events.where("event_id % 30 = 0").selectExpr(*_select(REVIEWS | {"human_polarity": "cast(2 - event_id % 5 as int)", "seq": "event_id * 2 + 1"}))
    return events.selectExpr(*_select(REVIEWS)).unionByName(twice)


#: (field, labels) of the long predictions; three backends.
FIELDS, BACKENDS = ("task", "aspect", "evidence", "polarity", "firsthand"), ("bayes", "tfidf", "vector")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, backend, field, label, confidence, actual) from digests of the row."""
    events = table(spark, sf_dir, "events").select("event_id")
    return events.selectExpr("event_id as row_id", f"explode(array({', '.join(repr(f) for f in FIELDS)})) as field").selectExpr(
        "row_id", "field", f"explode(array({', '.join(repr(b) for b in BACKENDS)})) as backend"
    ).selectExpr(
        "row_id", "field", "backend", "substring(md5(concat_ws('|', cast(row_id as string), field, case when row_id % 3 = 0 then 'same' else backend end)), 1, 1) as h",
        "ascii(substring(md5(concat_ws('|', backend, field, cast(row_id as string))), 2, 1)) * 100 + ascii(substring(md5(concat_ws('|', backend, field, cast(row_id as string))), 3, 1)) as c",
        "substring(md5(concat_ws('|', cast(row_id as string), field, 'same')), 1, 1) as t",
    ).selectExpr(
        "row_id", "backend", "field", "case when h < '4' then 'a' when h < '8' then 'b' else 'c' end as label", "(c - 4848) / 5454e0 as confidence",
        "case when t < '4' then 'a' when t < '8' then 'b' else 'c' end as actual",
    )


#: The same tables for the SQL twins.
OBS_SQL = f"obs as (select {', '.join(_select(OBSERVATIONS))} from events)"
REVIEWS_SQL = (
    f"reviews as (select {', '.join(_select(REVIEWS))} from events where event_id % 3 = 0 union all "
    f"select {', '.join(_select(REVIEWS | {'human_polarity': 'cast(2 - event_id % 5 as int)', 'seq': 'event_id * 2 + 1'}))} from events where event_id % 30 = 0)"
)
PREDICTIONS_SQL = (
    "predictions as (select row_id, backend, field, case when h < '4' then 'a' when h < '8' then 'b' else 'c' end as label, (ascii(c2) * 100 + ascii(c3) - 4848) / 5454e0 as confidence, "
    "case when t < '4' then 'a' when t < '8' then 'b' else 'c' end as actual from (select event_id as row_id, backend, field, "
    "substring(md5(concat_ws('|', cast(event_id as varchar), field, case when event_id % 3 = 0 then 'same' else backend end)), 1, 1) as h, "
    "substring(md5(concat_ws('|', backend, field, cast(event_id as varchar))), 2, 1) as c2, substring(md5(concat_ws('|', backend, field, cast(event_id as varchar))), 3, 1) as c3, "
    "substring(md5(concat_ws('|', cast(event_id as varchar), field, 'same')), 1, 1) as t from events "
    f"cross join (select unnest([{', '.join(repr(f) for f in FIELDS)}]) as field) cross join (select unnest([{', '.join(repr(b) for b in BACKENDS)}]) as backend)))"
)
