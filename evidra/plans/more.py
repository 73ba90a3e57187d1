"""Further registered queries: snapshots, corrections, products and spans, intervals, heads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corrections, intervals, learning, linking, review, scoring, snapshots
from ..sources import adapters as src
from .catalog import _LAST, _TOKENS, OBS, PRED, REV, cells_sql, pair, r6

# --------------------------------------------------------------------- snapshots

_SHOWN = "round(score, 6) as score, round(ess, 6) as ess, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, tier"


def _documents(spark, d):
    obs = src.observations(spark, d)
    return snapshots.assembled(scoring.cell_scores(obs), scoring.top_evidence(obs).select("model_id", "aspect", "source_item_id", "weight", "rank"))


@pair(f"with {OBS}, {cells_sql('model_id, aspect')} select model_id, aspect, {_SHOWN} from cells")
def snapshot_cells(spark, d):
    return r6(snapshots.flattened(_documents(spark, d)), "score", "ess", "ci_low", "ci_high")


@pair(f"with {OBS} select model_id, aspect, cast(rank - 1 as int) as ordinal, source_item_id, round(weight, 6) as weight from (select *, row_number() over (partition by model_id, aspect order by weight desc, seq) as rank from obs) where rank <= 4")
def snapshot_evidence(spark, d):
    return r6(snapshots.evidence_rows(_documents(spark, d)), "weight")


@pair(f"with {OBS}, w as (select *, cast(date_trunc('month', published_at) as date) as month from obs), {cells_sql('month, model_id, aspect', 'w')} select model_id, aspect, month, {_SHOWN} from (select *, row_number() over (partition by model_id, aspect order by month desc) as rn from cells) where rn = 1")
def latest_snapshot(spark, d):
    obs = src.observations(spark, d).withColumn("month", F.to_date(F.date_trunc("month", "published_at")))
    out = snapshots.latest(scoring.cell_scores(obs, ("month", "model_id", "aspect")), ["model_id", "aspect"], "month")
    return r6(out.select("model_id", "aspect", "month", "score", "ess", "ci_low", "ci_high", "tier"), "score", "ess", "ci_low", "ci_high")


_RAW = "event_id, user_id, case when event_id % 7 = 0 then 'n/a' else cast(cast(floor(value) as bigint) as varchar(20)) end as amount, case event_id % 3 when 0 then 'true' when 1 then 'no' else '?' end as flag"


@pair(f"with raw as (select {_RAW}, ts from events), f as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from raw) select user_id, event_id, try_cast(amount as int) as amount, try_cast(flag as boolean) as flag from f where rn = 1")
def observation_reload(spark, d):
    raw = src.table(spark, d, "events").selectExpr(*[x.strip() for x in _RAW.replace("varchar(20)", "string").replace(", case", "; case").replace("event_id, user_id", "event_id; user_id").split(";")], "ts")
    return snapshots.reloaded(raw, ["user_id"], ["ts", "event_id"], {"amount": "int", "flag": "boolean"}).select("user_id", "event_id", "amount", "flag")


@pair("""with c as (select conv_id, count(*) as comments from conversations group by 1),
h as (select 0 as query, conv_id as rank, conv_id as story, comments from c where conv_id % 2 = 0 union all select 1, -conv_id, conv_id, comments from c where conv_id % 3 = 0 union all select 2, conv_id, conv_id, comments from c),
f as (select * from h where comments >= 2 and story % 10 <> 3), b as (select * from (select *, row_number() over (partition by query order by rank, story) as rn from f) where rn <= 50)
select query, rank, story, comments from (select *, row_number() over (partition by story order by query, rank) as r2 from b) where r2 = 1""")
def story_selection(spark, d):
    c = src.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("comments"))
    found = F.inline(F.array_compact(F.array(
        F.when(F.col("conv_id") % 2 == 0, F.struct(F.lit(0).alias("query"), F.col("conv_id").alias("rank"))),
        F.when(F.col("conv_id") % 3 == 0, F.struct(F.lit(1).alias("query"), (-F.col("conv_id")).alias("rank"))),
        F.struct(F.lit(2).alias("query"), F.col("conv_id").alias("rank")),
    )))
    hits = c.select(found, F.col("conv_id").alias("story"), "comments")
    return snapshots.stories(hits, hits.where("story % 10 = 3").select("story").distinct(), 2, 50).select("query", "rank", "story", "comments")


#: Parameters of the collection list: lang as the source, and how many items are read.
_CONFIG = (("en", "forum", 40), ("de", "issues", 25))


@pair(f"with c(lang, kind, most) as (values {', '.join(map(str, _CONFIG))}) select doc_id, lang, kind from (select doc_id, c.lang, kind, most, row_number() over (partition by c.lang order by doc_id) as rn from documents d join c on d.lang = c.lang) where rn <= most")
def collection_list(spark, d):
    config = spark.createDataFrame(list(_CONFIG), "lang string, kind string, most int")
    return snapshots.landed(src.table(spark, d, "documents").select("doc_id", "lang"), config, "lang", "doc_id").select("doc_id", "lang", "kind")


# ------------------------------------------------------------------- corrections

_ACTION = "case event_id % 7 when 0 then 'accept_machine' when 1 then 'accept_suggestion' when 2 then 'exclude' when 3 then 'clear' when 4 then 'set_reason' end"
_NEW_REASON = "case when event_id % 4 = 0 then 'spam' end"
_REVIEWED = "r as (select o.source_item_id, o.model_id, o.aspect, o.polarity, l.human_aspect, l.human_polarity, case when o.source_item_id % 9 < 8 then cast(o.source_item_id % 9 as int) end as suggested_aspect, coalesce(l.excluded, false) as excluded, case when l.excluded then 'old' end as reason from obs o left join last l on o.source_item_id = l.source_item_id and o.model_id = l.model_id)"


def _reviewed(spark, d):
    last = review.last_reviews(src.reviews(spark, d), ("source_item_id", "model_id")).select("source_item_id", "model_id", "human_aspect", "human_polarity", "excluded")
    out = src.observations(spark, d).join(last, ["source_item_id", "model_id"], "left")
    return out.selectExpr("source_item_id", "model_id", "aspect", "polarity", "human_aspect", "human_polarity", "case when source_item_id % 9 < 8 then cast(source_item_id % 9 as int) end as suggested_aspect", "coalesce(excluded, false) as excluded", "case when excluded then 'old' end as reason")


@pair(f"""with {OBS}, {REV}, {_LAST}, {_REVIEWED}, a as (select event_id, coalesce({_ACTION}, '') as a, {_NEW_REASON} as n from events)
select source_item_id, case when a = 'accept_machine' then aspect when a = 'accept_suggestion' then coalesce(suggested_aspect, aspect) when a <> 'clear' then human_aspect end as human_aspect,
a = 'exclude' or (a <> 'clear' and excluded) as excluded, case when a = 'exclude' then coalesce(n, reason, 'off_topic') when a = 'set_reason' then n when a <> 'clear' then reason end as reason from r join a on event_id = source_item_id""")
def bulk_review(spark, d):
    actions = src.table(spark, d, "events").selectExpr("event_id as source_item_id", f"{_ACTION} as action", f"{_NEW_REASON} as new_reason")
    return corrections.bulk_actions(_reviewed(spark, d), actions, ["source_item_id"], ["aspect"], "off_topic").select("source_item_id", "human_aspect", "excluded", "reason")


@pair(f"with {OBS}, {REV}, {_LAST}, {_REVIEWED} select model_id, count(*) as n, count(*) filter ((human_aspect is not null and human_aspect <> aspect) or (human_polarity is not null and human_polarity <> polarity)) as corrected from r group by 1")
def correction_counts(spark, d):
    return _reviewed(spark, d).groupBy("model_id").agg(F.count("*").alias("n"), F.count_if(corrections.corrected(["aspect", "polarity"])).alias("corrected"))


_PREDICTED = {
    "evidence": "case event_id % 6 when 0 then 'firsthand_usage' when 1 then 'hearsay' when 2 then 'integration_failure' when 3 then 'pricing_value_comment' when 4 then 'release_update_reaction' end",
    "task": "case when event_id % 4 = 0 then 'api_developer_workflow' else 'coding' end", "aspect": "case when event_id % 5 = 0 then 'value' else 'quality' end", "firsthand": "case when event_id % 2 = 0 then 'true' else 'false' end",
}


@pair(f"""with p as (select event_id, {', '.join(f'{e} as {c}' for c, e in _PREDICTED.items())} from events),
n as (select *, case when evidence = 'firsthand_usage' then 'true' when evidence in ('hearsay', 'release_update_reaction') then 'false' else firsthand end as f, case when evidence = 'integration_failure' then 'api_developer_workflow' else task end as t,
case when evidence = 'integration_failure' then 'developer_ergonomics' when evidence = 'pricing_value_comment' then 'value' else aspect end as a from p)
select event_id, t as task, a as aspect, f as firsthand, t <> task as task_changed, a <> aspect as aspect_changed, f <> firsthand as firsthand_changed from n""")
def constraint_resolution(spark, d):
    rows = src.table(spark, d, "events").selectExpr("event_id", *[f"{e} as {c}" for c, e in _PREDICTED.items()])
    return corrections.constrained(rows, "high_purity").drop("evidence")


_QUEUE = ["bucket", "confidence", "model_id", "aspect", "source_item_id"]
_BUCKET = "case when (regression_flag or hallucination_flag) and confidence < 0.6 then 0 when confidence < 0.6 then 1 when regression_flag or hallucination_flag then 2 when confidence < 0.72 then 3 else 4 end"
_TOP = f"q as (select *, {_BUCKET} as bucket from obs where {_BUCKET} < 4 order by {', '.join(_QUEUE)} limit 200)"


def _top(spark, d):
    rows = src.observations(spark, d).withColumn("bucket", review.bucket(F.col("confidence"), F.col("regression_flag") | F.col("hallucination_flag"))).where("bucket < 4")
    return rows.orderBy(*_QUEUE).limit(200)


@pair(f"with {OBS}, {_TOP}, p as (select *, row_number() over (order by {', '.join(_QUEUE)}) as place from q) select source_item_id, cast(place as int) as place, case place when 1 then 'keep' when 3 then 'drop' when 8 then 'keep' end as decision from p")
def decisions_by_place(spark, d):
    told = spark.createDataFrame([(1, "keep"), (3, "drop"), (8, "keep")], "place int, decision string")
    return corrections.decided_by_place(_top(spark, d), _QUEUE, told).select("source_item_id", "place", "decision")


@pair(f"with {OBS}, {_TOP} select source_item_id, format('{{}} m{{}} a{{}} p{{}}', source_item_id, model_id, aspect, polarity) as line from q")
def review_dump(spark, d):
    return _top(spark, d).select("source_item_id", corrections.dump("%d m%d a%d p%d", "source_item_id", "model_id", "aspect", "polarity").alias("line"))


@pair(f"with {OBS}, {_TOP}, l as (select * from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn = 1) select source_item_id, case when conv_id is not null then '{{\"role\":\"' || role || '\",\"turn\":' || turn || '}}' end as context from q left join l on conv_id = source_item_id")
def review_context(spark, d):
    return snapshots.with_context(_top(spark, d), src.table(spark, d, "conversations"), "conv_id", "turn", ["role", "turn"]).select("source_item_id", "context")


# --------------------------------------------------------- products and spans

#: Parameters: products with their place in the order, words that must be near, and words that may not follow.
_PRODUCTS = (("und", "u", 0), ("the", "t", 1), ("and", "a", 2))
_CUES, _NOT_AFTER = ["in ", "on ", "mit ", "with "], [" says", " said", " think"]
_PLACES = """pos as (select doc_id, lower(text) as l, unnest(range(1, length(text) + 1)) as i from documents where regexp_matches(lower(text), '(^|[^a-z0-9])(und|the|and)([^a-z0-9]|$)')),
hit as (select doc_id, substring(l, i, 3) as alias, case when i > 1 then substring(l, greatest(1, i - 24), least(24, i - 1)) else '' end as b, substring(l, i + 3, 24) as a from pos where substring(l, i, 3) in ('und', 'the', 'and')),
m as (select * from hit where not regexp_matches(right(b, 1), '[a-z0-9]') and not regexp_matches(left(a, 1), '[a-z0-9]'))"""
_PRIORITY = "min(case alias when 'und' then 0 when 'the' then 1 else 2 end)"
_NAMED = f"case {_PRIORITY} when 0 then 'u' when 1 then 't' else 'a' end as entity"


def _found(spark, d, width=0):
    catalog = spark.createDataFrame([(a, a, "p", False) for a, _, _ in _PRODUCTS], "alias string, model_id string, provider_id string, generic boolean")
    return linking.mentions(src.table(spark, d, "documents"), catalog, "doc_id", "text", width)


def _priorities(spark):
    return spark.createDataFrame(list(_PRODUCTS), "alias string, entity string, priority int")


@pair(f"with {_PLACES} select doc_id, {_NAMED} from m where ({' or '.join(f'''contains(a, '{c}') or contains(b, '{c}')''' for c in _CUES)}) and not contains(a, '/') and not contains(b, '/') and not ({' or '.join(f'''contains(a, '{c}')''' for c in _NOT_AFTER)}) group by 1")
def product_detection(spark, d):
    near = linking.with_cue(_found(spark, d, 24), src.table(spark, d, "documents"), "doc_id", "text", _CUES, _NOT_AFTER)
    return linking.first_by_priority(near, "doc_id", _priorities(spark))


@pair(f"with {_PLACES} select doc_id, {_NAMED} from m group by 1")
def profile_detection(spark, d):
    return linking.first_by_priority(_found(spark, d), "doc_id", _priorities(spark))


_PREFACE = ("the ", "der ", ">")


@pair(r"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', concat('\1', chr(10)), 'g'), '\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') as s from documents),
k as (select doc_id, s, list_position(list_transform(s, lambda x: not (starts_with(lower(x), 'the ') or starts_with(lower(x), 'der ') or starts_with(x, '>'))), true) as f from s),
t as (select doc_id, case when coalesce(f, 0) = 0 then [] else s[f:] end as s from k where s is not null),
q as (select doc_id, s, list_transform(s, lambda x: not ends_with(x, '.')) as p from t),
e as (select doc_id, s, coalesce(list_position(p, true), 0) as a, len(s) + 1 - coalesce(list_position(list_reverse(p), true), 0) as z from q)
select d.doc_id, cast(len(e.x) as int) as n, e.x[1] as first, e.x[len(e.x)] as last from documents d left join (select doc_id, case when len(s) < 2 then s when a > 0 then s[a:z] else s[len(s):] end as x from e) e using (doc_id)""")
def trimmed_spans(spark, d):
    starts = lambda x: F.lower(x).startswith(_PREFACE[0]) | F.lower(x).startswith(_PREFACE[1]) | x.startswith(_PREFACE[2])
    s = src.table(spark, d, "documents").select("doc_id", T.trimmed_span(T.sentences(F.col("text")), starts, lambda x: x.endswith(".")).alias("s"))
    return s.select("doc_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("n"), F.try_element_at("s", F.lit(1)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


# -------------------------------------------------------------- intervals, trust

_CUT = "case " + " ".join(f"when u < {p!r} then {n}" for n, p in enumerate(intervals.POISSON)) + f" else {len(intervals.POISSON)} end"


@pair(f"""with {OBS}, b as (select model_id, thread_id, cast(date_trunc('week', published_at) as date) as week, sum(weight) as w, sum(weight * ((polarity + 2) * 25e0)) as wv from obs group by 1, 2, 3),
d as (select *, cast(('0x' || substring(md5(concat_ws('|', cast(r as varchar), cast(thread_id as varchar), cast(week as varchar))), 1, 8)) as bigint) / 4294967296e0 as u from b, (select unnest(range(1, 101)) as r)),
m as (select model_id, r, sum({_CUT} * wv) / nullif(sum({_CUT} * w), 0) as m, count(*) as blocks from d group by 1, 2)
select model_id, max(blocks) as blocks, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by 1""")
def bootstrap_intervals(spark, d):
    block = {"thread": F.col("thread_id"), "week": F.to_date(F.date_trunc("week", "published_at"))}
    return r6(intervals.block_bootstrap(src.observations(spark, d), ["model_id"], block, (F.col("polarity") + 2) * 25.0), "low", "high")


@pair(f"""with {OBS}, a as (select author_id, cast(min(published_at) as date) as born, count(distinct thread_id) as threads, count(*) as items from obs group by 1),
p as (select model_id, aspect, count(distinct platform) as platforms from obs group by 1, 2), c as (select author_id, model_id, polarity, count(*) as copies from obs group by 1, 2, 3),
b as (select model_id, cast(published_at as date) as day, count(*) as n from obs group by 1, 2), m as (select *, avg(n) over (partition by model_id order by day rows between 7 preceding and 1 preceding) as mean from b)
select source_item_id, round(0.2e0 * least(1e0, date_diff('day', born, cast(published_at as date)) / 30e0) + 0.15e0 * threads / items + 0.2e0 * firsthand_flag::int + 0.15e0 * (platforms >= 2)::int + 0.1e0 / copies + 0.2e0 * (1 - coalesce(n > 2 * mean and n >= 5, false)::int), 6) as trust
from obs join a using (author_id) join p using (model_id, aspect) join c using (author_id, model_id, polarity) join m on m.model_id = obs.model_id and m.day = cast(published_at as date)""")
def item_trust(spark, d):
    obs = src.observations(spark, d).withColumn("day", F.to_date("published_at"))
    authors = obs.groupBy("author_id").agg(F.min("day").alias("born"), F.countDistinct("thread_id").alias("threads"), F.count("*").alias("items"))
    platforms = obs.groupBy("model_id", "aspect").agg(F.countDistinct("platform").alias("platforms"))
    copies = obs.groupBy("author_id", "model_id", "polarity").agg(F.count("*").alias("copies"))
    days = obs.groupBy("model_id", "day").agg(F.count("*").alias("n")).withColumn("mean", F.avg("n").over(Window.partitionBy("model_id").orderBy("day").rowsBetween(-7, -1)))
    burst = F.coalesce((F.col("n") > 2 * F.col("mean")) & (F.col("n") >= 5), F.lit(False))
    rows = obs.join(authors, "author_id").join(platforms, ["model_id", "aspect"]).join(copies, ["author_id", "model_id", "polarity"]).join(days, ["model_id", "day"])
    value = intervals.trust(F.least(F.lit(1.0), F.datediff("day", "born") / 30), F.col("threads") / F.col("items"), F.col("firsthand_flag").cast("int"), (F.col("platforms") >= 2).cast("int"), 1 / F.col("copies"), 1 - burst.cast("int"))
    return r6(rows.select("source_item_id", value.alias("trust")), "trust")


# ------------------------------------------------------------------------- heads

_ABOVE = [f"max(confidence) filter (where backend = 'bayes' and field = '{f}')" for f in src.FIELDS[:4]]


@pair(f"with {PRED}, w as (select row_id, {', '.join(f'{e} as p{k}' for k, e in enumerate(_ABOVE))} from predictions group by 1) select row_id, case when p3 >= 0.5 then 2 when p2 >= 0.5 then 1 when p1 >= 0.5 then 0 when p0 >= 0.5 then -1 else -2 end as label, round((abs(p0 - 0.5) + abs(p1 - 0.5) + abs(p2 - 0.5) + abs(p3 - 0.5)) / 2, 6) as confidence from w")
def ordinal_head(spark, d):
    wide = src.predictions(spark, d).groupBy("row_id").agg(*[F.expr(e).alias(f"p{k}") for k, e in enumerate(_ABOVE)])
    label, confidence = intervals.ordinal([F.col(f"p{k}") for k in range(4)], -2)
    return r6(wide.select("row_id", label.alias("label"), confidence.alias("confidence")), "confidence")


@pair(None)
def calibrated_confidence(spark, d):
    """Fitted on rows whose id is not divisible by four, applied to all."""
    rows = src.predictions(spark, d).where("backend = 'bayes' and field = 'aspect'").withColumn("right", F.col("label") == F.col("actual"))
    return r6(learning.calibrated(rows, rows.where("row_id % 4 <> 0"), "confidence", "right").select("row_id", "confidence", "calibrated"), "confidence", "calibrated")


@pair(None)
def vector_classifier(spark, d):
    """Fitted on vectors whose id is not divisible by four, applied to all."""
    rows = src.table(spark, d, "embeddings")
    return r6(learning.vector_head(rows.where("vec_id % 4 <> 0"), rows, "embedding", "label").select("vec_id", "label", "predicted", "confidence"), "confidence")


@pair(f"""with {_TOKENS.replace('from documents', 'from documents where lang is not null')}, per as (select lang, token, sum(n) as n from tok group by 1, 2), cls as (select d.lang, d.rows, coalesce(t.total, 0) as total from (select lang, count(*) as rows from documents where lang is not null group by 1) d left join (select lang, sum(n) as total from per group by 1) t using (lang)),
hold as (select token, count(*) as holders from tok group by 1), own as (select doc_id, sum(n) as size, count(*) filter (holders = 1) as only from tok join hold using (token) group by 1),
v as (select count(*) as v from hold), k as (select count(*) as k, sum(rows) as r from cls),
s as (select tok.doc_id, cls.lang as c, (cls.lang = any_value(tok.lang))::int as mine, any_value(cls.rows) as rows, any_value(r) as r, any_value(k) as k,
  sum(tok.n * ln((coalesce(per.n, 0) - (cls.lang = tok.lang)::int * tok.n + 1e0) / (cls.total - (cls.lang = tok.lang)::int * own.size + v - own.only))) as l
  from tok join own using (doc_id) cross join cls cross join v cross join k left join per on per.lang = cls.lang and per.token = tok.token group by tok.doc_id, cls.lang),
a as (select *, max((mine = 1 and rows = 1)::int) over (partition by doc_id) as alone from s), b as (select doc_id, c, l + ln((rows - mine + 1e0) / (r - 1 + k - alone)) as l from a where rows > mine),
e as (select *, exp(l - max(l) over (partition by doc_id)) as e from b), p as (select *, e / sum(e) over (partition by doc_id) as p from e)
select doc_id, arg_max(c, p) as predicted, round(max(p), 6) as confidence from p group by 1""")
def bayes_leave_one_out(spark, d):
    docs = src.table(spark, d, "documents")
    return r6(learning.leave_one_out(docs, learning.bags(docs, "doc_id", "text", "lang"), "doc_id", "lang"), "confidence")
