"""All registered queries of the engine and their SQL twins for DuckDB.

A query is a function (spark, sf_dir) -> DataFrame; `pair` registers it
together with the SQL that gives the same columns and rows.  Doubles are
rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decisions, dedup, evaluation, extract, learning, linking, review, scoring, vectors
from ..operators.staging import cut
from ..sources import adapters as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def pair(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- SQL fragments


def caps_sql(cell: str, source: str = "obs", out: str = "c4") -> str:
    """CTEs c0..c4 with the caps of `scoring.capped`."""
    ctes = [f"c0 as (select *, weight as capped from {source})"]
    for k, (key, cap) in enumerate(scoring.CAPS):
        inner = f"select *, sum(capped) over (partition by {cell}) as tt, sum(capped) over (partition by {cell}, {key}) as gg, min({key}) over (partition by {cell}) < max({key}) over (partition by {cell}) as several from c{k}"
        ctes.append(f"{'c' + str(k + 1) if k < 3 else out} as (select * exclude (capped, tt, gg, several), case when {key} is not null and coalesce(several, false) and gg > {cap} * tt then capped * {cap} * tt / gg else capped end as capped from ({inner}))")
    return ",\n".join(ctes)


VALUE_SQL = "case when (hallucination_flag and aspect = 4) or (refusal_flag and aspect = 6) or (regression_flag and aspect = 5) then 0e0 else (polarity + 2) * 25e0 end"


def cells_sql(cell: str, source: str = "obs") -> str:
    shares = ", ".join(f"coalesce(max(w_{k}) / nullif(any_value(ww), 0), 0) as {k}_share" for k, _ in scoring.WARN)
    per = ", ".join(f"case when {k} is not null then sum(capped) over (partition by {cell}, {k}) end as w_{k}" for k, _ in scoring.WARN)
    warn = "case when ess < 30 then 'low_sample' end, " + ", ".join(f"case when {k}_share > {s} then '{k}_concentration' end" for k, s in scoring.WARN)
    return f"""{caps_sql(cell, source)},
v as (select *, {VALUE_SQL} as v from c4),
m as (select *, sum(capped) over (partition by {cell}) as ww, coalesce(sum(capped * v) over (partition by {cell}) / nullif(sum(capped) over (partition by {cell}), 0), 0) as mm, {per} from v),
g as (select {cell}, any_value(mm) as score, sum(weight) as weighted_n, sum(capped) as capped_n, coalesce(sum(capped) * sum(capped) / nullif(sum(capped * capped), 0), 0) as ess, sum(capped * pow(v - mm, 2)) as ss, {shares},
  count(*) as observations, count(distinct thread_id) as threads, count(distinct author_id) as authors, avg(case when firsthand_flag then 1e0 else 0e0 end) as firsthand_ratio from m group by {cell}),
h as (select *, case when ess > 1 then 1.96 * sqrt(ss / nullif(capped_n, 0) / ess) else 0 end as half, case when ess >= 150 then 'ranked' when ess >= 30 then 'provisional' else 'insufficient' end as tier from g),
i as (select *, greatest(0e0, score - half) as ci_low, least(100e0, score + half) as ci_high from h),
cells as (select *, concat_ws(',', {warn}) as warnings, concat_ws(',', {warn}, case when ci_high - ci_low > 30 then 'wide_interval' end) as blockers from i)"""


OBS, REV, PRED = src.OBS_SQL, src.REVIEWS_SQL, src.PREDICTIONS_SQL
_CELL_OUT = "round(score, 6) as score, round(weighted_n, 6) as weighted_n, round(capped_n, 6) as capped_n, round(ess, 6) as ess, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, round(firsthand_ratio, 6) as firsthand_ratio, observations, threads, authors, tier, warnings, blockers, blockers = '' as publishable"


def _board(df: DataFrame) -> DataFrame:
    return r6(df.drop(*[f"{k}_share" for k, _ in scoring.WARN]), "score", "weighted_n", "capped_n", "ess", "ci_low", "ci_high", "firsthand_ratio")


# ----------------------------------------------------------------------- scoring


@pair(f"with {OBS}, {cells_sql('model_id, aspect')} select model_id, aspect, {_CELL_OUT} from cells")
def leaderboard(spark, d):
    return _board(scoring.cell_scores(src.observations(spark, d)))


@pair(f"with {OBS}, {cells_sql('model_id, aspect, task')} select model_id, aspect, task, {_CELL_OUT} from cells")
def task_scores(spark, d):
    return _board(scoring.cell_scores(src.observations(spark, d), ("model_id", "aspect", "task")))


@pair(f"with {OBS}, {cells_sql('provider_id, aspect')} select provider_id, aspect, {_CELL_OUT} from cells")
def provider_rollup(spark, d):
    return _board(scoring.cell_scores(src.observations(spark, d), ("provider_id", "aspect")))


@pair(f"with {OBS}, {caps_sql('model_id, aspect')} select model_id, aspect, count(*) as n, count(*) filter (capped < weight) as lowered, round(sum(capped), 6) as capped_n from c4 group by 1, 2")
def contribution_caps(spark, d):
    out = scoring.capped(src.observations(spark, d)).groupBy("model_id", "aspect").agg(F.count("*").alias("n"), F.count_if(F.col("capped") < F.col("weight")).alias("lowered"), F.sum("capped").alias("capped_n"))
    return r6(out, "capped_n")


@pair(f"with {OBS}, {caps_sql('model_id, aspect')}, s as (select model_id, aspect, platform, sum(capped) as w from c4 group by 1, 2, 3) select model_id, aspect, platform, round(w / sum(w) over (partition by model_id, aspect), 6) as share from s")
def source_mix(spark, d):
    return r6(scoring.source_mix(src.observations(spark, d)), "share")


_W = "case aspect " + " ".join(f"when {k} then {w}" for k, w in enumerate(scoring.OVERALL)) + " end"


@pair(f"with {OBS}, {cells_sql('model_id, aspect')} select model_id, round(sum(score * {_W}) / sum(case when {_W} is not null then {_W} end), 6) as overall, count(*) as aspects from cells where {_W} is not null group by 1")
def overall_scores(spark, d):
    return r6(scoring.overall(scoring.cell_scores(src.observations(spark, d))), "overall")


@pair(f"with {OBS}, {caps_sql('model_id')}, e as (select model_id, sum(capped) * sum(capped) / sum(capped * capped) as ess from c4 group by 1) select model_id, round(ess, 6) as ess, case when ess >= 50 then 'ranked' when ess >= 15 then 'provisional' else 'insufficient' end as tier from e")
def overall_tiers(spark, d):
    return r6(scoring.pool_tier(src.observations(spark, d), "model_id"), "ess")


def _wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"({k} * 1e0 / {n})"
    return f"greatest(0e0, least(1e0, ({p} + 1.96 * 1.96 / (2 * {n}) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + 1.96 * 1.96 / (4e0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})))"


@pair(f"with {OBS}, g as (select model_id, sum(case when regression_flag then weight else 0 end) / sum(weight) as rate, count(*) filter (regression_flag) as k, count(*) as n from obs group by 1) select model_id, k, n, round(rate, 6) as rate, round({_wilson_sql('k', 'n', '-')}, 6) as low, round({_wilson_sql('k', 'n', '+')}, 6) as high from g")
def complaint_rates(spark, d):
    return r6(scoring.complaint_rate(src.observations(spark, d), "regression_flag"), "rate", "low", "high")


@pair(f"with {OBS} select count(*) as observations, count(*) filter (regression_flag or refusal_flag or hallucination_flag) as flagged, count(distinct model_id) as models, count(distinct provider_id) as providers, count(distinct thread_id) as threads, count(distinct author_id) as authors from obs")
def corpus_summary(spark, d):
    return src.observations(spark, d).agg(
        F.count("*").alias("observations"), F.count_if(F.col("regression_flag") | F.col("refusal_flag") | F.col("hallucination_flag")).alias("flagged"),
        *[F.countDistinct(f"{c}_id").alias(f"{c}s") for c in ("model", "provider", "thread", "author")],
    )


_REPORT = ("model_id", "aspect", "task", "platform", "polarity", "provider_id")


@pair(f"with {OBS}, l as ({' union all '.join(f'select {chr(39)}{c}{chr(39)} as field, cast({c} as varchar) as value from obs' for c in _REPORT)}), n as (select field, value, count(*) as n from l group by 1, 2) select * from (select field, value, n, row_number() over (partition by field order by n desc, value) as rank from n) where rank <= 25")
def quality_counts(spark, d):
    long = src.observations(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in _REPORT])).alias("x")).select("x.*")
    n = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where("rank <= 25")


@pair(f"with {OBS} select count(*) as n, round(avg(confidence), 6) as mean, min(confidence) as lowest, max(confidence) as highest, count(*) filter (confidence < 0.6) as below_60, count(*) filter (confidence < 0.72) as below_72, count(*) filter (firsthand_flag) as firsthand from obs")
def quality_report(spark, d):
    return r6(src.observations(spark, d).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"), F.count_if(F.col("confidence") < 0.6).alias("below_60"), F.count_if(F.col("confidence") < 0.72).alias("below_72"), F.count_if("firsthand_flag").alias("firsthand")), "mean")


@pair(f"with {OBS} select * from (select model_id, aspect, source_item_id, round(weight, 6) as weight, row_number() over (partition by model_id, aspect order by weight desc, seq) as rank from obs) where rank <= 4")
def top_evidence(spark, d):
    return r6(scoring.top_evidence(src.observations(spark, d)).select("model_id", "aspect", "source_item_id", "weight", "rank"), "weight")


@pair(f"with {OBS}, {cells_sql('model_id, aspect')} select aspect, model_id, tier, round(score, 6) as score, row_number() over (partition by aspect order by case tier when 'ranked' then 0 when 'provisional' then 1 else 2 end, round(score, 9) desc, model_id) as position from cells")
def rank_order(spark, d):
    return r6(scoring.rank_order(scoring.cell_scores(src.observations(spark, d)), ("aspect",)).select("aspect", "model_id", "tier", "score", "position"), "score")


@pair(f"with {OBS}, {cells_sql('model_id, aspect, task')} select * from (select task, aspect, model_id, tier, round(score, 6) as score, row_number() over (partition by task, aspect order by case tier when 'ranked' then 0 when 'provisional' then 1 else 2 end, round(score, 9) desc, model_id) as position from cells) where position <= 6")
def field_board(spark, d):
    cells = scoring.cell_scores(src.observations(spark, d), ("model_id", "aspect", "task"))
    return r6(scoring.rank_order(cells, ("task", "aspect")).where("position <= 6").select("task", "aspect", "model_id", "tier", "score", "position"), "score")


@pair(f"with {OBS} select source_item_id, model_id, aspect, round(weight, 6) as weight from obs where platform = 0 and aspect in (4, 6) and polarity < 0 and firsthand_flag order by weight desc, source_item_id limit 40")
def evidence_page(spark, d):
    rows = src.observations(spark, d).where("platform = 0 and aspect in (4, 6) and polarity < 0 and firsthand_flag")
    return r6(rows.orderBy(F.desc("weight"), "source_item_id").limit(40).select("source_item_id", "model_id", "aspect", "weight"), "weight")


# ------------------------------------------------------------------- review loop

_LAST = "last as (select * from (select *, row_number() over (partition by source_item_id, model_id order by seq desc) as rn from reviews) where rn = 1)"


@pair(f"with {OBS}, {REV}, {_LAST} select o.source_item_id, o.model_id, coalesce(human_polarity, polarity) as polarity, coalesce(human_aspect, aspect) as aspect, coalesce(human_polarity <> polarity, false) or coalesce(human_aspect <> aspect, false) as changed from obs o left join last l on o.source_item_id = l.source_item_id and o.model_id = l.model_id")
def apply_reviews(spark, d):
    return review.apply_reviews(src.observations(spark, d), src.reviews(spark, d)).select("source_item_id", "model_id", "polarity", "aspect", "changed")


@pair(f"with {OBS}, {REV}, {_LAST} select o.source_item_id, case when l.excluded is null then 'machine' when l.excluded then 'dropped' else 'human' end as part, coalesce(human_polarity, polarity) as polarity from obs o left join last l on o.source_item_id = l.source_item_id and o.model_id = l.model_id")
def split_by_review(spark, d):
    return review.split_by_review(src.observations(spark, d), src.reviews(spark, d)).select("source_item_id", "part", "polarity")


_OPEN = "select o.* from obs o where not exists (select 1 from reviews r where r.source_item_id = o.source_item_id and r.model_id = o.model_id and (human_polarity is not null or human_aspect is not null or excluded))"


@pair(f"with {OBS}, {REV} select source_item_id, model_id, aspect from ({_OPEN})")
def unreviewed(spark, d):
    return review.unreviewed(src.observations(spark, d), src.reviews(spark, d)).select("source_item_id", "model_id", "aspect")


_BUCKET = "case when (regression_flag or hallucination_flag) and confidence < 0.6 then 0 when confidence < 0.6 then 1 when regression_flag or hallucination_flag then 2 when confidence < 0.72 then 3 else 4 end"


@pair(f"with {OBS}, {REV}, o as (select *, {_BUCKET} as bucket from ({_OPEN})), n as (select *, row_number() over (partition by model_id, aspect order by bucket, confidence, model_id, aspect, source_item_id) > 1 as again from o where bucket < 4) select source_item_id, model_id, aspect, bucket, again, substring(sha256(concat_ws('|', cast(source_item_id as varchar), cast(model_id as varchar), cast(aspect as varchar))), 1, 16) as review_id from n order by again, bucket, confidence, model_id, aspect, source_item_id limit 200")
def review_queue(spark, d):
    return review.queue(src.observations(spark, d), src.reviews(spark, d)).select("source_item_id", "model_id", "aspect", "bucket", "again", "review_id")


@pair(f"with {PRED}, f as (select row_id, field, count(distinct label) as labels, max(confidence) as best from predictions group by 1, 2), g as (select row_id, count(*) filter (labels > 1) as disagreeing, count(*) filter (best < 0.65) as uncertain from f group by 1) select row_id, disagreeing, uncertain, 3 * disagreeing + uncertain as priority from g order by priority desc, row_id limit 200")
def active_learning(spark, d):
    return review.active_learning(src.predictions(spark, d))


@pair(f"with {PRED}, p as (select row_id, field, max(label) filter (backend = 'bayes') as m, max(label) filter (backend = 'tfidf') as c from predictions group by 1, 2) select row_id, count(*) filter (m <> c) as disagreements from p group by 1")
def disagreement_count(spark, d):
    side = lambda b: F.max(F.when(F.col("backend") == b, F.col("label")))
    return src.predictions(spark, d).groupBy("row_id", "field").agg(side("bayes").alias("m"), side("tfidf").alias("c")).groupBy("row_id").agg(F.count_if(F.col("m") != F.col("c")).alias("disagreements"))


@pair(f"with {OBS}, {REV}, {_LAST} select o.source_item_id, o.model_id, coalesce(human_aspect, aspect) as aspect, coalesce(human_polarity, polarity) as polarity from obs o join last l on o.source_item_id = l.source_item_id and o.model_id = l.model_id where not excluded and (human_polarity is not null or human_aspect is not null)")
def training_rows(spark, d):
    return review.training_rows(src.observations(spark, d), src.reviews(spark, d)).select("source_item_id", "model_id", "aspect", "polarity")


@pair(f"with {OBS} select source_item_id, thread_id from obs where thread_id is null or thread_id not in (select thread_id from obs where thread_id % 10 = 3)")
def thread_exclusion(spark, d):
    obs = src.observations(spark, d)
    return review.without_threads(obs, obs.where("thread_id % 10 = 3")).select("source_item_id", "thread_id")


@pair(f"with {OBS}, {REV}, {_LAST} select count(*) as reviewed, count(*) filter (excluded) as excluded, count(*) filter (coalesce(human_polarity <> polarity, false) or coalesce(human_aspect <> aspect, false)) as changed, (select count(*) from obs) - count(*) as remaining from last l join obs o on o.source_item_id = l.source_item_id and o.model_id = l.model_id")
def review_progress(spark, d):
    out = review.apply_reviews(src.observations(spark, d), src.reviews(spark, d))
    return out.agg(F.count("excluded").alias("reviewed"), F.count_if("excluded").alias("excluded"), F.count_if("changed").alias("changed"), F.count_if(F.col("excluded").isNull()).alias("remaining"))


_GATES = {"aspect": 0.4, "polarity": 0.3, "task": 0.5, "firsthand": 0.5}
_WIDE = "wide as (select row_id, " + ", ".join(f"max(confidence) filter (field = '{f}') as {f}_c" for f in src.FIELDS) + " from predictions where backend = 'bayes' group by 1)"


@pair(f"with {OBS}, {PRED}, {_WIDE} select source_item_id, task_c >= 0.5 as task_applied, firsthand_c >= 0.5 as firsthand_applied from obs join wide on source_item_id = row_id where aspect_c >= 0.4 and polarity_c >= 0.3")
def machine_gate(spark, d):
    wide = review.widened(src.predictions(spark, d).where("backend = 'bayes'"), src.FIELDS)
    return review.gate(src.observations(spark, d), wide, _GATES).select("source_item_id", "task_applied", "firsthand_applied")


@pair("""with recursive t as (select conv_id as thread, turn as node, case when turn > 0 then cast(floor((turn - 1) / 2) as bigint) end as parent, turn % 7 = 6 as deleted from conversations),
w as (select thread, node, parent, 0 as depth from t where parent is null and not deleted union all select t.thread, t.node, t.parent, w.depth + 1 from t join w on t.thread = w.thread and t.parent = w.node where not t.deleted and w.depth < 3)
select * from (select thread, node, parent, depth, row_number() over (partition by thread order by depth, node) as place from w) where place <= 6""")
def thread_walk(spark, d):
    turns = src.table(spark, d, "conversations").selectExpr("conv_id as thread", "turn as node", "case when turn > 0 then cast(floor((turn - 1) / 2) as bigint) end as parent", "turn % 7 = 6 as deleted")
    return review.thread_walk(turns, 3, 6)


@pair(f"with {OBS} select source_item_id, model_id, aspect from (select *, row_number() over (partition by thread_id, model_id, aspect order by seq) as rn from obs) where rn = 1")
def first_wins_dedup(spark, d):
    return review.first_wins(src.observations(spark, d), ["thread_id", "model_id", "aspect"], ["seq"]).select("source_item_id", "model_id", "aspect")


@pair(f"with {OBS} select thread_id, model_id, task, source_item_id from (select *, row_number() over (partition by thread_id, model_id, task order by seq desc) as rn from obs) where rn = 1 and (thread_id is null or thread_id not in (1000, 7))")
def training_merge(spark, d):
    obs = src.observations(spark, d)
    return dedup.merged(obs, ["thread_id", "model_id", "task"], obs.where("thread_id in (1000, 7)")).select("thread_id", "model_id", "task", "source_item_id")


# -------------------------------------------------------------------- evaluation


@pair(f"""with {PRED}, s as (select backend, field, label as l, (label = actual)::int as tp, (label <> actual)::int as fp, 0 as fn from predictions union all select backend, field, actual, 0, 0, (label <> actual)::int from predictions),
p as (select backend, field, l, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from s group by 1, 2, 3)
select backend, field, round(avg(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) as macro_f1, round(sum(tp) / (sum(tp) + sum(fn)), 6) as accuracy, count(*) as labels from p group by 1, 2""")
def classification_metrics(spark, d):
    return r6(evaluation.macro_f1(src.predictions(spark, d)), "macro_f1", "accuracy")


_CUTS = (0.3, 0.5, 0.7, 0.9)
_THRESHOLDS = f"t as (select field, threshold, count(*) as n, count(*) filter (confidence >= threshold) as answered, avg((confidence >= threshold)::int) as coverage, avg(case when confidence >= threshold then (label = actual)::int end) as precision, avg(case when confidence >= threshold then confidence end) as mean_confidence from predictions cross join (select unnest([{', '.join(map(str, _CUTS))}]::double[]) as threshold) group by 1, 2)"


@pair(f"with {PRED}, {_THRESHOLDS} select field, threshold, n, answered, round(coverage, 6) as coverage, round(precision, 6) as precision, round(mean_confidence, 6) as mean_confidence from t")
def threshold_report(spark, d):
    return r6(evaluation.thresholds(src.predictions(spark, d), _CUTS), "coverage", "precision", "mean_confidence")


@pair(f"with {PRED}, {_THRESHOLDS} select field, min(threshold) filter (precision >= 0.34) as threshold from t group by 1")
def operating_point(spark, d):
    return evaluation.operating_point(evaluation.thresholds(src.predictions(spark, d), _CUTS), 0.34)


_VOTES = "v as (select row_id, field, case when votes >= 2 and mean >= 0.5 then label end as label, votes, mean, actual from (select *, row_number() over (partition by row_id, field order by votes desc, mean desc, label) as rn from (select row_id, field, label, count(*) as votes, round(avg(confidence), 9) as mean, max(actual) as actual from predictions group by 1, 2, 3)) where rn = 1)"


@pair(f"with {PRED}, {_VOTES} select row_id, field, label, votes, round(mean, 6) as mean from v")
def ensemble_vote(spark, d):
    return r6(evaluation.vote(src.predictions(spark, d)).drop("actual"), "mean")


@pair(f"with {PRED}, {_VOTES} select field, count(*) as n, count(label) as answered, round(avg((label = actual)::int), 6) as precision, round(avg((label is not null)::int), 6) as coverage from v group by 1")
def ensemble_metrics(spark, d):
    return r6(evaluation.vote_metrics(evaluation.vote(src.predictions(spark, d))), "precision", "coverage")


@pair(f"with {PRED}, n as (select field, actual, label, count(*) as n from predictions where actual <> label group by 1, 2, 3) select * from (select field, actual, label, n, row_number() over (partition by field order by n desc, actual, label) as rank from n) where rank <= 20")
def label_confusion(spark, d):
    return evaluation.confusion(src.predictions(spark, d))


@pair(f"with {OBS}, g as (select thread_id, md5(concat_ws('|', '11', cast(thread_id as varchar))) as h from (select distinct thread_id from obs where thread_id is not null)), n as (select greatest(1, cast(round_even(0.25 * count(*), 0) as bigint)) as k from g), r as (select *, row_number() over (order by h, thread_id) as rn from g) select thread_id, rn <= k as test from r, n")
def grouped_split(spark, d):
    return evaluation.grouped_split(src.observations(spark, d), "thread_id", 11)


@pair(f"with {OBS} select distinct thread_id, cast(('0x' || substring(md5(concat_ws('|', '5', cast(thread_id as varchar))), 1, 8)) as bigint) % 5 as fold from obs where thread_id is not null")
def grouped_folds(spark, d):
    return evaluation.grouped_folds(src.observations(spark, d), "thread_id", 5, 5)


@pair(f"with {OBS}, s as (select distinct model_id, aspect, task from obs where thread_id = 1000), t as (select distinct model_id, aspect, task from obs where thread_id < 40) select * from s except select * from t")
def label_set_difference(spark, d):
    rows = src.observations(spark, d)
    one, two = (rows.where(c).select("model_id", "aspect", "task").distinct() for c in ("thread_id = 1000", "thread_id < 40"))
    return one.join(two, ["model_id", "aspect", "task"], "left_anti")


# --------------------------------------------------------------- text and linking

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _unescape_sql() -> str:
    """`text.unescape` of a column x: the standard table as a map, numbers by their rules; texts without & are not searched."""
    names = f"map([{', '.join(map(_quoted, html5))}], [{', '.join(map(_quoted, html5.values()))}])"
    digits = "regexp_replace(regexp_replace(e, '^&#[xX]?0*', ''), ';$', '')"
    n = f"case when length({digits}) > 9 then 1114112 when {digits} = '' then 0 when regexp_matches(e, '^&#[xX]') then cast('0x' || {digits} as bigint) else cast({digits} as bigint) end"
    number = f"list_transform([{n}], lambda n: case when n = 0 or n between 55296 and 57343 or n > 1114111 then chr(65533) when n = 13 then chr(13) when n between 128 and 159 then substr({_quoted(T.WINDOWS)}, cast(n as int) - 127, 1) when (n < 32 and n not in (9, 10, 12)) or n = 127 or n between 64976 and 65007 or n % 65536 >= 65534 then '' else chr(cast(n as int)) end)[1]"
    begun = ", ".join(f"m[left(substr(e, 2), {k})] || substr(e, {k + 2})" for k in range(T.SHORT_NAME, 1, -1))
    parts = f"list_transform(regexp_extract_all(x, {_quoted(T.ENTITY)}), lambda e: case when starts_with(e, '&#') then {number} else list_transform([{names}], lambda m: coalesce(m[substr(e, 2)], {begun}, e))[1] end)"
    return f"case when contains(x, '&') then list_reduce(list_transform(list_zip(regexp_split_to_array(x, {_quoted(T.ENTITY)}), {parts}), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), lambda a, b: a || b) else x end"


_UNESCAPE = _unescape_sql()
_SPACE = r"[\s\x0B\x{85}\p{Z}\x1C-\x1F]+"


def norm_sql(x: str) -> str:
    """A list of one text, so that the text is written once."""
    stripped = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace(list_transform([{stripped}], lambda x: {_UNESCAPE})[1], '{_SPACE}', ' ', 'g'))"


@pair(f"select page_id, {norm_sql('html')} as text from pages")
def normalize_html(spark, d):
    return src.table(spark, d, "pages").select("page_id", T.normalize(F.col("html")).alias("text"))


@pair("select doc_id, substring(sha256('salt:' || cast(doc_id as varchar)), 1, 24) as author, source || ':' || cast(doc_id as varchar) as item_key from documents")
def identifiers(spark, d):
    return src.table(spark, d, "documents").select("doc_id", T.hash_identifier(F.col("doc_id"), "salt").alias("author"), F.concat_ws(":", "source", "doc_id").alias("item_key"))


@pair(f"with f as (select doc_id, sha256(lower({norm_sql('text')})) as fingerprint from documents) select doc_id, fingerprint, min(doc_id) over (partition by fingerprint) as representative, count(*) over (partition by fingerprint) as copies from f")
def content_dedup(spark, d):
    return dedup.content_groups(src.table(spark, d, "documents"), "doc_id", "text").select("doc_id", "fingerprint", "representative", "copies")


@pair(r"with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', concat('\1', chr(10)), 'g'), '\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') as s from documents) select doc_id, cast(len(s) as int) as sentences, s[1] as first, s[len(s)] as last from s")
def sentence_split(spark, d):
    s = src.table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.try_element_at("s", F.lit(1)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


_ALIASES = (("the", "m-the", "p1", True), ("of the", "m-of-the", "p1", False), ("and", "m-and", "p2", True), ("und", "m-und", "p2", False), ("que", "m-que", "p3", False))
_MENTIONS = r"""doubled as (select doc_id, ' ' || regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g') || ' ' as t from documents),
found as (select doc_id, unnest(regexp_extract_all(t, '[^a-z0-9](of  the|the|and|und|que)[^a-z0-9]', 1)) as a from doubled),
mentions as (select doc_id, replace(a, '  ', ' ') as alias from found)"""


def _catalog(spark):
    return spark.createDataFrame(list(_ALIASES), "alias string, model_id string, provider_id string, generic boolean")


@pair(f"with {_MENTIONS} select doc_id, alias, 'm-' || replace(alias, ' ', '-') as model_id, count(*) as n from mentions group by 1, 2, 3")
def alias_mentions(spark, d):
    return linking.mentions(src.table(spark, d, "documents"), _catalog(spark), "doc_id", "text").groupBy("doc_id", "alias", "model_id").agg(F.count("*").alias("n"))


@pair(f"with {_MENTIONS}, c as (select doc_id, alias, case when alias in ('the', 'of the') then 'p1' when alias in ('and', 'und') then 'p2' else 'p3' end as provider_id, alias in ('the', 'and') as generic from mentions), s as (select *, max((not generic)::int) over (partition by doc_id, provider_id) as s from c) select doc_id, alias, count(*) as n from s where not generic or s = 0 group by 1, 2")
def specific_mentions(spark, d):
    found = linking.mentions(src.table(spark, d, "documents"), _catalog(spark), "doc_id", "text")
    return linking.drop_generic(found, "doc_id").groupBy("doc_id", "alias").agg(F.count("*").alias("n"))


_NAMES = "case event_id % 6 when 0 then 'Alpha-1' when 1 then 'beta-2x' when 2 then 'gamma' when 3 then '' when 4 then null else ' delta ' end as model, case when event_id % 4 = 0 then 'Acme' when event_id % 4 = 1 then '' else null end as provider"


@pair(f"""with n as (select event_id, {_NAMES} from events), m as (select *, nullif(lower(trim(model)), '') as m from n)
select event_id, case when m is null then 'unknown' when m = 'alpha-1' then 'registry' when regexp_matches(m, '[0-9]') then 'versioned_unregistered' else 'unversioned' end as status,
case when m = 'alpha-1' or regexp_matches(m, '[0-9]') then m end as resolved_model,
coalesce(case when m = 'alpha-1' then 'apex' end, case when split_part(m, '-', 1) = 'beta' then 'bold' end, nullif(lower(trim(provider)), ''), 'unknown') as resolved_provider from m""")
def identity_resolution(spark, d):
    rows = src.table(spark, d, "events").selectExpr("event_id", *_NAMES.replace("end as model, ", "end as model;").split(";"))
    registry = spark.createDataFrame([("Alpha-1", "apex")], "model_id string, provider_id string")
    return linking.resolve(rows, registry, {"beta": "bold"}).select("event_id", "status", "resolved_model", "resolved_provider")


_LEXICON = {"article": ("the", "der", "die"), "join": ("and", "und", "et "), "place": ("in ", "at ", "on ")}
_POSITIVE, _NEGATIVE = ("with", "for", "mit"), ("idiot", "clown", "worthless", "!!")


def _n(terms) -> str:
    return " + ".join(f"(contains(l, '{t}'))::int" for t in terms)


@pair(f"""with a as (select doc_id, lower(text) as l from documents), n as (select doc_id, {_n(_LEXICON['article'])} as a, {_n(_LEXICON['join'])} as j, {_n(_LEXICON['place'])} as p, {_n(_POSITIVE)} as pos, {_n(_NEGATIVE)} as neg from a),
q as (select *, greatest(-2, least(2, pos - neg)) as polarity from n)
select doc_id, a as n_article, j as n_join, p as n_place, case when greatest(a, j, p) = 0 then 'none' when a = greatest(a, j, p) then 'article' when j = greatest(a, j, p) then 'join' else 'place' end as category, polarity,
case when polarity > 0 then 'praise' when polarity < 0 then 'complaint' else 'neutral' end as claim_type, round(least(1e0, abs(polarity) / 2e0 + 0.15 * ((a > 0)::int + (j > 0)::int + (p > 0)::int)), 6) as severity from q""")
def lexicon_labels(spark, d):
    spans = src.table(spark, d, "documents").select("doc_id", F.col("text").alias("span"))
    out = extract.labelled(spans, _LEXICON, ("article", "join", "place"), _POSITIVE, _NEGATIVE, "none")
    return r6(out.select("doc_id", "n_article", "n_join", "n_place", "category", "polarity", "claim_type", "severity"), "severity")


@pair(None)
def best_spans(spark, d):
    spans = extract.candidate_spans(src.table(spark, d, "documents"), "doc_id", "text", ("idiot", "clown", "with ", "und "))
    out = extract.labelled(spans, _LEXICON, ("article", "join", "place"), _POSITIVE, _NEGATIVE, "none")
    return extract.best_spans(out, ["doc_id", "category"], "doc_id").select("doc_id", "category", "place", "polarity", "span_score", "span")


@pair(r"""with n as (select doc_id, text, case when trim(text) = '' then 0 else len(list_filter(regexp_split_to_array(trim(text), '[ \t\n\x0B\f\r]+'), lambda t: t <> '')) end as tokens, length(regexp_replace(text, '\P{L}', '', 'g')) as letters, length(regexp_replace(regexp_replace(text, '\P{L}', '', 'g'), '[A-Za-z]', '', 'g')) as other from documents)
select doc_id, (regexp_matches(text, '[\x{4e00}-\x{9fff}]') and tokens < 40) or (coalesce(other * 1e0 / nullif(letters, 0), 0) > 0.55 and tokens < 30) as garbled from n""")
def garbled_texts(spark, d):
    return src.table(spark, d, "documents").select("doc_id", T.garbled(F.col("text")).alias("garbled"))


# ------------------------------------------------------------- duplicates, vectors


@pair(None)
def simhash_pairs(spark, d):
    return dedup.signature_links(dedup.simhash(src.table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@pair(None)
def simhash_groups(spark, d):
    """The group of near copies of every document; a test compares the operator with all pairs."""
    return dedup.near_groups(cut(dedup.simhash(src.table(spark, d, "documents"), "doc_id", "text")), "doc_id")


@pair("with c as (select label, list(m order by k) as centroid from (select label, k, avg(x::double) as m from (select label, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as k from embeddings) group by 1, 2) group by 1) select e.vec_id, c.label, round(list_cosine_similarity(e.embedding::double[], c.centroid), 6) as feature from embeddings e, c")
def rubric_features(spark, d):
    e = src.table(spark, d, "embeddings")
    dims = len(e.select("embedding").first()[0])
    return r6(vectors.rubric_features(e, "embedding", vectors.centroids(e, "embedding", "label", dims), "vec_id"), "feature")


# ----------------------------------------------------------------------- learning

_TOKENS = "tok as (select doc_id, lang, token, count(*) as n from (select doc_id, lang, lower(unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_+-]+'))) as token from documents) group by 1, 2, 3)"


@pair(f"with {_TOKENS} select lang, token, sum(n)::bigint as n from tok group by 1, 2")
def bayes_counts(spark, d):
    docs = src.table(spark, d, "documents")
    return learning.fit(docs, learning.tokens(docs, "doc_id", "text", "lang"), "lang")[1]


@pair(f"""with {_TOKENS}, per as (select lang, token, sum(n) as n from tok group by 1, 2), cls as (select d.lang, d.rows, t.total from (select lang, count(*) as rows from documents group by 1) d join (select lang, sum(n) as total from per group by 1) t using (lang)),
v as (select count(distinct token) as v from per), k as (select count(*) as k, sum(rows) as r from cls),
s as (select tok.doc_id, cls.lang as c, sum(tok.n * ln((coalesce(per.n, 0) + 1e0) / (cls.total + v))) + ln((any_value(cls.rows) + 1e0) / (any_value(r) + any_value(k))) as l from tok cross join cls cross join v cross join k left join per on per.lang = cls.lang and per.token = tok.token group by 1, 2),
e as (select *, exp(l - max(l) over (partition by doc_id)) as e from s), p as (select *, e / sum(e) over (partition by doc_id) as p from e)
select doc_id, arg_max(c, p) as predicted, round(max(p), 6) as confidence from p group by 1""")
def bayes_scores(spark, d):
    docs = src.table(spark, d, "documents")
    tok = learning.bags(docs, "doc_id", "text", "lang")
    return r6(learning.score(tok, *learning.fit(docs, tok, "lang"), "doc_id", "lang"), "confidence")


# -------------------------------------------------- windows of time (documented forms)


@pair(f"with {OBS}, n as (select max(published_at) as now from obs), w as (select model_id, " + ", ".join(f"sum(case when published_at >= now - interval {k} day and regression_flag then weight else 0 end) / nullif(sum(case when published_at >= now - interval {k} day then weight else 0 end), 0) as p{k}" for k in (30, 90, 180)) + " from obs, n group by 1) select model_id, round(p30, 6) as p30, round(p90, 6) as p90, round(p180, 6) as p180, round(100 / (1 + exp(-(p30 - p180) / sqrt(0.01))), 6) as risk from w")
def windowed_complaints(spark, d):
    obs = src.observations(spark, d)
    now = obs.agg(F.max("published_at").alias("now")).first().now
    rate = lambda k: F.try_divide(F.sum(F.when((F.col("published_at") >= F.lit(now) - F.expr(f"interval {k} days")) & F.col("regression_flag"), F.col("weight")).otherwise(0.0)), F.sum(F.when(F.col("published_at") >= F.lit(now) - F.expr(f"interval {k} days"), F.col("weight")).otherwise(0.0))).alias(f"p{k}")
    out = obs.groupBy("model_id").agg(rate(30), rate(90), rate(180))
    return r6(out.withColumn("risk", 100 / (1 + F.exp(-(F.col("p30") - F.col("p180")) / F.sqrt(F.lit(0.01))))), "p30", "p90", "p180", "risk")


@pair(f"with {OBS}, a as (select *, row_number() over (partition by author_id, model_id, cast(published_at as date) order by weight desc, seq) as x from obs where thread_id is not null), b as (select *, row_number() over (partition by thread_id, model_id order by weight desc, seq) as y from a where x = 1) select source_item_id, model_id from b where y <= 3")
def hard_caps(spark, d):
    rows = src.observations(spark, d).where("thread_id is not null")
    order = [F.desc("weight"), "seq"]
    rows = rows.withColumn("x", F.row_number().over(Window.partitionBy("author_id", "model_id", F.to_date("published_at")).orderBy(*order))).where("x = 1")
    return rows.withColumn("y", F.row_number().over(Window.partitionBy("thread_id", "model_id").orderBy(*order))).where("y <= 3").select("source_item_id", "model_id")


@pair(f"with {OBS}, n as (select model_id, date_trunc('day', published_at) as day, count(*) as n from obs group by 1, 2), m as (select *, avg(n) over (partition by model_id order by day rows between 7 preceding and 1 preceding) as mean from n) select model_id, cast(day as date) as day, n, round(mean, 6) as mean, coalesce(n > 2 * mean and n >= 5, false) as burst from m")
def bursts(spark, d):
    n = src.observations(spark, d).groupBy("model_id", F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"))
    out = n.withColumn("mean", F.avg("n").over(Window.partitionBy("model_id").orderBy("day").rowsBetween(-7, -1)))
    return r6(out.withColumn("burst", F.coalesce((F.col("n") > 2 * F.col("mean")) & (F.col("n") >= 5), F.lit(False))), "mean")


@pair(f"with {OBS}, w as (select *, cast(date_trunc('month', published_at) as date) as month from obs), {cells_sql('month, model_id, aspect', 'w')} select month, model_id, aspect, {_CELL_OUT} from cells")
def monthly_snapshots(spark, d):
    obs = src.observations(spark, d).withColumn("month", F.to_date(F.date_trunc("month", "published_at")))
    return _board(scoring.cell_scores(obs, ("month", "model_id", "aspect")))


@pair(f"with {OBS} select model_id, aspect, count(distinct platform) as platforms, count(distinct platform) >= 2 as corroborated from obs where abs(polarity) = 2 group by 1, 2")
def corroboration(spark, d):
    return src.observations(spark, d).where("abs(polarity) = 2").groupBy("model_id", "aspect").agg(F.countDistinct("platform").alias("platforms")).withColumn("corroborated", F.col("platforms") >= 2)


# --------------------------------------------- decisions, hold-outs, vector work


_F1 = """s as (select backend, field, label as l, (label = actual)::int as tp, (label <> actual)::int as fp, 0 as fn from predictions union all select backend, field, actual, 0, 0, (label <> actual)::int from predictions),
p as (select backend, field, l, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from s group by 1, 2, 3),
m as (select backend, field, avg(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0)) as f1 from p group by 1, 2)"""


@pair(f"with {PRED}, {_F1}, b as (select backend, avg(f1) as mean_f1, min(f1) as lowest, count(*) as fields from m group by 1) select backend, round(mean_f1, 6) as mean_f1, round(lowest, 6) as lowest, fields, row_number() over (order by round(mean_f1, 9) desc, backend) as position from b")
def backend_ranking(spark, d):
    return r6(evaluation.backend_ranking(evaluation.macro_f1(src.predictions(spark, d))), "mean_f1", "lowest")


@pair(f"with {OBS}, h as (select source_item_id, aspect as label, md5('23|' || cast(source_item_id as varchar)) as h from obs), r as (select *, row_number() over (partition by label order by h, source_item_id) as rn, count(*) over (partition by label) as n from h) select source_item_id, label, rn <= case when n > 1 then greatest(1, cast(round_even(0.25 * n, 0) as bigint)) else 0 end as test from r")
def stratified_split(spark, d):
    return evaluation.stratified_split(src.observations(spark, d), "source_item_id", "aspect", 23)


@pair(f"with {PRED}, a as (select backend, field, avg((label = actual)::int) as accuracy from predictions group by 1, 2) select row_id, backend, field, case when round(accuracy, 9) >= 0.5 then label end as suggestion from predictions join a using (backend, field)")
def gated_suggestions(spark, d):
    return evaluation.suggestions(src.predictions(spark, d), 0.5)


@pair("with t as (select doc_id, sha256(text) as text_hash from documents where text is not null), c as (select distinct text_hash from t join labels using (doc_id)) select t.text_hash, min(doc_id) as doc_id, count(*) as copies, t.text_hash in (select text_hash from c) as hit from t group by t.text_hash")
def embedding_work_list(spark, d):
    docs = src.table(spark, d, "documents")
    cached = docs.join(src.table(spark, d, "labels").select("doc_id"), "doc_id").where("text is not null").select(F.sha2("text", 256).alias("text_hash"))
    return dedup.work_list(docs, "doc_id", "text", cached)


@pair("with t as (select doc_id, sha256(text) as h from documents), v as (select h, min(vec_id) as vec_id from t join embeddings on vec_id = doc_id group by 1) select doc_id, vec_id from t left join v using (h)")
def embedding_attach(spark, d):
    docs = src.table(spark, d, "documents")
    known = docs.join(src.table(spark, d, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"))
    return dedup.attach(docs, "doc_id", "text", known.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("vec_id").alias("vec_id")))


#: Parameters: weights of tasks, and of aspects in three profiles.
TASK_WEIGHTS = {0: 3.0, 1: 2.0, 2: 2.0, 3: 1.0, 4: 1.0, 5: 0.5}
PROFILES = {"builder": {0: 3.0, 2: 3.0, 7: 2.0}, "thrifty": {0: 2.0, 3: 4.0, 1: 1.0}, "careful": {2: 2.0, 4: 4.0, 5: 2.0}}
_TASKS_SQL = ", ".join(f"({k}, {v}e0)" for k, v in TASK_WEIGHTS.items())
_PROFILES_SQL = ", ".join(f"('{p}', {k}, {v}e0)" for p, w in PROFILES.items() for k, v in w.items())


@pair(f"with {OBS}, {cells_sql('model_id, aspect, task')} select model_id, aspect, round(sum(score * weight) / sum(weight), 6) as utility, count(*) as parts from cells join (values {_TASKS_SQL}) w(task, weight) using (task) group by 1, 2")
def task_portfolio(spark, d):
    weights = spark.createDataFrame(list(TASK_WEIGHTS.items()), "task int, weight double")
    return r6(decisions.weighted(scoring.cell_scores(src.observations(spark, d), ("model_id", "aspect", "task")), weights, "task", ["model_id", "aspect"]), "utility")


@pair(f"with {OBS}, {cells_sql('model_id, aspect')}, u as (select profile, model_id, sum(score * weight) / sum(weight) as utility, count(*) as parts from cells join (values {_PROFILES_SQL}) w(profile, aspect, weight) using (aspect) group by 1, 2) select * from (select profile, model_id, round(utility, 6) as utility, parts, row_number() over (partition by profile order by round(utility, 9) desc, model_id) as position from u) where position <= 3")
def profile_choices(spark, d):
    weights = spark.createDataFrame([(p, k, v) for p, w in PROFILES.items() for k, v in w.items()], "profile string, aspect int, weight double")
    scores = scoring.cell_scores(src.observations(spark, d), ("model_id", "aspect"))
    return r6(decisions.best(decisions.weighted(scores, weights, "aspect", ["profile", "model_id"]), "profile", "model_id", 3), "utility")


@pair(f"with {OBS}, {cells_sql('model_id, aspect')}, p as (select cast(p_partkey % 8 as int) as model_id, avg(cast(p_retailprice as double)) as price from part group by 1), n as (select model_id, 100 * ((select max(price) from p) - price) / ((select max(price) from p) - (select min(price) from p)) as price_norm from p) select model_id, round(score, 6) as score, round(price_norm, 6) as price_norm, round(0.7e0 * score + 0.3e0 * price_norm, 6) as value from cells join n using (model_id) where aspect = 3")
def value_scores(spark, d):
    prices = src.table(spark, d, "part").groupBy((F.col("p_partkey") % 8).cast("int").alias("model_id")).agg(F.avg(F.col("p_retailprice").cast("double")).alias("price"))
    cost = scoring.cell_scores(src.observations(spark, d), ("model_id", "aspect")).where("aspect = 3")
    return r6(decisions.value(cost, prices, "model_id"), "score", "price_norm", "value")


@pair(f"with {OBS}, r as (select model_id, cast(min(published_at) as date) + 10 as released from obs group by 1), g as (select obs.*, (polarity + 2) * 25e0 as v, date_diff('day', released, cast(published_at as date)) as gap from obs join r using (model_id)), a as (select model_id, aspect, count(*) filter (gap < 0) as n_before, count(*) filter (gap >= 0) as n_after, sum(weight * v) filter (gap < 0) / sum(weight) filter (gap < 0) as before, sum(weight * v) filter (gap >= 0) / sum(weight) filter (gap >= 0) as after from g where gap between -10 and 9 group by 1, 2) select model_id, aspect, n_before, n_after, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) as change from a")
def release_impact(spark, d):
    obs = src.observations(spark, d)
    releases = obs.groupBy("model_id").agg(F.date_add(F.to_date(F.min("published_at")), 10).alias("released"))
    return r6(decisions.release_impact(obs, releases, 10, (F.col("polarity") + 2) * 25.0), "before", "after", "change")


@pair(f"with {OBS}, {PRED}, {_F1}, g as (select avg(f1) as mean, min(f1) as worst from m), n as (select count(*) as examples, count(distinct thread_id) as groups from obs), a as (select *, concat_ws(',', case when examples < 300 then 'examples' end, case when groups < 75 then 'groups' end, case when mean < 0.7 then 'mean_macro_f1' end, case when worst < 0.6 then 'field_macro_f1' end) as failures from g, n) select round(mean, 6) as mean, round(worst, 6) as worst, examples, groups, failures, failures = '' as ready from a")
def readiness_gates(spark, d):
    size = src.observations(spark, d).agg(F.count("*").alias("_e"), F.countDistinct("thread_id").alias("_g"))
    scores = evaluation.macro_f1(src.predictions(spark, d)).join(F.broadcast(size))  # one row
    return r6(evaluation.readiness(scores, F.col("_e"), F.col("_g")), "mean", "worst")


# ------------------------------------------------- evidence types and exclusions

#: Terms of each flag: parameters of the two queries below.
_FLAGS = {"firsthand": [" we ", "my "], "comparative": [" than ", " like "], "regression": ["worse", "broken"], "hallucination": ["invented", "made up"], "refusal": ["refuse", "decline"], "value": ["price", "cheap"], "release": ["release", "version"], "bench": ["benchmark", "score"], "noise": ["password", "license"], "wiring": ["api", "sdk", "integration", "bug"]}
_HARDWARE = ["memory", "driver", "server", "install", "cable"]
_FLAGS_SQL = ", ".join(f"({' or '.join(f'contains(l, {chr(39)}{t}{chr(39)})' for t in terms)}) as {flag}" for flag, terms in _FLAGS.items())
_FLAGGED = f"""t as (select doc_id, coalesce(text, '') as text, lower(coalesce(text, '')) as l from documents),
f as (select doc_id, text, {_FLAGS_SQL}, ({_n(_HARDWARE)}) >= 2 as hardware, greatest(-2, least(2, {_n(_POSITIVE)} - ({_n(_NEGATIVE)}))) as polarity from t)"""
_JUDGED = "(firsthand or comparative or regression or hallucination or refusal or value or polarity <> 0)"
#: Names of evidence types and exclusion reasons, in the order in which they apply.
_EVIDENCE = [("bug_regression_report", "regression"), ("integration_failure", "wiring"), ("comparative_evaluation", "comparative"), ("benchmark_anecdote", "bench"), ("pricing_value_comment", "value"), ("release_update_reaction", "release"), ("firsthand_usage", "firsthand")]
_REASONS = [("hardware_infra_requirements", "hardware and not (firsthand or regression or hallucination or refusal)"), ("tooling_or_bot_transcript", f"noise and not {_JUDGED}"), ("factual_release_or_adoption", f"release and not {_JUDGED}"), ("benchmark_without_user_judgment", f"bench and not {_JUDGED}"), ("not_about_model_quality", f"not {_JUDGED}")]


def _flagged(spark, d) -> DataFrame:
    docs = src.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low = F.lower("text")
    any_of = {flag: F.size(extract.hits(low, terms)) > 0 for flag, terms in _FLAGS.items()}
    return docs.withColumns(any_of | {"hardware": F.size(extract.hits(low, _HARDWARE)) >= 2, "polarity": extract.polarity(F.size(extract.hits(low, _POSITIVE)), F.size(extract.hits(low, _NEGATIVE)))})


@pair(f"with {_FLAGGED} select doc_id, concat_ws(',', {', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in _EVIDENCE)}, case when not ({' or '.join(c for _, c in _EVIDENCE)}) then 'hearsay' end) as evidence from f")
def evidence_types(spark, d):
    types = extract.all_rules([(n, F.expr(c)) for n, c in _EVIDENCE], "hearsay")
    return _flagged(spark, d).select("doc_id", F.array_join(types, ",").alias("evidence"))


@pair(rf"""with {_FLAGGED}, n as (select *, case when trim(text) = '' then 0 else len(list_filter(regexp_split_to_array(trim(text), '[ \t\n\x0B\f\r]+'), lambda t: t <> '')) end as tokens, length(regexp_replace(text, '\P{{L}}', '', 'g')) as letters, length(regexp_replace(regexp_replace(text, '\P{{L}}', '', 'g'), '[A-Za-z]', '', 'g')) as other from f)
select doc_id, case when (regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') and tokens < 40) or (coalesce(other * 1e0 / nullif(letters, 0), 0) > 0.55 and tokens < 30) then 'non_english_or_garbled' {' '.join(f"when {c} then '{n}'" for n, c in _REASONS)} end as reason from n""")
def exclusion_reasons(spark, d):
    rules = [("non_english_or_garbled", T.garbled(F.col("text")))] + [(n, F.expr(c)) for n, c in _REASONS]
    return _flagged(spark, d).select("doc_id", extract.exclusion(rules).alias("reason"))


from . import chain, heads, more, reports  # noqa: E402, F401  register further queries
