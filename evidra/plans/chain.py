"""Registered queries of the extractor chain (items to observations to scores) and of the small text and registry steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, greedy, heads, learning, neighbours, registry, scoring, vectors
from ..sources import adapters as src
from .catalog import _board, _CELL_OUT, cells_sql, norm_sql, pair, r6

# ----------------------------------------------------------------- rules of the tables
# The texts are invented prose, so lexicons and aliases are common syllables and words of theirs.

RULES = claims.Rules(
    tasks={"reading": ("is ", "are "), "writing": ("est ", "ist ")},
    aspects={"speed": ("tion", "ung "), "cost": ("ment", "keit"), "trust": ("elle", "heit")},
    positive=("for ", "mit ", "pour "), negative=("idiot", "clown", "pas ", "nicht"),
    flags={"firsthand": ("we ", "ich "), "comparative": ("than ", "als "), "regression": ("sich ",), "hallucination": ("onnd",), "refusal": ("dans ",), "value": ("pri", "ein "), "release": ("das ",), "benchmark": ("sch",), "noise": ("qui ",)},
    hardware=("r.", "er.", "an."), ignored=("for the",), prefaces=("the ", "le ", "als "), instructions=("der ", "en "),
    platform_weights={"issues": 1.25, "forum": 1.15, "qa": 1.2, "video": 1.0, "review": 1.15}, issues="issues", forum="forum",
)
_ALIASES = (("with", "m-with", "p1"), ("und", "m-und", "p2"), ("avec", "m-avec", "p3"), ("que", "m-que", "p3"), ("that", "m-that", "p1"))


def items(spark, d):
    """Documents as raw items of five platforms."""
    platform = F.element_at(F.array(*map(F.lit, src.PLATFORMS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return src.table(spark, d, "documents").select(
        F.col("doc_id").alias("source_item_id"), platform.alias("platform"), F.substring(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), 1, 80).alias("title"), F.col("text").alias("body"),
        (F.col("doc_id") % 97).alias("thread_id"), (F.col("doc_id") % 211).alias("author_id"), F.col("source").alias("community_id"), (F.col("doc_id") % 3 == 0).alias("is_root_story"),
        F.create_map(F.lit("chars"), F.col("n_chars").cast("double")).alias("engagement"),
    )


def catalog(spark):
    return spark.createDataFrame(list(_ALIASES), "alias string, model_id string, provider_id string")


def _any(x: str, terms) -> str:
    return "(" + (" or ".join(f"contains({x}, '{t}')" for t in dict.fromkeys(terms)) or "false") + ")"


def _begins(x: str, terms) -> str:
    quoted = [t.replace("'", "''") for t in terms]
    return "(" + (" or ".join(f"starts_with({x}, '{t}')" for t in quoted) or "false") + ")"


def _count(x: str, terms) -> str:
    return "(" + (" + ".join(f"contains({x}, '{t}')::int" for t in terms) or "0") + ")"


def _split(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([.!?])[ \t\n\x0B\f\r]+', concat('\1', chr(10)), 'g'), '\n+'), lambda y: trim(y, ' ')), lambda y: y <> '')"


def _primary(of, default: str) -> str:
    top = "greatest(" + ", ".join(_count("l", t) for t in of.values()) + ")"
    return f"case when {top} = 0 then '{default}' " + " ".join(f"when {_count('l', t)} = {top} then '{k}'" for k, t in of.items()) + " end"


_NAMES = "|".join(a for a, *_ in _ALIASES)
_R = RULES
_QUALITY = [*_R.positive, *_R.negative, *(t for k in claims.FLAGS if k != "noise" for t in _R.flags[k]), *claims.SIGNALS]
_JUDGING = [*_R.positive, *_R.negative, *_R.flags["firsthand"], *_R.flags["comparative"]]


def _named(x: str) -> str:
    return f"regexp_matches(lower({x}), '(^|[^a-z0-9])({_NAMES})($|[^a-z0-9])')"


def _question(x: str) -> str:
    return f"(ends_with(lower(trim({x})), '?') and not {_any(f'lower(trim({x}))', _JUDGING)})"


def _instruction(x: str) -> str:
    return _begins(f"lower(trim({x}))", _R.instructions)


_FIRSTHAND_SQL = T.FIRSTHAND.replace("'", "''")
_TERMS: dict[str, set[str]] = {}
for _t in [*_R.positive, *_R.negative]:
    _TERMS.setdefault(_t, set()).add("q")
for _t in [*(t for x in (_R.tasks, _R.aspects) for v in x.values() for t in v), *(t for v in _R.flags.values() for t in v)]:
    _TERMS.setdefault(_t, set()).add("l")
_JUDGED = "(abs(polarity) > 0 or " + " or ".join(f"{k}_flag" for k in ("firsthand", "comparative", "regression", "hallucination", "refusal", "value")) + ")"
_KEEPS = "(firsthand_flag or regression_flag or hallucination_flag or refusal_flag)"
_LINES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(raw, '(?s)<!--.*?-->', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '\r\n|\r|\n'), lambda y: trim(y, ' ')), lambda y: y <> '' and not regexp_matches(y, '^[-*]\s+\[[ xX]\]\s') and (" + _named("y") + r" or not (regexp_matches(y, '^#{1,6}\s') or " + _begins("lower(y)", T.TEMPLATE_LINES) + ")))"
_WITHOUT_URLS = r"regexp_replace(raw, 'https?://\S+', ' ', 'g')"
_CLEAN = f"case platform when 'issues' then {norm_sql(f'array_to_string({_LINES}, chr(10))')} when 'forum' then {norm_sql(_WITHOUT_URLS)} else {norm_sql('raw')} end"
_ITEMS = f"""items as (select doc_id as source_item_id, ['forum', 'qa', 'issues', 'video', 'review'][doc_id % 5 + 1] as platform, {norm_sql("substring(split_part(coalesce(text, ''), chr(10), 1), 1, 80)")} as title, coalesce(text, '') as raw,
  doc_id % 97 as thread_id, doc_id % 211 as author_id, source as community_id, doc_id % 3 = 0 as root, n_chars from documents),
clean as (select * exclude (raw), {_CLEAN} as body from items)"""
#: What stands around names in these texts; `that` and `que` are the generic names of their providers.
CONTEXT = claims.Context(
    homonyms=(claims.Homonym(("und",), ("nicht", "sch "), 20), claims.Homonym(("with",), ("clown", "idiot"))),
    products=(("is", "prod-is"), ("la", "prod-la"), ("die", "prod-die")), profiles=(("des", "deep"), ("was", "fast")), not_after=(" de", " th"),
)
_GENERIC = {"that": ("with",), "que": ("avec",)}


def _places(x: str, alias: str, more: str = "true") -> str:
    """Places of a whole alias in a lower-cased text that meet a condition on i."""
    k, edge = len(alias), "'[a-z0-9]'"
    test = f"substring({x}, i, {k}) = '{alias}' and (i = 1 or not regexp_matches(substring({x}, i - 1, 1), {edge})) and not regexp_matches(substring({x}, i + {k}, 1), {edge}) and {more}"
    return f"case when contains({x}, '{alias}') then list_filter(range(1, length({x}) + 1), lambda i: {test}) else [] end"


def _meant(x: str) -> str:
    """Names of a lower-cased text in order, without homonyms."""
    parts = []
    for a, *_ in _ALIASES:
        other = [_any(x if h.width is None else f"substring({x}, greatest(i - {h.width}, 1), least(i - 1, {h.width}) + {len(a) + h.width})", h.signals) for h in CONTEXT.homonyms if a in h.aliases]
        parts.append(f"list_transform({_places(x, a, f'not ({chr(32) + (' or '.join(other) or 'false')})')}, lambda i: struct_pack(i := i, a := '{a}'))")
    return f"list_transform(list_sort(flatten([{', '.join(parts)}])), lambda m: m.a)"


def _product(x: str) -> str:
    out = "case"
    for alias, product in CONTEXT.products:
        before, after = f"substring({x}, greatest(i - 24, 1), least(i - 1, 24))", f"substring({x}, i + {len(alias)}, 24)"
        used = f"not contains({before}, '/') and not contains({after}, '/') and not {_any(after, CONTEXT.not_after)} and ({_any(before, CONTEXT.cues)} or {_any(after, CONTEXT.cues)})"
        out += f" when len({_places(x, alias, used)}) > 0 then '{product}'"
    return out + " end"


def _linked_names(x: str) -> str:
    out = _meant(x)
    for general, special in _GENERIC.items():
        out = f"list_filter({out}, lambda n: n <> '{general}' or not {_any_of(_meant(x), special)})"
    return out


def _any_of(names: str, wanted) -> str:
    return "(" + " or ".join(f"list_contains({names}, '{w}')" for w in wanted) + ")"


def _observed_sql(linked: bool) -> str:
    """CTEs up to obs; ``linked``: names, products and profiles by what stands around them."""
    named = (lambda x: f"(len({_meant(f'lower({x})')}) > 0)") if linked else _named
    names = _linked_names("l") if linked else r"regexp_extract_all(' ' || regexp_replace(l, '([^a-z0-9])', '\1\1', 'g') || ' ', '[^a-z0-9](" + _NAMES + ")[^a-z0-9]', 1)"
    profile = "case " + " ".join(f"when len({_places('l', a)}) > 0 then '{p}'" for a, p in CONTEXT.profiles) + " end"
    places = f", {_product('l')} as product_id, {profile} as inference_profile" if linked else ""
    key, order = (", product_id, inference_profile", ", product_id nulls first, inference_profile nulls first") if linked else ("", "")
    return f"""{_ITEMS},
sent as (select *, case when len({_split('body')}) > 0 then {_split('body')} when body <> '' then [body] else cast([] as varchar[]) end as s, title <> '' and body <> '' as both_parts, {named('title')} as named from clean),
each as (select * exclude (s), s, unnest(range(1, len(s) + 1)) as i from sent),
cand as (select source_item_id, platform, thread_id, author_id, community_id, n_chars, title, both_parts, named, 0 as place, title as raw from sent
    where title <> '' and not {_begins('lower(title)', T.LOW_SIGNAL_TITLES)} and not (platform = 'forum' and body = '' and root and not {_begins('lower(title)', claims.ROOT_TITLES)})
  union all select source_item_id, platform, thread_id, author_id, community_id, n_chars, title, both_parts, named, i * 2 - 1, s[i] from each
  union all select source_item_id, platform, thread_id, author_id, community_id, n_chars, title, both_parts, named, i * 2, array_to_string(s[greatest(i - 1, 1) : i + 1], ' ') from each),
t0 as (select *, {_split('raw')} as sp from cand),
t1 as (select *, coalesce(list_position(list_transform(sp, lambda x: starts_with(trim(x), '>') or {_begins('lower(trim(x))', _R.prefaces)} or {_instruction('x')}), false), 0) as k from t0),
t2 as (select *, case when k > 0 then sp[k : len(sp)] else cast([] as varchar[]) end as s1 from t1),
t3 as (select *, list_transform(s1, lambda x: not {_question('x')}) as plain from t2),
t4 as (select *, coalesce(list_position(plain, true), 0) as f1, len(s1) + 1 - coalesce(list_position(list_reverse(plain), true), 0) as l1 from t3),
t5 as (select *, case when place = 0 then raw else array_to_string(case when len(s1) < 2 then s1 when f1 > 0 then s1[f1 : l1] else s1[len(s1) : len(s1)] end, ' ') end as t from t4),
t6 as (select *, case when place > 0 and named and not {named('t')} then title || '. ' || t else t end as span from t5 where place = 0 or (length(t) >= 12 and ({named('t')} or {_any('lower(t)', _QUALITY)}))),
once as (select * from (select *, row_number() over (partition by source_item_id, lower(span) order by place) as rn from t6) where rn = 1),
l0 as (select source_item_id, platform, thread_id, author_id, community_id, n_chars, both_parts, cast(place as int) as place, span, lower(span) as l, replace(lower(span), 'for the', ' ') as q from once where not {_question('span')} and not {_instruction('span')} and ({_any('lower(span)', _QUALITY)} or {named('span')})),
l1 as (select *, {names} as names{places}, {_count('l', _R.hardware)} >= 2 as hard,
  {' + '.join('(' + ' or '.join(f"contains({x}, '{t}')" for x in sorted(where)) + ')::int' for t, where in _TERMS.items())} as terms,
  greatest(-2, least(2, {_count('q', _R.positive)} - {_count('q', _R.negative)})) as polarity, {_primary(_R.tasks, _R.default_task)} as task, {_primary(_R.aspects, _R.default_aspect)} as aspect_category,
  {', '.join(f"{_any('l', _R.flags[k])}" + (f" or regexp_matches(l, '{_FIRSTHAND_SQL}')" if k == 'firsthand' else '') + f' as {k}_flag' for k in claims.FLAGS)},
  len(list_filter(regexp_split_to_array(span, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) as words, length(regexp_replace(span, '\\P{{L}}', '', 'g')) as letters, length(regexp_replace(regexp_replace(span, '\\P{{L}}', '', 'g'), '[A-Za-z]', '', 'g')) as other from l0),
l2 as (select *, len(names) as n, case when (regexp_matches(span, '[\\x{{4e00}}-\\x{{9fff}}]') and words < 40) or (coalesce(other * 1e0 / nullif(letters, 0), 0) > 0.55 and words < 30) then 'garbled' when hard and not {_KEEPS} then 'hardware' when not {_JUDGED} then 'other' end as exclusion,
  case when regression_flag then 'bug_regression_report' when {_any('l', claims.INTEGRATION)} then 'integration_failure' when comparative_flag then 'comparative_evaluation' when benchmark_flag then 'benchmark_anecdote' when value_flag then 'pricing_value_comment' when release_flag then 'release_update_reaction' when firsthand_flag then 'firsthand_usage' else 'hearsay' end as evidence_type from l1),
l3 as (select *, words + 5e0 * n + 2e0 * terms + 3e0 * abs(polarity) + 6 * {_any('l', _R.flags['comparative'])}::int + 4 * {_any('l', _R.flags['firsthand'])}::int + 3 * {_any('l', _R.flags['regression'])}::int + 5 * {_any('l', claims.COMPARISONS)}::int
  - 8 * ((words < 20 and starts_with(span, '"') and ends_with(span, '"')) or {_begins('span', claims.QUOTES)})::int - 3 * contains(span, '>')::int - case when n > 1 then 2.5 * (n - 1) else 0 end - 4 * {_begins('l', claims.REPORTED)}::int - 6 * hard::int as span_score,
  least(0.95, 0.25 + 0.25 + least(0.25, 0.03 * terms) + 0.15 * firsthand_flag::int + 0.05 * both_parts::int) as confidence from l2 where n > 0 and exclusion is null),
e1 as (select l3.* exclude (names), unnest(names) as alias, generate_subscripts(names, 1) as pos from l3),
e2 as (select *, 'm-' || alias as model_id, case alias {' '.join(f"when '{a}' then '{p}'" for a, _, p in _ALIASES)} end as provider_id from e1),
e3 as (select * from (select *, row_number() over (partition by source_item_id, model_id, evidence_type{key} order by span_score desc, place, pos) as rn from e2) where rn = 1),
obs as (select *, case aspect_category {' '.join(f"when '{a}' then {k}" for k, a in enumerate(_R.aspects))} end as aspect,
  (case platform {' '.join(f"when '{p}' then {w}e0" for p, w in _R.platform_weights.items())} end) * (case when firsthand_flag then 1.25e0 else 0.75e0 end) * least(1.4e0, 1e0 + ln(1e0 + greatest(0e0, coalesce(n_chars, 0))) / 20e0) as weight
  from (select *, row_number() over (partition by source_item_id order by aspect_category, model_id, place, evidence_type{order}) as nn from e3) where nn <= 24)"""


_OBSERVED = _observed_sql(False)


def observed(spark, d):
    return claims.observations(items(spark, d), catalog(spark), RULES)


def linked(spark, d):
    """Observations whose names, products and profiles are told by what stands around them."""
    known = catalog(spark).withColumn("generic", F.col("alias").isin(*_GENERIC))
    return claims.observations(items(spark, d), known, RULES, context=CONTEXT)


@pair(f"with {_OBSERVED} select source_item_id, model_id, provider_id, task, aspect_category, evidence_type, case when polarity > 0 then 'praise' when polarity < 0 then 'complaint' else 'neutral' end as claim_type, polarity, round(least(1e0, abs(polarity) / 2e0 + 0.15), 6) as severity, round(confidence, 6) as confidence, firsthand_flag, place, round(span_score, 6) as span_score, md5(span) as span, round(weight, 6) as weight from obs")
def extracted_observations(spark, d):
    out = observed(spark, d).select("source_item_id", "model_id", "provider_id", "task", "aspect_category", "evidence_type", "claim_type", "polarity", "severity", "confidence", "firsthand_flag", "place", "span_score", F.md5("span").alias("span"), "weight")
    return r6(out, "severity", "confidence", "span_score", "weight")


@pair(f"with {_observed_sql(True)} select source_item_id, model_id, provider_id, product_id, inference_profile, task, aspect_category, evidence_type, polarity, round(confidence, 6) as confidence, place, round(span_score, 6) as span_score, md5(span) as span from obs")
def linked_observations(spark, d):
    """Homonyms and generic names do not count; product and profile are part of the key of a claim."""
    out = linked(spark, d).select("source_item_id", "model_id", "provider_id", "product_id", "inference_profile", "task", "aspect_category", "evidence_type", "polarity", "confidence", "place", "span_score", F.md5("span").alias("span"))
    return r6(out, "confidence", "span_score")


@pair(f"with {_OBSERVED}, {cells_sql('model_id, aspect')} select model_id, aspect, {_CELL_OUT} from cells")
def extracted_scores(spark, d):
    """Raw items to observations to scores, one plan."""
    return _board(scoring.cell_scores(observed(spark, d)))


@pair(f"with {_ITEMS} select source_item_id, md5(body) as body, {_begins('lower(title)', T.LOW_SIGNAL_TITLES)} as dull from clean")
def cleaned_items(spark, d):
    it = items(spark, d)
    names = "(?i)(?<![a-zA-Z0-9])(?:" + _NAMES + ")(?![a-zA-Z0-9])"
    return it.select("source_item_id", F.md5(T.cleaned(F.col("platform"), F.col("body"), names)).alias("body"), T.low_signal_title(F.col("title")).alias("dull"))


@pair(f"select conv_id, turn, coalesce(regexp_matches(lower(text), '{_FIRSTHAND_SQL}'), false) as firsthand from conversations")
def firsthand_turns(spark, d):
    return src.table(spark, d, "conversations").select("conv_id", "turn", T.is_firsthand(F.col("text")).alias("firsthand"))


_META = "concat_ws(' ', 'source=' || lower(nullif(trim(source), '')), 'lang=' || lower(nullif(trim(lang), '')))"


@pair(f"select doc_id, md5(concat_ws(chr(10), nullif(trim(text), ''), nullif(trim(text), ''), nullif(trim(source), ''), nullif({_META}, ''))) as doubled, md5(concat_ws(chr(10), nullif(trim(text), ''), nullif(trim(source), ''), 'lang=' || nullif(trim(lang), ''))) as plain, cast(doc_id % 2 = 0 as varchar) as flag from documents")
def classifier_texts(spark, d):
    meta = T.metadata_text(source=F.col("source"), lang=F.col("lang"))
    return src.table(spark, d, "documents").select("doc_id", F.md5(T.doubled_text(F.col("text"), F.col("source"), meta)).alias("doubled"), F.md5(T.model_text(F.col("text"), F.col("source"), lang=F.col("lang"))).alias("plain"), T.label_value(F.col("doc_id") % 2 == 0).alias("flag"))


# -------------------------------------------------------------- registry and rows

_REGISTRY = ((0, "p-a", (("m-1", "One"), ("m-4", None))), (1, "p-b", (("M-9", "Nine"),)), (2, "p-c", ()))
_RAW_ROWS = "case when event_id % 6 = 0 then '' when event_id % 6 = 1 then ' Family ' else 'm-' || cast(user_id % 23 as string) end as model, case when event_id % 4 = 0 then null else 'P-' || cast(user_id % 5 as string) end as provider, event_id"
_TOKENS_SQL = "case split_part(m, '-', 1) when 'm' then 'p-m' end"
_RESOLVED = f"""raw as (select {_RAW_ROWS} from events), reg(m, p) as (values ('m-1', 'p-a'), ('m-4', 'p-a'), ('m-9', 'p-b')),
r as (select event_id, nullif(lower(trim(model)), '') as m, provider from raw),
res as (select event_id, case when r.m is null then 'unknown' when p is not null then 'registry' when regexp_matches(r.m, '[0-9]') then 'versioned_unregistered' else 'unversioned' end as status, r.m, coalesce(p, {_TOKENS_SQL.replace('(m,', '(r.m,')}, nullif(lower(trim(provider)), ''), 'unknown') as prov from r left join reg on reg.m = r.m)"""


def _registry(spark):
    return spark.createDataFrame([(p, [(m, n) for m, n in models]) for _, p, models in _REGISTRY], "id string, models array<struct<id:string,display_name:string>>")


def _raw_rows(spark, d):
    return src.table(spark, d, "events").select(
        F.when(F.col("event_id") % 6 == 0, "").when(F.col("event_id") % 6 == 1, " Family ").otherwise(F.concat(F.lit("m-"), F.col("user_id") % 23)).alias("model"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("P-"), F.col("user_id") % 5)).alias("provider"), "event_id",
    )


@pair(f"""with {_RESOLVED}, a as (select 'status' as kind, status as value, count(*) as n from res group by 2), u as (select 'unspecified' as kind, prov as value, count(*) as n from res where status in ('unknown', 'unversioned') group by 2),
x as (select 'unregistered' as kind, m as value, count(*) as n from res where status = 'versioned_unregistered' group by 2 order by n desc, value limit 40) select * from a union all select * from u union all select * from x""")
def coverage_counts(spark, d):
    return registry.coverage(_raw_rows(spark, d), registry.flattened(_registry(spark)), {"m": "p-m"}, 40)


@pair("""with reg(m, p, n) as (values ('m-1', 'p-a', 'One'), ('m-4', 'p-a', 'm-4'), ('m-9', 'p-b', 'Nine')), e as (select 'm-' || cast(user_id % 23 as varchar) as m, count(*) as rows from events group by 1)
select e.m as model_id, p as provider_id, coalesce(n, e.m) as display_name, rows from e left join reg on reg.m = e.m""")
def registry_models(spark, d):
    used = src.table(spark, d, "events").groupBy(F.concat(F.lit("m-"), F.col("user_id") % 23).alias("model_id")).agg(F.count("*").alias("rows"))
    return registry.named(used, registry.flattened(_registry(spark)), "model_id")


_PREFIX_MODEL = "case user_id % 8 when 0 then 'claude-' when 1 then 'gpt-' when 2 then 'o3' when 3 then 'gemini-' when 4 then 'llama-' when 5 then 'mistral-' when 6 then 'deepseek-' else 'other-' end || cast(user_id as string)"


@pair(f"select event_id, case user_id % 8 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'openai' when 3 then 'google' when 4 then 'meta' when 5 then 'mistral' when 6 then 'deepseek' else '' end as provider from events where {_PREFIX_MODEL} <> ''")
def provider_defaults(spark, d):
    return src.table(spark, d, "events").select("event_id", registry.provider_of_prefix(F.expr(_PREFIX_MODEL)).alias("provider"))


@pair(f"select provider_id, string_agg(model_id, ',' order by model_id) as models, count(*) as n from (select distinct provider_id, model_id from ({_OBSERVED.join(('with ', ' select provider_id, model_id from obs'))})) group by 1")
def models_by_provider(spark, d):
    out = registry.by_provider(observed(spark, d).select("provider_id", "model_id").distinct())
    return out.select("provider_id", F.array_join("models", ",").alias("models"), F.size("models").cast("long").alias("n"))


@pair("with seed as (select distinct source as id, 'seeded' as name from documents where doc_id % 2 = 0), own as (select source as id, 'own' as name from documents where doc_id % 3 = 0 group by 1) select * from own union all select * from seed where id is not null and id not in (select id from own where id is not null)")
def seeded_dimension(spark, d):
    docs = src.table(spark, d, "documents")
    own = docs.where("doc_id % 3 = 0").select(F.col("source").alias("id")).distinct().withColumn("name", F.lit("own"))
    seed = docs.where("doc_id % 2 = 0 and source is not null").select(F.col("source").alias("id")).distinct().withColumn("name", F.lit("seeded"))
    return registry.seeded(own, seed, "id")


_LOOSE = [
    "case event_id % 5 when 0 then 'github' when 1 then '' when 2 then 'reddit' when 3 then 'mystery' end as source_platform",
    "case when event_id % 3 = 0 then 'coding' when event_id % 3 = 1 then 'nothing known' end as task_category",
    "case when event_id % 4 = 0 then 'yes' when event_id % 4 = 1 then 'TRUE' else 'no' end as firsthand_flag",
    "case when event_id % 7 = 0 then '' else cast(event_id % 5 - 2 as string) end as polarity_score",
    "cast(event_id as string) as source_item_id", "case when event_id % 6 = 0 then '' else cast(event_id % 97 as string) end as thread_id",
]


@pair(f"""with raw as (select {', '.join(_LOOSE)} from events) select source_item_id, case when source_platform in ('hacker_news', 'github', 'stack_exchange', 'reddit', 'hugging_face') then source_platform else 'hacker_news' end as source_platform, case when task_category = 'coding' then 'coding' else 'general' end as task_category,
lower(firsthand_flag) = 'true' as firsthand_flag, case when lower(firsthand_flag) = 'true' then 1.25e0 else 0.75e0 end as firsthand_weight, coalesce(try_cast(nullif(polarity_score, '') as int), 0) as polarity_score, nullif(thread_id, '') as thread_id from raw""")
def typed_rows(spark, d):
    return registry.typed(src.table(spark, d, "events").selectExpr(*_LOOSE)).select("source_item_id", "source_platform", "task_category", "firsthand_flag", F.col("weights.firsthand_weight").alias("firsthand_weight"), "polarity_score", "thread_id")



# --------------------------------------------------------------- vectors and heads


@pair("""with e as (select vec_id, cast(embedding as double[]) as v from embeddings), r as (select v, min(vec_id) as rep from e group by v)
select 'class' as kind, rep as a, vec_id as b, 1e0 as similarity from e join r on e.v = r.v union all
select 'link', x.rep, y.rep, round(list_cosine_similarity(x.v, y.v), 6) from r x join r y on x.rep < y.rep where list_cosine_similarity(x.v, y.v) >= 0.4""")
def similar_vectors(spark, d):
    """All pairs, as the SQL has them: the index would find each with a chance only."""
    return r6(vectors.similar_pairs(src.table(spark, d, "embeddings"), "vec_id", "embedding", 0.4, recall=1.0), "similarity")  # random vectors: few are nearer


@pair(None)
def greedy_clusters(spark, d):
    """Clusters of all vectors in the order of their ids; a test compares the operator with one pass over the rows."""
    rows = src.table(spark, d, "embeddings")
    return r6(greedy.numbered(greedy.clusters(rows, "vec_id", "embedding", "vec_id"), rows, "vec_id", "vec_id"), "similarity")


@pair("""with e as (select vec_id, cast(label as varchar) as label, vec_id // 10 as g, cast(embedding as double[]) as v from embeddings),
p as (select a.vec_id, b.label, list_cosine_similarity(a.v, b.v) as s, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.v, b.v), 12) desc, b.vec_id) as place from e a join e b on a.g <> b.g and b.label is not null),
c as (select vec_id, label, count(*) as n, sum(s) as s, max(s) as m from p where place <= 5 group by 1, 2),
t as (select vec_id, sum(n) as neighbours, min(struct_pack(n := -n, l := label)) as top, sum(s) as s, max(m) as m, string_agg(label || '=' || cast(n as varchar), ',' order by label) as votes from c group by 1)
select vec_id, cast(neighbours as bigint) as neighbours, votes, (top).l as label, round(-(top).n * 1e0 / neighbours, 6) as share, round(1 + (top).n * 1e0 / neighbours, 6) as disagreement, round(s / neighbours, 6) as mean_similarity, round(m, 6) as max_similarity from t""")
def neighbour_labels(spark, d):
    rows = src.table(spark, d, "embeddings").withColumn("thread", F.floor(F.col("vec_id") / 10))
    out = neighbours.label_features(rows, "vec_id", "embedding", "thread", "label", expected=0.5)
    votes = F.array_join(F.transform(F.map_entries("shares"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * F.col("neighbours")).cast("int").cast("string"))), ",")
    return r6(out.withColumn("votes", votes).drop("shares"), "share", "disagreement", "mean_similarity", "max_similarity")


def _labelled(spark, d):
    labels = src.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return src.table(spark, d, "documents").join(labels, "doc_id", "left")


@pair(None)
def text_head(spark, d):
    """A tf-idf head fitted on three quarters of the labelled documents, applied to all documents in one pass."""
    rows = _labelled(spark, d)
    model = heads.tfidf_head(rows.where("doc_id % 4 <> 0"), "text", "quality", characters=False)
    return r6(heads.predicted(model, rows.select("doc_id", "text", "quality"), "text").select("doc_id", "quality", "predicted", "confidence"), "confidence")


@pair(None)
def hierarchical_head(spark, d):
    rows = src.table(spark, d, "embeddings")
    out = heads.hierarchical(rows.where("vec_id % 4 <> 0"), rows, "embedding", "label", {str(k): -1 - k % 3 for k in range(10)}, "vec_id")
    return r6(out.select("vec_id", "label", "predicted_group", "predicted", "confidence"), "confidence")


@pair(None)
def agreeing_heads(spark, d):
    """Language of all documents where naive Bayes and the tf-idf head agree, each fitted on three quarters of the rows."""
    docs = src.table(spark, d, "documents").select("doc_id", "text", "lang")
    train = docs.where("doc_id % 4 <> 0 and lang is not null")
    tok = learning.bags(train, "doc_id", "text", "lang")
    bayes = learning.score(learning.bags(docs, "doc_id", "text", "lang"), *learning.fit(train, tok, "lang"), "doc_id", "lang").join(docs.select("doc_id", "lang"), "doc_id")
    tfidf = heads.predicted(heads.tfidf_head(train, "text", "lang", characters=False), docs, "text")
    out = heads.agreement([heads.long_form(bayes, "doc_id", "bayes", "lang", "lang"), heads.long_form(tfidf, "doc_id", "tfidf", "lang", "lang")])
    return r6(out.select("row_id", "label", "votes", "mean", "actual"), "mean")
