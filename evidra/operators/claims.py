"""From raw items to observations: the rule extractor as one plan.

Items (source_item_id, platform, title, body, ...) are cleaned, cut into
candidate spans, labelled by lexicons, linked to the entities they name, and
reduced to the best span of each claim.  The plan has one exchange, on the
item: unique spans, best spans and the cap for each item share it.

Lexicons and aliases are arguments (`Rules`, a catalog table); the beginnings
and weights below are the fixed values of the rules.  A `Context` says which
names do not count where something else is meant, and which products and
profiles a span speaks of; they are part of the key of a claim.  Nulls: a null
title or body is empty; an item without a mention gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract, linking

#: Beginnings of sentences that only lead to a claim, and of instructions.
PREFACES = (
    "as part of ", "a small number of organizations are currently using", "models of this capability level require", "we’re making swift progress",
    "we're making swift progress", "we plan to release", "not only that, but we plan to release",
)
INSTRUCTIONS = ("install manually:", "run npx ", "give this prompt to your agent:", "ktx setup")
#: Terms of the trade that make a span worth reading, comparisons, and beginnings of reported speech and of quotes.
SIGNALS = ("api", "sdk", "latency", "rate limit", "docs")
COMPARISONS = ("better than", "worse than", "compared to", "vs", "versus")
REPORTED = ("as part of ", "according to ", "anthropic says ", "openai says ", "google says ")
QUOTES = ('"users will', '"what model are you', '"we compared')
ROOT_TITLES = ("ask hn:", "show hn:", "tell hn:")
INTEGRATION = ("api", "sdk", "integration", "bug")
#: Weight of a platform, by name; others have 1.
PLATFORM_WEIGHTS = {"github": 1.25, "hacker_news": 1.15, "stack_exchange": 1.20, "reddit": 1.0, "hugging_face": 1.15}
FLAGS = ("firsthand", "comparative", "regression", "hallucination", "refusal", "value", "release", "benchmark", "noise")
#: What stands near the name of a product that is used, and what follows one that speaks.
CUES = ("in ", "on ", "using ", "with ", "via ", "inside ", "running in ", "switched to ", "switch to ", "worked in ", "for ", "through ", "from ", "at ", "my ", "our ")
NOT_AFTER = (" says", " said", " think")
MOST_PLACES = 500
_JUDGES = ("firsthand", "comparative", "regression", "hallucination", "refusal", "value")


@dataclass(frozen=True)
class Rules:
    """Lexicons of one domain. ``flags`` holds the terms of `FLAGS`; priorities break ties and their order numbers the aspects."""

    tasks: Mapping[str, Sequence[str]]
    aspects: Mapping[str, Sequence[str]]
    positive: Sequence[str]
    negative: Sequence[str]
    flags: Mapping[str, Sequence[str]]
    hardware: Sequence[str] = ()
    ignored: Sequence[str] = ()
    default_task: str = "general"
    default_aspect: str = "satisfaction"
    prefaces: Sequence[str] = PREFACES
    instructions: Sequence[str] = INSTRUCTIONS
    platform_weights: Mapping[str, float] = field(default_factory=lambda: PLATFORM_WEIGHTS)
    issues: str = "github"
    forum: str = "hacker_news"

    def any_of(self, low: Column, *flags: str) -> Column:
        return contains_any(low, [t for f in flags for t in self.flags.get(f, ())])


@dataclass(frozen=True)
class Homonym:
    """Aliases that mean something else where one of ``signals`` stands within ``width`` characters of them, or anywhere in the text (None)."""

    aliases: Sequence[str]
    signals: Sequence[str]
    width: int | None = None


@dataclass(frozen=True)
class Context:
    """What stands around names.

    ``products`` and ``profiles`` are (alias, id) in order of priority, at most
    `MOST_PLACES` each.  A product counts where one of ``cues`` stands within
    ``width`` characters of its alias, no slash does, and none of ``not_after``
    follows within that width.  A profile counts wherever its alias stands.
    """

    homonyms: Sequence[Homonym] = ()
    products: Sequence[tuple[str, str]] = ()
    profiles: Sequence[tuple[str, str]] = ()
    cues: Sequence[str] = CUES
    not_after: Sequence[str] = NOT_AFTER
    width: int = 24

    def __post_init__(self):
        if max(len(self.products), len(self.profiles)) > MOST_PLACES:
            raise ValueError(f"more than {MOST_PLACES} products or profiles")


def contains_any(low: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in dict.fromkeys(terms):
        out = out | F.contains(low, F.lit(t))
    return out


def signal(low: Column, rules: Rules) -> Column:
    """A term of quality, of use or of the trade."""
    return contains_any(low, [*rules.positive, *rules.negative]) | rules.any_of(low, *[f for f in FLAGS if f != "noise"]) | contains_any(low, SIGNALS)


def instructional(c: Column, rules: Rules) -> Column:
    return T.starts_with(F.lower(F.trim(c)), rules.instructions)


def question_only(c: Column, rules: Rules) -> Column:
    """Ends with a question mark and judges nothing."""
    low = F.lower(F.trim(c))
    return low.endswith("?") & ~contains_any(low, [*rules.positive, *rules.negative]) & ~rules.any_of(low, "firsthand", "comparative")


def preface(c: Column, rules: Rules) -> Column:
    """A quoted sentence, the preface of a release, or an instruction."""
    return F.trim(c).startswith(">") | T.starts_with(F.lower(F.trim(c)), rules.prefaces) | instructional(c, rules)


def quote_only(c: Column) -> Column:
    return ((words(c) < 20) & c.startswith('"') & c.endswith('"')) | T.starts_with(c, QUOTES)


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once: filters above do not repeat their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


@dataclass(frozen=True)
class Names:
    """The aliases of a catalog, longest first, with those that are homonyms and the (generic, specific) ones of each provider that has both."""

    aliases: Sequence[str]
    homonyms: Sequence[Homonym] = ()
    generic: Sequence[tuple[Sequence[str], Sequence[str]]] = ()

    @classmethod
    def of(cls, catalog: DataFrame, context: Context | None = None) -> Names:
        aliases, generic = linking.check_catalog(catalog), []
        if "generic" in catalog.columns:
            side = lambda c: F.sort_array(F.collect_set(F.when(c, F.lower("alias"))))
            both = catalog.groupBy("provider_id").agg(side(F.col("generic")).alias("general"), side(~F.coalesce("generic", F.lit(False))).alias("special")).orderBy("provider_id")
            generic = [(r.general, r.special) for r in both.collect() if r.general and r.special]  # as small as the aliases
        return cls(aliases, context.homonyms if context else (), generic)

    @property
    def pattern(self) -> str:
        return linking.pattern(list(self.aliases))

    def _marked(self) -> str:
        """The pattern whose first group is empty where a homonym takes the place."""
        edge, out = "[a-zA-Z0-9]", []
        for h in self.homonyms:
            for a in (x.lower() for x in h.aliases if h.width is not None):
                longer = "|".join(re.escape(x) for x in self.aliases if x != a and x.startswith(a))
                room = [(re.escape(s), len(a) + h.width - len(s)) for s in h.signals]
                near = "|".join([f"(?<=(?={s}).{{0,{h.width}}})" for s, k in room if k >= 0] + [f"(?=.{{0,{k}}}{s})" for s, k in room if k >= 0])
                if near:
                    out.append((f"(?!(?:{longer})(?!{edge}))" if longer else "") + f"(?:{near}){re.escape(a)}(?!{edge})")
        every = "|".join(map(re.escape, self.aliases))
        return f"(?is)(?<!{edge})(?:{'|'.join(out)}|({every})(?!{edge}))" if out else f"(?i)(?<!{edge})({every})(?!{edge})"

    def found(self, c: Column) -> Column:
        """The names in a text in order, as they are written, without homonyms."""
        if not self.homonyms:
            return F.regexp_extract_all(c, F.lit(self.pattern), F.lit(0))
        out, low = F.filter(F.regexp_extract_all(c, F.lit(self._marked()), F.lit(1)), lambda x: x != ""), F.lower(c)
        for h in self.homonyms:
            if h.width is None:
                out = F.when(contains_any(low, h.signals), _but(out, [a.lower() for a in h.aliases])).otherwise(out)
        return out

    def specific(self, names: Column) -> Column:
        """Names without the generic ones of a provider of which a specific one is there."""
        out = names
        for general, special in self.generic:
            has = F.exists(names, _among(special))
            out = F.when(has, _but(out, general)).otherwise(out)
        return out

    def named(self, c: Column) -> Column:
        """Whether a text names something."""
        return c.rlike(self.pattern) & (F.size(self.found(c)) > 0) if self.homonyms else c.rlike(self.pattern)


def _among(aliases: Sequence[str]):
    return lambda x: F.lower(x).isin(*aliases)


def _but(names: Column, aliases: Sequence[str]) -> Column:
    return F.filter(names, lambda x: ~F.lower(x).isin(*aliases))


def place_pattern(alias: str, context: Context) -> str:
    """A pattern of an alias in use as a product: what must and must not stand around it."""
    w, edge = context.width, "[a-zA-Z0-9]"
    near = lambda terms, form: "|".join(form(re.escape(t), w - len(t)) for t in terms if len(t) <= w)
    before, after = near(context.cues, lambda t, k: f"{t}.{{0,{k}}}"), near(context.cues, lambda t, k: f".{{0,{k}}}{t}")
    spoken = near(context.not_after, lambda t, k: f".{{0,{k}}}{t}")
    whole = f"(?<!{edge}){re.escape(alias)}(?!{edge})(?!.{{0,{w - 1}}}/)" + (f"(?!{spoken})" if spoken else "")
    if not before:
        return "(?!)"
    return f"(?is)(?<!/.{{0,{w - 1}}})(?:(?<={before}){whole}|{whole}(?={after}))"


def product(c: Column, context: Context | None) -> Column:
    """The product of the first alias in use in a text, or null."""
    return _first(c, [(a, p, place_pattern(a, context)) for a, p in context.products] if context else [])


def profile(c: Column, context: Context | None) -> Column:
    """The profile of the first alias in a text, or null."""
    return _first(c, [(a, p, linking.pattern([a])) for a, p in context.profiles] if context else [])


def _first(c: Column, known: Sequence[tuple[str, str, str]]) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(a.lower())) & c.rlike(p), F.lit(i)) for a, i, p in known], F.lit(None).cast("string"))


def spans(items: DataFrame, rules: Rules, names: Names) -> DataFrame:
    """Items (without body) with place and span: the title, each sentence and each window of three, with a signal, once each.

    A span that names nothing gets a title that does.
    """
    keep = [c for c in items.columns if c not in ("title", "body")]
    title, root = T.normalize(F.col("title")), F.coalesce("is_root_story", F.lit(False)) if "is_root_story" in items.columns else F.lit(False)
    out = items.withColumns({"title": title, "body": T.cleaned(F.col("platform"), F.col("body"), names.pattern, rules.issues, rules.forum)}).repartition("source_item_id")
    out = out.withColumn("_s", F.when(F.size(T.sentences(F.col("body"))) > 0, T.sentences(F.col("body"))).when(F.col("body") != "", F.array("body")).otherwise(F.array().cast("array<string>")))
    skip = (F.col("platform") == rules.forum) & (F.col("body") == "") & root & ~T.starts_with(F.lower("title"), ROOT_TITLES)
    none = F.array().cast("array<struct<place:int,_t:string>>")
    first = F.when((F.col("title") != "") & ~T.low_signal_title(F.col("title")) & ~skip, F.array(F.struct(F.lit(0).alias("place"), F.col("title").alias("_t")))).otherwise(none)
    pair = lambda x, i: F.array(F.struct((i * 2 + 1).alias("place"), x.alias("raw")), F.struct((i * 2 + 2).alias("place"), T.window_of(F.col("_s"), i + 1).alias("raw")))
    out = out.withColumns({"_named": names.named(F.col("title")), "_first": first, "_titled": F.col("title") != "", "_bodied": F.col("body") != ""})
    out = out.select(*keep, "title", "_titled", "_bodied", "_named", "_first", F.inline_outer(F.flatten(F.transform("_s", pair))))
    # `T.trimmed_span` step by step: each step is read several times by the next.
    out = settled(out, _p=T.sentences(F.col("raw")))
    out = settled(out, _k=T.first_true(F.transform("_p", lambda x: ~preface(x, rules))))
    out = settled(out, _q=T.after_preface(F.col("_p"), F.col("_k")))
    out = settled(out, _plain=F.transform("_q", lambda x: ~question_only(x, rules)))
    trimmed = F.array_join(T.between_questions(F.col("_q"), F.col("_plain")), " ")
    # The title goes with the first sentence, or alone where there is none.
    each = F.when(F.col("raw").isNotNull(), F.array(F.struct("place", trimmed.alias("_t")))).otherwise(none)
    out = out.select(*keep, "title", "_titled", "_bodied", "_named", F.inline(F.concat(F.when(F.coalesce("place", F.lit(1)) == 1, F.col("_first")).otherwise(none), each)))
    out = settled(out, _has=names.named(F.col("_t")), _low=F.lower("_t"))
    out = out.where((F.col("place") == 0) | ((F.length("_t") >= 12) & (F.col("_has") | signal(F.col("_low"), rules))))
    out = out.withColumn("span", F.when((F.col("place") > 0) & F.col("_named") & ~F.col("_has"), F.concat("title", F.lit(". "), "_t")).otherwise(F.col("_t")))
    once = out.withColumn("_rn", F.row_number().over(Window.partitionBy("source_item_id", F.lower("span")).orderBy("place"))).where("_rn = 1")
    shaped = ~question_only(F.col("span"), rules) & ~instructional(F.col("span"), rules) & (signal(F.lower("span"), rules) | names.named(F.col("span")))
    return once.where(shaped).select(*keep, (F.col("_titled") & F.col("_bodied")).alias("both_parts"), "place", "span")


def features(rows: DataFrame, rules: Rules, names: Names, context: Context | None = None) -> DataFrame:
    """Spans with their mentions, product, profile, labels, flags, severity, confidence, exclusion and score; one projection."""
    low = F.lower("span")
    hits = lambda c, terms: extract.hits(c, terms) if terms else F.array().cast("array<string>")
    sober = low
    for phrase in rules.ignored:
        sober = F.replace(sober, F.lit(phrase), F.lit(" "))
    lists = {"_pos": hits(sober, rules.positive), "_neg": hits(sober, rules.negative)}
    lists |= {f"_task_{k}": hits(low, t) for k, t in rules.tasks.items()} | {f"_aspect_{k}": hits(low, t) for k, t in rules.aspects.items()} | {f"_flag_{k}": hits(low, rules.flags.get(k, ())) for k in FLAGS}
    out = settled(rows, **lists, _names=names.found(F.col("span")), product_id=product(F.col("span"), context), inference_profile=profile(F.col("span"), context), _hard=F.size(hits(low, rules.hardware)) >= 2)
    if names.generic:
        out = settled(out.withColumnRenamed("_names", "_all"), _names=names.specific(F.col("_all"))).drop("_all")
    flags = {f"{k}_flag": F.size(f"_flag_{k}") > 0 for k in FLAGS}
    flags["firsthand_flag"] = flags["firsthand_flag"] | T.is_firsthand(F.col("span"))
    size = lambda kind, of: {k: F.size(f"_{kind}_{k}") for k in of}
    out = settled(out, **flags | {
        "_terms": F.size(F.array_distinct(F.concat(*lists))), "polarity": extract.polarity(F.size("_pos"), F.size("_neg")),
        "task": extract.primary(size("task", rules.tasks), list(rules.tasks), rules.default_task),
        "aspect_category": extract.primary(size("aspect", rules.aspects), list(rules.aspects), rules.default_aspect),
    })
    judged = F.abs("polarity") > 0
    for k in _JUDGES:
        judged = judged | F.col(f"{k}_flag")
    keeps = F.col("firsthand_flag") | F.col("regression_flag") | F.col("hallucination_flag") | F.col("refusal_flag")
    reason = extract.exclusion([
        ("non_english_or_garbled", T.garbled(F.col("span"))), ("hardware_infra_requirements", F.col("_hard") & ~keeps), ("tooling_or_bot_transcript", F.col("noise_flag") & ~judged),
        ("factual_release_or_adoption", F.col("release_flag") & ~judged), ("benchmark_without_user_judgment", F.col("benchmark_flag") & ~judged), ("not_about_model_quality", ~judged),
    ])
    n, lower = F.size("_names"), F.lower("span")
    evidence = extract.all_rules([
        ("bug_regression_report", F.col("regression_flag")), ("integration_failure", contains_any(lower, INTEGRATION)), ("comparative_evaluation", F.col("comparative_flag")),
        ("benchmark_anecdote", F.col("benchmark_flag")), ("pricing_value_comment", F.col("value_flag")), ("release_update_reaction", F.col("release_flag")), ("firsthand_usage", F.col("firsthand_flag")),
    ], "hearsay")
    if_ = lambda c, v: F.when(c, F.lit(float(v))).otherwise(0.0)
    score = (
        words(F.col("span")) + 5.0 * n + 2.0 * F.col("_terms") + 3.0 * F.abs("polarity") + if_(F.size("_flag_comparative") > 0, 6) + if_(F.size("_flag_firsthand") > 0, 4) + if_(F.size("_flag_regression") > 0, 3)
        + if_(contains_any(lower, COMPARISONS), 5) - if_(quote_only(F.col("span")), 8) - if_(F.contains("span", F.lit(">")), 3) - F.when(n > 1, 2.5 * (n - 1)).otherwise(0.0)
        - if_(T.starts_with(lower, REPORTED), 4) - if_(F.col("_hard"), 6)
    )
    out = settled(out, **{
        "exclusion": reason, "evidence_type": evidence[0], "claim_type": extract.claim_type(F.col("polarity")),
        "severity": extract.severity(F.col("polarity"), F.lit(1)), "confidence": extract.confidence(n > 0, F.col("_terms"), F.col("firsthand_flag"), F.col("both_parts")), "span_score": score,
    })
    return out.withColumn("relevant", (n > 0) & F.col("exclusion").isNull()).drop(*lists, "_hard", "_terms")


def weight(platform: Column, firsthand: Column, engagement: Column, weights: Mapping[str, float]) -> Column:
    """Weight of an observation: platform x firsthand x engagement; null engagement counts as none."""
    quality = F.lit(1.0)
    for name, w in weights.items():
        quality = F.when(platform == name, float(w)).otherwise(quality)
    total = F.aggregate(F.coalesce(F.map_values(engagement), F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return quality * F.when(firsthand, 1.25).otherwise(0.75) * F.least(F.lit(1.4), 1.0 + F.log1p(F.greatest(F.lit(0.0), total)) / 20)


def observations(items: DataFrame, catalog: DataFrame, rules: Rules, most: int = 24, context: Context | None = None) -> DataFrame:
    """One row for each (item, model, product, profile, evidence type): the best relevant span, earlier ones first; at most ``most`` for an item.

    ``aspect`` numbers the categories in the order of ``rules.aspects``, so that `scoring` can weigh them.  Where the
    catalog marks aliases as ``generic``, they do not count beside a specific one of their provider.
    """
    names = Names.of(catalog, context)
    rows = features(spans(items, rules, names), rules, names, context).where("relevant")
    rows = rows.select("*", F.posexplode("_names").alias("_at", "alias")).drop("_names").withColumn("alias", F.lower("alias"))
    known = catalog.select(F.lower("alias").alias("alias"), "model_id", "provider_id")
    rows = rows.join(F.broadcast(known), "alias")  # bounded by `check_catalog`
    best = Window.partitionBy("source_item_id", "model_id", "product_id", "inference_profile", "evidence_type").orderBy(F.desc("span_score"), "place", "_at")
    rows = rows.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    cap = Window.partitionBy("source_item_id").orderBy("aspect_category", "model_id", "place", "evidence_type", "product_id", "inference_profile")
    rows = rows.withColumn("_n", F.row_number().over(cap)).where(F.col("_n") <= most)
    number = F.lit(None).cast("int")
    for k, name in enumerate(rules.aspects):
        number = F.when(F.col("aspect_category") == name, k).otherwise(number)
    engagement = F.col("engagement") if "engagement" in items.columns else F.lit(None).cast("map<string,double>")
    return rows.withColumns({"aspect": number, "weight": weight(F.col("platform"), F.col("firsthand_flag"), engagement, rules.platform_weights)}).drop("_rn", "_n", "_at", "engagement")
