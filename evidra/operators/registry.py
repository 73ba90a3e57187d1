"""Registry, dimension and row-typing steps around a snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import linking

#: Domains of a typed observation, each with its default first.
PLATFORMS = ("hacker_news", "github", "stack_exchange", "reddit", "hugging_face")
TASKS = ("general", "coding", "writing", "research", "agents", "roleplay", "data_analysis", "long_context", "multimodal", "api_developer_workflow")
ASPECTS = ("satisfaction", "trust_reliability", "task_fit", "regression_stability", "hallucination_safety", "refusal_acceptance", "value", "developer_ergonomics")
EVIDENCE = ("hearsay", "firsthand_usage", "comparative_evaluation", "bug_regression_report", "integration_failure", "benchmark_anecdote", "release_update_reaction", "pricing_value_comment")
CLAIMS = ("neutral", "praise", "complaint", "mixed")
#: Beginnings of model names and their providers.
PREFIXES = (("claude-", "anthropic"), ("gpt-", "openai"), ("o3", "openai"), ("o4-", "openai"), ("gemini-", "google"), ("llama-", "meta"), ("mistral-", "mistral"), ("deepseek-", "deepseek"))
FACTORS = ("source_quality_weight", "firsthand_weight", "author_credibility_weight", "corroboration_weight", "recency_weight", "engagement_weight", "duplicate_penalty")
FLAG_COLUMNS = ("firsthand_flag", "comparative_flag", "regression_flag", "hallucination_flag", "refusal_flag", "value_flag", "human_labeled_flag")


def flattened(providers: DataFrame) -> DataFrame:
    """(model_id, provider_id, display_name) from rows (id, models: array of (id, display_name)); ids in lower case, a missing name is the id."""
    rows = providers.select(F.col("id").alias("provider_id"), F.inline("models")).withColumnRenamed("id", "_id")
    return rows.select(F.lower("_id").alias("model_id"), "provider_id", F.coalesce("display_name", "_id").alias("display_name"))


def named(rows: DataFrame, registry: DataFrame, model: str) -> DataFrame:
    """``rows`` with provider_id and display_name; a model that is not registered is its own name."""
    known = registry.select(F.col("model_id").alias("_m"), "provider_id", "display_name")
    out = rows.join(known, F.lower(F.trim(model)) == F.col("_m"), "left")
    return out.withColumn("display_name", F.coalesce("display_name", F.col(model))).drop("_m")


def coverage(rows: DataFrame, registry: DataFrame, tokens: Mapping[str, str], most: int = 40) -> DataFrame:
    """(kind, value, n): rows by status, unspecified rows by provider, and the ``most`` frequent unregistered models.

    One grouping of the rows; the three listings read its few groups.
    """
    groups = linking.resolve(rows, registry, dict(tokens)).groupBy("status", "resolved_model", "resolved_provider").agg(F.count("*").alias("n"))
    open_ = F.col("status").isin("unknown", "unversioned")
    kinds = F.array_compact(F.array(
        F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")), F.when(open_, F.struct(F.lit("unspecified").alias("kind"), F.col("resolved_provider").alias("value"))),
        F.when(F.col("status") == "versioned_unregistered", F.struct(F.lit("unregistered").alias("kind"), F.col("resolved_model").alias("value"))),
    ))
    counts = groups.select(F.inline(kinds), "n").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    top = counts.where("kind = 'unregistered'").orderBy(F.desc("n"), "value").limit(most)
    return counts.where("kind <> 'unregistered'").unionByName(top)


def provider_of_prefix(model: Column) -> Column:
    out = F.lit("")
    for prefix, provider in reversed(PREFIXES):
        out = F.when(model.startswith(prefix), provider).otherwise(out)
    return out


def by_provider(models: DataFrame) -> DataFrame:
    """(provider_id, models): the distinct models of each provider, sorted."""
    return models.groupBy("provider_id").agg(F.array_sort(F.collect_set("model_id")).alias("models"))


def seeded(dimension: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """The dimension with the rows of ``seed`` whose key it lacks."""
    return dimension.unionByName(seed.join(dimension.select(key), key, "left_anti"))


def typed(rows: DataFrame) -> DataFrame:
    """Observations of fixed types from loose text rows; missing columns are missing values.

    Values outside a domain fall to its default; the firsthand weight follows its flag; other weights default to 1.
    """
    text = lambda c: T.nz(F.col(c).cast("string")) if c in rows.columns else F.lit(None).cast("string")
    domain = lambda c, of: T.in_domain(text(c), of, of[0])
    number = lambda c, kind: F.coalesce(text(c).try_cast("double").try_cast(kind), F.lit(0).cast(kind))
    flags = {c: T.exactly_true(text(c)) for c in FLAG_COLUMNS}
    given: Sequence[str] = rows.schema["weights"].dataType.names if "weights" in rows.columns else ()
    factor = lambda c: F.when(flags["firsthand_flag"], 1.25).otherwise(0.75) if c == "firsthand_weight" else F.coalesce(F.col(f"weights.{c}").cast("double"), F.lit(1.0)) if c in given else F.lit(1.0)
    blank = lambda c: F.coalesce(text(c), F.lit(""))
    return rows.select(
        blank("source_item_id").alias("source_item_id"), domain("source_platform", PLATFORMS).alias("source_platform"), *[blank(c).alias(c) for c in ("community_id", "url", "model_id", "provider_id", "model_version_or_alias", "evidence_text")],
        *[text(c).alias(c) for c in ("thread_id", "author_id_hash", "product_id", "inference_profile")], text("published_at").try_cast("timestamp").alias("published_at"),
        domain("task_category", TASKS).alias("task_category"), domain("aspect_category", ASPECTS).alias("aspect_category"), domain("evidence_type", EVIDENCE).alias("evidence_type"), domain("claim_type", CLAIMS).alias("claim_type"),
        number("polarity_score", "int").alias("polarity_score"), number("severity_score", "double").alias("severity_score"), number("extractor_confidence", "double").alias("extractor_confidence"),
        *[v.alias(c) for c, v in flags.items()], F.struct(*[factor(c).alias(c) for c in FACTORS]).alias("weights"),
    )
