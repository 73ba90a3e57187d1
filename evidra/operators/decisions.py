"""From scores to decisions: portfolios, profiles, value and the effect of releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted(scores: DataFrame, weights: DataFrame, on: str, by: list[str]) -> DataFrame:
    """(*by, utility, parts): the mean of ``score`` by the weights (*, ``on``, weight), renormalised over what is present.

    ``weights`` is a small table of parameters; scores are one row for each cell.
    """
    joined = scores.where("score is not null").join(weights, on)
    return joined.groupBy(*by).agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("utility"), F.count("*").alias("parts"))


def best(utilities: DataFrame, profile: str, entity: str, n: int) -> DataFrame:
    """The ``n`` best entities of each profile, ties by entity; a row for each entity and profile is compared."""
    w = Window.partitionBy(profile).orderBy(F.desc(F.round("utility", 9)), entity)
    return utilities.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def value(perceived: DataFrame, prices: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """(key, score, price_norm, value): ``share`` of the perceived score, the rest of the price on a scale where the lowest is 100."""
    span = prices.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    norm = F.coalesce(100 * (F.col("hi") - F.col("price")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(100.0))
    priced = prices.join(F.broadcast(span)).select(key, norm.alias("price_norm"))
    return perceived.join(priced, key).select(key, "score", "price_norm", (share * F.col("score") + (1 - share) * F.col("price_norm")).alias("value"))


def release_impact(obs: DataFrame, releases: DataFrame, days: int, score: Column) -> DataFrame:
    """Per model and aspect: weighted means of the ``days`` days before and after the model's release, and their difference.

    An equi-join on the model; the windows are conditions inside one aggregation.
    """
    near = obs.withColumn("_v", score).join(releases, "model_id")
    gap = F.datediff("published_at", "released")
    mean = lambda c: F.sum(F.when(c, F.col("weight") * F.col("_v"))) / F.sum(F.when(c, F.col("weight")))
    before, after = gap.between(-days, -1), gap.between(0, days - 1)
    out = near.where(gap.between(-days, days - 1)).groupBy("model_id", "aspect").agg(
        F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"), mean(before).alias("before"), mean(after).alias("after")
    )
    return out.withColumn("change", F.col("after") - F.col("before"))
