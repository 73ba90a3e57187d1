"""Scores of entities from weighted observations.

All functions take observations (see `sources.adapters`) and the columns that
make up a cell.  No step holds the rows of a cell together: rows that share a
cell, all capped keys and a value become one row of sums, partly before the
shuffle; a cap needs the sums of (cell, key) and of the cell; and a cap can hold
for fewer than 1 / cap keys of a cell, so the factors of a stage are a small
table.  Those sums are checkpointed once and read by every stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import cut

#: Factors of a stage up to this number are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Share of a cell's weight that one key may hold, in the order of application.
CAPS = (("thread_id", 0.12), ("author_id", 0.15), ("community_id", 0.35), ("platform", 0.60))
#: Warnings are raised above these shares of the capped weight, in this order.
WARN = (("platform", 0.60), ("community_id", 0.35), ("thread_id", 0.12), ("author_id", 0.15))
#: Weight of an aspect in the overall score, by position; the eighth has none.
OVERALL = (0.20, 0.18, 0.22, 0.12, 0.12, 0.10, 0.06)
#: Aspects whose flag forces the score to 0.
FLAGS = {"hallucination_flag": 4, "refusal_flag": 6, "regression_flag": 5}
CELL = ("model_id", "aspect")


def score_value() -> Column:
    """(polarity + 2) / 4 * 100, 0 where the flag of that very aspect is set."""
    zero = F.lit(False)
    for flag, aspect in FLAGS.items():
        zero = zero | (F.col(flag) & (F.col("aspect") == aspect))
    return F.when(zero, 0.0).otherwise((F.col("polarity") + 2) * 25.0)


def _with(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``other``, joined on columns that may be null."""
    right = other.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in other.columns])
    return df.join(right, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on], how).drop(*[f"_r_{c}" for c in on])


def _lowered(df: DataFrame, factors: DataFrame, on: Sequence[str], small: bool) -> DataFrame:
    out = _with(df, F.broadcast(factors) if small else factors, on, "left")
    return out.withColumn("factor", F.col("factor") * F.coalesce("_f", F.lit(1.0))).drop("_f")


def cap_factors(sums: DataFrame, cell: Sequence[str], caps=CAPS) -> tuple[DataFrame, list[tuple[DataFrame, list[str], bool]]]:
    """(``sums`` with ``factor``; the factors of each stage that lowers something): caps one after the other over sums (*cell, *keys, weight, ...).

    A null key is not capped but counts in the total; a stage with at most one
    key in the cell is skipped; nothing is normalised afterwards.
    """
    spark, stages = sums.sparkSession, []
    out = sums.withColumn("factor", F.lit(1.0))
    for key, cap in caps:
        group = out.groupBy(*cell, key).agg(F.sum(F.col("weight") * F.col("factor")).alias("_g"))
        total = group.groupBy(*cell).agg(F.sum("_g").alias("_t"), (F.min(key) < F.max(key)).alias("_several"))
        over = _with(group, total, cell).where(F.col(key).isNotNull() & F.col("_several") & (F.col("_g") > cap * F.col("_t"))).select(*cell, key, (cap * F.col("_t") / F.col("_g")).alias("_f"))
        rows = over.limit(BROADCAST_ROWS + 1).collect()
        small = len(rows) <= BROADCAST_ROWS
        if not rows:
            continue
        over = spark.createDataFrame(rows, over.schema) if small else cut(over)
        stages.append((over, [*cell, key], small))
        out = _lowered(out, *stages[-1])
    return out, stages


def _sums(obs: DataFrame, cell: Sequence[str], caps=CAPS, value: Column | None = None, **more: Column) -> DataFrame:
    """(*cell, *keys, v, weight, squares, n, *more): what caps and moments need of the rows, checkpointed."""
    keys = [k for k, _ in caps if k not in cell]
    rows = obs.withColumn("v", F.lit(None).cast("double") if value is None else value)
    return cut(rows.groupBy(*cell, *keys, "v").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("weight")).alias("squares"), F.count("*").alias("n"), *[c.alias(n) for n, c in more.items()]))


def capped(obs: DataFrame, cell: Sequence[str] = CELL, caps=CAPS) -> DataFrame:
    """Adds ``capped``: the weight after the caps, applied one after the other (see `cap_factors`)."""
    out = obs.withColumn("factor", F.lit(1.0))
    for stage in cap_factors(_sums(obs, cell, caps), cell, caps)[1]:
        out = _lowered(out, *stage)
    return out.withColumn("capped", F.col("weight") * F.col("factor")).drop("factor")


def ess(w: Column, squares: Column) -> Column:
    """Effective sample size (sum w)^2 / sum w^2, from the two sums."""
    return F.coalesce(F.try_divide(w * w, squares), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k successes of n, (0, 0) for n = 0."""
    n = F.nullif(n, F.lit(0))
    p = k / n
    mid, half, size = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    clip = lambda c: F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return clip((mid - half) / size), clip((mid + half) / size)


def tier(n: Column, provisional: float = 30, ranked: float = 150) -> Column:
    return F.when(n >= ranked, "ranked").when(n >= provisional, "provisional").otherwise("insufficient")


def cell_scores(obs: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Score, weights, effective size, interval, warnings and blockers of each cell."""
    sums, _ = cap_factors(_sums(obs, cell, CAPS, score_value(), firsthand=F.sum(F.col("firsthand_flag").cast("long")), flagged=F.count("firsthand_flag")), cell)
    w = F.col("weight") * F.col("factor")
    levels = sums.groupBy(*cell, "v").agg(
        F.sum(w).alias("w"), F.sum(F.col("squares") * F.col("factor") * F.col("factor")).alias("s"), F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.sum("firsthand").alias("firsthand"), F.sum("flagged").alias("flagged")
    )
    # A value has few levels: their deviations are exact where a difference of large moments would not be.
    level = F.struct("v", "w", (F.col("w") * F.col("v")).alias("wv"))
    out = levels.groupBy(*cell).agg(
        F.sum("weight").alias("weighted_n"), F.sum("w").alias("capped_n"), F.sum("s").alias("_s"), F.sum(F.col("w") * F.col("v")).alias("_wv"), F.collect_list(level).alias("_levels"), F.sum("n").alias("observations"), F.try_divide(F.sum("firsthand"), F.sum("flagged")).alias("firsthand_ratio")
    )
    out = out.withColumn("score", F.coalesce(F.try_divide("_wv", "capped_n"), F.lit(0.0))).withColumn("ess", ess(F.col("capped_n"), F.col("_s")))
    out = out.withColumn("_ss", F.aggregate("_levels", F.lit(0.0), lambda t, x: t + F.coalesce(x["w"] * F.pow(x["v"] - F.col("score"), 2), F.lit(0.0))))
    for key, _ in WARN:
        per = sums.groupBy(*cell, key).agg(F.sum(w).alias("_w")).groupBy(*cell).agg(F.max(F.when(F.col(key).isNotNull(), F.col("_w"))).alias(f"_{key}"), F.count(key).alias(f"_n_{key}"))
        out = _with(out, per, cell).withColumn(f"{key}_share", F.coalesce(F.try_divide(f"_{key}", "capped_n"), F.lit(0.0)))
    out = out.select(*cell, "score", "weighted_n", "capped_n", "ess", "_ss", *[f"{k}_share" for k, _ in WARN], "observations", F.col("_n_thread_id").alias("threads"), F.col("_n_author_id").alias("authors"), "firsthand_ratio")
    half = F.when(F.col("ess") > 1, 1.96 * F.sqrt(F.try_divide(F.col("_ss"), F.col("capped_n")) / F.col("ess"))).otherwise(0.0)
    out = out.withColumn("ci_low", F.greatest(F.lit(0.0), F.col("score") - half)).withColumn("ci_high", F.least(F.lit(100.0), F.col("score") + half)).withColumn("tier", tier(F.col("ess")))
    warn = [F.when(F.col("ess") < 30, "low_sample"), *[F.when(F.col(f"{k}_share") > s, f"{k}_concentration") for k, s in WARN]]
    wide = F.when(F.col("ci_high") - F.col("ci_low") > 30, "wide_interval")
    listed = lambda items: F.array_join(F.array_compact(F.array(*items)), ",")
    return out.withColumn("warnings", listed(warn)).withColumn("blockers", listed([*warn, wide])).withColumn("publishable", F.col("blockers") == "").drop("_ss")


def overall(scores: DataFrame, entity: str = "model_id", weights=OVERALL) -> DataFrame:
    """Weighted mean over the aspects that are present, weights normalised to them."""
    w = F.lit(None).cast("double")
    for k, x in enumerate(weights):
        w = F.when(F.col("aspect") == k, x).otherwise(w)
    return scores.withColumn("_w", w).where("_w is not null").groupBy(entity).agg((F.sum(F.col("score") * F.col("_w")) / F.sum("_w")).alias("overall"), F.count("*").alias("aspects"))


def pool_tier(obs: DataFrame, entity: str) -> DataFrame:
    """Effective size and tier of the whole pool of an entity, capped over the pool."""
    sums, _ = cap_factors(_sums(obs, (entity,)), (entity,))
    f = F.col("factor")
    return sums.groupBy(entity).agg(ess(F.sum(F.col("weight") * f), F.sum(F.col("squares") * f * f)).alias("ess")).withColumn("tier", tier(F.col("ess"), 15, 50))


def source_mix(obs: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Share of the capped weight of each platform of a cell, one row each."""
    sums, _ = cap_factors(_sums(obs, cell), cell)
    per = sums.groupBy(*cell, "platform").agg(F.sum(F.col("weight") * F.col("factor")).alias("w"))
    return per.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*cell))).drop("w")


def complaint_rate(obs: DataFrame, flag: str, entity: str = "model_id") -> DataFrame:
    """Weighted share of flagged rows, with the Wilson interval of the raw counts."""
    out = obs.groupBy(entity).agg((F.sum(F.when(F.col(flag), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("rate"), F.count_if(flag).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumn("low", low).withColumn("high", high)


def top_evidence(obs: DataFrame, cell: Sequence[str] = CELL, n: int = 4) -> DataFrame:
    """The heaviest rows of each cell; ties by ``seq``."""
    return obs.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("weight"), "seq"))).where(F.col("rank") <= n)


def rank_order(board: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows numbered by tier (ranked, provisional, insufficient), then score, then id, inside each value of ``by``."""
    order = F.when(F.col("tier") == "ranked", 0).when(F.col("tier") == "provisional", 1).otherwise(2)
    return board.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(order, F.desc(F.round("score", 9)), "model_id")))
