"""The review loop: joining human decisions, queues, training rows and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first in ``order`` (a total order makes it stable under repartitioning)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_reviews(reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_wins(reviews, keys, [F.desc("seq")])


def apply_reviews(obs: DataFrame, reviews: DataFrame, keys=("source_item_id", "model_id")) -> DataFrame:
    """Human values where given, else the machine's; ``changed`` marks rows with a new value. The last review wins."""
    r = last_reviews(reviews, keys).select(*keys, "human_polarity", "human_aspect", "excluded")
    out = obs.join(r, list(keys), "left")
    return out.withColumn("changed", F.coalesce((F.col("human_polarity") != F.col("polarity")) | (F.col("human_aspect") != F.col("aspect")), F.coalesce(F.col("human_polarity") != F.col("polarity"), F.col("human_aspect") != F.col("aspect"), F.lit(False)))).withColumns(
        {"polarity": F.coalesce("human_polarity", "polarity"), "aspect": F.coalesce("human_aspect", "aspect")}
    )


def split_by_review(obs: DataFrame, reviews: DataFrame, keys=("source_item_id", "model_id")) -> DataFrame:
    """``part``: machine (not reviewed), dropped (excluded) or human, with overrides applied."""
    r = last_reviews(reviews, keys).select(*keys, "human_polarity", "excluded")
    return obs.join(r, list(keys), "left").withColumn("part", F.when(F.col("excluded").isNull(), "machine").when(F.col("excluded"), "dropped").otherwise("human")).withColumn("polarity", F.coalesce("human_polarity", "polarity"))


def unreviewed(obs: DataFrame, reviews: DataFrame, keys=("source_item_id", "model_id")) -> DataFrame:
    """Rows without a review that counts: one with a human value or an exclusion."""
    counted = reviews.where(F.col("human_polarity").isNotNull() | F.col("human_aspect").isNotNull() | F.col("excluded")).select(*keys).distinct()
    return obs.join(counted, list(keys), "left_anti")


def bucket(confidence: Column, flagged: Column) -> Column:
    """Review priority, 0 first."""
    return F.when(flagged & (confidence < 0.6), 0).when(confidence < 0.6, 1).when(flagged, 2).when(confidence < 0.72, 3).otherwise(4)


def queue(obs: DataFrame, reviews: DataFrame, limit: int = 200) -> DataFrame:
    """The review queue: unreviewed rows in need of review, the first of each (model, aspect) before the rest, with stable ids."""
    rows = unreviewed(obs, reviews).withColumn("bucket", bucket(F.col("confidence"), F.col("regression_flag") | F.col("hallucination_flag"))).where("bucket < 4")
    key = ["bucket", "confidence", "model_id", "aspect", "source_item_id"]
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("model_id", "aspect").orderBy(*key)) > 1)
    top = rows.orderBy("again", *key).limit(limit)
    return top.withColumn("review_id", F.substring(F.sha2(F.concat_ws("|", "source_item_id", "model_id", "aspect"), 256), 1, 16))


def active_learning(predictions: DataFrame, low: float = 0.65, limit: int = 200) -> DataFrame:
    """Rows by 3 x fields with several labels + fields whose best confidence is below ``low``."""
    per = predictions.groupBy("row_id", "field").agg(F.countDistinct("label").alias("labels"), F.max("confidence").alias("best"))
    out = per.groupBy("row_id").agg(F.count_if(F.col("labels") > 1).alias("disagreeing"), F.count_if(F.col("best") < low).alias("uncertain"))
    return out.withColumn("priority", 3 * F.col("disagreeing") + F.col("uncertain")).orderBy(F.desc("priority"), "row_id").limit(limit)


def training_rows(obs: DataFrame, reviews: DataFrame, keys=("source_item_id", "model_id")) -> DataFrame:
    """Reviewed, not excluded rows with at least one human value; human values else machine ones."""
    r = last_reviews(reviews, keys).where("not excluded and (human_polarity is not null or human_aspect is not null)").drop("seq")
    return obs.join(r, list(keys)).select(*keys, F.coalesce("human_aspect", "aspect").alias("aspect"), F.coalesce("human_polarity", "polarity").alias("polarity"), "task", "thread_id", "seq")


def without_threads(rows: DataFrame, threads: DataFrame) -> DataFrame:
    """Rows whose thread is not held out; a null thread never is."""
    return rows.join(threads.select("thread_id").distinct(), "thread_id", "left_anti")


def gate(rows: DataFrame, wide: DataFrame, gates: dict[str, float]) -> DataFrame:
    """Machine rows whose aspect and polarity predictions clear their gates; other fields apply above theirs."""
    out = rows.join(wide, rows["source_item_id"] == wide["row_id"]).where((F.col("aspect_confidence") >= gates["aspect"]) & (F.col("polarity_confidence") >= gates["polarity"]))
    return out.withColumn("task_applied", F.col("task_confidence") >= gates["task"]).withColumn("firsthand_applied", F.col("firsthand_confidence") >= gates["firsthand"])


def widened(predictions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(row_id, <field>_label, <field>_confidence): one backend's long predictions as columns."""
    aggs = [F.max(F.when(F.col("field") == f, F.col(c))).alias(f"{f}_{c}") for f in fields for c in ("label", "confidence")]
    return predictions.groupBy("row_id").agg(*aggs)


def thread_walk(turns: DataFrame, depth: int, most: int) -> DataFrame:
    """(thread, node, parent, depth, place): replies breadth first from each root, without deleted nodes and what hangs below them.

    Levels are joined one after the other; ``depth`` bounds their number.
    """
    alive = turns.where("not deleted")
    level = alive.where("parent is null").select("thread", "node", "parent", F.lit(0).alias("depth"))
    found = level
    for d in range(1, depth + 1):
        level = alive.join(level.select("thread", F.col("node").alias("parent")), ["thread", "parent"]).select("thread", "node", "parent", F.lit(d).alias("depth"))
        found = found.unionByName(level)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("thread").orderBy("depth", "node"))).where(F.col("place") <= most)
