"""Snapshots as nested documents and back, reloading of rows, and what a collection run reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .review import first_wins

#: One document for each model: its scores by aspect, and its evidence by "model|aspect".
DOCUMENT = "model_id int, scores map<string, struct<score: double, ess: double, ci: array<double>, tier: string>>, evidence map<string, array<struct<source_item_id: bigint, weight: double>>>"


def assembled(cells: DataFrame, evidence: DataFrame) -> DataFrame:
    """(model_id, document): JSON of all cells (model_id, aspect, score, ...) and evidence (model_id, aspect, source_item_id, weight, rank).

    A model has as many cells as there are aspects, and a few evidence rows in each, so a document is small.
    """
    one = F.struct("score", "ess", F.array("ci_low", "ci_high").alias("ci"), "tier")
    scores = cells.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("aspect").cast("string"), one))).alias("scores"))
    top = evidence.groupBy("model_id", "aspect").agg(F.sort_array(F.collect_list(F.struct("rank", "source_item_id", "weight"))).alias("items"))
    items = F.transform("items", lambda x: F.struct(x["source_item_id"].alias("source_item_id"), x["weight"].alias("weight")))
    shown = top.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "model_id", "aspect"), items))).alias("evidence"))
    return scores.join(shown, "model_id", "left").select("model_id", F.to_json(F.struct("model_id", "scores", "evidence")).alias("document"))


def parsed(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("document", DOCUMENT).alias("d")).select("d.*")


def flattened(documents: DataFrame) -> DataFrame:
    """(model_id, aspect, score, ess, ci_low, ci_high, tier): a row for each cell of each document."""
    return parsed(documents).select("model_id", F.explode("scores").alias("aspect", "c")).select("model_id", F.col("aspect").try_cast("int").alias("aspect"), "c.score", "c.ess", F.get("c.ci", F.lit(0)).alias("ci_low"), F.get("c.ci", F.lit(1)).alias("ci_high"), "c.tier")


def evidence_rows(documents: DataFrame) -> DataFrame:
    """(model_id, aspect, ordinal, source_item_id, weight) from the evidence maps."""
    lists = parsed(documents).select(F.explode("evidence").alias("key", "items"))
    part = lambda n: F.split_part("key", F.lit("|"), F.lit(n)).try_cast("int")
    return lists.select(part(1).alias("model_id"), part(2).alias("aspect"), F.posexplode("items").alias("ordinal", "x")).select("model_id", "aspect", "ordinal", "x.*")


def latest(snapshots: DataFrame, keys: Sequence[str], when: str) -> DataFrame:
    """The newest snapshot of each key; snapshots without a time are older than all others."""
    return first_wins(snapshots, keys, [F.desc_nulls_last(when)])


def reloaded(raw: DataFrame, keys: Sequence[str], order: Sequence[str], types: dict[str, str]) -> DataFrame:
    """The first row of each key; columns of text become ``types``, null where the text is not such a value."""
    return first_wins(raw, keys, order).withColumns({c: F.trim(c).try_cast(t) for c, t in types.items()})


def with_context(queue: DataFrame, raw: DataFrame, raw_key: str, order: str, shown: Sequence[str]) -> DataFrame:
    """The queue with ``context``: JSON of ``shown`` from the last raw record of its item, null where there is none.

    Only the raw records that the queue names are ranked.
    """
    named = raw.join(F.broadcast(queue.select(F.col("source_item_id").alias(raw_key)).distinct()), raw_key, "left_semi")
    last = first_wins(named, [raw_key], [F.desc(order)])
    return queue.join(last.select(F.col(raw_key).alias("source_item_id"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("context")), "source_item_id", "left")


def landed(items: DataFrame, config: DataFrame, source: str, order: str) -> DataFrame:
    """The first ``most`` items of each source that the small table ``config`` (source, kind, most) switches on."""
    cap = config.agg(F.max("most")).first()[0] or 0
    rows = items.join(F.broadcast(config), source).withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy(order)))
    return rows.where((F.col("_rn") <= cap) & (F.col("_rn") <= F.col("most"))).drop("_rn")


def stories(hits: DataFrame, excluded: DataFrame, least_comments: int, per_query: int) -> DataFrame:
    """Stories from search hits (query, rank, story, comments): enough comments, not excluded, the best of each query; the first query keeps a story."""
    rows = hits.where(F.col("comments") >= least_comments).join(excluded, "story", "left_anti")
    best = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("query").orderBy("rank", "story"))).where(F.col("_rn") <= per_query).drop("_rn")
    return first_wins(best, ["story"], ["query", "rank"])
