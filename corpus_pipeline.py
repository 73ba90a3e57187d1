"""A cleaning pipeline for a training corpus: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.

Every row is judged by itself: the join and the decontamination give rows a key
of their own, so rows with a null or a repeated doc_id are dropped or kept one
by one.  Of each component one row stays, that with the smallest doc_id (nulls
last), and of several with that doc_id the first in the staged input.

Nulls, empty and long texts: as the operators have them; a null or empty text is
neither toxic nor a copy nor contaminated, holds no private data, and is packed
as one end id.  An empty table gives no pieces.

Each `run` stages its tables under a scope of its own and deletes them when a
later stage no longer reads them; its result reads the staged ids of the last
stage, which stay.  Runs at the same time, and results of earlier runs, do not
disturb each other.  Stages that are called one by one share one scope: each
deletes what the one before it staged, so its result must have been written.
"""

from __future__ import annotations

import os
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import common, decontamination, jaccard, packing, pii, toxicity

#: Decisions about more rows than this are not broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
KEY_VARIABLE = "EVIDRA_PII_KEY"


_RUN: ContextVar[str] = ContextVar("run", default="stages")


def _scope(spark: SparkSession, name: str) -> str:
    """Starts a stage: what earlier stages of this run staged is deleted, as their results have been written and read again."""
    for other in ("toxicity", "jaccard", "decontamination", "pii", "packing"):
        common.release(spark, f"pipeline-{_RUN.get()}-{other}")
    return f"pipeline-{_RUN.get()}-{name}"


def _keyed(docs: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key ``_row`` of each row, staged so that it stays; and (doc_id, text) with that key as doc_id."""
    keyed = common.staged(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed", scope)
    return keyed, keyed.select(F.col("_row").alias("doc_id"), "text")


def _without(keyed: DataFrame, dropped: DataFrame, scope: str) -> DataFrame:
    """``keyed`` without the rows whose key is in ``dropped``, and without the key."""
    dropped = common.staged(dropped.select("_row"), "dropped", scope)
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return keyed.join(dropped, "_row", "left_anti").drop("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts."""
    _scope(spark, "toxicity")
    return toxicity.score(docs, toxicity.trained(spark, sf_dir, docs)).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, the smallest by (doc_id with nulls last, row); word 5-grams, similarity 0.8."""
    scope = _scope(spark, "jaccard")
    keyed, rows = _keyed(docs, scope)
    others = common.staged(jaccard.join(rows, scope=scope).where("component_id <> doc_id").select(F.col("doc_id").alias("_row"), "component_id"), "others", scope)
    # Only components of more than one row; the row that names one is its member too.
    members = others.unionByName(others.select(F.col("component_id").alias("_row"), "component_id").distinct())
    members = common.staged(members.join(keyed.select("_row", "doc_id"), "_row"), "members", scope)
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return _without(keyed, members.join(kept, "_row", "left_anti"), scope)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    scope = _scope(spark, "decontamination")
    keyed, rows = _keyed(docs, scope)
    found = decontamination.contamination(rows, common.table(spark, sf_dir, "benchmark"), scope=scope)
    return _without(keyed, found.where("contaminated").select(F.col("doc_id").alias("_row")), scope)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for private data; n_chars follows the new text."""
    scope = _scope(spark, "pii")
    out = pii.replace(docs, os.environ.get(KEY_VARIABLE, pii.DEMO_KEY), scope=scope)
    return out.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    import public_tokenizers

    scope = _scope(spark, "packing")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), scope=scope)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("private_data", replace_private_data),
    ("packing", pack_sequences),
]
#: Scores of a fitted model, token ids and keyed hashes are not SQL: tests compare `run` with a brute-force version of the five decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), ""
    token = _RUN.set(uuid.uuid4().hex[:12])
    try:
        for name, stage in STAGES[:-1]:
            scope = f"pipeline-{_RUN.get()}-out-{name}"
            path = common.new_dir(spark, f"stage-{name}", scope)
            stage(spark, docs, sf_dir).write.parquet(path)
            common.release(spark, before)
            docs, before = spark.read.parquet(path), scope
        out = STAGES[-1][1](spark, docs, sf_dir)  # has staged the ids of all texts
        common.release(spark, before)
        return out
    finally:
        _RUN.reset(token)
