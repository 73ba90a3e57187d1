"""Metrics of labels and classifiers over long predictions (row_id, backend, field, label, confidence, actual)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def macro_f1(predictions: DataFrame, by: Sequence[str] = ("backend", "field")) -> DataFrame:
    """Accuracy and macro-F1 over the union of actual and predicted labels."""
    sides = predictions.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("l"), (F.col("label") == F.col("actual")).cast("int").alias("tp"), (F.col("label") != F.col("actual")).cast("int").alias("fp"), F.lit(0).alias("fn")),
        F.struct(F.col("actual").alias("l"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), (F.col("label") != F.col("actual")).cast("int").alias("fn")),
    )).alias("x")).select(*by, "x.*")
    per = sides.groupBy(*by, "l").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return per.groupBy(*by).agg(F.avg(f1).alias("macro_f1"), (F.sum("tp") / (F.sum("tp") + F.sum("fn"))).alias("accuracy"), F.count("*").alias("labels"))


def thresholds(predictions: DataFrame, cuts: Sequence[float], by: Sequence[str] = ("field",)) -> DataFrame:
    """Coverage, precision and mean confidence of the answers at each threshold."""
    rows = predictions.withColumn("threshold", F.explode(F.array(*map(F.lit, cuts)))).withColumn("in", F.col("confidence") >= F.col("threshold"))
    return rows.groupBy(*by, "threshold").agg(
        F.count("*").alias("n"), F.count_if("in").alias("answered"), F.avg(F.col("in").cast("double")).alias("coverage"),
        F.avg(F.when(F.col("in"), (F.col("label") == F.col("actual")).cast("double"))).alias("precision"), F.avg(F.when(F.col("in"), F.col("confidence"))).alias("mean_confidence"),
    )


def operating_point(report: DataFrame, least: float, by: Sequence[str] = ("field",)) -> DataFrame:
    """The lowest threshold with at least that precision."""
    return report.groupBy(*by).agg(F.min(F.when(F.col("precision") >= least, F.col("threshold"))).alias("threshold"))


def vote(predictions: DataFrame, agreement: int = 2, confidence: float = 0.5) -> DataFrame:
    """(row_id, field, label, votes, confidence): most votes, then highest mean confidence, then label; null label = abstained."""
    per = predictions.groupBy("row_id", "field", "label").agg(F.count("*").alias("votes"), F.round(F.avg("confidence"), 9).alias("mean"), F.max("actual").alias("actual"))
    best = per.withColumn("_rn", F.row_number().over(Window.partitionBy("row_id", "field").orderBy(F.desc("votes"), F.desc("mean"), "label"))).where("_rn = 1")
    return best.select("row_id", "field", F.when((F.col("votes") >= agreement) & (F.col("mean") >= confidence), F.col("label")).alias("label"), "votes", "mean", "actual")


def vote_metrics(votes: DataFrame) -> DataFrame:
    return votes.groupBy("field").agg(F.count("*").alias("n"), F.count("label").alias("answered"), F.avg((F.col("label") == F.col("actual")).cast("double")).alias("precision"), F.avg(F.col("label").isNotNull().cast("double")).alias("coverage"))


def confusion(predictions: DataFrame, n: int = 20, by: Sequence[str] = ("field",)) -> DataFrame:
    """The most frequent (actual, label) pairs of each field."""
    per = predictions.where("actual <> label").groupBy(*by, "actual", "label").agg(F.count("*").alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "actual", "label"))).where(F.col("rank") <= n)


def readiness(scores: DataFrame, examples: Column, groups: Column, least=(300, 75, 0.70, 0.60)) -> DataFrame:
    """One row: failed gates (examples, groups, mean macro-F1, macro-F1 of each field), comma-joined."""
    agg = scores.agg(F.avg("macro_f1").alias("mean"), F.min("macro_f1").alias("worst"), F.first(examples).alias("examples"), F.first(groups).alias("groups"))
    failed = [F.when(F.col("examples") < least[0], "examples"), F.when(F.col("groups") < least[1], "groups"), F.when(F.col("mean") < least[2], "mean_macro_f1"), F.when(F.col("worst") < least[3], "field_macro_f1")]
    return agg.withColumn("failures", F.array_join(F.array_compact(F.array(*failed)), ",")).withColumn("ready", F.col("failures") == "")


def hash_rank(cols: Sequence[str | Column], seed: int) -> Column:
    """A portable pseudo-random order of values: the hex digest of seed and value."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def grouped_split(rows: DataFrame, group: str, seed: int, share: float = 0.25) -> DataFrame:
    """(group, test): a quarter of the groups, at least one, are held out; no group is on both sides."""
    groups = rows.where(F.col(group).isNotNull()).select(group).distinct()
    n = groups.count()
    order = groups.withColumn("h", hash_rank([group], seed))
    # The cut value instead of a global numbering: one sorted prefix of the digests.
    cut = order.orderBy("h", group).limit(max(1, round(share * n))).agg(F.max("h").alias("h")).first().h
    return order.select(group, (F.col("h") <= F.lit(cut)).alias("test"))


def grouped_folds(rows: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """(group, fold): groups dealt by digest."""
    return rows.where(F.col(group).isNotNull()).select(group).distinct().withColumn("fold", F.conv(F.substring(hash_rank([group], seed), 1, 8), 16, 10).cast("long") % folds)


def backend_ranking(metrics: DataFrame) -> DataFrame:
    """Backends by mean macro-F1 over their fields, with their lowest field; a row for each backend is ranked."""
    means = metrics.groupBy("backend").agg(F.avg("macro_f1").alias("mean_f1"), F.min("macro_f1").alias("lowest"), F.count("*").alias("fields"))
    return means.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.round("mean_f1", 9)), "backend")))


def stratified_split(rows: DataFrame, key: str, label: str, seed: int, share: float = 0.25) -> DataFrame:
    """(key, label, test): a share of the rows of each label, at least one; labels of one row train.

    Rows are ranked by a digest.  Its first byte cuts a label into 256 parts
    that are counted first, so that a frequent label is not one task.
    """
    h = rows.select(key, F.col(label).alias("label"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).alias("_h")).withColumn("_b", F.substring("_h", 1, 2))
    parts = h.groupBy("label", "_b").agg(F.count("*").alias("_n"))
    each = Window.partitionBy("label")
    parts = parts.select("label", "_b", F.sum("_n").over(each).alias("_all"), (F.sum("_n").over(each.orderBy("_b")) - F.col("_n")).alias("_before"))
    taken = F.when(F.col("_all") > 1, F.greatest(F.lit(1), F.bround(share * F.col("_all")).cast("long"))).otherwise(0)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("label", "_b").orderBy("_h", key))
    on = F.col("p.label").eqNullSafe(F.col("h.label")) & (F.col("p._b") == F.col("h._b"))
    return h.alias("h").join(parts.alias("p"), on).select(F.col(f"h.{key}"), F.col("h.label"), F.col("h._b"), "_h", "_before", taken.alias("_k")).select(key, "label", (rank <= F.col("_k")).alias("test"))


def suggestions(predictions: DataFrame, least: float) -> DataFrame:
    """(row_id, backend, field, suggestion): a backend's label where its accuracy on the field is at least ``least``, else null."""
    stored = predictions.groupBy("backend", "field").agg(F.avg((F.col("label") == F.col("actual")).cast("int")).alias("_accuracy"))
    shown = F.when(F.round("_accuracy", 9) >= least, F.col("label"))
    return predictions.join(stored, ["backend", "field"]).select("row_id", "backend", "field", shown.alias("suggestion"))
