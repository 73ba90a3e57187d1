"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neighbours
from .staging import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero or mismatched vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def centroids(df: DataFrame, vector: str, by: str, dims: int) -> DataFrame:
    """(by, centroid): the mean of each place, aggregated in one pass with partial sums."""
    means = df.groupBy(by).agg(*[F.avg(F.col(vector)[k].cast("double")).alias(f"_{k}") for k in range(dims)])
    return means.select(by, F.array(*[f"_{k}" for k in range(dims)]).alias("centroid"))


def rubric_features(df: DataFrame, vector: str, rubrics: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """(key, label, feature): scaled cosine of every vector to each of the few rubric vectors (label, centroid)."""
    rows = rubrics.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 rubrics")
    each = F.array(*[F.struct(F.lit(r[0]).alias("label"), (F.lit(scale) * cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in r[1]]))).alias("feature")) for r in rows])
    return df.select(key, F.inline(each))


def similar_pairs(df: DataFrame, key: str, vector: str, least: float, recall: float = 0.95, target: int = 1024) -> DataFrame:
    """(kind, a, b, similarity): pairs of different vectors with a cosine of at least ``least``, and the class of every row with a vector.

    Equal vectors are one class (``class`` rows: representative, row, 1); ``link`` rows pair representatives, a < b.
    Pairs meet in the index of `neighbours` and are scored exactly: all of them while there are at most ``target``
    different vectors (or ``recall`` is 1, at a quadratic cost in blocks), each with the chance ``recall`` beyond that.
    Null, empty, zero and not finite vectors are in no pair; vectors of different lengths are never similar.
    """
    units, members = neighbours.classes(df, key, vector)
    units = cut(units)
    rows = units.count()
    tables, bits = (1, 0) if recall >= 1 else neighbours.plan(rows, least, recall, target)
    links = neighbours.links(units, least, tables, bits) if bits else neighbours.all_links(units, least, rows)
    out = members.select(F.lit("class").alias("kind"), F.col("id").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    return out.unionByName(links.select(F.lit("link").alias("kind"), "a", "b", "similarity"))
