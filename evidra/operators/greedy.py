"""Greedy clusters of vectors in the order of rows, with the result of one pass but without one task over all rows.

Each row joins the cluster whose running mean is nearest by cosine, the earliest
of equals, if that is at least ``least``; else it opens a cluster.  What a row
does depends on all rows before it, yet only through clusters it could join.
If it joins, the mean is within theta = arccos(least) of it; a mean of vectors
that joined in this way is within theta of one of them (its length is at least
``least`` times theirs), so some earlier member is within 2 theta of the row.
Rows that no chain of pairs within 2 theta connects never meet in a cluster:
every connected component is worked through by itself.

Components come from the index of `neighbours` (vectors that agree in many signs
and lie close together stand as one, with the angle of links widened by twice
their distance, so nothing is lost by that) and from `graph.components`.  Small
tables are compared in full; beyond ``target`` rows the index finds each pair
with the chance ``recall``, and a component is found whole as long as its found
pairs connect it.

A component with all rows within theta / 2 of its first is one cluster whatever
their order: its running means are prefix sums in two levels, so the hot group
of near copies is spread over tasks.  The other components are streamed in
order, with nothing but the open clusters of one component in memory.  A
component that is neither is one stream however large it is: its rows depend on
each other one by one.

Null, empty and not finite vectors have no cluster.  A zero vector is similar to
nothing and opens a cluster of its own.  Equal places in the order go by key.
Keys are distinct whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, neighbours
from .staging import consecutive, cut
from .vectors import dot

#: Rows of a component that are added up together.
CHUNK = 8192
_SIGNS = 24


def bundled(units: DataFrame, angle: float, seed: int = 11) -> DataFrame:
    """(id, home): vectors with equal signs for 24 planes that lie within ``angle`` of the first of them have it as their home; others are their own."""
    rows = neighbours.keyed(units, 1, _SIGNS, seed)
    first = rows.groupBy("dims", "sign").agg(F.min_by(F.struct("id", "unit"), "id").alias("_f"))
    close = dot(F.col("unit"), F.col("_f.unit")) >= math.cos(angle)
    return rows.join(first, ["dims", "sign"]).select("id", F.when(close, F.col("_f.id")).otherwise(F.col("id")).alias("home"))


def groups(df: DataFrame, key: str, vector: str, least: float, recall: float = 0.99, target: int = 1024) -> DataFrame:
    """(key, component) of every row with a vector that is not zero: rows of different components are in no cluster together."""
    units, members = neighbours.classes(df, key, vector)
    units = cut(units)
    theta = math.acos(least)
    tables, bits = neighbours.plan(units.count(), math.cos(min(math.pi, 2 * theta)), recall, target)
    if bits:
        homes = cut(bundled(units, theta / 8))
        heads = units.join(homes.where("home = id").select("id"), "id")
        wide = math.cos(min(math.pi, 2.25 * theta))
        tables, bits = neighbours.plan(heads.count(), wide, recall, target)
        found = graph.components(neighbours.links(heads, wide, tables, bits, forest=True))
        of_unit = homes.join(found.withColumnRenamed("id", "home"), "home", "left").select("id", F.coalesce("component", "home").alias("component"))
    else:
        found = graph.components(neighbours.links(units, math.cos(min(math.pi, 2 * theta)), tables, bits, forest=True))
        of_unit = units.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return members.join(of_unit, "id").select("key", "component")


def _streamed(least: float):
    """Goes through rows sorted by component and order; the state is the clusters of one component."""

    def run(batches):
        comp, n = None, 0
        mean = norm = size = first = None
        for b in batches:
            out = []
            flat, off = b.column("_v").values.to_numpy(zero_copy_only=False), b.column("_v").offsets.to_numpy()
            for i, (c, k) in enumerate(zip(b.column("component").to_pylist(), b.column("_k").to_pylist(), strict=True)):
                v = flat[off[i] : off[i + 1]]
                if c != comp:
                    comp, n = c, 0
                    mean, norm, size, first = np.zeros((1, len(v))), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64)
                length = float(np.sqrt(v @ v))
                best, score = -1, -1.0
                if n and length:
                    s = mean[:n] @ v / np.maximum(norm[:n] * length, 1e-300)
                    best = int(s.argmax())
                    score = float(s[best])
                if best >= 0 and score >= least:
                    size[best] += 1
                    mean[best] = (mean[best] * (size[best] - 1) + v) / size[best]
                    norm[best] = np.sqrt(mean[best] @ mean[best])
                    out.append((k, int(first[best]), score))
                    continue
                if n == len(size):
                    mean, norm, size, first = (np.concatenate([x, np.zeros_like(x)]) for x in (mean, norm, size, first))
                mean[n], norm[n], size[n], first[n] = v, length, 1, k
                n += 1
                out.append((k, k, 1.0))
            k, f, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(k, pa.int64()), pa.array(f, pa.int64()), pa.array(s, pa.float64())], names=["key", "cluster", "similarity"])

    return run


def _tight(rows: DataFrame) -> DataFrame:
    """(key, cluster, similarity) of components that are one cluster each: means of all rows before, by sums of chunks and inside them."""
    placed = cut(consecutive(rows, ["component", "_o", "_k"], "_at").withColumn("_chunk", F.floor(F.col("_at") / CHUNK)))

    def total(t: pa.Table) -> pa.Table:
        col = t.column("_v").combine_chunks()
        m = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
        return pa.table({"component": t.column("component")[:1], "_chunk": t.column("_chunk")[:1], "_n": pa.array([len(m)]), "_s": pa.array([m.sum(0).tolist()])})

    def before(t: pa.Table) -> pa.Table:
        t = t.sort_by("_chunk")
        s, n = np.array(t.column("_s").to_pylist()), t.column("_n").to_numpy()
        return pa.table({"component": t.column("component"), "_chunk": t.column("_chunk"), "_n": pa.array(np.cumsum(n) - n), "_s": pa.array((np.cumsum(s, 0) - s).tolist(), pa.list_(pa.float64()))})

    def follow(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        col = t.column("_v").combine_chunks()
        m = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
        sums = np.array(t.column("_s")[0].as_py()) + np.cumsum(m, 0) - m
        length = np.linalg.norm(sums, axis=1) * np.linalg.norm(m, axis=1)
        s = np.where(length > 0, (sums * m).sum(1) / np.maximum(length, 1e-300), 1.0)
        if t.column("_n")[0].as_py() == 0:
            s[0] = 1.0
        return pa.table({"key": t.column("_k"), "cluster": t.column("_first"), "similarity": pa.array(s)})

    sums = placed.groupBy("component", "_chunk").applyInArrow(total, "component long, _chunk long, _n long, _s array<double>")
    ahead = sums.groupBy("component").applyInArrow(before, "component long, _chunk long, _n long, _s array<double>")
    first = placed.groupBy("component").agg(F.min_by("_k", "_at").alias("_first"))
    return placed.join(ahead.join(first, "component"), ["component", "_chunk"]).groupBy("component", "_chunk").applyInArrow(follow, "key long, cluster long, similarity double")


def clusters(df: DataFrame, key: str, vector: str, order: str, least: float = 0.92, recall: float = 0.99, target: int = 1024, hot: int = 20_000) -> DataFrame:
    """(key, cluster, similarity): the cluster of every row by the key of the row that opened it, and the cosine to its mean when the row came (1 for the opener)."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity must be above 0 and at most 1")
    found = groups(df, key, vector, least, recall, target)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")))
    rows = df.where((F.size(vector) > 0) & finite).select(F.col(key).cast("long").alias("_k"), F.col(order).alias("_o"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    zero = F.forall("_v", lambda x: x == 0)
    placed = cut(rows.where(~zero).join(found.withColumnRenamed("key", "_k"), "_k").select("component", "_o", "_k", "_v"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    first = placed.join(sizes, "component").groupBy("component").agg(F.min_by("_v", F.struct("_o", "_k")).alias("_f"))
    norm = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    near = placed.join(first, "component").groupBy("component").agg(F.min(dot(F.col("_v"), F.col("_f")) / (norm("_v") * norm("_f"))).alias("_c"))
    tight = cut(near.where(F.col("_c") >= math.cos(math.acos(least) / 2)).select("component"))
    loose = placed.join(tight, "component", "left_anti").repartition("component").sortWithinPartitions("component", "_o", "_k")
    out = loose.select("component", "_k", "_v").mapInArrow(_streamed(least), "key long, cluster long, similarity double")
    if not tight.isEmpty():
        out = out.unionByName(_tight(placed.join(tight, "component")))
    return out.unionByName(rows.where(zero).select(F.col("_k").alias("key"), F.col("_k").alias("cluster"), F.lit(1.0).alias("similarity")))


def numbered(members: DataFrame, df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, cluster, similarity, number): clusters counted from 1 in the order in which they were opened."""
    openers = members.where("key = cluster").select("cluster").join(df.select(F.col(key).cast("long").alias("cluster"), F.col(order).alias("_o")), "cluster")
    return members.join(consecutive(openers, ["_o", "cluster"], "number").select("cluster", (F.col("number") + 1).alias("number")), "cluster").select("key", "cluster", "similarity", "number")
