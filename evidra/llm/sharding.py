"""Sharding: minimax contiguous partition of atomic groups, with built-in functions only.

Equal texts are one group.  Groups are ordered by a 64-bit hash of the text and
first summed over at most 2^``unit_bits`` hash ranges, so that the ordered list
of sizes has a bound that does not grow with the data.  One SQL expression
searches the smallest feasible shard capacity by halving, checks each capacity
by filling shards greedily in order, and cuts where the fill overflows.  The
ranges at which a fill with one byte less overflows are then summed over smaller
ranges, and the search is repeated, until these are single groups: then no
smaller capacity is feasible for any cut between groups, so the result is the
minimax of the groups themselves.  A group is never split.

Places inside a shard come from counts of cells: a unit with many rows (a
frequent text) is dealt over cells by document, cells get their offsets from a
table of bounded size, and rows are numbered inside their cell, so no window
holds a whole shard or a whole hot group.

Nulls: a null text has size 16 and is a group of its own; null doc_ids are
numbered first in their cell.  Repeated rows are separate rows of one group; a long text counts
by its length and hash only, which Spark computes without a copy in Python.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: State of the greedy fill: sizes are added to the current shard until one does not fit.
_FILL = "aggregate({units}, named_struct('used', 0L, 'n', 1), (s, u) -> if(s.used + u.bytes > {cap}, named_struct('used', u.bytes, 'n', s.n + 1), named_struct('used', s.used + u.bytes, 'n', s.n)), s -> s.n)"
_CUTS = "aggregate({units}, named_struct('used', 0L, 'cuts', cast(array() as array<bigint>)), (s, u) -> if(s.used + u.bytes > {cap}, named_struct('used', u.bytes, 'cuts', array_append(s.cuts, u.unit)), named_struct('used', s.used + u.bytes, 'cuts', s.cuts)), s -> s.cuts)"


def capacity(units: DataFrame, shards: int, steps: int = 50) -> DataFrame:
    """One row (capacity, cuts, tight) from rows (unit long, bytes long): the smallest capacity that ``shards`` shards hold, the first unit of each later shard, and the units that overflow one byte less.

    The search ends after at most ``steps`` halvings, or at once when the
    bounds meet.
    """
    fits = _FILL.format(units="units", cap="((b.lo + b.hi) div 2)") + f" <= {int(shards)}"
    search = (
        f"aggregate(sequence(1, {int(steps)}), named_struct('lo', lo, 'hi', hi), (b, i) -> "
        f"case when b.lo >= b.hi then b when {fits} then named_struct('lo', b.lo, 'hi', (b.lo + b.hi) div 2) "
        "else named_struct('lo', (b.lo + b.hi) div 2 + 1L, 'hi', b.hi) end, b -> b.hi)"
    )
    return (
        units.agg(F.array_sort(F.collect_list(F.struct("unit", "bytes"))).alias("units"), F.coalesce(F.max("bytes"), F.lit(0)).alias("most"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
        # No capacity below the mean or the largest unit is feasible; mean plus largest always is.
        .select("units", F.expr(f"greatest(most, cast(ceil(total / {int(shards)}) as bigint))").alias("lo"), F.expr(f"most + cast(ceil(total / {int(shards)}) as bigint)").alias("hi"))
        .select("units", F.expr(search).alias("capacity"))
        .select("capacity", F.expr(_CUTS.format(units="units", cap="capacity")).alias("cuts"), F.expr(_CUTS.format(units="units", cap="(capacity - 1)")).alias("tight"))
    )


def minimax(rows: DataFrame, shards: int, unit_bits: int = 14, split: int = 256, scope: str = "") -> tuple[int, list[int]]:
    """(capacity, cuts) of rows (h long, size long): the smallest capacity for groups of equal ``h`` in their order, and the first ``h`` of each later shard.

    Each round refines at most ``shards`` ranges and those above the capacity,
    until none of them can change the result.  A range that is refined becomes
    up to ``split`` narrower ones, and a range of one hash is not refined, so
    the rounds end.
    """
    sums = F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("size").alias("bytes")
    units = common.staged(rows.groupBy(F.shiftright("h", 64 - unit_bits).alias("u")).agg(*sums).drop("u"), "units", scope)  # at most 2^unit_bits rows
    while True:
        best = capacity(units.select(F.col("lo").alias("unit"), "bytes"), shards).first()  # at most ``shards`` numbers
        tight = F.array(*map(F.lit, best.tight)).cast("array<bigint>")
        open_ = units.where((F.col("lo") < F.col("hi")) & (F.array_contains(tight, F.col("lo")) | (F.col("bytes") >= best.capacity)))
        open_ = common.staged(open_.select(F.col("lo").alias("a"), F.col("hi").alias("b")), "open", scope)
        if open_.isEmpty():
            break
        # A range holds at most 2^(64 - unit_bits) hashes, so its width is no overflow.
        part = F.expr(f"(h - a) div ((b - a) div {int(split)} + 1)")
        finer = rows.join(F.broadcast(open_), (F.col("h") >= F.col("a")) & (F.col("h") <= F.col("b"))).groupBy("a", part.alias("p")).agg(*sums)
        kept = units.join(F.broadcast(open_), units["lo"] == open_["a"], "left_anti")
        units = common.staged(kept.unionByName(finer.select("lo", "hi", "bytes")), "units", scope)
    return best.capacity, list(best.cuts)


def shard(docs: DataFrame, shards: int = 40, unit_bits: int = 14, overhead: int = 16, split: int = 256, scope: str = "") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; the largest shard is as small as the order of groups allows."""
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
    )
    rows = common.staged(rows, "sizes", scope)
    _, cuts = minimax(rows.select("h", "size"), shards, unit_bits, split, scope=scope)
    rows = rows.withColumns({
        "unit": F.shiftright("h", 64 - unit_bits).cast("int"), "shard": F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= F.col("h"))),
    })
    # At most 2^unit_bits + ``shards`` rows.
    units = common.staged(rows.groupBy("shard", "unit").agg(F.count("*").alias("n")), "counts", scope)
    limit = units.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    target = max(64, -(-limit * 4 // (1 << unit_bits)))
    units = units.select("shard", "unit", F.ceil(F.col("n") / target).cast("int").alias("parts"), (F.sum("n").over(Window.partitionBy("shard").orderBy("unit")) - F.col("n")).alias("base"))
    rows = rows.join(F.broadcast(units), ["shard", "unit"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")).cast("int"))
    cells = rows.groupBy("shard", "unit", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard", "unit").orderBy("part")) - F.col("n"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "unit", "part").orderBy("doc_id", "text_crc32")))
    # Cells: at most one for each unit and one for each ``target`` rows, that is fewer than 2^(unit_bits + 1) for large tables.
    return rows.join(F.broadcast(cells.select("shard", "unit", "part", "before")), ["shard", "unit", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("before") + F.col("k") - 1).cast("long").alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
