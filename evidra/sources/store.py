"""A store of snapshots of several tables that changes in one step.

Every table of a snapshot is written under a path of its own that no reader
knows; then one small manifest with the next number names the paths of all
snapshots and the current one.  A manifest is written aside and renamed to its
number, which fails if that number exists, so of two writers one has to begin
again and no reader ever sees half a snapshot.  A writer that dies leaves the
store as it was; `vacuum` removes what no manifest names.  Publishing a snapshot
again replaces it as a whole.  Files go through Spark and its file systems alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def manifest(spark: SparkSession, root: str) -> dict:
    """{number, current, snapshots: {id: {table: {path, rows}}}} as last committed; number 0 for an empty store."""
    names = [n for n in _listed(spark, f"{root}/_commits") if n.endswith(".json") and n[:-5].isdigit()]
    if not names:
        return {"number": 0, "current": None, "snapshots": {}}
    return json.loads("".join(r.value for r in spark.read.text(f"{root}/_commits/{names[-1]}", wholetext=True).collect()))


def commit(spark: SparkSession, root: str, state: dict) -> None:
    """Makes ``state`` the next manifest; raises if another writer was first."""
    state = state | {"number": state["number"] + 1}
    to = f"{root}/_commits/{state['number']:020d}.json"
    fs, p = _fs(spark, to)
    fs.mkdirs(p.getParent())
    aside = _fs(spark, f"{root}/_commits/_{uuid.uuid4().hex}")[1]
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    if fs.exists(p) or not fs.rename(aside, p):
        fs.delete(aside, False)
        raise RuntimeError(f"another writer committed manifest {state['number']}: read the store again and repeat")


def publish(spark: SparkSession, root: str, snapshot_id: str, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None, current: bool = True) -> dict:
    """Writes all tables of a snapshot and commits them together; ``keys``: columns whose values must be distinct in a table. Returns the manifest that was replaced."""
    before = manifest(spark, root)
    own = {}
    for name, df in tables.items():
        path = f"{root}/{name}/{snapshot_id}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        written = spark.read.parquet(path)
        if (k := list((keys or {}).get(name, ()))) and not written.groupBy(*k).count().where("count > 1").isEmpty():
            raise ValueError(f"table {name} repeats a key {k}")
        own[name] = {"path": path, "rows": written.count()}
    commit(spark, root, before | {"snapshots": before["snapshots"] | {snapshot_id: own}, "current": snapshot_id if current else before["current"]})
    return before


def read(spark: SparkSession, root: str, table: str, snapshot_id: str | None = None) -> DataFrame:
    """A table of the current snapshot, or of a named one, with its snapshot_id."""
    state = manifest(spark, root)
    snapshot_id = snapshot_id or state["current"]
    if snapshot_id not in state["snapshots"] or table not in state["snapshots"][snapshot_id]:
        raise ValueError(f"the store has no table {table} of snapshot {snapshot_id}")
    return spark.read.parquet(state["snapshots"][snapshot_id][table]["path"]).withColumn("snapshot_id", F.lit(snapshot_id))


def history(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot_id, table, rows, current): what the store holds."""
    state = manifest(spark, root)
    rows = [(s, t, x["rows"], s == state["current"]) for s, own in state["snapshots"].items() for t, x in own.items()]
    return spark.createDataFrame(rows, "snapshot_id string, table string, rows long, current boolean")


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Deletes the paths that the last manifest does not name, for times when nobody publishes; returns them."""
    state = manifest(spark, root)
    named = {x["path"].rsplit("/", 2)[1] + "/" + x["path"].rsplit("/", 1)[1] for own in state["snapshots"].values() for x in own.values()}
    gone = [f"{t}/{v}" for t in _listed(spark, root) if not t.startswith("_") for v in _listed(spark, f"{root}/{t}") if f"{t}/{v}" not in named]
    for path in gone:
        fs, p = _fs(spark, f"{root}/{path}")
        fs.delete(p, True)
    return gone
