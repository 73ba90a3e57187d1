"""Token files: raw id payloads with a minimal perfect hash index.

Documents lie in ascending doc_id order in shards of raw little-endian ids
(no framing).  The index is cut into buckets by key hash; each bucket is a
minimal perfect hash (levels of bit maps, slot = rank of the bit) whose slots
hold a stored fingerprint, the shard, the offset and the length, so a key is
found by reading one bucket and one byte range.  A fingerprint that differs
says that the key is absent.

Writing takes one encoding pass and one shuffle: quantiles of doc_id (a scan
of that column) give the shard bounds.  An id that spans several bounds is
spread over their shards, so a hot id does not fill one.

Nulls: a null text is empty; null doc_ids come first and are one key.
Repeated doc_ids are keyed by (doc_id, copy), copies counted in file order.
An empty table gives no shards and an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NO_ID = -(1 << 63)


# ------------------------------------------------------ a minimal perfect hash


def key_hash(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return common.mix(common.mix(doc_id.astype(np.int64).view(np.uint64)) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def build_hash(keys: np.ndarray, spread: float = 1.5) -> tuple[list[np.ndarray], np.ndarray]:
    """(bit maps, slot of each key) for distinct 64-bit keys: a key gets the first level at which it is alone."""
    slot, maps, base = np.zeros(len(keys), np.int64), [], 0
    rest = np.arange(len(keys))
    while len(rest):
        size = max(16, int(len(rest) * spread))
        at = _place(keys[rest], len(maps), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slot[rest[alone]] = base + np.cumsum(bits)[at[alone]] - 1
        base += int(bits.sum())
        maps.append(bits)
        rest = rest[~alone]
    return maps, slot


def find_slots(maps: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slots of keys; a key that was not built in gets any slot or -1."""
    slot, base = np.full(len(keys), -1, np.int64), 0
    rest = np.arange(len(keys))
    for level, bits in enumerate(maps):
        at = _place(keys[rest], level, len(bits))
        here = bits[at]
        slot[rest[here]] = base + np.cumsum(bits)[at[here]] - 1
        base += int(bits.sum())
        rest = rest[~here]
    return slot


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (common.mix(keys + np.uint64((level + 1) * 0xD1342543DE82EF95 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (common.mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


# ------------------------------------------------------------------------ files


def _put(path: str, data: bytes) -> None:
    """Writes under another name, then renames: a task that runs twice leaves one whole file."""
    fs, p = common.open_fs(path)
    with fs.open_output_stream(tmp := f"{p}.{uuid.uuid4().hex}.part") as f:
        f.write(data)
    fs.move(tmp, p)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 2, keeps_space: bool = True, docs_per_shard: int = 8192, keys_per_bucket: int = 16384, scope: str = "") -> dict:
    """Writes shards and index below ``path`` and returns the manifest (also stored as manifest.json).

    ``manifest["keys"]`` is the path of a table of the keys, in Parquet.
    """
    spark = docs.sparkSession
    common.ship(spark)
    fs, root = common.open_fs(path)
    fs.create_dir(root, recursive=True)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs = docs.count()
    shards = max(1, -(-n_docs // docs_per_shard))
    bounds = np.array(docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else [], float)
    bounds = np.sort(bounds).astype(np.int64)

    def encode(batches):
        from evidra.llm import common as c

        enc = c.encoder(tokenizer, keeps_space)
        for b in common.given(batches, encodes=True):
            keys = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for i, j, got, off in enc.encode_column(b.column("text"), end):
                key, raw, cuts = keys[i:j], got.tobytes(), off * got.dtype.itemsize
                tie = np.array([zlib.crc32(raw[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], np.int64)
                lo, hi = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                pieces = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.record_batch([pa.array((lo + tie % (hi - lo + 1)).astype(np.int32)), pa.array(key), pa.array(tie), pa.array(np.diff(off)), pieces], names=["shard", "doc_id", "tie", "n", "ids"])

    def write(batches):
        from evidra.llm import token_files as t

        fs, out, tmp, shard, at, last, copy = None, None, "", -1, 0, None, 0
        for b in common.given(batches):
            if b.num_rows == 0:
                continue
            if out is None:
                shard = b.column("shard")[0].as_py()
                fs, to = t.common.open_fs(f"{path}/shard-{shard:06d}.bin")
                out = fs.open_output_stream(tmp := f"{to}.{uuid.uuid4().hex}.part")
            key, n = b.column("doc_id").to_numpy(), b.column("n").to_numpy()
            for raw in b.column("ids"):
                out.write(raw.as_buffer())
            copies = []
            for k in key.tolist():
                copy = copy + 1 if k == last else 0
                last = k
                copies.append(copy)
            ends = at + np.cumsum(n)
            yield pa.record_batch([pa.array(key), pa.array(np.array(copies, np.int64)), pa.array(np.full(len(n), shard, np.int32)), pa.array(ends - n), pa.array(n)], names=["doc_id", "copy", "shard", "at", "n"])
            at = int(ends[-1])
        if out is not None:
            out.close()
            fs.move(tmp, to)

    rows = (
        ids.mapInArrow(encode, "shard int, doc_id long, tie long, n long, ids binary")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("doc_id", "tie")
        .mapInArrow(write, "doc_id long, copy long, shard int, at long, n long")
    )
    rows = common.staged(rows, "rows", scope)
    # Where each shard starts, and how many rows of its first id lie in earlier shards: a few numbers for each shard.
    told = rows.groupBy("shard").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.struct("doc_id", "copy"))["copy"].alias("copy")).orderBy("shard").collect()
    starts, carry, total, last, copies = np.zeros(shards, np.int64), np.zeros(shards, np.int64), 0, None, 0
    for r in told:
        starts[r.shard], carry[r.shard] = total, copies if r["first"] == last else 0
        total += r.n
        copies = r.copy + 1 + (carry[r.shard] if r["last"] == r["first"] == last else 0)
        last = r["last"]
    firsts = {r.shard: r["first"] for r in told}
    buckets = max(1, -(-n_docs // keys_per_bucket))

    def keyed(batches):
        from evidra.llm import token_files as t

        for b in common.given(batches):
            key, copy, shard = (b.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "copy", "shard"))
            first = np.array([firsts[s] for s in shard.tolist()], np.int64)
            copy = copy + np.where(key == first, carry[shard], 0)
            bucket = (t.key_hash(key, copy) % np.uint64(buckets)).astype(np.int32)
            yield pa.record_batch([pa.array(bucket), b.column("doc_id"), pa.array(copy), b.column("shard"), b.column("at"), b.column("n")], names=["bucket", "doc_id", "copy", "shard", "at", "n"])

    def index(batches):
        from evidra.llm import token_files as t

        got = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if got is None:
            return
        col = {k: got.column(k).to_numpy() for k in ("bucket", "doc_id", "copy", "shard", "at", "n")}
        keys = t.key_hash(col["doc_id"], col["copy"])
        maps, slot = t.build_hash(keys)
        table = np.zeros(len(keys), [("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])
        for k, v in (("print", t.fingerprint(keys)), ("shard", col["shard"]), ("at", col["at"]), ("n", col["n"])):
            table[k][slot] = v
        held = io.BytesIO()
        np.savez(held, table=table, sizes=np.array([len(m) for m in maps]), bits=np.packbits(np.concatenate(maps)))
        t._put(f"{path}/index-{col['bucket'][0]:06d}.npz", held.getvalue())
        yield pa.record_batch([pa.array(col["bucket"]), pa.array(col["doc_id"]), pa.array(col["copy"])], names=["bucket", "doc_id", "copy"])

    keys = rows.mapInArrow(keyed, "bucket int, doc_id long, copy long, shard int, at long, n long").repartitionById(buckets, "bucket").mapInArrow(index, "bucket int, doc_id long, copy long")
    common.staged(keys, "keys", scope)
    keys_path = common._STAGED[scope][-1]
    wide = 4 if common.encoder(tokenizer, keeps_space).kind.itemsize == 4 else 2
    manifest = {"docs": n_docs, "shards": shards, "buckets": buckets, "tokens": int(total), "starts": starts.tolist(), "bytes_per_id": wide, "keys": keys_path}
    _put(f"{path}/manifest.json", json.dumps(manifest).encode())
    return manifest


def load_bucket(path: str, bucket: int) -> tuple[list[np.ndarray], np.ndarray]:
    fs, p = common.open_fs(f"{path}/index-{bucket:06d}.npz")
    with fs.open_input_file(p) as f, np.load(io.BytesIO(f.read())) as z:
        sizes, bits = z["sizes"], np.unpackbits(z["bits"]).astype(bool)
        ends = np.cumsum(sizes)
        return [bits[e - s : e] for s, e in zip(sizes, ends, strict=True)], z["table"]


def lookup(path: str, manifest: dict, doc_id: int, copy: int = 0) -> np.ndarray | None:
    """The ids of one document by key, or None: one bucket and one range of bytes are read."""
    if not manifest["docs"]:
        return None
    key = key_hash(np.array([doc_id]), np.array([copy]))
    maps, rows = load_bucket(path, int(key[0] % np.uint64(manifest["buckets"])))
    slot = find_slots(maps, key)[0]
    if slot < 0 or rows["print"][slot] != fingerprint(key)[0]:
        return None
    width = manifest["bytes_per_id"]
    fs, p = common.open_fs(f"{path}/shard-{rows['shard'][slot]:06d}.bin")
    with fs.open_input_file(p) as f:
        return np.frombuffer(f.read_at(int(rows["n"][slot]) * width, int(rows["at"][slot]) * width), f"<u{width}")


def read_token_files(keys: DataFrame, path: str, manifest: dict) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids) for the keys (bucket, doc_id, copy) that the index holds; others are left out.

    Keys meet their bucket, then their shard; each shard is read in order of offsets.
    """
    buckets, shards, width, starts = manifest["buckets"], manifest["shards"], manifest["bytes_per_id"], np.array(manifest["starts"], np.int64)

    def find(batches):
        from evidra.llm import token_files as t

        held: dict = {}
        for b in common.given(batches):
            bucket, doc, copy = (b.column(k).to_numpy() for k in ("bucket", "doc_id", "copy"))
            for k in np.unique(bucket).tolist():
                if k not in held:
                    held = {k: t.load_bucket(path, k)}
                maps, rows = held[k]
                own = bucket == k
                keys = t.key_hash(doc[own], copy[own])
                slot = t.find_slots(maps, keys)
                there = (slot >= 0) & (rows["print"][slot] == t.fingerprint(keys))
                hit = rows[slot[there]]
                yield pa.record_batch([pa.array(doc[own][there]), pa.array(copy[own][there]), pa.array(hit["shard"].astype(np.int32)), pa.array(hit["at"].astype(np.int64)), pa.array(hit["n"].astype(np.int64))], names=["doc_id", "copy", "shard", "at", "n"])

    def read(batches):
        from evidra.llm import token_files as t

        shard, f = -1, None
        for b in common.given(batches):
            out = []
            for s, at, n in zip(*(b.column(k).to_pylist() for k in ("shard", "at", "n")), strict=True):
                if s != shard:
                    if f is not None:
                        f.close()
                    fs, p = t.common.open_fs(f"{path}/shard-{s:06d}.bin")
                    shard, f = s, fs.open_input_file(p)
                out.append(f.read_at(n * width, at * width))
            start = starts[b.column("shard").to_numpy()] + b.column("at").to_numpy() if out else np.zeros(0, np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("copy"), pa.array(start), b.column("n"), pa.array(out, pa.binary())], names=["doc_id", "copy", "start", "n_tokens", "ids"])
        if f is not None:
            f.close()

    return (
        keys.repartitionById(buckets, "bucket").mapInArrow(find, "doc_id long, copy long, shard int, at long, n long")
        .repartitionById(shards, "shard").sortWithinPartitions("shard", "at").mapInArrow(read, "doc_id long, copy long, start long, n_tokens long, ids binary")
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.new_dir(spark, "tokens")
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    width = manifest["bytes_per_id"]

    def digest(batches):
        for b in common.given(batches):
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
            doc = pa.array([None if d == NO_ID else d for d in b.column("doc_id").to_pylist()], pa.int64())
            yield pa.record_batch([doc, b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    keys = spark.read.schema("bucket int, doc_id long, copy long").parquet(manifest["keys"])
    return read_token_files(keys, path, manifest).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
