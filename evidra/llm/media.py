"""Media columns: ISO base media containers (MP4, MOV, 3GP, HEIF files).

`media_columns` walks the nested boxes of a container, decodes the sample
tables of each track (stsd, stts, stss, stsc, stsz or stz2, stco or co64) and of
its fragments (trex, tfhd, trun), and returns codec, duration and keyframe byte
ranges of every track; those of the first video track, or else of the first one,
stand beside the list.  Sample data is never decoded; the ranges say where it lies.
Every count is held against the bytes of its box, and nesting has a limit, so a
broken or hostile file gives an error, not a failed task.

`store_text` is the writer used for texts: the UTF-8 bytes, padded with zeros
to a positive multiple of 64, become 8-bit samples of one uncompressed audio
track, in frames of 64 and chunks of 16 frames; the first frame of each chunk
is a sync sample.

Nulls: a null text is empty (one frame of zeros); a null or broken container
gives null columns and the reason in ``error``; of ties the first track counts.
A long text is one container; a file of many samples needs some 30 bytes for each.
A column named media_info is replaced.  Repeated rows give equal
values.  An empty table gives no rows.  Extra columns are kept by
`media_columns` and ignored by `store_text`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed by the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
FRAME, FRAMES_IN_CHUNK, RATE = 64, 16, 8000
DEPTH = 32
_RANGES = "array<struct<offset:long,length:long>>"
_TRACK = f"struct<track_id:long,handler:string,codec:string,timescale:long,duration:double,samples:long,sample_bytes:long,keyframes:{_RANGES}>"
MEDIA = f"codec string, timescale long, duration double, samples long, sample_bytes long, keyframes {_RANGES}, tracks array<{_TRACK}>, error string"


# --------------------------------------------------------------------- writing


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def container(payload: bytes) -> bytes:
    """A container whose only track has ``payload`` (a multiple of 64 bytes) as 8-bit samples."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_IN_CHUNK)
    rest = frames - (chunks - 1) * FRAMES_IN_CHUNK
    runs = [(1, FRAMES_IN_CHUNK, 1)] * (chunks > 1 or rest == FRAMES_IN_CHUNK) + [(chunks, rest, 1)] * (rest != FRAMES_IN_CHUNK)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.uint64) * np.uint64(FRAME * FRAMES_IN_CHUNK)
        big = first + len(payload) > 0xFFFFFFFF
        where = _full(b"co64" if big else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if big else ">u4").tobytes())
        sync = np.arange(chunks) * FRAMES_IN_CHUNK + 1
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        tables = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, frames, FRAME)), _full(b"stss", struct.pack(">I", chunks), sync.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), _full(b"stsz", struct.pack(">II", FRAME, frames)), where,
        )
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"text\0"), _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables))
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        movie = _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, len(payload)), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, media))

    size = len(moov(0))
    return head + moov(len(head) + size + 8) + _box(b"mdat", payload)


# --------------------------------------------------------------------- reading


def boxes(data):
    """(path, start, first byte of the body, end) of every box, outer ones first."""
    todo = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        while start + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, start)
            body = start + 8
            if size == 1:
                (size,) = struct.unpack_from(">Q", data, body)
                body += 8
            elif size == 0:
                size = end - start
            stop = start + size
            if size < body - start or stop > end:
                raise ValueError(f"box {kind!r} at {start} does not fit")
            yield (*path, kind), start, body, stop
            if kind in CONTAINERS:
                if len(path) >= DEPTH:
                    raise ValueError(f"boxes are nested more than {DEPTH} deep")
                todo.append((stop, end, path))
                start, end, path = body, stop, (*path, kind)
            else:
                start = stop


def _ints(data, at: int, stop: int, n: int, kind: str) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > stop:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _counted(data, box: tuple, kind: str = ">u4", width: int = 1) -> np.ndarray:
    """The rows of a table that follow their number."""
    body, stop = box
    n = struct.unpack_from(">I", data, body + 4)[0]
    return _ints(data, body + 8, stop, n * width, kind).reshape(n, width)


def _sizes(data, found: dict, n_held: int) -> np.ndarray:
    kind = b"stsz" if b"stsz" in found else b"stz2"
    body, stop = found[kind]
    unit, n = struct.unpack_from(">II", data, body + 4)
    if n != n_held or kind == b"stsz" and unit * n > len(data):
        raise ValueError(f"chunks hold {n_held} samples of {n}, in {len(data)} bytes")
    if kind == b"stsz":
        return np.full(n, unit, np.int64) if unit else _ints(data, body + 12, stop, n, ">u4")
    bits = unit & 255
    if bits not in (4, 8, 16):
        raise ValueError(f"sizes of {bits} bits")
    if bits == 4:
        h = _ints(data, body + 12, stop, (n + 1) // 2, "u1")
        return np.stack([h >> 4, h & 15], 1).ravel()[:n]
    return _ints(data, body + 12, stop, n, ">u2" if bits == 16 else "u1")


def _one_track(data, found: dict) -> dict:
    """A track from the boxes below its trak."""
    body, _ = found[b"mdhd"]
    wide = data[body] == 1
    scale, length = struct.unpack_from(">IQ" if wide else ">II", data, body + (20 if wide else 12))
    number = struct.unpack_from(">I", data, found[b"tkhd"][0] + (20 if data[found[b"tkhd"][0]] == 1 else 12))[0] if b"tkhd" in found else 0
    name = lambda kind, at: bytes(data[found[kind][0] + at : found[kind][0] + at + 4]).decode("latin-1") if kind in found else ""
    out = {"track_id": number, "handler": name(b"hdlr", 8), "codec": name(b"stsd", 12), "timescale": scale}
    runs, kind = _counted(data, found[b"stsc"], width=3), b"stco" if b"stco" in found else b"co64"
    chunks = _counted(data, found[kind], ">u4" if kind == b"stco" else ">u8").ravel()
    if len(runs) and (runs[0, 0] != 1 or runs[-1, 0] > len(chunks)):
        raise ValueError("runs of chunks do not fit the chunks")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, np.int64)
    size = _sizes(data, found, int(per_chunk.sum()))
    n = len(size)
    first = np.concatenate([[0], np.cumsum(per_chunk)[:-1]]).astype(np.int64)
    within = np.cumsum(size) - size
    offset = np.repeat(chunks[: len(per_chunk)], per_chunk) + within - np.repeat(within[first[per_chunk > 0]], per_chunk[per_chunk > 0]) if n else size
    if n and (offset.min() < 0 or (offset + size).max() > len(data)):
        raise ValueError("a sample lies behind the end")
    times = _counted(data, found[b"stts"], width=2) if b"stts" in found else np.zeros((0, 2), np.int64)
    key = np.ones(n, bool)
    if b"stss" in found:
        at = _counted(data, found[b"stss"]).ravel()
        if len(at) and (at.min() < 1 or at.max() > n):
            raise ValueError("a sync sample that does not exist")
        key[:] = False
        key[at - 1] = True
    ticks = int((times[:, 0] * times[:, 1]).sum()) if len(times) else length
    return out | {"ticks": ticks, "offset": offset, "size": size, "key": key}


def _fragment(data, moof: int, head: tuple, truns: list[tuple], defaults: dict) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(track, ticks, offset, size, key) of the samples of one traf."""
    body, _ = head
    flags, track = struct.unpack_from(">II", data, body)
    at, base = body + 8, moof
    if flags & 1:
        (base,) = struct.unpack_from(">Q", data, at)
        at += 8
    at += 4 if flags & 2 else 0
    duration, length, mark = defaults.get(track, (0, 0, 0))
    values = [duration, length, mark]
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            (values[k],) = struct.unpack_from(">I", data, at)
            at += 4
    ticks, parts, place = 0, [], base
    for b, stop in truns:
        flags, n = struct.unpack_from(">II", data, b)
        at, first = b + 8, None
        if flags & 1:
            place = base + struct.unpack_from(">i", data, at)[0]
            at += 4
        if flags & 4:
            (first,) = struct.unpack_from(">I", data, at)
            at += 4
        named = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if not named and n * max(1, values[1]) > len(data):
            raise ValueError("more samples than bytes")
        rows = _ints(data, at, stop, n * len(named), ">u4").reshape(n, len(named))
        column = lambda bit, default: rows[:, named.index(bit)] if bit in named else np.full(n, default, np.int64)  # noqa: E731, B023
        size, marks = column(0x200, values[1]), column(0x400, values[2]).copy()
        if first is not None and n:
            marks[0] = first
        ticks += int(column(0x100, values[0]).sum())
        offset = place + np.cumsum(size) - size
        if n and (offset.min() < 0 or (offset + size).max() > len(data)):
            raise ValueError("a sample lies behind the end")
        place += int(size.sum())
        parts.append((offset, size, marks & 0x10000 == 0))
    offset, size, key = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    return track, ticks, offset, size, key


def tracks(blob: bytes) -> list[dict]:
    """track_id, handler, codec, timescale, ticks and, for each sample, offset, length and whether it is a keyframe, of every track."""
    data, of_tracks, fragments, defaults, moof = memoryview(blob), [], [], {}, 0
    for path, start, body, stop in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            of_tracks.append({})
        elif b"trak" in path:
            of_tracks[-1].setdefault(kind, (body, stop))
        elif kind == b"moof":
            moof = start
        elif kind == b"trex":
            _, track, _, duration, size, flags = struct.unpack_from(">6I", data, body)
            defaults[track] = duration, size, flags
        elif kind == b"tfhd":
            fragments.append((moof, (body, stop), []))
        elif kind == b"trun" and fragments:
            fragments[-1][2].append((body, stop))
    out = [_one_track(data, t) for t in of_tracks if b"mdhd" in t and b"stsc" in t and {b"stsz", b"stz2"} & set(t) and {b"stco", b"co64"} & set(t)]
    by = {t["track_id"]: t for t in reversed(out)}
    for f in fragments:
        track, ticks, *samples = _fragment(data, *f, defaults)
        if track not in by:
            raise ValueError(f"a fragment of the unknown track {track}")
        t = by[track]
        t["ticks"] += ticks
        for name, more in zip(("offset", "size", "key"), samples, strict=True):
            t[name] = np.concatenate([t[name], more])
    if not out:
        raise ValueError("no track with a sample table")
    for t in out:
        t["duration"] = t["ticks"] / t["timescale"] if t["timescale"] else 0.0
    return out


def sample_table(blob: bytes) -> dict:
    """The first video track, or else the first one."""
    got = tracks(blob)
    return next((t for t in got if t["handler"] == "vide"), got[0])


def track_bytes(blob: bytes, t: dict) -> bytes:
    """The samples of a track in order; neighbours in the file are read together."""
    off, size = t["offset"], t["size"]
    if not len(off):
        return b""
    breaks = np.flatnonzero(off[1:] != off[:-1] + size[:-1]) + 1
    a, z = np.append(0, breaks), np.append(breaks, len(off))
    return b"".join(blob[off[i] : off[j - 1] + size[j - 1]] for i, j in zip(a, z, strict=True))


def describe(blob: bytes | None) -> dict:
    """The media columns of one container."""
    empty = dict.fromkeys(("codec", "timescale", "duration", "samples", "sample_bytes", "keyframes", "tracks", "error"))
    if blob is None:
        return empty | {"error": "null"}
    try:
        got = tracks(blob)
    except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
        return empty | {"error": str(e)[:200] or type(e).__name__}

    def shown(t: dict) -> dict:
        frames = [{"offset": int(o), "length": int(s)} for o, s in zip(t["offset"][t["key"]], t["size"][t["key"]], strict=True)]
        return {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["size"]), "sample_bytes": int(t["size"].sum()), "keyframes": frames}

    whole = [{"track_id": t["track_id"], "handler": t["handler"], **shown(t)} for t in got]
    best = next((k for k, t in enumerate(got) if t["handler"] == "vide"), 0)
    return empty | {k: v for k, v in whole[best].items() if k in empty} | {"tracks": whole}


def media_columns(df: DataFrame, content: str = "media") -> DataFrame:
    """``df`` with a struct column ``media_info`` (codec, timescale, duration, samples, sample_bytes, keyframes, tracks, error)."""
    common.ship(df.sparkSession)

    @F.pandas_udf(MEDIA)
    def info(blobs: pd.Series) -> pd.DataFrame:
        from evidra.llm import media as m

        return pd.DataFrame([m.describe(None if b is None else bytes(b)) for b in blobs], columns=["codec", "timescale", "duration", "samples", "sample_bytes", "keyframes", "tracks", "error"])

    return df.withColumn("media_info", info(content))


def store_text(docs: DataFrame, scope: str = "") -> DataFrame:
    """(doc_id, n_bytes, media): every text in a container, stored in the shared folder and read back."""
    common.ship(docs.sparkSession)

    def run(batches):
        from evidra.llm import common as c
        from evidra.llm import media as m

        for b in common.given(batches):
            data, off = c.column_bytes(b.column("text"))
            for i, j in c.blocks(off):
                raw = [data[off[k] : off[k + 1]].tobytes() for k in range(i, j)]
                out = [m.container(x + bytes(-len(x) % m.FRAME if x else m.FRAME)) for x in raw]
                yield pa.record_batch([b.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.staged(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", scope, compression="zstd")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_text(common.table(spark, sf_dir, "documents"))

    def run(batches):
        from evidra.llm import media as m

        for b in common.given(batches):
            rows, frames = [], []
            for blob in b.column("media").to_pylist():
                t = m.sample_table(blob)
                payload = m.track_bytes(blob, t)
                at, size = t["offset"][t["key"]], t["size"][t["key"]]
                feature = f"codec={t['codec']};rate={t['timescale']};duration={t['duration']:.6f};samples={len(t['size'])};keyframes={len(at)};first={at[0]}+{size[0]};last={at[-1]}+{size[-1]}"
                frames.append((at, size))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            cols = [pa.array(x) for x in zip(*rows, strict=True)] if rows else []
            if rows:
                ranges = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*frames, strict=True)], names=["offset", "length"])
                ranges = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x, _ in frames]), pa.int32()), ranges)
                yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *cols, ranges], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframes"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<offset:long,length:long>>")
