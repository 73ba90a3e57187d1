"""Fill-in-the-middle: a share of the texts is cut at two token ranks and written prefix, suffix, middle or suffix, prefix, middle.

A token is white space and the run after it (or white space at the end).  Each
text that is cut becomes an indexable skip list: the links of its lowest lane
are the tokens, those of each lane above span `FAN` links of the lane below, and
every link carries its widths in units (tokens), code points and bytes.  The
ranks of both cuts are reached from the top lane by adding up unit widths; the
other widths added on the way say where to cut.  A lane is dealt by position
rather than by coin, so the list is perfect and the same for each run.

The choices depend on the seed and the key alone.  No shuffle.  A task holds one
batch; a long text is read in windows of a megabyte, and its list takes 9 bytes
a token.

Nulls: a null text is an empty one: plain, no tokens, an empty output.  A null
key counts as an empty string under the seed.  Empty texts and texts with a
sentinel in them are plain.  Repeated rows are cut alike; an empty table gives
no rows.  Extra columns are kept; those named as a result are replaced, and
columns that start with ``_fim`` are not allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed by the contract: what starts the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FAN = 16
RESULTS = "n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Links in express lanes, each with its widths in (units, code points, bytes)."""

    def __init__(self, chars: np.ndarray, size: np.ndarray):
        # The lowest lane's links are one unit wide, which is not stored.
        self.lanes = [(None, chars, size)]
        units = np.ones(len(size), np.int64)
        while len(size) > FAN:
            at = np.arange(0, len(size), FAN)
            units, chars, size = (np.add.reduceat(x, at, dtype=np.int64) for x in (units, chars, size))
            self.lanes.append((units, chars, size))

    def find(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the unit of that rank; the number of all units is a rank too."""
        link = chars = size = 0
        for lane, (units, c, s) in enumerate(reversed(self.lanes)):
            link *= FAN if lane else 1
            while rank and link < len(s) and (width := 1 if units is None else int(units[link])) <= rank:
                rank, chars, size, link = rank - width, chars + int(c[link]), size + int(s[link]), link + 1
        return chars, size


def _ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, code points before it) of every token of a block of texts, in order; code points count from the block's start."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, chars, seen = [], [], 0
    closing = np.unique(off[1:][off[1:] > off[:-1]])
    for at in range(0, len(data), common.BLOCK_BYTES):
        part = data[at : at + common.BLOCK_BYTES + 1]
        full = common.NOT_SPACE[part]
        n = min(len(part), common.BLOCK_BYTES)
        cut = np.zeros(n, bool)
        cut[: len(part) - 1] = full[:-1] & ~full[1:]
        cut[closing[(closing > at) & (closing <= at + n)] - at - 1] = True
        to = np.flatnonzero(cut)
        points = np.cumsum((part[:n] & 0xC0) != 0x80, dtype=np.int32)
        ends.append(to + 1 + at)
        chars.append(seen + points[to].astype(np.int64))
        seen += int(points[-1])
    return np.concatenate(ends), np.concatenate(chars)


def _arranged(raw: bytes, form: str, a: int, b: int) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        return b"".join([p, raw[:a], s, raw[b:], m, raw[a:b]])
    return b"".join([s, raw[b:], p, raw[:a], m, raw[a:b]])


def transform(docs: DataFrame, key: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output; ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of those in the order spm."""
    common.ship(docs.sparkSession)
    names = [x.split()[0] for x in RESULTS.split(", ")]
    docs = docs.select(*[c for c in docs.columns if c not in names])
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | (h[2] % 100 >= rate)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(sentinel))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")

    def run(batches):
        from evidra.llm import common as c, fill_middle as own

        for b in c.given(batches):
            data, off = c.column_bytes(b.column("text"))
            forms, h1, h2 = (b.column(x).to_pylist() for x in ("_fim_form", "_fim_1", "_fim_2"))
            rows = []
            for i, j in c.blocks(off):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ends, chars = own._ends(part, at)
                first = np.searchsorted(ends, at, "right")
                for d in range(j - i):
                    lo, hi = first[d], first[d + 1]
                    form, raw, n = forms[i + d], part[at[d] : at[d + 1]].tobytes(), int(hi - lo)
                    if form == "plain":
                        rows.append((n, form, None, None, raw))
                        continue
                    before = int(chars[lo - 1]) if lo else 0
                    tokens = own.SkipList(np.diff(chars[lo:hi], prepend=before).astype(np.int32), np.diff(ends[lo:hi], prepend=at[d]).astype(np.int32))
                    (p, a), (m, z) = map(tokens.find, sorted((h1[i + d] % (n + 1), h2[i + d] % (n + 1))))
                    rows.append((n, form, p, m - p, own._arranged(raw, form, a, z)))
            kept = [b.column(x) for x in b.schema.names if not x.startswith("_fim")]
            n, form, p, m, out = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([*kept, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.binary()).view(pa.string())], names=[x for x in b.schema.names if not x.startswith("_fim")] + names)

    added = T.StructType([T.StructField(x.split()[0], T.StringType() if x.endswith("string") else T.LongType()) for x in RESULTS.split(", ")])
    return docs.select("*", form.alias("_fim_form"), h[0].alias("_fim_1"), h[1].alias("_fim_2")).mapInArrow(run, T.StructType(docs.schema.fields + added.fields))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made from. A cut text holds no sentinel, so the three that were added are the only ones."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
