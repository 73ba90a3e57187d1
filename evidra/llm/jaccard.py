"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds the hashes of its distinct word n-grams.  Two sets of
Jaccard similarity >= t whose smaller one has at most ``hi`` members differ in
at most D = floor((1 - t) / t * hi) members.  Sets are put into size bands,
and each band cuts the universe of hashes into segments of equal hash range.
A segment has a budget: 1, its subset is indexed and must agree exactly; or 2,
its one-deletion neighbourhood is indexed too and it may differ by a member.
Budgets that sum to more than D leave no similar pair without an agreement.
Which budget a band uses is chosen by cost: keys written, and agreements that
are expected by chance among the sets of the band.  Each plan has a few
segments to spare, so segments with fewer members than their budget, which agree by
chance, are skipped by every set that has no more of them than can be spared; a pair
still agrees elsewhere.

A set is indexed in its own band, and in every band below that holds a set it
could be similar to.  Keys meet in buckets of bounded size; the sets that share
a key are a group, and each distinct group is kept once.  Passages that many
texts share make groups of unlike sets, so a group is not linked as such: every
two of its sets are compared by sketches (members counted by hash, in an eighth
to a quarter as many counts as members, which differ by no more than the sets
do, so no link is lost).  What the sketches connect forms clusters.  Clusters
are cut into size classes and blocks of bounded size, and verified in pairs of
blocks whose sizes allow a link: each task compares two blocks exactly and
returns only a spanning forest of the links it found, so no list of pairs is
ever written.  Equal sets are one class from the start; copies cost one row each.

Limits: a bucket needs about 40 bytes for each distinct set that shares its
key; groups and clusters of k sets in one size class are compared in blocks,
which reads k / MOST_IN_BLOCK times their sketches or sets.  A text longer than
a block is walked in windows: its set is held whole, about 40 bytes a word.

Nulls: a null or empty text, or one without words, has an empty set and is
linked with nothing; a null doc_id takes part, but is no component's name.
Texts of fewer than ``words_in_gram`` words have one member, the whole
sequence.  Repeated rows are copies of each other.  An empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RATIO = 1.5
CLASS_RATIO = 1.1
LEAST_IN_BLOCK, MOST_IN_BLOCK = 300, 1000
MEMBERS_IN_BLOCK = 1_000_000
KEYS_PER_BUCKET = 4_000_000
#: Groups of more sets than this are walked set by set instead of pair by pair.
PAIRED = 32


# ------------------------------------------------------------------------- sets


def gram_set(h: np.ndarray, words_in_gram: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of one text of word hashes."""
    n = len(h) - words_in_gram + 1
    if n <= 0:
        gram = np.zeros(min(len(h), 1), np.uint64)
        for w in h:
            gram = common.mix(gram + w)
        return gram
    gram = np.zeros(n, np.uint64)
    for q in range(words_in_gram):
        gram = common.mix(gram + h[q : q + n])
    return np.unique(gram)


def sets_of(col: pa.Array, words_in_gram: int, powers: list) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, off = common.column_bytes(col)
    out = []
    for i, j in common.blocks(off):
        _, _, doc, h = common.hashed_words(data[off[i] : off[j]], off[i : j + 1] - off[i], common.NOT_SPACE, powers)
        if j - i == 1:
            out.append(gram_set(h, words_in_gram))
            continue
        bounds = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
        size = len(h)
        gram = np.zeros(size, np.uint64)  # of the n-gram that starts at each word of the block
        for q in range(min(words_in_gram, size)):
            gram[: size - q] = common.mix(gram[: size - q] + h[q:])
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            n = z - a - words_in_gram + 1
            if n > 0:
                g = np.sort(gram[a : a + n])
                out.append(g[np.append(True, g[1:] != g[:-1])])
            else:
                out.append(gram_set(h[a:z], words_in_gram))
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(common.mix(common.mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Members of a set counted by hash, at most 255: the counts of two sets differ by no more than the sets do."""
    bins = 1 << min(13, max(4, (len(s) // 8).bit_length()))
    return np.minimum(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


class Sketches:
    """Sketches of different lengths in one array; a longer one folds to a shorter one by adding its parts."""

    def __init__(self, col):
        col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_binary())
        self.flat = np.frombuffer(col.buffers()[2], np.uint8) if len(col) else np.zeros(0, np.uint8)
        self.base = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        self.bins = np.diff(self.base)

    def folded(self, rows: np.ndarray, bins: int) -> np.ndarray:
        """The counts of some rows in ``bins`` bins each."""
        out = np.empty((len(rows), bins), np.int16)
        long = self.bins[rows]
        for b in np.unique(long).tolist():
            at = np.flatnonzero(long == b)
            out[at] = self.flat[self.base[rows[at], None] + np.arange(b)].reshape(len(at), b // bins, bins).sum(1, dtype=np.int16)
        return out

    def close(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sketches of the pairs (x, y) of rows, with ``n`` members, allow a link."""
        ok = percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y])
        at = np.flatnonzero(ok)
        bins = np.minimum(self.bins[x[at]], self.bins[y[at]])
        for b in np.unique(bins).tolist():
            these = at[bins == b]
            for s in range(0, len(these), (1 << 21) // b):
                some = these[s : s + (1 << 21) // b]
                apart = np.abs(self.folded(x[some], b) - self.folded(y[some], b)).sum(1, dtype=np.int64)
                ok[some] = (100 + percent) * apart <= (100 - percent) * (n[x[some]] + n[y[some]])
        return ok


def text_sets(docs: DataFrame, words_in_gram: int, scope: str = "") -> DataFrame:
    """(doc_id, n, sid, sketch): size, name and sketch of each document's set (the last two null if empty); staged."""
    common.ship(docs.sparkSession)

    def run(batches):
        from evidra.llm import jaccard as j

        powers: list = []
        for b in j.common.slices(batches):
            sets = j.sets_of(b.column("text"), words_in_gram, powers)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([j.set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([j.sketch(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "sid", "sketch"])

    return common.staged(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sid long, sketch binary"), "sets", scope)


# ----------------------------------------------------------------- size bands


def band_of(size: int) -> int:
    return int(math.floor(math.log(size) / math.log(RATIO) + 1e-9))


def band_top(band: int) -> int:
    """The largest size in a band."""
    return math.ceil(RATIO ** (band + 1) - 1e-9) - 1


class Plan:
    """How a band is indexed: number of segments, budget of each, and how many may be skipped."""

    def __init__(self, band: int, percent: int, sets: int):
        hi, lo = band_top(band), band_top(band - 1) + 1
        self.band, self.most = band, (100 - percent) * hi // percent  # members in which a pair may differ
        loose = (self.most + 2) // 2 + (self.most > 1)
        # More segments to spare cost keys, and leave fewer sets that must index their empty segments.
        plans = []
        for extra in (0.08, 0.12, 0.16, 0.2, 0.25, 0.3):
            exact = math.ceil((self.most + 1) * (1 + extra)) + 2
            mean, spare = lo / exact, exact - self.most - 1
            thin = exact * math.exp(-mean)  # expected number of empty segments
            over = 1 - sum(math.exp(k * math.log(thin) - thin - math.lgamma(k + 1)) for k in range(spare + 1))
            by_chance = sets * over * exact * math.exp(-2 * mean)  # agreements of a set that cannot skip all empty segments
            plans.append((exact + by_chance, exact, spare))
        cost, exact, spare = min(plans)
        self.budget = 1 if cost < hi + loose else 2
        self.n = exact if self.budget == 1 else loose
        # After skipping s segments the budgets left must exceed ``most``.
        self.spare = spare if self.budget == 1 else self.n - (self.most + 2) // 2

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The keys of a set in this band."""
        if self.most == 0:
            return np.zeros(0, np.uint64)  # only equal sets are similar
        n = np.uint64(self.n)
        seg = (((s >> np.uint64(32)) * n) >> np.uint64(32)).astype(np.int64)  # ascending: s is sorted
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        m = common.mix(s)
        sums, count = np.zeros(self.n, np.uint64), np.zeros(self.n, np.int64)
        sums[seg[first]] = np.add.reduceat(m, first)
        count[seg[first]] = np.diff(np.append(first, len(s)))
        salt = common.mix(np.arange(self.n, dtype=np.uint64) + np.uint64(self.band << 32))
        thin = count < self.budget
        keep = ~thin if thin.sum() <= self.spare else np.ones(self.n, bool)
        out = common.mix(sums[keep] + salt[keep])
        if self.budget == 2:
            own = keep[seg]
            out = np.concatenate([out, common.mix(sums[seg[own]] - m[own] + salt[seg[own]])])
        return out


def plans_of(size: int, percent: int) -> list[int]:
    """The bands in which a set is indexed: its own, and those below that hold a set it could be similar to."""
    b = band_of(size)
    out = [b]
    while (top := band_top(b - 1)) >= 1 and percent * size <= 100 * top:
        b -= 1
        out.append(b)
    return out


# ------------------------------------------------------------------ components


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, node) for each node of the edges: stars that connect what the edges connect, each with its centre."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, label[x], label[y])
        np.minimum.at(new, label[y], label[x])
        new = new[new]
        if (new == label).all():
            return names[label], names
        label = new


def stars(batches, most: int = 1_000_000):
    """The edges of one task as stars; holds a bounded number of them."""
    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += len(a[-1])
        if held > most:
            x, y = contracted(np.concatenate(a), np.concatenate(b))
            if len(x) > most // 2:
                yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])
                x, y = x[:0], y[:0]
            a, b, held = [x], [y], len(x)
    if held:
        x, y = contracted(np.concatenate(a), np.concatenate(b))
        yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])


def components(edges: DataFrame, parts: int, scope: str = "") -> DataFrame:
    """(node, label) for edges (a, b): label is the smallest node of the component.

    Each task turns its edges into stars.  A node takes the smallest of its
    centres; its other centres are linked with that one, and these links are
    the edges of the next level, which has centres only.  Levels grow with the
    logarithm of the number of nodes, and shrink fast.
    """
    common.ship(edges.sparkSession)

    def run(batches):
        from evidra.llm import jaccard as j

        yield from j.stars(j.common.given(batches))

    # Written first, so that no task runs the Python of two steps at once.
    levels, w, edges = [], Window.partitionBy("b"), common.staged(edges, "edges", scope)
    while True:
        named = edges.mapInArrow(run, "a long, b long").withColumns({"m": F.min("a").over(w), "first": F.row_number().over(w.orderBy("a")) == 1})
        named = common.staged(named.where("first or a <> m"), "stars", scope, parts)
        levels.append(named.where("first").select(F.col("b").alias("node"), F.col("m").alias("label")))
        edges = named.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        if edges.count() == 0:
            break
    labels = levels.pop()
    while levels:
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = common.staged(levels.pop().join(above, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels", scope, parts)
    return labels


# --------------------------------------------------------------------- the join


def groups(docs: DataFrame, sets: DataFrame, words_in_gram: int, percent: int, scope: str = "") -> DataFrame:
    """(gid, k, sid): the members of every distinct group of k sets that share a key; each similar pair is in one group at least."""
    common.ship(docs.sparkSession)
    # One row for each size, then for each band: a few dozen.
    sizes = sets.where("n > 0").select(F.floor(F.log("n") / math.log(RATIO) + 1e-9).cast("int").alias("band"), "n").groupBy("band").agg(F.count("*").alias("sets"), F.sum("n").alias("n")).collect()
    count = {r.band: r.sets for r in sizes}
    plans = {b: Plan(b, percent, count.get(b, 0) + count.get(b + 1, 0)) for b in range(-1, max(count, default=0) + 1)}
    expected = sum(r.n * plans[r.band].n / band_top(r.band) * 2 if plans[r.band].budget == 1 else r.n * 2 for r in sizes)
    buckets = max(16, math.ceil(expected / KEYS_PER_BUCKET))

    def emit(batches):
        """For each bucket the keys of some sets, 32 bits of each, and whose they are: a place in the list of names beside them."""
        from evidra.llm import jaccard as j

        powers, seen = [], set()
        for b in j.common.slices(batches):
            keys, which, names = [], [], []
            for s in j.sets_of(b.column("text"), words_in_gram, powers):
                if len(s) and (sid := j.set_id(s)) not in seen:
                    seen.add(sid)
                    for band in j.plans_of(len(s), percent):
                        keys.append(plans[band].keys(s))
                        which.append(np.full(len(keys[-1]), len(names), np.int16))
                    names.append(sid)
            if len(seen) > 200_000:
                seen.clear()
            if not any(map(len, keys)):
                continue
            keys, which, names = np.concatenate(keys), np.concatenate(which), np.array(names, np.int64)
            # A key is a fraction of the bucket space: the bucket, and 32 bits below it.
            top = (keys >> np.uint64(32)) * np.uint64(buckets)
            place = (keys & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
            place += top & np.uint64(0xFFFFFFFF)
            bucket = ((top >> np.uint64(32)) + (place >> np.uint64(32))).astype(np.int32)
            low = place.astype(np.uint32)
            order = np.lexsort((which, bucket))
            bucket, low, which = bucket[order], low[order], which[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rows = []
            for a, z in zip(first, np.append(first[1:], len(keys)), strict=True):
                used, at = np.unique(which[a:z], return_inverse=True)
                rows.append((low[a:z].tobytes(), at.astype(np.int16).tobytes(), names[used].tobytes()))
            yield pa.record_batch([pa.array(bucket[first]), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=["bucket", "keys", "which", "names"])

    def agree(batches):
        from evidra.llm import jaccard as j

        keys, which, names, held = [], [], [], 0
        for b in j.common.given(batches):
            for k, w, n in zip(b.column("keys"), b.column("which"), b.column("names"), strict=True):
                keys.append(np.frombuffer(k.as_buffer(), np.uint32))
                which.append(np.frombuffer(w.as_buffer(), np.int16).astype(np.int32) + held)
                names.append(np.frombuffer(n.as_buffer(), np.int64))
                held += len(names[-1])
        if keys:
            yield from j.shared(np.concatenate(keys), np.concatenate(which), np.concatenate(names))

    keys = docs.select("text").mapInArrow(emit, "bucket int, keys binary, which binary, names binary").repartitionById(buckets, "bucket")
    return common.staged(keys.mapInArrow(agree, "gid long, k int, sid long").distinct(), "groups", scope)


def shared(keys: np.ndarray, which: np.ndarray, names: np.ndarray):
    """(gid, k, sid) batches: the members of each distinct group of sets that share a key; ``which``: the place of each key's set in ``names``."""
    sid, place = np.unique(names, return_inverse=True)
    both = keys.astype(np.uint64) << np.uint64(32) | place[which].astype(np.uint64)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    starts = np.append(True, both[1:] >> np.uint64(32) != both[:-1] >> np.uint64(32))[: len(both)]
    alone = starts & np.append(starts[1:], True)[: len(both)]
    both, starts = both[~alone], starts[~alone]
    if not len(both):
        return
    sids, start = sid[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)], np.flatnonzero(starts)
    size = np.diff(np.append(start, len(both)))
    gid = common.mix(np.add.reduceat(common.mix(sids.view(np.uint64)), start)).view(np.int64)
    first = np.sort(np.unique(gid, return_index=True)[1])
    for s in range(0, len(first), 20_000):
        g = first[s : s + 20_000]
        k = size[g]
        at = np.repeat(start[g] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        yield pa.record_batch([pa.array(np.repeat(gid[g], k)), pa.array(np.repeat(k, k).astype(np.int32)), pa.array(sids[at])], names=["gid", "k", "sid"])


def plausible_groups(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the sets that sketches connect inside their groups; whole groups of rows (gid, sid, n, sketch)."""
    order = np.argsort(rows.column("gid").to_numpy(), kind="stable")
    gid, sid, n = (rows.column(c).to_numpy()[order] for c in ("gid", "sid", "n"))
    counts = Sketches(rows.column("sketch").combine_chunks().take(pa.array(order)))
    start = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
    size = np.diff(np.append(start, len(gid)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(size[size <= PAIRED]).tolist():
        s = start[size == k]
        x, y = np.triu_indices(k, 1)
        x, y = (s[:, None] + x).ravel(), (s[:, None] + y).ravel()
        ok = counts.close(x, y, n, percent)
        a.append(sid[x[ok]])
        b.append(sid[y[ok]])
    for s, k in zip(start[size > PAIRED].tolist(), size[size > PAIRED].tolist(), strict=True):
        at = np.arange(s, s + k)
        c, m = counts.folded(at, int(counts.bins[at].min())), n[at]
        left = np.arange(k)
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                fits = np.flatnonzero(percent * np.maximum(m[left], m[x]) <= 100 * np.minimum(m[left], m[x]))
                apart = np.abs(c[left[fits]] - c[x]).sum(1, dtype=np.int64)
                fits = fits[(100 + percent) * apart <= (100 - percent) * (m[left[fits]] + m[x])]
                found = left[fits]
                left = np.delete(left, fits)
                a.append(np.full(len(found), sid[s + x]))
                b.append(sid[s + found])
                todo += found.tolist()
    return contracted(np.concatenate(a), np.concatenate(b))


def distinct_rows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, name, side) of the distinct sets of each side; a repeated row counts once."""
    side = rows.column("side").to_numpy()
    order = np.lexsort((rows.column("sid").to_numpy(), side))
    sid, side = rows.column("sid").to_numpy()[order], side[order]
    new = np.append(True, (sid[1:] != sid[:-1]) | (side[1:] != side[:-1]))
    return order[new], sid[new], side[new]


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a spanning forest of a symmetric matrix of neighbours."""
    new = np.ones(len(near), bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(len(near)):
        todo = [start] if new[start] else []
        new[start] = False
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & new)
            new[found] = False
            a.append(np.full(len(found), at))
            b.append(found)
            todo += found.tolist()
    return np.concatenate(a), np.concatenate(b)


def plausible(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sketches allow a link, as a forest that connects what all such pairs between two blocks (or within one) connect."""
    order, sid, side = distinct_rows(rows)
    counts = Sketches(rows.column("payload").combine_chunks().take(pa.array(order)))
    bins = min(256, int(counts.bins.min()))
    count = counts.folded(np.arange(len(sid)), bins)
    size = rows.column("n").to_numpy()[order]
    one = side[0] == side[-1]
    x = np.arange(len(sid)) if one else np.flatnonzero(side == side[0])
    y = x if one else np.flatnonzero(side != side[0])
    apart = np.zeros((len(x), len(y)), np.int32)
    for k in range(bins):
        apart += np.abs(np.subtract.outer(count[x, k], count[y, k]))
    ok = (100 + percent) * apart.astype(np.int64) <= (100 - percent) * np.add.outer(size[x], size[y])
    near = np.zeros((len(sid), len(sid)), bool)
    near[np.ix_(x, y)] = ok
    near[np.ix_(y, x)] |= ok.T
    a, b = spanning(near)
    return sid[a], sid[b]


def forest(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links between two blocks (or within one) connect; exact set comparison."""
    order, sid, side = distinct_rows(rows)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("payload").combine_chunks().take(pa.array(order))]
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    member = np.concatenate(sets)
    by = np.argsort(member, kind="stable")
    member, doc = member[by], doc[by]
    start = np.flatnonzero(np.append(True, member[1:] != member[:-1]))
    long = np.diff(np.append(start, len(member)))
    start, long = start[long > 1], long[long > 1]
    both = np.zeros(len(sets) * len(sets), np.int32)
    # Every later holder of a member with each earlier one, some members at a time.
    step = np.cumsum(long * (long - 1) // 2)
    at = 0
    while at < len(long):
        z = max(at + 1, int(np.searchsorted(step, (step[at - 1] if at else 0) + 500_000, "right")))
        for k in np.unique(long[at:z]).tolist():
            s = start[at:z][long[at:z] == k]
            held = doc[s[:, None] + np.arange(k)]
            x, y = np.triu_indices(k, 1)
            pair = (held[:, x] * len(sets) + held[:, y]).ravel()
            if len(pair) * 8 > len(both):
                np.add(both, np.bincount(pair, minlength=len(both)), out=both, casting="unsafe")
            else:
                np.add.at(both, pair, np.int32(1))
        at = z
    near = np.zeros((len(sets), len(sets)), bool)
    for x, shared in enumerate(both.reshape(len(sets), -1)):
        y = np.flatnonzero(shared)
        c = shared[y].astype(np.int64)
        y = y[(100 * c >= percent * (size[x] + size[y] - c)) & ((side[x] != side[y]) | (side[0] == side[-1]))]
        near[x, y] = near[y, x] = True
    a, b = spanning(near)
    return sid[a], sid[b]


def dealt(held: DataFrame, blocks: DataFrame, percent: int, parts: int, scope: str) -> DataFrame:
    """(label, i, j, side, sid, n, payload): each set of ``held`` with every block of its cluster whose sizes allow a link."""
    # Only classes at most ``reach`` apart hold similar sets: (class, block) with every (class, block) in reach.
    reach = math.ceil(math.log(100 / percent) / math.log(CLASS_RATIO) - 1e-9)
    near = blocks.select("label", "class", F.col("blocks").alias("own_blocks"), F.explode(F.sequence(F.col("class") - reach, F.col("class") + reach)).alias("other"))
    near = near.join(blocks.select("label", F.col("class").alias("other"), "blocks"), ["label", "other"]).groupBy("label", "class").agg(F.first("own_blocks").alias("own_blocks"), F.collect_list(F.struct("other", "blocks")).alias("near"))
    near = common.staged(near, "near", scope, parts)
    mine, theirs = F.struct(F.col("class").alias("c"), F.col("own").alias("b")), F.struct(F.col("x.other").alias("c"), F.col("with").alias("b"))
    return (
        held.join(near, ["label", "class"]).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("own_blocks")).cast("int"))
        .select("label", "class", "own", "sid", "n", "payload", F.explode("near").alias("x")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("x.blocks") - 1)))
        .select("label", F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), F.when(mine <= theirs, 0).otherwise(1).alias("side"), "sid", "n", "payload")
    )


def classed(members: DataFrame, block: int, parts: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """Members of clusters with a size class, 0 in clusters of at most a block; and the blocks of each class."""
    large = common.staged(members.groupBy("label").agg((F.ceil(F.greatest(F.count("*") / block, F.sum("n") / MEMBERS_IN_BLOCK)) > 1).alias("large")), "large", scope, parts)
    size_class = F.when(F.col("large"), F.floor(F.log("n") / math.log(CLASS_RATIO) + 1e-9).cast("int")).otherwise(0)
    out = common.staged(members.join(large, "label").withColumn("class", size_class), "members", scope, parts)
    blocks = out.groupBy("label", "class").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / MEMBERS_IN_BLOCK)).cast("int").alias("blocks"))
    return out, common.staged(blocks, "blocks", scope, parts)


def clusters_of(found: DataFrame, first: DataFrame, percent: int, parts: int, scope: str) -> DataFrame:
    """(node, label): what the sketches connect inside the groups ``found``; ``first``: (sid, n, sketch)."""
    named = found.join(first.select("sid", "n", "sketch"), "sid")

    def near(batches):
        from evidra.llm import jaccard as j

        held = list(j.common.given(batches))
        if held:
            a, b = j.plausible_groups(pa.Table.from_batches(held), percent)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def may_link(rows: pa.Table) -> pa.Table:
        from evidra.llm import jaccard as j

        a, b = j.plausible(rows, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # Whole groups in one task, some thousand rows of a few hundred bytes.
    small = common.parts_for(found.sparkSession, found.count(), 40_000)
    stars = named.where(F.col("k") <= MOST_IN_BLOCK).select("gid", "sid", "n", "sketch").repartition(small, "gid").mapInArrow(near, "a long, b long")
    large = found.where(F.col("k") > MOST_IN_BLOCK)
    if not large.isEmpty():
        members, blocks = classed(named.where(F.col("k") > MOST_IN_BLOCK).select(F.col("gid").alias("label"), "sid", "n", F.col("sketch").alias("payload")), MOST_IN_BLOCK, parts, scope)
        stars = stars.unionByName(dealt(members, blocks, percent, parts, scope).groupBy("label", "i", "j").applyInArrow(may_link, "a long, b long"))
    return components(stars, parts, scope)


def links(docs: DataFrame, sets: DataFrame, words_in_gram: int, percent: int, parts: int, scope: str = "") -> DataFrame:
    """(a, b): verified links between names of sets that connect all linked sets."""
    found = groups(docs, sets, words_in_gram, percent, scope)
    # One document of each set that is in a group; the text of those in a cluster is read again.
    first = sets.join(found.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("doc_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    first = common.staged(first, "first", scope, parts)
    clusters = clusters_of(found, first, percent, parts, scope)
    # A block is a 150th of the candidates, within bounds: its sets fit a task, and tasks are even.
    block = min(MOST_IN_BLOCK, max(LEAST_IN_BLOCK, clusters.count() // 150))
    members, blocks = classed(clusters.withColumnRenamed("node", "sid").join(first.select("sid", "doc_id", "n"), "sid"), block, parts, scope)

    def verify(rows: pa.Table) -> pa.Table:
        from evidra.llm import jaccard as j

        a, b = j.forest(rows, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    wanted = members.select("sid", "doc_id", "n", "label", "class")
    if wanted.count() <= 1_000_000:  # 40 bytes each
        wanted = F.broadcast(wanted)

    def again(batches):
        from evidra.llm import jaccard as j

        powers: list = []
        for b in j.common.slices(batches):
            sets = j.sets_of(b.column("text"), words_in_gram, powers)
            mine = [k for k, (s, sid) in enumerate(zip(sets, b.column("sid").to_pylist(), strict=True)) if len(s) and j.set_id(s) == sid]
            if mine:
                yield pa.record_batch([*(b.column(c).take(pa.array(mine)) for c in ("label", "class", "sid", "n")), pa.array([sets[k].tobytes() for k in mine], pa.binary())], names=["label", "class", "sid", "n", "payload"])

    held = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("text", "label", "class", "sid", "n").mapInArrow(again, "label long, class int, sid long, n long, payload binary")
    return dealt(held, blocks, percent, parts, scope).groupBy("label", "i", "j").applyInArrow(verify, "a long, b long")


def join(docs: DataFrame, words_in_gram: int = 5, percent: int = 80, scope: str = "") -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id): documents of one component are connected by links of Jaccard similarity >= percent / 100."""
    sets = text_sets(docs, words_in_gram, scope)
    parts = common.parts_for(docs.sparkSession, sets.count())
    found = components(links(docs, sets, words_in_gram, percent, parts, scope), parts, scope)
    least = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = common.staged(least.join(found.withColumnRenamed("node", "sid"), "sid", "left"), "named", scope, parts)
    roots = named.where("label is not null").groupBy("label").agg(F.min("least").alias("root"))
    final = common.staged(named.join(roots, "label", "left").select(F.col("sid").alias("set_id"), F.coalesce("root", "least").alias("component")), "final", scope, parts)
    return sets.withColumnRenamed("sid", "set_id").join(final, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "set_id", F.coalesce("component", "doc_id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")
