"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each row of its table is one segment of
a few megabytes of text and holds, for every term of those documents, the term
itself and its ascending token positions.  Segments are built where the text
is read and stored in the shared folder, so building and searching need no
shuffle, and no frequent term meets in one task.

A phrase is searched in a segment by intersecting offset-adjusted position
lists, the rarest term of that segment first.  Terms that are missing end a
phrase at once.  Terms are looked up by hash and then compared byte by byte.
Proximity search finds the tokens at which all terms of a query lie within
its length plus a slop.

Queries are taken in blocks of bounded size; one block is answered in one
pass, several blocks are merged by document.

Nulls: a null text has no words; a null item text has no windows; a null
item_id is listed as an empty string.  Repeated documents are judged one by
one; rows of one item_id are one item.  Empty tables: no documents, no rows;
no benchmark, nothing is hit.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

INDEX = "segment long, doc_ids array<long>, doc_starts binary, hashes binary, list_starts binary, positions binary, terms binary, term_starts binary"
HITS = "segment long, place int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
SEGMENT_BYTES = 1 << 20
QUERY_BLOCK_BYTES = 32 << 20


# -------------------------------------------------------------------- the index


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, scope: str = "") -> DataFrame:
    """Segments of the positional index of ``text``, lower-cased (A-Z) words; staged."""
    common.ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        from evidra.llm import common as c

        number, powers = TaskContext.get().partitionId() << 32, []
        for b in c.given(batches):
            data, off = c.column_bytes(b.column("text"))
            for i, j in c.blocks(off, segment_bytes):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                start, end, doc, hashes = c.hashed_words(part, cut, c.ALNUM, powers)
                hashes, first, term = np.unique(hashes, return_index=True, return_inverse=True)
                order = np.argsort(term.astype(np.int32), kind="stable").astype(np.int32)
                lists = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(hashes)))]).astype(np.int32)
                size = (end - start)[first]
                to = np.cumsum(size)
                chars = c.LOWER[part[np.repeat(start[first] - to + size, size) + np.arange(size.sum())]]
                starts = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                ids = pa.ListArray.from_arrays([0, j - i], b.column("doc_id").slice(i, j - i).cast(pa.int64()))
                blobs = [starts, hashes, lists, order, chars, np.concatenate([[0], to]).astype(np.int32)]
                yield pa.record_batch([pa.array([number], pa.int64()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=[x.split()[0] for x in INDEX.split(", ")])
                number += 1

    # Rows are large: sizes are looked at after each row, else a page and a row group hold a hundred of them.
    small = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    return common.staged(docs.select("doc_id", "text").mapInArrow(run, INDEX), "index", scope, **small)


def rows_of(batches):
    """The segments of a task one by one."""
    for b in common.given(batches):
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        get = lambda k, kind: np.frombuffer(row[k], kind)
        self.number, self.doc_ids = row["segment"], row["doc_ids"]
        self.doc_starts, self.hashes, self.lists = get("doc_starts", np.int32).astype(np.int64), get("hashes", np.uint64), get("list_starts", np.int32).astype(np.int64)
        self.positions, self.chars, self.cuts = get("positions", np.int32), row["terms"], get("term_starts", np.int32)

    def find(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The number of each term here, -1 for a term that does not occur."""
        if not len(self.hashes):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        for k in np.flatnonzero(self.hashes[at] != hashes).tolist():
            at[k] = -1
        for k in np.flatnonzero(at >= 0).tolist():
            if self.chars[self.cuts[at[k]] : self.cuts[at[k] + 1]] != terms[k]:
                at[k] = -1
        return at

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.lists[term] : self.lists[term + 1]]

    def count(self, terms: np.ndarray) -> np.ndarray:
        return self.lists[terms + 1] - self.lists[terms]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Token positions at which the terms stand in a row, inside one document."""
        order = np.argsort(self.count(terms), kind="stable")
        found = self.postings(terms[order[0]]).astype(np.int64) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = self.postings(terms[k])
            want = found + k
            at = np.minimum(np.searchsorted(other, want), len(other) - 1)
            found = found[other[at] == want]
        found = found[(found >= 0) & (found + len(terms) <= self.doc_starts[-1])]
        return found[self.document(found) == self.document(found + len(terms) - 1)]

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Token positions from which all terms occur within ``span`` tokens of one document, starting with one of them."""
        terms = np.unique(terms)
        rare = self.postings(terms[np.argmin(self.count(terms))])
        left = np.unique(np.concatenate([p[self._close(p, rare, span)] for p in map(self.postings, terms)])).astype(np.int64)
        last = left.copy()
        for t in terms:
            p = self.postings(t)
            at = np.searchsorted(p, left)
            last = np.maximum(last, np.where(at < len(p), p[np.minimum(at, len(p) - 1)], left + span))
        ok = last - left < span
        left, last = left[ok], last[ok]
        return left[self.document(left) == self.document(last)]

    @staticmethod
    def _close(p: np.ndarray, rare: np.ndarray, span: int) -> np.ndarray:
        at = np.searchsorted(rare, p)
        return (rare[np.minimum(at, len(rare) - 1)] - p < span) & (rare[np.minimum(at, len(rare) - 1)] >= p)

    def document(self, token: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, token, "right") - 1


# ------------------------------------------------------------------ the queries


def text_words(text: str | None) -> list[bytes]:
    """The words of one text, as the index has them."""
    data = common.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = common.words(data, np.array([0, len(data)]), common.ALNUM)
    raw = data.tobytes()
    return [raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)]


class Queries:
    """A block of items as windows over a table of their terms."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.items, self.window = [], window
        number: dict[bytes, int] = {}
        for item, text in items:
            if w := text_words(text):
                self.items.append((item, np.array([number.setdefault(x, len(number)) for x in w])))
        self.terms = list(number)
        raw = np.frombuffer(b"".join(self.terms), np.uint8)
        end = np.cumsum([len(t) for t in self.terms], dtype=np.int64)
        self.hashes = common.word_hashes(raw, end - [len(t) for t in self.terms], end) if self.terms else np.zeros(0, np.uint64)

        # All windows of all items in one list: first word, length, item.
        size = np.array([min(window, len(w)) for _, w in self.items], np.int64)
        many = np.array([len(w) for _, w in self.items], np.int64) - size + 1
        self.flat = np.concatenate([w for _, w in self.items]) if self.items else np.zeros(0, np.int64)
        self.owner, self.size = np.repeat(np.arange(len(many)), many), np.repeat(size, many)
        base = np.cumsum(many + size - 1) - (many + size - 1)
        self.first = np.repeat(base - np.cumsum(many) + many, many) + np.arange(many.sum())

    def hits(self, seg: Segment) -> tuple[np.ndarray, dict[int, set[str]]]:
        """(for each token whether it is in a window that occurs, items of each document place)."""
        edge, items = np.zeros(seg.doc_starts[-1] + 1, np.int64), {}
        local = seg.find(self.terms, self.hashes)[self.flat]
        missing = np.concatenate([[0], np.cumsum(local < 0)])
        # Windows with a term that the segment lacks cost no step of their own.
        for k in np.flatnonzero(missing[self.first + self.size] == missing[self.first]).tolist():
            s, size = self.first[k], self.size[k]
            found = seg.phrase(local[s : s + size])
            if len(found):
                np.add.at(edge, found, 1)
                np.add.at(edge, found + size, -1)
                for d in np.unique(seg.document(found)).tolist():
                    items.setdefault(d, set()).add(self.items[self.owner[k]][0])
        return np.cumsum(edge)[:-1] > 0, items


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (id as text, text) of at most about ``block_bytes`` each, one after the other."""
    q = queries.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    size = q.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = q if n == 1 else q.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield n, [(r.i, r.t) for r in part.collect()]


def search(index: DataFrame, items: list[tuple[str, str | None]], window: int = 13) -> DataFrame:
    """For every document of the index: words, disjoint token ranges that windows of ``items`` cover, and those items."""
    common.ship(index.sparkSession)
    sent = index.sparkSession.sparkContext.broadcast(items)  # a block: at most QUERY_BLOCK_BYTES

    def run(batches):
        from evidra.llm import decontamination as d

        queries = d.Queries(sent.value, window)
        for row in d.rows_of(batches):
            seg = d.Segment(row)
            hit, items = queries.hits(seg)
            bounds = seg.doc_starts
            out = {k: [] for k in ("segment", "place", "doc_id", "n_words", "starts", "ends", "items")}
            for place, doc in enumerate(seg.doc_ids):
                a, z = bounds[place], bounds[place + 1]
                ranges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:z].astype(np.int8), [0]]))) if place in items else np.zeros(0, np.int64)
                for k, v in zip(out, (seg.number, place, doc, z - a, ranges[::2].astype(np.int32), ranges[1::2].astype(np.int32), sorted(items.get(place, ()))), strict=True):
                    out[k].append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return index.mapInArrow(run, HITS)


def merged(hits: DataFrame) -> DataFrame:
    """One row for each document from the hits of several query blocks."""
    return hits.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.expr("transform(starts, (s, i) -> sequence(s, ends[i] - 1))"))).alias("tokens"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    ).withColumn("n_hit", F.size(F.array_distinct(F.flatten("tokens"))).cast("long")).drop("tokens")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = QUERY_BLOCK_BYTES, scope: str = "") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated); contaminated: at least one ``share``-th of the words is hit."""
    index = build_index(docs, scope=scope)
    found = None
    for n, items in query_blocks(benchmark, "item_id", "text", block_bytes):
        part = search(index, items, window)
        found = part if found is None else found.unionByName(part)
    if n == 1:
        found = found.withColumn("n_hit", F.aggregate(F.zip_with("starts", "ends", lambda a, z: (z - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x))
    else:
        found = merged(found)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def proximity(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, slop: int = 5) -> DataFrame:
    """(doc_id, query_id, n): from how many tokens of a document all terms of a query lie within its number of terms plus ``slop`` tokens."""
    common.ship(index.sparkSession)
    found = None
    for _, items in query_blocks(queries, id_col, text_col, QUERY_BLOCK_BYTES):
        sent = index.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            from evidra.llm import decontamination as d

            block = d.Queries(sent.value, 1)
            for row in d.rows_of(batches):
                rows = []
                seg = d.Segment(row)
                at = seg.find(block.terms, block.hashes)
                for item, w in block.items:
                    if (at[w] >= 0).all():
                        place, n = np.unique(seg.document(seg.near(at[w], len(np.unique(w)) + slop)), return_counts=True)
                        rows += [(seg.doc_ids[p], item, c) for p, c in zip(place.tolist(), n.tolist(), strict=True)]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "query_id", "n"])

        part = index.mapInArrow(run, "doc_id long, query_id string, n long")
        found = part if found is None else found.unionByName(part)
    return found


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
