"""Stages of the pipeline judge rows, not ids: rows with null and repeated ids."""

import collections

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def run(stage, spark, rows, sf_dir=""):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return collections.Counter((r.doc_id, r.text) for r in stage(spark, docs, str(sf_dir)).collect())


def test_join_keeps_one_row_of_each_component(spark):
    a, near, b, c, d, e = text("a"), text("a", 41), text("b"), text("c"), text("d"), text("e")
    rows = [(None, a), (None, a), (7, near), (9, a)]  # nulls go last: 7 stays
    rows += [(None, b), (None, b), (None, b)]  # only nulls: one stays
    rows += [(5, c), (5, c), (5, c)]  # repeated rows: one stays
    rows += [(1, d), (3, d), (3, e)]  # one row of doc_id 3 is a copy, the other is not
    rows += [(None, None), (None, None), (2, ""), (2, "")]  # no words: copies of nothing
    want = collections.Counter([(7, near), (None, b), (5, c), (1, d), (3, e), (None, None), (None, None), (2, ""), (2, "")])
    assert run(corpus_pipeline.drop_near_copies, spark, rows) == want


@pytest.fixture
def benchmark(spark, tmp_path):
    spark.createDataFrame([(1, text("q", 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return tmp_path


def test_decontamination_drops_rows_and_not_ids(spark, benchmark):
    bad, clean = "x " + text("q", 20), text("clean")
    rows = [(None, bad), (None, clean), (4, bad), (4, clean), (4, bad), (6, None), (6, clean), (6, clean)]
    want = collections.Counter([(None, clean), (4, clean), (6, None), (6, clean), (6, clean)])
    assert run(corpus_pipeline.drop_contaminated, spark, rows, benchmark) == want


def words(rng, n):
    return " ".join(f"k{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of every kind, with labels and a benchmark, and which rows a brute-force reading of the stages keeps."""
    import random

    rng, rows, labels, keeps = random.Random(5), [], [], []
    question = words(rng, 20)
    for k in range(300):
        toxic = k % 4 == 0
        t = words(rng, rng.randrange(3, 90))
        rows.append((k, f"you idiot {t} worthless clown you {words(rng, 5)} idiot" if toxic else t))
        labels.append((k, 1, int(toxic)))
        if not toxic:
            keeps.append((k, t))
    base = [words(rng, 60) for _ in range(4)]
    rows += [(1000, base[0]), (1001, base[0] + " tail"), (1002, base[0]), (None, base[0])]
    keeps.append((1000, base[0]))
    rows += [(None, base[1]), (None, base[1])]
    keeps.append((None, base[1]))
    rows += [(1003, base[2] + " " + question), (1004, question), (1003, base[3])]
    keeps.append((1003, base[3]))
    rows += [(1005, "write to me.too@example.org or call 555-123-4567 today"), (1006, None), (1006, ""), (None, None)]
    keeps += [(1005, None), (1006, ""), (1006, ""), (None, "")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), keeps


def test_run_equals_brute_force(spark, tables):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path, keeps = tables
    first = corpus_pipeline.run(spark, path)
    second = corpus_pipeline.run(spark, path)  # must not disturb the first, which is read now
    rows = first.collect()
    assert sorted(map(str, rows)) == sorted(map(str, second.collect()))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids) + 1
    whole = collections.Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    want = collections.Counter((i, size(t)) for i, t in keeps if t is not None)
    surrogate = whole - want
    assert not want - whole, (want - whole, surrogate)
    assert [i for i, _ in surrogate.elements()] == [1005]  # its text has surrogates, so other ids
    (k,) = (k for k, (i, t) in enumerate(keeps) if i == 7)
    (row,) = (r for r in rows if r.doc_id == 7 and r.start == 0 and r.length == r.doc_tokens) if any(r.doc_id == 7 and r.length == r.doc_tokens for r in rows) else (None,)
    if row:
        ids = tok.encode(keeps[k][1], add_special_tokens=False).ids + [1]
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    place = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in rows)
    assert [p for p, _ in place] == [sum(n for _, n in place[:j]) for j in range(len(place))]


def test_run_of_an_empty_table(spark, tables, tmp_path):
    path, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_private_data_stage_keeps_columns(spark):
    rows = [(1, "mail a.b@example.org now"), (2, None), (None, "no data"), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 99) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in corpus_pipeline.replace_private_data(spark, docs, "").collect()}
    assert got[1].n_chars == len(got[1].text) and "a.b@" not in got[1].text and (got[2].text, got[2].n_chars, got[None].text, got[3].text) == (None, 99, "no data", "")
    assert list(got[1].asDict()) == [c.split()[0] for c in SCHEMA.split(", ")]
