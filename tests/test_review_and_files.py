import os

from pyspark.sql import functions as F

from evidra.operators import evaluation, review, vectors
from evidra.sources import files
from evidra.streaming import extract as stream


def test_last_review_wins_and_exclusion(spark):
    obs = spark.createDataFrame([(1, 5, 0, 0), (2, 5, 1, 1), (3, 5, 1, 1)], "source_item_id int, model_id int, polarity int, aspect int")
    rev = spark.createDataFrame([(1, 5, 2, None, False, 1), (1, 5, -2, None, False, 2), (2, 5, None, None, True, 3)], "source_item_id int, model_id int, human_polarity int, human_aspect int, excluded boolean, seq int")
    got = {r.source_item_id: (r.polarity, r.changed) for r in review.apply_reviews(obs, rev).collect()}
    assert got == {1: (-2, True), 2: (1, False), 3: (1, False)}
    assert {r.source_item_id: r.part for r in review.split_by_review(obs, rev).collect()} == {1: "human", 2: "dropped", 3: "machine"}
    assert [r.source_item_id for r in review.unreviewed(obs, rev).collect()] == [3]


def test_splits_are_disjoint(spark):
    rows = spark.range(200).select((F.col("id") % 23).alias("thread_id"))
    got = evaluation.grouped_split(rows, "thread_id", 3).collect()
    assert len(got) == 23 and sum(r.test for r in got) == 6


def test_macro_f1_by_hand(spark):
    rows = spark.createDataFrame([("x", "f", "a", "a"), ("x", "f", "a", "b"), ("x", "f", "b", "b"), ("x", "f", "c", "b")], "backend string, field string, label string, actual string")
    r = evaluation.macro_f1(rows).first()
    assert abs(r.macro_f1 - (2 / 3 + 0.5 + 0) / 3) < 1e-9 and r.accuracy == 0.5


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.99, 0.01]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [round(r.c, 6) for r in rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [0.999949, 0.0, 0.0, 0.0]


def test_jsonl_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "b int, a string")
    assert files.write_jsonl(df, f"{tmp_path}/j") == 2
    assert files.write_jsonl(df, f"{tmp_path}/j", append=True) == 2
    assert files.read_jsonl(spark, f"{tmp_path}/j", df.schema).count() == 4
    with open(f"{tmp_path}/r.csv", "w", encoding="utf-8-sig") as f:
        f.write('review_id,text\n1,"two\nlines, ""quoted"""\n')
    r = files.read_review_csv(spark, f"{tmp_path}/r.csv").first()
    assert (r.review_id, r.text) == ("1", 'two\nlines, "quoted"')


def test_payloads(spark):
    raw = spark.createDataFrame([(1, "story", "u", 0, "T", None, None, None, 5, 2, None, None, None, None), (2, "comment", "v", 60, None, "hi", None, 1, None, None, None, True, None, None)], files.FORUM_SCHEMA)
    got = {r.source_id: r for r in files.forum_items(raw).collect()}
    assert got["1"].thread_id == "1" and got["2"].thread_id == "1" and got["2"].metadata.deleted and got["1"].engagement["score"] == 5.0


def test_first_wins_over_files(spark):
    a, b = (spark.createDataFrame([(k, n, 1)], "key int, v string, seq int") for k, n in ((1, "a"), (1, "b")))
    assert [r.v for r in files.union_first_wins([a, b], ["key"], "seq").collect()] == ["a"]


def test_stream_appends_new_files_once(spark, tmp_path):
    src, out, cp = (os.path.join(tmp_path, x) for x in ("in", "out", "cp"))
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    df.write.json(src)
    for want in (1, 2):
        stream.append(stream.read_items(spark, src, df.schema), lambda s: s.withColumn("n", F.length("t")), out, cp).awaitTermination()
        assert spark.read.parquet(out).count() == want
        df.write.mode("append").json(src)
