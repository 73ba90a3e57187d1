from pyspark.sql import functions as F

from evidra.operators import decisions, dedup, evaluation


def test_utilities_are_renormalised_and_ties_go_to_the_smaller_id(spark):
    scores = spark.createDataFrame([(1, 0, 50.0), (1, 1, 100.0), (2, 0, 75.0), (3, 0, None), (4, 0, 75.0)], "model_id int, aspect int, score double")
    weights = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 3.0)], "profile string, aspect int, weight double")
    got = decisions.best(decisions.weighted(scores, weights, "aspect", ["profile", "model_id"]), "profile", "model_id", 2).collect()
    assert sorted((r.position, r.model_id, r.utility) for r in got) == [(1, 1, 87.5), (2, 2, 75.0)]


def test_value_of_equal_prices(spark):
    scores = spark.createDataFrame([(1, 50.0)], "model_id int, score double")
    prices = spark.createDataFrame([(1, 9.0), (2, 9.0)], "model_id int, price double")
    assert decisions.value(scores, prices, "model_id").first().value == 0.7 * 50 + 0.3 * 100


def test_release_impact(spark):
    obs = spark.createDataFrame([(1, 0, "2024-01-01", 1.0, 0), (1, 0, "2024-01-03", 1.0, 2), (1, 0, "2024-01-04", 3.0, -2), (1, 0, "2024-03-01", 9.0, 2)], "model_id int, aspect int, published_at string, weight double, polarity int")
    releases = spark.createDataFrame([(1, "2024-01-03")], "model_id int, released string")
    r = decisions.release_impact(obs, releases, 5, (F.col("polarity") + 2) * 25.0).first()
    assert (r.n_before, r.n_after, r.before, r.after, r.change) == (1, 2, 50.0, 25.0, -25.0)


def test_stratified_split_counts(spark):
    rows = spark.createDataFrame([(i, "a" if i < 40 else "b" if i < 42 else None if i < 50 else "c") for i in range(51)], "id int, label string")
    got = {(r.label, r.test): r.n for r in evaluation.stratified_split(rows, "id", "label", 1).groupBy("label", "test").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", True): 10, ("a", False): 30, ("b", True): 1, ("b", False): 1, (None, True): 2, (None, False): 6, ("c", False): 1}


def test_work_list(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "")], "doc_id int, text string")
    cached = spark.createDataFrame([("x",)], "t string").select(F.sha2("t", 256).alias("text_hash"))
    got = dedup.work_list(docs, "doc_id", "text", cached).collect()
    assert sorted((r.doc_id, r.copies, r.hit) for r in got) == [(1, 2, True), (4, 1, False)]
