"""Names told apart by their surroundings, feature tokens and reports against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidra.operators import claims, learning, reports

HOMONYMS = (claims.Homonym(("owl",), ("bird", "owl nest"), 12), claims.Homonym(("fox",), ("den of",)))
GENERIC = ((("fox",), ("fox one", "fox two")),)
ALIASES = ("fox one", "fox two", "fox", "owl", "owl 2")


def plain_names(text):
    """Names by one search for each alias, the longest first; then homonyms by their surroundings, then generic names."""
    low, taken = text.lower(), []
    for a in sorted(ALIASES, key=lambda a: -len(a)):
        for m in re.finditer(rf"(?<![a-zA-Z0-9]){re.escape(a)}(?![a-zA-Z0-9])", low):
            if all(m.end() <= s or m.start() >= e for s, e, _ in taken):
                taken.append((*m.span(), a))
    out = []
    for s, e, a in sorted(taken):
        if not any(a in h.aliases and any(x in (low if h.width is None else low[max(0, s - h.width) : e + h.width]) for x in h.signals) for h in HOMONYMS):
            out.append(a)
    return [a for a in out if a not in GENERIC[0][0] or not set(out) & set(GENERIC[0][1])]


def plain_product(text, context):
    low = text.lower()
    for a, p in context.products:
        for m in re.finditer(rf"(?<![a-zA-Z0-9]){re.escape(a)}(?![a-zA-Z0-9])", low):
            before, after = low[max(0, m.start() - context.width) : m.start()], low[m.end() : m.end() + context.width]
            if "/" not in before + after and not any(x in after for x in context.not_after) and any(c in before or c in after for c in context.cues):
                return p
    return None


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    pieces = ["fox", "fox one", "Fox Two", "owl", "OWL 2", "bird", "owl nest", "den of", "using ", "in", "at my", "x/y", " says", "pad", "Studio", "lab", "a\nb", "é", "foxes", "padding words"]
    return ["", "owl", "owl bird", "bird owl", "in studio says", "Studio at x"] + [rng.choice(["", " "]).join(rng.choices(pieces, k=rng.randint(1, 9))) if k % 5 == 0 else " ".join(rng.choices(pieces, k=rng.randint(1, 12))) for k in range(2000)]


def test_names_and_products_equal_plain_searches(spark, texts):
    context = claims.Context(homonyms=HOMONYMS, products=(("lab", "p-lab"), ("studio", "p-studio")), profiles=(("pad", "wide"),))
    names = claims.Names(sorted(ALIASES, key=lambda a: -len(a)), HOMONYMS, GENERIC)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, t string")
    t = F.col("t")
    got = df.select("k", names.found(t).alias("f"), names.named(t).alias("named"), claims.product(t, context).alias("p"), claims.profile(t, context).alias("q")).select("*", F.transform(names.specific(F.col("f")), F.lower).alias("n")).collect()
    for r in got:
        if r.k < 0:
            assert (r.f, r.n, r.p, r.q) == (None, None, None, None)
            continue
        x = texts[r.k]
        assert r.n == plain_names(x), x
        assert r.named == (len(r.f) > 0) and r.p == plain_product(x, context), x
        assert r.q == ("wide" if re.search(r"(?<![a-zA-Z0-9])pad(?![a-zA-Z0-9])", x.lower()) else None), x
    assert len({tuple(r.n) for r in got if r.k >= 0}) > 20 and {r.p for r in got} == {None, "p-lab", "p-studio"}


def test_claims_are_kept_apart_by_product(spark):
    from tests.test_chain import ITEM, RULES

    catalog = spark.createDataFrame([("fox one", "fox-1", "p1", False), ("fox", "fox", "p1", True)], "alias string, model_id string, provider_id string, generic boolean")
    body = "Fox One in Studio is reliable.\n\nFox One got better compared at lab.\n\nFox one, that fox, is better than before."
    context = claims.Context(products=(("studio", "p-studio"), ("lab", "p-lab")))
    got = claims.observations(spark.createDataFrame([("x", "reddit", "", body, False, None)], ITEM), catalog, RULES, context=context).collect()
    assert {r.model_id for r in got} == {"fox-1"} and {r.product_id for r in got} >= {"p-studio", "p-lab"}
    assert len({(r.product_id, r.evidence_type) for r in got}) == len(got)
    with pytest.raises(ValueError):
        claims.Context(products=[(str(k), "p") for k in range(501)])


def plain_tokens(text, context, meta):
    def grams(t):
        w = [x.lower() for x in re.findall(r"[a-zA-Z][a-zA-Z0-9_+-]*", t) if len(x) > 1]
        return w + [f"{a}__{b}" for a, b in zip(w, w[1:], strict=False)]

    low = f"{text}\n{context}".strip().lower()
    out = grams(text) * 2 + grams(context) + (["__feature_question__"] if text.strip().endswith("?") else [])
    return out + [k for k, of in learning.HINTS.items() if any(h in low for h in of)] + [f"__meta_{k}__{v.strip().lower()}" for k, v in meta.items() if v and v.strip()]


def test_feature_tokens(spark):
    rows = [("I used GPT-4 at work, a lot?", "It got worse", "Fox"), ("x", "", " "), ("", "only context", None), (None, None, None), ("naïve c++ a_b", None, "P")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, c string, m string")
    got = df.select("k", learning.feature_tokens(F.col("t"), F.col("c"), {"m": F.col("m")}).alias("x")).orderBy("k").collect()
    for r, (t, c, m) in zip(got, rows, strict=True):
        assert r.x == plain_tokens(t or "", c or "", {"m": m})
    tok = learning.tokens(df.withColumn("x", learning.feature_tokens(F.col("t"))), "k", F.col("x"), "m")
    assert tok.where("k = 0 and token = 'gpt-4'").first().n == 2


def test_reports(spark):
    rng = random.Random(3)
    flags = reports.FLAGS
    rows = [(rng.choice("ab"), rng.choice(["neutral", "praise"]), rng.choice(["hearsay", "bug"]), rng.choice([None, 0.5, 0.65, 0.9]), rng.choice(["one two", "", None]), *[rng.random() < 0.3 for _ in flags]) for _ in range(200)]
    df = spark.createDataFrame(rows, "model_id string, claim_type string, evidence_type string, confidence double, span string, " + ", ".join(f"{f} boolean" for f in flags))
    got = {(r.section, r.name): r.value for r in reports.quality(df).collect()}
    sure = [r[3] or 0.0 for r in rows]
    assert got[("rows", "n")] == 200 and got[("flags", "value_flag")] == sum(r[-1] for r in rows) and got[("confidence", "avg")] == pytest.approx(sum(sure) / 200)
    assert got[("confidence", "below_0_72")] == sum(x < 0.72 for x in sure) and got[("evidence", "max_words")] == 2 and ("warnings", "low_average_extractor_confidence") in got
    empty = {(r.section, r.name): r.value for r in reports.quality(df.limit(0)).collect()}
    assert empty[("rows", "n")] == 0 and not any(s == "warnings" for s, _ in empty)
    assert {(r.field, r.value): r.n for r in reports.counts(df, ["model_id"]).collect()} == {("model_id", k): n for k, n in Counter(r[0] for r in rows).items()}


def test_label_report(spark):
    rows = [("yes", "true", "2", "2"), ("no", "TRUE", "x", "0"), ("no", "", "1", None), (None, "no", None, "1")]
    df = spark.createDataFrame(rows, "m string, h string, pm string, ph string")
    got = reports.label_report(df, {"flag": ("m", "h", "flag"), "polarity": ("pm", "ph", "number")}).collect()
    fields = {r.field: (r.labelled, r.correct) for r in got if r.kind == "field"}
    assert fields == {"flag": (3, 2), "polarity": (3, 2)}
    assert {(r.field, r.pair, r.n) for r in got if r.kind == "pair"} == {("flag", "true -> true", 1), ("flag", "false -> true", 1), ("flag", "false -> false", 1), ("polarity", "2 -> 2", 1), ("polarity", "0 -> 0", 1), ("polarity", "0 -> 1", 1)}


def test_pool_and_comparison(spark):
    rows = [("a", "p", "t", True, 0.1, None), ("unspecified", "p", " ", False, 0.9, False), ("b", "q", None, None, 0.1, False), ("c", "q", "u", True, 0.9, True)]
    df = spark.createDataFrame(rows, "model_id string, provider_id string, thread_id string, human boolean, c double, x boolean")
    (r,) = reports.pool(df, F.col("human"), F.col("c") > 0.5, F.col("x")).collect()
    assert (r.human_included, r.machine_included, r.machine_rejected, r.excluded_by_review, r.models, r.providers, r.threads, r.unspecified) == (1, 1, 1, 1, 2, 1, 1, 1)
    one = spark.createDataFrame([("x", 0.5, 0.6), ("y", 0.7, 0.8)], "field string, macro_f1 double, accuracy double")
    got = {r.backend: (r.available, r.fields, r.mean_macro_f1, r.position) for r in reports.comparison({"b": one, "a": one.where("field = 'x'")}, ["z"]).collect()}
    assert got["a"] == (True, 1, 0.5, 2) and got["b"][1] == 2 and got["b"][3] == 1 and got["z"] == (False, 0, None, 3)
    metrics = one.withColumn("backend", F.lit("b")).unionByName(one.select("field", (F.col("macro_f1") / 2).alias("macro_f1"), "accuracy").withColumn("backend", F.lit("b")))
    low = {r.field: (r.runs, r.lowest_macro_f1, r.highest_macro_f1) for r in reports.runs(metrics).collect()}
    assert low == {"x": (2, 0.25, 0.5), "y": (2, 0.35, 0.7)}
