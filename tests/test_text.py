import html
from html.entities import html5

from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import dedup, extract, linking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_every_reference_as_the_standard_has_it(spark):
    """All names with and without a semicolon and before letters, numbers of all kinds, and what is no reference."""
    texts = [f"a &{n} b &{n}x &{n.rstrip(';')}y;" for n in html5]
    texts += [f"&#{n}; &#x{n:x} &#X{n:X};z" for n in [*range(400), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFE, 0x10FFFF, 0x110000, 10**12, 0x1F600, 8364]]
    texts += ["&", "&&&\nThe", "&#;", "&#x;", "&amp;lt;", "&#0000000000065;", "&notit; &notin; &ampx &AMPx&&lt;<b>", "I&#x27;ve &#x2F; &nbsp;&eacute", ""]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", T.unescape(F.col("t")).alias("u")).collect()}
    assert got.pop(-1) is None and got == {i: html.unescape(t) for i, t in enumerate(texts)}
    row = df.limit(1).select(T.is_firsthand(T.normalize(F.lit("I&#x27;ve&nbsp;used it"))).alias("a"), (T.fingerprint(F.lit("a &lt;b")) == T.fingerprint(F.lit("A\u00a0&#60;b"))).alias("b")).first()
    assert row.a and row.b


def test_normalize(spark):
    assert one(spark, "<p>a &lt;b&gt;</p>\n\t c &amp;amp; ", T.normalize) == "a <b> c &amp;"
    assert one(spark, None, T.normalize) == ""


def test_urls_and_markdown(spark):
    assert one(spark, "see https://x.y/z?q=1 now", T.without_urls) == "see now"
    assert one(spark, "# Title\n- [ ] box\nkeep\n```code```\n# gpt here", lambda c: T.markdown_cleanup(c, "gpt")).split("\n") == ["keep", "# gpt here"]  # blank lines go, as in the rules of the source


def test_two_rules_for_numbers_and_truth(spark):
    assert [one(spark, v, T.strict_int) for v in ("3", "1.0", "x", None)] == [3, 0, 0, 0]
    assert [one(spark, v, T.loose_int) for v in ("3", "1.0", "x", None)] == [3, 1, 0, 0]
    assert [one(spark, v, T.truthy) for v in ("Yes", "1", "true", "no", None)] == [True, True, True, False, False]
    assert [one(spark, v, T.exactly_true) for v in ("Yes", "TRUE", None)] == [False, True, False]


def test_firsthand(spark):
    assert one(spark, "Yesterday I finally tried it", T.is_firsthand)
    assert not one(spark, "They tried it", T.is_firsthand)


def test_sentences(spark):
    assert one(spark, "One. Two!\nThree? ", T.sentences) == ["One.", "Two!", "Three?"]


def test_mentions_longest_first_with_offsets(spark):
    items = spark.createDataFrame([(1, "Try Foo-2 or foo, not food."), (2, None)], "id int, t string")
    catalog = spark.createDataFrame([("foo", "foo", "p", True), ("foo-2", "foo2", "p", False)], "alias string, model_id string, provider_id string, generic boolean")
    got = linking.mentions(items, catalog, "id", "t").orderBy("start").collect()
    assert [(r.alias, r.start, r.end) for r in got] == [("foo-2", 4, 9), ("foo", 13, 16)]
    assert [r.alias for r in linking.drop_generic(linking.mentions(items, catalog, "id", "t"), "id").collect()] == ["foo-2"]
    assert linking.overlapping(["a b", "b c d"]) == [("a b", "b c d")]


def test_best_span(spark):
    items = spark.createDataFrame([(1, "The first one is great. It was bad and bad again! Nothing here.")], "id int, t string")
    spans = extract.labelled(extract.candidate_spans(items, "id", "t", ["great", "bad"]), {"a": ["first"], "b": ["again"]}, ("a", "b"), ["great"], ["bad"], "none")
    best = extract.best_spans(spans, ["id", "category"], "id").collect()
    assert {r.category for r in best} == {"a"} or {r.category for r in best} == {"a", "b"}
    assert extract.best_spans(spans, ["id"], "id").count() == 1


def test_simhash_pairs_against_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(k, base + f" w{k % 3}") for k in range(6)] + [(9, "something else entirely"), (10, None), (11, "")]
    sig = dedup.simhash(spark.createDataFrame(rows, "id int, t string"), "id", "t").cache()
    s = {r.id: r.signature for r in sig.collect()}
    reps = {}
    for k in sorted(s):
        reps.setdefault(s[k], k)
    want = {(a, b) for a in reps.values() for b in reps.values() if a < b and sum(x != y for x, y in zip(s[a], s[b], strict=True)) <= 6}
    assert {(r.a, r.b) for r in dedup.signature_pairs(sig, "id").collect()} == want


def test_simhash_links_hold_every_pair_of_documents(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(k, base + f" w{k % 3}") for k in range(8)] + [(9, "something else entirely"), (10, None), (11, ""), (12, base + " w1 w2")]
    sig = dedup.simhash(spark.createDataFrame(rows, "id int, t string"), "id", "t").cache()
    s = {r.id: r.signature for r in sig.collect()}
    want = {(a, b) for a in s for b in s if a < b and sum(x != y for x, y in zip(s[a], s[b], strict=True)) <= 6}
    for bands in (0, 7, 8, 9, 10):
        got = dedup.signature_links(sig, "id", bands=bands).collect()
        rep = {r.b: r.a for r in got if r.kind == "class"}
        linked = {(r.a, r.b) for r in got if r.kind == "link"}
        assert len(rep) == len(rows) and len(got) == len(rows) + len(linked)
        assert {(a, b) for a in s for b in s if a < b and (rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in linked)} == want
    assert [dedup.bands_for(n, 6) for n in (10, 100_000, 1_000_000)] == [7, 8, 9]
