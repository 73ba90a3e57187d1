"""Byte-level BPE against tiktoken, fill-in-the-middle and integer clusters against plain versions of their whole contracts."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evidra.llm import byte_bpe, centroids, fill_middle

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", " lead", "tail ", "a  b\n\n c", "é ñ Ü 日本 語　x", "I'm <|endoftext|> we'll", "x" * 3000, "<P>", "a <S> b", "\x1c\x85\xa0  ", "123 4567 ٣٤", "a\tb\r\nc", "👩‍💻 ok", "!!!???" * 50, None]


def rows():
    rng = random.Random(5)
    letters = "abc dé日👩 \n\t.'9"
    out = [(k, t) for k, t in enumerate(ODD + ODD[:6])]
    return out + [(50 + k, "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 20, 300, 3000])))) for k in range(150)] + [(None, "a row without id"), (7, "x" * 3000), (7, "x" * 3000)]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """A folder whose table documents has odd rows, repeated ids, and columns that clash with results."""
    d = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "n", "form", "output", "decoded", "lang", "cluster")})
    df.repartition(4).write.parquet(f"{d}/documents.parquet")
    df.where("false").write.parquet(f"{d}/none/documents.parquet")
    return d


def plain_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op11(spark, given):
    enc, want = plain_bpe(), []
    for d, t in rows():
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.op11_byte_bpe(spark, given)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert byte_bpe.op11_byte_bpe(spark, given + "/none").count() == 0


def test_codec_long_texts_and_all_characters():
    v, enc = byte_bpe.vocabulary(RANKS, public_tokenizers.PATTERN), plain_bpe()
    own = byte_bpe.Codec(v, keep=50)
    every = "".join(f"a{chr(c)} {chr(c)}1" for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    long = "word, it's 12  \n" * 200_000
    for t in (every, long, "ab" * 100_000):
        ids = own.encode(t)
        assert ids == np.array(enc.encode_ordinary(t), "<u4").tobytes() and own.decode(ids) == t.encode()
    with pytest.raises(ValueError):
        own.decode(np.array([50256], "<u4").tobytes())


def test_vocabulary_of_few_ranks_with_gaps(tmp_path):
    """Ranks with gaps; a token that no merges reach is still the id of a match that equals it."""
    tokens = {bytes([b]): 2 * b for b in range(256)} | {b"ab": 600, b"bc": 590, b"abc": 700, b"xyz": 800}
    p = tmp_path / "v"
    p.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in tokens.items()))
    enc = tiktoken.Encoding("own", pat_str=r"\w+|\W", mergeable_ranks=tokens, special_tokens={})
    own = byte_bpe.Codec(byte_bpe.vocabulary(str(p), r"\w+|\W"))
    for t in ("abc", "xabc", "ababc", "xyz", "xyzx", "aabbcc abc"):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == enc.encode_ordinary(t), t
    p.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        byte_bpe.vocabulary(str(p), ".")


def plain_fill(d, t):
    t = t or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n, sha = len(tokens), hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
    h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    cut = form != "plain"
    return d, n, form, len(p) if cut else None, len(m) if cut else None, digest(out), digest(t)


def test_op12(spark, given):
    got = [tuple(r) for r in fill_middle.op12_fill_middle(spark, given).collect()]
    want = [plain_fill(*r) for r in rows()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert fill_middle.op12_fill_middle(spark, given + "/none").count() == 0


def test_fill_of_every_text_in_both_orders(spark, given):
    """All texts without a sentinel are cut and come back; extra columns stay, clashing ones are replaced."""
    docs = spark.read.parquet(f"{given}/documents.parquet")
    for spm in (0, 100):
        out = fill_middle.transform(docs, rate=100, spm_rate=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
        assert out.where("back <> coalesce(text, '')").isEmpty() and out.where("lang = 'clash'").count() == len(rows())
        assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "spm" if spm else "psm"}


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 5000):
        chars = rng.integers(1, 9, n)
        size = chars * 2
        s = fill_middle.SkipList(chars, size)
        before = np.concatenate([[0], np.cumsum(chars)])
        for rank in {0, n, *rng.integers(0, n + 1, 200).tolist()}:
            assert s.find(rank) == (before[rank], 2 * before[rank])


def test_token_ends_over_windows(monkeypatch):
    monkeypatch.setattr(fill_middle.common, "BLOCK_BYTES", 7)
    text = "aé  bcd\n日本 e   fghijklmnop  "
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    raw = np.frombuffer(text.encode(), np.uint8)
    ends, chars = fill_middle._ends(raw, np.array([0, len(raw)]))
    assert np.diff(chars, prepend=0).tolist() == [len(t) for t in tokens] and np.diff(ends, prepend=0).tolist() == [len(t.encode()) for t in tokens]


def plain_clusters(rows, k=8, rounds=10, dims=64):
    """The contract in Python's whole numbers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    cent = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        member = [near(v)[1] for _, v in kept]
        for j in range(len(cent)):
            own = [v for (_, v), m in zip(kept, member, strict=True) if m == j]
            if own:
                cent[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, j in got if j == c) for c in range(len(cent))]
    return sorted(str((i, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest())) for i, d, j in got)


@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_op13(spark, tmp_path, n):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 64))
    rows = [(k, (base[k % 6] + rng.normal(size=64) * (0 if k % 7 == 0 else 0.4)).astype(np.float32).tolist()) for k in range(n)]
    rows += [(90_000, None), (90_001, []), (90_002, [1.0] * 63), (90_003, [1.0] * 63 + [None]), (90_004, [float("nan")] * 64), (90_005, [float("-inf")] + [0.0] * 63)]
    rows += [(None, [0.5] * 64), (3, [-0.25] * 64), (3, [-0.25] * 64)] if n > 5 else []
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op13_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_clusters(rows)


def test_tournament_ties_and_bounds(spark):
    c = np.array([[0, 0], [4, 0], [0, 4], [4, 0]], np.int64)
    x = np.array([[2, 0], [2, 2], [4, 0], [3, 3], [1, 4], [9, 0]], np.int64)
    best, d = centroids.Bisectors(c).nearest(x)
    plain = ((x[:, None] - c[None]) ** 2).sum(2)
    assert best.tolist() == plain.argmin(1).tolist() and d.tolist() == plain.min(1).tolist()
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 2)], "vec_id long, embedding array<float>"), dims=2).collect()
