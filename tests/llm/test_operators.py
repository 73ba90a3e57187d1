"""The text operators against brute force, exact round trips and held-out accuracy, with nulls, empty texts, repeats and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidra.llm import common, decontamination, jaccard, language, lm_score, media, packing, pii, sharding, token_files, toxicity

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", " ", "a  b", " lead", "tail ", "line\n x", "a\n\nb,,c", "é ñ Ü", "no break", "日本 語", "I'm <|endoftext|> ok", "x " * 3000, None]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(80)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(ODD + ODD[:4])]
    for k in range(300):
        rows.append((100 + k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 20, 60, 200]))), rng.choice(["en", None]), "hot", 1))
    rows += [(1000 + k, rows[30][1], "en", "hot", 1) for k in range(40)] + [(None, "a row without id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()


@pytest.fixture
def empty(docs):
    return docs.where("false")


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def ids_of(path, t, end):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok.encode(t, add_special_tokens=False).ids + [end]


def test_packing(docs, empty):
    want = {d: ids_of(WORD, t, 1) for d, t in texts(docs).items()}
    rows = packing.pack(docs, WORD, window=64, with_ids=True).collect()
    got, total = collections.defaultdict(dict), sum(map(len, want.values()))
    places = []
    for r in rows:
        got[r.doc_id][r.start] = np.frombuffer(bytes(r.ids), "<u2").tolist()
        assert r.doc_tokens == len(want[r.doc_id]) and r.offset + r.length <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        places.append((r.sequence_id * 64 + r.offset, r.length))
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in got.items()} == want
    at = 0
    for p, n in sorted(places):
        assert p == at
        at += n
    assert at == total and packing.pack(empty, WORD).count() == 0
    assert [packing.padded_length(n) for n in (64, 100, 2048)] == [64, 2048, 2048]


def test_token_files(spark, docs, empty):
    want = {d: ids_of(BYTE, t, 2) for d, t in texts(docs).items()}
    path = common.new_dir(spark, "test")
    m = token_files.write_token_files(docs, path, BYTE, docs_per_shard=60, keys_per_bucket=50)
    rows = token_files.read_token_files(spark.read.parquet(m["keys"]), path, m).collect()
    got = {None if r.doc_id == token_files.NO_ID else r.doc_id: r for r in rows}
    assert {d: np.frombuffer(bytes(r.ids), "<u2").tolist() for d, r in got.items()} == want
    at = 0
    for d in sorted(want, key=lambda d: (d is not None, d or 0)):
        assert got[d].start == at
        at += len(want[d])
    assert token_files.lookup(path, m, 103).tolist() == want[103] and token_files.lookup(path, m, 99_999) is None
    path = common.new_dir(spark, "test")
    m = token_files.write_token_files(docs.where("doc_id < 3").unionByName(docs.where("doc_id = 103")).unionByName(docs.where("doc_id = 103")), path, BYTE, docs_per_shard=2)
    rows = token_files.read_token_files(spark.read.parquet(m["keys"]), path, m).collect()
    assert sorted((r.doc_id, r.copy) for r in rows) == [(0, 0), (1, 0), (2, 0), (103, 0), (103, 1)]
    m = token_files.write_token_files(empty, common.new_dir(spark, "test"), BYTE)
    assert m["docs"] == 0


def test_minimal_perfect_hash():
    keys = common.mix(np.arange(5000, dtype=np.uint64))
    maps, slot = token_files.build_hash(keys)
    assert sorted(slot.tolist()) == list(range(5000)) and (token_files.find_slots(maps, keys) == slot).all()


def smallest_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, used = (lo + hi) // 2, 1, 0
        for s in sizes:
            n, used = (n + 1, s) if used + s > mid else (n, used + s)
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def test_sharding(spark, docs, empty):
    rows = sharding.shard(docs, 7).collect()
    assert len(rows) == docs.count() and all(0 <= r.shard < 7 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    t = texts(docs)
    place = {}
    for r in rows:
        assert r.size == len(t[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(t[r.doc_id].encode())
        if t[r.doc_id]:
            assert place.setdefault(t[r.doc_id], r.shard) == r.shard
    assert sharding.shard(empty).count() == 0
    rng = random.Random(1)
    for _ in range(6):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 60))]
        units = spark.createDataFrame(list(enumerate(sizes)), "unit long, bytes long")
        assert sharding.capacity(units, 5).first().capacity == smallest_capacity(sizes, 5)


@pytest.mark.parametrize(("bits", "split", "shards"), [(14, 256, 5), (3, 4, 5), (2, 2, 3), (3, 4, 1), (4, 8, 40)])
def test_minimax_of_groups(spark, bits, split, shards):
    rng = random.Random(bits)
    groups = {rng.randrange(-(2**63), 2**63): 1 for _ in range(300)}
    rows = [(h, rng.randrange(1, 400) if rng.random() < 0.97 else 5000) for h in groups for _ in range(rng.choice([1, 1, 3]))]
    sizes = collections.Counter()
    for h, n in rows:
        sizes[h] += n
    best, cuts = sharding.minimax(spark.createDataFrame(rows, "h long, size long"), shards, bits, split)
    ordered = [sizes[h] for h in sorted(sizes)]
    assert best == smallest_capacity(ordered, shards) and len(cuts) < shards
    fill = collections.Counter(sum(c <= h for c in cuts) for h in sizes for _ in range(1))
    by = collections.Counter()
    for h, n in sizes.items():
        by[sum(c <= h for c in cuts)] += n
    assert max(by.values()) <= best and sum(fill.values()) == len(sizes)


def components(rows, k, percent):
    sets, root, inv = {}, {}, collections.defaultdict(list)
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        root[i] = i
        for g in sets[i]:
            inv[g].append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for b, n in collections.Counter(b for g in s for b in inv[g] if b != i).items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                p, q = top(i), top(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 140), (5, 80, 4), (2, 60, 140), (2, 60, 4)])
def test_jaccard_join(spark, docs, empty, k, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_IN_BLOCK", block)
    monkeypatch.setattr(jaccard, "MOST_IN_BLOCK", max(block, 8))  # clusters of more are cut by sketches first
    rng, rows = random.Random(k), {d: t for d, t in texts(docs).items() if d is not None}
    n = 10_000
    for _ in range(30):
        size = rng.choice([1, 3, 6, 10, 25, 70])
        base = [f"v{rng.randrange(60)}" for _ in range(size)]
        for _ in range(15):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 3])):
                w[rng.randrange(size)] = f"v{rng.randrange(60)}"
            rows[n] = " ".join(w)
            n += 1
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, k, percent).collect()} == components(rows, k, percent)
    assert jaccard.join(empty, k, percent).count() == 0


def test_sets_of_blocks_with_fewer_words_than_a_gram(spark):
    pa = __import__("pyarrow")
    for n in range(6):
        for k in (4, 5):
            assert [len(s) for s in jaccard.sets_of(pa.array([" ".join(f"w{i}" for i in range(n))]), k, [])] == [min(n, max(n - k + 1, 1))]
    long = "x" * (2 << 20)
    assert [len(s) for s in jaccard.sets_of(pa.array(["two words", long]), 5, [])] == [1, 1]  # each in a block of its own
    rows = [(k, " ".join(["w"] * k)) for k in range(1, 6)] + [(9, "w w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, 4, 85).collect()} == components(dict(rows), 4, 85)


@pytest.mark.parametrize("kind", ["chain", "random", "empty"])
def test_components_of_graphs(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "chain":
        names = rng.permutation(300)
        edges = list(zip(names[:-1].tolist(), names[1:].tolist(), strict=True))
    else:
        edges = rng.integers(-400, 400, (380 if kind == "random" else 0, 2)).tolist()
    label = {n: n for e in edges for n in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(5), 2).collect()
    assert len(got) == len(label) and {r.node: r.label for r in got} == label


def test_sketches_never_differ_more_than_sets():
    pa = __import__("pyarrow")
    rng = np.random.default_rng(9)
    for size in (1, 20, 400, 1000, 40_000, 3_000_000):  # the last with counts beyond what a sketch holds
        s = rng.integers(0, 2**63, size).astype(np.uint64)
        t = np.concatenate([s[: size * 9 // 10], rng.integers(0, 2**63, size // 5).astype(np.uint64)])
        both = jaccard.Sketches(pa.array([jaccard.sketch(s), jaccard.sketch(t)], pa.binary()))
        a, b = both.folded(np.arange(2), int(both.bins.min())).astype(int)
        assert abs(a - b).sum() <= len(np.setxor1d(s, t))
        n = np.array([len(s), len(t)])
        c = len(np.intersect1d(s, t))
        for percent in (50, 80, 95):
            assert both.close(np.array([0]), np.array([1]), n, percent)[0] or 100 * c < percent * (n.sum() - c)


def test_bands_of_all_similar_sizes_meet():
    for percent in range(50, 96, 5):
        bands = {n: set(jaccard.plans_of(n, percent)) for n in range(1, 400)}
        for a in bands:
            for b in range(a, min(399, 100 * a // percent) + 1):
                assert bands[a] & bands[b] and jaccard.band_of(a) in bands[b]


def test_groups_of_sets_that_share_a_key():
    keys = np.array([5, 5, 7, 8, 8, 8, 9, 9, 5], np.uint32)
    sids = np.array([1, 2, 3, 1, 2, 2, 4, 5, 2])
    got = collections.defaultdict(set)
    for b in jaccard.shared(keys, sids - 1, np.array([1, 2, 3, 4, 5])):
        for gid, k, sid in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[gid, k].add(sid)
    assert sorted(map(sorted, got.values())) == [[1, 2], [4, 5]] and all(len(v) == k for (_, k), v in got.items())
    assert not list(jaccard.shared(np.arange(3, dtype=np.uint32), np.arange(3), np.array([7, 7, 8])))
    assert not list(jaccard.shared(np.array([1, 1], np.uint32), np.arange(2), np.array([7, 7])))  # a copy in another task


@pytest.mark.parametrize("paired", [2, 32])
def test_plausible_groups_hold_all_links(paired, monkeypatch):
    pa = __import__("pyarrow")
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    rng, sets, rows = np.random.default_rng(4), [], []
    for g in range(40):
        base = rng.integers(0, 2**63, rng.choice([3, 40, 300]))
        for _ in range(rng.choice([2, 3, 9])):
            s = base.copy()
            s[: len(s) // 10] = rng.integers(0, 2**63, len(s) // 10)
            rows.append((g, len(sets)))
            sets.append(np.unique(s.astype(np.uint64)))
    t = pa.table({"gid": [g for g, _ in rows], "sid": [k for _, k in rows], "n": [len(s) for s in sets], "sketch": pa.array([jaccard.sketch(s) for s in sets], pa.binary())})
    a, b = jaccard.plausible_groups(t, 80)
    star = dict(zip(b.tolist(), a.tolist(), strict=True))
    for g, x in rows:
        for h, y in rows:
            c = len(np.intersect1d(sets[x], sets[y]))
            if g == h and x < y and 100 * c >= 80 * (len(sets[x]) + len(sets[y]) - c):
                assert star[x] == star[y]


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
def test_windows_of_a_long_text_give_the_same_words(window):
    rng = random.Random(2)
    t = "".join(rng.choice("ab \tçД.") for _ in range(900)) + "x" * 300
    data = np.frombuffer(t.encode(), np.uint8)
    start, end, _ = common.words(data, np.array([0, len(data)]), common.NOT_SPACE)
    want = start.tolist(), end.tolist(), common.word_hashes(common.LOWER[data], start, end).tolist()
    assert tuple(x.tolist() for x in common.long_words(data, common.NOT_SPACE, size=window)) == want


def test_long_text_is_one_set():
    pa = __import__("pyarrow")
    t = " ".join(f"w{k % 5000}" for k in range(400_000))
    a, b = jaccard.sets_of(pa.array([t, " ".join(f"w{k}" for k in range(5000)) + " w0 w1 w2"]), 4, [])
    assert len(t) > common.BLOCK_BYTES and a.tolist() == b.tolist()


def test_one_deletion_plan_finds_all():
    rng = np.random.default_rng(5)
    for budget_sets in (1, 10**9):  # many sets make the one-deletion budget the cheaper one
        for size in (7, 30, 120):
            s = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            plan = jaccard.Plan(jaccard.band_of(len(s)), 85, budget_sets)
            for _ in range(50):
                t = s.copy()
                for _ in range(int(15 * len(s) // 85 // 2)):
                    t[rng.integers(len(t))] = rng.integers(0, 2**63)
                t = np.unique(t)
                both = len(np.intersect1d(s, t))
                if jaccard.band_of(len(t)) == plan.band and 100 * both >= 85 * (len(s) + len(t) - both):
                    assert np.intersect1d(plan.keys(s), plan.keys(t)).size


def test_contamination(spark, docs, empty):
    rows = texts(docs.where("doc_id is not null"))
    bench = [(1, " ".join(rows[130].split()[:30])), (2, "w1 w2"), (3, None), (4, ""), (None, "no such words here"), (5, rows[140])]
    b = spark.createDataFrame(bench, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = {}
    for d, t in rows.items():
        w, hit, items = words(t), set(), set()
        for item, bt in bench:
            v = words(bt)
            size = min(13, len(v))
            for s in range(len(v) - size + 1 if size else 0):
                for a in range(len(w) - size + 1):
                    if w[a : a + size] == v[s : s + size]:
                        hit |= set(range(a, a + size))
                        items.add("" if item is None else str(item))
        want[d] = (len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))
    for limit in (1 << 20, 100):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontamination.contamination(docs, b, block_bytes=limit).collect() if r.doc_id is not None}
        assert got == want
    assert decontamination.contamination(empty, b).count() == 0
    assert decontamination.contamination(docs, b.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red x x blue y green"), (2, "red blue"), (3, "blue z red z green"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([("q", "red blue green")], "id string, t string")
    index = decontamination.build_index(df)
    near = lambda slop: sorted(r.doc_id for r in decontamination.proximity(index, q, "id", "t", slop).collect())
    assert near(3) == [1, 3] and near(2) == [3] and near(1) == []


def test_media(spark, docs, empty):
    rows = media.store_text(docs).collect()
    t = texts(docs)
    for r in rows:
        raw = t[r.doc_id].encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        table = media.sample_table(bytes(r.media))
        assert media.track_bytes(bytes(r.media), table) == want and r.n_bytes == len(raw)
    info = media.media_columns(spark.createDataFrame([(1, bytearray(rows[0].media)), (2, bytearray(b"\0\0\0\x20moovxx")), (3, None)], "id int, media binary")).orderBy("id").collect()
    assert info[0].media_info.codec == "raw " and info[0].media_info.keyframes[0].length == 64
    assert info[1].media_info.error and info[2].media_info.error == "null"
    assert media.store_text(empty).count() == 0


def hostile(kind):
    import struct

    good, box = bytearray(media.container(b"x" * 640)), media._box
    put = lambda name, at, value: struct.pack_into(">I", good, good.index(name) + 4 + at, value)
    if kind == "deep":
        blob = b""
        for _ in range(1500):
            blob = box(b"moov", blob)
        return blob
    if kind in ("stsz", "stco", "stss", "stts", "stsc"):
        put(kind.encode(), 8 if kind == "stsz" else 4, 2**32 - 1)
    elif kind == "sync 0":
        put(b"stss", 8, 0)
    elif kind == "sync behind":
        put(b"stss", 8, 11)
    elif kind == "chunk":
        put(b"stsc", 8, 7)
    elif kind == "cut":
        return bytes(good[:-1])
    elif kind == "no track":
        return media._box(b"ftyp", b"isom")
    return bytes(good)


@pytest.mark.parametrize("kind", ["deep", "stsz", "stco", "stss", "stts", "stsc", "sync 0", "sync behind", "chunk", "cut", "no track"])
def test_broken_containers_give_an_error(kind):
    got = media.describe(hostile(kind))
    assert got["error"] and got["codec"] is None and got["tracks"] is None


def test_tracks_and_fragments():
    import struct

    box, full = media._box, media._full
    one = media.container(b"a" * 64)
    assert [t["track_id"] for t in media.tracks(one)] == [1]

    def trak(number, handler, codec):
        tables = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
        head = full(b"tkhd", struct.pack(">II", 0, 0), struct.pack(">I", number), bytes(68))
        return box(b"trak", head, box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(4), handler, bytes(12), b"\0"), box(b"minf", tables)))

    trex = full(b"trex", struct.pack(">IIIII", 2, 1, 40, 5, 0x10000))
    moov = box(b"moov", trak(1, b"soun", b"mp4a"), trak(2, b"vide", b"avc1"), box(b"mvex", trex))

    def moof(data_offset):
        run = box(b"trun", struct.pack(">IIiI", 0x205, 3, data_offset, 0), struct.pack(">III", 4, 5, 6))
        more = box(b"trun", struct.pack(">II", 0, 2))  # follows, with the defaults
        return box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 2)), run, more))

    size = len(moof(0))
    blob = moov + moof(size + 8) + box(b"mdat", bytes(range(25)))
    got = media.describe(blob)
    start = len(moov) + size + 8
    assert got["error"] is None and (got["codec"], got["samples"], got["sample_bytes"], got["duration"]) == ("avc1", 5, 25, 0.2)
    assert got["keyframes"] == [{"offset": start, "length": 4}] and [(t["track_id"], t["codec"], t["samples"]) for t in got["tracks"]] == [(1, "mp4a", 0), (2, "avc1", 5)]
    assert media.track_bytes(blob, media.sample_table(blob)) == bytes(range(25))


def test_media_query(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    t = texts(docs)
    for r in media.op2_media_columns(spark, str(tmp_path)).collect():
        raw = t[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        blob = media.container(payload)
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest()) and f"keyframes={len(r.keyframes)};" in r.feature
        assert len(r.keyframes) == -(-len(payload) // 1024) and all(blob[f.offset : f.offset + f.length] == payload[k * 1024 : k * 1024 + 64] for k, f in enumerate(r.keyframes))


def test_private_data(spark, docs, empty):
    rows = [
        (1, "Mr. John Smith wrote to a.b@x.org; call +1 (743) 555-3824 or (743) 555-3824, 10.2.3.4."), (2, "card 4111 1111 1111 1111 and password=abc123def token 0123456789abcdef0123456789abcdef"),
        (3, "A.B@X.ORG again, release 1.2 of 2024"), (4, None), (5, ""), (6, "clean text"), (1, "clean text"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_pii", F.lit("clash"))
    got = {(r.doc_id, r.n_pii): r.text for r in pii.replace(df, "key").collect()}
    one, two, three = got[1, 5], got[2, 3], got[3, 1]
    for secret in ("Smith", "a.b@x.org", "743) 555-3824", "10.2.3.4"):
        assert secret not in one
    phones = re.findall(r"\((\d{3})\) (\d{3}-\d{4})", one)
    assert len(phones) == 2 and phones[0] == phones[1] and "+1 (" in one and one.startswith("Mr. ")
    assert re.search(r"\S+@\S+\.org", one)[0].lower() == re.search(r"\S+@\S+\.ORG", three)[0].lower()
    card = re.search(r"card ([\d ]+) and", two)[1].replace(" ", "")
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(card))) % 10 == 0
    assert "password=" in two and "abc123def" not in two and three.endswith("release 1.2 of 2024")
    assert (got[4, 0], got[5, 0], got[6, 0], got[1, 0]) == (None, "", "clean text", "clean text")
    assert pii.replace(empty, "k").count() == 0


def test_each_type_alone_keeps_its_row(spark):
    """A row whose only entity is of one type is neither lost nor left as it was."""
    found = {
        "email": "el.00@mail8.example.com", "token": "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "secret": "password=e9b9ed9cc9999999d9", "iban": "DE89 3704 0044 0532 0130 00", "ip": "233.233.171.252",
        "phone": "+1 (743) 555-3824", "ssn": "123-45-6789", "number": "4041894974608795", "name": "Frau Müller",
    }
    df = spark.createDataFrame([(k, f"one {v} two") for k, v in enumerate(found.values())], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(df, "key").collect()}
    assert [got[k].pii_types for k in range(len(found))] == list(found)
    for k, v in enumerate(found.values()):
        assert v not in got[k].text and got[k].text.startswith("one ") and got[k].text.endswith(" two") and got[k].n_pii == 1


def test_surrogates_stay_distinct_when_they_collide(spark):
    df = spark.createDataFrame([(k, f"see #{k:02d} and #{k * 7 % 25:02d}.") for k in range(25)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace(df, "k", {"code": r"#\d{2}"}, "#").collect()}
    made = {}
    for k, t in out.items():
        for old, new in zip((f"#{k:02d}", f"#{k * 7 % 25:02d}"), re.findall(r"#\d\d", t), strict=True):
            assert made.setdefault(old, new) == new
    assert len(set(made.values())) == 25 and not set(made) & set(made.values())


def test_whole_entities_of_many_formats(spark):
    """Nothing of a long entity stays, and each format is found with its own type."""
    rng = random.Random(12)
    long = lambda n, of="abcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(of) for _ in range(n))
    found = [("secret", k, v) for k, v in [("password=", long(100)), ("API_KEY=", long(20)), ("Password: ", long(12)), ("api-key = ", long(12)), ('"secret": "', long(12)), ("pwd:", long(9))]]
    found += [("token", "", v) for v in (long(200, "0123456789abcdef"), long(160, "0123456789ABCDEF"), "sk-" + long(150), "ghp_" + long(90))]
    found += [("email", "", long(90) + "@mail.example.com"), ("email", "", "a@" + "b." * 12 + "example.org")]
    found += [("phone", "", v) for v in ("555-123-4567", "555.123.4567", "(555)123-4567", "+49 30 1234567", "+33 6 12 34 56 78", "+34 612 345 678", "+7 495 123-45-67", "06 12 34 56 78", "030 1234567", "8 (495) 123-45-67", "+14155552671")]
    found += [("number", "", "3782 822463 10005"), ("number", "", "3782-822463-10005")]
    df = spark.createDataFrame([(k, f"one {a}{v} two") for k, (_, a, v) in enumerate(found)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(df, "key").collect()}
    for k, (kind, a, v) in enumerate(found):
        text, types, n = got[k].text, got[k].pii_types, got[k].n_pii
        assert (types, n) == (kind, 1), (v, types, n)
        assert text.startswith(f"one {a}") and text.endswith(" two") and len(text) == len(f"one {a}{v} two") and v[-20:-12] not in text[4:] or len(v) < 30
        assert v not in text


def test_names_keep_their_parts(spark):
    """One family name for a person with and without a given name; different people stay different; titles and scripts."""
    old = ["Mr. John Smith", "Mr. Smith", "Mr. Carl Smith", "Mrs. Alex Kim", "Mr. Alex Kim", "Dr. Karl Braun", "Prof. Dr. Anna Braun", "Herr Müller-Weber", "Госпожа Анна Белова", "Frau Ölmann"]
    df = spark.createDataFrame([(k, f"so {e}, now") for k, e in enumerate(old)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replace(df, "key").collect()}
    made = [rows[k].text.removeprefix("so ").removesuffix(", now") for k in range(len(old))]
    family = [m.split()[-1] for m in made]
    assert family[0] == family[1] == family[2] and family[3] == family[4] and family[5] == family[6]
    assert len({family[0], family[3], family[5], family[7], family[8], family[9]}) == 6 and len(set(made)) == len(old)
    assert [m.split()[0] for m in made] == [o.split()[0] for o in old] and made[6].startswith("Prof. Dr. ") and made[8].split()[1].split("-")[0] in pii.FEMALE_CYRILLIC.split()
    assert [len(m.split()) for m in made] == [len(o.split()) for o in old] and all(rows[k].pii_types == "name" for k in rows)
    assert not {w for o in old for w in o.split() if w[0].isupper() and not w.endswith(".")} & {w for m in made for w in m.split()[1:]}


def test_addresses_of_all_scripts(spark):
    old = ["jörg.müller@example.org", "иван@почта.рф", "2001:db8:0:1:1:1:1:1", "fe80::1ff:fe23:4567:890a", "password=密码密码密码1"]
    df = spark.createDataFrame([(k, f"see {e} now at 10:20:30 in std::map") for k, e in enumerate(old)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replace(df, "key").collect()}
    assert [rows[k].pii_types for k in range(5)] == ["email", "email", "ip", "ip", "secret"] and all(r.n_pii == 1 for r in rows.values())
    for k, e in enumerate(old):
        part = re.split("[@=]", e)[-1 if k == 4 else 0]
        assert part not in rows[k].text and rows[k].text.endswith(" now at 10:20:30 in std::map")
    assert "müller" not in rows[0].text and rows[0].text.startswith("see ") and rows[0].text.split()[1].endswith("@example.org")
    assert len(rows[2].text.split()[1].split(":")) == 8


def test_surrogates_never_run_out(spark):
    """More names than the lists hold, all one-letter mailboxes of a domain, and secrets without a letter."""
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)).title() for _ in range(1000)})
    cyrillic = sorted({"".join(rng.choice(pii._LOWER_CYRILLIC) for _ in range(7)).title() for _ in range(200)})
    old = [f"Frau {n}" for n in names] + [f"Господин {n}" for n in cyrillic] + [f"{c}@example.com" for c in "abcdefghijklmnopqrstuvwxyz"] + ["password=******", "password=------"]
    df = spark.createDataFrame([(k, f"see {e}, now") for k, e in enumerate(old)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace(df, "k").collect()}
    made = [out[k].removeprefix("see ").removesuffix(", now") for k in range(len(old))]
    assert len(set(map(str.lower, made))) == len(old) == 1228 and not {x.lower() for x in made} & {x.lower() for x in old}
    assert all(m.startswith(o.split()[0] + " ") for m, o in zip(made, old, strict=True) if " " in o) and all(m.endswith("@example.com") for m in made[1200:1226])


def test_slices_of_code_are_no_addresses(spark):
    old = [f"take x[{a}::{b}] of it" for a in range(10) for b in range(10)] + ["x[1000::2] and a::b1", "std::f4::g", "[2001:db8::1]", "fe80::1", "64:ff9b::a1"]
    df = spark.createDataFrame(list(enumerate(old)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(df, "k").collect()}
    assert all(out[k].text == old[k] and out[k].n_pii == 0 for k in range(102))
    assert all(out[k].pii_types == "ip" and out[k].text != old[k] for k in range(102, 105)) and out[102].text.startswith("[") and out[102].text.endswith("]")


def test_dense_types_grow(spark):
    """All link addresses of one digit after one prefix, and all codes of a caller's own pattern."""
    old = [f"#{k:02d}" for k in range(100)]
    out = [r.text for r in pii.replace(spark.createDataFrame([(k, f"see {e}.") for k, e in enumerate(old)], "doc_id long, text string"), "k", {"code": r"#\d{2}"}, "#").collect()]
    assert len(set(out)) == 100 and not {f"see {e}." for e in old} & set(out)
    six = spark.createDataFrame([("f00d::1", "ip", "f00d::1", 7)], "e string, type string, norm string, attempt int")
    assert re.fullmatch(r"[0-9a-f]{4}(:[0-9a-f]{4}){7}", pii.with_surrogates(six, "k").first().made)


def test_secrets_of_signs_and_long_entities(spark):
    """Signs do not stay in clear; millions of characters in one entity are replaced in linear time, with their type, case and length."""
    rng = random.Random(4)
    dump = lambda n, of: "".join(rng.choices(of, k=n))
    old = {0: "password=!@#$%^&*()", 1: "password=******", 2: dump(4_000_000, "0123456789abcdef"), 3: dump(1000, "0123456789ABCDEF"), 4: "password=" + dump(200_000, "abcXYZ019-_"), 5: dump(50_000, "ab1") + "@mail.example.com"}
    df = spark.createDataFrame([(k, f"one {e} two") for k, e in old.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(df, "k").collect()}
    kinds = ["secret", "secret", "token", "token", "secret", "email"]
    for k, e in old.items():
        new = out[k].text.removeprefix("one ").removesuffix(" two")
        assert out[k].pii_types == kinds[k] and len(new) == len(e)
        a, b = (x.removeprefix("password=") for x in (e, new))
        # About as many characters stay as chance has it, and no run of them.
        assert sum(x == y for x, y in zip(a, b, strict=True)) <= max(3, 0.45 * len(a)) and a[:40] not in b and a[-60:-30] not in b or k < 2
    assert re.fullmatch("password=[" + re.escape(pii._SIGNS) + "]{10}", out[0].text.split()[1]) and "!@#" not in out[0].text and "***" not in out[1].text
    assert re.fullmatch("[0-9a-f]+", out[2].text.split()[1]) and re.fullmatch("[0-9A-F]+", out[3].text.split()[1]) and re.fullmatch("[a-z0-9]{50000}@[a-z]{4}.example.com", out[5].text.split()[1])


def test_language(spark, docs, empty):
    words = {"en": "the of and that with from this there".split(), "de": "der und nicht mit eine auch zwischen über".split(), "fr": "le que dans pour être français où mais".split()}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([4, 30, 200]))), lang) for k, lang in enumerate(rng.choices(list(words), k=240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 4 <> 2"), landmarks=24)
    got = language.identify(df, model).where("doc_id % 4 = 2").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "日本")], "doc_id long, text string"), model).collect()}
    assert [odd[k] for k in (1, 2, 3)] == ["und"] * 3 and odd[4] != "und"
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(df.limit(3), language.fit(df.where("false"))).collect()} == {"und"}


def test_kernel_is_the_normalised_intersection():
    data, off = common.column_bytes(__import__("pyarrow").array(["abc", "abcd", ""]))
    bits = language.presence(data, off)
    a, b = (set(np.flatnonzero(x)) for x in bits[:2])
    assert language.kernel(bits, bits[:1])[1, 0] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5)


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([10, 40, 120]))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "clown", "grumbo"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab.where("doc_id % 3 <> 0"))
    got = toxicity.score(df, model).join(lab.where("toxic is not null"), "doc_id").where("doc_id % 3 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    nulls = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "doc_id long, text string, score string")
    a, b = toxicity.score(nulls, model).collect()
    assert a.score == b.score and toxicity.score(empty, model).count() == 0
    assert toxicity.score(df.limit(2), toxicity.fit(df, lab.where("false"))).first().score == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    _, f = toxicity.isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-x))).astype(float), np.ones(300))
    assert (np.diff(f) >= 0).all()


def test_lm_scores(spark, docs, empty):
    v = lm_score.Vocabulary(lm_score.count_words(docs))
    got = {r.doc_id: r for r in lm_score.score(docs, v, lm_score.train(docs, v)).collect()}
    assert len(got) == docs.count() and got[0].n_words == 0 and got[0].log_prob == 0 and got[0].mean_log_prob is None
    assert all(r.log_prob < 0 for r in got.values() if r.n_words)
    # Learned structure: a text of a repeated pattern is likelier after training than its shuffled words.
    rng = random.Random(6)
    line = "red green blue one two three".split()
    shuffled = [rng.sample(line * 5, 30) for _ in range(20)]
    df = spark.createDataFrame([(k, " ".join(line * 40)) for k in range(200)] + [(1000 + k, " ".join(s)) for k, s in enumerate(shuffled)], "doc_id long, text string").repartition(2)
    v = lm_score.Vocabulary(lm_score.count_words(df))
    out = lm_score.score(df, v, lm_score.train(df, v))
    assert out.where("doc_id < 1000").agg(F.avg("mean_log_prob")).first()[0] > out.where("doc_id >= 1000").agg(F.avg("mean_log_prob")).first()[0] + 0.2
    assert lm_score.score(empty, v, lm_score.Network()).count() == 0


def test_lm_holds_every_word(spark):
    """Two words that share an id of the network are told apart by their counts, and the shares of an id sum to one."""
    rng = random.Random(8)
    names = [f"n{k}" for k in range(3000)]
    words = names + [names[0]] * 40
    rng.shuffle(words)
    rows = [(None if k == 3 else k, " ".join(words[k * 40 : k * 40 + 40])) for k in range(76)] + [(500, "n0"), (500, "n0"), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    v, net = lm_score.Vocabulary(lm_score.count_words(df), rest=256), lm_score.Network()
    n = collections.Counter(w for _, t in rows for w in (t or "").split())
    own = {int(x) for x in v.names}
    powers, share, want = [], collections.Counter(), collections.Counter()
    data, off = common.column_bytes(__import__("pyarrow").array(list(n)))
    hashed = dict(zip(n, (int(x) for x in common.word_hashes(data, off[:-1], off[1:])), strict=True))
    for w, k in n.items():
        if hashed[w] not in own:
            share[hashed[w] % v.rest] += k
    assert [v.counts[lm_score.VOCABULARY - v.rest + k] for k in range(v.rest)] == [share[k] for k in range(v.rest)]
    for i, t in rows:
        d, o = common.column_bytes(__import__("pyarrow").array([t or ""]))
        word, context, _, _ = lm_score.places(d, o, v.names, v.ids, v.rest, powers)
        order = np.argsort(word, kind="stable")
        total = float(net.forward(context[order], word[order]).sum()) if len(word) else 0.0
        total += sum(np.log(n[w] / share[hashed[w] % v.rest]) for w in (t or "").split() if hashed[w] not in own)
        want[i, len(word), round(total, 2)] += 1
    for known in (0, 1200, 10_000):  # none, some and all of the counts are sent to the tasks
        some = lm_score.Vocabulary(lm_score.count_words(df), rest=256, known_words=known)
        assert len(some.known[0]) <= known and (known == 0 or len(some.known[0]) > 0)
        got = collections.Counter((r.doc_id, r.n_words, round(r.log_prob, 2)) for r in lm_score.score(df, some, net).collect())
        assert {k[:2] for k in got} == {k[:2] for k in want} and sum(got.values()) == len(rows)
        assert all(abs(a[2] - b[2]) < 0.02 for a, b in zip(sorted(got.elements(), key=str), sorted(want.elements(), key=str), strict=True))
    # For one context the probabilities of all words of the corpus sum to one.
    ids = np.arange(lm_score.VOCABULARY, dtype=np.uint16)
    p_id = np.exp(net.forward(np.zeros((len(ids), 4), np.uint16), ids))
    own_ids = dict(zip((int(x) for x in v.names), v.ids.tolist(), strict=True))
    total = sum(p_id[own_ids[hashed[w]]] if hashed[w] in own else p_id[lm_score.VOCABULARY - v.rest + hashed[w] % v.rest] * k / share[hashed[w] % v.rest] for w, k in n.items())
    empty_ids = sum(p_id[lm_score.VOCABULARY - v.rest + k] for k in range(v.rest) if not share[k]) + sum(p_id[k] for k in range(lm_score.VOCABULARY - v.rest) if k not in set(v.ids.tolist()))
    assert total + empty_ids == pytest.approx(1, abs=1e-4)
    out = lm_score.score(spark.createDataFrame([(1, names[0]), (2, "n2999")], "doc_id long, text string"), lm_score.Vocabulary(lm_score.count_words(df), rest=lm_score.VOCABULARY), net)
    a, b = (r.log_prob for r in out.orderBy("doc_id").collect())
    assert n["n0"] == 43 and a != b


def test_word_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"alpha beta alpha", np.uint8)
    start, end, _ = common.words(data, np.array([0, len(data)]), common.NOT_SPACE)
    h = common.word_hashes(data, start, end)
    assert h[0] == h[2] != h[1] and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
