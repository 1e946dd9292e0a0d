"""The operators on small tables: brute force, round trips, and odd rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from larkspur.llm import common, components, fingerprint, html, lm, media, mixing, neardup, packing, quality, toxicity, training_order, wordhash
from larkspur.llm.eliasfano import EliasFano, from_buffer, to_bytes
from larkspur.llm.tokens import part_ids

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, _size int"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows(texts, first=0):
    """Documents with extra columns whose names clash with the operators' own."""
    return [(i + first, t, "en", f"s{i % 3}", None, "x", 0.5, 7) for i, t in enumerate(texts)]


ODD = [(None, "some text here with words", None, None, None, None, None, None), (1, None, "en", "s", 0, "", 0.0, 1), (2, "", "en", "s", 0, "", 0.0, 1), (3, " \t\n ", "en", "s", 0, "", 0.0, 1), (4, "one two", "en", None, 7, "", 0.0, 1), (4, "one two", "en", None, 7, "", 0.0, 1),
       (5, "x " * 30000, "en", "s", 60000, "", 0.0, 1), (6, "\x00 <|endoftext|> é 𝒜", "en", "s", 9, "", 0.0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    base = [prose(r, r.randint(30, 90)) for _ in range(25)]
    texts = list(base)
    for t in base[:12]:
        for edits in (1, 2, 6):
            ws = t.split()
            for _ in range(edits):
                ws[r.randrange(len(ws))] = r.choice(WORDS)
            texts.append(" ".join(ws))
    texts += [base[0]] * 5 + [base[1].upper(), "a b c", "a b c", "a b d"]
    return spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    ws = text.lower().split() if text else []
    return {" ".join(ws)} if 0 < len(ws) < 5 else {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute_components(pairs, percent):
    sets = {i: shingle_set(t) for i, t in pairs}
    at = {i: i for i in sets}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, percent):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent).collect()}
    assert got == want


def test_near_duplicates_in_blocks(docs, monkeypatch):
    """Keys split over blocks of two and families of none give the same components."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "DENSE", 2)
    monkeypatch.setattr(neardup, "FAMILY", 0)
    monkeypatch.setattr(neardup, "HELD", 100)
    monkeypatch.setattr(neardup, "LEADS", 2)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 85).collect()}
    assert got == want


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """Under one hot key, near copies without a candidate in their own blocks are found."""

    def one_key(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0] * b.num_rows, pa.int64()), b.column(0)], ["key", "node"])

    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "DENSE", 8)
    monkeypatch.setattr(neardup, "_keys", one_key)
    r = random.Random(11)
    texts = [prose(r, 80) for _ in range(60)]
    texts += [f"{t} other" for t in texts[:20]]
    pairs = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == brute_components(pairs, 85) and got[60][1] == 0


def test_near_duplicates_odd(odd, empty):
    got = [tuple(r) for r in neardup.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert (None, 1, None, False) in got and got.count((4, 1, 4, True)) == 2 and (5, 1, 5, True) in got
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == [(False, None), (True, 1), (True, 2), (True, 3), (True, 4), (True, 5), (True, 6)]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_signature_pigeonhole():
    """Any two signatures under the threshold share a key."""
    r = np.random.default_rng(0)
    for _ in range(200):
        a = r.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = r.permutation(neardup.SYMBOLS)[: neardup.THRESHOLD]
        b[at] ^= 1
        sigs = [x.tobytes() for x in (a, b)]
        batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"b"]), pa.array(sigs, pa.binary())], ["node", "sig"])
        out = next(neardup._keys(iter([batch])))
        keys = {n: {k for k, m in zip(*(c.to_pylist() for c in out.columns)) if m == n} for n in (b"a", b"b")}
        assert keys[b"a"] & keys[b"b"]


def test_prefixes_meet():
    """Two sets that are similar enough share a shingle that the larger looks with and the smaller is found by, under any order."""
    r = np.random.default_rng(5)
    for _ in range(300):
        percent = int(r.choice([80, 85, 90]))
        common, extra = int(r.integers(1, 60)), r.integers(0, 8, 2)
        s = r.permutation(np.unique(r.integers(1, 1 << 63, common + int(extra.sum()), dtype=np.uint64)))
        x, y = np.sort(s[: common + extra[0]]), np.sort(np.r_[s[:common], s[common + extra[0] :]])
        if len(x) > len(y):
            x, y = y, x
        counts = r.integers(0, 3, neardup.BUCKETS).astype(np.int32)
        (px, found), (py, _) = neardup.prefix(x, percent, counts), neardup.prefix(y, percent, counts)
        if 100 * common >= percent * len(s):
            assert np.isin(px[:found], py).any()


def test_near_duplicates_of_a_template(spark):
    """Under hot keys: thousands of texts that share most of a template, some of them near copies of others, without emitting their pairs."""
    r = random.Random(6)
    words = [f"t{i}" for i in range(150)]
    texts = [" ".join([*words, *(f"v{r.randrange(10**9)}" for _ in range(30))]) for _ in range(4000)]
    texts += [f"{t} end" for t in texts[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(df).collect()}
    assert got == {i: i - 4000 if i >= 4000 else i for i in range(len(texts))}


def test_mixing(spark, empty, odd):
    r = random.Random(1)
    data = [(i, prose(r, r.randint(1, 40)), "en", s, 0, "", 0.0, 0) for i, s in enumerate(["big"] * 150 + ["mid"] * 60 + ["few"] * 5 + [None] * 12)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(df).collect()
    size = {}
    for x in got:
        size[x.source] = size.get(x.source, 0) + x._size
        assert x._size == len(x.text.split()) and 0 <= x._copies <= 2
    weights = dict(zip(sorted(k for k in size if k) + [None], (5, 2, 1, 5)))
    total, target, full = 1.5 * sum(size.values()), {}, set()
    while True:  # clamp, share the rest again, until none is above
        left = total - sum(2 * size[k] for k in full)
        w = sum(weights[k] for k in size if k not in full)
        target = {k: 2.0 * size[k] if k in full else left * weights[k] / w for k in size}
        over = {k for k in size if k not in full and target[k] > 2 * size[k]}
        if not over:
            break
        full |= over
    for k in size:
        mine = [x for x in got if x.source == k]
        assert {round(x._target, 6) for x in mine} == {round(target[k], 6)}
        assert abs(sum(x._copies * x._size for x in mine) - target[k]) <= max(x._size for x in mine) / 2
    again = {x.doc_id: x._copies for x in mixing.mix(df.repartition(7)).collect()}
    assert again == {x.doc_id: x._copies for x in got}
    assert mixing.mix(empty).count() == 0
    assert len(mixing.mix(odd).collect()) == len(ODD)


def test_mixing_equal_rows(spark, tmp_path):
    """Of equal rows as many are taken as fit, as the SQL does row by row; columns named as the plan's do not clash."""
    import duckdb

    r = random.Random(3)
    same = [(7, "one two three four five six seven eight", "hot", 1, 2)] * 1000
    rest = [(100 + i, prose(r, r.randint(0, 30)), ["a", "b", None][i % 3], 3, 4) for i in range(200)] + [(50, "", "a", 0, 0)] * 3
    spark.createDataFrame(same + rest, "doc_id long, text string, source string, whole int, cut int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op3_mixing(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(mixing.SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(x[n] for n in names) for x in got.collect()))) == sorted(map(str, want.fetchall()))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.mix(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    for x in out.groupBy("source").agg({"_target": "max"}).collect():
        taken = sum(y._copies * y._size for y in out.collect() if y.source == x.source)
        assert abs(taken - x[1]) <= 30


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (docs, odd):
        for window in (2048, 64):
            got = packing.pack(df, window=window).collect()
            ids = {}
            for r in df.collect():
                ids.setdefault(r.doc_id, []).append(tok.encode(r.text or "", add_special_tokens=False).ids + [1])
            by_doc, by_seq = {}, {}
            for p in got:
                by_doc.setdefault(p.doc_id, []).append(p)
                by_seq.setdefault(p.sequence_id, []).append(p)
                want = ids[p.doc_id][0]
                assert p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(np.array(want[p.start : p.start + p.length], "<u4").tobytes())
            for d, pieces in by_doc.items():
                cover = sorted(i for p in pieces for i in range(p.start, p.start + p.length))
                assert cover == sorted(i for x in ids[d] for i in range(len(x)))
            for pieces in by_seq.values():
                pieces.sort(key=lambda p: p.offset)
                at = 0
                for p in pieces:
                    assert p.offset == at
                    at += p.length
                assert at <= window
            assert sum(sum(p.length for p in x) < window for x in by_seq.values()) <= 1
    assert packing.pack(empty).count() == 0


def test_packing_plan():
    r = np.random.default_rng(2)
    for _ in range(20):
        hist = np.zeros(129, np.int64)
        hist[r.integers(1, 129, 20)] = r.integers(1, 500, 20)
        p = packing.plan(hist)
        assert set(p["length"].tolist()) == set(np.flatnonzero(hist).tolist())
    combos = packing.combinations(np.array([10, 54, 64, 30, 24]), 64)
    assert ([54, 10, 0, 0] in combos.tolist()) and all(c.sum() == 64 for c in combos)
    hist = np.zeros(64, np.int64)
    hist[[10, 54]] = 7
    assert packing.repeats(np.array([[54, 10, 0, 0]]), hist).tolist() == [7]


def test_training_order(docs, odd, empty, tmp_path):
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    assert training_order.feistel(np.arange(1000), 1000, 5).tolist() != training_order.feistel(np.arange(1000), 1000, 6).tolist()
    out = f"file://{tmp_path}/shards"
    run = lambda: training_order.materialise(docs, out, size=32, shard_rows=16).collect()
    got = sorted(run(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    records = training_order.read_records(out, 0, len(got), 32, 16)
    assert (training_order.read_records(out, 20, 7, 32, 16) == records[20:27]).all()
    ids = part_ids()
    total = 0
    for r, rec in zip(got, records, strict=True):
        assert (r.shard, r.record, r.byte_offset) == (r.slot // 16, r.slot % 16, r.slot % 16 * 64)
        assert r.ids_crc32 == zlib.crc32(rec[: r.n_ids].astype("<u4").tobytes())
        total += r.n_ids
    assert total == sum(len(ids.of(r.text.encode())) // 4 + 1 for r in docs.collect())
    assert {d for r in got for d in r.doc_ids} == {r.doc_id for r in docs.collect()}
    stamp = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").iterdir()}
    assert sorted(run(), key=lambda r: r.slot) == got and stamp == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").iterdir()}
    assert training_order.materialise(empty).count() == 0 and training_order.materialise(odd).count() > 0


def test_training_order_against_plain(docs, tmp_path, monkeypatch):
    """Every slot holds the ids that a plain permutation of the plainly cut sequences gives it, however many shards a range has."""
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    one = docs.coalesce(1)
    stream = [i for r in one.collect() for i in [*tok.encode(r.text or "", add_special_tokens=False).ids, training_order.END]]
    seqs = [stream[i : i + 32] for i in range(0, len(stream), 32)]

    def slot(i, n, key):
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            left, right = i >> half, i & ((1 << half) - 1)
            for k in common.mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64))).tolist():
                left, right = right, left ^ (int(common.mix64(np.array([(right + k) % (1 << 64)], np.uint64))[0]) & ((1 << half) - 1))
            i = left << half | right
            if i < n:
                return i

    out = f"file://{tmp_path}/plain"
    got = training_order.materialise(one, out, size=32, key=99, shard_rows=3).collect()
    assert len(got) == len(seqs) and len(list((tmp_path / "plain").iterdir())) == -(-len(seqs) // 3)
    records = training_order.read_records(out, 0, len(seqs), 32, 3)
    for i, ids in enumerate(seqs):
        assert records[slot(i, len(seqs), 99)].tolist() == ids + [training_order.PAD] * (32 - len(ids))


def test_training_order_again(docs, tmp_path):
    """Shards of another key in the same folder are replaced."""
    out = f"file://{tmp_path}/shards"
    for key in (1, 2):
        got = sorted(training_order.materialise(docs, out, size=32, key=key, shard_rows=16).collect(), key=lambda r: r.slot)
    fresh = f"file://{tmp_path}/fresh"
    want = sorted(training_order.materialise(docs, fresh, size=32, key=2, shard_rows=16).collect(), key=lambda r: r.slot)
    assert got == want and (training_order.read_records(out, 0, len(got), 32, 16) == training_order.read_records(fresh, 0, len(got), 32, 16)).all()


def test_fingerprints(docs, odd, empty):
    def sketch(text):
        h = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)))[0] for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        if not h:
            return []
        if len(h) < 5:
            g = [xxhash.xxh64_intdigest(" ".join(map(str, h)).encode(), 42)]
        else:
            g = []
            for i in range(len(h) - 4):
                seed = 42
                for x in h[i : i + 5]:
                    seed = long_hash(x, seed)
                g.append(seed)
        signed = [x - (1 << 64) if x >= 1 << 63 else x for x in g]
        if len(h) >= 5:
            kept = [x for x in signed if 0 <= x < fingerprint.LIMIT]
            signed = kept or [min(signed)]
        return sorted(set(signed))

    def long_hash(x, seed):
        return xxhash.xxh64_intdigest(struct.pack("<q", x), seed)

    for df in (docs, odd):
        src = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
        got = sorted(fingerprint.fingerprints(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        assert len(got) == len(src)
        texts = [s[2] for s in src]
        twice = {s[1] for s in src if sum(x[:2] == s[:2] for x in src) > 1}
        for i, r in enumerate(got):
            if r.doc_id in twice:
                continue
            t, nxt = texts[i], texts[(i + 1) % len(texts)]
            k = len(t) // 4
            e = t[: len(t) - k] + nxt[:k]
            a, b, c = sketch(t), sketch(e), sketch(nxt)
            like = lambda x, y: float(x == y == []) if not x or not y else len(set(x) & set(y)) / min(len(x), len(y))
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert r.fingerprint == "".join(f"{x % (1 << 64):016X}" for x in a) and r.edited_fingerprint == "".join(f"{x % (1 << 64):016X}" for x in b)
            assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprints_over_ranges(docs, monkeypatch):
    want = sorted(map(tuple, fingerprint.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 7)
    monkeypatch.setattr(fingerprint, "QUANTILES", 4)
    assert sorted(map(tuple, fingerprint.fingerprints(docs).collect())) == want


def test_fingerprints_of_hot_ids(spark, monkeypatch):
    """Null doc_ids and one repeated doc_id are cut into ranges too, and give the same rows."""
    r = random.Random(8)
    data = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i - 40, prose(r, r.randint(0, 30))) for i in range(180)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(map(str, fingerprint.fingerprints(df).collect()))
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 10)
    monkeypatch.setattr(fingerprint, "QUANTILES", 9)
    ranged = df.withColumn("r", fingerprint._ranges(df))
    assert max(x["count"] for x in ranged.groupBy("r").count().collect()) < 40
    assert sorted(map(str, fingerprint.fingerprints(df).collect())) == want


def test_sketches_merge(spark):
    """Merged sketches are the sketch of all shingles, also where one has a stand-in."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    pairs = [(prose(r, r.randint(5, 12)), prose(r, r.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *[fingerprint.sketch(F.col(c)).alias(f"s{c}") for c in "ab"])
    rows_ = df.select("sa", "sb", fingerprint.merge(F.col("sa"), F.col("sb")).alias("m")).collect()
    inside = lambda s: [h for h in s if 0 <= h < fingerprint.LIMIT]
    assert any(not inside(x.sa) for x in rows_)
    for x in rows_:
        both = sorted(set(inside(x.sa) + inside(x.sb)))
        assert x.m == (both or [min(x.sa + x.sb)])


def test_components(spark):
    """Few edges are united by a bounded number of stages, and as the rounds unite them."""
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 7), (9, None), (301, 300), (301, 300)]
    df = spark.createDataFrame([tuple(None if x is None else f"{x:03d}".encode() for x in e) for e in edges], "a binary, b binary")
    want: dict = {}
    for a, b in (e for e in edges if None not in e):
        own = {x for x in (a, b) for x in (want.get(x) or {x})}
        want |= dict.fromkeys(own, own)
    want = {x: min(own) for x, own in want.items()}
    root = lambda few: sorted((int(x.node), int(x.root)) for x in components.components(df, few=few).collect())
    tracker = spark.sparkContext.statusTracker()
    for few in (components.FEW, 0):
        spark.sparkContext.setJobGroup(f"components-{few}", "")
        assert root(few) == sorted(want.items())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [len(tracker.getJobIdsForGroup(f"components-{few}")) for few in (components.FEW, 0)]
    assert jobs[0] <= 12 < jobs[1]
    assert components.components(df.limit(0)).count() == 0


def test_media(docs, odd, empty):
    for df in (docs, odd):
        for r, d in zip(sorted(media.stored(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id)), sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))):
            b = (d.text or "").encode()
            p = b + b"\xff" * (576 - len(b) if not b else -len(b) % 576)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            w = media.store_wav(p)
            assert (r.media_bytes, r.media_sha256) == (len(w), hashlib.sha256(w).hexdigest()) and r.feature.startswith("audio/wav;corrected=1")
    assert media.stored(empty).count() == 0


def test_media_inside_texts(spark):
    """What a text holds is in its feature: as what it begins with, and further in with its place; headers alone are nothing."""
    pdf = "%PDF-1.4\nx\nstartxref\n9\n%%EOF"
    wav = media.store_wav(b"abcd").decode()
    texts_ = [pdf, "é " + wav + " and " + pdf, wav + pdf, "BM RIFF GIF8 %PDF-1.4 alone", None]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = [r.feature.partition(";content=")[2] for r in sorted(media.stored(df).collect())]
    n, m = len(wav), len(pdf)
    other = "application/octet-stream;embedded="
    assert got == ["application/pdf;embedded=0", f"{other}2;audio/wav@3+{n};application/pdf@{3 + n + 5}+{m}", f"audio/wav;embedded=1;application/pdf@{n}+{m}", f"{other}0", f"{other}0"]


def test_sniffing(spark):
    import gzip
    import io
    import zipfile

    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d)) for n, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<iiHHIIiiII", 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    gif = b"GIF89a\x01\0\x01\0\0\0\0" + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
    jpg = b"\xff\xd8\xff\xe0\0\x04ab" + b"\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"\x12\xff\x00\x34" + b"\xff\xd9"
    pdf = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    wav, gz = media.store_wav(b"abc"), gzip.compress(b"hello" * 20)
    good = {"image/png": png, "image/bmp": bmp, "image/gif": gif, "image/jpeg": jpg, "application/pdf": pdf, "application/zip": z.getvalue(), "audio/wav": wav, "application/gzip": gz}
    finder = media.automaton()
    for kind, data in good.items():
        assert media.sniff(data, finder) == [media.Medium(kind, 0, len(data))], kind
        if kind != "application/pdf":
            assert media.sniff(b"junk BM RIFF " + data + b" tail", finder) == [media.Medium(kind, 13, len(data))], kind
        assert media.sniff(data[: len(data) // 2], finder) == [], kind
    assert media.sniff(png[:40] + b"\xff" + png[41:], finder) == []
    two = b"__" + wav + b"--" + png
    assert [m.kind for m in media.sniff(two, finder)] == ["audio/wav", "image/png"]
    rows_ = [(1, bytearray(png), "image/gif"), (2, bytearray(b"BM, plain text"), "text/plain"), (3, bytearray(two), None), (4, None, "x/y"), (5, bytearray(b""), None)]
    got = {r.id: r for r in media.sniff_column(spark.createDataFrame(rows_, "id int, data binary, type_said string"), "data", "type_said").collect()}
    assert (got[1].type, got[1].corrected) == ("image/png", True) and (got[2].type, got[2].corrected) == ("text/plain", False)
    assert [m.kind for m in got[3].media] == ["audio/wav", "image/png"] and got[4].type == "x/y" and got[5].media == []


def test_sniffing_pdfs():
    """One file with its updates and what it embeds, but not the files after it."""
    pdf = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF\n"
    updated = pdf + b"y\nstream\n" + pdf + b"endstream\nstartxref\n20\n%%EOF\n"
    wav, finder = media.store_wav(b"abc"), media.automaton()
    got = media.sniff(updated + wav + pdf + pdf, finder)
    at = len(updated) + len(wav)
    assert got == [media.Medium("application/pdf", 0, len(updated) - 1), media.Medium("audio/wav", len(updated), len(wav)), media.Medium("application/pdf", at, len(pdf) - 1), media.Medium("application/pdf", at + len(pdf), len(pdf) - 1)]


def test_sniffing_in_linear_time():
    """Many headers that lead nowhere, or all to one end, cost no more than their bytes."""
    import time

    finder = media.automaton()
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR"
    units = [b"%PDF-1.4 ", b"%PDF-1.4 startxref 1 ", b"stream\n%PDF-1.4 startxref ", b"PK\x03\x04abcdefgh", b"PK\x03\x04PK\x05\x06" + b"\x01" * 18, png, b"GIF89a" + b"\1" * 8 + b"!\1\1a", b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\4ab\xff\xda\0\4ab", b"\x1f\x8b\x08\0\0\0\0\0\0\0", b"RIFF\x40\0\0\0WAVE"]
    for unit in units:
        for tail in (b"", b"startxref 1 %%EOF"):

            def best(n, unit=unit, tail=tail):
                out = []
                for _ in range(3):
                    at = time.perf_counter()
                    media.sniff(unit * n + tail, finder)
                    out.append(time.perf_counter() - at)
                return min(out)

            assert best(16_000) < 3.2 * best(8_000) + 0.05, unit


def test_sniffing_between_files():
    """A picture between two documents is carved, and so are archives one after another."""
    import io
    import zipfile

    pdf, finder = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF", media.automaton()
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d)) for n, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IEND", b"")))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
        f.writestr("b.txt", "world")
    z = z.getvalue()
    data = pdf + b"--" + png + b"--" + pdf + z + b"-" + z
    want, at = [], 0
    for kind, part, gap in (("application/pdf", pdf, 2), ("image/png", png, 2), ("application/pdf", pdf, 0), ("application/zip", z, 1), ("application/zip", z, 0)):
        want.append(media.Medium(kind, at, len(part)))
        at += len(part) + gap
    assert media.sniff(data, finder) == want


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li><a>Menu</a></ul></nav><div id="cookie-notice"><p>We use cookies to make this long site work better for everyone</p></div>
    <main><h1>Title &lt;x&gt; &amp;amp;</h1><p><b>One<br>two</b>&nbsp; three<p>Four &#233;&#x41;<!-- <p>not</p> --> <a href=x>linked words</a>
    <form><input name=q><label>Mail</label></form><aside>Side</aside><ul><li>a<li>b</ul><div class="ad">Buy</div><section class="comments"><p>Nice post, thank you for writing it</p></section></main>
    <div class="sidebar">More of this and that</div><footer>&copy; foot</footer></body></html>"""
    assert html.main_text(page) == "Title <x> &amp; One two three Four éA linked words a b"
    assert html.main_text("<article><p>Cut off &amp") == "Cut off &" and html.main_text("<article>a<!-- open <p>b") == "a" and html.main_text('<article>x <a href="open>y') in ("x", "x y")
    plain = "<body><div class=nav><a>x</a></div><h2>Head</h2><p>" + "word " * 40 + "</p><p>Short.</p><p>" + "more " * 30 + "</p></body>"
    assert html.main_text(plain).startswith("Head word") and "Short." in html.main_text(plain) and "x" not in html.main_text(plain).split()
    rows_ = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p></p>"), (4, "u", "<" * 5000), (5, "u", "<article>" + "<div>" * 3000 + "deep"), (5, "u", "<article>" + "<div>" * 3000 + "deep")]
    got = html.extract(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 5] == ["deep", "deep"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_html_of_odd_pages():
    """Legal but unusual markup keeps its text, as a browser shows it."""
    t = html.main_text
    assert t("<article><p>One <!--> two <!-- x --> three --></p></article>") == "One two three -->"
    assert t("<html><head><title>T</title><article><p>No end of the head</p></article>") == "No end of the head"
    assert t("<title>T</title><meta charset=utf-8><article>Plain</article>") == "Plain"
    assert t('<article><h1 class="post-header">Head</h1><p class="intro">Text</p><div class="post-footer-share">Share</div></article>') == "Head Text"
    assert t("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "So x=2 holds"
    assert t("<body><h1>Short page</h1><p>One line here.</p><p>Another one.</p></body>") == "Short page One line here. Another one."
    assert t('<body><nav><a href="/">Home</a></nav><h1>Short page</h1><p>One line.</p><footer>Foot</footer>') == "Short page One line."
    assert t("<article>1 < 2 and <3 </> x</article>") == "1 < 2 and <3 x"
    assert t('<article><p title="a > b">Quoted</p><p title="open>Then</p></article>') == "Quoted Then"
    assert t("<article><svg><text>no</text></svg><p>a</p><table><tr><td>b<td>c<tr><td>d</table></article>") == "a b c d"


@pytest.mark.parametrize("part, more", [("<i>", "</p>"), ("<a \"x'", ""), ("<a b=\"", ""), ("<a b='\"", ">"), ("<div class=x>", "</b>"), ("<b><div>", "</b>"), ("<p><span>", "</li>"), ("<li>", "<td>"), ("<!--", "-"), ("</", ">"), ("<h", "<"), ("&", "x"), ("<style>", "</styl>"), ("<a class", " ")])
def test_html_in_linear_time(part, more):
    import time

    def best(n):
        page = "<article>text " + part * n + more * n
        out = []
        for _ in range(3):
            at = time.perf_counter()
            html.main_text(page)
            out.append(time.perf_counter() - at)
        return min(out)

    assert best(16_000) < 3.2 * best(8_000) + 0.05


@pytest.mark.parametrize("n, top", [(0, 10), (1, 1), (500, 500), (500, (1 << 64) - 1), (3000, 7)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = EliasFano.from_arrays(from_buffer(to_bytes(EliasFano.of(v, top).arrays())))
    q = np.concatenate([v, r.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    assert (e.values() == v).all() and (e.lower_bound(q) == np.searchsorted(v, q)).all()
    assert ((e.find(q) >= 0) == np.isin(q, v)).all()


def test_word_hashes(monkeypatch):
    r = random.Random(2)
    for _ in range(100):
        monkeypatch.setattr(wordhash, "PIECE", r.choice([5, 64, 1 << 20]))
        t = [r.choice([None, "", " ", "".join(r.choice("ab Ç\n\t\x0b\x1c\xa0XY") for _ in range(r.randint(0, 60)))]) for _ in range(r.randint(0, 9))]
        h, c = wordhash.hash_texts(pa.array(["zz", *t, "q"], pa.string())[1:-1])
        words = [common.words(x.encode()) if x else [] for x in t]
        assert c.tolist() == [len(w) for w in words] and h.tolist() == [wordhash.hash_word(x) for w in words for x in w]


def test_language_model(spark, docs, odd, empty):
    """Against counts and probabilities worked out plainly, and each context's probabilities sum to one at most."""
    import math
    from collections import Counter

    m = lm.train(docs.select("doc_id", "text"), least=2)
    texts = [(r.text or "").lower().split() for r in docs.collect()]
    uni, bi, tri = Counter(), Counter(), Counter()
    for ws in texts:
        seq = ["<s>", *ws, "</s>"]
        uni.update(seq[1:])
        bi.update(zip(seq, seq[1:]))
        tri.update(zip(seq, seq[1:], seq[2:]))
    n, v = sum(uni.values()), len(uni)
    assert (m.tokens, m.types, m.docs) == (n, v, len(texts))
    bi, tri = {k: c for k, c in bi.items() if c > 1}, {k: c for k, c in tri.items() if c > 1}
    assert [x.n for x in m.levels] == [v, len(bi), len(tri)]
    of = lambda c, order: c - m.discounts[order][min(c, 3) - 1]
    count = lambda w: len(texts) if w == "<s>" else uni[w]

    def p(u, a, w):
        out = (uni[w] + 1) / (n + v + 1)
        if a == "<s>" or a in uni:
            kept = sum(of(c, 0) for (x, _), c in bi.items() if x == a) / count(a)
            out = (1 - kept) * out + (of(bi[a, w], 0) / count(a) if (a, w) in bi else 0)
        if u is not None and (u, a) in bi:
            kept = sum(of(c, 1) for (x, y, _), c in tri.items() if (x, y) == (u, a)) / bi[u, a]
            out = (1 - kept) * out + (of(tri[u, a, w], 1) / bi[u, a] if (u, a, w) in tri else 0)
        return out

    new = spark.createDataFrame([(1, "w1 w2 w3 zzz w4 w1 w2"), (2, None), (3, " ".join(texts[0]).upper()), (None, "zzz zzz")], "doc_id long, text string")
    for r, t in zip(sorted(lm.score(new, m).collect(), key=lambda r: r.doc_id or 0), ("zzz zzz", "w1 w2 w3 zzz w4 w1 w2", "", " ".join(texts[0]))):
        seq = ["<s>", *t.split(), "</s>"]
        want = sum(math.log10(p(seq[i - 2] if i > 1 else None, seq[i - 1], seq[i])) for i in range(1, len(seq)))
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in seq[1:])
        assert r.n_tokens == len(seq) - 1 and abs(r.base_score - base) < 1e-6 and abs(r.score - want) < 1e-3 * len(seq)
        assert r.n_known == sum(uni[w] > 0 for w in seq[1:])
    total = sum(p(None, "w1", w) for w in uni) + p(None, "w1", "unseen")
    assert abs(total - 1) < 1e-9
    assert lm.score(odd, m).count() == len(ODD) and lm.score(empty, m).count() == 0
    nothing = lm.train(empty.select("doc_id", "text"))
    assert all(r.score == 0 and r.train_tokens == 0 for r in lm.score(odd, nothing).collect())


def test_language_model_logarithms():
    """Rounded down by little, as far as the rarest pair after a word met 10^12 times; nothing stored becomes 0."""
    p = 10.0 ** -np.arange(0, 15.5, 0.01)
    back = lm.expand(lm.quantise(p))
    assert (back <= p * (1 + 1e-9)).all() and (back > p * 0.999).all()
    assert (lm.expand(lm.quantise(np.array([1.1 / 1e12, 1e-20, 0.0]))) > 0).all()


def test_language_model_of_all_pairs(spark, tmp_path):
    """op4_lm holds every pair and triple, and a held-out text gets credit for those that training has once."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    r = random.Random(7)
    texts = [prose(r, 40) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held", common.row_mod("doc_id", 7) == 2)
    held = {x.doc_id: x.held for x in table.collect()}
    first = next(i for i in held if not held[i])
    texts = [texts[first] if held[i] else t for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    train = [t.split() for i, t in enumerate(texts) if not held[i]]
    uni, bi, tri = Counter(), Counter(), Counter()
    for ws in train:
        seq = ["<s>", *ws, "</s>"]
        uni.update(seq[1:])
        bi.update(zip(seq, seq[1:]))
        tri.update(zip(seq, seq[1:], seq[2:]))
    m = lm.train(df.where(~F.col("doc_id").isin([i for i in held if held[i]])), least=1)
    assert [x.n for x in m.levels] == [len(uni), len(bi), len(tri)]
    n, v, count = sum(uni.values()), len(uni), uni | Counter({"<s>": len(train)})
    of = lambda c, order: c - m.discounts[order][min(c, 3) - 1]
    seq, want = ["<s>", *texts[first].split(), "</s>"], 0.0
    for i in range(1, len(seq)):
        u, a, w = seq[i - 2] if i > 1 else None, seq[i - 1], seq[i]
        p = (1 - sum(of(c, 0) for (x, _), c in bi.items() if x == a) / count[a]) * (uni[w] + 1) / (n + v + 1) + of(bi[a, w], 0) / count[a]
        if u:
            p = (1 - sum(of(c, 1) for (x, y, _), c in tri.items() if (x, y) == (u, a)) / bi[u, a]) * p + of(tri[u, a, w], 1) / bi[u, a]
        want += math.log10(p)
    got = [x.score for x in lm.op4_lm(spark, str(tmp_path)).where("held_out").collect()]
    assert got and all(abs(x - want) < 1e-3 * len(seq) for x in got)


def test_toxicity_against_plain_loops():
    """Scores by plain sums over words, filters and positions, and a worker's table is that of the model it scores with."""
    r = random.Random(2)
    sample = [(" ".join([*prose(r, 12).split(), *(["grubble"] if i % 2 else [])]).encode(), i % 2, None) for i in range(60)]
    a, b = toxicity.fit(sample, (30, 30)), toxicity.fit([(t, 1 - y, x) for t, y, x in sample], (30, 30), seed=8)
    texts_ = [b"grubble w1 w2", b"", b"w3", b"W1 w2 " + b"x" * 500]

    def plain(m, text):
        rows_ = [sum(m.E[i] for i in toxicity.parts(w)) for w in text.split()] or [m.E[0]]
        out, c = float(m.base[0]), 0
        zero = np.zeros(toxicity.DIM)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                top = max(sum(float(np.dot((rows_ + [zero] * 2)[i + j], m.W[:, c + j * toxicity.FILTERS + f])) for j in range(width)) for i in range(len(rows_)))
                out += max(0.0, top + float(m.bias[k * toxicity.FILTERS + f])) * float(m.out[k * toxicity.FILTERS + f])
            c += width * toxicity.FILTERS
        return 1 / (1 + np.exp(-out))

    for m in (a, b, a):
        assert np.allclose(m.score(texts_), [plain(m, t) for t in texts_], atol=1e-4)
    del b
    for seed in range(3):  # models at whatever addresses are free
        assert np.allclose(toxicity.fit(sample, (30, 30), epochs=1, seed=seed).score(texts_), [plain(toxicity.fit(sample, (30, 30), epochs=1, seed=seed), t) for t in texts_], atol=1e-4)


def test_quality_against_plain_loops():
    """The forward pass, passage by passage."""
    r = random.Random(2)
    m = quality.Model()
    texts_ = [prose(r, n).encode() for n in (1, 64, 65, 200)] + [b"", b"y" * 900]
    x, first = quality.encode(texts_, quality.WordStats())
    got = m.score(texts_, quality.WordStats())
    for d, (a, b) in enumerate(zip(first, [*first[1:], len(x)])):
        h = [np.tanh(row @ m.p["A"] + m.p["a"]) for row in x[a:b]]
        e = [float(((np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"])))) @ m.p["w"])[0]) for v in h]
        weight = np.exp(e) / np.exp(e).sum()
        z = sum(w * v for w, v in zip(weight, h))
        assert abs(got[d] - 1 / (1 + np.exp(-(z @ m.p["c"] + m.p["b"])[0]))) < 1e-5
    assert [len(t.split()) for t in texts_] == [1, 64, 65, 200, 0, 1] and np.diff([*first, len(x)]).tolist() == [1, 1, 2, 4, 1, 1]


def _labelled(kind):
    r = random.Random(9)
    out, labels = [], []
    for i in range(260):
        y = i % 3 == 0
        ws = prose(r, r.randint(20, 150)).split()
        if kind == "toxic" and y:
            ws[r.randrange(len(ws))] = r.choice(["grubble", "Grubbler,", "grubbling"])
        if kind == "quality" and not y:
            ws = [w.upper() + "!!" for w in ws] if i % 2 else [w for x in ws[:12] for w in [x] * 9]
        out.append((i, " ".join(ws), ["en", "de"][i % 2], "s", 0, "", 0.0, 0))
        labels.append((i, int(y), int(y)))
    return out, labels


@pytest.mark.parametrize("module, kind", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, odd, empty, module, kind):
    data, lab = _labelled(kind)
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame(lab + [(None, 1, 1), (5000, None, None), (5001, 1, 0)], "doc_id long, quality int, toxic int")
    train = labels.where("doc_id % 4 <> 0 or doc_id is null")
    got = {r.doc_id: r.score for r in module.score(docs, train).collect()}
    held = [(got[i] >= 0.5) == bool(q if kind == "quality" else t) for i, q, t in lab if i % 4 == 0]
    assert sum(held) / len(held) >= 0.95 and all(0 <= s <= 1 for s in got.values())
    assert module.score(odd, labels).count() == len(ODD) and module.score(empty, labels).count() == 0
    one = [r.score for r in module.score(odd.where("doc_id in (1, 2, 3)"), labels).collect()]
    assert len(set(one)) == 1
    assert {r.score for r in module.score(odd, labels.where("doc_id < 0")).collect()} == {0.5}
    keep = toxicity.keep_civil if kind == "toxic" else quality.keep_good
    kept = keep(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    right = {i for i, q, t in lab if (q if kind == "quality" else not t)}
    assert len(ids ^ right) <= 5


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "mixing", "packing"]
    distinct = corpus_pipeline.distinct(spark, docs, folder)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], corpus_pipeline.SIMILAR)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted({c for n, c in want.values() if n} | {i for i, (n, _) in want.items() if not n})
    mixed = corpus_pipeline.mixed(spark, docs, folder)
    copies = {r.doc_id: r._copies for r in mixing.mix(docs).collect()}
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, c in copies.items() for _ in range(c))
    # The whole run, stage by stage: what each decides is what its operator decides on what the stage before kept.
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.score >= 0.5}
    kept = docs.where(docs.doc_id.isin(list(good)))
    civil = {r.doc_id for r in toxicity.score(kept, labels).collect() if r.score < r.threshold}
    kept = [r for r in kept.collect() if r.doc_id in civil]
    want = brute_components([(r.doc_id, r.text) for r in kept], corpus_pipeline.SIMILAR)
    stay = [r for r in kept if not want[r.doc_id][0] or want[r.doc_id][1] == r.doc_id]
    copies = {r.doc_id: r._copies for r in mixing.mix(spark.createDataFrame(stay, docs.schema)).collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    ids, taken = part_ids(), {}
    for r in stay:
        taken[r.doc_id] = (len(ids.of((r.text or "").encode())) // 4 + 1) * copies[r.doc_id]
    got = {}
    for p in out:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {d: n for d, n in taken.items() if n} and 0 < len(stay) < docs.count()
