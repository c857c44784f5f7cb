import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scalecluster.llm import decontaminate, packing, rlz, sharding, simhash, tokenstore
from scalecluster.llm.textkit import NOT_SPACE, Words, shingle_hashes

from . import brute

key = lambda r: tuple((x is not None, x) if not isinstance(x, bool) else (True, x) for x in r)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


def same(a, b):
    assert sorted(a, key=key) == sorted(b, key=key)


def test_words_and_shingles():
    import pyarrow as pa

    w = Words(pa.array(["Ab c", None, "", "xy", "  z\n\tq "]), NOT_SPACE, True)
    assert [w.word(i) for i in range(len(w))] == [b"ab", b"c", b"xy", b"z", b"q"]
    assert w.counts.tolist() == [2, 0, 0, 1, 2] and w.fits(2).tolist() == [0, 3]
    h = Words(pa.array(["a b a b a b"]), NOT_SPACE, True).hashes()
    s = shingle_hashes(h, 2)
    assert s[0] == s[2] and s[0] != s[1]


@pytest.fixture(scope="module")
def items(odd_docs):
    text = dict((i, t) for i, t in odd_docs if i is not None)
    return [(1, text[70]), (2, text[3]), (10, "TWO words"), (11, "one"), (12, None), (13, ""), (None, text[4]), (2, text[6]), (21, "not anywhere at all " * 4), (22, text[120][:400])]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination(spark, docs_frame, odd_docs, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_frame, bench, block_bytes=block)
    expected = brute.contamination(odd_docs, items)
    assert sum(r[5] for r in expected) > 10
    same(rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), expected)
    kept = decontaminate.remove_contaminated(docs_frame, bench, block_bytes=block)
    assert kept.columns == docs_frame.columns
    same([r[0:1] for r in rows(kept, "doc_id")], [r[0:1] for r in expected if not r[5]])


def test_contamination_of_empty_tables(spark, docs_frame, no_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(no_docs, bench).count() == 0
    got = decontaminate.contamination(docs_frame, bench.limit(0)).agg({"n_hit": "sum", "n_items": "sum"}).first()
    assert tuple(got) == (0, 0)


def test_substring_dedup(docs_frame, odd_docs):
    expected = brute.substring_dedup(odd_docs)
    assert sum(r[2] > 0 for r in expected) > 20
    same(rows(rlz.digest(docs_frame), "doc_id", "n_words", "n_removed", "kept_sha256"), expected)


def test_factors_cover_what_is_removed(docs_frame, odd_docs):
    lost = {}
    for r in rlz.factors(docs_frame.filter("doc_id <> 90 and doc_id <> 5")).collect():
        assert r.owner < r.doc_id and r.length >= 13
        lost.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    expected = {r[0]: r[2] for r in brute.substring_dedup([d for d in odd_docs if d[0] not in (90, 5, None)]) if r[2]}
    assert {k: len(v) for k, v in lost.items()} == expected


def test_factors_are_copies_of_their_blocks(docs_frame, odd_docs):
    words = {i: brute.SPACE_WORD.findall(t or "") for i, t in odd_docs if i not in (None, 5, 90)}
    found = rlz.factors(docs_frame.filter("doc_id not in (5, 90)")).collect()
    assert len(found) > 20
    for r in found:
        assert words[r.doc_id][r.start : r.start + r.length] == words[r.owner][r.owner_start : r.owner_start + r.length]


@pytest.mark.parametrize("run, combined", [(2, 1 << 21), (32, 40)])
def test_substring_dedup_whatever_is_combined(monkeypatch, docs_frame, odd_docs, run, combined):
    monkeypatch.setattr(rlz, "RUN", run)
    monkeypatch.setattr(rlz, "COMBINED", combined)
    same(rows(rlz.digest(docs_frame), "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring_dedup(odd_docs))


def test_substring_dedup_of_texts_that_share_some_of_their_runs(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    base = [r.choice(words) for _ in range(400)]
    docs = []
    for i in range(60):  # overlapping pieces, some with a word changed or a loop of one word
        a = r.randrange(360)
        text = base[a : a + r.randrange(10, 40)]
        if i % 3 == 0:
            text[r.randrange(len(text))] = "changed"
        if i % 7 == 0:
            text = text[:5] + ["loop"] * r.randrange(12, 90) + text[5:]
        docs.append((r.randrange(10**6), " ".join(text)))
    got = rows(rlz.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), "doc_id", "n_words", "n_removed", "kept_sha256")
    expected = brute.substring_dedup(docs)
    assert sum(x[2] > 0 for x in expected) > 20
    same(got, expected)


INTERNAL = ["_id", "_text", "_row", "_doc", "_runs", "_windows", "_anchors", "_place", "_fingerprint", "fingerprint", "root", "component_id", "_key", "_item", "_n", "n_bytes", "bits", "cell", "leaf", "id", "role", "key", "owner"]


def test_columns_named_like_the_operators_own(spark, tmp_path):
    docs = [(i, f"some words of text {i % 3} " * 8 + ("and an item that is leaked here" if i == 4 else ""), *[f"{n}{i}" for n in INTERNAL]) for i in range(8)] + [(3, None, *[None] * len(INTERNAL))]
    frame = spark.createDataFrame(docs, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in INTERNAL))
    bench = spark.createDataFrame([(1, "an item that is leaked here", "x")], "item_id long, text string, _key string")
    same([r[:2] for r in rows(simhash.near_duplicates(frame), "doc_id", "component_id")], [(i, c) for i, _, c in brute.simhash([d[:2] for d in docs])])
    kept = rows(simhash.representatives(frame), *frame.columns)
    assert len(kept) == len({c for _, _, c in brute.simhash([d[:2] for d in docs])}) and set(kept) <= set(docs)
    out = rlz.remove_duplicates(frame)
    assert out.columns == frame.columns
    same([r[:1] + r[2:] for r in rows(out, *frame.columns)], [d[:1] + d[2:] for d in docs])
    for block in (1 << 20, 1):
        same(rows(decontaminate.remove_contaminated(frame, bench, block_bytes=block), *frame.columns), [d for d in docs if d[0] != 4])
    sharding.write_shards(frame, str(tmp_path / "shards"), limit=300)
    back = spark.read.parquet(str(tmp_path / "shards"))
    same([r[:-1] for r in rows(back, *frame.columns, "shard")], docs)
    with pytest.raises(ValueError):
        sharding.write_shards(frame, str(tmp_path / "other"), by="Bits")
    same(rows(rlz.digest(frame), "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring_dedup([d[:2] for d in docs]))
    assert sharding.assign(frame).count() == tokenstore.round_trip(frame).count() == len(docs) and packing.pack(frame).count() >= len(docs)


def test_shards_of_equal_ids_keep_to_the_limit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 100)] * 50 + [(None, "y" * 60)] * 40, "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), limit=1000)
    out = spark.read.parquet(str(tmp_path / "s"))
    assert out.count() == 90 and out.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).agg(F.max("b")).first()[0] <= 1000


def test_remove_duplicates_keeps_columns_and_untouched_texts(docs_frame, odd_docs, no_docs):
    out = rlz.remove_duplicates(docs_frame)
    assert out.schema == docs_frame.schema and out.count() == docs_frame.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[62] == " \n\t " and texts[60] is None and texts[0] == odd_docs[0][1]
    assert texts[99] == ""
    assert rlz.digest(no_docs).count() == 0 and rlz.remove_duplicates(no_docs).count() == 0


def test_simhash(docs_frame, odd_docs, no_docs):
    got = simhash.near_duplicates(docs_frame).collect()
    got = [(r.doc_id, f"{r.fingerprint & (2**64 - 1):016x}", r.component_id) for r in got]
    same(got, brute.simhash(odd_docs))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_ball_hashing_loses_no_link():
    r = np.random.Generator(np.random.PCG64(3))
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [base]
    for _ in range(3):  # chains of up to 4 flipped bits
        step = fps[-1].copy()
        for _ in range(4):
            step ^= np.uint64(1) << r.integers(0, 64, len(step)).astype(np.uint64)
        fps.append(step)
    fps = np.unique(np.concatenate(fps))
    for bits in (4, 9):
        u, v = map(np.concatenate, zip(*(simhash.bucket_links(fps, q, bits, 4) for q in range(1 << bits))))
        ours = simhash.local_roots(len(fps), np.searchsorted(fps, u), np.searchsorted(fps, v))
        i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
        assert (ours == simhash.local_roots(len(fps), i, j)).all()


def test_hot_ball_is_split(monkeypatch):
    monkeypatch.setattr(simhash, "SORTED_VARIANTS", 8000)
    r = np.random.Generator(np.random.PCG64(5))
    fps = np.unique(np.uint64(1 << 40) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)))
    u, v = map(np.concatenate, zip(*(simhash.bucket_links(fps, q, 4, 4) for q in range(16))))
    assert len(np.unique(simhash.local_roots(len(fps), np.searchsorted(fps, u), np.searchsorted(fps, v)))) == 1


@pytest.mark.parametrize("bound", [1_000_000, 2, 0])
def test_representatives_of_null_and_equal_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", bound)
    say = lambda k: " ".join(f"{k}{j}" for j in range(30))
    docs = [(1, say("a")), (None, say("a")), (4, say("b")), (4, say("c")), (4, say("b")), (None, say("d")), (None, say("d")), (7, None), (8, ""), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    same(rows(simhash.representatives(frame), "doc_id", "text"), [(1, say("a")), (4, say("b")), (4, say("c")), (None, say("d")), (7, None)])
    assert simhash.representatives(frame.limit(0)).count() == 0


def test_crowded_buckets_are_dealt_further(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_PRINTS", 40)
    r = np.random.Generator(np.random.PCG64(9))
    flip = lambda n: np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (n, 3)).astype(np.uint64), axis=1)
    fps = np.unique(np.concatenate([np.uint64(0xF0F0F0F0F0F0F0F0) ^ flip(300), r.integers(0, 2**63, 50, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fingerprint long")
    got = simhash.links(frame, 4).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    u, v = (np.array([at[r[k]] for r in got]) for k in (0, 1))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert (simhash.local_roots(len(fps), u, v) == simhash.local_roots(len(fps), i, j)).all()


def test_representatives(docs_frame):
    kept = simhash.representatives(docs_frame)
    assert kept.columns == docs_frame.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    groups = simhash.near_duplicates(docs_frame)
    assert sorted(set(ids)) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    assert len(ids) == len(set(ids)) + 1  # two different texts have id 5


def test_token_store(docs_frame, odd_docs, no_docs, spark, tmp_path):
    got = rows(tokenstore.round_trip(docs_frame), "doc_id", "start", "n_tokens", "ids_crc32")
    expected = brute.token_store(odd_docs)
    assert sorted(x[2:] for x in got) == sorted(x[2:] for x in expected)
    unique = lambda x: [r for r in x if r[0] not in (None, 5, 90)]  # noqa: E731  the order among equal ids is free
    same(unique(got), unique(expected))
    assert sorted(r[1] for r in got) == np.cumsum([0] + [r[2] for r in sorted(got, key=lambda r: r[1])])[:-1].tolist()
    assert tokenstore.round_trip(no_docs).count() == 0
    path = str(tmp_path / "store")
    tokenstore.write(docs_frame, path, shard_ids=2000, task_bytes=5000)
    ids = spark.createDataFrame([(66,), (90,), (12345,)], "doc_id long")
    found = sorted((r.doc_id, r.ids) for r in tokenstore.lookup(spark, path, ids).collect())
    text = dict(odd_docs[:67])[66]
    assert [d for d, _ in found] == [66, 90, 90] and found[0][1] == brute.encode([text])[0]
    again = rows(tokenstore.read(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    same(unique(again), unique(expected))


def test_lookup_reads_only_the_shards_that_may_hold_a_key(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(0, 800, 2)] + [(None, "none"), (None, "other")], "doc_id long, text string")
    path = str(tmp_path / "store")
    tokenstore.write(docs, path, shard_ids=1000, task_bytes=8000)
    every = spark.read.parquet(path + "/shards").count()
    some = spark.createDataFrame([(100,), (101,), (5000,), (None,)], "doc_id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = tokenstore.lookup(spark, path, some)
        got = sorted((r.doc_id is not None, r.doc_id or 0, len(r.ids)) for r in found.collect())
        read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [x[:2] for x in got] == [(False, 0), (False, 0), (True, 100)] and found.filter("doc_id = 100").first().ids == brute.encode(["text number 100 " * 20])[0]
    assert every > 8 and 1 <= read <= 3
    assert tokenstore.lookup(spark, path, some.filter("doc_id = 5000")).count() == 0
    known = tokenstore.manifest(spark, path).orderBy("start").collect()
    assert [r.start for r in known] == np.cumsum([0] + [r.n_ids for r in known])[:-1].tolist() and sum(r.n_docs for r in known) == 402


def test_starts_are_joined_when_shards_are_many(spark, docs_frame, monkeypatch):
    before = rows(tokenstore.round_trip(docs_frame.filter("doc_id not in (5, 90)")), "doc_id", "start", "n_tokens", "ids_crc32")
    monkeypatch.setattr(tokenstore, "BROADCAST_SHARDS", 0)
    assert rows(tokenstore.round_trip(docs_frame.filter("doc_id not in (5, 90)")), "doc_id", "start", "n_tokens", "ids_crc32") == before


def test_minimal_hash():
    keys = np.unique(np.random.Generator(np.random.PCG64(1)).integers(0, 2**63, 5000, dtype=np.uint64))
    for n in (0, 1, 2, 5000):
        table = tokenstore.MinimalHash.build(keys[:n])
        again = tokenstore.MinimalHash.load(table.dump())
        assert sorted(again.lookup(keys[:n]).tolist()) == list(range(min(n, len(keys))))
    with pytest.raises(ValueError):
        tokenstore.MinimalHash.build(np.array([7, 7], dtype=np.uint64))


@pytest.mark.parametrize("capacity, grain", [(1024, 8), (64, 4)])
def test_packing(docs_frame, odd_docs, capacity, grain):
    out = packing.pack(docs_frame, capacity=capacity, grain=grain, with_ids=True).collect()
    encoded = brute.encode([t for _, t in odd_docs])
    pieces = sorted((i is not None, i or 0, s, len(ids[s : s + capacity]), brute.crc(ids[s : s + capacity]), len(ids)) for (i, _), ids in zip(odd_docs, encoded) for s in range(0, len(ids), capacity))
    assert pieces == sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    sequences = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= capacity
    assert len(sequences) * capacity <= 1.1 * sum(sequences.values()) + capacity


def test_packing_of_short_texts_fills_sequences(spark):
    texts = [""] * 2000 + [None] * 48 + ["a"] * 1024 + ["a a a a a a a a"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = packing.pack(docs).groupBy("sequence_id").agg({"length": "sum"}).collect()
    total = sum(r[1] for r in out)
    assert total == sum(map(len, brute.encode(texts))) and max(r[1] for r in out) <= 1024
    assert len(out) <= -(-total // 1024) + 1


def test_packing_of_no_documents(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_column_generation_reaches_the_bound():
    r = random.Random(2)
    histogram = {k: r.randint(1, 500) for k in range(1, 129)}
    plan = packing.Plan(histogram, 128)
    assert plan.sequences <= plan.bound * 1.01 + 2
    assert plan.bound >= sum(k * n for k, n in histogram.items()) / 128 - 1e-6


def test_sharding(docs_frame, odd_docs, no_docs):
    import hashlib

    unique = docs_frame.filter("doc_id is not null and doc_id not in (5, 90)").coalesce(1)
    sizes = {i: len((t or "").encode()) for i, t in odd_docs if i not in (None, 5, 90)}
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i in sizes}
    for limit in (1 << 20, 4000, 500):
        expected = brute.extendible([(bits[i], n) for i, n in sizes.items()], limit)
        got = sharding.assign(unique, limit=limit).collect()
        assert {r.doc_id: (r.n_bytes, r.shard_id) for r in got} == {i: (n, expected[bits[i]]) for i, n in sizes.items()}
        assert all(r.local_depth == len(r.shard_id) for r in got)
    assert sharding.assign(no_docs).count() == 0


def test_sharding_of_a_hot_key(spark):
    rows_ = [(1, "x" * 100)] * 200 + [(i, "y" * 50) for i in range(100)] + [(None, None), (7, "z" * 5000)]
    got = sharding.assign(spark.createDataFrame(rows_, "doc_id long, text string"), limit=1000).collect()
    assert len(got) == len(rows_)
    size = {}
    for r in got:
        size.setdefault(r.shard_id, []).append(r.n_bytes)
    assert all(sum(v) <= 1000 or len(v) == 1 for v in size.values()) and len(size) < 120
    assert [r.oversize for r in got if r.n_bytes == 5000] == [True]
    for a in size:  # a prefix-free directory
        assert not any(b != a and b.startswith(a) for b in size)
