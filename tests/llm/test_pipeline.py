"""The pipeline against brute force on a small table."""

import random

import pytest

import corpus_pipeline
from scalecluster.llm import toxicity

from . import brute


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(25)) for i in range(6)]
    passage = say(60)
    docs = []
    for i in range(160):
        text = say(r.randint(20, 200))
        if i % 4 == 3:
            text = text.replace(" ", " zorgle ", 2)
        if i in (8, 9, 10, 12):
            text += " " + passage
        if i in (13, 14):
            text = f"{text} {items[i - 13][1]} {say(5)}"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
    docs += [(200 + i, docs[20][1], "en", "s", 0) for i in range(5)] + [(210, None, None, None, None), (211, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 3)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs, items


def test_stages(spark, small, tmp_path):
    path, docs, items = small
    text = {d[0]: d[1] for d in docs}
    frame, previous = spark.read.parquet(f"{path}/documents.parquet"), docs
    states = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, path).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == frame.columns
        states.append([tuple(r) for r in out.collect()])
        frame = out
    toxic, near, cut, clean, packed = states
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity(spark.read.parquet(f"{path}/documents.parquet"), labels).collect() if r.predicted}
    assert {d[0] for d in toxic} == set(text) - rejected
    assert len(rejected & {i for i in range(160) if i % 4 == 3}) >= 36 and len(rejected - {i for i in range(160) if i % 4 == 3}) <= 2
    groups = {}
    for doc, _, component in brute.simhash([d[:2] for d in toxic]):
        groups.setdefault(component, []).append(doc)
    assert {d[0] for d in near} == set(groups)
    digests = {d[0]: d for d in brute.substring_dedup([d[:2] for d in near])}
    import hashlib

    for d in cut:
        assert hashlib.sha256(" ".join(brute.SPACE_WORD.findall(d[1] or "")).encode()).hexdigest() == digests[d[0]][3]
        assert d[1] is None or d[4] == len(d[1]) or digests[d[0]][2] == 0
    expected = {d[0] for d in brute.contamination([d[:2] for d in cut], items) if not d[5]}
    assert {d[0] for d in clean} == expected and not {13, 14} & expected
    lengths = {d[0]: len(ids) for d, ids in zip(clean, brute.encode([d[1] for d in clean]))}
    total = {}
    for p in packed:
        total[p[0]] = total.get(p[0], 0) + p[2]
    assert total == lengths


def expected_run(docs, items, kept):
    """The pieces of run's last stage without their sequences; ``kept`` are the ids that toxicity keeps."""
    left = [d[:2] for d in docs if d[0] in kept]
    left = [(i, t) for i, t in left if i in set(brute.simhash_keepers(left))]
    cut = brute.cut_duplicates(left)
    left = [d for d, r in zip(cut, brute.contamination(cut, items)) if not r[5]]
    return sorted((i, s, len(ids[s : s + 1024]), brute.crc(ids[s : s + 1024]), len(ids)) for (i, _), ids in zip(left, brute.encode([t for _, t in left])) for s in range(0, len(ids), 1024))


def test_run(spark, small):
    path, docs, items = small
    labels = spark.read.parquet(f"{path}/labels.parquet")
    kept = {r.doc_id for r in toxicity.toxicity(spark.read.parquet(f"{path}/documents.parquet"), labels).collect() if not r.predicted}
    out = corpus_pipeline.run(spark, path)
    got = out.collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected_run(docs, items, kept)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_run_on_empty_tables_repeated_ids_and_clashing_names(spark, small, tmp_path):
    path, docs, items = small
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id int, component_id long, shingle string"
    labels, bench = spark.read.parquet(f"{path}/labels.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")

    def write(name, frame, labels, bench):
        for n, f in (("documents", frame), ("labels", labels), ("benchmark", bench)):
            f.write.parquet(f"{tmp_path}/{name}/{n}.parquet")
        return corpus_pipeline.run(spark, f"{tmp_path}/{name}")

    none = spark.createDataFrame([], schema)
    assert write("none", none, labels.limit(0), bench.limit(0)).count() == 0
    rows = [(i, f"text number {(i or 0) % 9} of a few words", "en", "s", 1, "x", i, 0, "y") for i in [*range(20), 3, 3, None, None]] + [(50, None, None, None, None, None, None, None, None)]
    out = write("odd", spark.createDataFrame(rows, schema), labels.limit(0), bench.limit(0)).collect()
    groups = brute.simhash([r[:2] for r in rows])
    assert len({r.doc_id for r in out}) == len(out) == len({c for _, _, c in groups})
