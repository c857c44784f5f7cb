import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scalecluster.llm import langid, logbilinear, mih, toxicity
from scalecluster.llm.queries import QUERIES, table

from . import brute

SF = "/root/testdata/sf0.01"


def fold(doc, n):
    return zlib.crc32(str("" if doc is None else doc).encode()) % n


# --- toxicity ----------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have too few toxic rows to learn all of their signs
    got = QUERIES["op2_toxicity"](spark, sf).cache()
    assert got.count() == table(spark, sf, "documents").count()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got.select("doc_id", "held_out").collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.collect())
    rows = got.join(table(spark, sf, "labels"), "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in rows) / len(rows)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    assert right >= 0.97 and sum(pairs) / len(pairs) >= 0.98


def test_toxicity_edges(docs_frame, odd_docs, spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity.toxicity(docs_frame, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 0, 1) for i in range(30)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    scores = {r.score for r in toxicity.toxicity(docs_frame, one).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 0.1
    two = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(60)], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(docs_frame, two)
    assert out.count() == len(odd_docs) and out.filter("score is null or isnan(score)").count() == 0
    assert toxicity.toxicity(no_docs, two).count() == 0
    assert toxicity.remove_toxic(docs_frame, two).columns == docs_frame.columns


def test_toxicity_features_are_whole_ngrams():
    wanted = toxicity.features(pa.array(["xx bad. yy"]))
    again = toxicity.features(pa.array(["", None, "XX BAD! yy", "b", "ad"]))
    assert set(wanted[1]) == set(again[1]) and set(again[0]) == {2}


def plain_features(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    data = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in data)
    grams = {data[i : i + n] for n in (3, 4, 5, 6) for i in range(len(data) - n + 1)}
    return {((int.from_bytes(g, "little") << (64 - 8 * len(g))) * int(toxicity.MULTIPLIERS[len(g)]) % 2**64) >> 44 for g in grams}


def test_toxicity_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"), "doc_id", "text", "toxic", toxicity.MAX_POSITIVE, toxicity.MAX_NEGATIVE, toxicity.MAX_BYTES)
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        z = model.bias + sum(float(model.weights[f]) for f in plain_features(text))
        score = 1 / (1 + math.exp(-z))
        assert abs(got[i][0] - score) < 1e-9 and got[i][1] == int(got[i][0] >= 0.3)


def test_toxicity_fits_plain_ratios():
    texts, labels = ["bad words", "bad day", "good words", "fine words", "fine day"], np.array([1, 1, 0, 0, 0])
    model = toxicity.fit([pa.array(texts)], labels, np.ones(5), least_gain=-1.0, steps=0, keep=1 << 20)
    assert abs(model.bias - math.log(2.5 / 3.5)) < 1e-12
    model = toxicity.fit([pa.array(texts * 3)], np.tile(labels, 3), np.ones(15), least_gain=-1.0, keep=1 << 20)
    bad, fine = (next(iter(plain_features(g) - set())) for g in ("bad", "fin"))
    assert model.weights[bad] > 0 > model.weights[fine]


def test_repeated_ids_do_not_crowd_the_fit(spark):
    rows = [(1, "horrid thing")] * 300 + [(i, "nice thing" if i % 2 else "horrid thing") for i in range(2, 60)] + [(1, "a")]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(2, 60)] + [(1, 0), (1, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(d, labels).collect()) for d in (docs, docs.repartition(5)))
    assert one == two and len(one) == len(rows)


# --- language ----------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    got = QUERIES["op6_language_id"](spark, SF)
    rows = got.join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == table(spark, SF, "documents").count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97


def test_language_edges(spark, no_docs):
    r = random.Random(1)
    say = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, say("abcd") if i % 2 else say("wxyz"), "aa" if i % 2 else "ww") for i in range(60)]
    rows += [(100, None, "aa"), (101, "", "aa"), (102, "12 34 !", "ww"), (103, say("abcd") * 50, None), (None, "x", None), (3, say("wxyz"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = [(x.doc_id, x.lang_pred, x.score) for x in langid.identify(docs).collect()]
    assert len(got) == len(rows)
    by = {i: (lang, s) for i, lang, s in got}
    assert {by[i] for i in (100, 101, 102)} == {("und", 0.0)}
    assert by[103][0] == "aa" and all(by[i][0] == ("aa" if i % 2 else "ww") for i in range(60) if i != 3)
    assert langid.identify(no_docs).count() == 0
    assert {x.lang_pred for x in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_more_than_64_languages_are_learned(spark):
    names = [f"l{k:02}" for k in range(70)]
    say = lambda k: chr(0x4E00 + 64 * k) * 20
    rows = [(i, say(i % 70), names[i % 70]) for i in range(70 * 12)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    right = [r.lang_pred == names[r.doc_id % 70] for r in got]
    assert len({r.lang_pred for r in got}) > 64 and sum(right) / len(right) >= 0.9


def plain_probabilities(net, symbols):
    """A window's mean probabilities, by loops."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(d, order):
        hidden = d.recurrent.shape[1]
        h, out = [0.0] * hidden, []
        for s in order:
            inner = [sum(float(d.recurrent[i][j]) * h[j] for j in range(hidden)) for i in range(3 * hidden)]
            x = [float(d.table[i][s]) for i in range(3 * hidden)]
            update = [sigmoid(x[i] + inner[i]) for i in range(hidden)]
            reset = [sigmoid(x[hidden + i] + inner[hidden + i]) for i in range(hidden)]
            new = [math.tanh(x[2 * hidden + i] + reset[i] * inner[2 * hidden + i]) for i in range(hidden)]
            h = [update[i] * h[i] + (1 - update[i]) * new[i] for i in range(hidden)]
            out.append(h)
        return out

    ahead, back = states(net.ahead, symbols), states(net.back, symbols[::-1])[::-1]
    total = [0.0] * len(net.bias)
    for s, a, b in zip(symbols, ahead, back):
        z = [sum(float(w) * v for w, v in zip(row, a + b)) + float(c) for row, (c,) in zip(net.out, net.bias)]
        top = max(z)
        e = [math.exp(v - top) for v in z]
        if s != langid.PAD:
            total = [t + v / sum(e) for t, v in zip(total, e)]
    return total


def test_labels_match_plain_python():
    net = langid.Network.random(3, hidden=4, seed=9)
    texts = ["Some text", "x" * 70 + " ÄÖ", "", "z"]
    got = langid.label_batch(net, pa.array([*texts, None]))
    for text, p in zip(texts, got):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total = [0.0] * 3
        for i in range(0, len(raw), langid.WINDOW):
            part = list(raw[i : i + langid.WINDOW])
            total = [a + b for a, b in zip(total, plain_probabilities(net, part + [langid.PAD] * (langid.WINDOW - len(part))))]
        assert all(abs(a / max(1, len(raw)) - b) < 1e-4 for a, b in zip(total, p))
    assert (got[4] == 0).all()


def test_language_of_repeated_rows_and_ties(spark):
    rows = [(1, "same words here", "aa")] * 40 + [(2, "same words here", "bb")] * 40 + [(1, "same words here", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 81 and len({(r.lang_pred, round(r.score, 6)) for r in got}) == 1
    assert {r.lang_pred for r in got} <= {"aa", "bb"}
    only = spark.createDataFrame([(0, "words", "aa"), (1, "words", "aa"), (2, "words", "aa")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 6)) for r in langid.identify(only).collect()} == {("aa", 1.0)}


def test_gradients_match_differences():
    rng = np.random.Generator(np.random.PCG64(2))
    net = langid.Network.random(3, hidden=3, seed=1)
    symbols, labels = rng.integers(97, 103, (6, 5)).astype(np.intp), np.array([0, 1, 2, 1, 0])
    symbols[4:, 0] = langid.PAD
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    _, grads = net.gradients(symbols, labels)
    for p, g in zip(net.parameters(), grads):
        flat = [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]
        if p.shape[-1] == 257:
            flat = [(k[0], int(symbols[1, 1])) for k in flat]
        for k in flat:
            old, eps = p[k], np.float32(1e-2)
            p[k] = old + eps
            up = net.gradients(symbols, labels)[0]
            p[k] = old - eps
            down = net.gradients(symbols, labels)[0]
            p[k] = old
            assert abs((up - down) / (2 * eps) - g[k]) < 2e-3


# --- language model ----------------------------------------------------------


def test_base_scores_and_counts(docs_frame, odd_docs):
    from collections import Counter

    got = logbilinear.score(docs_frame, hot_tokens=60).collect()
    tokens = [(i, brute.SPACE_WORD.findall(brute.lower(t)) + [None]) for i, t in odd_docs]
    count = Counter(w for i, ws in tokens if fold(i, 7) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    expected = sorted((i is not None, i or 0, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5), fold(i, 7) == 2) for i, ws in tokens)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.held_out) for r in got) == expected
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_scores_do_not_depend_on_what_is_hot(docs_frame):
    a = {(r.doc_id, r.n_tokens): r.base_score for r in logbilinear.score(docs_frame).collect()}
    b = {(r.doc_id, r.n_tokens): r.base_score for r in logbilinear.score(docs_frame, hot_tokens=3).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def small_tree(members=5, shared=3):
    words, endings = np.arange(1, 9, dtype=np.uint64) << np.uint64(50), np.arange(shared - 1)
    names = np.arange(100, 100 + 2 * shared, dtype=np.uint64) << np.uint64(48)
    classes = logbilinear.Classes(words, endings, names, np.repeat(9 + np.arange(shared), 2), members)
    member_n = np.full((shared, members - 1), -1.0)
    member_n[:, :2] = [[7, 2]] * shared
    return logbilinear.Tree(classes, np.arange(classes.count) + 1.0, member_n, np.full(shared, 5.0), np.full(shared, 3.0))


def test_model_is_normalised():
    tree = small_tree()
    model = logbilinear.Model.start(tree.share, tree.member_share, 3, 5)
    n = tree.classes.symbols
    symbols = np.array([[7, 2, 1, s] for s in range(n)]).ravel()
    p = np.exp(model.log_probabilities(symbols, np.arange(n) * 4 + 3, tree.classes))
    assert abs(p.sum() - 1) < 1e-5
    absent = np.flatnonzero(tree.member_share.ravel() == 0) + tree.classes.single
    assert len(absent) == 6 and (p[absent] < 1e-9).all()


def test_probabilities_match_plain_python():
    tree = small_tree()
    model = logbilinear.Model.start(tree.share, tree.member_share, 2, 4)
    classes, rng = tree.classes, random.Random(4)
    context = [[rng.randrange(classes.symbols) for _ in range(50)] for _ in range(2)]
    target = [rng.choice([s for s in range(classes.symbols) if s < classes.single or tree.member_share.ravel()[s - classes.single] > 0]) for _ in range(50)]
    symbols = np.array([[context[1][j], context[0][j], target[j]] for j in range(50)]).ravel()
    got = model.log_probabilities(symbols, np.arange(50) * 3 + 2, classes)
    soft = lambda z, i: z[i] - math.log(sum(math.exp(x) for x in z))
    for j in range(50):
        ctx = [sum(float(model.r[context[k][j]][d]) * float(model.c[k][d]) for k in range(2)) for d in range(4)]
        dot = lambda v: sum(a * float(b) for a, b in zip(ctx, v))
        s = target[j]
        c = s if s < classes.single else classes.single + (s - classes.single) // classes.slots
        want = soft([dot(q) + float(b) for q, b in zip(model.q, model.bias)], c)
        if s >= classes.single:
            first = (c - classes.single) * classes.slots
            want += soft([dot(v) + float(b) for v, b in zip(model.p[first : first + classes.slots], model.member_bias[first : first + classes.slots])], s - classes.single - first)
        assert abs(got[j] - want) < 1e-3


def test_sequences_keep_texts_apart():
    t = logbilinear.Tokens(pa.array(["a b", None, "c"]))
    symbols, places = logbilinear.sequence(t, np.arange(1, 7), 2)
    assert symbols.tolist() == [0, 0, 1, 2, 3, 0, 0, 4, 0, 0, 5, 6] and places.tolist() == [2, 3, 4, 7, 10, 11]


def test_steps_do_not_depend_on_calls(monkeypatch):
    monkeypatch.setattr(logbilinear, "BATCH", 7)
    tree, rng = small_tree(), np.random.Generator(np.random.PCG64(3))
    texts = [np.append(np.zeros(logbilinear.CONTEXT, np.int64), rng.integers(0, 9, n)) for n in (30, 1, 55, 90)]
    vectors = []
    for groups in ([[0, 1, 2, 3]], [[0], [1, 2], [3]]):
        trainer = logbilinear.Trainer(logbilinear.Model.start(tree.share, tree.member_share), tree.classes, tree.share, tree.member_share, 0.1, 5)
        for g in groups:
            starts = np.cumsum([0] + [len(texts[i]) for i in g])
            trainer.add(np.concatenate([texts[i] for i in g]), np.concatenate([np.arange(logbilinear.CONTEXT, len(texts[i])) + a for i, a in zip(g, starts)]))
        trainer.finish()
        vectors.append(trainer.m.vector())
    assert (vectors[0] == vectors[1]).all()


def test_scores_do_not_depend_on_partitions(spark):
    docs = table(spark, SF, "documents")
    one, eight = (sorted((r.doc_id, r.score) for r in logbilinear.score(docs.repartition(n), start_bytes=1 << 18).collect()) for n in (1, 8))
    assert [i for i, _ in one] == [i for i, _ in eight]
    assert max(abs(a - b) / max(1.0, abs(a)) for (_, a), (_, b) in zip(one, eight)) < 1e-6


def test_held_out_gain(spark):
    r = QUERIES["op4_lm_scoring"](spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (r[0] - r[1]) / r[2] > 0.25


def test_lm_of_nothing(no_docs, spark):
    assert logbilinear.score(no_docs).count() == 0
    held = next(i for i in range(99) if fold(i, 7) == 2)
    only = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = logbilinear.score(only).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.held_out) == (3, 0, 0, 0.0, True)


# --- nearest neighbours ------------------------------------------------------


def exact(vectors, k=5):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], dtype=np.float64)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[ids == ids[i]] = -9
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    truth = exact(rows)
    got = QUERIES["op10_nearest_neighbours"](spark, SF).collect()
    assert len(got) == 5 * len(truth)
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in truth}
    assert sum(len(set(found[q]) & set(truth[q])) for q in truth) >= 0.9 * 5 * len(truth)
    x = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for r in got:
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(mih, "MISS", 0.0)  # all rows are checked here, so nothing is missed
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], "x") for i in range(60)]
    rows += [(100, None, "x"), (150, [0.0, 0.0, 0.0], "x"), (200, [float("nan"), 1.0, 1.0], "x"), (250, [float("inf"), 1.0, 1.0], "x"), (300, [1.0, None, 1.0], "x"), (350, [1.0], "x"), (None, [1.0, 1.0, 1.0], "x"), (50, [5.0, 5.0, 5.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = mih.search(df, df.filter("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert r.vec_id not in (None, 100, 150, 200, 250, 300, 350, r.query_id)
    assert set(by) == {0, 50} and by[0] == exact([r[:2] for r in rows[:60]])[0]
    assert mih.search(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert [r.vec_id for r in mih.search(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [1, 2]
    tens = df.filter("vec_id < 60")
    blocks = mih.search(tens, tens.filter("vec_id % 10 = 0"), row_block=7, query_block=2)
    assert sorted(map(tuple, blocks.collect()), key=str) == sorted(map(tuple, mih.search(tens, tens.filter("vec_id % 10 = 0")).collect()), key=str)
    assert blocks.select("query_id").distinct().count() == 6


def test_far_values_repeated_queries_and_equal_vectors(spark):
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, [x * (1e250 if i % 3 == 0 else 1e-250 if i % 3 == 1 else 1) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mih.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [100, 101, 102, 103, 104] and all(abs(x.score - 1) < 1e-12 for x in got)
    own = mih.search(df, df.filter("vec_id in (3, 4)").unionByName(df.filter("vec_id = 3")), k=3)
    assert sorted((x.query_id, x.rank) for x in own.collect()) == sorted([(3, k) for k in (1, 2, 3)] * 2 + [(4, k) for k in (1, 2, 3)])
    truth = exact([(i, [x / max(map(abs, v)) for x in v]) for i, v in rows])
    assert [x.vec_id for x in got] == truth[0]


def test_more_neighbours_and_many_buckets(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    truth = exact(rows, 20)
    monkeypatch.setattr(mih, "ROW_BLOCK", 150)  # four bits of prefix
    vectors = table(spark, sf, "embeddings")
    got = mih.search(vectors, vectors.filter("vec_id % 50 = 0"), k=20, row_block=150, query_block=7).collect()
    hit = sum(r.vec_id in set(truth[r.query_id]) for r in got)
    assert len(got) == 20 * len(truth) and hit >= 0.9 * 20 * len(truth)
    assert len({(r.query_id, r.vec_id) for r in got}) == len(got)


def test_few_rows_are_reranked():
    import pyarrow.parquet as pq

    vectors = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").combine_chunks()
    x = mih.matrix(vectors, 64)
    axes = mih.learn_axes(x)
    codes, u = mih.encode(x, axes), x / mih.norms(x)[:, None]
    near = u[:64] @ u.T
    near[np.arange(64), np.arange(64)] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    radius = int(np.quantile([mih.distance(codes[best[i]], codes[i : i + 1]) for i in range(64)], 1 - mih.MISS, method="higher"))
    index = mih.Index.choose(radius, mih.BITS, len(x))
    found = [np.concatenate([index.candidates(codes, codes[i : i + 1], p) for p in range(index.m)]) for i in range(64)]
    assert sum(map(len, found)) <= 0.1 * 64 * len(x)
    assert sum(len(set(f) & set(b)) for f, b in zip(found, best)) >= 0.9 * 5 * 64


def test_a_longer_vector_does_not_set_the_length(spark, monkeypatch):
    monkeypatch.setattr(mih, "MISS", 0.0)
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    for stray in ([1.0] * 5, [1.0, None, float("nan"), 1.0]):
        df = spark.createDataFrame([*rows, (100, stray)], "vec_id long, embedding array<float>")
        got = mih.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
        assert {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 50)} == exact(rows)
        assert len(got) == 10


@pytest.mark.parametrize("m, prefix", [(2, 0), (4, 3), (8, 6), (16, 9)])
def test_pigeonhole_probing_is_complete(m, prefix):
    rng = np.random.Generator(np.random.PCG64(8))
    codes = rng.integers(0, 256, (2000, 32)).astype(np.uint8)
    codes[:300] = codes[0] ^ np.where(rng.random((300, 32)) < 0.4, 1 << rng.integers(0, 8, (300, 32)), 0).astype(np.uint8)
    for radius in (0, 3, 20, 60, 110, 256):
        index = mih.Index(radius, 256, m, prefix)
        found = []
        for p in range(m):
            reach = set((index.bucket(codes[:1], p)[0] ^ index.reach(p)).tolist())
            here = np.array([b in reach for b in index.bucket(codes, p).tolist()])
            found += np.flatnonzero(here)[index.candidates(codes[here], codes[:1], p)].tolist()
        far = mih.distance(codes, codes[:1])
        assert sorted(found) == np.flatnonzero(far <= radius).tolist()  # each once
