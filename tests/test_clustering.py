import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scalecluster.functions.hashing import hash_family, java_ints, string_hash
from scalecluster.functions.vectors import normalise
from scalecluster.operators import evaluate, minhash, sdcode, stats
from scalecluster.operators.components import connected_components, grouped_components, local_roots
from scalecluster.plans import engine
from scalecluster.plans.config import ClusterConfig
from scalecluster.sources import io

SD7 = ["0.0,0.0", "1.0,1.0", "0.5 0.5", "8.0,8.0", "7.5,8.0", "8.0,0.0", "4.0,4.5"]


def labels(df, scale):
    return [r.cluster for r in df.filter(F.col("scale") == scale).orderBy("item_id").collect()]


@pytest.fixture(scope="module")
def sd7(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sd7") / "items.txt"
    path.write_text("\n".join(SD7) + "\n")
    return io.read_text(spark, str(path))


def test_sd_goldens(sd7):
    out = engine.cluster(sd7, ClusterConfig(standardise=False)).cache()
    assert sorted(r.scale for r in out.select("scale").distinct().collect()) == [1, 2, 3, 4, 5]
    expected = {1: [0] * 7, 2: [0, 0, 0, 12, 12, 10, 12], 3: [0, 0, 0, 63, 63, 42, 48], 4: [0, 0, 0, 255, 255, 170, 193], 5: [0, 48, 12, 1021, 1021, 682, 772]}
    assert {s: labels(out, s) for s in expected} == expected


def test_sd_codes_and_prefix(sd7):
    cells = sdcode.cell_columns(sd7, stats.column_stats(sd7, 2).collect(), 5)
    both = cells.select("item_id", sdcode.code_text([F.col("c0"), F.col("c1")], 5).alias("t"), sdcode.code_number([F.col("c0"), F.col("c1")], 5).alias("n")).orderBy("item_id").collect()
    assert [r.t for r in both] == ["0000000000", "0000110000", "0000001100", "1111111111", "1111111101", "1010101010", "1100000100"]
    assert [r.n for r in both] == [int(r.t, 2) for r in both]


def test_end_scale_is_clamped_and_empty_ranges_warn(sd7):
    out = engine.cluster(sd7, ClusterConfig(standardise=False, start_scale=4, end_scale=99))
    assert {r.scale for r in out.select("scale").distinct().collect()} == {4, 5}
    with pytest.warns(UserWarning):
        assert engine.cluster(sd7, ClusterConfig(standardise=False, start_scale=9)).count() == 0


MIN5 = ["11110000", "11110001", "00001111", "00001110", "10101010"]


def test_min_goldens(spark):
    items = spark.createDataFrame([(i, [float(c) for c in t]) for i, t in enumerate(MIN5)], "item_id long, vec array<double>")
    config = ClusterConfig(model="MIN", standardise=False, hash_functions=10, bands=5, growth=0.5)
    bits = engine.min_bits(items, config, 8)
    sigs = minhash.signatures(bits, 8, 10).orderBy("item_id").collect()
    assert sigs[0].sig == [-2023131173, 108465952, -1986860988, -2131736360, -1937485178, -2080657548, 68101457, 293213494, -2112701308, -1927285109]
    assert sigs[4].sig[3:6] == [-1780947002, -2015175777, -1815326182]
    sig_df = minhash.signatures(bits, 8, 10)
    scored = minhash.scored_pairs(minhash.candidates(minhash.bands(sig_df, 10, 5)), sig_df, 10)
    assert {(r.u, r.v): r.sim for r in scored.collect()} == {(0, 1): 0.8, (0, 4): 0.3, (2, 3): 0.7, (3, 4): 0.6}
    out = engine.cluster(items, config).cache()
    assert [labels(out, s) for s in (1, 2, 3)] == [[0] * 5] * 3 and labels(out, 4) == [0, 0, 2, 2, 2]
    alone = engine.cluster(items.filter("item_id in (0, 2)"), ClusterConfig(model="MIN", standardise=False, hash_functions=10, bands=5, growth=0.5, keep_unmatched=False))
    assert alone.count() == 0


def test_hash_constants():
    assert java_ints(100, 4) == [-1193959466, -1139614796, 837415749, -1220615319]
    assert hash_family(125)[2] == (-1429538713, 118249332) and hash_family(125)[124] == (706579457, 1171511452)
    assert [string_hash(s) for s in ("0-0", "0-1", "10-1", "511-0")] == [47571, 47572, 1507331, 50454904]


def test_hub_limit_keeps_pairs_linear(spark):
    sigs = spark.range(40).select(F.col("id").alias("item_id"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("sig"))
    banded = minhash.bands(sigs, 2, 2)
    assert minhash.candidates(banded, None).count() == 40 * 39 // 2
    assert minhash.candidates(banded, 5).count() == 5 * 35 + 10


def test_components_against_union_find(spark):
    r = random.Random(4)
    edges = [(s, r.randrange(60), r.randrange(60)) for s in (1, 2) for _ in range(45)] + [(3, i, i + 1) for i in range(200)] + [(4, 7, 7), (4, None, 1)]
    df = spark.createDataFrame(edges, "scale int, u long, v long")

    def plain(scale):
        label = {}
        some = [(u, v) for s, u, v in edges if s == scale and u is not None and u != v]
        for u, v in some:
            label.setdefault(u, u), label.setdefault(v, v)
        changed = True
        while changed:
            changed = False
            for u, v in some:
                low = min(label[u], label[v])
                changed |= label[u] != low or label[v] != low
                label[u] = label[v] = low
        return {(scale, n, x) for n, x in label.items()}

    expected = set().union(*(plain(s) for s in (1, 2, 3, 4)))
    for found in (connected_components(df, ["scale"]), grouped_components(df, ["scale"]), grouped_components(df, ["scale"], local_edges=3)):
        rows = [tuple(x) for x in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected
    assert connected_components(df.limit(0), ["scale"]).count() == 0 and grouped_components(df.limit(0), ["scale"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_local_roots(pairs):
    import numpy as np

    a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    root = local_roots(31, a, b)
    assert (root[root] == root).all() and (root <= np.arange(31)).all() and all(root[x] == root[y] for x, y in pairs)


def test_nesting_and_permutation(spark):
    r = random.Random(9)
    points = [(i, [r.random() * 10, r.random() * r.random()]) for i in range(300)]
    points += [(300 + i, points[i][1]) for i in range(20)]
    config = ClusterConfig(scales=(3, 4, 5), standardise=False)
    out = engine.cluster(spark.createDataFrame(points, "item_id long, vec array<double>"), config)
    by = {(x.scale, x.item_id): x.cluster for x in out.collect()}
    for s in (3, 4):
        parent = {}
        for i in range(320):
            assert parent.setdefault(by[s + 1, i], by[s, i]) == by[s, i]
    assert all(by[s, 300 + i] == by[s, i] for s in (3, 4, 5) for i in range(20))
    r.shuffle(points)
    again = engine.cluster(spark.createDataFrame(points, "item_id long, vec array<double>"), config)
    assert {(x.scale, x.item_id): x.cluster for x in again.collect()} == by


def test_long_codes_are_text(spark):
    items = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [1e-7, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])], "item_id long, vec array<double>")
    out = engine.cluster(items, ClusterConfig(scales=(3, 22), standardise=False)).cache()
    assert labels(out, 3) == ["0" * 9, "0" * 9, "1" * 9]
    assert labels(out, 22) == ["0" * 66, "0" * 66, "1" * 66]


def test_degenerate_inputs(spark):
    make = lambda rows: spark.createDataFrame(rows, "item_id long, vec array<double>")
    assert engine.cluster(make([])).count() == 0
    assert labels(engine.cluster(make([(5, [2.0, 3.0])]), ClusterConfig(standardise=False)), 1) == [0]
    constant = engine.cluster(make([(i, [1.0, float(i)]) for i in range(4)]), ClusterConfig(standardise=False, scales=(2,)))
    assert labels(constant, 2) == [0, 0, 0, 0]
    zero = normalise(make([(0, [0.0, 0.0]), (1, [3.0, 4.0])])).orderBy("item_id").collect()
    assert all(x != x for x in zero[0].vec) and zero[1].vec == [0.6, 0.8]
    assert labels(engine.cluster(make([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [4.0, 3.0])]), ClusterConfig(scales=(1,))), 1) == [0, 0, 0]
    with pytest.raises(ValueError):
        engine.cluster(make([(0, [1.0]), (1, [1.0, 2.0])]))
    with pytest.raises(ValueError):
        engine.cluster(make([(0, [1.0] * 7)]), ClusterConfig(model="SD"))


@pytest.mark.parametrize("bad", [{"model": "X"}, {"start_scale": 0}, {"start_scale": 5, "end_scale": 4}, {"hash_functions": 10, "bands": 3}, {"growth": 0}, {"grid": "hex"}, {"hub_limit": 0}, {"radius": 30}, {"scales": ()}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        ClusterConfig(**bad)


def test_config_from_environment():
    got = ClusterConfig.from_environment({"CODE_MODEL": "MIN", "LAMBDA": "0.2", "DATA_STANDARDIZATION": "false", "NUMBER_OF_HASHTABLES": "20", "NUMBER_OF_BUCKETS": "4", "PATH": "/x"})
    assert got == ClusterConfig(model="MIN", growth=0.2, standardise=False, hash_functions=20, bands=4)
    with pytest.raises(ValueError):
        ClusterConfig.from_environment({"DATA_STANDARDIZATION": "maybe"})


def test_auto_model_and_ladders():
    assert engine.resolve_model(ClusterConfig(model="auto"), 3) == "SD" and engine.resolve_model(ClusterConfig(model="auto"), 4) == "MIN"
    assert stats.max_jaccard_scale(64, 0.1) == 42 and stats.max_jaccard_scale(64, 0.02) == 209
    assert [round(t, 6) for _, t in stats.threshold_ladder(8, 0.5, 1, 4)] == [0.125, 0.1875, 0.28125, 0.421875]
    assert stats.neighbour_radius(1, 9, 2) == 1 and stats.neighbour_radius(0.5, 6, 4) == 2
    with pytest.raises(ValueError):
        stats.neighbour_radius(0.5, 30, 2)
    assert max(stats.similarity_ladder(64, 0.5, 0.5)) <= 1 and stats.scale_count(1, 1024.0, 1.0) == 10


def test_evaluation(spark):
    clusters = spark.createDataFrame([(1, i, c) for i, c in enumerate([0, 0, 0, 3, 3, 5])], "scale int, item_id long, cluster long")
    tags = spark.createDataFrame([(i, t) for i, t in enumerate([1, 1, 2, 2, 1, 2])], "item_id long, label int")
    got = {(r.cluster): (r.label, r.n, r.size) for r in evaluate.majority(clusters, tags).collect()}
    assert got == {0: (1, 2, 3), 3: (1, 1, 2)}
    best = {r.label: r for r in evaluate.best_f1(clusters, tags).collect()}
    assert best[2].f1 == 0 and best[2].cluster is None
    assert best[1].cluster == 0 and abs(best[1].f1 - 2 / 3) < 1e-12


def test_files(spark, tmp_path, sd7):
    out = engine.cluster(sd7, ClusterConfig(standardise=False, scales=(2, 5)))
    io.write_clusters(out, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["scale=2", "scale=5"]
    assert io.read_clusters(spark, str(tmp_path / "out")).filter("scale = 5").count() == 7
    (tmp_path / "named.csv").write_text("city,a,b\nx,1,2\ny,3,4\n")
    named = io.read_named_csv(spark, str(tmp_path / "named.csv"), 2).orderBy("name").collect()
    assert [(r.name, r.vec) for r in named] == [("x", [1.0, 2.0]), ("y", [3.0, 4.0])]
    members = evaluate.cluster_members(out, sd7.withColumn("name", F.concat(F.lit("n"), "item_id")))
    io.write_report(members, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == members.count()
    import numpy as np

    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    np.save(tmp_path / "t.npy", np.array([1, 0, 1]))
    assert [(r.item_id, r.vec, r.label) for r in io.read_npy(spark, str(tmp_path / "m.npy"), str(tmp_path / "t.npy")).orderBy("item_id").collect()] == [(0, [0.0, 1.0], 1), (1, [2.0, 3.0], 0), (2, [4.0, 5.0], 1)]


def test_streaming_encoding(spark, sd7, tmp_path):
    from scalecluster.streaming.encode import encode_stream, label_stream

    run = engine.run_sd(sd7, ClusterConfig(standardise=False, scales=(3, 5)), 2)
    sd7.select("item_id", "vec").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id long, vec array<double>").parquet(str(tmp_path / "in"))
    cells = encode_stream(stream, stats.column_stats(sd7, 2).collect(), 5, standardise=False)
    q = label_stream(cells, run).writeStream.format("memory").queryName("labelled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.scale, r.item_id): r.cluster for r in spark.table("labelled").collect()}
    assert got == {(r.scale, r.item_id): r.cluster for r in run.items().collect()}


def test_entry_contract():
    import __spark_entry__ as entry
    from scalecluster.plans import catalogue

    assert set(catalogue.ORACLE_SQL) == set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_weber_scales(spark):
    r = random.Random(6)
    rows = [(i, [round(r.random() * 20, 1), round(r.random() * 20, 1)]) for i in range(120)] + [(120 + i, rows_) for i, rows_ in enumerate([[0.0, 0.0], [0.0, 0.0]])]
    items = spark.createDataFrame(rows, "item_id long, vec array<double>")
    low = [min(v[j] for _, v in rows) for j in (0, 1)]
    widest = max(max(v[j] for _, v in rows) - low[j] for j in (0, 1))
    gaps = [b - a for j in (0, 1) for values in [sorted({v[j] for _, v in rows})] for a, b in zip(values, values[1:])]
    most = max(max(v) for _, v in rows) - min(min(v) for _, v in rows)
    bits = int(__import__("math").log2(most / min(gaps)))

    def plain(scale_bits, radius):
        width = widest / (1 << bits)
        cells = [tuple(min((1 << bits) - 1, int((x - a) / width)) >> (bits - scale_bits) for x, a in zip(v, low)) for _, v in rows]
        root = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if all(abs(x - y) <= radius for x, y in zip(cells[i], cells[j])):
                    a, b = root[i], root[j]
                    root = [b if x == a else x for x in root]
        return root

    def partition(labels_):
        seen = {}
        return [seen.setdefault(x, len(seen)) for x in labels_]

    one = engine.run_weber(items, 2).cache()
    for s in (1, 3):
        assert partition(labels(one, s)) == partition(plain(s + 1, 1))
    half = engine.run_weber(items, 2, 0.5, scales=[bits - 4, bits - 2, bits]).cache()
    for s in (bits - 4, bits - 2, bits):
        assert partition(labels(half, s)) == partition(plain(bits, int(1.5 ** (bits - s))))
    same = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "item_id long, vec array<double>")
    assert labels(engine.run_weber(same, 1), 0) == [0, 0]
    with pytest.raises(ValueError):
        engine.run_weber(items, 2, 0.9, scales=[0])


def test_edges_and_components_are_kept(spark, tmp_path):
    edges = spark.createDataFrame([(1, 5, 2), (1, 2, 9), (2, 4, 3)], "scale int, u long, v long")
    io.write_edges(edges, str(tmp_path / "edges"))
    assert (tmp_path / "edges" / "scale=1").is_dir()
    again = io.read_edges(spark, str(tmp_path / "edges"))
    assert sorted(map(tuple, again.select("scale", "u", "v").collect())) == [(1, 2, 9), (1, 5, 2), (2, 4, 3)]
    found = grouped_components(again.select("scale", "u", "v"), ["scale"])
    io.write_components(found, str(tmp_path / "components"))
    heads = {f.read_text().splitlines()[0] for f in (tmp_path / "components").glob("scale=*/*.csv")}
    assert heads == {"__id,component_id"}
    assert sorted(map(tuple, io.read_components(spark, str(tmp_path / "components")).collect())) == [(1, 2, 2), (1, 5, 2), (1, 9, 2), (2, 3, 3), (2, 4, 3)]
    io.write_edges(edges.limit(0), str(tmp_path / "none"))
    nothing = io.read_edges(spark, str(tmp_path / "none")).select("scale", "u", "v")
    assert nothing.count() == 0
    io.write_components(grouped_components(nothing, ["scale"]), str(tmp_path / "no-components"))
    assert io.read_components(spark, str(tmp_path / "no-components")).count() == 0


@pytest.mark.parametrize("model", ["SD", "MIN", "by_rows"])
def test_job_in_one_and_in_steps(spark, tmp_path, model):
    from scalecluster import job

    (tmp_path / "in.txt").write_text("\n".join({"SD": SD7, "by_rows": SD7 * 2}.get(model) or [" ".join(f"{c}.0" for c in t) for t in MIN5]))
    env = {"DATA_PATH": str(tmp_path / "in.txt"), "CODE_MODEL": model, "LAMBDA": "0.5", "START_SCALE": "1", "END_SCALE": "0", "DATA_STANDARDIZATION": "FALSE", "NUMBER_OF_HASHTABLES": "10", "NUMBER_OF_BUCKETS": "5", "SPARK_DEFAULT_PARALLELISM": "4"}
    job.run(spark, env | {"OUTPUT_PATH": str(tmp_path / "one")})
    for step in "123":
        job.run(spark, env | {"OUTPUT_PATH": str(tmp_path / "three"), "STEP": step})
        assert (tmp_path / "three" / "tmp").exists() == (step != "3")
    rows = [sorted((r.scale, r.item_id, r.cluster) for r in io.read_clusters(spark, str(tmp_path / n / "clusters")).collect()) for n in ("one", "three")]
    assert rows[0] == rows[1]
    by_scale = {s: [int(c) for t, _, c in rows[0] if t == s] for s in {t for t, _, _ in rows[0]}}
    if model == "SD":
        assert by_scale[4] == [0, 0, 0, 255, 255, 170, 193] and set(by_scale) == {1, 2, 3, 4, 5}
    elif model == "by_rows":
        assert by_scale[4] == [0, 0, 0, 255, 255, 170, 193] * 2
    else:
        assert by_scale[4] == [0, 0, 2, 2, 2] and set(by_scale) == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        job.run(spark, env | {"OUTPUT_PATH": "x", "STEP": "4"})


def test_job_of_nothing(spark, tmp_path):
    from scalecluster import job

    (tmp_path / "in.txt").write_text("")
    job.run(spark, {"DATA_PATH": str(tmp_path / "in.txt"), "OUTPUT_PATH": str(tmp_path / "out")})
    assert not (tmp_path / "out" / "tmp").exists() and not (tmp_path / "out" / "clusters").exists()


def test_lines_are_numbered_across_files_and_blocks(spark, tmp_path):
    rows = [f"{i}.5,{i % 7}.0" for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(rows[:2500]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(rows[2500:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = io.read_text(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.item_id, r.vec[0]) for r in got) == [(i, i + 0.5) for i in range(4000)]


def test_min_gap_of_many_ranges(spark):
    r = random.Random(2)
    rows = [(i, [round(r.random() * 50, 2), float(r.randrange(9)), 3.0]) for i in range(400)] + [(400, [float("nan"), 2.0, 3.0])]
    got = {x.dim: x.gap for x in stats.min_gap(spark.createDataFrame(rows, "item_id long, vec array<double>").repartition(5)).collect()}
    for j in (0, 1):
        values = sorted({v[j] for _, v in rows if v[j] == v[j]})
        assert got[j] == min(b - a for a, b in zip(values, values[1:]))
    assert set(got) == {0, 1}


def test_joins_of_hot_keys(spark, monkeypatch):
    from scalecluster.operators import skew

    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(k, k) for k in range(1, 9)] + [(None, 1)], "k int, x int")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("x").alias("m"))
    expected = sorted(map(tuple, rows.join(table.drop("_n"), "k").collect()))
    assert sorted(map(tuple, skew.join_counted(rows, table, ["k"], 59).collect())) == expected
    monkeypatch.setattr(skew, "LEAST_HOT", 10)
    split = skew.join_counted(rows, table, ["k"], 59)
    assert sorted(map(tuple, split.collect())) == expected
    groups = spark.createDataFrame([(a, i, i % 5) for a in "xy" for i in range(30)], "a string, i long, n long")
    got = {(r.a, r.i): r.before for r in skew.totals_before(groups, ["a"], "i", "n", "before", block=4).collect()}
    assert got == {(a, i): sum(j % 5 for j in range(i)) for a in "xy" for i in range(30)}


def test_components_of_a_hub(spark, monkeypatch):
    from scalecluster.operators import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(59, 100)], "u long, v long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(i, 0) for i in [*range(60), *range(100, 121)]}


def test_large_clusters_are_listed_in_parts(spark):
    clusters = spark.range(40).select(F.lit(1).alias("scale"), F.col("id").alias("item_id"), (F.col("id") % 2 * (F.col("id") < 8).cast("long")).alias("cluster"))
    names = spark.range(40).select(F.col("id").alias("item_id"), F.format_string("n%02d", "id").alias("name"))
    got = evaluate.cluster_members(clusters, names, chunk=10).collect()
    assert len({r.part for r in got if r.cluster == 0}) > 1 and [r.members for r in got if r.cluster == 1] == [["n01", "n03", "n05", "n07"]]
    assert sorted(x for r in got for x in r.members) == [f"n{i:02}" for i in range(40)] and all(r.members == sorted(r.members) for r in got)


def test_members_of_a_large_cluster_are_one_row(spark, tmp_path):
    from scalecluster.plans import catalogue

    # two clusters at scale 4, one of them larger than a part of a list; every name occurs twice
    spark.range(240_000).selectExpr("id AS c_custkey", "format_string('n%06d', id * 7919 % 120000) AS c_name", "0 AS c_nationkey", "if(id < 1000, -900.0d, id % 500 + 0.25d) AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    rows = catalogue.QUERIES["cluster_members"](spark, str(tmp_path)).filter("scale = 4").collect()
    names = [f"n{i * 7919 % 120_000:06}" for i in range(240_000)]
    assert sorted(r.members for r in rows) == sorted(",".join(sorted(x)) for x in (names[:1000], names[1000:]))


def test_parts_of_members_are_put_together(spark):
    clusters = spark.range(60).select(F.lit(1).alias("scale"), F.col("id").alias("item_id"), (F.col("id") >= 50).cast("long").alias("cluster"))
    names = spark.range(60).selectExpr("id AS item_id", "if(id >= 50, null, if(id = 3, '', format_string('n%02d', id * 7 % 20))) AS name").repartition(3)
    expected = ",".join(sorted("" if i == 3 else f"n{i * 7 % 20:02}" for i in range(50)))
    for chunk in (7, 100):
        found = evaluate.cluster_members(clusters, names, chunk=chunk)
        assert {r.cluster: r.members for r in evaluate.cluster_texts(found).collect()} == {0: expected, 1: None}
        assert (found.count() > 2) == (chunk == 7)


def test_scratch_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from scalecluster import scratch

    class Context:
        master, applicationId = "spark://host:7077", "x"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, *a: None})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())
    Context.master = "local[2]"
    assert scratch.shared_dir(Session()).startswith("file://")
    since = scratch.mark()
    one, two = scratch.materialise(spark.range(3), "one"), scratch.bucketed(spark.range(5), "two", "id")
    assert one.count() == 3 and two.count() == 5
    scratch.release(spark, since, one)
    assert one.count() == 3 and not spark.catalog.tableExists("scratch_" + two._scratch_path.rsplit("-", 1)[1])
    scratch.discard(one)


def test_models_by_rows(spark):
    config = ClusterConfig(model="by_rows")
    assert [engine.resolve_model(config, 2, n) for n in (9, 10)] == ["MIN", "SD"] and engine.resolve_model(config, 9, 10**6) == "MIN"
    items = spark.createDataFrame([(i, [float(i % 4), float(i % 3)]) for i in range(12)], "item_id long, vec array<double>")
    assert engine.cluster(items, ClusterConfig(model="by_rows", standardise=False, scales=(1,))).count() == 12
    assert engine.run_highd(items, 2, 1.0, scales=[99]).count() == 0 and engine.run_gaussian(items, 2, 1.0, scales=[]).count() == 0
