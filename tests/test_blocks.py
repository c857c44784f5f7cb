import random

import pytest

from scalecluster.operators import blocks
from scalecluster.plans import engine

D = 12
LADDER = [3, 4, 5, 6]  # thresholds 1.5^s / 12


def vectors(kind):
    r = random.Random(11)
    base = [[r.gauss(0, 1) for _ in range(D)] for _ in range(6)]
    rows = [(10 * i, [x + r.gauss(0, 0.7) for x in base[i % 6]]) for i in range(150)]
    if kind == "copies":  # more neighbours are kept than a task passes on, ties go by id
        rows += [(10 * i + 1, base[0]) for i in range(30)] + [(10 * i + 2, [2 * x for x in base[1]]) for i in range(12)]
        rows += [(5000 + i, [0.0] * D) for i in range(7)]
    return rows


def labelled(df):
    return sorted((r.scale, r.item_id, r.cluster) for r in df.collect())


@pytest.mark.parametrize("kind", ["near", "copies"])
@pytest.mark.parametrize("run", [engine.run_highd, engine.run_gaussian])
def test_blocks_find_the_components_of_all_pairs(spark, monkeypatch, kind, run):
    items = spark.createDataFrame(vectors(kind), "item_id long, vec array<double>").repartition(3)
    monkeypatch.setattr(engine, "PAIRS_AN_ITEM", 10**9)
    expected = labelled(run(items, D, 0.5, scales=LADDER))
    monkeypatch.setattr(engine, "PAIRS_AN_ITEM", 0)
    monkeypatch.setattr(blocks, "LEAST_BLOCKS", 3)
    got = labelled(run(items, D, 0.5, scales=LADDER))
    assert got == expected and 1 < len({c for _, _, c in got}) < len(items.collect())
    texts = items.selectExpr("format_string('k%05d', item_id) AS item_id", "vec")
    assert labelled(run(texts, D, 0.5, scales=LADDER)) == [(s, f"k{i:05d}", f"k{c:05d}") for s, i, c in expected]


@pytest.mark.parametrize("run", [engine.run_highd, engine.run_gaussian])
def test_dense_buckets_write_no_pairs_as_rows(spark, monkeypatch, run):
    monkeypatch.setattr(blocks, "LEAST_BLOCKS", 2)
    monkeypatch.setattr(engine, "_weber_pairs", lambda *a: pytest.fail("pairs as rows"))
    items = spark.range(400).selectExpr("id AS item_id", "transform(array(1d, 2d, 3d), x -> if(id % 2 = 0, x, -x)) AS vec")
    found = labelled(run(items, 3, 0.5, scales=[1]))
    assert found == [(1, i, i % 2) for i in range(400)]
