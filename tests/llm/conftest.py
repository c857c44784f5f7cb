import random

import pytest


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empty, blank and short texts, copies, near copies, shared
    passages, a long text, repeated rows."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = say(40), say(300)
    rows = [(i, say(r.randint(1, 120))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "One"), (64, "two  words\n"), (65, "\x0b"), (66, "Ünï ñ 漢字, … “q” 😀 it's 12%")]
    rows += [(70 + i, say(10) + "\n" + passage + " " + say(9)) for i in range(12)]
    rows += [(90 + i, base) for i in range(10)] + [(105 + i, base.replace(base.split()[i * 7], "zz", 1)) for i in range(10)]
    rows += [(120, say(9000)), (121, base[: len(base) // 2] + " " + passage), (90, base), (5, say(30)), (None, base), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs_frame(spark, odd_docs):
    """The rows as a table with more columns, some of whose names the operators use too."""
    rows = [(t, i, "x", 1, 0.5) for i, t in odd_docs]
    return spark.createDataFrame(rows, "text string, doc_id long, bucket string, n_words int, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
