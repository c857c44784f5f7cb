import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scalecluster.llm import textkit
from scalecluster.llm.bpe import PartEncoder, default_vocabulary
from scalecluster.llm.rlz import _rolling_min, locate_pairs

from . import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list(" \t\n\x0b\x1c\x00aB'sÉé1,.! 　 漢😀<|endoftext|>")), max_size=40)), max_size=12)
ENCODER = PartEncoder(default_vocabulary())
LIBRARY = Tokenizer.from_file(default_vocabulary())  # as it is: brute.encode's doesn't match special tokens


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_match_the_expressions(texts):
    column = pa.array(texts, pa.string())
    for rule, pattern in ((textkit.NOT_SPACE, brute.SPACE_WORD), (textkit.ALNUM, brute.ALNUM_WORD)):
        w = textkit.Words(column, rule, lower=True)
        got = [[w.word(i).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(w.rows)]
        assert got == [pattern.findall(brute.lower(t)) for t in texts]
        kept = textkit.joined_words(w, np.ones(len(w), dtype=bool))
        assert [k.decode() for k in kept] == [" ".join(x) for x in got]
        h = w.hashes()
        flat = [x for row in got for x in row]
        assert len(set(h.tolist())) == len(set(flat)) and len({*zip(flat, h.tolist())}) == len(set(flat))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_parts_give_the_library_ids(texts):
    ids, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == brute.encode(texts)


SPECIAL_TEXTS = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "\t", "ab", "'s", "1", "é", "漢", "."]), max_size=12).map("".join)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(SPECIAL_TEXTS)
def test_special_tokens_in_texts_give_the_library_ids(texts):
    texts = ["end.<|endoftext|>Next", "cut <|endof", "text|>here", *texts]
    ids, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    assert ids[:5].tolist() == [437, 13, 50256, 10019, 0]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [LIBRARY.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_hashes_do_not_depend_on_segments(monkeypatch):
    texts = pa.array(["some words " * 50, "x" * 500, "some words"])
    a = textkit.Words(texts, textkit.NOT_SPACE, True).hashes()
    monkeypatch.setattr(textkit, "SEGMENT", 64)
    assert (textkit.Words(texts, textkit.NOT_SPACE, True).hashes() == a).all()


def test_pieces_hold_all_rows_and_bounded_bytes():
    texts = ["a" * n for n in (1, 5000, 3, 0, 70, 90000, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(textkit.pieces([batch, batch.slice(0, 0), batch.slice(2, 3)], "t", limit=100))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts + texts[2:5]
    assert all(p.num_rows == 1 or sum(map(len, p.column(0).to_pylist())) <= 100 for p in parts)


@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 12))
def test_rolling_min(values, width):
    x = np.array(values, dtype=np.uint64)
    assert _rolling_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), max_size=20), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), max_size=20))
def test_locate_pairs(a, b):
    split = lambda p: (np.array([x for x, _ in p], dtype=np.int64), np.array([y for _, y in p], dtype=np.uint64))
    found = locate_pairs(*split(a), *split(b))
    assert [(a[k] if k >= 0 else None) for k in found] == [p if p in a else None for p in b]
