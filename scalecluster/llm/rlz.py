"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks.

Every document is a reference block for the documents with larger ids.  The
index holds each window (``window`` successive words) once, at the first place
of the least id in which it starts.  A document is parsed greedily: a factor
begins at a word whose window stands in the block of a smaller id and is
prolonged word by word as long as the next window stands at the next place of
the same block, so a factor is a copy of ``length`` successive words of its block.
At a factor's end the windows that straddle the boundary are looked up, too, and
begin factors of their own.  Words inside factors are duplicates.

To index every window would shuffle the corpus several times over, so there are
three indexes, each for what the one before leaves open:

* Anchors.  A window is represented by its minimiser, the least hash among its
  ``anchor``-word shingles.  Equal windows have equal minimisers, so only windows
  whose minimiser occurs in two rows can be shared.
* Runs.  Successive windows with one minimiser are a run.  A run that a smaller
  id has, too, is a piece of a factor as a whole: most of a copy is found here.
* Windows.  Of the runs that a document is the first to have, those whose anchor
  has other runs as well may share some windows with them; these are indexed.
  Whatever a smaller id has is found: its least id is the first to have its run.

All phases work alike: a task combines what its own documents share and passes on
one row for each anchor, run or window that it holds, so the commonest passage of
the corpus makes one row a task; these rows meet by hash, and what is found
returns to the documents.  What returns to a document is bounded by its own
length.  Texts are shuffled once, into buckets of their ids, and are then read
where they are.

Windows and runs are equal if 96 bits of two hashes of their words are: among
10^13 distinct windows one wrong pair is expected with probability 0.001.

Defined cases: null, empty and short texts have no window and lose nothing; a
null id owns nothing and loses nothing; rows with equal ids are never each
other's duplicates.  Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_counted
from ..scratch import bucketed, discard, materialise
from ..session import map_arrow
from .textkit import NOT_SPACE, STEP, Words, joined_words, mix, pieces, shingle_hashes, spans

WINDOW = 13
ANCHOR = 5
#: Windows of a run at most.
RUN = 32
#: Rows that a task combines at a time, at most about.
COMBINED = 1 << 19
#: What a row of an index phase is: to be looked up, known to be shared by more
#: rows of its task, or an answer that the task could give itself.
ASKS, MARKS, ANSWERS = 0, 1, 2


def _rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values."""
    if len(x) < width:
        return x[:0]
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(words: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows, and each one's minimiser."""
    at = words.fits(window)
    return at, _rolling_min(shingle_hashes(hashes, anchor), window - anchor + 1)[at]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every ``window`` successive words: 64 bits and 32 bits."""
    return shingle_hashes(hashes, window), (shingle_hashes(hashes, window, STEP[::-1]) >> np.uint64(32)).astype(np.uint32)


class Gathered:
    """Rows of successive batches: arrays of numbers, and the ids they belong to."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.ids, self.parts, self.documents, self.size = kind, [], [], 0, 0

    def add(self, ids: pa.Array, row: np.ndarray, *columns: np.ndarray) -> bool:
        """Rows ``columns`` of the documents ``row`` of ``ids``; whether it is time to combine."""
        self.ids.append(ids)
        self.parts.append((row + self.documents, *columns))
        self.documents += len(ids)
        self.size += len(row)
        return self.size >= COMBINED

    def take(self) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
        """The ids in ascending order, each row's place among them, and the columns."""
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], self.kind)
        known = ids.unique()
        known = known.take(pa.compute.sort_indices(known))
        place = pa.compute.index_in(ids, known).to_numpy(zero_copy_only=False)
        row, *columns = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0, np.int64),)
        self.__init__(self.kind)
        return known, place[row].astype(np.int64) if len(row) else row, columns


def combined_anchors(gathered: Gathered) -> pa.RecordBatch:
    """``(anchor, id, role)``: a row to look up for each anchor of one document;
    of the others, a mark, and an answer for each document that has them."""
    ids, place, columns = gathered.take()
    anchor = columns[0] if columns else np.empty(0, np.uint64)
    order = np.lexsort((place, anchor))
    anchor, place = anchor[order], place[order]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = anchor[1:] != anchor[:-1]
    once = new | np.append(False, place[1:] != place[:-1])[: len(new)]
    anchor, place, new = anchor[once], place[once], new[once]
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    many = np.repeat(size > 1, size)
    role = np.where(many, ANSWERS, ASKS).astype(np.int8)
    marks = np.flatnonzero(new & many)
    at = np.append(np.arange(len(anchor)), marks)
    return pa.RecordBatch.from_arrays([_signed(anchor[at]), ids.take(pa.array(place[at])), pa.array(np.append(role, np.full(len(marks), MARKS, np.int8)))], ["anchor", "id", "role"])


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(anchor, id, role)`` of every minimiser; docs has ``_id, _text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = None
        for b in pieces(batches, "_text"):
            gathered = gathered or Gathered(b.column(0).type)
            words = Words(b.column(1), NOT_SPACE, lower=False)
            at, least = minimisers(words, words.hashes(), window, anchor)
            rows = words.row_of()[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
            if gathered.add(b.column(0), rows[new], least[new]):
                yield combined_anchors(gathered)
        if gathered:
            yield combined_anchors(gathered)

    return docs.transform(map_arrow, run, f"anchor long, id {docs.schema['_id'].dataType.simpleString()}, role byte")


def combined_places(gathered: Gathered) -> pa.RecordBatch:
    """``(key, check, id, place, owner, owner_place, role[, anchor])`` from rows of
    these: a row to look up for the least document of each key, at its first
    place there, and answers for the other documents."""
    ids, doc, columns = gathered.take()
    key, check, place, *more = columns if columns else (np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int32))
    order = np.lexsort((place, doc, check, key))
    key, check, doc, place = key[order], check[order], doc[order], place[order]
    group, document = np.ones(len(doc), dtype=bool), np.ones(len(doc), dtype=bool)
    group[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    document[1:] = group[1:] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(group)[np.cumsum(group) - 1] if len(group) else np.empty(0, np.int64)
    keep = np.flatnonzero(document)
    first, asks = first[keep], group[keep]
    owner = ids.take(pa.array(doc[first], mask=asks))
    owner_place = pa.array(place[first], pa.int32(), mask=asks)
    role = np.where(asks, ASKS, ANSWERS).astype(np.int8)
    out = [_signed(key[keep]), pa.array(check[keep].view(np.int32)), ids.take(pa.array(doc[keep])), pa.array(place[keep]), owner, owner_place, pa.array(role), *(_signed(m[order][keep]) for m in more)]
    return pa.RecordBatch.from_arrays(out, [*PLACES, *["anchor"] * len(more)])


PLACES = ["key", "check", "id", "place", "owner", "owner_place", "role"]


class Runs:
    """The runs of a batch: row, first word, number of windows, and hashes; and
    the words' hashes."""

    def __init__(self, words: Words, window: int, anchor: int):
        self.hashes = words.hashes()
        self.at, least = minimisers(words, self.hashes, window, anchor)
        self.window, self.window_check = (x[self.at] for x in window_hashes(self.hashes, window))
        rows = words.row_of()[self.at]
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
        index = np.arange(len(self.at))
        new |= (index - np.flatnonzero(new)[np.cumsum(new) - 1]) % RUN == 0 if len(new) else new
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(new)))
        place = index - np.repeat(self.first, self.size)
        self.row, self.anchor = rows[self.first], least[self.first]
        self.place = (self.at[self.first] - words.first[self.row]).astype(np.int32)
        add = lambda x, steps: np.add.reduceat(x * steps[place], self.first) if len(x) else np.empty(0, np.uint64)
        self.key = mix(add(self.window, STEP) + self.size.astype(np.uint64))
        self.check = (mix(add(self.window_check.astype(np.uint64), STEP[::-1]) + self.size.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _in_pieces(batches: Iterable[pa.RecordBatch], window: int, anchor: int, choose) -> Iterator[pa.RecordBatch]:
    """Combined rows of what ``choose(batch, words, runs)`` takes of the batches' runs or windows."""
    gathered = None
    for b in pieces(batches, "_text"):
        gathered = gathered or Gathered(b.column(0).type)
        words = Words(b.column(1), NOT_SPACE, lower=False)
        if gathered.add(b.column(0), *choose(b, words, Runs(words, window, anchor))):
            yield combined_places(gathered)
    if gathered:
        yield combined_places(gathered)


def _of_list(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each entry of a list column, and the entries."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten()


def shared_runs(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """The runs whose anchor is among the row's ``_anchors``; marked has ``_id, _text, _anchors``."""

    def choose(b: pa.RecordBatch, words: Words, runs: Runs) -> tuple[np.ndarray, ...]:
        row, known = _of_list(b.column(2))
        at = np.flatnonzero(contains_pairs(row, known.to_numpy(zero_copy_only=False).view(np.uint64), runs.row, runs.anchor))
        return runs.row[at], runs.key[at], runs.check[at], runs.place[at], runs.anchor[at]

    kind = marked.schema["_id"].dataType.simpleString()
    return marked.transform(map_arrow, lambda batches: _in_pieces(batches, window, anchor, choose), f"key long, check int, id {kind}, place int, owner {kind}, owner_place int, role byte, anchor long")


def open_windows(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """The windows of the runs that ``_runs`` lists without an owner; marked has ``_id, _text, _runs``."""

    def choose(b: pa.RecordBatch, words: Words, runs: Runs) -> tuple[np.ndarray, ...]:
        row, known = _of_list(b.column(2))
        asked = np.asarray(known.field(1).is_null())
        keys = known.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
        open_ = np.flatnonzero(contains_pairs(row[asked], keys[asked], runs.row, runs.key))
        at = spans(runs.first[open_], runs.size[open_])
        row = np.repeat(runs.row[open_], runs.size[open_])
        return row, runs.window[at], runs.window_check[at], (runs.at[at] - words.first[row]).astype(np.int32)

    kind = marked.schema["_id"].dataType.simpleString()
    return marked.transform(map_arrow, lambda batches: _in_pieces(batches, window, anchor, choose), f"key long, check int, id {kind}, place int, owner {kind}, owner_place int, role byte")


def contains_pairs(row_a: np.ndarray, value_a: np.ndarray, row_b: np.ndarray, value_b: np.ndarray) -> np.ndarray:
    """For each pair b whether it is among the pairs a."""
    return locate_pairs(row_a, value_a, row_b, value_b) >= 0


def locate_pairs(row_a: np.ndarray, value_a: np.ndarray, row_b: np.ndarray, value_b: np.ndarray) -> np.ndarray:
    """For each pair b the place of an equal pair a, or -1."""
    out = np.full(len(row_b), -1, dtype=np.int64)
    if not len(row_a) or not len(row_b):
        return out
    values, place_a = np.unique(value_a, return_inverse=True)
    place_b = np.minimum(np.searchsorted(values, value_b), len(values) - 1)
    same = np.flatnonzero(values[place_b] == value_b)
    n = len(values)
    key_a = row_a.astype(np.int64) * n + place_a
    order = np.argsort(key_a, kind="stable")
    key_a = key_a[order]
    key_b = row_b[same].astype(np.int64) * n + place_b[same]
    i = np.minimum(np.searchsorted(key_a, key_b), len(key_a) - 1)
    ok = key_a[i] == key_b
    out[same[ok]] = order[i[ok]]
    return out


def texts_by_id(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """``(_id, _text[, _row])`` in buckets of the ids, and apart those without an id."""
    columns = [F.col(id_col).alias("_id"), *([F.struct("*").alias("_row")] if whole else [F.col(text_col).alias("_text")])]
    text = [F.col("_row").getField(text_col).alias("_text"), "_row"] if whole else ["_text"]
    some = bucketed(docs.filter(F.col(id_col).isNotNull()).select(*columns), "texts", "_id")
    return some, docs.filter(F.col(id_col).isNull()).select(*columns).select("_id", *text)


def _suspects(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(_doc, _anchors)``: each document's minimisers that another row has, too."""
    rows = materialise(anchors(docs, window, anchor), "anchors")
    # one row a task for each anchor, and one more for those that it has seen twice
    seen = F.sum(F.when(F.col("id").isNull(), 2).otherwise(1)).over(Window.partitionBy("anchor"))
    asked = rows.filter(F.col("role") != ANSWERS).select("anchor", F.when(F.col("role") == ASKS, F.col("id")).alias("id"))
    asked = asked.withColumn("_n", seen).filter((F.col("_n") > 1) & F.col("id").isNotNull())
    shared = asked.select("id", "anchor").unionByName(rows.filter(F.col("role") == ANSWERS).select("id", "anchor"))
    suspects = bucketed(shared.groupBy(F.col("id").alias("_doc")).agg(F.collect_set("anchor").alias("_anchors")), "suspects", "_doc", grouped=True)
    discard(rows)
    return suspects


def _asked(rows: DataFrame, *more: str) -> DataFrame:
    """``(key, id, *more, _first struct<id, place>)`` of the rows to be looked up:
    where the least id has the key, null if that is the row's own."""
    first = F.min(F.struct("id", "place")).over(Window.partitionBy("key", "check"))  # one row a task
    asked = rows.filter(F.col("role") == ASKS).withColumn("_first", first)
    return asked.select("key", "id", *more, F.when(F.col("_first.id") < F.col("id"), F.col("_first")).alias("_first"))


def _answers(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``(id, entry)``: where a smaller id has the key."""
    told = rows.filter(F.col("role") == ANSWERS)
    return asked.filter("_first is not null").select("id", _entry("_first.id", "_first.place")).unionByName(told.select("id", _entry("owner", "owner_place")))


def _entry(owner, place) -> Column:
    column = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct("key", column(owner).alias("owner"), column(place).alias("place")).alias("entry")


def _listed(entries: DataFrame, name: str) -> DataFrame:
    return bucketed(entries.groupBy(F.col("id").alias("_doc")).agg(F.collect_list("entry").alias(name)), name.strip("_"), "_doc", grouped=True)


def _runs(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(_doc, _runs array<struct<key, owner, place>>)``: runs that a smaller id
    has, and, with null for the owner, those that are to be looked at by window."""
    suspects = _suspects(docs, window, anchor)
    marked = docs.join(suspects, docs["_id"] == suspects["_doc"]).select("_id", "_text", "_anchors")
    rows = materialise(shared_runs(marked, window, anchor), "runs")
    discard(suspects)
    kinds = rows.schema
    asked = materialise(_asked(rows, "anchor"), "asked-runs")
    own = asked.filter("_first is null").select("id", "key", "anchor")
    # anchors with several runs; the minimum and maximum are partially aggregated
    varied = own.groupBy("anchor").agg(F.min("key").alias("_a"), F.max("key").alias("_b"), F.count(F.lit(1)).alias("_n")).filter("_a < _b").select("anchor", "_n")
    none = (F.lit(None).cast(kinds["owner"].dataType), F.lit(None).cast("int"))
    open_ = join_counted(own, varied, ["anchor"], own.count()).select("id", _entry(*none))
    listed = _listed(_answers(asked, rows).unionByName(open_), "_runs")
    discard(rows, asked)
    return listed


def owners(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """``(_doc, _runs)`` and ``(_doc, _windows)``, arrays of struct<key, owner,
    place>, of the documents that have runs or windows of a smaller id, in
    buckets of ids as docs (``_id, _text``) is."""
    runs = _runs(docs, window, anchor)
    marked = docs.join(runs.filter(F.exists("_runs", lambda r: r["owner"].isNull())), docs["_id"] == F.col("_doc")).select("_id", "_text", "_runs")
    rows = materialise(open_windows(marked, window, anchor), "windows")
    windows = _listed(_answers(_asked(rows), rows), "_windows")
    discard(rows)
    return runs.withColumn("_runs", F.filter("_runs", lambda r: r["owner"].isNotNull())), windows


class Parse:
    """The factors of a batch, from its texts and the owners of its runs and windows."""

    def __init__(self, texts: pa.Array, runs: pa.Array, windows: pa.Array, window: int, anchor: int):
        self.words = words = Words(texts, NOT_SPACE, lower=False)
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        self.row = self.start = self.length = self.place = np.empty(0, np.int64)
        both = pa.concat_arrays([runs.flatten(), windows.flatten()])
        self.owner = both.field(1).slice(0, 0)
        if len(both):
            found = Runs(words, window, anchor)
            rows = np.repeat(found.row, found.size)
            row_of, entries = _of_list(runs)
            entry = locate_pairs(row_of, entries.field(0).to_numpy(zero_copy_only=False).view(np.uint64), found.row, found.key)
            entry = np.repeat(entry, found.size)
            shift = np.arange(len(entry)) - np.repeat(found.first, found.size)  # a window's place in its run
            row_of, windows_ = _of_list(windows)
            single = locate_pairs(row_of, windows_.field(0).to_numpy(zero_copy_only=False).view(np.uint64), rows, found.window)
            shift[entry < 0] = 0
            entry = np.where(entry >= 0, entry, np.where(single >= 0, single + len(entries), -1))
            hit = np.flatnonzero(entry >= 0)
            at, rows, entry, shift = found.at[hit], rows[hit], entry[hit], shift[hit]
            owner = both.field(1).take(pa.array(entry))
            block = owner.dictionary_encode().indices.to_numpy()
            place = both.field(2).to_numpy(zero_copy_only=False)[entry].astype(np.int64) + shift
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (rows[1:] != rows[:-1]) | (block[1:] != block[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            self.row, self.start, self.place, self.owner = rows[first], at[first], place[first], owner.take(pa.array(first))
            self.length = np.diff(np.append(first, len(at))) + window - 1
            np.add.at(covered, self.start, 1)
            np.add.at(covered, self.start + self.length, -1)
        self.removed = np.cumsum(covered[:-1]) > 0

    def counts(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.removed)])[self.words.first])


def _parsed(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int, run, schema, whole: bool = False) -> DataFrame:
    """``run`` over batches of ``(_id, _text[, _row], _runs, _windows)`` of all rows."""
    some, rest = texts_by_id(docs, id_col, text_col, whole)
    texts = some.select("_id", F.col("_row").getField(text_col).alias("_text") if whole else "_text")
    every = some.select(*rest.columns) if not whole else some.select("_id", F.col("_row").getField(text_col).alias("_text"), "_row")
    joined = every
    for owned in owners(texts, window, anchor):
        joined = joined.join(owned, joined["_id"] == owned["_doc"], "left").drop("_doc")
    none = {name: F.lit(None).cast(joined.schema[name].dataType) for name in ("_runs", "_windows")}
    return joined.transform(map_arrow, run, schema).unionByName(rest.withColumns(none).transform(map_arrow, run, schema))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row for each input row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            parse = Parse(b.column(1), b.column(2), b.column(3), window, anchor)
            kept = joined_words(parse.words, ~parse.removed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(parse.words.counts), pa.array(parse.counts()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return _parsed(docs, id_col, text_col, window, anchor, run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, start, length, owner, owner_start)``: the factors, in words;
    both documents have the same ``length`` words there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            p = Parse(b.column(1), b.column(2), b.column(3), window, anchor)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(p.row)), pa.array(p.start - p.words.first[p.row]), pa.array(p.length), p.owner, pa.array(p.place)],
                ["doc_id", "start", "length", "owner", "owner_start"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return _parsed(docs, id_col, text_col, window, anchor, run, f"doc_id {kind}, start long, length long, owner {kind}, owner_start long")


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the duplicate words taken out of its texts.  A text that
    loses nothing stays as it is; else its kept words are joined by one space.
    Columns may have any names: rows travel as one value."""
    names, text_at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            texts, columns = b.column(1), b.column(2).flatten()
            parse = Parse(texts, b.column(3), b.column(4), window, anchor)
            lost = parse.counts() > 0
            if lost.any():
                kept = joined_words(parse.words, ~parse.removed)
                columns[text_at] = pa.array([k.decode("utf-8", "replace") if gone else t.as_py() for k, gone, t in zip(kept, lost.tolist(), texts)], texts.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _parsed(docs, id_col, text_col, window, anchor, run, docs.schema, whole=True)
