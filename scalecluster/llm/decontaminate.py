"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (``window`` successive words; a shorter item is one window)
are sets of ``shingle``-word shingles.  A document holds a window only if it
holds all of its shingles (overlap 1.0), so the necessary prefix is a single
shingle: the window's rarest one by the counts over all documents.  Documents'
shingles are joined with those prefixes; a match fixes where the window would
start, which length and position bounds must allow, and the window is then
verified word for word there.

Items of at most ``block_bytes`` of text make one index that is sent to the tasks
that scan the documents; nothing is shuffled but counts.  Of more items, windows
and prefixes are tables: the documents are scanned twice, whatever the number of
items, once to count the items' shingles and once for the prefixes, and only what
a bitmap of fixed size lets through (the places of shingles that items have, with
the words around them) is shuffled to be joined and verified.  Both ways give the
same rows.  The bitmap of 2^BITMAP_BITS bits lets more through as items grow
beyond some 10^7 words.

Defined cases: a null or wordless document has no words and no hits; items
without words have no windows; rows with equal item ids are one item; a null
item id counts as the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_counted
from ..scratch import discard, materialise
from ..session import map_arrow
from .textkit import ALNUM, Words, pieces, shingle_hashes, spans

WINDOW = 10
SHINGLE = 5
#: Text bytes of items that make one broadcast index.
BLOCK_BYTES = 8 << 20
TABLE_BITS, BITMAP_BITS = 20, 27


class ItemWindows:
    """The distinct windows of a block of items."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int = WINDOW, shingle: int = SHINGLE):
        words = Words(texts, ALNUM, lower=True)
        hashes = words.hashes()
        counts = words.counts
        self.ids = np.array(sorted(set(ids)), dtype=object)
        id_of = np.searchsorted(self.ids, np.array(ids, dtype=object)) if ids else np.empty(0, np.int64)
        size = np.minimum(counts, window)
        number = np.where(counts > 0, counts - size + 1, 0)
        start = spans(words.first[:-1], number)
        self.length = np.repeat(size, number)
        self.item = np.repeat(id_of, number)
        self.words = np.zeros((len(start), window), dtype=np.uint64)
        for j in range(window):
            ok = self.length > j
            self.words[ok, j] = hashes[start[ok] + j]
        # windows with the same words in the same item are one
        if len(start):
            _, once = np.unique(np.column_stack([self.words, self.item.astype(np.uint64), self.length.astype(np.uint64)]), axis=0, return_index=True)
            self.length, self.item, self.words = self.length[once], self.item[once], self.words[once]
        self.sizes = sorted({int(min(s, shingle)) for s in self.length})
        self.shingle = shingle

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, offset and hash of all shingles of the windows whose shingles have this size."""
        at = np.flatnonzero(np.minimum(self.length, self.shingle) == size)
        number = self.length[at] - size + 1
        window = np.repeat(at, number)
        offset = spans(np.zeros(len(at), np.int64), number)
        columns = self.words[window[:, None], offset[:, None] + np.arange(size)]
        hashes = np.concatenate([shingle_hashes(row, size) for row in columns]) if len(columns) else np.empty(0, np.uint64)
        return window, offset, hashes

    def index(self, frequency: dict[int, int]) -> list[dict]:
        """For each shingle size the sorted prefix keys and their windows."""
        out = []
        for size in self.sizes:
            window, offset, hashes = self.shingles(size)
            count = np.array([frequency.get(int(h), 0) for h in hashes.view(np.int64)], dtype=np.int64)
            order = np.lexsort((hashes, count, window))  # the rarest first; ties by hash
            first = order[np.unique(window[order], return_index=True)[1]]
            by_key = first[np.argsort(hashes[first], kind="stable")]
            keys, start = np.unique(hashes[by_key], return_index=True)
            table = np.zeros(1 << TABLE_BITS, dtype=bool)
            table[keys >> np.uint64(64 - TABLE_BITS)] = True
            out.append({"size": size, "keys": keys, "start": np.append(start, len(by_key)), "window": window[by_key], "offset": offset[by_key], "table": table})
        return out


def _lookup(index: dict, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``hashes`` that are keys, and which keys."""
    maybe = np.flatnonzero(index["table"][hashes >> np.uint64(64 - TABLE_BITS)])
    key = np.minimum(np.searchsorted(index["keys"], hashes[maybe]), len(index["keys"]) - 1)
    ok = index["keys"][key] == hashes[maybe]
    return maybe[ok], key[ok]


def find(words: Words, hashes: np.ndarray, items: ItemWindows, index: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Start word and window number of every occurrence."""
    starts, windows = [], []
    for part in index:
        at = words.fits(part["size"])
        place, key = _lookup(part, shingle_hashes(hashes, part["size"])[at])
        number = part["start"][key + 1] - part["start"][key]
        entry = spans(part["start"][key], number)
        pos = np.repeat(at[place], number)
        window = part["window"][entry]
        start = pos - part["offset"][entry]
        row = np.searchsorted(words.first, pos, "right") - 1
        length = items.length[window]
        ok = (start >= words.first[row]) & (start + length <= words.first[row + 1])
        start, window, length = start[ok], window[ok], length[ok]
        for j in range(items.words.shape[1]):
            same = (length <= j) | (hashes[np.minimum(start + j, len(hashes) - 1)] == items.words[window, j])
            start, window, length = start[same], window[same], length[same]
        starts.append(start)
        windows.append(window)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(windows)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``(_item, _text)``, and the bytes of text."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_item"), F.col(text_col).alias("_text"))
    return rows, rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0


def shingle_frequency(texts: DataFrame, items: ItemWindows) -> dict[int, int]:
    """Counts over all documents of the items' shingles (at most those keys)."""
    wanted = {s: np.unique(items.shingles(s)[2]) for s in items.sizes}
    wanted = [{"size": s, "keys": k, "table": _table(k)} for s, k in wanted.items() if len(k)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(w["keys"]), np.int64) for w in wanted]
        for b in pieces(batches, "_text"):
            words = Words(b.column(0), ALNUM, lower=True)
            hashes = words.hashes()
            for w, count in zip(wanted, counts):
                _, key = _lookup(w, shingle_hashes(hashes, w["size"])[words.fits(w["size"])])
                count += np.bincount(key, minlength=len(count))
        for w, count in zip(wanted, counts):
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(w["keys"][some].view(np.int64)), pa.array(count[some])], ["shingle", "n"])

    if not wanted:
        return {}
    found = texts.transform(map_arrow, run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def _table(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[keys >> np.uint64(64 - TABLE_BITS)] = True
    return table


def _index(texts: DataFrame, items: DataFrame, window: int, shingle: int):
    """The broadcast windows and prefix index of a bounded table of items."""
    table = items.toArrow()
    found = ItemWindows(table.column(0).to_pylist(), table.column(1).combine_chunks(), window, shingle)
    return texts.sparkSession.sparkContext.broadcast((found, found.index(shingle_frequency(texts, found))))


class Hits:
    """Hit words of a batch, and the (row, item) pairs that occur."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts, ALNUM, lower=True)
        self.hashes = self.words.hashes()
        self.cover = np.zeros(len(self.words) + 1, dtype=np.int64)
        self.pairs: set[tuple[int, str]] = set()

    def add(self, items: ItemWindows, index: list[dict]) -> None:
        start, window = find(self.words, self.hashes, items, index)
        np.add.at(self.cover, start, 1)
        np.add.at(self.cover, start + items.length[window], -1)
        row = np.searchsorted(self.words.first, start, "right") - 1
        both = np.unique(row * np.int64(len(items.ids) + 1) + items.item[window])
        self.pairs.update((int(p) // (len(items.ids) + 1), items.ids[int(p) % (len(items.ids) + 1)]) for p in both)

    def hit_counts(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(self.cover[:-1]) > 0)])[self.words.first])

    def item_lists(self) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in range(self.words.rows)]
        for row, item in sorted(self.pairs):
            out[row].append(item)
        return out


def _scan(docs: DataFrame, index, emit, text_col: str, schema) -> DataFrame:
    """One pass over docs; ``emit(batch, hits)`` makes the output."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            hits = Hits(b.column(b.schema.names.index(text_col)))
            hits.add(*index.value)
            yield emit(b, hits)

    return docs.transform(map_arrow, run, schema)


# --- items of any size ---------------------------------------------------------


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``(_item, _length, _words, _shingles)`` of all windows; shingles in order of their places."""

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            found = ItemWindows(b.column(0).to_pylist(), b.column(1), window, shingle)
            for size in found.sizes:
                at, _, hashes = found.shingles(size)
                rows = np.unique(at)
                length = found.length[rows]
                words = found.words[rows][np.arange(window) < length[:, None]]
                yield pa.RecordBatch.from_arrays([pa.array(found.ids[found.item[rows]], pa.string()), pa.array(length, pa.int32()), lists(words, length), lists(hashes, length - size + 1)], ["_item", "_length", "_words", "_shingles"])

    return items.transform(map_arrow, run, "_item string, _length int, _words array<long>, _shingles array<long>")


def _bitmap(keys: DataFrame):
    """A broadcast bitmap of the first bits of the column ``shingle``."""
    place = F.shiftrightunsigned("shingle", 64 - BITMAP_BITS) + 1  # Spark's places start at 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # 2^BITMAP_BITS bits at most
    bits = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r.bits, np.uint8)
        bits[(r.part - 1) * len(part) : r.part * len(part)] = part
    return keys.sparkSession.sparkContext.broadcast(bits)


def _let_through(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)


def _counted(texts: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """``(shingle, n)``: counts over all documents of what the bitmap lets through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            words = Words(b.column(0), ALNUM, lower=True)
            hashes = words.hashes()
            found = [(h := shingle_hashes(hashes, k)[words.fits(k)])[_let_through(bitmap.value, h)] for k in sizes]
            shingle, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return texts.transform(map_arrow, run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, bitmap, sizes: list[int], window: int) -> DataFrame:
    """A row ``(_key, doc_id, n_words)`` for each document, and one ``(_key, _at, shingle,
    _before, _around)`` for each place that the bitmap lets through: the hashes of
    up to window - 1 words before it and of the words from there on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "doc_id", "n_words", "_at", "shingle", "_before", "_around"]
        types = [pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        for b in pieces(batches, "_text"):
            words = Words(b.column(2), ALNUM, lower=True)
            none = [pa.nulls(b.num_rows, t) for t in types[3:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words.counts), *none], names)
            hashes = words.hashes()
            for k in sizes:
                at = words.fits(k)
                found = shingle_hashes(hashes, k)[at]
                hit = _let_through(bitmap.value, found)
                at, found = at[hit], found[hit]
                row = np.searchsorted(words.first, at, "right") - 1
                before = np.minimum(at - words.first[row], window - 1)
                size = np.minimum(at + window, words.first[row + 1]) - at + before
                around = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(hashes[spans(at - before, size)].view(np.int64)))
                columns = [b.column(0).take(pa.array(row)), pa.nulls(len(at), b.column(1).type), pa.nulls(len(at), pa.int64()), pa.array(at - words.first[row]), pa.array(found.view(np.int64)), pa.array(before, pa.int32()), around]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.transform(map_arrow, run, f"_key long, doc_id {kind}, n_words long, _at long, shingle long, _before int, _around array<long>")


def _joined(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``contamination`` by joins; docs has ``_id, _text``."""
    windows = materialise(_windows(items, window, shingle).withColumn("_window", F.monotonically_increasing_id()), "item-windows")
    sizes = sorted(r.s for r in windows.select(F.least("_length", F.lit(shingle)).alias("s")).distinct().collect())
    each = windows.select("_window", F.posexplode("_shingles").alias("_offset", "shingle"))
    keys = each.select("shingle").distinct()
    counts = _counted(docs.select("_text"), _bitmap(keys), sizes).join(keys, "shingle")
    # the rarest shingle of a window; a window with one that no document has can't occur
    rarest = each.join(counts, "shingle", "left").groupBy("_window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "_offset")).alias("_first"))
    rarest = rarest.filter("_first.n > 0").select("_window", F.col("_first.n").alias("_n"), F.col("_first.shingle").alias("shingle"), F.col("_first._offset").alias("_offset"))
    prefixes = materialise(windows.drop("_shingles").join(rarest, "_window"), "prefixes")
    keyed = docs.select(F.monotonically_increasing_id().alias("_key"), "_id", "_text")
    places = materialise(_places(keyed, _bitmap(prefixes), sizes, window), "places")
    at = places.filter("shingle is not null").drop("doc_id", "n_words")
    total = at.count()
    fits = F.slice("_around", F.col("_before") - F.col("_offset") + 1, F.col("_length")) == F.col("_words")
    inside = (F.col("_offset") <= F.col("_before")) & (F.col("_before") - F.col("_offset") + F.col("_length") <= F.size("_around"))
    hits = join_counted(at, prefixes.drop("_window"), ["shingle"], total).filter(inside & F.when(inside, fits))
    hits = materialise(hits.select("_key", "_item", (F.col("_at") - F.col("_offset")).alias("_start"), "_length").distinct(), "hits")
    discard(windows, prefixes)
    covered = hits.select("_key", F.explode(F.sequence("_start", F.col("_start") + F.col("_length") - 1)).alias("_word")).distinct().groupBy("_key").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = hits.select("_key", "_item").distinct().groupBy("_key").agg(F.sort_array(F.collect_list("_item")).alias("items"))
    out = places.filter("shingle is null").select("_key", "doc_id", "n_words").join(covered, "_key", "left").join(listed, "_key", "left")
    n_hit, of = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(of).cast("long").alias("n_items"), F.sha2(F.array_join(of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), of.alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items)``,
    one row for each input row; ``items`` lists the ids, sorted as strings."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    items, size = _items(benchmark, item_col, item_text)
    if size > block_bytes:
        return _joined(docs, items, window, shingle)

    def emit(b: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        hit, lists = hits.hit_counts(), hits.item_lists()
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(hits.words.counts), pa.array(hit), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array(hit > 0), pa.array(lists, pa.list_(pa.string()))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )

    kind = docs.schema["_id"].dataType.simpleString()
    return _scan(docs, _index(docs.select("_text"), items, window, shingle), emit, "_text", f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    items, size = _items(benchmark, item_col, item_text)
    if size > block_bytes:
        rows = materialise(docs.select(F.monotonically_increasing_id().alias("_id"), F.struct("*").alias("_row")), "rows")
        found = _joined(rows.select("_id", F.col("_row").getField(text_col).alias("_text")), items, window, shingle)
        gone = found.filter("contaminated").select(F.col("doc_id").alias("_id"))
        return rows.join(gone, "_id", "left_anti").select("_row.*")

    def emit(b: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        return b.filter(pa.array(hits.hit_counts() == 0))

    return _scan(docs, _index(docs.select(F.col(text_col).alias("_text")), items, window, shingle), emit, text_col, docs.schema)
