"""Token ids in binary shards with a minimal perfect hash index.

A shard is one record: the raw ids of its documents (little-endian uint16 if
the vocabulary allows, else uint32), the documents' offsets into them, and an
index from document keys to documents.  The index is a minimal perfect hash
over the shard's distinct keys, a cascade of bit arrays (public as BBHash), and
for each slot a 32-bit fingerprint of the key, the key's first document and how
many follow it with the same key.  A lookup is a few bit tests and one
comparison; a foreign key passes with probability 2^-32.

Documents are range-partitioned by id, ties told apart by content and place, so
a repeated id doesn't fill one task.  Spark's own writer stores the records
(Parquet as the container, uncompressed, a row group for each shard and a folder
for each task's shards), which commits whole tasks and works on any file system;
a shard's size is bounded, and tasks cut a new one when it is full.

Beside the shards stands a manifest: a row for each with its least and greatest
document id and the ids before it.  A lookup goes by the manifest to the shards
whose range holds the key and reads only these.  The manifest is made, read and
joined as a table; the driver sees none of it.

Defined cases: null and empty texts hold the end id only; null ids come first
and share one key; equal ids are successive documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import totals_before
from ..scratch import scratch_path
from ..session import map_arrow
from .bpe import ENCODE_BYTES, default_vocabulary, encoder
from .textkit import mix, pieces

#: Ids of a shard at most, unless one document has more.
SHARD_IDS = 4 << 20
#: Text bytes that a writing task should get, and those beyond FEW_TASKS tasks:
#: it streams, and the sample that finds the ranges grows with the tasks.
TASK_BYTES, LARGE_TASK_BYTES, FEW_TASKS = 16 << 20, 256 << 20, 4096
#: Rows of a manifest (24 bytes each) that are broadcast; more are joined.
BROADCAST_SHARDS = 1 << 18
LEVELS = 40
SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, n_null long, low {kind}, high {kind}, width int, doc_ids array<{kind}>, keys array<long>, hash binary, slots binary, offsets binary, payload binary"


class MinimalHash:
    """Maps each of n distinct 64-bit keys to its own slot 0 .. n - 1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # bits: uint8, packed, one level after the other
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = bits.view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64(0xA0761D6478BD642F * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        sizes, parts = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, -(-2 * len(keys) // 64) * 64)
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("the keys are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.empty(0, np.uint8))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slots; a foreign key gets any slot, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self._place(keys[left], level, size) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return np.concatenate([[len(self.sizes)], self.sizes]).astype("<i8").tobytes() + self.bits.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> MinimalHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        return cls(np.frombuffer(raw, "<i8", n, 8).astype(np.int64), np.frombuffer(raw, np.uint8, offset=8 * (n + 1)).copy())


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A shard record, opened for keyed access."""

    def __init__(self, hash_: bytes, slots: bytes, offsets: bytes, payload: bytes, width: int):
        self.hash = MinimalHash.load(hash_)
        self.slots = np.frombuffer(slots, "<u4").reshape(-1, 3)  # fingerprint, first document, documents
        self.offsets = np.frombuffer(offsets, "<u4").astype(np.int64)
        self.payload = np.frombuffer(payload, f"<u{width}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; (-1, 0) if it isn't here."""
        slot = self.hash.lookup(keys)
        known = slot >= 0
        known[known] = self.slots[slot[known], 0] == fingerprint(keys[known])
        first, many = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[known], many[known] = self.slots[slot[known], 1], self.slots[slot[known], 2]
        return first, many

    def ids(self, document: int) -> np.ndarray:
        return self.payload[self.offsets[document] : self.offsets[document + 1]].astype(np.uint32)


def _record(part: int, seq: int, doc_ids: list, keys: list, lengths: list, ids: list, width: int, kind: pa.DataType) -> pa.RecordBatch:
    keys_, lengths_, ids_ = np.concatenate(keys), np.concatenate(lengths), np.concatenate(ids)
    new = np.ones(len(keys_), dtype=bool)
    new[1:] = keys_[1:] != keys_[:-1]  # equal ids are neighbours
    first = np.flatnonzero(new)
    distinct = keys_[first].view(np.uint64)
    table = MinimalHash.build(distinct)
    slots = np.empty((len(first), 3), dtype="<u4")
    at = table.lookup(distinct)
    slots[at, 0], slots[at, 1], slots[at, 2] = fingerprint(distinct), first, np.diff(np.append(first, len(keys_)))
    offsets = np.concatenate([[0], np.cumsum(lengths_)])
    documents = pa.concat_arrays(doc_ids)
    some = documents.drop_null()
    low, high = (some[0].as_py(), some[-1].as_py()) if len(some) else (None, None)
    values = [part, seq, len(keys_), len(ids_), documents.null_count, low, high, width, documents, keys_, table.dump(), slots.tobytes(), offsets.astype("<u4").tobytes(), ids_.astype(f"<u{width}").tobytes()]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind, kind, pa.int32(), pa.list_(kind), pa.list_(pa.int64()), *[pa.binary()] * 4]
    names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
    arrays = []
    for v, t in zip(values, types):
        if pa.types.is_list(t):
            flat = v if isinstance(v, pa.Array) else pa.array(v)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(t.value_type)))
        else:
            arrays.append(pa.array([v], t))
    return pa.RecordBatch.from_arrays(arrays, names)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, shard_ids: int = SHARD_IDS, task_bytes: int = TASK_BYTES) -> None:
    """Encodes ``docs`` and writes them to ``path``, in ascending order of ids."""
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col)).alias("_key"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, -(-size // LARGE_TASK_BYTES), min(FEW_TASKS, -(-size // task_bytes)))
    ties = docs.withColumn("_tie", F.xxhash64("_text")).withColumn("_place", F.monotonically_increasing_id())
    # equal ids may span tasks; within a task ids ascend, so equal keys are neighbours
    dealt = ties.repartitionByRange(n, "_id", "_tie", "_place").sortWithinPartitions("_id", "_tie", "_place").select("_id", "_key", "_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        doc_ids, keys, lengths, ids = [], [], [], []
        for b in pieces(batches, "_text", ENCODE_BYTES):
            got, off = enc.encode(b.column(2))
            if held and held + len(got) > shard_ids:
                yield _record(part, seq, doc_ids, keys, lengths, ids, width, doc_ids[0].type)
                seq, held = seq + 1, 0
                doc_ids, keys, lengths, ids = [], [], [], []
            doc_ids.append(b.column(0))
            keys.append(b.column(1).to_numpy())
            lengths.append(np.diff(off))
            ids.append(got.astype(f"<u{width}"))
            held += len(got)
        if held:
            yield _record(part, seq, doc_ids, keys, lengths, ids, width, doc_ids[0].type)

    kind = docs.schema["_id"].dataType.simpleString()
    shards = dealt.transform(map_arrow, run, SHARD_SCHEMA.format(kind=kind))
    raw = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.row.count.limit": "1"}
    shards.write.options(**raw).partitionBy("part").parquet(f"{path}/shards")
    _manifest(_shards(docs.sparkSession, path, kind)).write.parquet(f"{path}/manifest")


def _shards(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA.format(kind=kind)).parquet(f"{path}/shards")


def _manifest(shards: DataFrame) -> DataFrame:
    """``(part, seq, n_docs, n_ids, n_null, low, high, start)``, start being the ids of all shards before."""
    sizes = shards.select("part", "seq", "n_docs", "n_ids", "n_null", "low", "high")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    parts = totals_before(parts, [], "part", "_ids", "_start").drop("_ids")
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.withColumn("start", own).join(parts, "part").withColumn("start", F.col("start") + F.col("_start")).drop("_start")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, each found
    in its shard through the index."""
    known = manifest(spark, path)
    kind = known.schema["low"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, seq, width, keys, *raw = (b.column(n)[i] for n in ("part", "seq", "width", "keys", "hash", "slots", "offsets", "payload"))
                shard = Shard(*(x.as_py() for x in raw), width.as_py())
                keys = keys.values.to_numpy().view(np.uint64)
                first, many = shard.find(keys)
                if (first < 0).any():
                    raise ValueError("a key isn't in its shard's index")
                # the k-th document with a key is k places after the first
                place = np.arange(len(keys))
                document = first + place - np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1]), place, 0))
                at, end = shard.offsets[document], shard.offsets[document + 1]
                raw32 = memoryview(shard.payload.astype("<u4").tobytes())
                crc = [zlib.crc32(raw32[a * 4 : e * 4]) for a, e in zip(at.tolist(), end.tolist())]
                n = len(keys)
                columns = [pa.repeat(part, n), pa.repeat(seq, n), b.column(b.schema.names.index("doc_ids"))[i].values, pa.array(at), pa.array(end - at), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "_at", "n_tokens", "ids_crc32"])

    columns = ["part", "seq", "width", "keys", "hash", "slots", "offsets", "payload", "doc_ids"]
    found = _shards(spark, path, kind).select(*columns).transform(map_arrow, run, f"part int, seq int, doc_id {kind}, _at long, n_tokens long, ids_crc32 long")
    starts = known.select("part", "seq", "start")
    if known.count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, ids array<int>)`` for the ids of a list that fits the driver.

    Only the shards whose range holds one of them are read, and in these the
    index finds them.  An id that isn't there has no row; a repeated one has a
    row for each document."""
    wanted = ids.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col).alias("key")).distinct().toArrow()
    keys, names = wanted.column(1).to_numpy().view(np.uint64), wanted.column(0).to_pylist()
    order, null = sorted(x for x in names if x is not None), None in names
    known = manifest(spark, path)
    kind = known.schema["low"].dataType.simpleString()

    def holds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = b.column(2).to_pylist(), b.column(3).to_pylist()
            at = [bisect_left(order, x) if x is not None else len(order) for x in low]
            hit = [(i < len(order) and order[i] <= y) or (null and nulls > 0) for i, y, nulls in zip(at, high, b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["part", "seq"]).filter(pa.array(hit, pa.bool_()))

    hits = known.select("part", "seq", "low", "high", "n_null").transform(map_arrow, holds, "part int, seq int").collect()
    shards = _shards(spark, path, kind).filter(F.col("part").isin(sorted({r.part for r in hits})) & F.col("seq").isin(sorted({r.seq for r in hits})))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                width, *raw = (b.column(n)[i].as_py() for n in ("width", "hash", "slots", "offsets", "payload"))
                shard = Shard(*raw, width)
                first, many = shard.find(keys)
                hit = [(k, d) for k in np.flatnonzero(many) for d in range(first[k], first[k] + many[k])]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k, _ in hit], b.schema.field("doc_ids").type.value_type), pa.array([shard.ids(d).astype(np.int32) for _, d in hit], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shards.select("width", "hash", "slots", "offsets", "payload", "doc_ids").transform(map_arrow, run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Writes ``docs`` to a scratch path and reads them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, id_col, text_col, vocabulary)
    return read(docs.sparkSession, path)
