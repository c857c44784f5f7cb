"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes.

Texts are lower-cased (A-Z), everything but letters, digits and non-ASCII
characters counts as a space, and all byte n-grams of 3 to 6 bytes are hashed to
2^20 features that are present or not.  From labelled documents come the
features' naive Bayes log-count ratios r; the features that tell the classes
apart best (by their likelihood ratio statistic) are kept, and a logistic
regression is trained on presence times r.  A score is the model's probability.

The classifier is fitted on a sample of labelled rows, bounded by
``max_positive`` and ``max_negative`` rows (the first by a hash of their ids) and
``max_bytes`` of text; the rows' weights restore the classes' true shares.
Everything else covers all rows.  Fitting is one task; scoring is one scan of
whole texts without a shuffle.

Defined cases: a null or empty text has no features and gets the bias's
probability; labels of null, or of ids that don't occur, are ignored; if an id
has more labels, the largest counts, and if it has more rows, the least text is
learned from and all are scored; without labels every score is 0, with one
class only it is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .textkit import LOWER, pieces, spans, utf8

ORDERS = (3, 4, 5, 6)
BITS = 20
FEATURES = 4096
#: Log-likelihood ratio below which a feature tells nothing.
LEAST_GAIN = 5.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
U64 = np.uint64

#: Lower-cased letters, digits and non-ASCII bytes; a space for the rest.
PLAIN = LOWER.copy()
PLAIN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
MULTIPLIERS = {n: U64((0x9E3779B97F4A7C15 * (2 * n + 1)) & 0xFFFFFFFFFFFFFFFF | 1) for n in ORDERS}


def held_out(id_col: str, folds: int = FOLDS, fold: int = HELD_OUT) -> F.Column:
    """Whether a row is kept from learning; a null id is hashed as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, sorted; only ``wanted`` features if given."""
    data, offsets = utf8(column)
    data = PLAIN[data]
    found = []
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    sizes = np.diff(offsets)
    rows = np.arange(len(sizes)) << BITS
    for n in ORDERS:
        if len(data) < n:
            continue
        feature = ((eight[: len(data) - n + 1] << U64(64 - 8 * n)) * MULTIPLIERS[n] >> U64(64 - BITS)).astype(np.int32)
        if wanted is None:  # every place at which n bytes of one row start
            at = spans(offsets[:-1], np.maximum(sizes - n + 1, 0))
            found.append(np.repeat(rows, np.maximum(sizes - n + 1, 0)) | feature[at])
            continue
        at = np.flatnonzero(wanted[feature])
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + n <= offsets[row + 1]
        found.append(rows[row[whole]] | feature[at[whole]])
    pairs = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    if len(pairs):
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Model:
    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.wanted = np.zeros(1 << BITS, dtype=bool)
        self.weights = np.zeros(1 << BITS)
        self.wanted[kept] = True
        self.weights[kept] = weights
        self.bias = bias

    def score(self, column: pa.Array) -> np.ndarray:
        row, feature = features(column, self.wanted)
        z = self.bias + np.bincount(row, self.weights[feature], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[pa.Array], labels: np.ndarray, weights: np.ndarray, keep: int = FEATURES, smooth: float = 1.0, ridge: float = 0.03, steps: int = 250, least_gain: float = LEAST_GAIN) -> Model:
    """The classifier from arrays of texts and, for all rows, labels (0, 1) and weights."""
    size = 1 << BITS
    count = [np.zeros(size), np.zeros(size)]
    base = 0
    for t in texts:
        row, feature = features(t)
        y = labels[base + row]
        for c in (0, 1):
            count[c] += np.bincount(feature[y == c], minlength=size)
        base += len(t)
    n = [max(1.0, float((labels == c).sum())) for c in (0, 1)]
    share = float((weights * labels).sum() + 0.5) / (weights.sum() + 1)
    bias = float(np.log(share / (1 - share)))
    if not (labels == 1).any() or not (labels == 0).any():
        return Model(np.empty(0, np.int64), np.empty(0), bias)
    p, q = (smooth + count[1]) / (2 * smooth + n[1]), (smooth + count[0]) / (2 * smooth + n[0])
    ratio = np.log(p / q)
    both = (count[0] + count[1]) / (n[0] + n[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(np.nan_to_num(c * np.log(c / (m * both))) + np.nan_to_num((m - c) * np.log((m - c) / (m * (1 - both)))) for c, m in ((count[0], n[0]), (count[1], n[1])))
    gain[count[0] + count[1] < 3] = 0
    kept = np.sort(np.argsort(-gain, kind="stable")[:keep])
    kept = kept[gain[kept] > least_gain]
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    wanted = place >= 0
    rows, columns, base = [], [], 0
    for t in texts:
        row, feature = features(t, wanted)
        rows.append(base + row)
        columns.append(place[feature])
        base += len(t)
    row, column = np.concatenate(rows), np.concatenate(columns)
    x = ratio[kept][column]
    w, b = np.zeros(len(kept)), bias
    total = weights.sum()
    moment, second, mb, sb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the whole sample
        z = b + np.bincount(row, x * w[column], minlength=len(labels))
        error = weights * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) / total
        gradient = np.bincount(column, x * error[row], minlength=len(kept)) + ridge * w / max(1, len(kept)) ** 0.5
        gb = error.sum()
        moment, second = 0.9 * moment + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
        rate = 0.05 / (1 + step / 100)
        w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-8)
    return Model(kept, w * ratio[kept], float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_positive: int, max_negative: int, max_bytes: int) -> Model | None:
    """Fits in one task on the bounded sample; None without labels."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    known = known.filter(~held_out("_key"))
    size = {r["_y"]: r.n for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size:
        return None
    bound = {0: max_negative, 1: max_positive}
    first = [known.filter(F.col("_y") == c).orderBy(F.xxhash64("_key"), "_key").limit(bound[c]) for c in sorted(size)]
    chosen = first[0] if len(first) == 1 else first[0].unionByName(first[1])
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key"))  # at most both bounds' rows
    sample = sample.groupBy("_key", "_y").agg(F.min("_text").alias("_text"))  # an id may have several rows
    sample = sample.select("_y", "_text", F.xxhash64("_key").alias("_order")).repartition(1).sortWithinPartitions("_order")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, used = [], [], 0
        for b in pieces(batches, "_text", 1 << 20):
            if used < max_bytes:
                texts.append(b.column(1).fill_null(""))
                y.append(b.column(0).to_numpy())
                used += texts[-1].nbytes
        label = np.concatenate(y) if y else np.empty(0, np.int64)
        if len(label):
            used_of = {c: max(1, int((label == c).sum())) for c in size}
            model = fit(texts, label, np.where(label == 1, size.get(1, 0) / used_of.get(1, 1), size.get(0, 0) / used_of.get(0, 1)))
            kept = np.flatnonzero(model.wanted)
            yield pa.RecordBatch.from_arrays([pa.array([kept.tolist()], pa.list_(pa.int32())), pa.array([model.weights[kept].tolist()], pa.list_(pa.float64())), pa.array([model.bias])], ["kept", "weights", "bias"])

    got = sample.transform(map_arrow, run, "kept array<int>, weights array<double>, bias double").collect()
    return Model(np.array(got[0].kept, np.int64), np.array(got[0].weights), got[0].bias) if got else None


MAX_POSITIVE, MAX_NEGATIVE, MAX_BYTES = 3000, 6000, 48 << 20


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each input row."""
    model = train(docs, labels, id_col, text_col, label_col, max_positive, max_negative, max_bytes)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held_out(id_col).alias("_held"))
    packed = _packed(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpacked(packed)
        for b in pieces(batches, "_text"):
            score = own.score(b.column(1)) if own else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.transform(map_arrow, run, f"doc_id {docs.schema['_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    packed = _packed(train(docs, labels, id_col, text_col, label_col, MAX_POSITIVE, MAX_NEGATIVE, MAX_BYTES))
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpacked(packed)
        for b in pieces(batches, text_col):
            yield b.filter(pa.array(own.score(b.column(at)) < threshold)) if own else b

    return docs.transform(map_arrow, run, docs.schema)


def _packed(model: Model | None):
    if model is None:
        return None
    kept = np.flatnonzero(model.wanted)
    return kept, model.weights[kept], model.bias


def _unpacked(packed) -> Model | None:
    return None if packed is None else Model(*packed)
