"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes (A-Z lower-cased) are read in windows of ``WINDOW`` bytes, all
windows of a batch side by side.  One recurrent unit layer reads each window
forwards and one backwards; at every byte both states together give a
probability for each language, and a document's probabilities are the means
over all its bytes, whole texts without exception.  The network is trained in
numpy by backpropagation through time, on windows of a sample of labelled
documents that is bounded for each language, in one task.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with a null language are never learned from; if nothing can be learned,
all rows are ``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .textkit import LOWER, pieces, utf8
from .toxicity import held_out

WINDOW = 64
HIDDEN = 8
PAD = 256
#: Windows that are read side by side.
LANES = 2048
#: Documents sampled for each language, and windows of each document, at most.
MAX_DOCUMENTS, MAX_WINDOWS = 500, 16
#: The hidden width grows beyond so many languages a unit, and fewer windows are then read side by side.
LANGUAGES_A_UNIT = 8
EPOCHS, BATCH, RATE = 5, 256, 0.01
#: Small samples are passed over more often.
MIN_STEPS = 200
FOLDS, HELD_OUT = 3, 1
LETTER = regex.compile(r"\p{L}")
f4 = np.float32


class Direction:
    """The unit layer of one direction: tables of the bytes' gate inputs
    (update, reset, candidate), and recurrent weights."""

    def __init__(self, table: np.ndarray, recurrent: np.ndarray):
        self.table, self.recurrent = table, recurrent  # (3 H, 257), (3 H, H)

    @classmethod
    def random(cls, rng: np.random.Generator, hidden: int) -> Direction:
        table = rng.normal(0, 0.3, (3 * hidden, 257)).astype(f4)
        table[:, PAD] = 0
        return cls(table, rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(f4))

    def forward(self, symbols: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States (T, H, lanes) for symbols (T, lanes); ``keep`` gets what the backward pass needs."""
        steps, lanes = symbols.shape
        hidden = self.recurrent.shape[1]
        states = np.empty((steps, hidden, lanes), dtype=f4)
        h = np.zeros((hidden, lanes), dtype=f4)
        x, g = np.empty((3 * hidden, lanes), dtype=f4), np.empty((3 * hidden, lanes), dtype=f4)
        # sigmoid(a) = (tanh(a / 2) + 1) / 2, so the gates' halves are built in
        table, recurrent = self.table.copy(), self.recurrent.copy()
        table[: 2 * hidden] *= f4(0.5)
        recurrent[: 2 * hidden] *= f4(0.5)
        for t in range(steps):
            np.take(table, symbols[t], axis=1, out=x, mode="clip")
            np.matmul(recurrent, h, out=g)
            gates = x[: 2 * hidden]
            gates += g[: 2 * hidden]
            np.tanh(gates, out=gates)
            gates += f4(1)
            gates *= f4(0.5)
            update, reset, candidate, inner = x[:hidden], x[hidden : 2 * hidden], x[2 * hidden :], g[2 * hidden :]
            if keep is not None:
                keep["inner"].append(inner.copy())
            inner *= reset
            candidate += inner
            np.tanh(candidate, out=candidate)
            if keep is not None:
                keep["gates"].append(x.copy())
            new = states[t]
            np.subtract(h, candidate, out=new)
            new *= update
            new += candidate
            h = new
        return states

    def backward(self, symbols: np.ndarray, states: np.ndarray, upstream: np.ndarray, keep: dict) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and recurrent weights; upstream: (T, H, lanes)."""
        steps, lanes = symbols.shape
        hidden = self.recurrent.shape[1]
        table, recurrent = np.zeros_like(self.table), np.zeros_like(self.recurrent)
        back = np.zeros((hidden, lanes), dtype=f4)
        grads = np.empty((steps, 3 * hidden, lanes), dtype=f4)
        for t in range(steps - 1, -1, -1):
            x, inner = keep["gates"][t], keep["inner"][t]
            update, reset, candidate = x[:hidden], x[hidden : 2 * hidden], x[2 * hidden :]
            before = states[t - 1] if t else np.zeros((hidden, lanes), dtype=f4)
            up = upstream[t] + back
            d_candidate = up * (1 - update) * (1 - candidate**2)
            d_update = up * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * inner * reset * (1 - reset)
            grads[t, :hidden], grads[t, hidden : 2 * hidden], grads[t, 2 * hidden :] = d_update, d_reset, d_candidate
            inside = np.concatenate([d_update, d_reset, d_candidate * reset])
            recurrent += inside @ before.T
            back = up * update + self.recurrent.T @ inside
        flat = symbols.ravel()
        for k in range(3 * hidden):
            table[k] = np.bincount(flat, grads[:, k].ravel(), minlength=257)[:257]
        table[:, PAD] = 0
        return table, recurrent


class Network:
    def __init__(self, ahead: Direction, back: Direction, out: np.ndarray, bias: np.ndarray):
        self.ahead, self.back, self.out, self.bias = ahead, back, out, bias  # out: (languages, 2 H)

    @classmethod
    def random(cls, languages: int, hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        return cls(Direction.random(rng, hidden), Direction.random(rng, hidden), rng.normal(0, 0.3, (languages, 2 * hidden)).astype(f4), np.zeros((languages, 1), f4))

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.recurrent, self.back.table, self.back.recurrent, self.out, self.bias]

    @classmethod
    def of(cls, p: list[np.ndarray]) -> Network:
        return cls(Direction(p[0], p[1]), Direction(p[2], p[3]), p[4], p[5])

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """(T, languages, lanes) for symbols (T, lanes)."""
        hidden = self.ahead.recurrent.shape[1]
        a = self.ahead.forward(symbols)
        b = self.back.forward(symbols[::-1])[::-1]
        z = np.matmul(self.out[:, :hidden], a)
        z += np.matmul(self.out[:, hidden:], b)
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the bytes and all parameters' gradients; labels: (lanes,)."""
        hidden = self.ahead.recurrent.shape[1]
        turned = symbols[::-1]
        ka, kb = {"inner": [], "gates": []}, {"inner": [], "gates": []}
        a, b = self.ahead.forward(symbols, ka), self.back.forward(turned, kb)
        both = np.concatenate([a, b[::-1]], axis=1)
        z = np.matmul(self.out, both) + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        real = (symbols != PAD).astype(f4)
        n = max(1.0, float(real.sum()))
        lanes = np.arange(len(labels))
        loss = float(-(np.log(p[:, labels, lanes] + 1e-9) * real).sum() / n)
        p[:, labels, lanes] -= 1
        p *= real[:, None, :] / f4(n)
        d_out = np.einsum("tlb,thb->lh", p, both, optimize=True)
        up = np.matmul(self.out.T, p)
        ta, ra = self.ahead.backward(symbols, a, up[:, :hidden], ka)
        tb, rb = self.back.backward(turned, b, up[::-1, hidden:], kb)
        return loss, [ta, ra, tb, rb, d_out, p.sum(axis=(0, 2))[:, None]]


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, width) symbols that cover every row, padded, and each window's row."""
    sizes = np.diff(offsets)
    number = -(-sizes // width)
    row = np.repeat(np.arange(len(sizes)), number)
    padded = np.full(int(number.sum()) * width, PAD, dtype=np.int16)
    shift = (np.cumsum(number) - number) * width - offsets[:-1]
    padded[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    return padded.reshape(-1, width), row


def train_network(texts: list[bytes], labels: list[int], languages: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 11) -> Network:
    rng = np.random.Generator(np.random.PCG64(seed))
    cut, y = [], []
    for text, label in zip(texts, labels):
        n = max(1, -(-len(text) // WINDOW))
        for k in np.unique(np.linspace(0, n - 1, min(n, MAX_WINDOWS)).astype(int)).tolist():
            cut.append(text[k * WINDOW : (k + 1) * WINDOW])
            y.append(label)
    data = LOWER[np.frombuffer(b"".join(cut), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
    symbols, row = windows(data, offsets)
    y = np.array(y)[row]
    net = Network.random(languages, hidden)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    batches = -(-len(symbols) // BATCH)
    epochs = max(epochs, -(-MIN_STEPS // batches))
    steps = epochs * batches
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(symbols))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            step += 1
            _, grads = net.gradients(np.ascontiguousarray(symbols[at].T).astype(np.intp), y[at])
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, (m, v) in zip(net.parameters(), grads, moments):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f4)
    return net


def label_batch(net: Network, column: pa.Array) -> np.ndarray:
    """(rows, languages): means of the bytes' probabilities; 0 for empty rows."""
    data, offsets = utf8(column)
    symbols, row = windows(LOWER[data], offsets)
    languages = len(net.bias)
    out = np.zeros((len(offsets) - 1, languages))
    lanes = max(1, LANES * HIDDEN * LANGUAGES_A_UNIT // max(languages, HIDDEN * LANGUAGES_A_UNIT))
    for i in range(0, len(symbols), lanes):
        part = np.ascontiguousarray(symbols[i : i + lanes].T).astype(np.intp)
        p = net.probabilities(part)
        p *= (part != PAD)[:, None, :]
        sums = p.sum(axis=0)
        for k in range(languages):
            out[:, k] += np.bincount(row[i : i + lanes], sums[k], minlength=len(out))
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[np.ndarray]] | None:
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    known = known.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out("_id", FOLDS, HELD_OUT))
    top = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each language
    languages = sorted(r["_lang"] for r in top)
    if not languages:
        return None
    # a share of each language's rows by a hash of the id, at most twice MAX_DOCUMENTS are then read
    share = F.create_map(*[F.lit(x) for r in top for x in (r["_lang"], min(1.0, MAX_DOCUMENTS / r.n))])
    level = F.shiftrightunsigned(F.xxhash64("_id"), 11) / float(1 << 53)
    sample = known.filter(level < F.try_element_at(share, F.col("_lang"))).select("_lang", "_text", level.alias("_order"))
    sample = sample.repartition(1).sortWithinPartitions("_order")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, number = [], [], dict.fromkeys(languages, 0)
        for b in pieces(batches, "_text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if number[lang] < 2 * MAX_DOCUMENTS and has_letter(text):
                    number[lang] += 1
                    raw = text.encode()
                    n = -(-len(raw) // WINDOW)  # only the windows that are trained on are kept
                    some = np.unique(np.linspace(0, n - 1, min(n, MAX_WINDOWS)).astype(int)).tolist()
                    texts += [raw[k * WINDOW : (k + 1) * WINDOW] for k in some]
                    labels += [languages.index(lang)] * len(some)
        if texts:
            net = train_network(texts, labels, len(languages), max(HIDDEN, -(-len(languages) // LANGUAGES_A_UNIT)))
            yield pa.RecordBatch.from_arrays([pa.array([p.astype("<f4").tobytes() for p in net.parameters()]), pa.array([str(p.shape)[1:-1] for p in net.parameters()])], ["values", "shape"])

    got = sample.transform(map_arrow, run, "values binary, shape string").collect()
    if not got:
        return None
    return languages, [np.frombuffer(r["values"], "<f4").reshape([int(x) for x in r["shape"].split(",")]) for r in got]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row for each input row."""
    model = train(docs, id_col, text_col, lang_col)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held_out(id_col, FOLDS, HELD_OUT).alias("_held"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.of(model[1]) if model else None
        for b in pieces(batches, "_text"):
            letters = np.array([has_letter(t) for t in b.column(1).to_pylist()], dtype=bool)
            if net:
                p = label_batch(net, b.column(1))
                best = p.argmax(axis=1)
                names = [model[0][k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
                score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            else:
                names, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.transform(map_arrow, run, f"doc_id {docs.schema['_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
