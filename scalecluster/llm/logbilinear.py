"""Scoring of texts by a log-bilinear language model.

Tokens are lower-cased words and one end token for each text.  The probability
of a token is a product over a tree of two levels and a leaf.  Classes come
first: the end, the most frequent words (each a class of its own), and for all
other words their last two bytes (the most frequent endings; one class for the
rest).  A class of an ending has members: its most frequent words, more of them
in a larger vocabulary, and one member for all of its other words.  Both levels
are predicted from the context; a token's share of the other words of its class
comes from the counts.

A context is the CONTEXT tokens before, each told apart as finely as the tree
does.  A log-bilinear model (Mnih and Hinton) sums their vectors, each scaled by
its position's vector, and multiplies the sum with the vectors of the predicted
classes, and of the predicted members of the class, plus biases.  It is trained
in numpy with noise-contrastive estimation, against the classes' frequencies
and, within a class, its members': a start on a bounded sample, then one pass
over all training texts in parallel, whose parameters are averaged by tokens.
For scores, matrix products over batches of tokens give all classes and all
members of a class, so the log-probabilities are normalised exactly.  The share
of a class's other words is (c + 1) / (N' + V' + 1) with their training tokens N'
and distinct words V'; the remaining 1 is the share of unseen words.

Training texts are dealt to groups by a hash of id and text, sorted, and cut
into steps of BATCH tokens; noise is drawn by the group's number.  So the model
doesn't depend on how tables are partitioned.

Token counts cover all training texts and stay distributed.  The most frequent
HOT_TOKENS counts at most go to the scoring tasks; rarer tokens are joined with
the count table, as (token, row) pairs summed by row.

Defined cases: null and empty texts hold the end token only; without training
texts N and V are 0, all scores follow the formulas; a null id is hashed as ''.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from ..session import map_arrow
from .textkit import NOT_SPACE, Words, pieces
from .toxicity import held_out

WORD_CLASSES, ENDING_CLASSES = 160, 94
#: Members of an ending's class, the other words included: one in MEMBER_SHARE
#: words of the vocabulary, if they were spread evenly, within these limits.
MEMBER_SHARE, MEMBERS = 8, (16, 128)
CONTEXT, WIDTH = 6, 16
NOISE, MEMBER_NOISE, BATCH = 32, 4, 2048
HOT_TOKENS = 1 << 19
#: Tokens that are scored at a time.
SCORED = 1 << 15
#: Text bytes of a group of training texts, about.
GROUP_BYTES = 16 << 20
#: Parameters that are summed as one row.
CHUNK = 1 << 13
#: Text bytes of the sample for the start, about.
START_BYTES = 3 << 20
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x5BD1E995C0FFEE01)
#: The bias of a member that its class doesn't have.
ABSENT = -1e4
f4 = np.float32


class Tokens:
    """A batch's tokens in order: words, and the end of each row."""

    def __init__(self, column: pa.Array):
        words = Words(column, NOT_SPACE, lower=True)
        counts = words.counts
        self.rows = words.rows
        self.number = counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.number)])
        total = int(self.first[-1])
        self.hash = np.full(total, END, dtype=np.uint64)
        self.ending = np.full(total, -1, dtype=np.int32)
        is_word = np.ones(total, dtype=bool)
        is_word[self.first[1:] - 1] = False
        self.hash[is_word] = words.hashes()
        if len(words):
            last = words.data[words.ends - 1].astype(np.int32)
            before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.int32)
            self.ending[is_word] = before << 8 | last
        self.row = np.repeat(np.arange(self.rows), self.number)


def token_counts(docs: DataFrame) -> DataFrame:
    """``(token, ending, n)`` over the texts of docs (``_text``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text", 4 << 20):  # the larger, the fewer rows are passed on
            t = Tokens(b.column(0))
            token, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(t.ending[first]), pa.array(n)], ["token", "ending", "n"])

    return docs.transform(map_arrow, run, "token long, ending int, n long").groupBy("token", "ending").agg(F.sum("n").alias("n"))


class Classes:
    """The class of every token: 0 the end (also what stands before a text),
    then words, then endings, last all other words; and the members of these."""

    def __init__(self, words: np.ndarray, endings: np.ndarray, members: np.ndarray, member_class: np.ndarray, slots: int):
        """members: words and their classes, the most frequent of a class first; at most slots - 1 of a class."""
        self.single, self.slots = 1 + len(words), slots  # classes of one token, and members of each of the others
        self.count = self.single + len(endings) + 1
        self.shared = self.count - self.single
        self.symbols = self.single + self.shared * slots
        self.of_ending = np.full(1 << 16, self.count - 1, dtype=np.int32)
        self.of_ending[endings] = self.single + np.arange(len(endings))
        order = np.lexsort((np.arange(len(members)), member_class))
        members, member_class = members[order], member_class[order]
        first = np.searchsorted(member_class, member_class)
        slot = np.arange(len(members)) - first
        known = np.concatenate([words, members])
        symbol = np.concatenate([1 + np.arange(len(words)), self.single + (member_class - self.single) * slots + slot])
        order = np.argsort(known)
        self.words, self.symbol = known[order], symbol[order].astype(np.int32)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[known >> np.uint64(48)] = True

    def of(self, t: Tokens) -> np.ndarray:
        """Symbols: a class of one token, or a class's member, of which the last is for other words."""
        other = self.single + (self.of_ending[np.maximum(t.ending, 0)] - self.single) * self.slots + self.slots - 1
        out = np.where(t.ending >= 0, other, np.int32(0))
        if len(self.words):
            at = np.flatnonzero(self.maybe[t.hash >> np.uint64(48)])
            k = np.minimum(np.searchsorted(self.words, t.hash[at]), len(self.words) - 1)
            hit = self.words[k] == t.hash[at]
            out[at[hit]] = self.symbol[k[hit]]
        return out.astype(np.intp)

    def split(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The classes; the places of symbols with members; and these symbols from 0."""
        at = np.flatnonzero(symbol >= self.single)
        member = symbol[at] - self.single
        out = symbol.copy()
        out[at] = self.single + member // self.slots
        return out, at, member


def sequence(t: Tokens, symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each text after ``size`` times 0, and the places of
    its tokens: the context of a place is the ``size`` places before it."""
    place = np.arange(len(symbols)) + np.repeat(np.arange(1, t.rows + 1) * size, t.number)
    out = np.zeros(len(symbols) + t.rows * size, dtype=np.intp)
    out[place] = symbols
    return out, place


class Model:
    """Vectors of context symbols R, positions C, classes Q and members P, and biases."""

    def __init__(self, r: np.ndarray, c: np.ndarray, q: np.ndarray, bias: np.ndarray, p: np.ndarray, member_bias: np.ndarray):
        self.r, self.c, self.q, self.bias, self.p, self.member_bias = r, c, q, bias, p, member_bias

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.bias, self.p, self.member_bias]

    @classmethod
    def start(cls, share: np.ndarray, member_share: np.ndarray, size: int = CONTEXT, width: int = WIDTH, seed: int = 3) -> Model:
        """share of the classes; member_share (classes with members, members), 0 where there is none.
        A member's vector starts as its class's."""
        rng = np.random.Generator(np.random.PCG64(seed))
        n, (shared, slots) = len(share), member_share.shape
        by_class = rng.normal(0, 0.3, (n, width))
        r = np.concatenate([by_class[: n - shared], np.repeat(by_class[n - shared :], slots, axis=0)])
        q, p = rng.normal(0, 0.1, (n, width)), rng.normal(0, 0.1, (shared * slots, width))
        member_bias = np.where(member_share > 0, np.log(np.maximum(member_share, 1e-12)), ABSENT).ravel()
        return cls(*(x.astype(f4) for x in (r, np.ones((size, width)) / size, q, np.log(share), p, member_bias)))

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters()])

    def of(self, vector: np.ndarray) -> Model:
        out, i = [], 0
        for x in self.parameters():
            out.append(vector[i : i + x.size].reshape(x.shape).astype(f4))
            i += x.size
        return Model(*out)

    def contexts(self, vectors: np.ndarray) -> np.ndarray:
        """(places, width) from the vectors R of these places and the ones before
        the first: vectors are looked up once and shifted."""
        size = len(self.c)
        n = len(vectors) - size
        out = vectors[size - 1 : size - 1 + n] * self.c[0]
        for k in range(1, size):
            out += vectors[size - 1 - k : size - 1 - k + n] * self.c[k]
        return out

    def log_probabilities(self, symbols: np.ndarray, places: np.ndarray, classes: Classes) -> np.ndarray:
        """Natural logs of the symbols at ``places``, normalised over all classes and all members of a class."""
        out, size = np.empty(len(places)), len(self.c)
        q = np.ascontiguousarray(np.concatenate([self.q, self.bias[:, None]], axis=1).T)
        p = np.concatenate([self.p, self.member_bias[:, None]], axis=1)
        slots = classes.slots
        for i in range(0, len(places), SCORED):
            some = places[i : i + SCORED]
            ctx = self.contexts(self.r[symbols[some[0] - size : some[-1] + 1]])[some - some[0]]
            ctx = np.concatenate([ctx, np.ones((len(ctx), 1), f4)], axis=1)  # for the biases
            own, at, member = classes.split(symbols[some])
            part = np.empty(len(ctx))
            for j in range(0, len(ctx), BATCH):
                part[j : j + BATCH] = _log_share(ctx[j : j + BATCH] @ q, own[j : j + BATCH])
            group = (member // slots).astype(np.uint16)
            order = np.argsort(group, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(group[order].astype(np.int64), prepend=-1)), len(order))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # the tokens of one class at a time
                rows, g = at[order[a:b]], int(group[order[a]])
                part[rows] += _log_share(ctx[rows] @ p[g * slots : (g + 1) * slots].T, member[order[a:b]] - g * slots)
            out[i : i + SCORED] = part
        return out


def _log_share(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Logs of the softmax of rows at ``own``; overwrites z."""
    value = z[np.arange(len(z)), own].astype(np.float64)
    top = float(z.max())
    if top > 60 or float(value.min()) < -60:  # sums of float32 exponentials would leave their range
        high = z.max(axis=1, keepdims=True)
        z -= high
        value -= high[:, 0]
    np.exp(z, out=z)
    return value - np.log(z.sum(axis=1, dtype=np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive steps (Adagrad): noise of the classes is shared by a
    batch, noise of the members is drawn for each token."""

    def __init__(self, model: Model, classes: Classes, share: np.ndarray, member_share: np.ndarray, rate: float, seed: int):
        self.m, self.classes, self.rate = Model(*(x.copy() for x in model.parameters())), classes, rate
        self.log_noise = np.log(NOISE * share).astype(f4)
        self.cumulative = np.cumsum(share) / share.sum()
        slots = classes.slots
        shares = member_share / member_share.sum(axis=1, keepdims=True)
        self.log_member = np.where(shares > 0, np.log(MEMBER_NOISE * np.maximum(shares, 1e-12)), 0.0).ravel().astype(f4)
        # one ascending list for all classes: the class's number and the share up to a member
        self.up_to = (np.arange(len(shares))[:, None] + np.minimum(np.cumsum(shares, axis=1), 1.0)).ravel()
        self.last = np.arange(len(shares)) * slots + slots - 1  # other words are always there
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.sums = [np.full_like(x, 1e-2) for x in self.m.parameters()]
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def _update(self, k: int, g: np.ndarray, rows: np.ndarray | slice) -> None:
        """A step of some rows of a parameter, the others having no gradient."""
        x, sums = self.m.parameters()[k], self.sums[k]
        total = sums[rows] + g * g
        sums[rows] = total
        x[rows] -= f4(self.rate) * g / np.sqrt(total)

    def _members(self, ctx: np.ndarray, member: np.ndarray, scale: np.float32) -> np.ndarray:
        """A step of the members' vectors and biases; returns the contexts' gradients."""
        m, n = self.m, len(member)
        group = member // self.classes.slots
        drawn = np.searchsorted(self.up_to, group[:, None] + self.rng.random((n, MEMBER_NOISE)), "right")
        both = np.concatenate([member[:, None], np.minimum(drawn, self.last[group][:, None])], axis=1)
        vectors = m.p[both]
        error = _sigmoid(np.einsum("nd,nkd->nk", ctx, vectors) + m.member_bias[both] - self.log_member[both])
        error[:, 0] -= 1
        error = (error * scale).astype(f4)
        rows, sums = _sums(both.ravel(), error[:, :, None] * ctx[:, None, :], error)
        self._update(4, sums[:, :-1], rows)
        self._update(5, sums[:, -1], rows)
        return np.einsum("nk,nkd->nd", error, vectors)

    def step(self, symbols: np.ndarray, at_: np.ndarray) -> None:
        """One step of the tokens ``at_`` in symbols, all at least CONTEXT from its start."""
        m, n, classes = self.m, len(at_), self.classes
        size = len(m.c)
        scale = f4(1 / np.sqrt(n))
        vectors = m.r[symbols]
        ctx = m.contexts(vectors)[at_ - size]
        target, at, member = classes.split(symbols[at_])
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), classes.count - 1)
        own = m.q[target]
        true = np.einsum("nd,nd->n", ctx, own) + m.bias[target] - self.log_noise[target]
        false = ctx @ m.q[noise].T + (m.bias - self.log_noise)[noise]
        e_true, e_false = ((_sigmoid(true) - 1) * scale).astype(f4), (_sigmoid(false) * scale).astype(f4)
        g_ctx = e_true[:, None] * own + e_false @ m.q[noise]
        if len(at):
            g_ctx[at] += self._members(ctx[at], member, scale)
        each = np.concatenate([e_true[:, None] * ctx, e_false.T @ ctx])
        rows, sums = _sums(np.concatenate([target, noise]), each, np.concatenate([e_true, e_false.sum(axis=0)]))
        g = np.zeros((len(symbols) - size, ctx.shape[1]), dtype=f4)
        g[at_ - size] = g_ctx
        g_c, g_r = np.empty_like(m.c), np.zeros_like(vectors)
        for k in range(size):  # a place's vector is in the contexts of the places after it
            before = slice(size - 1 - k, size - 1 - k + len(g))
            g_c[k] = np.einsum("nd,nd->d", g, vectors[before])
            g_r[before] += g * m.c[k]
        self._update(2, sums[:, :-1], rows)
        self._update(3, sums[:, -1], rows)
        rows, sums = _sums(symbols, g_r, None)
        self._update(0, sums, rows)
        self._update(1, g_c, slice(None))

    def add(self, symbols: np.ndarray, places: np.ndarray) -> None:
        """Takes texts in (see ``sequence``); steps are made of BATCH successive tokens, wherever calls end."""
        held = sum(len(x) for x, _ in self.waiting)
        self.waiting.append((symbols, places + held))
        self.tokens += len(places)
        if sum(len(k) for _, k in self.waiting) >= 8 * BATCH:
            self._steps(False)

    def finish(self) -> None:
        self._steps(True)

    def _steps(self, all_: bool) -> None:
        if not self.waiting:
            return
        symbols, places = np.concatenate([x for x, _ in self.waiting]), np.concatenate([k for _, k in self.waiting])
        end = len(places) if all_ else len(places) // BATCH * BATCH
        for i in range(0, end, BATCH):
            some = places[i : min(i + BATCH, end)]
            start = some[0] - CONTEXT
            self.step(symbols[start : some[-1] + 1], some - start)
        left = places[end:]
        self.waiting = [(symbols[left[0] - CONTEXT :], left - left[0] + CONTEXT)] if len(left) else []


def _sums(at: np.ndarray, values: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ``at``, ascending, and for each the sum of its
    rows of values (last dimension: width), with ``more`` as a last column."""
    values = values.reshape(len(at), -1)
    if more is not None:
        values = np.concatenate([values, more.reshape(-1, 1)], axis=1)
    at = at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at  # sorted in linear time
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
    sums = np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]
    return at[first].astype(np.intp), sums.astype(f4)


def _hot(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count so that at most ``most`` tokens have it, and those tokens, sorted."""
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 * F.floor(F.log2(F.col("n"))) - 4096 * 11)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).collect()  # about 4,100 rows at most
    least, total = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r.low):
        if total + r.k > most:
            break
        total, least = total + r.k, r.low
    table = counts.filter(F.col("n") >= least).select("token", "n").toArrow()
    token, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(token)
    return least, token[order], n[order]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_tokens: int = HOT_TOKENS, start_bytes: int = START_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``,
    one row for each input row; scores are log10 probabilities."""
    spark = docs.sparkSession
    held = held_out(id_col, FOLDS, HELD_OUT)
    learned = docs.filter(~held).select(F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_order"))
    counts = materialise(token_counts(learned.select("_text")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    least, hot_token, hot_n = _hot(counts, hot_tokens)
    tree = _tree(counts, least, total.v)
    log_all = float(np.log10(total.n + total.v + 1))
    shared = spark.sparkContext.broadcast((tree, hot_token, hot_n))
    model = _train(learned, tree, start_bytes) if total.n else Model.start(tree.share, tree.member_share)
    shared_model = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hot_token, hot_n = shared.value
        classes, model = tree.classes, shared_model.value
        log_hot = np.append(np.log10(hot_n + 1.0), 0.0)
        names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "token", "times"]
        for b in pieces(batches, "_text"):
            t = Tokens(b.column(1))
            k = classes.of(t)
            logp = model.log_probabilities(*sequence(t, k, CONTEXT), classes) / np.log(10) - tree.log_others[k]
            distinct, inverse = np.unique(t.hash, return_inverse=True)
            at = np.minimum(np.searchsorted(hot_token, distinct), max(len(hot_token) - 1, 0))
            found = hot_token[at] == distinct if len(hot_token) else np.zeros(len(distinct), bool)
            log_count = np.where(found, log_hot[np.where(found, at, len(log_hot) - 1)], 0.0)[inverse]
            known = found[inverse]
            count = lambda w: np.bincount(t.row, w, minlength=t.rows)
            base = count(log_count) - t.number * log_all
            whole = count(logp + np.where(tree.others[k], log_count, 0.0))
            n = t.rows
            empty = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(2), pa.array(t.number), pa.array(count(known).astype(np.int64)), pa.array(base), pa.array(whole), empty(pa.int64()), empty(pa.int64())], names)
            rare = np.flatnonzero(~known)
            if len(rare):
                pair, times = _pairs(t.row[rare], inverse[rare], len(distinct))
                n = len(times)
                yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(pair[0])), empty(b.schema.field(0).type), empty(pa.bool_()), empty(pa.int64()), empty(pa.int64()), empty(pa.float64()), empty(pa.float64()), pa.array(distinct[pair[1]].view(np.int64)), pa.array(times)], names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held.alias("_held"), F.monotonically_increasing_id().alias("_key"))
    kind = rows.schema["_id"].dataType.simpleString()
    scored = materialise(rows.transform(map_arrow, run, f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, token long, times long"), "scored")
    # rarer tokens are other words of their class
    rare = scored.filter("token is not null").select("key", "token", "times").join(counts.filter(F.col("n") < least).select("token", "n"), "token")
    added = rare.groupBy("key").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("_log"))
    texts = scored.filter("token is null").drop("token", "times").join(added, "key", "left")
    more = F.coalesce("_log", F.lit(0.0))
    return texts.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def _pairs(row: np.ndarray, token: np.ndarray, n: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    key, times = np.unique(row.astype(np.int64) * n + token, return_counts=True)
    return (key // n, key % n), times


class Tree:
    """Classes with the training counts' shares.  For each symbol: whether it
    stands for other words, and if so log10 of what a word's count + 1 is divided by."""

    def __init__(self, classes: Classes, class_n: np.ndarray, member_n: np.ndarray, others_n: np.ndarray, others_v: np.ndarray):
        """class_n (classes,); member_n (classes with members, members - 1), -1 where there is none; tokens and words of the others."""
        self.classes = classes
        self.share = (class_n + 1) / (class_n + 1).sum()
        every = np.concatenate([member_n, others_n[:, None]], axis=1)
        self.member_share = np.where(every >= 0, every + 1, 0) / np.where(every >= 0, every + 1, 0).sum(axis=1, keepdims=True)
        last = classes.single + np.arange(classes.shared) * classes.slots + classes.slots - 1
        self.others, self.log_others = np.zeros(classes.symbols, dtype=bool), np.zeros(classes.symbols)
        self.others[last], self.log_others[last] = True, np.log10(others_n + others_v + 1)


def _tree(counts: DataFrame, least: int, distinct: int) -> Tree:
    """Classes and members from the counts; members have at least the count ``least``."""
    slots = int(np.clip(distinct // (MEMBER_SHARE * (ENDING_CLASSES + 1)), *MEMBERS))
    frequent = counts.filter((F.col("ending") >= 0) & (F.col("n") >= least))
    top = {r.token: r.n for r in frequent.orderBy(F.desc("n"), "token").limit(WORD_CLASSES).collect()}
    words = list(top)
    rest = counts.filter(~F.col("token").isin(words)) if words else counts
    by_ending = rest.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # 2^16 rows at most
    by_ending.sort(key=lambda r: (-r.n, r.ending))
    endings = [r.ending for r in by_ending if r.ending >= 0][:ENDING_CLASSES]
    single, last = 1 + len(words), 1 + len(words) + len(endings)
    ending_class = {e: single + i for i, e in enumerate(endings)}
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ending_class.items() for x in pair]), F.col("ending")), F.lit(last)) if endings else F.lit(last)
    rank = F.row_number().over(Window.partitionBy("_class").orderBy(F.desc("n"), "token"))
    members = frequent.filter(~F.col("token").isin(words)) if words else frequent
    members = members.withColumn("_class", own).withColumn("_rank", rank).filter(F.col("_rank") < slots).orderBy("_class", "_rank").collect()  # slots for each class at most
    classes = Classes(np.array(words, np.int64).view(np.uint64), np.array(endings, np.int64), np.array([r.token for r in members], np.int64).view(np.uint64), np.array([r["_class"] for r in members], np.int64), slots)
    class_n, class_v = np.zeros(classes.count), np.zeros(classes.count)
    class_n[1:single] = [top[w] for w in words]
    for r in by_ending:
        k = ending_class.get(r.ending, last) if r.ending >= 0 else 0
        class_n[k] += r.n
        class_v[k] += r.v if k else 0
    member_n = np.full((classes.shared, slots - 1), -1.0)
    for r in members:
        member_n[r["_class"] - single, r["_rank"] - 1] = r.n
    own_n, own_v = np.maximum(member_n, 0).sum(axis=1), (member_n >= 0).sum(axis=1)
    return Tree(classes, class_n, member_n, class_n[single:] - own_n, class_v[single:] - own_v)


def _train(learned: DataFrame, tree: Tree, start_bytes: int) -> Model:
    """A start in one task on a bounded sample, then all texts and an average."""
    model = Model.start(tree.share, tree.member_share)
    size = learned.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    level = F.shiftrightunsigned("_order", 11) / float(1 << 53)
    sample = learned.filter(level < min(1.0, start_bytes / max(size, 1))).repartition(1).sortWithinPartitions("_order", "_text").select("_text", F.lit(0).cast("long").alias("_group"))
    model = _average(sample, model, tree, 0.1, 3, start_bytes * 2) or model
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = learned.withColumn("_group", F.pmod(F.xxhash64("_order"), F.lit(groups)))
    tasks = max(1, min(groups, int(learned.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(tasks, "_group").sortWithinPartitions("_group", "_order", "_text").select("_text", "_group")
    return _average(dealt, model, tree, 0.02, 1, 1 << 62) or model


def _average(texts: DataFrame, model: Model, tree: Tree, rate: float, epochs: int, limit: int) -> Model | None:
    """The mean, by tokens, of the models that each group of texts makes of
    ``model``; texts has ``_text, _group``, groups one after the other."""
    shared = texts.sparkSession.sparkContext.broadcast((model, tree))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tree = shared.value
        classes, trainer, group = tree.classes, None, None
        total, tokens, used, kept = np.zeros(len(model.vector())), 0, 0, []

        def finish() -> None:
            nonlocal total, tokens
            trainer.finish()
            for e in range(1, epochs):
                trainer.rate = rate / (1 + e)
                for text in kept:
                    trainer.add(*text)
                trainer.finish()
            seen = trainer.tokens // epochs
            total += trainer.m.vector().astype(np.float64) * seen
            tokens += seen

        for b in pieces(batches, "_text"):
            which = b.column(1).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if trainer is None or which[i] != group:
                    if trainer is not None:
                        finish()
                    group, used, kept = which[i], 0, []
                    trainer = Trainer(model, classes, tree.share, tree.member_share, rate, int(group))
                if used > limit:
                    continue
                t = Tokens(b.column(0).slice(i, j - i))
                used += int(t.number.sum())
                k = classes.of(t)
                text = sequence(t, k, CONTEXT)
                trainer.add(*text)
                if epochs > 1:
                    kept.append(text)
        if trainer is not None:
            finish()
        if tokens:
            starts = range(0, len(total), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([total[a : a + CHUNK].tobytes() for a in starts], pa.binary()), pa.array([tokens] * len(starts), pa.int64())], ["at", "sums", "tokens"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for at, raw, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                old = sums.setdefault(at, [0.0, 0])
                old[0], old[1] = old[0] + np.frombuffer(raw), old[1] + tokens
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], ["at", "sums", "tokens"])

    schema = "at long, sums binary, tokens long"
    parts = texts.transform(map_arrow, run, schema).repartition("at").transform(map_arrow, add, schema).collect()  # the parameters, once
    if not parts:
        return None
    vector = np.concatenate([np.frombuffer(r.sums) / r.tokens for r in sorted(parts, key=lambda r: r["at"])])
    return model.of(vector)
