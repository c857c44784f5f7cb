"""Byte-level BPE ids of whole texts through the ``tokenizers`` library.

Texts are cut where the pre-tokenizer of this vocabulary always starts a new
piece: before a space that a visible character follows, after an ASCII letter
that no letter follows, and between a single line end and a visible character.  So
the ids of the parts, concatenated, are the ids of the text.  The vocabulary's
added tokens (``<|endoftext|>``) are matched before anything else, as the library
does: each is a part of its own, and the text on either side is cut as if it
ended or began there.  Each distinct part is encoded once per worker and
remembered (a bounded table), because the same words come again and again.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .textkit import hash_spans, spans, utf8

END_ID = 0
#: What byte-level vocabularies write for a space.
SPACE_MARK = "\u0120"
CACHE_ENTRIES = 500_000
#: Text bytes that are encoded at a time.
ENCODE_BYTES = 2 << 20

#: Bytes that can't be the first of a white-space character.
VISIBLE = np.zeros(256, dtype=bool)
VISIBLE[0x21:0x7F] = VISIBLE[0xC3:0xF5] = True
VISIBLE[[0xE1, 0xE2, 0xE3]] = False
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
NO_LETTER = ~LETTER
NO_LETTER[0x80:] = False
LINE_END = np.zeros(256, dtype=bool)
LINE_END[0x09:0x0E] = True


class PartEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if not str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False"):
            raise ValueError("parts are cut as the byte-level pre-tokenizer cuts them; the vocabulary has another")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in spaces or need word bounds can't be parts")
        longest = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.model = self.tokenizer.model
        self.added = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)  # the hashes known, ascending, and their places
        self.ids = np.empty(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 16, np.int64)
        self.n_ids = 0

    def _add(self, hashes: np.ndarray, texts: list[str], words: list[bool]) -> None:
        """Takes in parts by their ascending hashes.  A part that is an ASCII word,
        a space before it or not, is a single piece of the pre-tokenizer, so the
        model alone encodes it."""
        tokenize = self.model.tokenize
        encoded: list[list[int]] = [[t.id for t in tokenize(x.replace(" ", SPACE_MARK, 1))] if word else [] for x, word in zip(texts, words)]
        others = [i for i, word in enumerate(words) if not word]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)):
            encoded[i] = e.ids
        n = len(self.keys)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum()))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(encoded) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.empty_like(self.offsets)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.offsets[n + 1 : n + 1 + len(encoded)] = self.n_ids + np.cumsum(lengths)
        self.n_ids += len(flat)
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.slots = np.insert(self.keys, at, hashes), np.insert(self.slots, at, np.arange(n, n + len(hashes)))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ascending hashes are or would be among the keys, and which are there."""
        at = np.searchsorted(self.keys, hashes)
        inside = np.minimum(at, max(len(self.keys) - 1, 0))
        return inside, (self.keys[inside] == hashes) if len(self.keys) else np.zeros(len(hashes), dtype=bool)

    def _added_spans(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """(2, matches): starts and ends of added tokens, none across rows."""
        if self.added is None or not self.added.search(raw):
            return np.empty((2, 0), dtype=np.int64)
        at = offsets.tolist()
        found = [m.span() for a, b in zip(at, at[1:]) for m in self.added.finditer(raw, a, b)]
        return np.array(found, dtype=np.int64).reshape(-1, 2).T

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row with the end id, and row offsets (rows + 1)."""
        data, offsets = utf8(column)
        rows = len(offsets) - 1
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 1:
            visible = VISIBLE[data]
            np.logical_and(data[:-1] == 0x20, visible[1:], out=cut[: len(data) - 1])
            cut[offsets[1:-1] - 1] = False  # a space that ends its row; an empty first row clears the spare last place
            cut[1 : len(data)] |= LETTER[data[:-1]] & NO_LETTER[data[1:]]
            cut[2 : len(data)] |= visible[:-2] & LINE_END[data[1:-1]] & visible[2:]
        raw = data.tobytes()
        added_start, added_end = self._added_spans(raw, offsets)
        if len(added_start):
            before = added_start[added_start > 0] - 1
            cut[before[data[before] == 0x20]] = False  # a space that ends what stands before the token
            cut[spans(added_start, added_end - added_start)] = False
            cut[added_start] = cut[added_end] = True
        filled = offsets[:-1][np.diff(offsets) > 0]
        cut[filled] = True
        cut[len(data)] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if len(self.keys) > CACHE_ENTRIES:
            self._reset()
        hashes, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._find(hashes)[1])
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            letters = np.concatenate([[0], np.cumsum(LETTER[data])])
            gap = data[a] == 0x20
            word = (letters[b] - letters[a] == b - a - gap) & (b - a > gap)
            self._add(hashes[new], [raw[i:j].decode("utf-8", "replace") for i, j in zip(a.tolist(), b.tolist())], word.tolist())
        slot = self.slots[self._find(hashes)[0]][inverse] if len(hashes) else np.empty(0, np.int64)
        lengths = self.offsets[slot + 1] - self.offsets[slot]
        part_first = np.searchsorted(starts, offsets)
        before = np.concatenate([[0], np.cumsum(lengths)])[part_first]
        out_offsets = before + np.arange(rows + 1)
        out = np.full(int(out_offsets[-1]), END_ID, dtype=np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[out_offsets[1:] - 1] = False
        out[keep] = self.ids[spans(self.offsets[slot], lengths)]
        return out, out_offsets


_encoders: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """One encoder for each worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
