"""Plain-Python forms of the operators' contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM_WORD.findall(lower(text))
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = ALNUM_WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if names := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def substring_dedup(docs, width=13):
    least = {}
    words = [(doc, SPACE_WORD.findall(text or "")) for doc, text in docs]
    for doc, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if doc is not None and (key not in least or doc < least[key]):
                least[key] = doc
    out = []
    for doc, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if doc is not None and least[tuple(w[i : i + width])] < doc:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text, size=4):
    import xxhash

    w = SPACE_WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def simhash(docs, radius=4):
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(docs)]


def encode(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def token_store(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out, start = [], 0
    for (doc, _), ids in zip(docs, encode([t for _, t in docs])):
        out.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def extendible(sizes, limit):
    """Leaf prefix of every row from (bits, bytes) pairs, by plain splitting."""
    out = {}

    def split(prefix, rows):
        if sum(b for _, b in rows) <= limit or len(rows) == 1:
            out.update({bits: prefix for bits, _ in rows})
            return
        for bit in "01":
            part = [r for r in rows if r[0][len(prefix)] == bit]
            if part:
                split(prefix + bit, part)

    split("", sizes)
    return out


def simhash_keepers(docs):
    """The least id of each group; docs have distinct ids."""
    return {component for _, _, component in simhash(docs)}


def cut_duplicates(docs, width=13):
    """docs without the words that ``substring_dedup`` removes; texts that lose nothing stay as they are."""
    first = {}
    split = {i: SPACE_WORD.findall(t or "") for i, t in docs}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][k : k + width]), i)
    out = []
    for i, text in docs:
        words = split[i]
        gone = {k + j for k in range(len(words) - width + 1) if first[tuple(words[k : k + width])] < i for j in range(width)}
        out.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else text))
    return out
