"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(texts, size):
    """(n_bytes, n_removed, n_spans, sha) of every text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(hashlib.md5(b[i : i + size]).digest() for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = [0] * (len(b) + 1)
        for i in range(len(b) - size + 1):
            if count[hashlib.md5(b[i : i + size]).digest()] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        kept, depth, spans, before = bytearray(), 0, 0, False
        for i, x in enumerate(b):
            depth += gone[i]
            if depth:
                spans += not before
            else:
                kept.append(x)
            before = depth > 0
        out.append((len(b), len(b) - len(kept), spans, sha(bytes(kept))))
    return out


def substring_dedup(texts, size):
    """(n_words, n_removed, sha) of every text."""
    words = [WORDS.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def simhash(texts, ids, radius=3):
    """(fingerprint, component) of every text."""
    prints = []
    for t in texts:
        w = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(f"{p:016x}", least[find(i)]) for i, p in enumerate(prints)]
