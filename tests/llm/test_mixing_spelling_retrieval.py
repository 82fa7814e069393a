"""Mixing, spelling variants and ranked search against plain versions, on small and awkward inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mdq.llm import mixing, retrieval, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, source string, size long, k long, word string, n long, shard int, m long, rank int, h long"
RNG = random.Random(11)
AWKWARD = [None, "", "\n", " \t ", "a", "a b", "A B é", "\x00\x01", "x" * 5000, "ab " * 2000, "a\r\nb\r\n", "𝔘ni 👍🏽 text", "a×b÷c Ünïcödé ÀÉÿ"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None, sources=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in zip(ids, texts, sources)], DOCS).repartition(parts)


# ---- mixing -----------------------------------------------------------------------------


def plain_targets(size_of, weights=(5, 2, 1), most=3):
    """Targets by sharing what is over again until no source is above."""
    names = sorted((s for s in size_of if s is not None), key=lambda s: s) + [None] * (None in size_of)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(size_of.values()), {s for s in names if not size_of[s]}
    while True:
        left = total - sum(most * size_of[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * size_of[s]}
        if not over:
            return {s: float(most * size_of[s]) if s in full else share[s] for s in names}
        full |= over


def check_mix(docs, rows):
    sizes = [(i, s, len(WORDS.findall(t or ""))) for i, t, s in docs]
    size_of = Counter()
    for _, s, n in sizes:
        size_of[s] += n
    target = plain_targets(size_of)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["source_size"]) for r in rows) == sorted((i is None, i, n, size_of[s]) for i, s, n in sizes)
    source = {i: s for i, s, _ in sizes}
    taken, longest = Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.5 * longest[s] + 2e-4 * target[s] + 1, s
    return taken


def test_mix_reaches_targets_and_reruns_agree(spark):
    texts = ["w " * RNG.choice([1, 3, 10, 50, 400]) for _ in range(600)] + ["same " * 20] * 300
    sources = [RNG.choice(["a", "b", "c", "d", "é", "𝔘", None]) for _ in range(600)] + ["b"] * 300
    docs = list(zip(range(900), texts, sources))
    rows = mixing.mix(frame(spark, texts, sources=sources)).collect()
    check_mix(docs, rows)
    again = mixing.mix(frame(spark, texts, sources=sources, parts=7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_stops_at_three_copies_and_shares_the_rest(spark):
    # the first source is far too small for its weight: all of it three times, the others take what is over
    texts = ["w " * 4] * 3 + ["w " * 40] * 200 + ["w " * 7] * 150
    sources = ["a"] * 3 + ["b"] * 200 + ["c"] * 150
    rows = mixing.mix(frame(spark, texts, sources=sources)).collect()
    check_mix(list(zip(range(len(texts)), texts, sources)), rows)
    assert {r["copies"] for r in rows if r["source_size"] == 12} == {3}


def test_mix_tilts_rates_by_size(spark):
    texts = ["w " * n for n in (10, 1000)] * 400
    rows = mixing.mix(frame(spark, texts, sources=["a", "a", "b", "b"] * 200)).collect()
    mean = lambda n, t: sum(r["copies"] for r in rows if (r["size"], r["target"]) == (n, t)) / 200
    high, low = sorted({r["target"] for r in rows}, reverse=True)
    assert mean(1000, high) > mean(10, high) and mean(1000, low) < mean(10, low)
    # one multiplier: log rates are in proportion to the sizes
    assert math.log(mean(1000, low)) / math.log(mean(10, low)) == pytest.approx(100, rel=0.6)


def test_mix_awkward(spark):
    ids = [None, *range(1, len(AWKWARD) - 1), 1]
    sources = [None, "", "b"] * 9
    rows = mixing.mix(frame(spark, AWKWARD, ids, sources[: len(AWKWARD)])).collect()
    assert len(rows) == len(AWKWARD)
    assert mixing.mix(frame(spark, [], [])).collect() == []
    assert [r["taken"] for r in mixing.mix(frame(spark, [None, ""])).collect()] == [0, 0]
    clash = spark.createDataFrame([(1, "a b", None, 9, 9, "w", 9, 9, 9, 9, 9)], CLASHING)
    assert mixing.mix(clash).first()["size"] == 2


def test_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 16)
    texts, sources = ["w " * 9] * 500 + ["w " * 5] * 90, ["a"] * 500 + ["b"] * 90
    rows = mixing.mix(frame(spark, texts, sources=sources)).collect()
    check_mix(list(zip(range(590), texts, sources)), rows)


# ---- spelling variants ------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_counts(docs, every=199, min_len=6, min_count=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= min_len and n >= min_count}


def plain_variants(count, times=5):
    near = defaultdict(set)
    gone = defaultdict(set)
    for w in count:
        for k in range(len(w)):
            gone[w[:k] + w[k + 1 :]].add((w, k))
        gone[w].add((w, -1))
    for held in gone.values():
        for a, j in held:
            for b, k in held:
                if a != b and (j == k or -1 in (j, k)) and one_edit(a, b):
                    near[a].add(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x))
        if count[best] >= times * count[w]:
            form[w] = best
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None))
    return sorted(out)


def spelled(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def corpus(rng, n_docs=150):
    base = ["".join(rng.choice("abceélñ") for _ in range(rng.randint(5, 12))) for _ in range(60)] + ["prefixed" + "".join(rng.choice("ab") for _ in range(7)) for _ in range(60)]
    texts = []
    for _ in range(n_docs):
        words = []
        for w in rng.choices(base, weights=[1 / (1 + k % 50) ** 2 for k in range(len(base))], k=120):
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÉ") + w[k:], w[:k] + rng.choice("ab") + w[k + 1 :], w.title()])
            words.append(w)
        texts.append(rng.choice([" ", "-", "1", "\n"]).join(words))
    return texts


def test_variants_equal_plain(spark):
    texts = corpus(RNG) + AWKWARD
    got = spelled(spelling.variants(frame(spark, texts)))
    want = plain_variants(plain_counts(list(enumerate(texts))))
    assert got == want and sum(r[1] is not None for r in want) > 50 and max(r[4] for r in want) > 5


def test_variants_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 8)
    texts = corpus(random.Random(3))
    assert spelled(spelling.variants(frame(spark, texts))) == plain_variants(plain_counts(list(enumerate(texts))))


def test_variants_follow_chains(spark):
    texts = [" ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdegh"] * 125 + ["abcdegg"] * 125)]
    got = spelled(spelling.variants(frame(spark, texts, [4]), every=10**9))
    assert got == [("abcdef", "abcdeg", "abcdegg", 5, 1, 25), ("abcdeg", "abcdegg", "abcdegg", 25, 3, 125), ("abcdegg", None, "abcdegg", 125, 2, None), ("abcdegh", None, "abcdegh", 125, 2, None)]


def test_variants_awkward(spark):
    assert spelled(spelling.variants(frame(spark, [], []))) == []
    texts = [*AWKWARD, "anagram margana " * 9, "granama"]
    ids = [None, *range(1, len(texts))]
    assert spelled(spelling.variants(frame(spark, texts, ids))) == plain_variants(plain_counts(list(zip(ids, texts))))
    clash = spark.createDataFrame([(1, "cuttlefish " * 6, None, 9, 9, "w", 9, 9, 9, 9, 9)], CLASHING)
    assert [r[0] for r in spelled(spelling.variants(clash))] == ["cuttlefish"]


# ---- ranked search ----------------------------------------------------------------------


def plain_search(docs, items, k=10):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        asked = Counter(term.findall((text or "").translate(lower)))
        scores = []
        for i, c in found:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(q * w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def prose(n, rng):
    return rng.choice([" ", ", ", "\x00"]).join(rng.choice(["the", "The", "of", "élan", "x9"]) if rng.random() < 0.6 else f"w{rng.randint(0, 400)}é" for _ in range(n))


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("shard", [8192, 16])
def test_search_equals_plain(spark, monkeypatch, shard):
    monkeypatch.setattr(retrieval, "SHARD", shard)
    rng = random.Random(4)
    texts = [prose(rng.choice([1, 2, 5, 20, 20, 20, 90, 300]), rng) for _ in range(300)] + [prose(20, random.Random(9))] * 100
    items = [(i, prose(rng.choice([1, 3, 30]), rng)) for i in range(40)] + [(90, texts[3]), (91, texts[-1]), (92, None), (93, ""), (94, "nowhere"), (95, "the " * 50)]
    docs = list(enumerate(texts))
    assert found(retrieval.rank_documents(frame(spark, texts), items_frame(spark, items))) == plain_search(docs, items)


def test_search_with_every_term_indexed(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SENT", 3)
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    rng = random.Random(5)
    texts = [prose(15, rng) for _ in range(60)]
    items = [(i, prose(8, rng)) for i in range(11)]
    assert found(retrieval.rank_documents(frame(spark, texts), items_frame(spark, items))) == plain_search(list(enumerate(texts)), items)


def test_search_leaves_strata_out(spark):
    """Strata under the tenth score are not visited, and results stay whole."""
    rng = random.Random(6)
    table = retrieval.term_counts(frame(spark, [prose(rng.randint(1, 200), rng) for _ in range(400)]), "doc_id", "text").collect()
    import pyarrow as pa

    m = [25 + r["n"] for r in table]
    rows = pa.table({"shard": pa.array([0] * len(m), pa.int32()), "m": m, "id": [r["id"] for r in table], "terms": [r["terms"] for r in table], "tfs": [r["tfs"] for r in table]})
    shard = retrieval.Shard(retrieval._strata(rows))
    wanted = [("w7é", 5000), ("w9é", 4000), ("the", 10)]
    ids, scores = shard.search(wanted, 5, 1)
    total = Counter()
    for r, mm in zip(table, m):
        for t, tf in zip(r["terms"], r["tfs"]):
            total[r["id"]] += dict(wanted).get(t, 0) * ((10**9 * tf) // (1000 * tf + 8 * mm))
    best = sorted(((-s, i) for i, s in total.items() if s))[:5]
    assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == best
    assert shard.search(wanted, 5, int(scores[0]) + 1)[0].tolist() == []


def test_search_awkward(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(retrieval.rank_documents(frame(spark, ["a"]), none)) == []
    assert found(retrieval.rank_documents(frame(spark, [], []), items_frame(spark, [(1, "a")]))) == []
    texts, ids = [*AWKWARD, "a b", "a b"], [None, *range(1, len(AWKWARD)), 5, None]
    items = [(1, "A b é text"), (None, "x " * 3), (3, "Ünïcödé"), (4, "x" * 5000)]
    got = retrieval.rank_documents(frame(spark, texts, ids), items_frame(spark, items)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [x for i in items for x in plain_search(list(zip(ids, texts)), [i])]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    clash = spark.createDataFrame([(1, "needle", None, 9, 9, "w", 9, 9, 9, 9, 9), (2, "hay", None, 9, 9, "w", 9, 9, 9, 9, 9)], CLASHING)
    assert [r[:3] for r in found(retrieval.rank_documents(clash, items_frame(spark, [(1, "needle")])))] == [(1, 1, 1)]
    twice = retrieval.rank_documents(frame(spark, ["needle", "hay", "hay"]), items_frame(spark, [(1, "needle"), (1, "needle")]))
    assert twice.filter(F.col("rank") == 1).count() == 2
