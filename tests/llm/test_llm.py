"""Operators for training data against plain versions, on small and awkward inputs."""

import base64
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
import corpus_pipeline
from mdq.llm import ann, bpe, catalogue, langid, line_dedup, near_copies, packing, quality, simhash, substring_dedup, suffix_dedup, warc
from mdq.llm.common import work_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCAB = ["ba", "lo", "Mi", "tu", "sé", "ra", "no", "ke", "日本", "x1"]


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, texts, ids=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


AWKWARD = [None, "", "\n", " \t ", "a", "a b", "A B é", "\x00\x01", "x" * 5000, "ab " * 2000, "a\r\nb\r\n", " line", "𝔘ni 👍🏽 text"]


# ---- line dedup -------------------------------------------------------------------------


def plain_lines(rows, min_chars=10, min_docs=2):
    import string

    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(lower)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and min(held[key(x)]) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_matches_plain_version(spark):
    pool = [prose(RNG.randint(1, 6)) for _ in range(25)] + ["Shared LINE of text", "  shared line of TEXT\r", "short"]
    texts = ["\n".join(RNG.choice(pool) for _ in range(RNG.randint(0, 9))) for _ in range(60)] + AWKWARD
    rows = list(enumerate(texts))
    got = line_dedup.drop_shared_lines(frame(spark, texts)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == sorted(plain_lines(rows))


def test_line_dedup_null_and_repeated_ids(spark):
    line = "a line that is shared"
    rows = [(None, line), (3, line), (3, line), (1, line + "\nown")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_lines int")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_shared_lines(df).collect()), key=str)
    assert got == sorted([(None, "", 1, 1), (3, "", 1, 1), (3, "", 1, 1), (1, line + "\nown", 2, 0)], key=str)


# ---- suffix, substring and SimHash dedup --------------------------------------------------


def shared_texts():
    passages = [prose(120) for _ in range(4)]
    texts = [prose(RNG.randint(0, 90)) + " " + RNG.choice(passages)[RNG.randint(0, 300) :] + " " + prose(RNG.randint(0, 40)) for _ in range(30)]
    near = passages[0].split(" ")
    for _ in range(6):  # near copies: one word changed
        w = list(near)
        w[RNG.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts + [texts[0], texts[0]] + ["ab" * 700, "ab" * 401, "z" * 1300] + AWKWARD


def test_suffix_dedup_matches_plain_version(spark):
    texts = shared_texts()
    for size in (400, 130):
        got = suffix_dedup.drop_repeated_bytes(frame(spark, texts), size=size)
        got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == [(i, *x) for i, x in enumerate(brute.suffix_dedup(texts, size))]


def test_collections_in_a_file_give_the_same_runs(monkeypatch):
    texts = [t.encode() for t in shared_texts() if t and len(t.encode()) >= 400]
    anchor, group = np.full(len(texts), 3), np.array([i % 3 for i in range(len(texts))])
    group = np.sort(group)
    runs = lambda: sorted(zip(*(x.tolist() for x in suffix_dedup.Collection(texts, group, anchor, 400).repeated())))
    inside = runs()
    monkeypatch.setattr(suffix_dedup, "MEMORY", 1)
    assert runs() == inside and inside


def test_substring_dedup_matches_plain_version(spark):
    texts = shared_texts() + [" ".join(["w"] * 36), "w " * 35, "v " * 34]
    for size in (35, 3, 1):
        got = substring_dedup.drop_repeated_windows(frame(spark, texts), size=size)
        kept = [(r.doc_id, r.n_words, r.n_removed, brute.sha(" ".join(brute.WORDS.findall(r.text or "")).encode())) for r in got.collect()]
        assert sorted(kept) == [(i, *x) for i, x in enumerate(brute.substring_dedup(texts, size))]


def test_substring_prefilter_loses_nothing_when_cells_collide(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CELL_BITS", 4)
    texts = shared_texts()
    got = substring_dedup.drop_repeated_windows(frame(spark, texts)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(i, x[1]) for i, x in enumerate(brute.substring_dedup(texts, 35))]


def test_clean_texts_stay_as_they_are(spark):
    texts = ["  one\n two \n\nthree ", prose(50)]
    got = {r.doc_id: r.text for r in substring_dedup.drop_repeated_windows(frame(spark, texts)).collect()}
    assert got == dict(enumerate(texts))


def test_simhash_matches_plain_version(spark):
    base = [prose(40) for _ in range(12)]
    texts = list(base)
    for t in base[:6]:
        for _ in range(5):
            w = t.split(" ")
            w[RNG.randrange(len(w))] = RNG.choice(["zz", "yy"])
            texts.append(" ".join(w))
    texts += AWKWARD + base[:3]
    got = sorted(map(tuple, simhash.near_groups(frame(spark, texts)).collect()))
    assert got == [(i, *x) for i, x in enumerate(brute.simhash(texts, list(range(len(texts)))))]


def test_links_connect_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(2)
    values = set()
    for c in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            x = c
            for b in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                x ^= 1 << int(b)
            values.add(x)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                root[find(signed[i])] = find(signed[j])
    groups, own = {}, {}
    for v in signed:
        groups.setdefault(find(v), set()).add(v)
        own.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_simhash_ids_may_be_null_or_repeated(spark):
    text = prose(30)
    got = simhash.near_groups(frame(spark, [text, text, text, "other words here"], [None, 7, 7, None])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)
    kept = simhash.keep_one(frame(spark, [text, text, "unlike the rest of them"], [5, 2, 9])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 9]


# ---- near copies of the pipeline ------------------------------------------------------------


def plain_near_copies(rows, n=5, percent=80):
    """Ids that stay: the smallest of each component of texts whose n-word runs overlap enough."""
    sets = []
    for _, t in rows:
        w = brute.WORDS.findall((t or "").encode().lower().decode())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def changed(text, words, rng):
    w = text.split(" ")
    for k in range(words):
        w[rng.randrange(len(w))] = f"c{rng.random()}"
    return " ".join(w)


def test_near_copies_of_five_word_overlap_go(spark):
    text = prose(130)
    near = text.split(" ")
    for k in (30, 90):
        near[k] = "changed"
    rows = [(1, text), (2, " ".join(near)), (3, prose(130))]
    assert plain_near_copies(rows) == [1, 3]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, [t for _, t in rows], [i for i, _ in rows]), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


@pytest.mark.parametrize("small,common", [(8, 5), (1, 2)])
def test_near_copies_match_plain_version(spark, monkeypatch, small, common):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "COMMON", common)
    rng = random.Random(small)
    base = [prose(n, rng) for n in (120, 120, 60, 300)]
    texts = [changed(rng.choice(base), rng.randint(0, 7), rng) for _ in range(90)]
    texts += [base[0] + " " + prose(k, rng) for k in (5, 15, 25, 35, 45)] + [t.upper() for t in texts[:3]]
    texts += [prose(40, rng) + " " + base[1] for _ in range(5)] + AWKWARD + ["a", "A b"]
    ids = rng.sample(range(1000), len(texts))
    got = near_copies.keep_one(frame(spark, texts, ids))
    assert sorted(r.doc_id for r in got.collect()) == plain_near_copies(list(zip(ids, texts)))


def test_near_copies_take_one_more_turn_where_little_is_left(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", 2)
    monkeypatch.setattr(near_copies, "COMMON", 1000)
    pivots, rest, turns = near_copies._pivots, near_copies._rest, []
    monkeypatch.setattr(near_copies, "_pivots", lambda rows, turn, percent: turns.append(turn) or pivots(rows, turn, percent))
    monkeypatch.setattr(near_copies, "_rest", lambda rows, percent: turns.append("rest") or rest(rows, percent))
    rng = random.Random(4)
    shared, base = prose(40, rng), prose(60, rng)
    texts = [shared + " " + prose(40, rng) for _ in range(5)] + [changed(base, 1, rng) for _ in range(4)] + [prose(12, rng) for _ in range(600)]
    got = near_copies.keep_one(frame(spark, texts, list(range(len(texts)))))
    assert sorted(r.doc_id for r in got.collect()) == plain_near_copies(list(enumerate(texts)))
    assert turns == [0, "rest"]


def test_near_copies_come_from_fingerprints_too(spark):
    words = prose(300).split()
    other = [*words[:150], "elsewhere", *words[151:]]
    held = frame(spark, [" ".join(words), " ".join(other), prose(300)]).select(F.lit(0).alias("__group"), F.col("doc_id").alias("__row"), F.col("doc_id").alias("id"), "text")
    marked = near_copies._marked(held, 5)
    want = {i: simhash.fingerprint(t.encode(), 5) for i, t in ((r.id, r.text) for r in held.collect())}
    assert {r.id: r.fp % 2**64 for r in marked.collect()} == want
    rows = [(k, fp) for k, fp in enumerate((0, 0, 5, -1, -1 - 7, 1 << 40 | 5))]  # 0 0 5 ...: within 3 bits of each other; -1 and -8 too
    pairs = near_copies._alike(spark.createDataFrame(rows, "sid long, fp long")).collect()
    assert {r.b for r in pairs} | {r.a for r in pairs} == {0, 1, 2, 3, 4, 5}
    assert all({r.a, r.b} <= {0, 1, 2, 5} or {r.a, r.b} == {3, 4} for r in pairs)


def test_near_copies_keep_rows_without_an_id(spark):
    text = prose(30)
    got = near_copies.keep_one(frame(spark, [text, text, None, text, "other words here"], [None, 7, None, 3, None])).collect()
    assert sorted((r.doc_id for r in got), key=str) == [3, None, None, None]


# ---- quality --------------------------------------------------------------------------------


def plain_counts(text):
    words = brute.WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_match_plain_version(spark):
    texts = [prose(RNG.randint(0, 60)) + "\n" + prose(3) * RNG.randint(0, 4) for _ in range(20)] + ["a b c a b c a", "# $ a|b <c>\n# $ a|b <c>\n\n"] + [t for t in AWKWARD if t != "ab " * 2000]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_rules(frame(spark, texts)).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def plain_distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def test_divergence_matches_plain_version(spark):
    texts = [prose(80) for _ in range(12)] + ["### *** $$$ %%% " * 40]
    df = frame(spark, texts)
    seen = quality.measured(df)
    ref = quality.references(quality.language_sums(seen), quality.common_words(seen))
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        words = brute.WORDS.findall(t)
        joined = "".join(words)
        shares = [sum(c in own for c in joined) / len(joined) for own in (set("aeiou"), set("bcdfghjklmnpqrstvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789"))]
        shares.append(sum(ord(c) > 127 for c in joined) / len(joined))
        shares.append(max(0.0, 1 - sum(shares)))
        assert got[i].char_distance == pytest.approx(plain_distance(shares, ref["char"][0]), abs=1e-9)
        hits = [w for w in words if w in set(ref["words"])]
        if hits:
            assert got[i].word_distance == pytest.approx(plain_distance([hits.count(w) / len(hits) for w in ref["words"]], ref["word"][0]), abs=1e-7)
        else:
            assert got[i].word_distance is None
    assert not got[12].kept and all(got[i].kept for i in range(12))


def test_quality_keeps_clean_documents_of_a_rare_language(spark, monkeypatch):
    rng = random.Random(3)
    greek = " ".join("".join(rng.choice("αβγδεζηθικλμνοπρστυφχψω") for _ in range(rng.randint(2, 8))) for _ in range(90))
    latin = [(i, prose(60), "en", "s", 1) for i in range(399)]
    df = spark.createDataFrame([*latin, (900, greek, "el", "s", 1)], DOCS)
    assert [r.kept for r in quality.quality_rules(df).filter("doc_id = 900").collect()] == [True]
    both = df.unionByName(df.filter("doc_id = 900").withColumns({"doc_id": F.lit(901), "lang": F.lit(None).cast("string")}))
    got = {r.doc_id: r for r in quality.quality_rules(both, most=1).filter("doc_id >= 900").collect()}
    assert got[900].kept and got[900].char_distance < 1e-6 and got[900].word_distance < 1e-6  # its own language, by a join
    assert not got[901].kept  # no label, and far from the one language that all are compared with


def test_quality_of_250_languages(spark):
    """Languages beyond those that the driver holds have references too: clean documents stay, noise goes."""
    rng = random.Random(8)
    word = lambda k: "".join(chr(0x4E00 + 20 * k + rng.randrange(20)) for _ in range(rng.randint(2, 4)))
    rows = [(k, " ".join(word(k) for _ in range(90)), f"l{k:03d}", "s", 1) for k in range(250)]
    rows += [(1000 + k, "abc def ghi " * 90, f"l{k:03d}", "s", 1) for k in (3, 249)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: r for r in quality.quality_rules(df, max_repeat_percent=101, most=20).collect()}
    assert len(got) == 252 and all(got[k].kept for k in range(250))
    small = quality.quality_rules(df.filter("lang in ('l248', 'l249')"), max_repeat_percent=101, most=1)
    assert {r.doc_id: r.kept for r in small.collect()}[248]


def test_quality_compares_with_all_languages_however_many(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda k: "".join(chr(0x4E00 + 20 * k + rng.randrange(20)) for _ in range(rng.randint(1, 3)))
    text = lambda k: " ".join(word(k) if rng.random() < 0.7 else word(0) for _ in range(90))
    rows = [(k, text(k) if k % 9 else prose(60), f"l{k:03d}", "s", 1) for k in range(210)]
    rows += [(900, rows[209][1], None, "s", 1), (901, rows[209][1], "l003", "s", 1), (902, rows[209][1], "x", "s", 1), (903, "", "y", "s", 1), (904, None, None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality.quality_rules(df, max_repeat_percent=101).collect()}
    assert len(got) == 215 and all(got[k].kept and got[k].word_distance < 0.9 for k in (209, 900, 901, 902)) and got[903].char_distance is None
    few = spark.createDataFrame([*rows[:12], (900, rows[11][1], None, "s", 1), (901, rows[11][1], "l003", "s", 1), *rows[-2:]], DOCS)
    want = {r.doc_id: r for r in quality.quality_rules(few, max_repeat_percent=101).collect()}
    monkeypatch.setattr(quality, "HELD", 5)
    got = {r.doc_id: r for r in quality.quality_rules(few, max_repeat_percent=101).collect()}
    for k, w in want.items():
        assert (got[k].kept, got[k].n_common) == (w.kept, w.n_common)
        assert [got[k].char_distance, got[k].word_distance] == [x if x is None else pytest.approx(x, abs=1e-6) for x in (w.char_distance, w.word_distance)]


def test_quality_without_labels(spark):
    got = quality.quality_rules(frame(spark, [prose(60), None]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.doc_id: (r.kept, r.char_distance) for r in got} == {0: (True, None), 1: (False, None)}


def test_language_id_of_250_languages(spark):
    """Every labelled language is learned; scores are those of a plain mean over n-grams; the bound is the calibrated one."""
    rng = random.Random(12)
    word = lambda k: "".join(chr(0x4E00 + 20 * k + rng.randrange(20)) for _ in range(rng.randint(2, 4)))
    rows = [(i, " ".join(word(i % 250) for _ in range(20)), f"l{i % 250:03d}", "s", 1) for i in range(250 * 12)]
    df = spark.createDataFrame(rows + [rows[0]] * 500, DOCS).repartition(4)
    model = langid.fit(df)
    assert len(model.languages) == 250
    got = langid.predict(df.filter(langid.fold_of(F.col("doc_id")) == 2), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    for r in got[:20]:
        data = b" " + r.text.encode() + b" "
        at = []
        for n, mult in zip((2, 3, 4), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            for k in range(len(data) - n + 1):
                v = int.from_bytes(data[k : k + n], "big")
                at.append(((v * mult + n) % 2**32 * 0x27D4EB2F) % 2**32 >> (32 - langid.BUCKET_BITS))
        z = (model.scores[at].astype(float).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert (r.lang_pred, r.score) == (model.languages[p.argmax()], pytest.approx(p.max(), abs=1e-9))
        assert r.accepted == (r.score >= model.least)


def test_calibrated_bound_rejects(spark):
    logits = np.array([[4.0, 0.0], [3.0, 0.0], [0.1, 0.0], [0.0, 5.0]])
    t, least = langid.calibrate(logits, np.array([0, 0, 0, 1]), 0.5)
    p = langid.softmax(logits / t).max(axis=1)
    assert least > 0.5 and (p >= least).tolist() == [True, True, False, True]


# ---- byte-level BPE and packing -----------------------------------------------------------------

RANKS = P.path("byte_bpe_50k.tiktoken")
STRANGE = ["It's we'll  DON'T\n\n\tx", "tab\t\tend  ", "日本語テキスト 123456", "é́‍﻿", "a" * 3000, "<|endoftext|> in text", "   　x", "0123456789" * 30, "\r\n \r\n"]


def own_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library_and_decodes(spark):
    texts = [prose(RNG.randint(1, 80)) for _ in range(20)] + AWKWARD + STRANGE
    enc, ranks = own_encoding(), bpe.read_ranks(RANKS)
    df = bpe.encode(frame(spark, texts).withColumn("ids", F.lit(1)), RANKS, P.PATTERN)
    got = df.select("doc_id", "ids", bpe.decode(F.col("ids"), ranks).alias("back"), bpe.little_endian(F.col("ids"), len(ranks)).alias("raw")).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t)
        assert bytes(r.back) == t.encode() and bytes(r.raw) == np.array(r.ids, "<u4").tobytes()


def test_bpe_fold_in_the_jvm_matches_the_plain_fold(spark):
    words = sorted({w for t in [prose(60), *STRANGE] for w in regex.findall(P.PATTERN, t)} | {" the", "ththth", "é"})
    words = [w for w in words if len(w.encode()) <= bpe.LONGEST]
    ranks = bpe.read_ranks(RANKS)
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", bpe.fold_word(F.col("word"), bpe.rank_map(ranks)).alias("ids")).collect()
    enc = own_encoding()
    for r in got:
        assert tuple(r.ids) == bpe.merge(r.word.encode(), ranks) == tuple(enc.encode_ordinary(r.word))


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [np.clip(rng.lognormal(4, 1.2, 3000), 1, 512), rng.integers(1, 513, 3000), rng.integers(60, 70, 500), np.full(7, 300)][seed].astype(int)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    patterns = packing.plan(counts, 512)
    used = {}
    for times, items in patterns:
        assert times > 0 and sum(items) <= 512
        for n in items:
            used[n] = used.get(n, 0) + times
    assert used == counts
    best = -(-int(lengths.sum()) // 512)
    if seed < 2:
        assert sum(t for t, _ in patterns) <= 1.02 * best + 1


def test_packed_documents_are_whole(spark):
    texts = [prose(RNG.randint(1, 60)) for _ in range(60)] + [prose(900)] + AWKWARD + STRANGE
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(frame(spark, texts), P.path("byte_bpe_50k.json"), P.PATTERN, capacity=128).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 128 for r in own[1:]) and len(own) == -(-len(ids) // 128)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128


# ---- WARC -------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def pages(spark):
    big = "<html>" + "é" * 60 + "WARC/1.0\r\n\r\nWARC/1.1\r\n</html>"
    rows = [(5, "u5", big), (2, "u2", big), (9, "u\r\n9", big), (1, None, None), (3, "u3", ""), (4, "u4", "tiny"), (6, "u6", "tiny"), (None, "n", big), (2, "again", big)]
    rows += [(100 + i, f"http://x/{i}", prose(200)) for i in range(40)]
    return spark.createDataFrame(rows, PAGES), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    got = warc.round_trip(df).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        first = min(same) if len(data) >= 100 and len([1 for _, _, h in rows if (h or "").encode() == data]) > 1 else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if i == first else "revisit", None if i == first else first, True))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload_ok) for r in got], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_ranges_find_every_record_once(spark, compression):
    df, rows = pages(spark)
    warc.register(spark)
    path = work_path(spark, "ranges")
    warc.page_records(df).coalesce(1).write.format("warc").option("path", path).option("compression", compression).option("roll", 30_000).mode("append").save()
    load = spark.read.format("warc").option("path", path).option("split", 700).load()
    assert load.count() == len(rows)
    few = load.filter((F.col("record_type") == "revisit") & F.col("refers_to").isNotNull())
    assert few.count() == 3 and few.select("payload").distinct().collect()[0][0] == b""
    one = load.filter(F.col("record_id").isin("<urn:page:101>", "<urn:page:102>")).collect()
    assert sorted(bytes(r.payload).decode() for r in one) == sorted(h for i, _, h in rows if i in (101, 102))


def test_warc_files_of_lost_tasks_are_not_read(spark):
    df, rows = pages(spark)
    warc.register(spark)
    path = work_path(spark, "lost")
    warc.page_records(df).write.format("warc").option("path", path).mode("append").save()
    with open(path.removeprefix("file:") + "/part-orphan.warc", "wb") as f:
        f.write(warc.encode({"record_id": "x", "record_type": "response", "payload": b"lost"}, False)[:40])
    assert spark.read.format("warc").option("path", path).load().count() == len(rows)


# ---- nearest neighbours --------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def exact(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted((-float(q @ v) / np.linalg.norm(q) / np.linalg.norm(v), j) for j, v in ok if j != i)
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def test_nearest_reaches_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    got = {}
    for r in ann.nearest(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = exact(rows, 50, 5)
    hit = sum(len({x for x, _ in got[q].values()} & {x for x, _ in w}) for q, w in want.items())
    assert hit >= 0.9 * 5 * len(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())


def test_collisions_leave_most_vectors_unverified():
    """Recall comes through collision counting: a fifth of the vectors at most is verified."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    v = np.array(pq.read_table(path)["embedding"].to_pylist(), float)
    shard, asked = ann.Shard(v, ann.measured(v[: ann.SAMPLE], len(v), 6)), v[::50]
    share, hit = [], []
    for query, (places, scores) in zip(asked, shard.search(asked, 6)):
        best = np.argsort(-ann.cosines(v, query), kind="stable")[:6]
        share.append(len(places) / len(v))
        hit.append(len(set(best) & set(places[np.argsort(-scores, kind="stable")[:6]])) / 6)
    print(f"verified share {np.mean(share):.3f}, recall {np.mean(hit):.3f}")
    assert np.mean(share) <= 0.2 and np.mean(hit) >= 0.9


def test_nearest_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(0, 120)] + [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 1.0]), (350, [float("nan"), 1.0, 1.0]), (None, same), (400, [float("inf"), 0.0, 1.0]), (450, [-1.0, 0.0, 1.0])]
    got = {}
    for r in ann.nearest(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(g)] for q, g in got.items()} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 450: [0, 1, 2, 3, 4]}
    few = ann.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]


# ---- language ID ----------------------------------------------------------------------------------

SPOKEN = {"aa": ["the", "of", "and", "with", "thing", "shore"], "bb": ["der", "und", "nicht", "über", "schön", "zeit"], "cc": ["que", "été", "pour", "dans", "très", "eau"]}


def spoken(spark, n=240):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(SPOKEN[x]) for _ in range(rng.randint(3, 30))), x, "s", None) for i in range(n) for x in [rng.choice(list(SPOKEN))]]
    return spark.createDataFrame(rows, DOCS), rows


def test_language_held_out_accuracy_and_unknown(spark):
    df, rows = spoken(spark)
    model = langid.fit(df)
    more = spark.createDataFrame([(900, None, "aa", "s", None), (901, "123 !!", "aa", "s", None), (902, "", None, "s", None)], DOCS)
    got = {r.doc_id: r for r in langid.predict(df.unionByName(more), model).collect()}
    held = [(r, got[r[0]]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and sum(r[2] == g.lang_pred for r, g in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (900, 901, 902))
    assert all(0 <= g.score <= 1 for g in got.values())


def test_language_learns_only_outside_the_held_out_fold(spark):
    df, _ = spoken(spark)
    held = langid.fold_of(F.col("doc_id")) == 2
    changed = df.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("text", F.when(held, F.lit("zzz")).otherwise(F.col("text")))
    a, b = langid.fit(df), langid.fit(changed)
    assert a.languages == b.languages and np.array_equal(a.scores, b.scores) and a.least == b.least


def test_rejection_spares_the_share_of_calibration_texts_it_names():
    rng = np.random.default_rng(1)
    for n in (1, 2, 12, 999, 1001, 3000):
        logits, labels = rng.standard_normal((n, 3)), np.zeros(n, int)
        logits[:, 0] += 3 + rng.random(n)
        t, least = langid.calibrate(logits, labels, 0.999)
        p = langid.softmax(logits / t)
        own = p.max(axis=1)[p.argmax(axis=1) == 0]
        assert (own >= least).sum() >= 0.999 * len(own) and (own > least + 2e-9).sum() < len(own)


def test_right_calibration_texts_are_accepted(spark):
    """Few texts calibrate here, so none of the right ones may be rejected."""
    df, _ = spoken(spark, 60)
    more = spark.createDataFrame([(1000 + i, prose(200, random.Random(i)), "aa", "s", None) for i in range(4)], DOCS)
    docs = df.unionByName(more)
    rows = docs.filter(langid.fold_of(F.col("doc_id")) != 2).select(F.xxhash64("text").alias("h"), "lang", "doc_id").dropDuplicates(["h", "lang"]).orderBy("h", "lang").collect()
    held = {r.doc_id for r in rows[4::5]}
    said = [r for r in langid.predict(docs, langid.fit(docs)).collect() if r.doc_id in held and r.lang_pred == r.lang]
    assert said and all(r.accepted for r in said)


def test_subwords_do_not_depend_on_blocks(monkeypatch):
    data = prose(300).encode()
    whole = langid.counts(data)
    monkeypatch.setattr(langid, "_BLOCK", 64)
    small = langid.counts(data)
    assert np.array_equal(whole[0], small[0]) and np.array_equal(whole[1], small[1])


# ---- empty tables and the pipeline --------------------------------------------------------------------


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for made in (
        line_dedup.drop_shared_lines(docs), suffix_dedup.drop_repeated_bytes(docs), substring_dedup.drop_repeated_windows(docs), simhash.near_groups(docs),
        quality.quality_rules(docs), packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN), bpe.encode(docs, RANKS, P.PATTERN),
        langid.predict(docs, langid.fit(docs)), ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")), warc.round_trip(spark.createDataFrame([], PAGES)),
    ):
        assert made.collect() == []


def test_clashing_column_names(spark):
    names = ["id", "fp", "words", "lines", "n_words", "n_bytes", "kept", "ids", "score", "rank", "h1", "b", "parts", "group", "stripe"]
    df = frame(spark, [prose(20), prose(60)]).withColumns({n: F.lit(7) for n in names})
    for made in (line_dedup.drop_shared_lines(df), suffix_dedup.drop_repeated_bytes(df), substring_dedup.drop_repeated_windows(df), quality.quality_rules(df), bpe.encode(df, RANKS, P.PATTERN), langid.predict(df, langid.fit(df)), simhash.keep_one(df)):
        assert made.count() == 2
        assert {r["stripe"] for r in made.collect()} == {7}
    assert packing.pack(df.withColumn("length", F.lit(5).cast("long"))).count() == 2


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark, tmp_path):
    df, rows = spoken(spark, 60)
    passage = prose(60)
    extra = [(1000, prose(150) + " " + passage, "aa", "s", 1), (1001, prose(150) + " " + passage, "aa", "s", 1), (1002, "!!! 123", "aa", "s", 1), (1003, rows[3][1], "aa", "s", 1)]
    df.unionByName(spark.createDataFrame(extra, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert 1002 not in kept and 1003 not in kept and rows[3][0] in kept
    assert passage not in kept[1000] + kept[1001]
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids == set(kept)


def test_queries_are_registered_once_per_operator():
    names = [n for n in catalogue.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in catalogue.queries()
