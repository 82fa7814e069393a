"""Near copies by SimHash and the exact overlap of word shingles: BK-trees, a prefix join, verified links, connected components.

Sets whose SimHash fingerprints are linked in the BK-trees of `simhash` are the first candidates.
Overlaps near the bound differ in more bits than the trees can search, so a prefix join completes
them; whichever way a pair is found, it is verified on the texts.

Two sets of shingles whose overlap (intersection over union) reaches a bound share a shingle among
the first few of each, in any fixed order, and from there on both have enough shingles left. So a
set goes to the keys of its prefix, and pairs that pass this test at a common key are verified: no
pair over the bound is missed. Shingles that a sample finds often come last in the order, so
boilerplate seldom is a key. Keys of many sets link them to a pivot, then sets outside the key's
largest component to some more pivots in each round; only those that none has linked are compared
with the whole key at the end, in tiles. The rounds end early once few comparisons are left, since
each costs the driver some thirty stages; for the same reason sides of joins are not broadcast.

Texts lie in bucketed groups that all passes read in place. To be verified, a text goes once to
each block of pairs that have one set in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .buckets import bucketed
from .common import NO_ID, staged
from .simhash import components, fingerprint, links
from .words import Words, as_bytes, member, windows

#: one set in so many is in the sample that orders the shingles, how many of them make a shingle common, and common ones at most
SAMPLE, COMMON, MOST = 8, 3, 1 << 20
#: sets under one key that are compared pair by pair at once; pivots of larger keys in each round
SMALL, PIVOTS = 8, (1, 4, 16, 64)
#: sets of a large key that are compared with each other in one place, and pairs of one set that are verified in one
TILE, BLOCK = 4096, 512
_SLICE = 8 << 20
_ROWS = "key long, sid long, size int, left int"


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of every text's distinct runs of n words, A-Z lower-cased; all words of a shorter text are one run."""
    a = 0
    while a < len(texts):
        b, total = a + 1, len(texts[a])
        while b < len(texts) and total + len(texts[b]) <= _SLICE:
            total += len(texts[b])
            b += 1
        words = Words([t.lower() for t in texts[a:b]])  # of bytes: A-Z only
        h = words.hashes(17)
        for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            yield np.unique(windows(h[s:e], min(n, e - s), 0x6A09E667F3BCC909)) if e > s else np.zeros(0, np.uint64)
        a = b


def overlap_reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = int(member(a, b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides stay on the executors: a broadcast would build each in the driver, and there are dozens."""
    return left.join(right.hint("merge"), on, how)


def _marked(held: DataFrame, n: int) -> DataFrame:
    """(__group, __row, id, sid, fp) of bucketed (id, text): sid is a hash of the set of shingles, fp the SimHash of all shingles. Staged."""

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(3))
            sid = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in shingle_sets(texts, n)]
            fp = [fingerprint(t, n) for t in texts]
            made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sid, fp)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["__group", "__row", "id", "sid", "fp"])

    return staged(held.select("__group", "__row", "id", "text").mapInArrow(run, "__group int, __row long, id long, sid long, fp long"), "marked")


def _alike(firsts: DataFrame) -> DataFrame:
    """(a, b): every set whose fingerprint is met or linked in the BK-trees of simhash.links, with one of the sets there."""
    lead = staged(firsts.groupBy("fp").agg(F.min("sid").alias("lead")), "fingerprints")
    same = _join(firsts, lead, "fp").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    one, other = (lead.select(F.col("fp").alias(c), F.col("lead").alias("l" + c)) for c in "ab")
    near = _join(_join(links(lead), one, "a"), other, "b").groupBy("la").agg(F.min("lb").alias("lb"))
    return same.unionByName(near.select(F.col("lb").alias("a"), F.col("la").alias("b"))).filter("a <> b")


def _common(texts: DataFrame, n: int) -> np.ndarray:
    """Sorted shingles that are common in a sample of the sets; they only order the keys, so results don't depend on them.

    The sample is a fixed share of all sets, so what is common does not depend on the size of the input.
    """

    def run(batches):
        seen: set[int] = set()  # copies within a task
        for batch in batches:
            held = []
            for s in shingle_sets(as_bytes(batch.column(0)), n):
                sid = xxhash.xxh3_64_intdigest(s.tobytes())
                if sid % SAMPLE == 0 and sid not in seen:
                    seen.add(sid)
                    held.append(s)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["h"])

    often = texts.select("text").mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST)
    return np.sort(often.select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))


def _whole_keys(batches, parts: int = 1) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut where one of the first `parts` columns changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if any(held[-1][p][-1] != held[0][p][0] for p in range(parts)):
            both = [np.concatenate(c) for c in zip(*held)]
            same = np.logical_and.reduce([both[p] == both[p][-1] for p in range(parts)])
            k = len(same) - int(np.argmin(same[::-1]))
            held = [[c[k:] for c in both]]
            yield [c[:k] for c in both]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _prefixes(held: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, sid, size, left, g) for keys that g > 1 sets share; left: the set's shingles from the key on. Staged."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(_common(held, n))  # at most MOST numbers

    def cut(batches):
        seen: set[int] = set()  # copies within a task
        for batch in batches:
            out = []
            for s in shingle_sets(as_bytes(batch.column(0)), n):
                sid = np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)
                if sid in seen or not len(s):
                    continue
                seen.add(sid)
                k = len(s) + percent * len(s) // -100 + 1
                late = member(s, shared.value)
                own = np.concatenate([s[~late], s[late]])[:k]
                out.append((own, np.full(k, sid), np.full(k, len(s), np.int32), np.arange(len(s), len(s) - k, -1, dtype=np.int32)))
            if out:
                key, *rest = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, rest)], ["key", "sid", "size", "left"])

    def several(batches):
        for key, sid, size, left in _whole_keys(batches):
            order = np.lexsort((sid, key))
            key, sid, size, left = (c[order] for c in (key, sid, size, left))
            fresh = (np.diff(key, prepend=key[0] ^ 1) != 0) | (np.diff(sid, prepend=sid[0]) != 0)
            key, sid, size, left = (c[fresh] for c in (key, sid, size, left))
            _, own, count = np.unique(key, return_inverse=True, return_counts=True)
            g = count[own]
            yield pa.RecordBatch.from_arrays([pa.array(c[g > 1]) for c in (key, sid, size, left, g.astype(np.int32))], ["key", "sid", "size", "left", "g"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select("text").mapInArrow(cut, _ROWS).repartition(parts, "key").sortWithinPartitions("key")
    return staged(dealt.mapInArrow(several, f"{_ROWS}, g int"), "prefixes")


def _may(a: str, b: str, percent: int) -> str:
    """SQL: whether two sets of a key, at their places in it, can reach the bound."""
    return f"{a}.label <> {b}.label and {100 + percent} * least({a}.left, {b}.left) >= {percent} * ({a}.size + {b}.size)"


def _small(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of keys of at most SMALL sets."""

    def run(batches):
        for key, sid, size, left in _whole_keys(batches):
            size, left = size.astype(np.int64), left.astype(np.int64)
            first, count = np.unique(key, return_index=True, return_counts=True)[1:]
            start, place = np.repeat(first, count), np.arange(len(key))
            found = []
            for d in range(1, SMALL):
                j = np.flatnonzero(place - start >= d)
                i = j - d
                ok = (100 + percent) * np.minimum(left[i], left[j]) >= percent * (size[i] + size[j])
                found.append(np.stack([sid[i[ok]], sid[j[ok]]], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter(F.col("g") <= SMALL).select("key", "sid", "size", "left").repartition(parts, "key").sortWithinPartitions("key", "sid")
    return dealt.mapInArrow(run, "a long, b long")


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows of large keys that links leave in several components, plus main, the largest of these, and all, how many sets the key has. Staged."""
    rows = _join(rows.filter(F.col("g") > SMALL).select("key", "sid", "size", "left", "g"), roots, F.col("sid") == F.col("node"), "left")
    rows = rows.select("key", "sid", "size", "left", "g", F.coalesce("root", "sid").alias("label"))
    of = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = of.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    return staged(rows.join(main.filter(F.col("all") > F.col("most")).drop("most"), "key"), "open")


def _pivots(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b) of the sets outside a large key's largest component (in the first turn of all) and the key's pivots of this turn."""
    large = rows.filter(F.col("g") > SMALL)
    deal = F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(PIVOTS[turn]))
    pivots = large.groupBy("key", deal.alias("deal")).agg(F.min_by(F.struct("sid", "size", "left", "label"), F.xxhash64("sid", F.lit(turn))).alias("p"))
    asks = large.filter("label <> main") if turn else large
    both = asks.alias("r").join(pivots.alias("q").select("key", "p"), "key").filter(_may("r", "p", percent))
    return both.select(F.col("p.sid").alias("a"), F.col("r.sid").alias("b"))


def _rest(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the sets outside a key's largest component with all others of the key, tile by tile."""
    r = rows.withColumn("tiles", F.ceil(F.col("all") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    asks = r.filter("label <> main").select("key", F.col("tile").alias("i"), F.explode(every).alias("j"), F.struct("sid", "size", "left", "label").alias("s"), F.lit(0).alias("side"))
    all_ = r.select("key", F.explode(every).alias("i"), F.col("tile").alias("j"), F.struct("sid", "size", "left", "label").alias("s"), F.lit(1).alias("side"))

    def run(batches):
        for key, i, j, side, sid, size, left, label in _whole_keys(batches, 3):
            cut = np.flatnonzero((np.diff(key, prepend=key[0] ^ 1) != 0) | (np.diff(i, prepend=i[0]) != 0) | (np.diff(j, prepend=j[0]) != 0))
            size, left = size.astype(np.int64), left.astype(np.int64)
            found = [np.zeros((0, 2), np.int64)]
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                m = s + int((side[s:e] == 0).sum())
                for x in range(s, m):
                    ok = (label[m:e] != label[x]) & ((100 + percent) * np.minimum(left[m:e], left[x]) >= percent * (size[m:e] + size[x]))
                    found.append(np.stack([np.full(int(ok.sum()), sid[x]), sid[m:e][ok]], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asks.unionByName(all_).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return dealt.select("key", "i", "j", "side", "s.sid", "s.size", "s.left", "s.label").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, firsts: DataFrame, held: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the bound. Blocks hold pairs with one a; each of their texts goes there once."""
    at = F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1
    placed = pairs.withColumn("at", at).withColumn("part", F.floor(F.col("at") / BLOCK).cast("int"))
    heads = F.when(F.col("at") % BLOCK == 0, F.array("a", "b")).otherwise(F.array("b"))
    need = _join(placed.select("a", "part", F.explode(heads).alias("sid")), firsts.select("sid", "row.*"), "sid").select("__group", "__row", "a", "part", "sid")

    def fetch(_, own, wanted):
        at = {r: k for k, r in enumerate(own["__row"].to_pylist())}
        texts = own["text"].take(pa.array([at[r] for r in wanted["__row"].to_pylist()], pa.int64()))
        return wanted.select(["a", "part", "sid"]).append_column("text", texts)

    def run(batches):
        block, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            a, part, sid = (batch.column(k).to_pylist() for k in range(3))
            for k, s in enumerate(shingle_sets(as_bytes(batch.column(3)), n)):
                if sid[k] == a[k]:
                    block, first = (a[k], part[k]), s
                elif block == (a[k], part[k]):
                    good[k] = overlap_reaches(first, s, percent)
                else:
                    raise ValueError("a block without its own set")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(good))

    fetched = held.select("__group", "__row", "text").groupBy("__group").cogroup(need.groupBy("__group")).applyInArrow(fetch, "a long, part int, sid long, text string")
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = fetched.repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("sid") != F.col("a"))
    return staged(blocks.mapInArrow(run, "a long, b long"), "verified")


def _relabelled(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, root): labels after two hops over new edges, to the smallest label met; a node without a row is its own label. Staged.

    That joins what hangs on one pivot, at a few exchanges; labels that could still be joined only
    cost comparisons, the groups come from all edges at the end.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if labels is not None:
        for c in "uv":
            e = _join(e, labels.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        e = e.filter("u <> v")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    further = _join(near, near.select(F.col("u").alias("m"), F.col("m").alias("m2")), "m").filter("m2 < u").select(F.col("u").alias("node"), F.col("m2").alias("root"))
    if labels is not None:
        moved = _join(labels, further.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
        further = further.unionByName(moved.select("node", F.coalesce("to", "root").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    return staged(further, "labels")


def _groups(held: DataFrame, firsts: DataFrame, n: int, percent: int) -> DataFrame | None:
    """(node, root) of the sets that links connect; None without any link."""
    alike = staged(_alike(firsts), "alike")
    rows = _prefixes(held, n, percent).withColumn("label", F.col("sid"))
    if rows.isEmpty():
        return None
    turn, sets, roots, edges, done = 0, firsts.count(), None, None, None
    lower = lambda df: df.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    while True:
        made = _pivots(rows, turn, percent) if turn < len(PIVOTS) else _rest(rows, percent)
        if turn == 0:
            made = alike.unionByName(made).unionByName(_small(rows, percent))
        # the set that comes first in a hash order leads, so that pairs share their leader
        led = F.xxhash64("a", F.lit(turn)) < F.xxhash64("b", F.lit(turn))
        made = made.select(F.when(led, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(led, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
        if done is not None:
            made = _join(made.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}), done, ["lo", "hi"], "left_anti").select("a", "b")
        pairs = staged(made, "pairs")
        done = lower(pairs) if done is None else done.unionByName(lower(pairs))
        found = _verified(pairs, firsts, held, n, percent)
        edges = found if edges is None else edges.unionByName(found)
        if turn == len(PIVOTS):
            break
        roots = _relabelled(found, roots)
        rows = _open(rows, roots)
        left = rows.filter("label <> main").agg(F.sum("all")).first()[0]
        if left is None:
            break
        # where all pairs that are left are no more than the sets, another turn costs more than to compare them
        turn = len(PIVOTS) if left <= sets else turn + 1
    return staged(components(edges), "roots")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The row of docs with the smallest id of each group of near copies; rows without an id stay.

    Two documents link if their sets of `shingle`-word runs (A-Z lower-cased) overlap by at least
    `percent` in a hundred, counted exactly; groups are what links connect. Texts with the same
    set, such as those without words, are one group.
    """
    inner = [f"c{k}" for k in range(len(docs.columns))]  # so that no name clashes
    id_at, text_at = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    held = bucketed(docs.toDF(*inner), "near")
    texts = held.select("__group", "__row", F.col(id_at).cast("long").alias("id"), F.col(text_at).cast("string").alias("text"))
    marked = _marked(texts, shingle)
    first = F.min(F.coalesce("id", F.lit(NO_ID))).alias("first")
    firsts = staged(marked.groupBy("sid").agg(F.min(F.struct("__group", "__row")).alias("row"), F.min("fp").alias("fp"), first), "firsts")
    roots = _groups(texts, firsts, shingle, percent)
    own = firsts.withColumn("root", F.col("sid"))
    if roots is not None:
        own = _join(firsts, roots, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    least = own.groupBy("root").agg(F.min("first").alias("least"))
    kept = _join(own, least, "root").filter(F.col("first") == F.col("least")).select("sid", "least")
    chosen = _join(marked, kept, "sid").filter(F.col("id").isNull() | (F.col("id") == F.col("least")))
    chosen = chosen.unionByName(_join(marked.filter("id is null"), kept, "sid", "left_anti").withColumn("least", F.lit(NO_ID)))
    rows = staged(chosen.select("__group", "__row"), "kept")

    def pick(_, own, wanted):
        return own.filter(pc.is_in(own["__row"], value_set=wanted["__row"].combine_chunks())).select(inner)

    # the texts stay where they are, only the chosen row numbers are dealt
    picked = held.groupBy("__group").cogroup(rows.groupBy("__group")).applyInArrow(pick, T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, docs.schema)]))
    return picked.toDF(*docs.columns)
