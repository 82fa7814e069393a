"""Ranked lexical search over an index stratified by document length.

A document's score depends on its length only through its normaliser m, so documents of equal m
form a stratum. Inside a stratum a term's contribution depends on tf alone: postings lie by term
and tf, and the impact of a tf is computed once. The largest tf of every term bounds what a
stratum can give an item; strata are visited from the largest bound down, and left out where the
bound is under the item's tenth best score so far.

Shards hold whole strata, neighbours in m, and parts of those that are larger than a shard. A
shard is one row group of the index and one task of a search. A search first visits the most
promising shard of every item, which sets the score that the others must reach.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, staged

#: documents of a shard
SHARD = 8192
#: terms of the items up to which they are sent to the tasks that read the texts; beyond it every term is indexed
SENT = 500_000
#: items of one visit of a shard
BLOCK = 4096
#: weights are in thousandths, impacts in billionths; the normaliser gives length three quarters
SCALE, IMPACT, FLAT, LONG = 1000, 1_000_000_000, 25, 75

#: ASCII other than digits and letters separates terms; A-Z become a-z
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and code points from U+0080, A-Z lower-cased."""
    return text.translate(_TERMS).split() if text else []


def term_counts(rows: DataFrame, id_col: str, text_col: str, only: frozenset[bytes] | None = None) -> DataFrame:
    """(id, n, terms, tfs) of every row with a term: n counts all its terms, the arrays only those asked for."""
    spark = rows.sparkSession
    asked = spark.sparkContext.broadcast(only) if only is not None else None  # at most SENT terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = asked.value if asked else None
        for batch in batches:
            ids, sizes, names, tfs, ends = [], [], [], [], [0]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                own = Counter(found) if known is None else Counter(filter(known.__contains__, found))
                ids.append(i)
                sizes.append(len(found))
                names.extend(own.keys())
                tfs.extend(own.values())
                ends.append(len(names))
            at = pa.array(ends, pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(names, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    cols = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(count, "id long, n long, terms array<string>, tfs array<long>")


class Index:
    """shards: one row a stratum and shard; weights: (term, df, w); bounds: (shard, term, impact), the most that one occurrence of the term in an item adds, over w."""

    def __init__(self, shards: DataFrame, weights: DataFrame, bounds: DataFrame):
        self.shards, self.weights, self.bounds = shards, weights, bounds


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[bytes] | None = None) -> Index:
    """Index every document; with `only`, postings are kept for those terms alone (counts are still over all)."""
    counted = staged(term_counts(docs, id_col, text_col, only), "counted")
    r = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    docs_n, length = r["docs"], r["length"] or 1
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(SCALE * F.log((F.lit(2.0 * docs_n) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = staged(held.withColumn("w", w), "weights")
    # strata in order of m; those over a shard's size are cut by a hash of the document
    m = F.expr(f"{FLAT} + ({LONG} * n * {docs_n}L) div {length}L")
    lengths = counted.groupBy("n").agg(F.count("*").alias("docs"))
    strata = lengths.withColumn("m", m).groupBy("m").agg(F.sum("docs").alias("docs"))
    before = F.coalesce(F.sum("docs").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per length
    placed = strata.withColumn("first", F.floor(before / SHARD)).withColumn("parts", F.ceil(F.col("docs") / SHARD))
    shard = (F.col("first") + F.pmod(F.xxhash64("id", "n"), F.col("parts"))).cast("int")
    rows = counted.withColumn("m", m).join(placed.select("m", "first", "parts"), "m").select(shard.alias("shard"), "m", "id", "terms", "tfs")
    shards = staged(rows.groupBy("shard").applyInArrow(_strata, "shard int, m long, docs array<long>, terms array<string>, starts array<long>, tfs array<long>, places array<int>"), "shards")
    # a term's postings lie by falling tf, so its first has the largest
    most = F.transform(F.slice("starts", 1, F.size("terms")), lambda s: F.get("tfs", s.cast("int")))
    heads = shards.select("shard", "m", "terms", most.alias("most")).select("shard", "m", F.explode(F.arrays_zip("terms", "most")).alias("t"))
    heads = heads.select("shard", "m", F.col("t.terms").alias("term"), F.col("t.most").alias("tf"))
    impact = F.expr(f"({IMPACT} * tf) div ({SCALE} * tf + 8 * m)")
    return Index(shards, weights, staged(heads.groupBy("shard", "term").agg(F.max(impact).alias("impact")), "bounds"))


def _strata(table: pa.Table) -> pa.Table:
    """The documents of one shard as strata: ids, and postings by term and falling tf (starts: where a term's begin; places: in ids)."""
    out: list[list] = [[] for _ in range(7)]
    if not table.num_rows:
        return pa.table([pa.array(c, t) for c, t in zip(out, _KINDS)], names=_NAMES)
    table = table.sort_by([("m", "ascending"), ("id", "ascending")])
    m = table.column("m").to_numpy()
    for a, b in zip(*_edges(m)):
        part = table.slice(a, b - a)
        lists = part.column("terms").combine_chunks()
        names = lists.flatten().dictionary_encode()
        tf = part.column("tfs").combine_chunks().flatten().to_numpy()
        place = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
        code = names.indices.to_numpy()
        order = np.lexsort((place, -tf, code))
        starts = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
        row = (table.column("shard")[a].as_py(), int(m[a]), part.column("id").to_pylist(), names.dictionary.to_pylist(), starts, tf[order], place[order].astype(np.int32))
        for column, v in zip(out, row):
            column.append(v)
    return pa.table([pa.array(c, t) for c, t in zip(out, _KINDS)], names=_NAMES)


_NAMES = ["shard", "m", "docs", "terms", "starts", "tfs", "places"]
_KINDS = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _edges(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    starts = np.flatnonzero(np.diff(sorted_values, prepend=sorted_values[0] - 1))
    return starts, np.append(starts[1:], len(sorted_values))


class Shard:
    """The strata of one shard, postings of all of them by term."""

    def __init__(self, table: pa.Table):
        columns = {n: table.column(n).combine_chunks() for n in _NAMES[1:]}
        m = columns["m"].to_numpy()
        sizes = columns["docs"].value_lengths().to_numpy().astype(np.int64)
        ids = columns["docs"].flatten()
        self.docs = ids.fill_null(NO_ID).to_numpy().astype(np.int64)
        self.stratum = np.repeat(np.arange(len(m)), sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        names = columns["terms"].flatten().dictionary_encode()
        self.code = {t: k for k, t in enumerate(names.dictionary.to_pylist())}
        n_terms = columns["terms"].value_lengths().to_numpy()
        counts = np.concatenate([np.diff(s) for s in columns["starts"].to_pylist()]) if len(m) else np.zeros(0, np.int64)
        stratum_of = np.repeat(np.arange(len(m)), n_terms)
        code = np.repeat(names.indices.to_numpy(), counts)
        at = np.repeat(stratum_of, counts)
        tf = columns["tfs"].flatten().to_numpy().astype(np.int64)
        # one division for every tf of a stratum
        pair, own = np.unique(np.stack([m[at], tf]), axis=1, return_inverse=True)
        impact = (IMPACT * pair[1]) // (SCALE * pair[1] + 8 * pair[0]) if len(tf) else np.zeros(0, np.int64)
        impact = impact[own.ravel()]
        place = columns["places"].flatten().to_numpy() + self.first[at]
        order = np.argsort(code, kind="stable")  # by term, then stratum, then falling tf
        self.impact, self.place, self.at = impact[order], place[order], at[order]
        self.ends = np.searchsorted(code[order], np.arange(len(self.code) + 1))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(code[order]) != 0) | (np.diff(self.at) != 0)
        self.heads = np.flatnonzero(new)  # the largest tf of a term in a stratum
        self.head_ends = np.searchsorted(self.heads, self.ends)
        self.n_strata = len(m)

    def search(self, wanted: list[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents of at least this score, from (term, weight in the item)."""
        known = [(self.code[t], w) for t, w in wanted if t in self.code and w]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        heads = np.concatenate([self.heads[self.head_ends[c] : self.head_ends[c + 1]] for c, _ in known])
        weight = np.repeat([w for _, w in known], [self.head_ends[c + 1] - self.head_ends[c] for c, _ in known])
        bound = np.zeros(self.n_strata, np.int64)
        np.add.at(bound, self.at[heads], weight * self.impact[heads])
        at = np.concatenate([np.arange(self.ends[c], self.ends[c + 1]) for c, _ in known])
        weight = np.repeat([w for _, w in known], [self.ends[c + 1] - self.ends[c] for c, _ in known])
        stratum = self.at[at]
        order = np.argsort(-bound, kind="stable")
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, step = 0, 8
        while done < len(order) and bound[order[done]] >= max(least, 1):
            visit = np.zeros(self.n_strata, bool)
            some = order[done : done + step]
            visit[some[bound[some] >= max(least, 1)]] = True
            mine = at[visit[stratum]]
            total = np.zeros(len(self.docs), np.int64)
            np.add.at(total, self.place[mine], weight[visit[stratum]] * self.impact[mine])
            hit = np.flatnonzero(total >= max(least, 1))
            docs, scores = np.concatenate([docs, self.docs[hit]]), np.concatenate([scores, total[hit]])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                least = max(least, int(scores[-1]))
            done, step = done + step, step * 4
        return docs, scores


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank, doc_id, score (item and document columns under these names).

    Scores are above 0; equal ones go to the smaller doc_id. Every row of items is an item, so a
    repeated id has its results twice; items without terms, or whose terms no document holds, have
    none.
    """
    asked = staged(term_counts(items, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "items")
    each = asked.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    each = staged(each.join(index.weights, "term").select("item", "term", (F.col("times") * F.col("w")).alias("weight")).filter("weight > 0"), "asked")
    whole = each.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("ws"))
    bounds = each.join(index.bounds, "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("impact")).alias("bound"))
    ranked = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    bounds = staged(bounds.withColumn("turn", ranked), "visits")

    def visits(chosen: DataFrame) -> DataFrame:
        """Results of the (item, shard, least) chosen."""
        full = chosen.join(whole, "item").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
        both = full.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block"))
        return both.applyInArrow(_visit(k), "item long, id long, score long")

    blocks = max(1, -(-asked.count() // BLOCK))
    spread = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = staged(visits(bounds.filter("turn = 1").select("item", "shard", F.lit(1).cast("long").alias("least"))), "first")
    reached = first.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
    rest = bounds.filter("turn > 1").join(reached, "item", "left").withColumn("least", F.coalesce("reached", F.lit(1)).cast("long"))
    further = visits(rest.filter(F.col("bound") >= F.col("least")).select("item", "shard", "least"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    top = first.unionByName(further).withColumn("rank", best).filter(F.col("rank") <= k)
    doc = F.when(F.col("top.id") != NO_ID, F.col("top.id"))
    return top.alias("top").join(asked.select("item", F.col("id").alias("item_id")), "item").select("item_id", "rank", doc.alias("doc_id"), "score")


def _visit(k: int):
    def run(_, chosen: pa.Table, strata: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if chosen.num_rows and strata.num_rows:
            shard = Shard(strata)
            for item, least, names, ws in zip(*(chosen.column(c).to_pylist() for c in ("item", "least", "terms", "ws"))):
                docs, scores = shard.search(list(zip(names, ws)), k, least)
                for column, v in zip(out, ([item] * len(docs), docs.tolist(), scores.tolist())):
                    column.extend(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["item", "id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of every item, over all documents: item_id, rank, doc_id, score.

    Terms are runs of digits, letters and code points from U+0080, only A-Z lower-cased; null and
    empty texts have none and count nowhere. A null doc_id sorts last among equal scores; rows
    that repeat an id are documents of their own. Empty tables give an empty result. Of both
    tables only the named columns are read.
    """
    named = term_counts(items, item_id, item_text).select(F.explode("terms").alias("term")).distinct().limit(SENT + 1).toArrow()["term"].to_pylist()
    only = frozenset(t.encode() for t in named) if len(named) <= SENT else None
    return search(build(docs, doc_id, doc_text, only), items, k, item_id, item_text)
