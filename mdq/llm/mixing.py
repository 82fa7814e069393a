"""Mixing sources to target token counts by entropy balancing.

Among all document rates that give a source its target, entropy balancing takes those nearest to
one copy each in relative entropy: rate = exp(x * size), at most the largest number of copies. The
multiplier x of a source maximises a concave dual; its Newton steps need two sums over the
source's documents, which a job over the histogram of (source, size) gives for all sources at once.
Rates become copies by carrying fractions from the longest sizes to the shortest, so a source
misses its target by at most half of its longest document.

All sums are over whole numbers (rates are rounded to 2^-20 before they are added), so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, whole_text

#: weights of the sources in their order, repeating
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: rates are whole multiples of this
UNIT = 1 << 20
#: documents of one cell whose extra copies one task deals out
CELL = 20_000
_BIG = "decimal(38,0)"


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size) of every row, in words between ASCII white space; staged."""
    words = F.regexp_count(whole_text(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"))
    return staged(rows, "sizes")


def numbered(sources: DataFrame) -> DataFrame:
    """Add k, the place from 0 in order of code points, null last: parts sorted by range, then the parts' counts in front of each."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
    starts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = rows.join(starts, part == F.col("part"))
    return placed.withColumn("k", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "n", "start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, k, source_size, squares, weight, target) of every source.

    Sources share the total of all sizes by weight. A target stops at `most` times its source's
    size, and what is over goes to the others by weight, until none is above.
    """
    size = F.col("size")
    sums = sizes.groupBy("source").agg(F.sum(size).alias("source_size"), F.sum((size * size).cast(_BIG)).alias("squares"))
    placed = numbered(sums).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("k", F.lit(len(weights))).cast("int")).cast("long"))
    rows = staged(placed.withColumn("cap", most * F.col("source_size")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    shared, weight = total, None
    while True:  # every round but the last stops further sources
        if weight is None:
            stopped = F.col("cap") == 0
        else:
            stopped = F.col("cap").cast(_BIG) * F.lit(weight).cast(_BIG) <= F.col("weight").cast(_BIG) * F.lit(shared).cast(_BIG)
        r = rows.agg(F.sum(F.when(stopped, F.col("cap"))).alias("c"), F.sum(F.when(~stopped, F.col("weight"))).alias("w")).first()
        now = (total - (r["c"] or 0), r["w"] or 0)
        if now == (shared, weight) or not now[1]:
            break
        shared, weight = now
    share = F.col("weight").cast("double") * F.lit(float(shared)) / F.lit(float(weight or 1))
    return rows.withColumn("target", F.when(stopped, F.col("cap").cast("double")).otherwise(share)).drop("cap")


def rate(multiplier: Column, x: Column, most: int) -> Column:
    """The tilted rate, in whole units."""
    return F.least(F.lit(most * UNIT), F.floor(F.exp(F.least(multiplier * x, F.lit(5.0))) * UNIT)).cast("long")


def multipliers(cells: DataFrame, wanted: DataFrame, most: int = MOST_COPIES, rounds: int = 60) -> DataFrame:
    """(k, multiplier) of the sources: Newton steps on the dual, halved intervals where a step leaves the bracket.

    cells: (k, size, x, docs); wanted: (k, target, least), least being the smallest x over 0. A
    source is done when its rates give its target up to a ten-thousandth or its bracket is closed.
    """
    end = F.log(F.lit(float(most))) / F.col("least") + 1e-6  # from there on every rate is `most`
    state = staged(wanted.select("k", "target", F.lit(0.0).alias("m"), F.lit(-1e3).alias("lo"), end.alias("hi"), F.lit(False).alias("done")), "dual")
    for _ in range(rounds):
        live = state.filter(~F.col("done"))
        r = rate(F.col("m"), F.col("x"), most)
        words = (F.col("docs") * F.col("size")).cast(_BIG) * r.cast(_BIG)
        slope = F.floor(F.when(r < most * UNIT, F.col("docs") * F.col("size") * F.col("x") * r / UNIT).otherwise(0.0) * 16).cast(_BIG)
        sums = cells.join(live.select("k", "m"), "k").groupBy("k").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        gap = F.col("words").cast("double") / UNIT - F.col("target")
        near = F.abs(gap) <= F.col("target") * 1e-4
        lo, hi = F.when(gap < 0, F.col("m")).otherwise(F.col("lo")), F.when(gap > 0, F.col("m")).otherwise(F.col("hi"))
        step = F.col("m") - gap * 16 / F.col("slope").cast("double")
        moved = live.join(sums, "k").select("k", "target", "m", lo.alias("lo"), hi.alias("hi"), near.alias("near"), F.when(F.col("slope") > 0, step).alias("step"))
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        closed = F.col("hi") - F.col("lo") <= 1e-12
        to = F.when(F.col("near") | closed, F.col("m")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = staged(moved.select("k", "target", to.alias("m"), "lo", "hi", (F.col("near") | closed).alias("done")).unionByName(state.filter("done")), "dual")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("k", F.col("m").alias("multiplier"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of every document so that sources come near their targets: id_col, size, source_size, target, copies, taken.

    A null text has size 0; documents of size 0 are taken once, as 0 words. Rows without a source
    form one, the last. Every row is a document: null, tied or repeated ids are kept. An empty
    table gives an empty result. Only the three named columns are read.
    """
    own = sizes(docs, id_col, text_col, source_col)
    sources = staged(targets(own, weights, most), "targets")
    named = own.join(sources.select("source", "k", "source_size", "target", "squares"), own["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    # x is the size over the source's mean size, words counting alike; cells over CELL documents are cut by a hash of the id
    x = F.when(F.col("size") > 0, F.col("size") * F.col("source_size").cast("double") / F.col("squares").cast("double")).otherwise(0.0)
    counted = staged(named.groupBy("k", "size", x.alias("x")).agg(F.count("*").alias("docs")), "cells")
    least = counted.filter("x > 0").groupBy("k").agg(F.min("x").alias("least"))
    solved = multipliers(counted.filter("x > 0"), sources.join(least, "k").select("k", "target", "least"), most)
    rated = counted.join(solved, "k", "left").withColumn("rate", F.coalesce(rate(F.col("multiplier"), F.col("x"), most), F.lit(UNIT)))
    cells = staged(rated.select("k", "size", "rate", F.ceil(F.col("docs") / CELL).cast("int").alias("cuts")), "rates")
    rows = named.select("doc_id", "k", "size", "source_size", "target").join(cells, ["k", "size"])
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("cut", F.pmod("h", F.col("cuts")).cast("int"))
    # whole copies for all, and as many extra ones a cell as the carried fractions say
    dealt = rows.groupBy("k", "size", "cut", "rate").agg((F.count("*") * F.pmod("rate", F.lit(UNIT))).cast("long").alias("part"))
    falling = Window.partitionBy("k").orderBy(F.desc("size"), "cut")
    upto = dealt.withColumn("upto", F.floor((F.sum("part").over(falling) + UNIT // 2) / UNIT))
    extra = upto.select("k", "size", "cut", (F.col("upto") - F.lag("upto", 1, 0).over(falling)).alias("extra"))
    place = F.row_number().over(Window.partitionBy("k", "size", "cut").orderBy("h", "doc_id"))
    copies = F.floor(F.col("rate") / UNIT).cast("int") + (F.col("place") <= F.col("extra")).cast("int")
    out = rows.withColumn("place", place).join(extra, ["k", "size", "cut"]).withColumn("copies", copies)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
