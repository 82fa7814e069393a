"""Quality rules with DataFrame functions only: base counts and divergence from language references."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import staged, whole_text, word_list

#: each class is counted on the words of a text; the rest of the code points are the last class
CLASSES = {"vowel": "aeiou", "consonant": "b-df-hj-np-tv-z", "upper": "A-Z", "digit": "0-9", "other": r"^\x00-\x7F"}
SYMBOLS = "[#*$%&|<>]"
#: slots of the word table; a power of two well over its words
SLOTS = 4096
#: languages whose references are literals of a plan; more are joined, with the same results
HELD = 200


def _count(text: Column, chars: str) -> Column:
    """Code points of text in a character class."""
    negated = chars[1:] if chars.startswith("^") else "^" + chars
    return F.char_length(F.regexp_replace(text, f"[{negated}]+", ""))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the words as __words and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words, text = F.col("__words"), whole_text(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    n = F.size("__words")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    # windows in order of their hash: equal ones are neighbours; only texts with equal ones are sorted
    windows = F.when(
        F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
        F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    twice = F.filter(
        F.transform(
            F.col("__windows"),
            lambda x, k: F.when(
                x["h"].eqNullSafe(F.get(F.col("__windows"), k - 1)["h"]) | x["h"].eqNullSafe(F.get(F.col("__windows"), k + 1)["h"]),
                x["i"],
            ),
        ),
        lambda x: x.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    return (
        docs.withColumn("__words", word_list(text))
        .withColumn("__hashes", F.when(n >= 3, hashes))
        .withColumn("__windows", windows)
        .withColumn("__lines", lines)
        .withColumns(
            {
                "n_words": n.cast("long"),
                "__joined": F.array_join("__words", ""),
                "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_repeat_words": F.when(F.col("__windows").isNotNull(), covered).otherwise(0).cast("long"),
            }
        )
        .withColumn("word_chars", F.char_length("__joined").cast("long"))
        .drop("__windows", "__lines", "__hashes")
    )


def _class_counts() -> dict[str, Column]:
    return {f"__c{k}": _count(F.col("__joined"), chars).cast("long") for k, chars in enumerate(CLASSES.values())}


def measured(docs: DataFrame, text_col: str = "text", with_text: bool = True, max_len: int = 5) -> DataFrame:
    """Everything that a verdict needs of a text, in one pass over it, staged: base counts, class counts (__c0, ...) and the words of at most max_len code points (__short)."""
    short = F.filter("__words", lambda w: F.char_length(w) <= max_len)
    out = base_counts(docs, text_col).withColumns({**_class_counts(), "__short": short}).drop("__words", "__joined")
    return staged(out if with_text else out.drop(text_col), "measured")


def language_sums(seen: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(lang, docs, n, c0, ...): documents, code points in words and class counts of every language with any words."""
    sums = seen.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang"))
    return sums.agg(F.count("*").alias("docs"), F.sum("word_chars").alias("n"), *[F.sum(f"__c{k}").alias(f"c{k}") for k in range(len(CLASSES))]).filter(F.col("n") > 0)


def common_words(seen: DataFrame, lang_col: str = "lang", top: int = 40) -> DataFrame:
    """(lang, word, n): the `top` commonest short words of every language."""
    counts = seen.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode("__short").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("r", rank).filter(F.col("r") <= top).drop("r")


def references(sums: DataFrame, words: DataFrame, most: int = 200) -> dict:
    """Histograms of the `most` commonest languages: character classes and common words; what the driver holds is bounded."""
    rows = sums.orderBy(F.desc("docs"), "lang").limit(most).collect()
    if not rows:
        return {"langs": [], "words": [], "char": [], "word": []}
    langs = sorted(r["lang"] for r in rows)
    by = {r["lang"]: r for r in rows}
    char = [[by[x][f"c{k}"] / by[x]["n"] for k in range(len(CLASSES))] for x in langs]
    char = [row + [max(0.0, 1.0 - sum(row))] for row in char]
    found = words.filter(F.col("lang").isin(langs)).collect()  # at most 40 a language
    names = sorted({r["word"] for r in found})
    at = {w: i for i, w in enumerate(names)}
    word = [[0.0] * len(names) for _ in langs]
    for r in found:
        word[langs.index(r["lang"])][at[r["word"]]] = float(r["n"])
    word = [[x / max(1.0, sum(row)) for x in row] for row in word]
    return {"langs": langs, "words": names, "char": char, "word": word}


def _literal(value, kind: T.DataType) -> Column:
    """A constant of any shape; the optimizer folds it once."""
    return F.get(F.from_json(F.lit(json.dumps([value])), T.ArrayType(kind)), F.lit(0))


def _term(p: Column, q: Column) -> Column:
    """One outcome's share of the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def _shares() -> list[Column]:
    """A text's share of every character class, the rest last."""
    own = [F.col(f"__c{i}") / F.col("word_chars") for i in range(len(CLASSES))]
    return [*own, F.greatest(F.lit(0.0), F.lit(1.0) - sum(own[1:], own[0]))]


def divergence(seen: DataFrame, ref: dict) -> DataFrame:
    """Add char_distance, word_distance and n_common: the least Jensen-Shannon distance (0 to 1) to a language's histograms.

    seen comes from `measured`. Distances are null where there is nothing to compare: no
    reference, or a text without words (for word_distance: without any reference word).
    """
    if not ref["langs"]:
        return seen.withColumns({"char_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double"), "n_common": F.lit(0).cast("long")})
    doubles = T.ArrayType(T.DoubleType())
    # a transform over the references: spelled out, 200 languages would be too long an expression
    chars = _literal(ref["char"], T.ArrayType(doubles))
    nearest = F.array_min(F.transform(chars, lambda row: sum((_term(p, F.get(row, F.lit(i))) for i, p in enumerate(_shares())), F.lit(0.0))))
    out = seen.withColumn("char_distance", F.when(F.col("word_chars") > 0, F.sqrt(F.greatest(F.lit(0.0), nearest))))

    # the reference words by slot of their hash: a look-up costs one hash and a short list
    spark = seen.sparkSession
    hashed = spark.createDataFrame([(w, i) for i, w in enumerate(ref["words"])], "w string, i int").select("w", "i", F.pmod(F.xxhash64("w"), F.lit(SLOTS)).cast("int").alias("s")).collect()
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for r in hashed:
        slots[r["s"]][r["w"]] = r["i"]
    look = _literal(slots, T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))
    ids = F.transform("__short", lambda w: F.element_at(F.get(look, F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")), w))
    # sorted ids: a run's length is the place of the next run less its own
    kinds = F.array_distinct("__ids")
    ends = F.concat(F.slice("__starts", 2, F.greatest(F.size("__starts") - 1, F.lit(0))), F.array((F.size("__ids") + 1).cast("long")))
    pairs = F.zip_with(F.zip_with("__starts", ends, lambda a, b: (b - a) / F.size("__ids")), F.array_distinct("__ids"), lambda p, i: F.struct(i.alias("i"), p.alias("p")))

    def distance(row: Column) -> Column:
        # words of a reference that the text lacks add q / 2 each
        present = F.aggregate("__pairs", F.lit(0.0), lambda acc, x: acc + _term(x["p"], F.get(row, x["i"])) - F.get(row, x["i"]) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), present + 0.5))

    rows = _literal(ref["word"], T.ArrayType(doubles))
    return (
        out.withColumn("__ids", F.sort_array(F.array_compact(ids)))
        .withColumn("__starts", F.transform(kinds, lambda i: F.array_position("__ids", i)))
        .withColumn("__pairs", pairs)
        .withColumn("n_common", F.size("__ids").cast("long"))
        .withColumn("word_distance", F.when(F.col("n_common") > 0, F.array_min(F.transform(rows, distance))))
        .drop("__ids", "__starts", "__pairs")
    )


def own_divergence(seen: DataFrame, sums: DataFrame, words: DataFrame, lang_col: str) -> DataFrame:
    """divergence to the reference of a document's own language, by joins on the language: for languages beyond those that the driver holds."""
    row = seen.withColumn("__row", F.monotonically_increasing_id())
    total = Window.partitionBy("lang")
    q = [F.col(f"__q{k}") / F.col("__n") for k in range(len(CLASSES))]
    q = [*q, F.greatest(F.lit(0.0), F.lit(1.0) - sum(q[1:], q[0]))]
    chars = sum((_term(p, x) for p, x in zip(_shares(), q)), F.lit(0.0))
    named = sums.select(F.col("lang").alias("__lang"), F.col("n").alias("__n"), *[F.col(f"c{k}").alias(f"__q{k}") for k in range(len(CLASSES))])
    out = row.join(named, F.col(lang_col) == F.col("__lang"), "left")
    out = out.withColumn("char_distance", F.when(F.col("word_chars") > 0, F.sqrt(F.greatest(F.lit(0.0), chars))))
    ref = words.withColumn("q", F.col("n") / F.sum("n").over(total)).select(F.col("lang").alias("__lang"), "word", "q")
    held = row.select("__row", F.col(lang_col).alias("__lang"), F.explode("__short").alias("word")).groupBy("__row", "__lang", "word").agg(F.count("*").alias("k"))
    met = held.join(ref, ["__lang", "word"])
    share = F.col("k") / F.sum("k").over(Window.partitionBy("__row"))
    met = met.withColumn("d", _term(share, F.col("q")) - F.col("q") / 2).groupBy("__row").agg(F.sum("d").alias("d"), F.sum("k").alias("n_common"))
    out = out.join(met, "__row", "left").withColumns({"word_distance": F.sqrt(F.greatest(F.lit(0.0), F.col("d") + 0.5)), "n_common": F.coalesce("n_common", F.lit(0)).cast("long")})
    return out.drop("__row", "__lang", "__n", "d", *[f"__q{k}" for k in range(len(CLASSES))])


def every_divergence(seen: DataFrame, sums: DataFrame, words: DataFrame) -> DataFrame:
    """divergence to the nearest of all languages by joins, for more languages than a plan should hold.

    A language that shares no word with a text is at the distance 1, so the least word distance
    comes from the languages that share one: they meet the text by the word.
    """
    row = staged(seen.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    q = [F.col(f"c{k}") / F.col("n") for k in range(len(CLASSES))]
    q = [*q, F.greatest(F.lit(0.0), F.lit(1.0) - sum(q[1:], q[0]))]
    blocks = sums.select(F.pmod(F.xxhash64("lang"), F.lit(-(-sums.count() // HELD))).alias("b"), F.array(*q).alias("q")).groupBy("b").agg(F.collect_list("q").alias("__refs")).drop("b")
    each = F.transform("__refs", lambda r: sum((_term(p, F.get(r, F.lit(i))) for i, p in enumerate(_shares())), F.lit(0.0)))
    chars = row.filter("word_chars > 0").select("__row", "word_chars", *[f"__c{k}" for k in range(len(CLASSES))]).crossJoin(blocks)
    chars = chars.select("__row", F.array_min(each).alias("d")).groupBy("__row").agg(F.sqrt(F.greatest(F.lit(0.0), F.min("d"))).alias("char_distance"))
    ref = words.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).select("lang", "word", "q")
    held = row.select("__row", F.explode("__short").alias("word")).groupBy("__row", "word").agg(F.count("*").alias("k"))
    held = held.join(ref.select("word").distinct(), "word", "left_semi").withColumn("n_common", F.sum("k").over(Window.partitionBy("__row")))
    p = F.col("k") / F.col("n_common")
    near = held.join(ref, "word").groupBy("__row", "lang").agg(F.sum(_term(p, F.col("q")) - (p + F.col("q")) / 2).alias("d"), F.max("n_common").alias("n_common"))
    near = near.groupBy("__row").agg(F.sqrt(F.greatest(F.lit(0.0), F.min("d") + 1)).alias("word_distance"), F.max("n_common").alias("n_common"))
    out = row.join(chars, "__row", "left").join(near, "__row", "left").withColumn("n_common", F.coalesce("n_common", F.lit(0)).cast("long"))
    return out.select(*seen.columns, "char_distance", "n_common", "word_distance")


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_char_distance: float = 0.29,
    max_word_distance: float = 0.95,
    guard_chars: int = 200,
    guard_common: int = 30,
    with_text: bool = True,
    most: int | None = None,
) -> DataFrame:
    """Base rules and divergence rules for every document; the columns of docs plus the counts, distances and verdicts.

    base_failed: under min_words words, or over max_repeat_percent of the words lie in three-word
    windows found twice or more. kept: not base_failed, and neither distance to the nearest
    language reference is over its limit. The limits bind only behind minimum lengths: guard_chars
    code points in words for the characters, guard_common common words for the words; shorter
    texts keep the base verdict. Every language of the table has a reference, and every document is
    compared with all of them; with `most`, only the `most` commonest are, and any other with the
    documents of its own language. A null or empty text has no words and fails. Documents without a language are judged like all others but
    are not part of the references. Columns of docs with the names of results are replaced;
    without with_text the text is left out of the result.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "n_common", "base_failed", "kept"]
    plain = docs.drop(*[c for c in made if c in docs.columns])
    seen = measured(plain, text_col, with_text)
    sums = staged(language_sums(seen, lang_col), "language_sums")
    words = staged(common_words(seen, lang_col), "common_words")
    n = sums.count()
    if most is None and n > HELD:
        out = every_divergence(seen, sums, words)
    elif most is None or not n:
        out = divergence(seen, references(sums, words, HELD))
    else:
        ref = references(sums, words, most)
        known = F.col(lang_col).isNull() | F.col(lang_col).isin(ref["langs"])
        out = divergence(seen.filter(known), ref)
        if n > len(ref["langs"]):
            far_langs = ~F.col("lang").isin(ref["langs"])
            out = out.unionByName(own_divergence(seen.filter(~known), sums.filter(far_langs), words.filter(far_langs), lang_col))
        else:
            out = out.unionByName(divergence(seen.filter(~known), ref))  # languages whose texts have no words
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    far = ((F.col("word_chars") >= guard_chars) & (F.col("char_distance") > max_char_distance)) | ((F.col("n_common") >= guard_common) & (F.col("word_distance") > max_word_distance))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False))).drop("__short", *[f"__c{k}" for k in range(len(CLASSES))])
