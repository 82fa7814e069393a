"""Line dedup with DataFrame functions only: explode normalised lines, hash, count documents, drop, reassemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SPACES, ascii_lower, hash128, whole_text


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Remove lines whose key is found in at least min_docs documents, except in the smallest id that holds it.

    A key is the line without ASCII white space at its ends and with A-Z lower-cased; keys under
    min_chars code points are left alone. Returns the columns of docs with the text replaced by
    the kept lines joined by a line feed, plus n_lines (before) and n_dropped. A null text is one
    empty line and becomes an empty text. Rows with one id count as one document; rows without an
    id count together as one document after all others. Repeated rows each return their own result.
    Columns of docs named n_lines or n_dropped are replaced.

    Hot lines: a key is first counted once per document, on (key, id), so a line that a third of
    all documents hold is spread over them; the join back relies on Spark's skewed-join splitting.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"),
        F.xxhash64(whole_text(text_col)).alias("__text"),
        F.posexplode(F.split(whole_text(text_col), "\n", -1)).alias("__pos", "__line"),
    ).withColumn("__key", ascii_lower(F.btrim("__line", F.lit(SPACES))))
    h1, h2 = hash128(F.col("__key"))
    keyed = rows.filter(F.char_length("__key") >= min_chars).select("__id", "__text", "__pos", h1.alias("__h1"), h2.alias("__h2"))
    shared = (
        keyed.groupBy("__h1", "__h2", "__id")
        .agg(F.lit(1).alias("__one"))
        .groupBy("__h1", "__h2")
        .agg(F.count("*").alias("__docs"), F.min("__id").alias("__first"))
        .filter(F.col("__docs") >= min_docs)
        .select("__h1", "__h2", "__first")
    )
    dropped = (
        keyed.join(shared, ["__h1", "__h2"])
        .filter(F.col("__id") != F.col("__first"))
        .groupBy("__id", "__text")
        .agg(F.collect_set("__pos").alias("__drop"))
    )
    lines = F.split(whole_text(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.col("__n") - 1), F.col("__drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return (
        docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__text": F.xxhash64(whole_text(text_col))})
        .join(dropped, ["__id", "__text"], "left")
        .withColumns({"__lines": lines})
        .withColumns({"__n": F.size("__lines")})
        .select(
            *[F.when(F.col("__drop").isNull(), whole_text(text_col)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in names],
            F.col("__n").cast("long").alias("n_lines"),
            F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
