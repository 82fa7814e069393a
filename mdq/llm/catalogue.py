"""The registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, line_dedup, mixing, packing, quality, retrieval, simhash, spelling, substring_dedup, suffix_dedup, warc
from .common import table, whole_text, word_list

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def sha(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)


@query
def op1_warc(spark, sf_dir):
    """Pages written as WARC archives, repeated payloads as revisits, and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


_SQL["op1_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to, true AS payload_ok FROM f"""


@query
def op2_suffix_dedup(spark, sf_dir):
    """Bytes covered by 400-byte strings that occur elsewhere, cut."""
    out = suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_packing(spark, sf_dir):
    """Token pieces of all documents packed into sequences of at most 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op4_bpe(spark, sf_dir):
    """Byte-level BPE ids of all documents, and what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.little_endian(F.col("ids"), len(ranks)), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


@query
def op7_line_dedup(spark, sf_dir):
    """Lines found in two or more documents, dropped from all but the first."""
    out = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", sha("text").alias("kept_sha256"))


_SQL["op7_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, coalesce(s.first <> k.doc_id, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@query
def op8_quality_rules(spark, sf_dir):
    """Base quality counts and the verdict by divergence from the language references."""
    out = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


@query
def op5_substring_dedup(spark, sf_dir):
    """Words covered by 35-word windows that occur elsewhere, cut."""
    out = substring_dedup.drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(word_list(whole_text()), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


_SQL["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents)),
v AS (SELECT doc_id, pos, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT md5(win) AS win FROM v WHERE n = 35 GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT v.doc_id, v.pos, v.n = 35 AND r.win IS NOT NULL AS hit FROM v LEFT JOIN r ON md5(v.win) = r.win),
c AS (SELECT doc_id, pos, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h)
SELECT d.doc_id, count(w.pos) AS n_words, count(*) FILTER (c.gone) AS n_removed,
 sha256(coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (NOT c.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN c USING (doc_id, pos) GROUP BY d.doc_id"""


@query
def op6_simhash(spark, sf_dir):
    """SimHash fingerprints and the groups of documents linked at 3 or fewer differing bits."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op9_ann(spark, sf_dir):
    """The five nearest vectors of every fiftieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_language_id(spark, sf_dir):
    """The language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", (langid.fold_of(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@query
def op11_mixing(spark, sf_dir):
    """Copies of every document that bring the sources to their shares of all words."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op12_spelling(spark, sf_dir):
    """Words of all documents, their near words, forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_retrieval(spark, sf_dir):
    """The ten highest-scoring documents of every benchmark item."""
    return retrieval.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL["op13_retrieval"] = r"""
WITH lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM lowered),
s AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM s),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM s) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM c JOIN w USING (term) JOIN t USING (term), g GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""


@query
def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
