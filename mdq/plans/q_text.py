"""Registered queries: posts, headlines, filings, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.core import tidy
from ..session import shared_folder
from ..sources import documents, store
from ..sources.adapters import table
from .inputs import once
from .registry import SQL, cte, query, rounded

# posts written from orders: two symbols per post, digits spelled as letters
_LET = ("0123456789", "BCDFGKLMNQ")
cte(
    "posts",
    """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Pre-market plan' WHEN '2-HIGH' THEN 'After hours list' WHEN '3-MEDIUM' THEN 'Market open list' ELSE 'Daily list' END || ' ' || o_orderkey AS title,
 'X' || translate(CAST(o_custkey % 1000 AS VARCHAR), '0123456789', 'BCDFGKLMNQ') AS t1, 'Z' || translate(CAST(o_orderkey % 1000 AS VARCHAR), '0123456789', 'BCDFGKLMNQ') AS t2,
 CAST(floor(o_totalprice / 100) AS BIGINT) + 10 AS p, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS timestamp, o_orderdate FROM orders""",
)


@once("posts")
def posts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").repartition("o_orderkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Pre-market plan").when(F.col("o_orderpriority") == "2-HIGH", "After hours list").when(F.col("o_orderpriority") == "3-MEDIUM", "Market open list").otherwise("Daily list")
    spell = lambda c: F.translate((F.col(c) % 1000).cast("string"), *_LET)
    p = F.floor(F.col("o_totalprice") / 100) + 10
    line = lambda pre, sym, k: F.concat(F.lit(pre), sym, F.lit(" support "), (p * k).cast("string"), F.lit(".5 resistance "), (p * k + 3).cast("string"), F.lit(".25 target "), (p * k + 9).cast("string"), F.lit(" stop "), (p * k - 2).cast("string"))
    a, b = F.concat(F.lit("X"), spell("o_custkey")), F.concat(F.lit("Z"), spell("o_orderkey"))
    return o.select(
        F.concat(kind, F.lit(" "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(line("$", a, 1), F.lit("\n"), line("$", b, 2)).alias("content"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("timestamp"),
    )


cte(
    "parsed",
    """SELECT title, t1 AS ticker, p + 0.5 AS support, p + 3.25 AS resistance, p + 0.5 AS stop, o_orderdate AS post_ts FROM posts
 UNION ALL SELECT title, t2, 2 * p + 0.5, 2 * p + 3.25, 2 * p + 0.5, o_orderdate FROM posts""",
)
_SESS = "CASE WHEN title LIKE 'Pre%' THEN 'pre_market' WHEN title LIKE 'After%' THEN 'after_hours' WHEN title LIKE 'Market%' THEN 'market_open' ELSE 'unknown' END"


@query("post_entries", rounded("title ticker session post_ts", "support resistance stop", f"SELECT *, {_SESS} AS session FROM parsed", 4))
def q_posts(spark, sf_dir):
    e = text.parse_posts(posts(spark, sf_dir)).withColumn("post_ts", F.col("post_ts").cast("timestamp_ntz"))
    return tidy(e, ["title", "ticker", "session", "post_ts"], ["support", "resistance", "stop"], 4)


@query("post_tickers", "SELECT DISTINCT ticker FROM parsed")
def q_tickers(spark, sf_dir):
    t = text.tickers(F.concat_ws("\n", "title", "content"))
    return posts(spark, sf_dir).select(F.explode(t).alias("ticker")).distinct()


@query("post_sessions", f"SELECT {_SESS} AS session, count(*) AS n FROM posts GROUP BY 1")
def q_sessions(spark, sf_dir):
    return posts(spark, sf_dir).groupBy(text.session(F.concat_ws("\n", "title", "content")).alias("session")).agg(F.count("*").alias("n"))


@query("latest_day_posts", "SELECT title, timestamp FROM posts WHERE o_orderdate = (SELECT max(o_orderdate) FROM posts) AND title LIKE 'Pre%' OR (o_orderdate = (SELECT max(o_orderdate) FROM posts) AND NOT EXISTS (SELECT 1 FROM posts WHERE o_orderdate = (SELECT max(o_orderdate) FROM posts) AND title LIKE 'Pre%'))")
def q_latest(spark, sf_dir):
    p = posts(spark, sf_dir).withColumn("hit", F.col("title").rlike("^Pre").cast("int"))
    last = p.agg(F.max("timestamp").alias("last"))
    day = p.join(F.broadcast(last), F.col("timestamp") == F.col("last"))
    any_ = day.agg(F.max("hit").alias("any"))
    return day.join(F.broadcast(any_)).where("hit = any").select("title", "timestamp")


@query("append_new_posts", "SELECT count(*) AS n FROM posts WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def q_append(spark, sf_dir):
    p = posts(spark, sf_dir).withColumn("key", text.post_key(F.col("title"), F.col("timestamp")))
    return store.insert_new(p.where("timestamp < '2000-01-01'"), p, ["key"]).agg(F.count("*").alias("n"))


@query("symbol_validity", "SELECT DISTINCT ticker FROM parsed WHERE regexp_matches(ticker, '^[A-Z]{2,6}$') AND ticker NOT IN (SELECT t2 FROM posts WHERE id < 50)")
def q_valid(spark, sf_dir):
    t = q_tickers(spark, sf_dir).where(text.valid_symbol(F.col("ticker")))
    banned = table(spark, sf_dir, "orders").where("o_orderkey < 50").select(F.concat(F.lit("Z"), F.translate((F.col("o_orderkey") % 1000).cast("string"), *_LET)).alias("ticker"))
    return t.join(banned, "ticker", "left_anti")


_SENT = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {s} ELSE 0 END" for w, s in text.SENTIMENT.items())


@query("headline_sentiment", f"SELECT doc_id, ({_SENT})::DOUBLE AS score FROM documents")
def q_sentiment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sentiment(F.col("text")).alias("score"))


@query("sentiment_extremes", f"SELECT source, n, score FROM (SELECT source, count(*) AS n, round(sum({_SENT}), 6)::DOUBLE AS score FROM documents GROUP BY 1) WHERE n >= 5 ORDER BY abs(score) DESC, source LIMIT 10")
def q_extremes(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum(text.sentiment(F.col("text"))), 6).alias("score"))
    return g.where("n >= 5").orderBy(F.abs("score").desc(), "source").limit(10)


_FW = " OR ".join(f"contains(lower(d), '{w}')" for w in text.FILING_WORDS)


@query("filing_kinds", f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN form = '8-K' AND ({_FW}) THEN CASE WHEN contains(lower(d), 'at-the-market') OR contains(lower(d), 'atm') THEN 'atm_offering' WHEN contains(lower(d), 'pipe') THEN 'pipe_deal' WHEN contains(lower(d), 'warrant') THEN 'warrant_exercise'
 WHEN contains(lower(d), 'convertible') THEN 'convertible_debt' ELSE 'unknown' END WHEN form = 'S-3' THEN 'shelf_registration' END AS kind FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'S-3' ELSE '8-K' END AS form,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'ATM offering with warrants' WHEN '2-HIGH' THEN 'PIPE closing' WHEN '3-MEDIUM' THEN 'Convertible note issued' ELSE 'Quarterly results' END AS d FROM orders)) WHERE kind IS NOT NULL GROUP BY 1""")
def q_filings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.when(F.col("o_orderpriority") == "1-URGENT", "ATM offering with warrants").when(F.col("o_orderpriority") == "2-HIGH", "PIPE closing").when(F.col("o_orderpriority") == "3-MEDIUM", "Convertible note issued").otherwise("Quarterly results")
    form = F.when(F.col("o_orderstatus") == "O", "S-3").otherwise("8-K")
    return o.select(text.filing_kind(form, d).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query("newest_filings", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE k <= 15")
def q_newest(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return o.withColumn("k", F.row_number().over(w)).where("k <= 15").select("o_custkey", "o_orderkey")


@query("news_dilution_hits", "SELECT doc_id FROM documents WHERE (" + " OR ".join(f"contains(lower(text), '{w}')" for w in text.NEWS_WORDS) + f" OR lang = 'en' AND contains(lower(text), 'peace')) AND ({_SENT}) / 10 < -0.3 OR (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def q_news(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = text.sentiment(F.col("text")) / 10
    hits = d.where(text.news_hit(F.col("text"), s) | ((F.col("lang") == "en") & F.lower("text").contains("peace") & (s < -0.3))).select("doc_id")
    toxic = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
    return hits.union(toxic).distinct()


@query("deduplicated_notes", "SELECT source, arg_max(doc_id, n_chars * 10000000 + doc_id) AS best, count(DISTINCT trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS notes FROM documents GROUP BY 1")
def q_notes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("note", text.note_key(F.col("text")))
    return d.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("best"), F.count_distinct("note").alias("notes"))


@query("facts_latest_value", "SELECT o_custkey AS company, concept, arg_max(val, pref * 1e15 + epoch(o_orderdate) * 1e5 + val / 10) AS val FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'Cash' WHEN 'F' THEN 'Shares' ELSE 'Debt' END AS concept, floor(o_totalprice) AS val, CASE WHEN o_orderpriority IN ('1-URGENT') THEN 1 ELSE 0 END AS pref FROM orders) GROUP BY 1, 2")
def q_facts(spark, sf_dir):
    return text.xbrl_latest(_facts(spark, sf_dir), ["Cash", "Shares", "Debt"], ["1-URGENT"])


def _facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    concept = F.when(F.col("o_orderstatus") == "O", "Cash").when(F.col("o_orderstatus") == "F", "Shares").otherwise("Debt")
    return o.select(F.col("o_custkey").alias("company"), concept.alias("concept"), F.floor("o_totalprice").cast("double").alias("val"), F.col("o_orderdate").alias("end"), F.col("o_orderpriority").alias("form"))


@query("facts_first_available", f"""SELECT company, concept, val FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE concept WHEN 'Shares' THEN 1 WHEN 'Cash' THEN 2 ELSE 3 END) AS k FROM ({SQL["facts_latest_value"]})) WHERE k = 1""")
def q_first(spark, sf_dir):
    return text.first_available(q_facts(spark, sf_dir), ["Shares", "Cash", "Debt"])


@query("dilution_profile", rounded("p_partkey dilution_risk raise_risk", "headroom diluted runway pct_used", """SELECT *, CASE WHEN pct_used > 85 THEN 'high' WHEN pct_used > 70 THEN 'moderate' ELSE 'low' END AS dilution_risk,
 CASE WHEN runway < 6 THEN 'high' WHEN runway < 12 THEN 'moderate' ELSE 'low' END AS raise_risk FROM (SELECT p_partkey, p_retailprice - p_size * 25 AS headroom, p_size * 25 / p_retailprice * 100 AS pct_used,
 p_size * 25 + p_size / 2.0 AS diluted, p_retailprice / (p_size * 100 / 12.0) AS runway FROM part)"""))
def q_profile(spark, sf_dir):
    size = F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", (size * 25).alias("shares"), F.col("p_retailprice").alias("authorized"), (size / 2).alias("warrants"), F.col("p_retailprice").alias("cash"), (size * -100).alias("cash_flow")
    )
    return tidy(text.dilution_profile(p), ["p_partkey", "dilution_risk", "raise_risk"], ["headroom", "diluted", "runway", "pct_used"])


@query("file_stem_dates", "SELECT 'S' || s_suppkey AS ticker, DATE '1998-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS start, DATE '1998-01-01' + CAST(s_suppkey % 300 AS INTEGER) + 5 AS \"end\" FROM supplier")
def q_stem(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("a", F.date_add(F.lit("1998-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")))
    path = F.concat(F.lit("/cache/bars/S"), F.col("s_suppkey").cast("string"), F.lit("_"), F.col("a").cast("string"), F.lit("_"), F.date_add("a", 5).cast("string"), F.lit(".parquet"))
    return s.select(store.window_dates(path).alias("x")).select("x.ticker", "x.start", "x.end")


# ---- documents as JSON text ------------------------------------------------------------

_CONCEPTS = {"O": ("Cash", "USD"), "F": ("CommonStockSharesOutstanding", "shares"), "P": ("LongTermDebt", "USD")}


def _written(df, name):
    """A column of JSON text as text files in the shared folder, one document per line."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/mdq/{spark.sparkContext.applicationId}/{name}"
    df.write.mode("overwrite").text(path)
    return documents.lines(spark, path)


@once("fact_documents")
def fact_documents(spark, sf_dir):
    """A facts document per customer, written from the orders; every fiftieth is cut short."""
    o = table(spark, sf_dir, "orders")
    pick = lambda of, k: F.element_at(F.create_map(*[F.lit(x) for s, v in of.items() for x in (s, v[k])]), F.col("o_orderstatus"))
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").when(F.col("o_orderpriority") == "2-HIGH", "10-Q").otherwise("8-K")
    v = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.floor("o_totalprice").cast("double").alias("val"), form.alias("form"))
    c = o.groupBy("o_custkey", pick(_CONCEPTS, 0).alias("concept"), pick(_CONCEPTS, 1).alias("unit")).agg(F.collect_list(v).alias("values"))
    units = F.struct(F.create_map("unit", "values").alias("units"))
    d = c.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("concept", units))).alias("concepts"))
    doc = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.create_map(F.lit("us-gaap"), "concepts").alias("facts")))
    cut = F.when(F.col("o_custkey") % 50 == 0, F.expr("substring(doc, 1, length(doc) - 7)")).otherwise(F.col("doc"))
    return _written(d.withColumn("doc", doc).select(cut.alias("value")), "fact_documents")


cte(
    "fact_rows",
    """SELECT o_custkey AS company, CASE o_orderstatus WHEN 'O' THEN 'cash' WHEN 'F' THEN 'shares_outstanding' ELSE 'long_term_debt' END AS metric,
 CASE o_orderstatus WHEN 'O' THEN 'Cash' WHEN 'F' THEN 'CommonStockSharesOutstanding' ELSE 'LongTermDebt' END AS concept, floor(o_totalprice) AS val, o_orderdate AS d,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS pref FROM orders WHERE o_custkey % 50 <> 0""",
)


@query("facts_from_documents", "SELECT CAST(company AS VARCHAR) AS company, metric, concept, arg_max(val, (pref, d, val)) AS val, strftime(arg_max(d, (pref, d, val)), '%Y-%m-%d') AS as_of FROM fact_rows GROUP BY 1, 2, 3")
def q_documents(spark, sf_dir):
    return documents.metrics(documents.fact_rows(fact_documents(spark, sf_dir)))


@query("malformed_documents", "SELECT count(DISTINCT o_custkey) AS malformed FROM orders WHERE o_custkey % 50 = 0")
def q_malformed(spark, sf_dir):
    return documents.malformed(fact_documents(spark, sf_dir), documents.FACTS).agg(F.count("*").alias("malformed"))


@query("post_entries_from_documents", rounded("title ticker session post_ts", "support resistance stop", f"SELECT *, {_SESS} AS session FROM parsed", 4))
def q_post_documents(spark, sf_dir):
    """All posts, written as JSON text and read back."""
    feed = posts(spark, sf_dir).select(F.to_json(F.struct("title", "content", "timestamp")).alias("value"))
    e = text.parse_posts(documents.posts(_written(feed, "post_documents"))).withColumn("post_ts", F.col("post_ts").cast("timestamp_ntz"))
    return tidy(e, ["title", "ticker", "session", "post_ts"], ["support", "resistance", "stop"], 4)
