"""Post, headline and filing text as Column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: patterns and keyword lists -----------------------------------------
TICKER = r"\$([A-Z]{1,5})\b|(?<!\w)([A-Z]{2,5})(?=:)"
PRICE = r"\$?(\d{0,5}\.?\d{1,4})\b"
SUPPORT = r"(?i)(support|sppt|sup|floor|hold[s]?|bounce|base|key level|demand)"
RESISTANCE = r"(?i)(resist[ance]*|res|target|tgt|ceiling|r\/r|supply|break[out]*)"
STOP = r"(?i)(stop|sl|cut|invalidat[e]*|below)"
PRE_MARKET = r"(?i)pre[\s\-]?market|pm\b|premarket|before open"
AFTER_HOURS = r"(?i)after[\s\-]?hours?|ah\b|extended hours?|post[\s\-]?market"
MARKET_OPEN = r"(?i)market open|open[ing]?|rth|regular hours?|9:30"
#: the words that most often look like symbols; longer lists are a parameter of the caller
NOT_TICKERS = [
    "THE", "AND", "FOR", "BUT", "NOT", "ARE", "WAS", "HAS", "HAD", "ITS", "ALL", "NEW", "GET", "SET", "WITH", "FROM", "INTO", "OVER",
    "SOME", "THIS", "THAT", "THEN", "ALSO", "WHEN", "WILL", "BOTH", "NEXT", "LAST", "THEM", "THEY", "THEIR", "THAN", "ONLY", "THESE",
    "THOSE", "JUST", "BEEN", "HAVE", "WERE", "DOES", "WHAT", "WHICH", "SUCH", "EACH", "EVEN", "VERY", "MUCH", "MOST", "MANY", "MORE",
    "LESS", "BACK", "TOOK", "MAKE", "MADE", "TAKE", "GIVE", "GAVE", "GOES", "GOING", "COME", "CAME", "KEEP", "KEPT", "TELL", "TOLD", "KNOW",
    "KNEW", "SHOW", "SHOWN", "SAID", "SAYS", "NEED", "NEEDS", "WANT", "WANTS", "FEEL", "FELT", "YOUR", "OUR", "HIS", "HER", "OWN", "MINE",
    "YOU", "HIM", "SHE", "WE", "MY", "ME", "DO", "DID", "DONE", "IS", "IT", "IN", "OF", "TO", "ON", "AT", "BY", "UP", "AS", "IF", "OR",
    "AN", "A", "BUY", "SELL", "STOP", "HOLD", "WATCH", "LONG", "SHORT", "LOOK", "LIKE", "PLAY", "FLAT", "WAIT", "SIDE", "BODY", "HIGH",
    "LOW", "OPEN", "CLOSE", "BREAK", "ABOVE", "BELOW", "LEVEL", "PRICE", "ENTRY", "EXIT", "RISK", "LOSS", "GAIN", "NFA", "DYOR", "DD",
    "IMO", "IMHO", "FWIW", "TBH", "RN", "AH", "PM", "EOD", "EOW", "YTD", "ATH", "ATM", "OTC", "HALT", "EMA", "SMA", "RSI", "ETF", "IPO",
    "SEC", "ADR",
    "RISKS", "MONEY", "LOSE", "HUGE", "SMALL", "LARGE", "GOOD", "GREAT", "BEST", "BULL", "BEAR", "PUSH", "PULL", "PUMP", "DUMP", "MOVE",
    "PRINT", "AFTER", "HOURS", "DAYS", "DAY", "WEEK", "MONTH", "YEAR", "TIME", "CALL", "PUT", "STOCK", "TRADE", "SETUP", "CHART", "NEWS",
    "ALERT", "TOP", "GAP", "RUN", "DIP", "CASH", "VOL", "RED",
]
SENTIMENT = {
    "war": 5.0, "conflict": 5.0, "iran": 5.0, "israel": 5.0, "hormuz": 5.0,
    "well": 2.0, "drilling": 2.0, "bpd": 2.0, "production": 2.0,
    "offering": -3.0, "dilution": -3.0, "warrants": -3.0, "peace": -2.0,
}
FILING_WORDS = [
    "at-the-market", "atm offering", "shelf registration", "registered direct offering", "pipe", "warrant exercise",
    "convertible note", "equity line", "committed equity facility",
]
NEWS_WORDS = ["dilution", "offering", "capital raise", "equity financing", "share issuance", "warrant exercise", "convertible debt"]
#: posts that one task parses
POSTS = 20_000
# ---- end of fixed values --------------------------------------------------------------


def tickers(text: Column, stop_words: list[str] | None = None) -> Column:
    """Symbols in first-seen order; the stop list is a parameter."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TICKER), 0), lambda x: F.ltrim(x, F.lit("$")))
    return F.filter(F.array_distinct(found), lambda x: ~x.isin(stop_words or NOT_TICKERS))


def session(text: Column) -> Column:
    return (
        F.when(text.rlike(PRE_MARKET), "pre_market").when(text.rlike(AFTER_HOURS), "after_hours").when(text.rlike(MARKET_OPEN), "market_open").otherwise("unknown")
    )


def prices(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(PRICE), 1), lambda x: x.try_cast("double"))
    return F.filter(found, lambda x: (x > 0.001) & (x < 100000))


def _windows(text: Column, parts: Column, words: Column, window: int) -> Column:
    """Prices in the window around each keyword match, from the split text and its matches."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["w"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    def found(x):
        left = F.greatest(x["start"] - window, F.lit(0))
        return prices(F.substr(text, left + 1, F.least(x["end"] + window, F.length(text)) - left))

    pairs = F.transform(words, lambda w, i: F.struct(F.get(parts, i).alias("p"), w.alias("w")))
    return F.flatten(F.transform(F.aggregate(pairs, none, add, lambda acc: acc["out"]), found))


def prices_near(text: Column, keyword: str, window: int = 80) -> Column:
    """Prices inside the window around every keyword match, in order of the matches."""
    return _windows(text, F.split(text, keyword), F.regexp_extract_all(text, F.lit(keyword), 1), window)


def with_prices_near(df: DataFrame, text: str, keywords: dict[str, str], window: int = 80) -> DataFrame:
    """prices_near for several keywords; the split text is a column of its own, so it is made once per row."""
    df = df.withColumns({f"_p_{n}": F.split(text, k) for n, k in keywords.items()})
    df = df.withColumns({f"_w_{n}": F.regexp_extract_all(text, F.lit(k), 1) for n, k in keywords.items()})
    df = df.withColumns({n: _windows(F.col(text), F.col(f"_p_{n}"), F.col(f"_w_{n}"), window) for n in keywords})
    return df.drop(*[f"_{x}_{n}" for n in keywords for x in "pw"])


def with_blocks(df: DataFrame) -> DataFrame:
    """One row per (post, symbol) with the post's part from the symbol's line start to the next symbol's.

    Posts that cannot be split keep the whole content for every symbol; a symbol with several
    blocks keeps its last.
    """
    head = F.concat(F.lit(r"(?i)(?:^|\n)\s*\$?("), F.array_join("symbols", "|"), F.lit(r")\b"))
    df = df.withColumn("_marked", F.regexp_replace("content", head, F.lit("\u0001$0")))
    df = df.withColumn("_parts", F.filter(F.split("_marked", "\u0001"), lambda p: p != ""))
    # a part belongs to the symbol it starts with
    first = F.transform("_parts", lambda p: F.struct(F.upper(F.regexp_extract(p, r"^\s*\$?([A-Za-z]+)", 1)).alias("s"), p.alias("t")))
    df = df.withColumn("_parts", F.filter(first, lambda x: F.array_contains("symbols", x["s"])))
    # the outer form, as Spark would find the symbols once more to leave out posts without any
    df = df.withColumn("ticker", F.explode_outer("symbols")).where("ticker is not null")
    mine = F.filter("_parts", lambda x: x["s"] == F.col("ticker"))
    df = df.withColumn("_mine", F.try_element_at(mine, F.lit(-1)))
    block = F.when(F.size("_parts") < 2, F.col("content")).otherwise(F.coalesce("_mine.t", "content"))
    return df.withColumn("block", block).drop("_marked", "_parts", "_mine")


def _spread(posts: DataFrame) -> DataFrame:
    """posts dealt to tasks by their number: they are few bytes but much work each, so tasks by bytes would be few."""
    if posts.isStreaming:
        return posts
    return posts.repartition(max(posts.sparkSession.sparkContext.defaultParallelism, -(-posts.count() // POSTS)))


def parse_posts(posts: DataFrame) -> DataFrame:
    """posts(title, content, timestamp) to one entry row per ticker."""
    text = F.concat_ws("\n", "title", "content")
    p = _spread(posts).withColumns({"symbols": tickers(text), "session": session(text), "post_ts": parse_time(F.col("timestamp"))})
    p = with_blocks(p.select("title", "content", "symbols", "session", "post_ts"))
    p = with_prices_near(p, "block", {"sup": SUPPORT, "res": RESISTANCE, "stp": STOP}).withColumn("all_p", F.array_sort(prices(F.col("block"))))
    median = F.coalesce(F.try_element_at("all_p", (F.floor(F.size("all_p") / 2) + 1).cast("int")), F.lit(0.0))
    p = p.withColumn("median", median)
    first = lambda a: F.try_element_at(a, F.lit(1))
    p = p.withColumn("support", F.coalesce(first(F.filter("sup", lambda x: x < F.col("median"))), first(F.col("sup"))))
    above = F.filter("res", lambda x: F.col("support").isNull() | (x > F.col("support")))
    return p.select(
        "title", "ticker", "session", "post_ts", "support", F.coalesce(first(above), first(F.col("res"))).alias("resistance"), first(F.col("stp")).alias("stop"),
        F.trim(F.substr(F.col("block"), F.lit(1), F.lit(200))).alias("notes"), F.col("block").alias("raw_text"),
    )


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def sentiment(headline: Column) -> Column:
    h, total = F.lower(headline), F.lit(0.0)
    for word, weight in SENTIMENT.items():
        total = total + F.when(h.contains(word), weight).otherwise(0.0)
    return total


def filing_kind(form: Column, description: Column) -> Column:
    """Dilution kind of a filing, null when it is none."""
    d = F.lower(description)
    hit = F.lit(False)
    for w in FILING_WORDS:
        hit = hit | d.contains(w)
    kind = F.when(d.contains("at-the-market") | d.contains("atm"), "atm_offering").when(d.contains("pipe"), "pipe_deal").when(d.contains("warrant"), "warrant_exercise").when(d.contains("convertible"), "convertible_debt").otherwise("unknown")
    return F.when((F.upper(form) == "8-K") & hit, kind).when(F.upper(form) == "S-3", "shelf_registration")


def news_hit(text: Column, score: Column, limit: float = -0.3) -> Column:
    t, hit = F.lower(text), F.lit(False)
    for w in NEWS_WORDS:
        hit = hit | t.contains(w)
    return hit & (score < limit)


def post_key(title: Column, timestamp: Column) -> Column:
    return F.concat_ws("::", title, timestamp)


def note_key(note: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(note), r"\s+", " "))


def valid_symbol(ticker: Column) -> Column:
    return ticker.rlike("^[A-Z]{2,6}$")


def xbrl_latest(facts: DataFrame, concepts: list[str], forms: list[str]) -> DataFrame:
    """Latest value per company and concept, preferred forms first; facts(company, concept, val, end, form)."""
    f = facts.where(F.col("concept").isin(concepts)).withColumn("pref", F.when(F.col("form").isin(forms), 1).otherwise(0))
    return f.groupBy("company", "concept").agg(F.max_by("val", F.struct("pref", "end", "val")).alias("val"))


def first_available(latest: DataFrame, order: list[str]) -> DataFrame:
    """First concept of the order that has a value."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("concept"))
    return latest.where(rank > 0).groupBy("company").agg(F.min_by(F.struct("concept", "val"), rank).alias("x")).select("company", "x.concept", "x.val")


def dilution_profile(df: DataFrame) -> DataFrame:
    """Headroom, share of the authorization used, fully diluted count and runway in months, from shares, authorized, warrants, cash and yearly operating cash flow.

    Risks are high, moderate or low: of dilution over 85 and 70 percent used, of a raise under 6
    and 12 months. Both are null where their inputs are missing; there is a runway only for a
    negative cash flow.
    """
    c = F.col
    known = lambda *names: F.least(*[(c(n) != 0).cast("int") for n in names], F.lit(1)) == 1  # noqa: E731  all there and not zero
    used, months = c("pct_used"), c("runway")
    tier = lambda high, mid: F.when(high, "high").when(mid, "moderate")
    out = df.withColumns(
        {
            "headroom": F.when(known("shares", "authorized") & c("shares").isNotNull() & c("authorized").isNotNull(), c("authorized") - c("shares")),
            "pct_used": F.try_divide(c("shares"), c("authorized")) * 100,
            "diluted": F.when(known("shares", "warrants"), c("shares") + c("warrants")),
            "warrant_pct": F.try_divide(c("warrants"), c("shares")) * 100,
            "burn": F.when((c("cash") != 0) & (c("cash_flow") < 0), -c("cash_flow") / 12),
        }
    ).withColumn("runway", F.try_divide(c("cash"), c("burn")))
    return out.withColumns(
        {
            "dilution_risk": F.when(used.isNotNull(), tier(used > 85, used > 70).otherwise("low")),
            "raise_risk": F.when(months.isNotNull(), tier(months < 6, months < 12).otherwise("low")),
        }
    )
