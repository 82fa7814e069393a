"""Semi-structured documents: company facts and posts as JSON text, with malformed ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "struct<end: string, val: double, form: string, filed: string>"
_CONCEPT = f"struct<label: string, units: map<string, array<{_VALUE}>>>"
#: a facts document: taxonomy, then concept, then unit, then the reported values
FACTS = f"cik string, entityName string, facts map<string, map<string, {_CONCEPT}>>, _bad string"
POST = "title string, content string, timestamp string, _bad string"

# ---- fixed values: reports that count before others, and where each metric is found ----
REPORTS = ["10-K", "10-Q", "20-F"]
#: metric: unit and concepts, the first that has a value counts
METRICS = {
    "shares_outstanding": ("shares", ["CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"]),
    "shares_authorized": ("shares", ["CommonStockSharesAuthorized"]),
    "warrants_outstanding": ("shares", ["ClassOfWarrantOrRightOutstanding", "WarrantsAndRightsOutstanding"]),
    "cash": ("USD", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsAndShortTermInvestments", "Cash"]),
    "long_term_debt": ("USD", ["LongTermDebtNoncurrent", "LongTermDebt", "NotesPayable"]),
    "operating_cash_flow": ("USD", ["NetCashProvidedByUsedInOperatingActivities"]),
    "revenue": ("USD", ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "OilAndGasRevenue", "OilAndCondensateRevenue"]),
}
# ---- end of fixed values --------------------------------------------------------------


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc): one JSON document per line of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def parsed(docs: DataFrame, schema: str, doc: str = "doc") -> DataFrame:
    """docs plus x, the parsed document; x._bad holds the text of a document that is malformed, null otherwise."""
    return docs.withColumn("x", F.from_json(doc, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))


def malformed(docs: DataFrame, schema: str, doc: str = "doc") -> DataFrame:
    """The documents that cannot be read; empty lines are none."""
    p = parsed(docs, schema, doc)
    return p.where((F.length(F.trim(doc)) > 0) & (F.col("x").isNull() | F.col("x._bad").isNotNull())).drop("x")


def _good(docs: DataFrame, schema: str, doc: str) -> DataFrame:
    return parsed(docs, schema, doc).where(F.col("x").isNotNull() & F.col("x._bad").isNull())


def fact_rows(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per reported value: company, taxonomy, concept, unit, end, val, form."""
    d = _good(docs, FACTS, doc).select(F.col("x.cik").alias("company"), F.explode("x.facts").alias("taxonomy", "concepts"))
    d = d.select("company", "taxonomy", F.explode("concepts").alias("concept", "c"))
    d = d.select("company", "taxonomy", "concept", F.explode("c.units").alias("unit", "values"))
    return d.select("company", "taxonomy", "concept", "unit", F.explode("values").alias("v")).select("company", "taxonomy", "concept", "unit", "v.end", "v.val", "v.form")


def metrics(rows: DataFrame, table: dict[str, tuple[str, list[str]]] = METRICS) -> DataFrame:
    """(company, metric, concept, val, as_of): the newest value of the first concept that has one.

    Of a concept's values those from REPORTS count before all others. Shares may stand under
    either taxonomy, us-gaap first.
    """
    places = [(m, c, unit, k) for m, (unit, concepts) in table.items() for k, c in enumerate(concepts)]
    wanted = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("concept"), F.lit(u).alias("unit"), F.lit(k).alias("place")) for m, c, u, k in places])
    mine = F.filter(wanted, lambda w: (w["concept"] == F.col("concept")) & (w["unit"] == F.col("unit")))
    r = rows.where(F.col("concept").isin([c for _, c, _, _ in places])).withColumn("w", F.explode(mine))
    preferred = F.col("form").isin(REPORTS).cast("int")
    newest = F.max_by(F.struct("val", "end"), F.struct(preferred.alias("p"), F.col("end").alias("e"), F.col("val").alias("v")))
    g = r.groupBy("company", "w.metric", "w.place", "concept", "taxonomy").agg(newest.alias("x"))
    first = F.struct("place", (F.col("taxonomy") != "us-gaap").alias("other"), "taxonomy")
    best = g.groupBy("company", "metric").agg(F.min_by(F.struct("concept", "x.val", "x.end"), first).alias("b"))
    return best.select("company", "metric", "b.concept", "b.val", F.col("b.end").alias("as_of"))


def posts(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """title, content and timestamp of the posts that can be read; missing fields are empty."""
    d = _good(docs, POST, doc)
    text: list[Column] = [F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c) for c in ("title", "content", "timestamp")]
    return d.select(*text)
