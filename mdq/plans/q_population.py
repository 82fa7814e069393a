"""Registered queries: dominance, diversity, population tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import score_expr
from ..functions.core import tidy
from ..operators import population
from ..sources.adapters import table
from .inputs import once, panel
from .q_portfolio import walk
from .q_reports import enriched_panel
from .registry import cte, query, rounded

_ORD = "SELECT o_orderkey, o_totalprice AS x, -(epoch(o_orderdate) // 86400)::DOUBLE AS y FROM orders"


@query("pareto_front_large", rounded("o_orderkey", "x y", f"SELECT * FROM ({_ORD}) a WHERE NOT EXISTS (SELECT 1 FROM ({_ORD}) b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))", 3))
def q_front(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), (-F.unix_date(F.to_date("o_orderdate"))).cast("double").alias("y"))
    return tidy(population.pareto_front_2d(o, "x", "y"), ["o_orderkey"], ["x", "y"], 3)


_ORD3 = "SELECT o_orderkey, o_totalprice AS x, -date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS y, o_custkey % 977 AS z FROM orders"


@query("pareto_skyline_3d", rounded("o_orderkey", "x y z", f"""SELECT * FROM ({_ORD3}) a WHERE NOT EXISTS (SELECT 1 FROM ({_ORD3}) b WHERE b.x >= a.x AND b.y >= a.y AND b.z >= a.z AND (b.x > a.x OR b.y > a.y OR b.z > a.z))""", 3))
def q_skyline(spark, sf_dir):
    date = (-F.unix_date(F.to_date("o_orderdate"))).cast("double")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), date.alias("y"), (F.col("o_custkey") % 977).cast("double").alias("z"))
    return tidy(population.skyline(o, "o_orderkey", {"x": "max", "y": "max", "z": "max"}), ["o_orderkey"], ["x", "y", "z"], 3)


cte("objs", "SELECT ticker, round(avg(ret), 9) AS mean, round(stddev_samp(ret), 9) AS sd FROM enp WHERE ret IS NOT NULL GROUP BY 1")


@once("objectives")
def objectives(spark, sf_dir):
    return enriched_panel(spark, sf_dir).where("ret is not null").groupBy("ticker").agg(F.round(F.avg("ret"), 9).alias("mean"), F.round(F.stddev_samp("ret"), 9).alias("sd"))


OBJ = {"mean": "max", "sd": "min"}


@query("dominance_pairs", "SELECT a.ticker AS winner, b.ticker AS loser FROM objs a JOIN objs b ON a.mean >= b.mean AND a.sd <= b.sd AND (a.mean > b.mean OR a.sd < b.sd)")
def q_dominance(spark, sf_dir):
    return population.dominated_by(objectives(spark, sf_dir), "ticker", OBJ)


@once("fronts")
def ranked(spark, sf_dir):
    return population.crowding(population.fronts(objectives(spark, sf_dir), "ticker", OBJ), "ticker", ["mean", "sd"])


cte("dom", "SELECT a.ticker AS winner, b.ticker AS loser FROM objs a JOIN objs b ON a.mean >= b.mean AND a.sd <= b.sd AND (a.mean > b.mean OR a.sd < b.sd)")
# front number = longest chain of dominators
cte("chains", "SELECT ticker, 0 AS d FROM objs UNION SELECT dom.loser, c.d + 1 FROM chains c JOIN dom ON dom.winner = c.ticker")
cte("frontno", "SELECT ticker, max(d) AS front FROM chains GROUP BY 1")


@query("pareto_fronts", "SELECT ticker, CAST(front AS INTEGER) AS front FROM frontno")
def q_fronts(spark, sf_dir):
    return ranked(spark, sf_dir).select("ticker", "front")


def _cd(c):
    w = f"(PARTITION BY front ORDER BY {c}, ticker)"
    s = f"nullif(max({c}) OVER (PARTITION BY front) - min({c}) OVER (PARTITION BY front), 0)"
    return f"coalesce((lead({c}) OVER {w} - lag({c}) OVER {w}) / {s}, 0)", f"lead({c}) OVER {w} IS NULL OR lag({c}) OVER {w} IS NULL"


cte("crowd", f"SELECT ticker, front, mean, sd, CASE WHEN {_cd('mean')[1]} OR {_cd('sd')[1]} THEN NULL ELSE {_cd('mean')[0]} + {_cd('sd')[0]} END AS crowding FROM objs JOIN frontno USING (ticker)")


@query("crowding_distance", rounded("ticker", "crowding", "SELECT * FROM crowd"))
def q_crowding(spark, sf_dir):
    return tidy(ranked(spark, sf_dir), ["ticker"], ["crowding"])


@query("survivor_selection", "SELECT ticker FROM crowd ORDER BY front, round(crowding, 9) DESC NULLS FIRST, ticker LIMIT 10")
def q_survivors(spark, sf_dir):
    return population.survivors(ranked(spark, sf_dir).withColumn("crowding", F.round("crowding", 9)), 10, "ticker").select("ticker")


@query("hypervolume_2d", rounded("", "hypervolume", "SELECT sum((x - coalesce(p, rx)) * (y - ry)) AS hypervolume FROM (SELECT *, lag(x) OVER (ORDER BY x) AS p, min(x) OVER () - 1 AS rx, min(y) OVER () - 1 AS ry FROM (SELECT DISTINCT mean AS x, -sd AS y FROM crowd WHERE front = 0))"))
def q_hv(spark, sf_dir):
    f = ranked(spark, sf_dir).where("front = 0").select(F.col("mean").alias("x"), (-F.col("sd")).alias("y"))
    return tidy(population.hypervolume_2d(f, "x", "y"), [], ["hypervolume"])


@query("behaviour_distances", rounded("a b", "euclidean manhattan cosine", """SELECT x.strategy AS a, y.strategy AS b, list_distance(x.v, y.v) AS euclidean, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: abs(x.v[i] - y.v[i]))) AS manhattan, 1 - list_cosine_similarity(x.v, y.v) AS cosine FROM (
 SELECT strategy, list_concat(list_concat(list_concat(list(total_return ORDER BY period_id), list(sharpe_ratio ORDER BY period_id)), list(max_drawdown ORDER BY period_id)), [avg(turnover)::DOUBLE, avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, count(*)::DOUBLE]) AS v FROM wf GROUP BY 1) x
 JOIN (SELECT strategy, list_concat(list_concat(list_concat(list(total_return ORDER BY period_id), list(sharpe_ratio ORDER BY period_id)), list(max_drawdown ORDER BY period_id)), [avg(turnover)::DOUBLE, avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, count(*)::DOUBLE]) AS v FROM wf GROUP BY 1) y ON x.strategy < y.strategy""", 5))
def q_behaviour(spark, sf_dir):
    v = population.behaviour_vector(walk(spark, sf_dir))
    a, b = v.toDF("a", "va"), v.toDF("b", "vb")
    j = a.join(b, F.col("a") < F.col("b"))
    d = {k: population.distance(F.col("va"), F.col("vb"), k) for k in ("euclidean", "manhattan", "cosine")}
    return tidy(j.withColumns(d), ["a", "b"], list(d), 5)


_EMB = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
cte("vdist", f"SELECT a.vec_id, a.label, b.vec_id AS other, list_distance(a.v, b.v) AS d FROM ({_EMB}) a JOIN ({_EMB}) b ON a.vec_id <> b.vec_id")


@once("niches")
def niches(spark, sf_dir):
    return population.niches(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", sigma=1.2, k=15)


@once("mean_distances")
def mean_distances(spark, sf_dir):
    return population.mean_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("niche_count_and_novelty", rounded("vec_id", "niche_count mean_distance novelty", """SELECT vec_id, niche_count, mean_distance, novelty FROM (SELECT vec_id, 1 + sum(CASE WHEN d < 1.2 THEN 1 - d / 1.2 ELSE 0 END) AS niche_count, avg(d) AS mean_distance FROM vdist GROUP BY 1)
 JOIN (SELECT vec_id, avg(d) AS novelty FROM (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM vdist) WHERE k <= 15 GROUP BY 1) USING (vec_id)""", 5))
def q_near(spark, sf_dir):
    return tidy(niches(spark, sf_dir).join(mean_distances(spark, sf_dir), "vec_id"), ["vec_id"], ["niche_count", "mean_distance", "novelty"], 5)


@query("shared_fitness", rounded("vec_id", "shared", "SELECT vec_id, any_value(label + 1) / (1 + sum(CASE WHEN d < 1.2 THEN 1 - d / 1.2 ELSE 0 END)) AS shared FROM vdist GROUP BY 1", 5))
def q_shared(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label").join(niches(spark, sf_dir), "vec_id")
    return tidy(e.withColumn("shared", (F.col("label") + 1) / F.col("niche_count")), ["vec_id"], ["shared"], 5)


@query("archive_statistics", rounded("label n", "avg_fitness best diversity", "SELECT label, count(*) AS n, avg(f) AS avg_fitness, max(f) AS best, avg(m) AS diversity FROM (SELECT vec_id, any_value(label) AS label, any_value(vec_id) / 100.0 AS f, avg(d) AS m FROM vdist GROUP BY 1) GROUP BY 1", 5))
def q_archive(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") / 100.0).alias("fitness"))
    return tidy(population.archive_statistics(e, mean_distances(spark, sf_dir), "vec_id", "label"), ["label", "n"], ["avg_fitness", "best", "diversity"], 5)


# strategies table written from parts: formula, tree, fitness, generation
cte(
    "strats",
    """SELECT p_partkey AS id, p_brand AS generation, p_retailprice / 1000 AS fitness, p_size % 5 + 3 AS size, '(mom_' || p_size || 'd add neg(vol_' || p_size % 7 || 'd))' AS formula,
 '{"type": "binary", "op": "add", "left": {"type": "feature", "name": "mom_' || p_size || 'd"}, "right": {"type": "unary", "op": "neg", "child": {"type": "feature", "name": "vol_' || p_size % 7 || 'd"}}}' AS tree_json FROM part""",
)


@once("strats")
def strategies(spark, sf_dir):
    a, b = F.col("p_size").cast("string"), (F.col("p_size") % 7).cast("string")
    c = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("generation"), (F.col("p_retailprice") / 1000).alias("fitness"), (F.col("p_size") % 5 + 3).alias("size"),
        c("(mom_", a, "d add neg(vol_", b, "d))").alias("formula"),
        c('{"type": "binary", "op": "add", "left": {"type": "feature", "name": "mom_', a, 'd"}, "right": {"type": "unary", "op": "neg", "child": {"type": "feature", "name": "vol_', b, 'd"}}}').alias("tree_json"),
    )


@query("expression_size_and_depth", "SELECT id, 4 AS nodes, 3 AS depth FROM strats")
def q_size(spark, sf_dir):
    return strategies(spark, sf_dir).select("id", score_expr.tree_size(F.col("tree_json")).alias("nodes"), score_expr.tree_depth(F.col("tree_json")).alias("depth"))


@query("parsimony_fitness", rounded("id", "adjusted", "SELECT id, fitness - 0.001 * size + CASE WHEN id = min(id) OVER (PARTITION BY formula) THEN 0.01 ELSE 0 END AS adjusted FROM strats"))
def q_parsimony(spark, sf_dir):
    return tidy(population.parsimony(strategies(spark, sf_dir)), ["id"], ["adjusted"])


@query("generation_statistics", rounded("generation n formulas", "lo mean best avg_size unique_share", "SELECT generation, count(*) AS n, count(DISTINCT formula) AS formulas, min(fitness) AS lo, avg(fitness) AS mean, max(fitness) AS best, avg(size) AS avg_size, count(DISTINCT formula) / count(*)::DOUBLE AS unique_share FROM strats GROUP BY 1"))
def q_generations(spark, sf_dir):
    return tidy(population.generation_statistics(strategies(spark, sf_dir)), ["generation", "n", "formulas"], ["lo", "mean", "best", "avg_size", "unique_share"])


_FE = "SELECT generation, fitness, unnest(['mom_' || regexp_extract(formula, 'mom_([0-9]+)d', 1) || 'd', 'vol_' || regexp_extract(formula, 'vol_([0-9]+)d', 1) || 'd']) AS feature FROM strats"


@query("feature_importance", rounded("feature uses", "lo mean best use_share score", f"SELECT *, uses / sum(uses) OVER ()::DOUBLE AS use_share, uses * mean AS score FROM (SELECT feature, count(*) AS uses, min(fitness) AS lo, avg(fitness) AS mean, max(fitness) AS best FROM ({_FE}) GROUP BY 1)", 5))
def q_importance(spark, sf_dir):
    return tidy(population.feature_importance(strategies(spark, sf_dir)), ["feature", "uses"], ["lo", "mean", "best", "use_share", "score"], 5)


@query("feature_importance_by_group", rounded("generation feature uses", "mean use_share", f"SELECT *, uses / sum(uses) OVER (PARTITION BY generation)::DOUBLE AS use_share FROM (SELECT generation, feature, count(*) AS uses, avg(fitness) AS mean FROM ({_FE}) GROUP BY 1, 2)", 5))
def q_importance_group(spark, sf_dir):
    return tidy(population.feature_importance(strategies(spark, sf_dir), "generation"), ["generation", "feature", "uses"], ["mean", "use_share"], 5)


@query("top_strategies", rounded("id formula", "fitness", "SELECT * FROM strats ORDER BY fitness DESC, id LIMIT 10"))
def q_top(spark, sf_dir):
    return tidy(strategies(spark, sf_dir).orderBy(F.col("fitness").desc(), "id").limit(10), ["id", "formula"], ["fitness"])
