"""Registered queries of binning, encoding, filters, evaluation and cleaning, and their SQL. Nulls and special values are made from line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import focal_gradient, focal_loss, scaled_score
from ..operators.autobin import BinSelector
from ..operators.boosting import ParameterSearch, TreeModel, permutation_importance, sequential_selection
from ..operators.cleaning import allocated, replaced, standardised
from ..operators.clustering import VariableClusters
from ..operators.encode import BinEncoder, CardScorer, WoeEncoder
from ..operators.evaluate import best_cut, bucketed_thresholds, calibration, density, mean_log_loss, thresholds
from ..operators.filters import PreSelector, chi2_statistics, f_statistics, variances
from ..operators.regression import LassoLogit, StepLogit, standardised as standard_coefficients, vif
from ..operators.report import gains_breaks, gains_table, group_pivot, stability, variable_report, without_small_groups
from ..operators.selection import best_per_group, missing_correlation, scorecard
from .scorecard import BREAKS, items, rounded

SPECIAL = {"x": [-999.0]}
CUTS = {"x": [10, 20, 30, 40], "s": ["O", "F"]}
WEIGHTS = {"x": 0.8, "s": 1.1}


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x: the quantity, with a special value on lines 6 and nothing on lines 7; s: the status, missing on lines 5; p: a probability."""
    t = items(spark, sf_dir)
    line = F.col("l_linenumber")
    return t.select("l_orderkey", "l_linenumber", "l_returnflag", "y", F.when(line == 6, -999.0).when(line < 6, F.col("l_quantity").cast("double")).alias("x"), F.when(line != 5, F.col("l_linestatus")).alias("s"), (F.col("l_quantity").cast("double") / 64).alias("p"), line.cast("double").alias("w"))


def _table(spark, sf_dir, **more):
    return variable_report(holes(spark, sf_dir), "y", CUTS, SPECIAL, **more)


def _encoder(spark, sf_dir):
    return WoeEncoder(CUTS, SPECIAL, woe_missing=0.25, distr_limit=0.2).fit(_table(spark, sf_dir))


def _breaks(spark, sf_dir, method):
    chosen = BinSelector(method, bin_num_limit=6, special=SPECIAL).fit(holes(spark, sf_dir).select("x", "p", "s", "y"), "y")
    rows = [(n, k, str(b)) for n, found in chosen.breaks.items() for k, b in enumerate(found)]
    return spark.createDataFrame(rows, "variable string, place int, cut string")


def _bins(method):
    return lambda spark, sf_dir: _breaks(spark, sf_dir, method)


def _freq_vtab(spark, sf_dir):
    t = holes(spark, sf_dir).where("l_linenumber < 6")
    return rounded(BinSelector("freq", bin_num_limit=5).fit(t.select("x", "y"), "y").table.select("variable", "bin_no", "count", "bad", "woe", "total_iv"))


def _card_scored(spark, sf_dir):
    scored = CardScorer(WEIGHTS, -1.5, odds0=1 / 100, pdo=50, points0=600).fit(_encoder(spark, sf_dir)).transform(holes(spark, sf_dir))
    return scored.select("l_orderkey", "l_linenumber", "x_points", "s_points", "score")


def _gains(how):
    def run(spark, sf_dir):
        t = items(spark, sf_dir).withColumn("v", F.col("l_extendedprice").cast("double"))
        return rounded(gains_table(t, "v", "y", gains_breaks(t, "v", 5, how)))

    return run


def _pivot(spark, sf_dir):
    t = without_small_groups(holes(spark, sf_dir), ["s"], 10)
    return rounded(group_pivot(variable_report(t, "y", {"x": CUTS["x"]}, SPECIAL, by=["s"]), "s", "badprob"))


def _psi_null(spark, sf_dir):
    return rounded(stability(holes(spark, sf_dir), {"x": CUTS["x"]}, "s", "l_linenumber <= 3", SPECIAL), 8)


def _first(spark, sf_dir):
    """Line numbers repeat within an order: of equal ones the first row of the files counts, as with arg_min."""
    place = ["file_path", "row_index"]
    t = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_linestatus", "l_tax", *(f"_metadata.{c}" for c in place))
    return standardised(t, "l_orderkey", ["l_linenumber", *place], ["l_tax", *place])


def _step(spark, sf_dir):
    t = WoeEncoder(BREAKS).fit(variable_report(items(spark, sf_dir), "y", BREAKS)).transform(items(spark, sf_dir))
    fit = StepLogit("both").fit(t, list(BREAKS), "y")
    rows = [("const", fit.intercept), *fit.coefficients.items()]
    return rounded(spark.createDataFrame([(n, float(c), float(p)) for (n, c), p in zip(rows, fit.model.p)], "variable string, coefficient double, p_value double"))


def _lasso(spark, sf_dir):
    t = WoeEncoder(BREAKS).fit(variable_report(items(spark, sf_dir), "y", BREAKS)).transform(items(spark, sf_dir))
    fit = LassoLogit(c_num=8, cv=3).fit(t.select(*BREAKS, "y"), list(BREAKS), "y")
    return rounded(spark.createDataFrame([(n, float(c)) for n, c in fit.coefficients.items()], "variable string, coefficient double"), 4)


def _preselect(spark, sf_dir):
    found = PreSelector().fit(items(spark, sf_dir).select("l_quantity", "l_discount", "l_tax", "l_linestatus", "y"), "y")
    return spark.createDataFrame([(n, s) for s, names in found.dropped.items() for n in names] + [(n, "kept") for n in found.kept], "variable string, step string")


def _clusters(spark, sf_dir):
    t = items(spark, sf_dir).selectExpr("cast(l_quantity AS double) AS q", "cast(l_extendedprice AS double) AS e", "cast(l_discount AS double) AS d", "cast(l_tax AS double) AS t")
    found = VariableClusters(3).fit(t, ["q", "e", "d", "t"])
    return rounded(spark.createDataFrame([(n, c, float(found.ratios[n]), n in found.kept) for n, c in found.labels.items()], "variable string, cluster int, ratio double, kept boolean"))


def _tree_frame(spark, sf_dir):
    return holes(spark, sf_dir).select("x", "s", "w", "y")


def _importances(spark, sf_dir):
    found = TreeModel(params={"maxIter": 5, "maxDepth": 3}).fit(_tree_frame(spark, sf_dir), "y").importances
    return rounded(spark.createDataFrame(list(found.items()), "variable string, importance double"))


def _permuted(spark, sf_dir):
    t = _tree_frame(spark, sf_dir)
    return rounded(permutation_importance(TreeModel(params={"maxIter": 5, "maxDepth": 3}).fit(t, "y"), t, "y", 3))


def _sequence(spark, sf_dir):
    path = sequential_selection(_tree_frame(spark, sf_dir), "y", k=2, folds=2, params={"maxIter": 2, "maxDepth": 2})
    return rounded(spark.createDataFrame([(len(names), ",".join(names), auc) for names, auc in path], "size int, names string, auc double"))


def _search(how):
    def run(spark, sf_dir):
        found = ParameterSearch({"maxDepth": [1, 2, 4], "stepSize": [0.1, 0.3]}, how, 5, fixed={"maxIter": 2}, folds=2).fit(_tree_frame(spark, sf_dir), "y")
        return rounded(spark.createDataFrame([(k, c["maxDepth"], c["stepSize"], share, auc, c == found.best) for k, (c, share, auc) in enumerate(found.trials)], "trial int, max_depth int, step_size double, share double, auc double, best boolean"))

    return run


QUERIES = {
    "woe_table_special_missing": lambda s, d: rounded(_table(s, d)),
    "woe_table_weighted": lambda s, d: rounded(_table(s, d, weight="w")),
    "woe_table_null_group": lambda s, d: rounded(variable_report(holes(s, d), "y", {"x": CUTS["x"]}, SPECIAL, by=["s"]).select("s", "bin_no", "count", "bad", "total_iv")),
    "stability_null_group": _psi_null,
    "group_pivot": _pivot,
    "bin_encoded": lambda s, d: BinEncoder(CUTS, SPECIAL).transform(holes(s, d)).select("l_orderkey", "l_linenumber", "x", "s"),
    "woe_encoded": lambda s, d: rounded(_encoder(s, d).transform(holes(s, d)).select("l_orderkey", "l_linenumber", "x", "s")),
    "scorecard_scored": _card_scored,
    "freq_bin_vtab": _freq_vtab,
    "freq_bins": _bins("freq"),
    "pretty_bins": _bins("pretty"),
    "chi2_bins": _bins("chi2"),
    "tree_bins": _bins("tree"),
    "kmeans_bins": _bins("freq-kmeans"),
    "gains_freq": _gains("freq"),
    "gains_width": _gains("width"),
    "variance_filter": lambda s, d: rounded(variances(holes(s, d), ["x", "p", "w"]), 4),
    "anova_f": lambda s, d: rounded(f_statistics(holes(s, d), "y", ["x", "p", "w"]), 5),
    "chi2_filter": lambda s, d: rounded(chi2_statistics(holes(s, d), "y", ["s", "l_returnflag"]), 4),
    "vif": lambda s, d: rounded(vif(holes(s, d).where("l_linenumber < 6"), ["x", "w"]), 5),
    "standard_coefficients": lambda s, d: rounded(standard_coefficients(holes(s, d).where("l_linenumber < 6"), {"x": 0.5, "w": -2.0}), 5),
    "calibration": lambda s, d: rounded(calibration(holes(s, d), "p", "y")),
    "density": lambda s, d: rounded(density(holes(s, d), "p", "y", 10)),
    "best_f_beta": lambda s, d: rounded(best_cut(thresholds(holes(s, d), "p", "y"), 2.0)),
    "thresholds_bucketed": lambda s, d: rounded(bucketed_thresholds(items(s, d), "l_extendedprice", "y", 50)),
    "log_loss": lambda s, d: rounded(mean_log_loss(holes(s, d), "p", "y")),
    "scaled_score": lambda s, d: holes(s, d).select("l_orderkey", "l_linenumber", scaled_score(F.col("p")).alias("score")),
    "focal_loss": lambda s, d: rounded(holes(s, d).agg(F.avg(focal_loss(F.col("y"), F.col("p"))).alias("loss"), F.avg(focal_gradient(F.col("y"), F.col("p"))).alias("gradient"))),
    "missing_correlation": lambda s, d: rounded(missing_correlation(holes(s, d), ["x", "s", "p"])),
    "special_replaced": lambda s, d: replaced(holes(s, d), [-999.0, "O"], None).select("l_orderkey", "l_linenumber", "x", "s"),
    "first_per_id": _first,
    "typed": lambda s, d: allocated(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"), F.col("o_totalprice").cast("string").alias("price")), {"date": ["day"], "num": ["price"]}).select("o_orderkey", F.col("day").cast("date").alias("day"), F.round("price", 2).alias("price")),
    "best_per_group": lambda s, d: best_per_group(s.read.parquet(f"{d}/supplier.parquet").select("s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal"), "s_suppkey"), "s_nationkey", "s_acctbal"),
    "common_levels": lambda s, d: items(s, d).where("l_returnflag = 'R'").select("l_linestatus").distinct().intersect(items(s, d).where("l_returnflag = 'N'").select("l_linestatus").distinct()),
    "new_levels": lambda s, d: items(s, d).select("l_returnflag").exceptAll(items(s, d).where("l_linestatus = 'F'").select("l_returnflag")).distinct(),
    "step_logit": _step,
    "lasso_logit": _lasso,
    "preselected": _preselect,
    "variable_clusters": _clusters,
    "tree_importances": _importances,
    "permutation_importance": _permuted,
    "sequential_selection": _sequence,
    "parameter_grid": _search("grid"),
    "parameter_tpe": _search("tpe"),
    "parameter_halving": _search("halving"),
    "scorecard_fitted": lambda s, d: scorecard(items(s, d), "y", BREAKS)[1].groupBy("score").agg(F.count("*").alias("n")),
}

_H = """t AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_linenumber = 6 THEN -999.0 WHEN l_linenumber < 6 THEN CAST(l_quantity AS DOUBLE) END AS x,
    CASE WHEN l_linenumber <> 5 THEN l_linestatus END AS s, CAST(l_quantity AS DOUBLE) / 64 AS p, CAST(l_linenumber AS DOUBLE) AS w, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem),
    c AS (SELECT *, CASE WHEN x IS NULL THEN 6 WHEN x = -999 THEN 5 ELSE (x >= 10)::INT + (x >= 20)::INT + (x >= 30)::INT + (x >= 40)::INT END AS xb, CASE s WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 3 END AS sb FROM t)"""
_KEYS = "k(variable, bin_no, breaks) AS (VALUES ('x',0,'10'),('x',1,'20'),('x',2,'30'),('x',3,'40'),('x',4,'inf'),('x',5,'special'),('x',6,'missing'),('s',0,'O'),('s',1,'F'),('s',2,'special'),('s',3,'missing'))"


def _woe_sql(weight: str = "1.0", by: str = "", only: str = "") -> str:
    """The statements up to f: the table by bin, before its rounded columns."""
    g, on, key = (f"g.{by}, ", f"u.{by} IS NOT DISTINCT FROM g.{by} AND ", f"{by}, ") if by else ("", "", "")
    frame = f"(SELECT k.*, d.{by} FROM k CROSS JOIN (SELECT DISTINCT {by} FROM c) d) g" if by else "k g"
    return f"""{_H}, {_KEYS}, u AS (SELECT {key}'x' AS variable, xb AS bin_no, {weight} AS w, y FROM c UNION ALL SELECT {key}'s', sb, {weight}, y FROM c),
        a AS (SELECT {g}g.variable, g.bin_no, g.breaks, coalesce(sum(u.w), 0) AS n, coalesce(sum(u.w * u.y), 0) AS bad FROM {frame} LEFT JOIN u ON {on}u.variable = g.variable AND u.bin_no = g.bin_no {only} GROUP BY ALL),
        b AS (SELECT *, n - bad AS good, (bad + 1e-10) / (sum(bad) OVER w + 2e-10) AS bd, (n - bad + 1e-10) / (sum(n - bad) OVER w + 2e-10) AS gd FROM a WINDOW w AS (PARTITION BY {key}variable)),
        e AS (SELECT *, ln(bd / gd) AS lg, sum(bd) OVER o AS cb, sum(gd) OVER o AS cg FROM b WINDOW o AS (PARTITION BY {key}variable ORDER BY bin_no ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT *, CASE WHEN breaks IN ('special', 'missing') AND n = 0 THEN 0 ELSE lg END AS woe, gd * (2 * cb - bd) / 2 AS area, n / sum(n) OVER (PARTITION BY {key}variable) AS share FROM e)"""


_VTAB = """SELECT variable, bin_no, breaks, CAST(n AS DOUBLE) AS count, round(share, 6) AS count_distr, CAST(good AS DOUBLE) AS good, CAST(bad AS DOUBLE) AS bad, round(CASE WHEN n > 0 THEN bad / n END, 6) AS badprob, round(woe, 6) AS woe,
    round(sum((bd - gd) * lg) OVER w, 6) AS total_iv, round(max(abs(cg - cb)) OVER w, 6) AS ks, round(CASE WHEN n > 0 THEN bad / n END / (sum(bad) OVER w / sum(n) OVER w), 6) AS lift, round(sum(area) OVER w, 6) AS auc
    FROM f WINDOW w AS (PARTITION BY variable)"""
_WOES = "h AS (SELECT variable, bin_no, CASE WHEN breaks = 'missing' AND share < 0.2 THEN 0.25 ELSE woe END AS woe FROM f)"
_GAINS = """s AS (SELECT list_sum(list_transform(b, lambda e: (v >= e)::INT)) AS bin_no, y FROM t, q), g AS (SELECT CAST(bin_no AS INTEGER) AS bin_no, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS bad FROM s GROUP BY 1)
    SELECT 'Total' AS model, bin_no, n AS count, sum(n) OVER o AS cum_count, n - bad AS good, sum(n - bad) OVER o AS cum_good, bad, sum(bad) OVER o AS cum_bad, round(n / sum(n) OVER (), 6) AS count_distr, round(bad / n, 6) AS badprob,
    round(sum(n) OVER o / sum(n) OVER (), 6) AS approval_rate, round(sum(bad) OVER o / sum(n) OVER o, 6) AS cum_posprob FROM g WINDOW o AS (ORDER BY bin_no ROWS UNBOUNDED PRECEDING)"""
_THRESHOLDS = """r AS (SELECT pred, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM z WINDOW o AS (ORDER BY pred DESC ROWS UNBOUNDED PRECEDING))"""
_FOCAL = "CASE WHEN y = 1 THEN p ELSE 1 - p END"

ORACLE_SQL = {
    "woe_table_special_missing": f"WITH {_woe_sql()} {_VTAB}",
    "woe_table_weighted": f"WITH {_woe_sql('w')} {_VTAB}",
    "woe_table_null_group": f"WITH {_woe_sql(by='s')} SELECT s, bin_no, CAST(n AS DOUBLE) AS count, CAST(bad AS DOUBLE) AS bad, round(sum((bd - gd) * lg) OVER (PARTITION BY s, variable), 6) AS total_iv FROM f WHERE variable = 'x' QUALIFY true",
    "stability_null_group": f"WITH {_H}, n AS (SELECT s, xb, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT xb, count(*) FILTER (l_linenumber <= 3) AS nb FROM c GROUP BY ALL), q AS (SELECT xb, greatest(nb / sum(nb) OVER (), 1e-10) AS q FROM b), m AS (SELECT g.s, q.q, greatest(coalesce(n.n, 0) / sum(n.n) OVER (PARTITION BY g.s), 1e-10) AS p FROM (SELECT DISTINCT s FROM c) g CROSS JOIN q LEFT JOIN n ON n.s IS NOT DISTINCT FROM g.s AND n.xb = q.xb) SELECT 'x' AS variable, s AS \"group\", round(sum((p - q) * ln(p / q)), 8) AS psi FROM m GROUP BY s",
    "group_pivot": f"WITH {_woe_sql(by='s')} SELECT variable, bin_no, breaks, round(max(CASE WHEN s = 'F' AND n > 0 THEN bad / n END), 6) AS badprob_F, round(max(CASE WHEN s = 'O' AND n > 0 THEN bad / n END), 6) AS badprob_O, round(max(CASE WHEN s IS NULL AND n > 0 THEN bad / n END), 6) AS badprob_None FROM f WHERE variable = 'x' GROUP BY ALL",
    "bin_encoded": f"WITH {_H} SELECT l_orderkey, l_linenumber, ['10', '20', '30', '40', 'inf', 'special', 'missing'][xb + 1] AS x, ['O', 'F', 'special', 'missing'][sb + 1] AS s FROM c",
    "woe_encoded": f"WITH {_woe_sql()}, {_WOES} SELECT l_orderkey, l_linenumber, round(i.woe, 6) AS x, round(j.woe, 6) AS s FROM c JOIN h i ON i.variable = 'x' AND i.bin_no = xb JOIN h j ON j.variable = 's' AND j.bin_no = sb",
    "scorecard_scored": f"WITH {_woe_sql()}, {_WOES}, m AS (SELECT variable, bin_no, round_even(-(50 / ln(2)) * CASE variable WHEN 'x' THEN 0.8 ELSE 1.1 END * woe, 0) + 0::DOUBLE AS points FROM h) SELECT l_orderkey, l_linenumber, i.points AS x_points, j.points AS s_points, round_even(600 + 50 / ln(2) * ln(0.01) + 50 / ln(2) * 1.5, 0) + i.points + j.points AS score FROM c JOIN m i ON i.variable = 'x' AND i.bin_no = xb JOIN m j ON j.variable = 's' AND j.bin_no = sb",
    "freq_bin_vtab": f"WITH {_H}, q AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(x, [0.2, 0.4, 0.6, 0.8]), lambda e: round(e, 3)))) AS b FROM t WHERE l_linenumber < 6), u AS (SELECT CAST(list_sum(list_transform(b, lambda e: (x >= e)::INT)) AS INTEGER) AS bin_no, y FROM t, q WHERE l_linenumber < 6), n AS (SELECT g.bin_no, count(u.y) AS n, coalesce(sum(u.y), 0) AS bad FROM (SELECT unnest(range(0, 7)) AS bin_no) g LEFT JOIN u USING (bin_no) GROUP BY ALL), d AS (SELECT *, (bad + 1e-10) / (sum(bad) OVER () + 2e-10) AS bd, (n - bad + 1e-10) / (sum(n - bad) OVER () + 2e-10) AS gd FROM n) SELECT 'x' AS variable, CAST(bin_no AS INTEGER) AS bin_no, CAST(n AS DOUBLE) AS count, CAST(bad AS DOUBLE) AS bad, round(CASE WHEN bin_no > 4 THEN 0 ELSE ln(bd / gd) END, 6) AS woe, round(sum((bd - gd) * ln(bd / gd)) OVER (), 6) AS total_iv FROM d",
    "gains_freq": f"WITH {_H}, q AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.2, 0.4, 0.6, 0.8]))) AS b FROM t), {_GAINS}",
    "gains_width": f"WITH {_H}, q AS (SELECT list_transform([1, 2, 3, 4], lambda k: min(v) + (max(v) - min(v)) * k / 5) AS b FROM t), {_GAINS}",
    "variance_filter": f"WITH {_H} SELECT 'x' AS variable, round(var_pop(x), 4) AS variance FROM t UNION ALL SELECT 'p', round(var_pop(p), 4) FROM t UNION ALL SELECT 'w', round(var_pop(w), 4) FROM t",
    "anova_f": f"WITH {_H}, u AS (SELECT 'x' AS variable, x AS e, y FROM t UNION ALL SELECT 'p', p, y FROM t UNION ALL SELECT 'w', w, y FROM t), g AS (SELECT variable, y, count(*) AS n, avg(e) AS m, var_pop(e) AS v FROM u WHERE e IS NOT NULL GROUP BY ALL), a AS (SELECT variable, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mm FROM g GROUP BY ALL) SELECT variable, round((sum(g.n * (m - mm) ** 2) / (max(k) - 1)) / (sum(g.n * v) / (max(a.n) - max(k))), 5) AS f, CAST(max(k) - 1 AS BIGINT) AS df1, CAST(max(a.n) - max(k) AS BIGINT) AS df2 FROM g JOIN a USING (variable) GROUP BY variable",
    "chi2_filter": f"WITH {_H}, u AS (SELECT 's' AS variable, s AS e, y FROM t UNION ALL SELECT 'l_returnflag', l_returnflag, y FROM t), r AS (SELECT *, dense_rank() OVER (PARTITION BY variable ORDER BY e NULLS LAST) - 1 AS code FROM u), b AS (SELECT variable, y, count(*) AS n, sum(code) AS seen FROM r GROUP BY ALL), d AS (SELECT *, n / sum(n) OVER (PARTITION BY variable) * sum(seen) OVER (PARTITION BY variable) AS due FROM b) SELECT variable, round(sum((seen - due) ** 2 / due), 4) AS chi2, count(*) - 1 AS dof FROM d GROUP BY variable",
    "vif": f"WITH {_H}, a AS (SELECT sum(x * x) AS xx, sum(w * w) AS ww, sum(x * w) AS xw FROM t WHERE l_linenumber < 6) SELECT 'x' AS variable, round(xx * ww / (xx * ww - xw * xw), 5) AS vif FROM a UNION ALL SELECT 'w', round(xx * ww / (xx * ww - xw * xw), 5) FROM a",
    "standard_coefficients": f"WITH {_H}, a AS (SELECT 'x' AS variable, 0.5 AS c, stddev_samp(x) AS sd FROM t WHERE l_linenumber < 6 UNION ALL SELECT 'w', -2.0, stddev_samp(w) FROM t WHERE l_linenumber < 6) SELECT variable, CAST(c AS DOUBLE) AS coefficient, round(c * sd, 5) AS standard, round(c * sd * 0.5513, 5) AS sas, round(c * sd * 0.3554, 5) AS long FROM a",
    "calibration": f"WITH {_H} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS event_rate FROM t GROUP BY 1",
    "density": f"WITH {_H}, m AS (SELECT min(p) AS lo, (max(p) - min(p)) / 10 AS wd FROM t), b AS (SELECT y AS label, CAST(least(floor((p - lo) / wd), 9) AS INTEGER) AS bin, lo, wd, count(*) AS n FROM t, m GROUP BY ALL) SELECT label, bin, round(lo + bin * wd, 6) AS low, round(n / sum(n) OVER (PARTITION BY label) / wd, 6) AS density FROM b",
    "best_f_beta": f"WITH {_H}, z AS (SELECT p AS pred, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM t GROUP BY 1), {_THRESHOLDS} SELECT round(pred, 6) AS pred, round(5 * (tp / (tp + fp)) * (tp / pp) / (4 * (tp / (tp + fp)) + tp / pp), 6) AS fbeta FROM r ORDER BY 5 * (tp / (tp + fp)) * (tp / pp) / (4 * (tp / (tp + fp)) + tp / pp) DESC, r.pred DESC LIMIT 1",
    "thresholds_bucketed": f"WITH {_H}, m AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS wd FROM t), z AS (SELECT lo + least(floor((v - lo) / wd), 49) * wd AS pred, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM t, m GROUP BY 1), {_THRESHOLDS} SELECT round(pred, 6) AS pred, tp, fp, round(tp / pp, 6) AS tpr, round(fp / nn, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round((tp + fp) / (pp + nn), 6) AS cumpop, round(abs(tp / pp - fp / nn), 6) AS ks, round(tp / (tp + fp) / (pp / (pp + nn)), 6) AS lift, round(2 * tp / (tp + fp + pp), 6) AS f1 FROM r",
    "log_loss": f"WITH {_H} SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM t",
    "scaled_score": f"WITH {_H} SELECT l_orderkey, l_linenumber, round_even(660 + 75 / ln(2) * ln(1 / 15) - 75 / ln(2) * ln(p / (1 - p)), 0) AS score FROM t",
    "focal_loss": f"WITH {_H}, e AS (SELECT y, {_FOCAL} AS q, CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END AS a FROM t) SELECT round(avg(-a * (1 - q) ** 2 * ln(q)), 6) AS loss, round(avg(a * (2 * y - 1) * (1 - q) ** 2 * (2 * q * ln(q) + q - 1)), 6) AS gradient FROM e",
    "missing_correlation": f"WITH {_H} SELECT 'x' AS one, 's' AS other, round(corr((x IS NULL)::INT, (s IS NULL)::INT), 6) AS corr FROM t",
    "special_replaced": f"WITH {_H} SELECT l_orderkey, l_linenumber, nullif(x, -999) AS x, nullif(s, 'O') AS s FROM t",
    "first_per_id": "SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_linestatus, l_linenumber) AS l_linestatus FROM lineitem GROUP BY l_orderkey",
    "typed": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, round(CAST(o_totalprice AS DOUBLE), 2) AS price FROM orders",
    "best_per_group": "SELECT s_nationkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_acctbal AS DOUBLE) DESC, s_suppkey) = 1",
    "common_levels": "SELECT l_linestatus FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_linestatus FROM lineitem WHERE l_returnflag = 'N'",
    "new_levels": "SELECT DISTINCT l_returnflag FROM (SELECT l_returnflag FROM lineitem EXCEPT ALL SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'F')",
}
