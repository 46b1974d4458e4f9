"""The registered queries over lineitem and orders, and their SQL. Results are rounded to six places, where sums in another order agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import Missing, Outliers
from ..operators.evaluate import confusion, summary, thresholds
from ..operators.report import business_report, gains_table, level_profile, missing_profile, numeric_profile, stability, variable_report
from ..operators.selection import by_information_value, filter_statistics, scorecard

BREAKS = {"l_quantity": [10, 20, 30, 40], "l_discount": [0.025, 0.055, 0.085], "l_linestatus": ["O", "F"]}
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _numeric(spark, sf_dir):
    return rounded(numeric_profile(items(spark, sf_dir), NUMBERS), 4)


def _levels(spark, sf_dir):
    return rounded(level_profile(items(spark, sf_dir), ["l_returnflag", "l_linestatus"]))


def _missing(spark, sf_dir):
    return rounded(missing_profile(items(spark, sf_dir), ["l_tax", "l_linestatus"]))


def _business(spark, sf_dir):
    return rounded(business_report(items(spark, sf_dir), "y", "l_returnflag", "l_linestatus"))


def _woe(spark, sf_dir):
    return rounded(variable_report(items(spark, sf_dir), "y", BREAKS))


def _woe_groups(spark, sf_dir):
    return rounded(variable_report(items(spark, sf_dir), "y", {"l_quantity": BREAKS["l_quantity"]}, by=["l_linenumber"]))


def _psi(spark, sf_dir):
    return rounded(stability(items(spark, sf_dir), {k: BREAKS[k] for k in ("l_quantity", "l_discount")}, "l_returnflag"), 8)


def _gains(spark, sf_dir):
    return rounded(gains_table(items(spark, sf_dir), "l_quantity", "y", [10, 20, 30, 40], descending=True, group="l_linestatus"))


def _scores(spark, sf_dir):
    return rounded(thresholds(items(spark, sf_dir), "l_discount", "y"))


def _score_summary(spark, sf_dir):
    return rounded(summary(thresholds(items(spark, sf_dir), "l_quantity", "y")))


def _confusion(spark, sf_dir):
    return rounded(confusion(items(spark, sf_dir), "l_discount", "y", 0.05))


def _outliers(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("x", F.col("o_totalprice").cast("double"))
    return rounded(Outliers(["x"]).fit(t).transform(t).select("o_orderkey", "x"), 3)


def _filled(spark, sf_dir):
    t = items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 6, F.col("l_quantity").cast("double")).alias("x"))
    return rounded(Missing(numeric=["x"], method=("median", "constant"), indicator=True).fit(t).transform(t))


def _filters(spark, sf_dir):
    return rounded(filter_statistics(items(spark, sf_dir), ["l_linenumber", "l_linestatus", "l_returnflag"]))


def _iv(spark, sf_dir):
    return by_information_value(items(spark, sf_dir), "y", BREAKS, 0.0, 6)


def _card(spark, sf_dir):
    return scorecard(items(spark, sf_dir), "y", BREAKS)[0]


QUERIES = {"eda_numeric": _numeric, "eda_levels": _levels, "eda_missing": _missing, "business_report": _business, "variable_report": _woe, "variable_report_groups": _woe_groups, "stability_psi": _psi, "gains_table": _gains, "score_thresholds": _scores,
    "score_summary": _score_summary, "confusion_matrix": _confusion, "outliers": _outliers, "missing_filled": _filled, "filter_statistics": _filters, "iv_filter": _iv, "scorecard_points": _card}

_T = "t AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"
_BINS = "c AS (SELECT *, {quantity} AS q, {discount} AS d, CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE NULL END AS s FROM t)"
_QUANTITY = "(CASE WHEN l_quantity IS NULL THEN 6 ELSE (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT END)"
_DISCOUNT = "(CASE WHEN l_discount IS NULL THEN 5 ELSE (l_discount >= 0.025)::INT + (l_discount >= 0.055)::INT + (l_discount >= 0.085)::INT END)"
_BINNED = _BINS.format(quantity=_QUANTITY, discount=_DISCOUNT)
_QLABELS = "('l_quantity',0,'10'),('l_quantity',1,'20'),('l_quantity',2,'30'),('l_quantity',3,'40'),('l_quantity',4,'inf'),('l_quantity',5,'special'),('l_quantity',6,'missing')"
_LABELS = f"k(variable, bin_no, breaks) AS (VALUES {_QLABELS},('l_discount',0,'0.025'),('l_discount',1,'0.055'),('l_discount',2,'0.085'),('l_discount',3,'inf'),('l_discount',4,'special'),('l_discount',5,'missing'),('l_linestatus',0,'O'),('l_linestatus',1,'F'),('l_linestatus',2,'special'),('l_linestatus',3,'missing'))"
_LONG = "u AS (SELECT 'l_quantity' AS variable, q AS bin_no, y FROM c UNION ALL SELECT 'l_discount', d, y FROM c UNION ALL SELECT 'l_linestatus', s, y FROM c)"


def _report_sql(labels: str, long: str, key: str = "") -> str:
    by, on = (f"{key}, ", f"u.{key} = g.{key} AND ") if key else ("", "")
    frame = f"(SELECT k.*, g.{key} FROM k CROSS JOIN (SELECT DISTINCT {key} FROM c) g) g" if key else "k g"
    g = f"g.{key}, " if key else ""
    return f"""WITH {_T}, {_BINNED}, {labels}, {long},
        a AS (SELECT {g}g.variable, g.bin_no, g.breaks, CAST(count(u.y) AS DOUBLE) AS n, CAST(coalesce(sum(u.y), 0) AS DOUBLE) AS bad FROM {frame} LEFT JOIN u ON {on}u.variable = g.variable AND u.bin_no = g.bin_no GROUP BY ALL),
        b AS (SELECT *, n - bad AS good, (bad + 1e-10) / (sum(bad) OVER w + 2e-10) AS bd, (n - bad + 1e-10) / (sum(n - bad) OVER w + 2e-10) AS gd FROM a WINDOW w AS (PARTITION BY {by}variable)),
        e AS (SELECT *, ln(bd / gd) AS lg, sum(bd) OVER o AS cb, sum(gd) OVER o AS cg FROM b WINDOW o AS (PARTITION BY {by}variable ORDER BY bin_no ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT *, gd * (2 * cb - bd) / 2 AS area FROM e)
        SELECT {by}variable, bin_no, breaks, n AS count, round(n / sum(n) OVER w, 6) AS count_distr, good, bad, round(CASE WHEN n > 0 THEN bad / n END, 6) AS badprob,
            round(CASE WHEN breaks IN ('special', 'missing') AND n = 0 THEN 0 ELSE lg END, 6) AS woe, round(sum((bd - gd) * lg) OVER w, 6) AS total_iv, round(max(abs(cg - cb)) OVER w, 6) AS ks,
            round(CASE WHEN n > 0 THEN bad / n END / (sum(bad) OVER w / sum(n) OVER w), 6) AS lift, round(sum(area) OVER w, 6) AS auc
        FROM f WINDOW w AS (PARTITION BY {by}variable)"""


_WOE = _report_sql(_LABELS, _LONG)
_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, {', '.join(f'round(quantile_cont(x, {k / 10}), 4) AS p{k}0' for k in range(1, 10))}, round(max(x), 4) AS max, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 4) AS missing_rate FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem)"
    for c in NUMBERS
)
_FREQ = lambda c: f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, count(*) AS freq FROM lineitem GROUP BY ALL"
_RANKED = "WITH {t}, s AS (SELECT CAST({c} AS DOUBLE) AS pred, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 1), r AS (SELECT pred, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM s WINDOW o AS (ORDER BY pred DESC ROWS UNBOUNDED PRECEDING))"

ORACLE_SQL = {
    "eda_numeric": _PROFILE,
    "eda_levels": f"WITH f AS ({_FREQ('l_returnflag')} UNION ALL {_FREQ('l_linestatus')}) SELECT variable, level, freq, round(freq / sum(freq) OVER (PARTITION BY variable), 6) AS percent, CAST(sum(freq) OVER o AS BIGINT) AS cum_freq, round(sum(freq) OVER o / sum(freq) OVER (PARTITION BY variable), 6) AS cum_percent FROM f WINDOW o AS (PARTITION BY variable ORDER BY level NULLS LAST ROWS UNBOUNDED PRECEDING)",
    "eda_missing": " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS missings, round((count(*) - count({c})) / count(*), 6) AS missing_rate FROM lineitem" for c in ("l_tax", "l_linestatus")),
    "business_report": f"WITH {_T} SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS index_level, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS column_level, count(y) AS n, CAST(sum(y) AS DOUBLE) AS events, round(avg(y), 6) AS event_rate FROM t WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY CUBE (l_returnflag, l_linestatus)",
    "variable_report": _WOE,
    "variable_report_groups": _report_sql(f"k(variable, bin_no, breaks) AS (VALUES {_QLABELS})", "u AS (SELECT l_linenumber, 'l_quantity' AS variable, q AS bin_no, y FROM c)", "l_linenumber"),
    "stability_psi": f"WITH {_T}, {_BINNED}, u AS (SELECT 'l_quantity' AS variable, l_returnflag AS g, q AS b FROM c UNION ALL SELECT 'l_discount', l_returnflag, d FROM c), n AS (SELECT variable, g, b, count(*) AS n FROM u GROUP BY ALL), q AS (SELECT variable, b, count(*) / sum(count(*)) OVER (PARTITION BY variable) AS q FROM u GROUP BY variable, b), m AS (SELECT x.variable, x.g, q.q, coalesce(n.n, 0) / sum(n.n) OVER (PARTITION BY x.variable, x.g) AS share FROM (SELECT DISTINCT variable, g FROM n) x JOIN q ON q.variable = x.variable LEFT JOIN n ON n.variable = x.variable AND n.g = x.g AND n.b = q.b) SELECT variable, g AS \"group\", round(sum((greatest(share, 1e-10) - q) * ln(greatest(share, 1e-10) / q)), 8) AS psi FROM m GROUP BY variable, g",
    "gains_table": f"WITH {_T}, s AS (SELECT l_linestatus AS model, {_QUANTITY} AS bin_no, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS bad FROM t WHERE l_quantity IS NOT NULL GROUP BY ALL) SELECT model, bin_no, n AS count, sum(n) OVER o AS cum_count, n - bad AS good, sum(n - bad) OVER o AS cum_good, bad, sum(bad) OVER o AS cum_bad, round(n / sum(n) OVER (PARTITION BY model), 6) AS count_distr, round(bad / n, 6) AS badprob, round(sum(n) OVER o / sum(n) OVER (PARTITION BY model), 6) AS approval_rate, round(sum(bad) OVER o / sum(n) OVER o, 6) AS cum_posprob FROM s WINDOW o AS (PARTITION BY model ORDER BY bin_no DESC ROWS UNBOUNDED PRECEDING)",
    "score_thresholds": _RANKED.format(t=_T, c="l_discount") + " SELECT round(pred, 6) AS pred, tp, fp, round(tp / pp, 6) AS tpr, round(fp / nn, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round((tp + fp) / (pp + nn), 6) AS cumpop, round(abs(tp / pp - fp / nn), 6) AS ks, round(tp / (tp + fp) / (pp / (pp + nn)), 6) AS lift, round(2 * tp / (tp + fp + pp), 6) AS f1 FROM r",
    "score_summary": _RANKED.format(t=_T, c="l_quantity") + ", z AS (SELECT *, (fp - lag(fp, 1, 0) OVER (ORDER BY fp, tp)) / nn * (tp + lag(tp, 1, 0) OVER (ORDER BY fp, tp)) / pp / 2 AS area FROM r) SELECT round(max(abs(tp / pp - fp / nn)), 6) AS ks, round(sum(area), 6) AS auc, round(2 * sum(area) - 1, 6) AS gini, round(max(2 * tp / (tp + fp + pp)), 6) AS best_f1 FROM z",
    "confusion_matrix": f"WITH {_T}, s AS (SELECT y AS actual, (l_discount > 0.05)::INT AS predicted, CAST(count(*) AS DOUBLE) AS n FROM t WHERE l_discount IS NOT NULL GROUP BY ALL) SELECT actual, predicted, n, round(n / sum(n) OVER (), 6) AS of_all, round(n / sum(n) OVER (PARTITION BY actual), 6) AS of_actual, round(n / sum(n) OVER (PARTITION BY predicted), 6) AS of_predicted FROM s",
    "outliers": "WITH p AS (SELECT quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.99) AS p99 FROM (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders)), b AS (SELECT CASE WHEN q3 > q1 THEN q1 - 3 * (q3 - q1) ELSE p1 END AS lo, CASE WHEN q3 > q1 THEN q3 + 3 * (q3 - q1) ELSE p99 END AS hi FROM p) SELECT o_orderkey, round(CASE WHEN o_totalprice <= lo THEN lo WHEN o_totalprice >= hi THEN hi ELSE CAST(o_totalprice AS DOUBLE) END, 3) AS x FROM orders, b",
    "missing_filled": "WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 6 THEN CAST(l_quantity AS DOUBLE) END AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM s)), 6) AS x, CASE WHEN x IS NULL THEN 1 ELSE 0 END AS x_isnan FROM s",
    "filter_statistics": f"WITH f AS ({_FREQ('l_linenumber')} UNION ALL {_FREQ('l_linestatus')} UNION ALL {_FREQ('l_returnflag')}) SELECT variable, round(sum(CASE WHEN level IS NULL THEN freq ELSE 0 END) / sum(freq), 6) AS missing_rate, round(max(freq) / sum(freq), 6) AS modal_share, count(level) AS levels FROM f GROUP BY variable",
    "iv_filter": f"SELECT variable, max(total_iv) AS total_iv FROM ({_WOE}) GROUP BY variable HAVING max(total_iv) > 0",
}
