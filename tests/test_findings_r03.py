"""Small cases of the third round's findings; each failed before its change."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import boosting
from scoreloom.operators.binning import number
from scoreloom.operators.folds import distinct_rows
from scoreloom.operators.quantiles import percentiles
from scoreloom.operators.report import _cells, numeric_profile, variable_report
from scoreloom.plans import modelling, scorecard


def _sql(path, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    return sorted(con.execute(query).fetchall())


def _lineitem(path, name, rows):
    """One more file of the table: rows as a query."""
    (path / "lineitem.parquet").mkdir(exist_ok=True)
    duckdb.execute(f"COPY ({rows}) TO '{path}/lineitem.parquet/{name}.parquet' (FORMAT parquet)")


def test_first_per_id_takes_the_first_of_equal_lines(spark, tmp_path):
    """Spark reads the larger file first, whatever its name."""
    _lineitem(tmp_path, "a", "SELECT 1::BIGINT AS l_orderkey, 1::INT AS l_linenumber, 'F' AS l_linestatus, 0.1 AS l_tax, 'R' AS l_returnflag")
    _lineitem(tmp_path, "b", "SELECT (1 + k % 7)::BIGINT AS l_orderkey, 1::INT AS l_linenumber, 'O' AS l_linestatus, 0.1 AS l_tax, 'R' AS l_returnflag FROM range(5000) t(k)")
    got = sorted(map(tuple, modelling.QUERIES["first_per_id"](spark, str(tmp_path)).collect()))
    assert got == _sql(tmp_path, modelling.ORACLE_SQL["first_per_id"]) and got[0] == (1, 1, "F")


def test_iv_filter_compares_rounded_values(spark, tmp_path):
    """The status tells next to nothing: its value rounds to 0 and is out."""
    _lineitem(tmp_path, "a", "SELECT CASE WHEN k % 2 = 0 THEN 'R' ELSE 'N' END AS l_returnflag, CASE WHEN k // 2 % 2 = 0 OR k = 2 THEN 'O' ELSE 'F' END AS l_linestatus, (k % 49)::DOUBLE AS l_quantity, (k % 11)::DOUBLE / 100 AS l_discount FROM range(20000) t(k)")
    got = sorted(map(tuple, scorecard.QUERIES["iv_filter"](spark, str(tmp_path)).collect()))
    want = _sql(tmp_path, scorecard.ORACLE_SQL["iv_filter"])
    assert [r[0] for r in got] == [r[0] for r in want] and "l_linestatus" not in dict(got)
    assert [r[1] for r in got] == pytest.approx([r[1] for r in want], abs=1e-9)


def test_percentiles_are_exact_without_a_buffer_of_values(spark, monkeypatch):
    """Outliers, infinite and equal values, nulls, both signs; with few buckets, so that they are parted often."""
    monkeypatch.setattr("scoreloom.operators.quantiles.BUCKETS", 64)
    rows = [(float(i * 7919 % 1009) / 7 - 50, 1e308 * (-1) ** i if i % 9 == 0 else float(i % 5), None if i % 3 else math.exp(i % 13), [math.inf, -math.inf, 2.0][i % 3], float("nan") if i % 2 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    shares = [0.0, 0.01, 0.25, 0.3, 0.5, 0.77, 0.99, 1.0]
    got = percentiles(df, {n: number(n) for n in df.columns}, dict.fromkeys(df.columns, shares))
    want = df.agg(*(F.percentile(number(n), F.array(*map(F.lit, shares))).alias(n) for n in df.columns)).first()
    for n in df.columns:
        assert repr(got[n]) == repr(want[n]), n


def test_profile_keeps_no_buffer_of_values(spark):
    plan = numeric_profile(spark.range(100).selectExpr("id + 0.5 AS x", "null AS y").select("x", F.col("y").cast("double")), ["x", "y"])
    assert "percentile" not in plan._jdf.queryExecution().toString()
    rows = {r.variable: r for r in plan.collect()}
    assert rows["x"].p50 == 50.0 and rows["y"].p50 is None and rows["y"].missing_rate == 1.0


def test_levels_are_distinct_before_they_are_compared(spark, tmp_path):
    _lineitem(tmp_path, "a", "SELECT CASE WHEN k % 2 = 0 THEN 'R' ELSE 'N' END AS l_returnflag, CASE WHEN k % 3 = 0 OR k = 1 THEN 'O' ELSE 'F' END AS l_linestatus FROM range(60) t(k)")
    found = modelling.QUERIES["common_levels"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == _sql(tmp_path, modelling.ORACLE_SQL["common_levels"])
    assert found._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1].count("Aggregate") == 1  # of the right side


def _few_cells(spark, n):
    """x tells the label, z nothing; 8 distinct rows."""
    return spark.range(n).selectExpr("CAST(id % 2 AS DOUBLE) AS x", "CASE WHEN id % 5 < 2 THEN 'u' ELSE 'v' END AS z", "CAST(CASE WHEN id % 10 < 8 THEN id % 2 ELSE 1 - id % 2 END AS INT) AS y")


def test_boosted_trees_are_fitted_on_distinct_rows(spark, monkeypatch):
    df, seen, fit = _few_cells(spark, 3000), [], boosting.GBTClassifier.fit
    monkeypatch.setattr(boosting.GBTClassifier, "fit", lambda self, rows: (seen.append(rows.count()), fit(self, rows))[1])
    few = boosting.TreeModel(params={"maxIter": 3, "maxDepth": 2}).fit(df, "y")
    assert seen == [df.distinct().count()]
    rows = boosting.TreeModel(params={"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 1}).fit(df, "y")  # counts rows one by one
    assert seen[1] == 3000 and few.importances == pytest.approx(rows.importances, abs=1e-9)
    want = {tuple(r[:3]): r.probability for r in rows.transform(df).collect()}
    assert all(r.probability == pytest.approx(want[tuple(r[:3])], abs=1e-9) for r in few.transform(df.distinct()).collect())


def test_permutation_parts_equal_rows(spark):
    """With more equal rows than a batch holds, batches of one row each had told nothing."""
    df = _few_cells(spark, 120_000)
    model = boosting.TreeModel(params={"maxIter": 5, "maxDepth": 2}).fit(df, "y")
    many = {r.variable: r.importance for r in boosting.permutation_importance(model, df, "y", 2).collect()}
    p = {tuple(r[:3]): r.probability for r in model.transform(df.distinct()).collect()}
    loss = lambda q, y: -math.log(q if y else 1 - q)
    of = {(x, z): next(v for k, v in p.items() if k[:2] == (x, z)) for x in (0.0, 1.0) for z in "uv"}
    n = {tuple(r[:3]): r["count"] for r in df.groupBy("x", "z", "y").count().collect()}
    want = sum(c * (0.5 * loss(of[1 - x, z], y) - 0.5 * loss(of[x, z], y)) for (x, z, y), c in n.items()) / 120_000
    assert many["x"] == pytest.approx(want, rel=0.05)


@pytest.mark.parametrize("how", ["grid", "halving", "tpe"])
def test_trials_read_distinct_rows(spark, monkeypatch, how):
    df, seen, deal = _few_cells(spark, 3000), [], boosting.dealt
    monkeypatch.setattr(boosting, "dealt", lambda rows, *a, **k: (seen.append(rows.count()), deal(rows, *a, **k))[1])
    found = boosting.ParameterSearch({"maxDepth": [1, 2]}, how, 2, 2, fixed={"maxIter": 1}, folds=2).fit(df, "y")
    assert set(seen) == {df.distinct().count()} and len(found.trials) == 2
    plain = sorted(map(tuple, deal(df, ["x", "z", "y"], 2, share=0.5).collect()))
    assert plain == sorted(map(tuple, deal(distinct_rows(df, ["x", "z", "y"]), ["x", "z", "y"], 2, share=0.5, count="__count").collect()))


def test_many_bins_keep_the_code_short(spark):
    """Java compiles no method over 8,000 bytes."""
    df = spark.range(500).selectExpr("CASE WHEN id % 50 < 48 THEN CAST(id % 101 AS DOUBLE) / 2 WHEN id % 50 = 49 THEN double('nan') END AS x", "CAST(id % 67 AS INT) AS z", "CAST(id % 3 = 0 AS INT) AS y", "CAST(1 + id % 2 AS DOUBLE) AS w")
    breaks = {"x": [k + 0.5 for k in range(49)], "z": list(range(63, 0, -1)), "w": [2.0]}
    table = variable_report(df, "y", breaks, {"x": [7.0]}, "w")
    want = {}
    for r in df.collect():
        gone = r.x is None or math.isnan(r.x)
        for n, at in (("x", 51 if gone else 50 if r.x == 7 else sum(r.x >= b for b in breaks["x"])), ("z", sum(r.z >= b for b in breaks["z"])), ("w", int(r.w >= 2))):
            want[n, at] = want.get((n, at), 0) + r.w
    assert {(r.variable, r.bin_no): r["count"] for r in table.collect() if r["count"]} == want
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(_cells(df, breaks, {"x": [7.0]}, F.col("w"))._jdf.queryExecution().executedPlan())
    assert 0 < max(parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size())) < 8000
