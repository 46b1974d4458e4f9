import itertools
import math
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException

from scoreloom.operators import validate
from scoreloom.operators.autobin import BinSelector, clusters, kmeans_cuts, merged, monotone_cuts, pruned_cuts, tree_cuts
from scoreloom.operators.boosting import ParameterSearch, TreeModel, cross_validated, permutation_importance, sequential_selection, tree_filter
from scoreloom.operators.clustering import VariableClusters, least_clusters, linkage
from scoreloom.operators.cleaning import Outliers, allocated, replaced
from scoreloom.operators.encode import BinEncoder, CardScorer, WoeEncoder
from scoreloom.operators.folds import dealt
from scoreloom.operators.filters import PreSelector, corrected
from scoreloom.operators.regression import Cells, Fit, LassoLogit, StepLogit, l1_fit
from scoreloom.operators.report import missing_profile, variable_report
from scoreloom.plans.modelling import QUERIES
from scoreloom.sources import write_report

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def worth(cells, cuts):
    share = (merged(cells, cuts) + 1e-10) / (cells.sum(axis=0) + 1e-10)
    return ((share[:, 1] - share[:, 0]) * np.log(share[:, 1] / share[:, 0])).sum()


def test_tree_takes_the_best_first_cut():
    rng = np.random.default_rng(2)
    for _ in range(20):
        cells = rng.integers(1, 50, (9, 2)).astype(float)
        first = tree_cuts(cells, limit=2, share=0.0)
        assert first == [max(range(1, 9), key=lambda c: worth(cells, [c]))]
        grown = tree_cuts(cells, limit=4, share=0.05)
        assert grown == sorted(grown) and len(grown) <= 3 and (merged(cells, grown).sum(axis=1) >= 0.05 * cells.sum()).all()
        rates = [b / (g + b) for g, b in merged(cells, tree_cuts(cells, monotone=True))]
        assert all(np.diff(rates) > 0) or all(np.diff(rates) < 0)


def test_clusters_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x, k = rng.random(7), 3
        cost = lambda g: sum(((x[g == c] - x[g == c].mean()) ** 2).sum() for c in set(g.tolist()))
        best = min(cost(np.array(g)) for g in itertools.product(range(k), repeat=7) if len(set(g)) == k)
        assert cost(clusters(x, k)) == pytest.approx(best)
    cells = np.array([[90, 10], [89, 11], [50, 50], [51, 49], [10, 90], [11, 89.0]])
    assert kmeans_cuts(cells, [1, 2, 3, 4, 5], 3) == [2, 4]
    assert pruned_cuts(np.array([[1, 1], [50, 50], [1, 0], [50, 50.0]]), [1, 2, 3], 8, 0.05) == [3] and monotone_cuts(cells, [1, 2, 3, 4, 5])[0] == 1


@pytest.mark.parametrize("name", ["freq_bins", "pretty_bins", "chi2_bins", "tree_bins", "kmeans_bins", "step_logit", "lasso_logit", "preselected", "variable_clusters", "scorecard_fitted"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_bins_of_text_weights_and_edges(spark):
    rows = [(float(i % 20), "abcde"[i % 5], int(i % 5 > 2 or i % 20 > 15), 2.0) for i in range(400)] + [(None, None, 1, 1.0), (float("nan"), "a", 0, 1.0), (-999.0, "z", None, 1.0)]
    df = spark.createDataFrame(rows, "x double, s string, y int, w double")
    for method in BinSelector.METHODS:
        for monotone in (False, True):
            own = BinSelector(method, special={"x": [-999.0]}, weight="w", monotone=monotone).fit(df, "y")
            assert own.kept and all(b == sorted(b) for b in [own.breaks["x"]])
            assert sorted("%,%".join(own.breaks["s"]).split("%,%")) == list("abcde")
            assert own.transform(df).columns == own.kept
    assert BinSelector("freq", levels=2).fit(df, "y", ["s"]).breaks == {}
    edited = BinSelector("tree").fit(df, "y", ["x"]).adjust([("edit", "x", [3.0])])
    assert edited.breaks == {"x": [3.0]} and edited.adjust([("remove", "x")]).breaks == {}
    with pytest.raises(RuntimeError):
        BinSelector().transform(df)


def test_encoders(spark):
    df = spark.createDataFrame([(1.0, "a", 0), (5.0, "b", 1), (5.0, "a", 1), (None, None, 0), (1.0, "b", 0), (6.0, "a", 0)], "x double, s string, y int")
    breaks = {"x": [3], "s": ["a", "b"]}
    assert [tuple(r) for r in BinEncoder(breaks).transform(df).select("x", "s").collect()][:4] == [("3", "a"), ("inf", "b"), ("inf", "a"), ("missing", "missing")]
    woe = WoeEncoder(breaks, woe_missing=0.5, distr_limit=0.9).fit(variable_report(df, "y", breaks))
    assert woe.transform(df).collect()[3].x == 0.5
    card = CardScorer({"x": 1.0, "s": 0.5}, -1.0).fit(woe)
    rows = card.transform(df).collect()
    b = 50 / math.log(2)
    assert rows[3].score == round(600 + b * math.log(0.01) + b) + round(-b * 0.5) + round(-b * 0.25) and card.card(df).count() == 1 + 4 + 4
    with pytest.raises(PySparkException):
        BinEncoder({"s": ["a"]}).transform(df).collect()
    assert BinEncoder({"s": ["a"]}, check_na=False).transform(df).where("s IS NULL").count() == 2
    wide = spark.createDataFrame([(1234567.5, 0), (1234569.0, 1)], "x double, y int")
    labels = [r.breaks for r in variable_report(wide, "y", {"x": [1234567.1, 1234568.2]}).orderBy("bin_no").collect()]
    assert labels[:2] == ["1234567.1", "1234568.2"]
    named = spark.createDataFrame([("NaN", float("nan")), ("a", 1.0)], "s string, x double")
    assert {r.variable: r.missings for r in missing_profile(named, ["s", "x"]).collect()} == {"s": 0, "x": 1}


def irls(x, y):
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design, design.T @ (y - p))
    return beta


def test_regression(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (600, 4)).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.4 + 1.2 * x[:, 0] - 0.8 * x[:, 1])))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")
    names, want = ["a", "b", "c", "d"], irls(x, y)
    near, far = Cells(df, names, "y"), Cells(df, names, "y", most=3)
    assert near.rows is not None and far.rows is None
    for cells in (near, far):
        fit = Fit(cells, range(4), 12)
        assert [fit.intercept, *fit.coefficients.values()] == pytest.approx(want.tolist(), abs=1e-6)
    far.close()
    for method in ("forward", "backward", "both"):
        for criterion in ("aic", "bic"):
            found = StepLogit(method, criterion).fit(df, names, "y")
            assert {"a", "b"} <= set(found.names) and (criterion == "aic" or len(found.names) <= 3)
    assert l1_fit(x, np.ones(600), y, 1e6) == pytest.approx(want, abs=1e-3)
    lasso = LassoLogit(c_num=8, cv=3).fit(df, names, "y")
    assert {"a", "b"} <= set(lasso.names) and np.abs(lasso.path[0][1:]).max() < 1e-3


def test_filters_and_clusters(spark):
    rows = [(float(i), 1.0, float(i) + (i % 3) / 10, "ab"[i % 2], None, int(i > 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, flat double, b double, s string, gone double, y int")
    found = PreSelector().fit(df, "y")
    assert "a" in found.kept and found.dropped["missing"] == ["gone"] and found.dropped["unique"] == ["flat"] and found.dropped["chi2 or F"] == ["s"]
    assert "flat" in PreSelector(keep=["flat"]).fit(df, "y").kept
    assert corrected({"a": 0.01, "b": 0.03, "c": 0.9}, 0.05, "fdr") == ["a", "b"] and corrected({"a": 0.01, "b": 0.03, "c": 0.9}, 0.05, "fwe") == ["a"]
    noise = df.selectExpr("a", "b", "hash(a) % 7 + 0.0 AS r")
    groups = VariableClusters(2).fit(noise, ["a", "b", "r"])
    assert groups.labels["a"] == groups.labels["b"] != groups.labels["r"] and len(groups.kept) == 2
    assert linkage(np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0.0]])) == [(0, 1, 1.0, 2), (2, 3, 4.5, 3)] and least_clusters(np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1.0]])) == 2


def test_checks_casts_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-05", "7", True), (0, "x", "y", False)], "y int, day string, n string, b boolean")
    got = allocated(df, {"date": ["day"], "num": ["n"]}).collect()
    assert got[0].day.day == 5 and got[0].n == 7 and got[1].day is None and got[1].n is None and dict(allocated(df).dtypes)["b"] == "double"
    assert [r.n for r in replaced(df, ["7", 1]).collect()] == [None, "y"]
    for bad in (lambda: allocated(df, {"num": ["n"], "str": ["n"]}), lambda: validate.frame(df, ["q"]), lambda: validate.binary_target(df.where("y = 1"), "y"), lambda: validate.weights(df.selectExpr("-1 AS w"), "w"), lambda: validate.breaks({"q": [1]}, ["y"]), lambda: validate.values(df.selectExpr("double('inf') AS q"), ["q"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        Outliers(["y"]).transform(df)
    validate.binary_target(df, "y")
    assert validate.breaks({"y": [2, 1.00004, 1.0]}, ["y"]) == {"y": [1.0, 2.0]}
    out = write_report({"one": df}, f"file://{tmp_path}")
    assert spark.read.option("header", True).csv(out[0]).count() == 2


def test_trees_and_searches(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        a, noise = float(rng.normal()), float(rng.normal())
        s = "pqr"[rng.integers(3)]
        z = 2 * a + (2.0 if s == "q" else -1.0)
        rows.append((None if i % 50 == 0 else a, noise, None if i % 70 == 0 else s, int(rng.random() < 1 / (1 + math.exp(-z)))))
    df = spark.createDataFrame(rows, "a double, noise double, s string, y int").cache()
    small = {"maxIter": 5, "maxDepth": 3}
    model = TreeModel(params=small).fit(df, "y")
    assert model.importances["a"] > model.importances["noise"] and model.importances["s"] > model.importances["noise"]
    scored = model.transform(df, "score").collect()
    assert len(scored) == len(rows) and all(0 <= r.probability <= 1 and r.score is not None for r in scored)
    assert model.transform(spark.createDataFrame([(None, None, "new", 0)], df.schema)).count() == 1
    assert set(tree_filter(df, "y", least=0.1, kind="rf", params={"numTrees": 5})) >= {"a"}
    rise = {r.variable: r.importance for r in permutation_importance(model, df, "y", 3).collect()}
    assert rise["a"] > 0.05 > abs(rise["noise"]) and rise["s"] > 0.05
    path = sequential_selection(df, "y", k=2, folds=2, params={"maxIter": 2, "maxDepth": 2})
    assert path[-1][0] == ("a", "s") and path[0][1] < path[1][1]
    with pytest.raises(ValueError):
        TreeModel(levels=2).fit(df, "y")
    with pytest.raises(RuntimeError):
        TreeModel().transform(df)
    for how, tried in (("grid", 2), ("halving", 2), ("random", 2)):
        found = ParameterSearch({"maxDepth": [1, 4]}, how, 2, 2, fixed={"maxIter": 2}, folds=2).fit(df, "y", ["a", "s"])
        assert len(found.trials) == tried and found.best == {"maxDepth": 4}


def test_suggestions_follow_the_best_trials():
    search = ParameterSearch({"a": [1, 2, 3], "b": [1, 2]}, "tpe")
    search.trials = [({"a": 3, "b": 1}, 1.0, 0.9), ({"a": 1, "b": 1}, 1.0, 0.5), ({"a": 2, "b": 2}, 1.0, 0.4), ({"a": 1, "b": 2}, 1.0, 0.3)]
    assert search.suggested(np.random.default_rng(1), [{"a": 2, "b": 1}, {"a": 3, "b": 2}, {"a": 1, "b": 1}])["a"] == 3


def test_folds_deal_equal_rows_round(spark):
    """Few distinct rows: had a row's own values told its fold, a fold's labels would be the reverse of what the others teach."""
    rows = [(float(i % 3), "uv"[i % 2], int((i * 7919) % 100 < 20 + 25 * (i % 3)), 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, s string, y int, w double")
    parts = dealt(df, ["a", "s", "y"], 4, weight="w").collect()
    sums = {}
    for r in parts:
        sums.setdefault((r.a, r.s, r.y), []).append(r["__weight"])
    for key, found in sums.items():
        n = sum(x[:3] == key for x in rows)
        assert abs(sum(found) - n / 2) < 1e-9 and max(found) - min(found) <= 0.5 and len(found) == 4
    less = sum(r["__weight"] for r in dealt(df, ["a", "s", "y"], 4, share=0.25).collect())
    assert abs(less - 750) <= 12
    lasso = LassoLogit(c_num=6, cv=3, metric="auc").fit(df.select("a", "y"), ["a"], "y")
    assert lasso.scores[-1].min() > 0.6
    assert min(cross_validated(df, "y", ["a", "s"], 3, params={"maxIter": 2})) > 0.6
