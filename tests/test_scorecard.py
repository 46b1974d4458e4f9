import math
import os

import duckdb
import pytest

from scoreloom.operators.binning import merged_by_chi2, percentile_breaks, pretty, pretty_breaks
from scoreloom.operators.cleaning import Missing, Outliers, first_by_id
from scoreloom.operators.selection import points
from scoreloom.plans import modelling, scorecard
from scoreloom.plans.scorecard import items

QUERIES, ORACLE_SQL = scorecard.QUERIES | modelling.QUERIES, scorecard.ORACLE_SQL | modelling.ORACLE_SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _values(rows):
    plain = lambda x: ("nan" if math.isnan(x) else round(x, 5) + 0.0) if isinstance(x, float) else x
    return sorted((tuple((k, plain(v)) for k, v in sorted(r.items())) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    assert len(got) == len(want) > 0
    for a, b in zip(_values(got), _values(want)):
        for (k, x), (m, y) in zip(a, b):
            assert k == m and (x == y or isinstance(x, float) and abs(x - y) < 2e-5), (a, b)


def test_outliers_and_missing(spark):
    flat = spark.createDataFrame([(k, -100.0 if k == 0 else 100.0 if k == 99 else 1.0) for k in range(100)], "k int, a double")
    none = Outliers(["a"], "nan").fit(flat).transform(flat)
    assert sorted(r.k for r in none.where("a IS NULL").collect()) == [0, 99]
    wide = spark.createDataFrame([(-10000.0 if k == 0 else 10000.0 if k == 99 else float(k),) for k in range(100)], "a double")
    ends = Outliers(["a"]).fit(wide).transform(wide).agg({"a": "min"}).first()[0], Outliers(["a"]).fit(wide).transform(wide).agg({"a": "max"}).first()[0]
    assert ends == (-123.75, 222.75)
    holes = spark.createDataFrame([(1.0, "b"), (float("nan"), None), (3.0, "b"), (None, "a")], "x double, s string")
    full = Missing(["x"], ["s"], ("mean", "most_frequent"), indicator=True).fit(holes).transform(holes).collect()
    assert [(r.x, r.s, r.x_isnan, r.s_isnan) for r in full] == [(1, "b", 0, 0), (2, "b", 1, 1), (3, "b", 0, 0), (2, "a", 1, 0)]
    assert first_by_id(spark.createDataFrame([(1, 2), (1, 1), (2, 3)], "i int, o int"), "i", ["o"]).count() == 2


def test_breaks(spark):
    t = items(spark, DATA)
    assert percentile_breaks(t, ["l_quantity"], 4)["l_quantity"] == sorted(percentile_breaks(t, ["l_quantity"], 4)["l_quantity"])
    assert pretty(0, 10, 5) == [0, 2, 4, 6, 8, 10] and pretty_breaks(t, ["l_quantity"])["l_quantity"][0] > 1
    assert merged_by_chi2([(100, 10), (100, 11), (50, 50)], [1, 2]) == [2]
    assert points() == pytest.approx((660 + 75 / math.log(2) * math.log(1 / 15), 75 / math.log(2)))
