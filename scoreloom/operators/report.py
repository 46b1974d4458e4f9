"""Reports: variable profiles, weight-of-evidence tables, stability and gains. One pass over the rows each; windows run over small aggregates only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binning import SEARCHED, bin_labels, bin_number, number, searched
from .quantiles import percentiles

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")


def is_numeric(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name].split("(")[0] in NUMERIC


def stacked(df: DataFrame, names: Sequence[str], cast: str, *others: str) -> DataFrame:
    """variable, value and the other columns: one row per row and column, without a shuffle."""
    cells = F.array(*(F.struct(F.lit(n).alias("variable"), F.col(n).cast(cast).alias("value")) for n in names))
    return df.select(*others, F.inline(cells))


def absent(df: DataFrame, names: Sequence[str]) -> Column:
    """Of stacked text: null, or not a number in a column of numbers. 'NaN' in a column of text is a level."""
    return F.col("value").isNull() | (F.col("value") == "NaN") & F.col("variable").isin([n for n in names if is_numeric(df, n)])


def numeric_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable, n, mean, std, min, p10 ... p90, max, missing_rate."""
    long = stacked(df, names, "double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    found = percentiles(df, {n: number(n) for n in names}, dict.fromkeys(names, [k / 10 for k in range(1, 10)]))
    deciles = df.sparkSession.createDataFrame([(n, *(found[n] or [None] * 9)) for n in names], ", ".join(["variable string", *(f"p{k}0 double" for k in range(1, 10))]))
    out = long.groupBy("variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))
    return out.join(F.broadcast(deciles), "variable").select("variable", "n", "mean", "std", "min", *deciles.columns[1:], "max", "missing_rate")


def level_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable, level, freq, percent, cum_freq, cum_percent; null is the last level."""
    counts = stacked(df, names, "string").groupBy("variable", F.col("value").alias("level")).agg(F.count("*").alias("freq"))
    whole = F.sum("freq").over(Window.partitionBy("variable"))
    upto = F.sum("freq").over(Window.partitionBy("variable").orderBy(F.asc_nulls_last("level")).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("variable", "level", "freq", (F.col("freq") / whole).alias("percent"), upto.alias("cum_freq"), (upto / whole).alias("cum_percent"))


def missing_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable, n, missings, missing_rate."""
    long = stacked(df, names, "string")
    gone = absent(df, names)
    return long.groupBy("variable").agg(F.count("*").alias("n"), F.count_if(gone).alias("missings"), F.avg(gone.cast("double")).alias("missing_rate"))


def business_report(df: DataFrame, target: str, index: str, columns: str) -> DataFrame:
    """Counts, events and event rate of each cell, with margins named All; null keys take no part."""
    kept = df.where(F.col(index).isNotNull() & F.col(columns).isNotNull())
    cube = kept.cube(index, columns).agg(F.grouping(index).alias("gi"), F.grouping(columns).alias("gc"), F.count(target).alias("n"), F.sum(target).cast("double").alias("events"), F.avg(target).alias("event_rate"))
    name = lambda flag, c: F.when(F.col(flag) == 1, "All").otherwise(F.col(c).cast("string"))
    return cube.select(name("gi", index).alias("index_level"), name("gc", columns).alias("column_level"), "n", "events", "event_rate")


def _cells(df: DataFrame, breaks: Mapping[str, Sequence], special: Mapping[str, Sequence], *others: Column) -> DataFrame:
    held = [f"__o{k}" for k in range(len(others))]
    wide = {n: f"__b{k}" for k, (n, b) in enumerate(breaks.items()) if len(b) > SEARCHED and is_numeric(df, n)}
    names = list(breaks)
    t = df.select(*(c.alias(h) for c, h in zip(others, held)), *names)
    t = searched(t, {at: (n, breaks[n]) for n, at in wide.items()})
    cells = [F.struct(F.lit(n).alias("variable"), bin_number(n, b, is_numeric(df, n), special.get(n, ()), wide.get(n)).alias("bin_no")) for n, b in breaks.items()]
    names = df.select(*others).columns if others else []
    return t.select(*(F.col(h).alias(n) for h, n in zip(held, names)), F.inline(F.array(*cells))).where("bin_no IS NOT NULL")


def _skeleton(df: DataFrame, breaks: Mapping[str, Sequence]) -> DataFrame:
    rows = [(n, k, x) for n, b in breaks.items() for k, x in enumerate(bin_labels(b, is_numeric(df, n)))]
    return df.sparkSession.createDataFrame(rows, "variable string, bin_no int, breaks string")


def variable_report(df: DataFrame, target: str, breaks: Mapping[str, Sequence], special: Mapping[str, Sequence] | None = None, weight: str | None = None, by: Sequence[str] = (), regular: float = 1e-10) -> DataFrame:
    """The weight-of-evidence table of each variable (in each group of by): counts, bad rate, woe, iv, ks, lift and auc by bin. Empty bins stay.

    Rows with a null target or weight count nowhere; string levels outside all groups neither.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(target).cast("double")
    long = _cells(df, breaks, special or {}, *map(F.col, by), w.alias("w"), (w * y).alias("wy")).where("w IS NOT NULL AND wy IS NOT NULL")
    sums = long.groupBy(*by, "variable", "bin_no").agg(F.sum("w").alias("count"), F.sum("wy").alias("bad"))
    frame = F.broadcast(_skeleton(df, breaks))  # one row per bin
    if by:
        frame = sums.select(*by).distinct().crossJoin(frame)  # groups by bins, both of the report's own size
    # Null is a group of its own, so keys are compared null-safe.
    keys = [*by, "variable", "bin_no"]
    held = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), "count", "bad")
    t = frame.join(held, [frame[k].eqNullSafe(held[f"__{k}"]) for k in keys], "left").drop(*(f"__{k}" for k in keys)).fillna(0.0, ["count", "bad"]).withColumn("good", F.col("count") - F.col("bad"))
    whole = Window.partitionBy(*by, "variable")
    upto = whole.orderBy("bin_no").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: (F.col(c) + regular) / (F.sum(c).over(whole) + 2 * regular)
    t = t.withColumn("gd", share("good")).withColumn("bd", share("bad")).withColumn("cg", F.sum("gd").over(upto)).withColumn("cb", F.sum("bd").over(upto))
    log = F.log(F.col("bd") / F.col("gd"))
    before = lambda c: F.lag(c, 1, 0.0).over(whole.orderBy("bin_no"))
    t = t.withColumn("iv", (F.col("bd") - F.col("gd")) * log).withColumn("area", (F.col("cg") - before("cg")) * (before("cb") + F.col("cb")) / 2)
    rate = F.try_divide("bad", "count")
    empty = F.col("breaks").isin("special", "missing") & (F.col("count") == 0)
    return t.select(
        *by, "variable", "bin_no", "breaks", "count", (F.col("count") / F.sum("count").over(whole)).alias("count_distr"), "good", "bad", rate.alias("badprob"), F.when(empty, 0.0).otherwise(log).alias("woe"),
        F.sum("iv").over(whole).alias("total_iv"), F.max(F.abs(F.col("cg") - F.col("cb"))).over(whole).alias("ks"), (rate / (F.sum("bad").over(whole) / F.sum("count").over(whole))).alias("lift"), F.sum("area").over(whole).alias("auc"),
    )


def stability(df: DataFrame, breaks: Mapping[str, Sequence], group: str, base: str | None = None, special: Mapping[str, Sequence] | None = None) -> DataFrame:
    """variable, group, psi: how far the bins of each group are from those of the base rows (a condition; all rows without one). Null is a group."""
    flag = F.expr(base) if base else F.lit(True)
    long = _cells(df, breaks, special or {}, F.col(group).alias("__group"), flag.alias("__base"))
    sums = long.groupBy("variable", "__group", "bin_no").agg(F.count("*").cast("double").alias("n"), F.count_if("__base").cast("double").alias("nb"))
    groups = sums.select("variable", "__group").distinct()
    grid = groups.join(sums.select("variable", "bin_no").distinct(), "variable")
    basis = sums.groupBy("variable", "bin_no").agg(F.sum("nb").alias("nb"))
    basis = basis.select("variable", "bin_no", (F.col("nb") / F.sum("nb").over(Window.partitionBy("variable"))).alias("q"))
    held = sums.select(F.col("variable").alias("__v"), F.col("__group").alias("__g"), F.col("bin_no").alias("__b"), "n")
    full = grid.join(held, (F.col("variable") == F.col("__v")) & F.col("__group").eqNullSafe(F.col("__g")) & (F.col("bin_no") == F.col("__b")), "left").join(basis, ["variable", "bin_no"])
    p = F.coalesce("n", F.lit(0.0)) / F.sum("n").over(Window.partitionBy("variable", "__group"))
    held = full.select("variable", F.col("__group").alias("group"), F.when(p > 0, p).otherwise(1e-10).alias("p"), F.when(F.col("q") > 0, F.col("q")).otherwise(1e-10).alias("q"))
    return held.groupBy("variable", "group").agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"))


def gains_table(df: DataFrame, score: str, target: str, breaks: Sequence[float], descending: bool = False, group: str | None = None) -> DataFrame:
    """Bins of a score in order of approval with running counts. Rows with a null score or target take no part."""
    model = F.col(group).cast("string") if group else F.lit("Total")
    kept = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(model.alias("model"), bin_number(score, breaks, True).alias("bin_no"), F.col(target).cast("double").alias("y"))
    sums = kept.groupBy("model", "bin_no").agg(F.count("*").cast("double").alias("count"), F.sum("y").alias("bad")).withColumn("good", F.col("count") - F.col("bad"))
    order = F.desc("bin_no") if descending else F.asc("bin_no")
    upto, whole = Window.partitionBy("model").orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("model")
    run = lambda c: F.sum(c).over(upto)
    total = F.sum("count").over(whole)
    return sums.select("model", "bin_no", "count", run("count").alias("cum_count"), "good", run("good").alias("cum_good"), "bad", run("bad").alias("cum_bad"), (F.col("count") / total).alias("count_distr"), (F.col("bad") / F.col("count")).alias("badprob"), (run("count") / total).alias("approval_rate"), (run("bad") / run("count")).alias("cum_posprob"))


def group_pivot(table: DataFrame, by: str, value: str) -> DataFrame:
    """variable, bin_no, breaks and a column of `value` for each group of a grouped variable_report(); groups become columns, so they must be few."""
    groups = sorted((r[0] for r in table.select(by).distinct().collect()), key=lambda x: (x is None, x))
    return table.groupBy("variable", "bin_no", "breaks").agg(*(F.max(F.when(F.col(by).eqNullSafe(F.lit(g)), F.col(value))).alias(f"{value}_{g}") for g in groups))


def without_small_groups(df: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """The rows whose group has at least so many rows; null is a group."""
    large = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*(F.col(c).alias(f"__{c}") for c in by))
    return df.join(large, [df[c].eqNullSafe(large[f"__{c}"]) for c in by], "left_semi")


def gains_breaks(df: DataFrame, score: str, bins: int = 10, how: str = "freq") -> list[float]:
    """Break points of a score: freq by its percentiles, width of equal width."""
    x = number(score)
    if how == "freq":
        found = percentiles(df, {score: x}, {score: [k / bins for k in range(1, bins)]})[score] or []
    elif how == "width":
        low, high = df.agg(F.min(x), F.max(x)).first()
        found = [] if low is None else [low + (high - low) * k / bins for k in range(1, bins)]
    else:
        raise ValueError("how is freq or width")
    return sorted(set(found))
