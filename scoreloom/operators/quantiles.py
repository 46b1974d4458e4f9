"""Exact percentiles without a buffer of the values: rows are counted in buckets, and those that hold a wanted rank are parted again until they hold one value."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a window: what a task keeps and sends on for each variable, however many rows there are.
BUCKETS = 4096


def _rows(spark: SparkSession, rows: Sequence[Column]) -> DataFrame:
    """Few rows of literals, made without Python workers."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def _bucket(x: Column, low: Column, width: Column, scale: Column) -> Column:
    """Never falls as x grows, and parts the ends of the window. Infinite values have buckets of their own."""
    at = F.floor((x * scale - low * scale) / width * (BUCKETS - 1)).cast("int")
    return F.when(x == math.inf, BUCKETS).when(x == -math.inf, -1).otherwise(at)


def _window(low: float | None, high: float | None) -> tuple[float, float, float]:
    """low, width and scale, which keeps the width finite."""
    low, high = (0.0, 0.0) if low is None else (low, high)
    scale = 1.0 if math.isfinite(high - low) else 0.25
    return low, (high * scale - low * scale) or 1.0, scale


def ranked(df: DataFrame, values: Mapping[str, Column], ranks: Mapping[str, Sequence[int]], ends: Mapping[str, tuple]) -> dict[tuple[str, int], float]:
    """The values at ranks (from 0) of each column, whose finite values lie between its ends. A pass over the rows for each parting."""
    spark, found, key = df.sparkSession, {}, ["variable", "__id"]
    names = [n for n in values if ranks.get(n)]
    asked = {(n, 0): [(r, r) for r in sorted(set(ranks[n]))] for n in names}  # of each window: rank there, rank in the column
    cut: list[DataFrame] = []  # windows of the partings after the first
    while asked:
        names = [n for n in names if any(n == m for m, _ in asked)]
        first = {n: tuple(map(F.lit, _window(*ends[n]))) for n in names}
        cells = [F.struct(F.lit(n).alias("variable"), values[n].alias("__x"), F.lit(0).alias("__id"), _bucket(values[n], *first[n]).alias("__bucket")) for n in names]
        t = df.select(F.inline(F.array(*cells))).where("__x IS NOT NULL")
        for held in cut:
            t = t.join(F.broadcast(held), [*key, "__bucket"]).select("variable", "__x", F.col("__next").alias("__id"), _bucket(F.col("__x"), F.col("__low"), F.col("__width"), F.col("__scale")).alias("__bucket"))
        sums = t.groupBy(*key, "__bucket").agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        below = F.sum("n").over(Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        wanted = _rows(spark, [F.struct(F.lit(n).alias("variable"), F.lit(i).alias("__id"), F.lit(r).cast("long").alias("here"), F.lit(whole).cast("long").alias("rank")) for (n, i), some in asked.items() for r, whole in some])
        hit = sums.withColumn("below", below).join(F.broadcast(wanted), key).where("here >= below AND here < below + n")
        places, windows, asked = {}, [], {}
        for r in hit.collect():  # a row for each rank
            if r.low == r.high:
                found[r.variable, r.rank] = r.low
                continue
            at = (r.variable, r["__id"], r["__bucket"])
            if at not in places:
                places[at] = len(places)
                windows.append(F.struct(*(F.lit(v).alias(k) for k, v in zip([*key, "__bucket", "__next", "__low", "__width", "__scale"], [*at, places[at], *_window(r.low, r.high)]))))
            asked.setdefault((r.variable, places[at]), []).append((r.here - r.below, r.rank))
        if windows:
            cut.append(_rows(spark, windows))
    return found


def percentiles(df: DataFrame, values: Mapping[str, Column], at: Mapping[str, Sequence[float]]) -> dict[str, list[float] | None]:
    """The percentiles of columns of doubles at shares from 0 to 1, between two values by their distances, as Spark's percentile; nulls are left out, None stands for no values."""
    if not values:
        return {}
    inside = lambda x: F.when((x > -math.inf) & (x < math.inf), x)
    row = df.agg(*(F.struct(F.count(x).alias("n"), F.min(inside(x)).alias("low"), F.max(inside(x)).alias("high")).alias(f"v{k}") for k, x in enumerate(values.values()))).first()
    stats = {n: row[f"v{k}"] for k, n in enumerate(values)}
    places = {n: [(stats[n].n - 1) * p for p in at[n]] for n in values if stats[n].n}
    found = ranked(df, values, {n: [f(p) for p in some for f in (math.floor, math.ceil)] for n, some in places.items()}, {n: (stats[n].low, stats[n].high) for n in places})

    def between(n: str, p: float) -> float:
        low, high = found[n, math.floor(p)], found[n, math.ceil(p)]
        return low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    return {n: [between(n, p) for p in places[n]] if n in places else None for n in values}
