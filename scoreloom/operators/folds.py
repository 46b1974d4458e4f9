"""Folds and samples of rows, dealt on aggregated cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, columns: Sequence[str], count: str = "__count") -> DataFrame:
    """The distinct rows of the columns and how often each is there."""
    return df.groupBy(*columns).agg(F.count("*").alias(count))


def dealt(df: DataFrame, columns: Sequence[str], folds: int, seed: int = 123, weight: str | None = None, share: float = 1.0, count: str | None = None) -> DataFrame:
    """The distinct rows of the columns in each fold that holds any, with __fold and __weight (rows there, or their share of the weight).

    Rows that repeat are dealt round the folds, beginning at a hash of their values, so no fold is told by a row's own label, and
    the outcome is the same however the rows come. share: of equal rows so many are taken, rounded up or down by a hash.
    count: a column that says for how many rows each stands (without weight).
    """
    w = F.col(weight or count).cast("double") if weight or count else F.lit(1.0)
    cells = df.groupBy(*columns).agg((F.sum(count) if count else F.count("*")).alias("__rows"), F.sum(w).alias("__all"))
    taken = F.col("__rows")
    if share < 1:
        taken = F.floor(taken * share + F.pmod(F.xxhash64(F.lit(seed + 1), *columns), F.lit(1 << 20)) / (1 << 20))
    spread = cells.withColumn("__begin", F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(folds)).cast("int")).withColumn("__taken", taken).withColumn("__fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    part = F.floor((F.col("__taken") + folds - 1 - F.pmod(F.col("__fold") - F.col("__begin"), F.lit(folds))) / folds)
    return spread.withColumn("__part", part).where("__part > 0").select(*columns, "__fold", (F.col("__all") * F.col("__part") / F.col("__rows")).alias("__weight"))
