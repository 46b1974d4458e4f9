"""Binning: break points from aggregates, and bin numbers as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles

#: Breaks from which bins are found by halving.
SEARCHED = 12
#: What joins the levels of one bin of a string column.
JOINED = "%,%"


def missing(column: Column, numeric: bool) -> Column:
    return column.isNull() | F.isnan(column.cast("double")) if numeric else column.isNull()


def number(name: str) -> Column:
    """A column of numbers as double, without not-a-numbers."""
    return F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double"))


def bin_labels(breaks: Sequence, numeric: bool) -> list[str]:
    """The label of each bin in order; special and missing come last."""
    edges = [str(int(b)) if float(b).is_integer() else repr(float(b)) for b in breaks] + ["inf"] if numeric else [str(b) for b in breaks]
    return [*edges, "special", "missing"]


def searched(df: DataFrame, columns: Mapping[str, tuple[str, Sequence]]) -> DataFrame:
    """df with how many of its breaks each number reaches, by halving: {new column: (column, breaks)}.

    Each step is a projection of its own, and the code stays short however many breaks there are: Java doesn't compile what is too long.
    """
    steps = {at: 1 << (len(b).bit_length() - 1) for at, (_, b) in columns.items()}
    df = df.withColumns({at: F.lit(0) for at in columns})
    while any(steps.values()):
        moves = {}
        for at, (name, breaks) in columns.items():
            if step := steps[at]:
                edge = F.get(F.array(*(F.lit(float(b)) for b in sorted(breaks))), F.col(at) + (step - 1))  # null beyond the last
                moves[at] = F.when(F.col(name) >= edge, F.col(at) + step).otherwise(F.col(at))
                steps[at] = step >> 1
        df = df.withColumns(moves)
    return df


def bin_number(name: str, breaks: Sequence, numeric: bool, special: Sequence = (), found_in: str | None = None) -> Column:
    """The bin of each row. Numeric bins are closed at their left edge; levels outside all groups have no bin (null).

    found_in: a column of searched() that has the number of breaks reached.
    """
    column = F.col(name)
    bins = len(breaks) + 1 if numeric else len(breaks)
    if found_in:
        at = F.col(found_in)
    elif numeric:
        at = sum((F.when(column >= F.lit(float(b)), 1).otherwise(0) for b in breaks), F.lit(0))
    else:
        at = F.lit(None).cast("int")
        for k, group in reversed(list(enumerate(breaks))):
            at = F.when(column.isin(str(group).split(JOINED)), k).otherwise(at)
    found = F.when(missing(column, numeric), bins + 1)
    return (found.when(column.isin(list(special)), bins) if special else found).otherwise(at).cast("int")


def percentile_breaks(df: DataFrame, names: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Equal-frequency break points of many numeric columns."""
    found = percentiles(df, {n: number(n) for n in names}, dict.fromkeys(names, [k / bins for k in range(1, bins)]))
    return {n: sorted({round(x, 3) for x in found[n] or []}) for n in names}


def pretty(low: float, high: float, n: int = 5) -> list[float]:
    """Round break points: about n steps of 1, 2, 5 or 10 times a power of ten that cover the range."""
    if not high > low:
        return []
    rough = (high - low) / max(1, n - 1)
    power = 10.0 ** math.floor(math.log10(rough))
    share = rough / power
    step = power * (1 if share < 1.5 else 2 if share < 3 else 5 if share < 7 else 10)
    first, last = math.floor(low / step), math.ceil(high / step)
    return [k * step for k in range(first, last + 1)]


def pretty_breaks(df: DataFrame, names: Sequence[str], n: int = 8) -> dict[str, list[float]]:
    """Round break points strictly inside the range of each column."""
    row = df.agg(*(f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    ends = {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(names)}
    return {c: [round(b, 3) for b in pretty(lo, hi, n) if lo < b < hi] if lo is not None else [] for c, (lo, hi) in ends.items()}


def merged_by_chi2(cells: list[tuple[float, float]], breaks: list[float], limit: int = 8, threshold: float = 2.7055, share: float = 0.05) -> list[float]:
    """Break points after merging neighbours of (good, bad) cells: least chi-square under the threshold first, then thin cells, then too many cells.

    A thin cell loses its left edge (the first its right one). A pair without goods or without bads counts as alike.
    """
    cells, cuts = [tuple(c) for c in cells], list(breaks)
    total = sum(g + b for g, b in cells)

    def chi(k: int) -> float:
        (a, b), (c, d) = cells[k], cells[k + 1]
        under = (a + b) * (c + d) * (a + c) * (b + d)
        return (a + b + c + d) * (a * d - b * c) ** 2 / under if under else 0.0

    while cuts:
        values = [chi(k) for k in range(len(cuts))]
        at = min(range(len(cuts)), key=values.__getitem__)
        sizes = [g + b for g, b in cells]
        if values[at] >= threshold:
            thin = min(range(len(cells)), key=sizes.__getitem__)
            if sizes[thin] < share * total:
                at = max(thin - 1, 0)
            elif len(cells) <= limit:
                break
        cells[at : at + 2] = [(cells[at][0] + cells[at + 1][0], cells[at][1] + cells[at + 1][1])]
        del cuts[at]
    return cuts
