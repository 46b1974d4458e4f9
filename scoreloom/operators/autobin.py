"""Automatic binning. One pass finds the ranges, one sums good and bad over candidate bins; break points are then chosen on these few sums.

Missing and special values never are candidates. Cells are (good, bad) weights in order of the variable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binning import JOINED, merged_by_chi2, missing, pretty
from .quantiles import percentiles
from .report import _cells, is_numeric, variable_report

TINY = 1e-10


def merged(cells: np.ndarray, cuts: Sequence[int]) -> np.ndarray:
    """The sums of cells between cuts (a cut at k lies before cell k)."""
    return np.add.reduceat(cells, [0, *cuts], axis=0)


def strictly_monotone(x: Sequence[float]) -> bool:
    step = np.diff(x)
    return bool((step > 0).all() or (step < 0).all())


def monotone_cuts(cells: np.ndarray, cuts: Sequence[int]) -> list[int]:
    """From left to right, each cut that keeps the bad rates of all bins so far strictly monotone."""
    kept: list[int] = []
    for c in cuts:
        sums = merged(cells, [*kept, c])
        if sums.sum(axis=1).all() and strictly_monotone(sums[:, 1] / sums.sum(axis=1)):
            kept.append(c)
    return kept


def _worth(sums: np.ndarray, criterion: str) -> float:
    share = (sums + TINY) / (sums.sum(axis=0) + TINY)
    good, bad = share[:, 0], share[:, 1]
    return float(((bad - good) * np.log(bad / good)).sum()) if criterion == "iv" else float(np.abs(np.cumsum(good) - np.cumsum(bad)).max())


def tree_cuts(cells: np.ndarray, lost: Sequence[float] = (0.0, 0.0), limit: int = 8, share: float = 0.05, criterion: str = "iv", tol: float = 1e-4, rounds: int = 100, monotone: bool = False) -> list[int]:
    """Greedy splits: each round takes the cut that gains most information value (or ks), the missing bin (lost) included.

    A cut that leaves a bin without goods or bads, or breaks monotony where asked, is out for good; one that leaves a bin of less than `share`
    of all rows too. Ends when the gain is below tol or the bins are `limit`.
    """
    alive, chosen, before = list(range(1, len(cells))), [], 0.0
    total = cells.sum() + sum(lost)
    while alive and rounds:
        worth = {}
        for c in list(alive):
            sums = merged(cells, sorted([*chosen, c]))
            if not sums.all() or monotone and not strictly_monotone(sums[:, 1] / sums.sum(axis=1)):
                alive.remove(c)
            else:
                worth[c] = _worth(np.vstack([sums, lost]) if sum(lost) else sums, criterion), float(sums.sum(axis=1).min())
        if not worth:
            break
        best = max(worth, key=lambda c: (worth[c][0], -c))
        alive.remove(best)
        if worth[best][1] < share * total:
            continue
        if before and (worth[best][0] - before) / before < tol:
            break
        chosen, before, rounds = sorted([*chosen, best]), worth[best][0], rounds - 1
        if len(chosen) + 1 >= limit:
            break
    return chosen


def pruned_cuts(cells: np.ndarray, cuts: Sequence[int], limit: int = 8, share: float = 0.05) -> list[int]:
    """Takes out the left edge of the smallest bin (the right one of the first) while it holds less than `share`, then while bins are too many."""
    cuts = list(cuts)
    while cuts:
        sizes = merged(cells, cuts).sum(axis=1)
        small = int(sizes.argmin())
        if sizes[small] >= share * cells.sum() and len(sizes) <= limit:
            break
        del cuts[max(small - 1, 0)]
    return cuts


def clusters(values: Sequence[float], k: int) -> np.ndarray:
    """The best clusters of numbers by squares, as a number for each value; exact, by dynamic programming over the sorted values."""
    order = np.argsort(values, kind="stable")
    x = np.asarray(values, float)[order]
    one, two = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
    n = len(x)
    cost = lambda a, z: two[z] - two[a] - (one[z] - one[a]) ** 2 / np.maximum(z - a, 1)
    best, at = np.full((k + 1, n + 1), np.inf), np.zeros((k + 1, n + 1), int)
    best[0, 0] = 0
    for j in range(1, k + 1):
        for z in range(j, n + 1):
            a = np.arange(j - 1, z)
            whole = best[j - 1, a] + cost(a, z)
            at[j, z] = a[int(whole.argmin())]
            best[j, z] = whole.min()
    out, z = np.zeros(n, int), n
    for j in range(k, 0, -1):
        out[order[at[j, z] : z]] = j - 1
        z = at[j, z]
    return out


def kmeans_cuts(cells: np.ndarray, cuts: Sequence[int], limit: int = 5) -> list[int]:
    """Joins neighbours whose bad rates fall into one cluster, with ever fewer clusters, until the bins are `limit`."""
    cuts, k = list(cuts), None
    while cuts and len(cuts) + 1 > limit:
        sums = merged(cells, cuts)
        rates = sums[:, 1] / np.maximum(sums.sum(axis=1), TINY)
        k = max(1, min(len(set(rates.tolist())), k or len(rates)) - 1)
        group = clusters(rates, k)
        like = np.append(False, group[1:] == group[:-1])
        gone = [i - 1 for i in range(1, len(like)) if like[i] and not like[i - 1]]  # the first break of each run
        cuts = [c for i, c in enumerate(cuts) if i not in gone]
    return cuts


def trimmed_ranges(df: DataFrame, names: Sequence[str], special: Mapping[str, Sequence] | None = None) -> dict[str, tuple[float, float, int]]:
    """Least, greatest and number of values of each column without outliers (as Outliers has them; all values if one would be left)."""
    special = special or {}
    value = lambda n: F.when(~missing(F.col(n), True) & ~F.col(n).isin(list(special.get(n, ()))), F.col(n).cast("double"))
    points = percentiles(df, {n: value(n) for n in names}, dict.fromkeys(names, (0.01, 0.25, 0.75, 0.99)))
    first = df.agg(*(F.struct(F.min(value(n)).alias("lo"), F.max(value(n)).alias("hi")).alias(n) for n in names)).first()
    bounds = {}
    for n in names:
        if points[n]:
            p1, q1, q3, p99 = points[n]
            bounds[n] = (q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)) if q3 > q1 else (p1, p99)
    inside = lambda n: F.when(value(n).between(*map(float, bounds[n])), value(n))
    second = df.agg(*(F.struct(F.min(inside(n)).alias("lo"), F.max(inside(n)).alias("hi"), F.approx_count_distinct(inside(n)).alias("n")).alias(n) for n in bounds)).first() if bounds else {}
    return {n: (second[n].lo, second[n].hi, second[n].n) if second[n].n > 1 else (first[n].lo, first[n].hi, 2) for n in bounds}


class BinSelector:
    """Break points of many variables by freq, freq-kmeans, pretty, tree or chi2, and a filter on information value.

    Numeric variables get cuts, strings groups of levels joined by '%,%', ordered by bad rate (ties by name); strings with more than
    `levels` levels are left out. Null targets and weights count nowhere. fit() sets breaks, table and kept; transform() selects.
    """

    METHODS = ("freq", "freq-kmeans", "pretty", "tree", "chi2")

    def __init__(self, method: str = "freq", max_bin: int = 50, distr_limit: float = 0.05, bin_num_limit: int = 8, special: Mapping[str, Sequence] | None = None, iv_limit: float = 0.0, keep: Sequence[str] = (), weight: str | None = None, monotone: bool = False, levels: int = 10):
        if method not in self.METHODS:
            raise ValueError(f"method is one of {', '.join(self.METHODS)}")
        self.method, self.max_bin, self.share, self.limit, self.special, self.iv_limit = method, max_bin, distr_limit, bin_num_limit, dict(special or {}), iv_limit
        self.keep, self.weight, self.monotone, self.levels = list(keep), weight, monotone, levels
        self.breaks: dict[str, list] = {}
        self.kept: list[str] | None = None

    def _chosen(self, cells: np.ndarray, lost: np.ndarray) -> list[int]:
        if not len(cells):
            return []
        every = list(range(1, len(cells)))
        if self.method == "tree":
            return tree_cuts(cells, lost, self.limit, self.share, monotone=self.monotone)
        if self.method == "chi2":
            cuts = merged_by_chi2([tuple(c) for c in cells.tolist()], every, self.limit, share=self.share)
        elif self.method == "pretty":
            cuts = pruned_cuts(cells, [c for c in every if merged(cells, [c]).sum(axis=1).all()], self.limit, self.share)
        elif self.method == "freq-kmeans":
            cuts = kmeans_cuts(cells, every, self.limit)
        else:
            cuts = every
        return monotone_cuts(cells, cuts) if self.monotone else cuts

    def _sums(self, df: DataFrame, target: str, breaks: Mapping[str, Sequence]) -> dict[str, dict[int, tuple[float, float]]]:
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        long = _cells(df, breaks, self.special, w.alias("w"), (w * F.col(target).cast("double")).alias("wy")).where("w IS NOT NULL AND wy IS NOT NULL")
        out: dict[str, dict[int, tuple[float, float]]] = {n: {} for n in breaks}
        for r in long.groupBy("variable", "bin_no").agg(F.sum("w").alias("n"), F.sum("wy").alias("bad")).collect():  # variables by candidate bins
            out[r.variable][r.bin_no] = (r.n - r.bad, r.bad)
        return out

    def _numeric(self, df: DataFrame, target: str, names: list[str]) -> None:
        ranges = trimmed_ranges(df, names, self.special)
        if self.method.startswith("freq"):
            value = lambda n: F.when(~missing(F.col(n), True) & ~F.col(n).isin(list(self.special.get(n, ()))), F.col(n).cast("double"))
            bins = {n: max(1, min(self.limit if self.method == "freq" else self.max_bin, ranges[n][2])) for n in ranges}
            some = [n for n in ranges if bins[n] > 1]
            row = percentiles(df, {n: value(n) for n in some}, {n: [k / bins[n] for k in range(1, bins[n])] for n in some})
            found = {n: sorted({round(x, 3) for x in row[n]}) if bins[n] > 1 else [] for n in ranges}
        else:
            found = {n: [b for b in (round(x, 3) for x in pretty(lo, hi, min(self.max_bin, count))) if lo < b <= hi] for n, (lo, hi, count) in ranges.items()}
        found |= {n: [] for n in names if n not in found}
        sums = self._sums(df, target, found)
        for n in names:
            cells = np.array([sums[n].get(k, (0.0, 0.0)) for k in range(len(found[n]) + 1)])
            lost = np.add(sums[n].get(len(found[n]) + 1, (0.0, 0.0)), sums[n].get(len(found[n]) + 2, (0.0, 0.0)))
            cuts = self._chosen(cells, lost) if cells.sum() else []
            if self.method == "freq" and cuts and cells[0].sum() <= min(1 / (len(found[n]) + 1), 0.01) * cells.sum():
                cuts = cuts[1:]
            self.breaks[n] = [found[n][c - 1] for c in cuts]

    def _text(self, df: DataFrame, target: str, names: list[str]) -> None:
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        long = df.where(F.col(target).isNotNull()).select(w.alias("w"), F.col(target).cast("double").alias("y"), F.inline(F.array(*(F.struct(F.lit(n).alias("variable"), F.when(~F.col(n).isin(list(self.special.get(n, ()))), F.col(n)).alias("level")) for n in names))))
        counts = long.groupBy("variable", "level").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("bad"), F.avg("y").alias("rate"))
        few = counts.groupBy("variable").agg(F.count("level").alias("levels")).where(F.col("levels") <= self.levels)
        rows = counts.join(F.broadcast(few), "variable").collect()  # at most so many levels a variable
        for n in sorted({r.variable for r in rows}):
            own = sorted((r for r in rows if r.variable == n and r.level is not None), key=lambda r: (r.rate, r.level))
            lost = [(r.n - r.bad, r.bad) for r in rows if r.variable == n and r.level is None]
            cells = np.array([(r.n - r.bad, r.bad) for r in own]).reshape(-1, 2)
            cuts = self._chosen(cells, np.array(lost[0] if lost else (0.0, 0.0))) if len(own) > 1 else []
            edges = [0, *cuts, len(own)]
            self.breaks[n] = [JOINED.join(r.level for r in own[a:z]) for a, z in zip(edges, edges[1:]) if z > a]

    def fit(self, df: DataFrame, target: str, names: Sequence[str] | None = None) -> BinSelector:
        self.breaks = {}
        names = list(names or [c for c in df.columns if c not in (target, self.weight)])
        numbers = [n for n in names if is_numeric(df, n)]
        if numbers:
            self._numeric(df, target, numbers)
        if text := [n for n in names if n not in numbers]:
            self._text(df, target, text)
        self.table, worth = None, {}
        if self.breaks:
            self.table = variable_report(df, target, self.breaks, self.special, self.weight)
            worth = {r.variable: r.iv for r in self.table.groupBy("variable").agg(F.max("total_iv").alias("iv")).collect()}
        self.kept = [n for n in names if n in self.keep or worth.get(n, -1.0) > self.iv_limit]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The variables that were kept, in their order."""
        if self.kept is None:
            raise RuntimeError("fit() comes first")
        return df.select(*self.kept)

    def adjust(self, actions: Sequence[tuple]) -> BinSelector:
        """A script of edits: ('edit', name, breaks), ('remove', name). Edits of unknown variables are refused."""
        for what, name, *rest in actions:
            if name not in self.breaks:
                raise KeyError(name)
            if what == "edit":
                self.breaks[name] = list(rest[0])
            elif what == "remove":
                del self.breaks[name]
                self.kept = [n for n in self.kept or [] if n != name]
            else:
                raise ValueError(f"unknown action {what}")
        return self
