"""Logistic regression on aggregated cells: plain, stepwise and with an L1 path.

Rows are first summed by their distinct feature values, which for weights of evidence are few. If these cells are few enough
(counted first) the fits run on them in numpy, else each Newton step is one aggregate over the cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import dealt

#: Cells that are fetched to the driver at most: rows of some doubles.
CELLS = 50_000


def _cells(df: DataFrame, names: Sequence[str], target: str, weight: str | None, folds: int = 0, seed: int = 0) -> DataFrame:
    """n and bad by distinct row of the names, and by fold if folds are asked for."""
    w, keys = F.col(weight).cast("double") if weight else F.lit(1.0), [f"x{k}" for k in range(len(names))]
    kept = df.select(*(F.col(n).cast("double").alias(k) for n, k in zip(names, keys)), w.alias("w"), F.col(target).cast("double").alias("y")).dropna()
    if folds:
        kept = dealt(kept, [*keys, "y"], folds, seed, "w").select(*keys, "y", F.col("__weight").alias("w"), F.col("__fold").alias("fold"))
    return kept.groupBy(*keys, *(["fold"] if folds else [])).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("bad"))


class Cells:
    """The cells of the named features, fetched if few."""

    def __init__(self, df: DataFrame, names: Sequence[str], target: str, weight: str | None = None, folds: int = 0, seed: int = 0, most: int = CELLS):
        self.names, self.df = list(names), _cells(df, names, target, weight, folds, seed).persist()
        self.rows = None
        if self.df.limit(most + 1).count() <= most:
            p = self.df.toPandas()
            self.rows = p[[f"x{k}" for k in range(len(names))]].to_numpy(float), p["n"].to_numpy(float), p["bad"].to_numpy(float), p["fold"].to_numpy() if folds else None
            self.df.unpersist()

    def close(self) -> None:
        self.df.unpersist()

    def step(self, use: Sequence[int], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient, information and log-likelihood at beta (intercept first)."""
        if self.rows is not None:
            x, n, bad, _ = self.rows
            design = np.column_stack([np.ones(len(x)), x[:, list(use)]])
            eta = np.clip(design @ beta, -500, 500)
            p = 1 / (1 + np.exp(-eta))
            return design.T @ (bad - n * p), (design * (n * p * (1 - p))[:, None]).T @ design, float(bad @ eta - n @ np.logaddexp(0, eta))
        terms = [F.lit(1.0), *(F.col(f"x{k}") for k in use)]
        eta = sum((t * float(b) for t, b in zip(terms, beta)), F.lit(0.0))
        held = self.df.withColumn("eta", eta).withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        k = len(terms)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = held.agg(
            *(F.sum(t * (F.col("bad") - F.col("n") * F.col("p"))).alias(f"g{i}") for i, t in enumerate(terms)), *(F.sum(terms[i] * terms[j] * F.col("n") * F.col("p") * (1 - F.col("p"))).alias(f"h{i}_{j}") for i, j in pairs),
            F.sum(F.col("bad") * F.col("eta") - F.col("n") * (F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))))).alias("l"),
        ).first()
        bend = np.zeros((k, k))
        for i, j in pairs:
            bend[i, j] = bend[j, i] = row[f"h{i}_{j}"]
        return np.array([row[f"g{i}"] for i in range(k)]), bend, float(row["l"])

    def total(self) -> float:
        return float(self.rows[1].sum()) if self.rows is not None else float(self.df.agg(F.sum("n")).first()[0])


class Fit:
    """A fitted model: names, coefficients, intercept, standard errors and p-values (intercept first), aic, bic."""

    def __init__(self, cells: Cells, use: Sequence[int], rounds: int = 200):
        self.use, self.names = list(use), [cells.names[k] for k in use]
        beta = np.zeros(len(use) + 1)
        for _ in range(rounds):
            slope, bend, _ = cells.step(use, beta)
            move = np.linalg.lstsq(bend, slope, rcond=None)[0]
            beta = beta + np.clip(move, -10, 10)
            if np.abs(move).max() < 1e-10:
                break
        _, bend, self.loglik = cells.step(use, beta)
        self.intercept, self.coefficients = float(beta[0]), dict(zip(self.names, beta[1:].tolist()))
        self.se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(bend)), 0))
        self.p = np.array([math.erfc(abs(b) / s / math.sqrt(2)) if s else 1.0 for b, s in zip(beta, self.se)])
        self.aic, self.bic = 2 * len(beta) - 2 * self.loglik, len(beta) * math.log(cells.total()) - 2 * self.loglik


class StepLogit:
    """Binomial regression with an intercept: no_stepwise, forward, backward or both, by aic or bic.

    forward adds and backward drops the best variable while the criterion improves; both also drops the variable of highest p-value
    above p_enter, which doesn't return. With fewer than three features nothing is selected.
    """

    def __init__(self, method: str = "no_stepwise", criterion: str = "aic", p_enter: float = 0.05, max_iter: int = 200):
        if method not in ("no_stepwise", "forward", "backward", "both") or criterion not in ("aic", "bic"):
            raise ValueError("unknown method or criterion")
        self.method, self.criterion, self.p_enter, self.max_iter = method, criterion, p_enter, max_iter

    def fit(self, df: DataFrame, names: Sequence[str], target: str, weight: str | None = None) -> StepLogit:
        cells = Cells(df, names, target, weight)
        score = lambda f: getattr(f, self.criterion)
        every = list(range(len(names)))
        method = self.method if len(names) >= 3 else "no_stepwise"
        now = Fit(cells, every if method in ("no_stepwise", "backward") else [])
        out: set[int] = set()
        for turn in range(self.max_iter if method != "no_stepwise" else 0):
            if method == "backward":
                tries = [Fit(cells, [k for k in now.use if k != gone]) for gone in now.use] if len(now.use) > 1 else []
            else:
                tries = [Fit(cells, [*now.use, k]) for k in every if k not in now.use and k not in out]
            best = min(tries, key=score, default=None)
            better = best is not None and score(best) < score(now)
            if better:
                now = best
            dropped = False
            if method == "both" and turn and len(now.use) > 1 and now.p[1:].max() > self.p_enter:
                gone = now.use[int(now.p[1:].argmax())]
                out.add(gone)
                now, dropped = Fit(cells, [k for k in now.use if k != gone]), True
            if not better and not dropped:
                break
        cells.close()
        self.model, self.names, self.coefficients, self.intercept = now, now.names, now.coefficients, now.intercept
        return self


def moments(df: DataFrame, names: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, sums and raw cross products of columns in one pass; rows with a null are left out."""
    x = df.select(*(F.col(n).cast("double").alias(f"x{k}") for k, n in enumerate(names))).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = x.agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(len(names))), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cross = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cross[i, j] = cross[j, i] = row[f"c{i}_{j}"] or 0.0
    return float(row["n"]), np.array([row[f"s{i}"] or 0.0 for i in range(len(names))]), cross


def vif(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable, vif from the uncentred regression of each column on the others."""
    _, _, cross = moments(df, names)
    values = np.diag(cross) * np.diag(np.linalg.pinv(cross))
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "variable string, vif double")


def standardised(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """variable, coefficient, and it standardised: by the deviation, times 0.5513 (SAS) and 0.3554 (Long)."""
    names = list(coefficients)
    n, sums, cross = moments(df, names)
    sd = np.sqrt(np.maximum(np.diag(cross) - sums**2 / n, 0) / max(n - 1, 1))
    return df.sparkSession.createDataFrame([(k, float(coefficients[k]), float(coefficients[k] * s), float(coefficients[k] * s * 0.5513), float(coefficients[k] * s * 0.3554)) for k, s in zip(names, sd)], "variable string, coefficient double, standard double, sas double, long double")


def _soft(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def l1_fit(x: np.ndarray, n: np.ndarray, bad: np.ndarray, c: float, start: np.ndarray | None = None, rounds: int = 5000) -> np.ndarray:
    """Coefficients (intercept first, not penalised) of least sum|b| + c * weighted logistic loss, by accelerated proximal steps."""
    design = np.column_stack([np.ones(len(x)), x])
    pace = 4 / max(float(np.linalg.eigvalsh((design * n[:, None]).T @ design)[-1]) * c, 1e-12)
    beta = np.zeros(design.shape[1]) if start is None else start
    ahead, t = beta, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -500, 500)))
        new = ahead - pace * c * (design.T @ (n * p - bad))
        new[1:] = _soft(new[1:], pace)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, step = new + (t - 1) / later * (new - beta), np.abs(new - beta).max()
        beta, t = new, later
        if step < 1e-9:
            break
    return beta


class LassoLogit:
    """An L1 path over l1_min_c * logspace(0, 7, c_num) with cross-validation; keeps the features of the strongest penalty within one standard
    error of the best (1se), or of the best itself. Equal rows are dealt round the folds, beginning at a hash of their values."""

    def __init__(self, c_num: int = 20, method: str = "1se", metric: str = "neglogloss", cv: int = 5, seed: int = 123, standard: bool = True):
        if method not in ("1se", "best") or metric not in ("neglogloss", "auc"):
            raise ValueError("method is 1se or best, metric neglogloss or auc")
        self.c_num, self.method, self.metric, self.cv, self.seed, self.standard = c_num, method, metric, cv, seed, standard

    def fit(self, df: DataFrame, names: Sequence[str], target: str, weight: str | None = None) -> LassoLogit:
        cells = Cells(df, names, target, weight, self.cv, self.seed)
        if cells.rows is None:
            cells.close()
            raise ValueError(f"more than {CELLS} distinct rows: encode the features by bins first")
        x, n, bad, fold = cells.rows
        mean, sd = (n @ x) / n.sum(), np.sqrt((n @ (x - (n @ x) / n.sum()) ** 2) / n.sum())
        x = (x - mean) / np.where(sd > 0, sd, 1) if self.standard else x
        least = 1 / max(float(np.abs(x.T @ (bad - n * bad.sum() / n.sum())).max()), 1e-12)
        self.cs = least * np.logspace(0, 7, self.c_num)
        scores, path, beta = np.zeros((self.c_num, self.cv)), [], None
        for k, c in enumerate(self.cs):
            beta = l1_fit(x, n, bad, c, beta)
            path.append(beta)
        for f in range(self.cv):
            train, test, own = fold != f, fold == f, None
            for k, c in enumerate(self.cs):
                own = l1_fit(x[train], n[train], bad[train], c, own)
                scores[k, f] = _score(own[0] + x[test] @ own[1:], n[test], bad[test], self.metric)
        mean_score, se = scores.mean(axis=1), scores.std(axis=1) / math.sqrt(max(self.cv - 1, 1))
        best = int(mean_score.argmax())
        at = best if self.method == "best" else int(np.flatnonzero(mean_score >= mean_score[best] - se[best])[0])
        self.c, self.path, self.scores = float(self.cs[at]), np.array(path), scores
        self.coefficients = dict(zip(names, path[at][1:].tolist()))
        self.names = [k for k in names if abs(self.coefficients[k]) > 1e-9]
        return self


def _score(eta: np.ndarray, n: np.ndarray, bad: np.ndarray, metric: str) -> float:
    if metric == "neglogloss":
        return float((bad @ eta - n @ np.logaddexp(0, eta)) / n.sum())
    order = np.argsort(-eta, kind="stable")
    values, first = np.unique(-eta[order], return_index=True)
    tp, fp = (np.append(0, np.cumsum(np.add.reduceat(y[order], first))) for y in (bad, n - bad))
    return float(((fp[1:] - fp[:-1]) * (tp[1:] + tp[:-1])).sum() / 2 / max(tp[-1] * fp[-1], 1e-300))
