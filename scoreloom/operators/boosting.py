"""Tree ensembles as selectors and tuned models: fits, importances, permutation, sequential selection, and searches of parameters.

A missing number becomes one below the column's least, so that a split can part it from the rest; levels of text are ranked by their bad rate.
Models of folds are fitted on distinct rows with weights (folds.py), and so is any boosted model for which they are the same as the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import log_loss, scaled_score
from .binning import missing
from .folds import dealt, distinct_rows
from .report import is_numeric

FEATURES, PROBABILITY = "__features", "probability"
#: Rows that one task of a fit keeps, some 250 bytes each, or that one task of permutation_importance() scores.
TASK_ROWS = 1_000_000
#: Equal rows that are made at once of one distinct row.
CHUNK = 4096


class TreeModel:
    """A boosted ("gbt") or bagged ("rf") ensemble for a 0/1 target. params: the arguments of Spark's classifier, such as maxIter or maxDepth.

    Text columns may have up to `levels` levels; levels not seen in fit(), and missing text, rank first.
    """

    def __init__(self, kind: str = "gbt", params: Mapping | None = None, seed: int = 123, levels: int = 1000):
        if kind not in ("gbt", "rf"):
            raise ValueError("kind is gbt or rf")
        self.kind, self.params, self.seed, self.levels, self.model = kind, dict(params or {}), seed, levels, None

    def _encoding(self, df: DataFrame, target: str, weight: str | None) -> None:
        numbers = [n for n in self.names if is_numeric(df, n)]
        self.least = {}
        if numbers:
            low = df.agg(*(F.min(F.when(~missing(F.col(n), True), F.col(n).cast("double"))).alias(n) for n in numbers)).first()
            self.least = {n: (low[n] if low[n] is not None else 0.0) for n in numbers}
        self.ranks, w = {}, F.col(weight) if weight else F.lit(1.0)
        for n in self.names:
            if n not in self.least:
                rows = df.where(F.col(n).isNotNull()).groupBy(F.col(n).alias("level")).agg((F.sum(F.col(target) * w) / F.sum(w)).alias("rate")).limit(self.levels + 1).collect()
                if len(rows) > self.levels:
                    raise ValueError(f"{n} has more than {self.levels} levels: bin it first")
                self.ranks[n] = [r.level for r in sorted(rows, key=lambda r: (r.rate, r.level))]

    def _vector(self, df: DataFrame) -> DataFrame:
        def one(n: str):
            if n in self.least:
                return F.when(missing(F.col(n), True), F.lit(self.least[n] - 1.0)).otherwise(F.col(n).cast("double"))
            return F.coalesce(F.array_position(F.array(*map(F.lit, self.ranks[n])), F.col(n)).cast("double"), F.lit(0.0)) if self.ranks[n] else F.lit(0.0)

        held = [f"__{k}" for k in range(len(self.names))]
        wide = df.select("*", *(one(n).alias(h) for n, h in zip(self.names, held)))
        return VectorAssembler(inputCols=held, outputCol=FEATURES).transform(wide).drop(*held)

    def _as_weights(self) -> bool:
        """Whether equal rows may be one row with a weight: not where rows are drawn or counted one by one."""
        known = {"maxIter", "maxDepth", "maxBins", "stepSize", "minInfoGain", "minWeightFractionPerNode", "seed", "maxMemoryInMB", "cacheNodeIds", "checkpointInterval", "impurity", "lossType"}
        return self.kind == "gbt" and set(self.params) <= known

    def fit(self, df: DataFrame, target: str, names: Sequence[str] | None = None, weight: str | None = None) -> TreeModel:
        self.names = list(names or [c for c in df.columns if c not in (target, weight)])
        if self._as_weights():
            w = F.sum(weight) if weight else F.count("*").cast("double")
            df, weight = df.groupBy(*self.names, target).agg(w.alias("__w")), "__w"
        df = df.select(*self.names, target, *([weight] if weight else [])).persist()
        try:
            return self._fitted(df, target, weight)
        finally:
            df.unpersist()

    def _fitted(self, df: DataFrame, target: str, weight: str | None) -> TreeModel:
        n = df.count()
        if n > TASK_ROWS * df.rdd.getNumPartitions():
            df = df.repartition(-(-n // TASK_ROWS))
        self._encoding(df, target, weight)
        make = GBTClassifier if self.kind == "gbt" else RandomForestClassifier
        chosen = {"featuresCol": FEATURES, "labelCol": "__label", "seed": self.seed, **self.params, **({"weightCol": weight} if weight else {})}
        rows = self._vector(df).select(FEATURES, F.col(target).cast("double").alias("__label"), *([weight] if weight else []))
        self.model = make(**chosen).fit(rows)
        self.importances = dict(zip(self.names, map(float, self.model.featureImportances.toArray())))
        return self

    def transform(self, df: DataFrame, score: str | None = None) -> DataFrame:
        """df with the probability of label 1 (a column of that name is replaced) and, if named, the scaled score."""
        if self.model is None:
            raise RuntimeError("fit() comes first")
        found = self.model.transform(self._vector(df).drop("rawPrediction", "prediction", PROBABILITY))
        found = found.withColumn(PROBABILITY, vector_to_array(PROBABILITY)[1]).drop(FEATURES, "rawPrediction", "prediction")
        return found.withColumn(score, scaled_score(F.col(PROBABILITY))) if score else found


def tree_filter(df: DataFrame, target: str, names: Sequence[str] | None = None, least: float = 0.0, **model) -> list[str]:
    """The columns whose importance in an ensemble is above least."""
    found = TreeModel(**model).fit(df, target, names)
    return [n for n in found.names if found.importances[n] > least]


def permutation_importance(model: TreeModel, df: DataFrame, target: str, repeats: int = 5, seed: int = 123) -> DataFrame:
    """variable, importance, deviation: the rise of the mean log loss when a column is shuffled, over the repeats; 0 without rows.

    Rows are dealt to partitions by a hash of their values and their number among equal rows, so that equal rows go apart, and are
    shuffled within the batches that Python gets, so all copies of a batch are scored in one pass.
    """
    names, spark = model.names, df.sparkSession
    held = [*names, "__label"]
    cells = distinct_rows(df.withColumn("__label", F.col(target).cast("int")), held).persist()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(cells.agg(F.sum("__count")).first()[0] or 0) // TASK_ROWS))
    chunks = cells.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__count") - 1) / CHUNK)))).repartition(parts, *held, "__chunk")
    each = chunks.withColumn("__place", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("__count") - F.col("__chunk") * CHUNK).cast("int"))))
    by = F.xxhash64(F.lit(seed), *held, "__chunk", "__place")
    dealt = each.select(*held, by.alias("__by")).repartition(parts, "__by").sortWithinPartitions("__by").select(*held)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        for b in batches:
            for variant in range(-1, len(names) * repeats):
                columns = list(b.columns)
                if variant >= 0:
                    columns[variant // repeats] = columns[variant // repeats].take(pa.array(rng.permutation(b.num_rows)))
                yield pa.record_batch([*columns, pa.array(np.full(b.num_rows, variant, np.int32))], [*b.schema.names, "__variant"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", __variant int"
    scored = model.transform(dealt.mapInArrow(copies, schema))
    losses = {r["__variant"]: r.loss for r in scored.groupBy("__variant").agg(F.avg(log_loss(F.col("__label"), F.col(PROBABILITY))).alias("loss")).collect()}  # one number a copy
    cells.unpersist()
    rows = []
    for i, n in enumerate(names):
        rise = np.array([losses[i * repeats + k] - losses[-1] for k in range(repeats)]) if losses else np.zeros(1)
        rows.append((n, float(rise.mean()), float(rise.std())))
    return spark.createDataFrame(rows, "variable string, importance double, deviation double")


def cross_validated(df: DataFrame, target: str, names: Sequence[str], folds: int = 5, metric: str = "auc", seed: int = 123, share: float = 1.0, count: str | None = None, **model) -> list[float]:
    """The metric on each fold by a model of the others: auc, or neg_log_loss (higher is better). A fold without both labels is left out.

    count: a column of df that says for how many rows each stands.
    """
    parts, out = dealt(df, [*names, target], folds, seed, share=share, count=count).persist(), []
    both = {r["__fold"] for r in parts.groupBy("__fold").agg(F.countDistinct(target).alias("n")).where("n > 1").collect()}
    for k in sorted(both):
        scored = TreeModel(seed=seed, **model).fit(parts.where(F.col("__fold") != k), target, names, "__weight").transform(parts.where(F.col("__fold") == k))
        if metric == "auc":
            out.append(BinaryClassificationEvaluator(rawPredictionCol=PROBABILITY, labelCol=target, weightCol="__weight").evaluate(scored))
        else:
            loss = F.sum(log_loss(F.col(target), F.col(PROBABILITY)) * F.col("__weight")) / F.sum("__weight")
            out.append(-scored.agg(loss.alias("loss")).first().loss)
    parts.unpersist()
    return out


def sequential_selection(df: DataFrame, target: str, names: Sequence[str] | None = None, k: int = 5, forward: bool = True, floating: bool = False, **cv) -> list[tuple[tuple[str, ...], float]]:
    """The sets of columns step by step with their mean metric, the last of k columns: the best column comes in (or the least useful goes out) at each step.

    floating: after each step, steps back are taken while they beat the best set of that size so far. Ties go to the first column.
    """
    every = list(names or [c for c in df.columns if c != target])
    cells = distinct_rows(df, [*every, target]).persist()  # all trials read these
    tried: dict[frozenset, float] = {}

    def worth(chosen: Sequence[str]) -> float:
        key = frozenset(chosen)
        if key not in tried:
            tried[key] = float(np.mean(cross_validated(cells, target, [n for n in every if n in key], count="__count", **cv))) if key else -np.inf
        return tried[key]

    def step(held: list[str], add: bool) -> list[str]:
        options = [[*held, n] for n in every if n not in held] if add else [[m for m in held if m != n] for n in held]
        return max(options, key=worth)

    held = [] if forward else list(every)
    goal = max(1, min(k, len(every)))
    best: dict[int, float] = {}
    path = [] if forward else [(tuple(held), worth(held))]
    while len(held) != goal:
        held = step(held, forward)
        best[len(held)] = max(best.get(len(held), -np.inf), worth(held))
        path.append((tuple(n for n in every if n in held), worth(held)))
        while floating and len(held) != goal and (len(held) > 2 if forward else len(held) < len(every) - 1):
            back = step(held, not forward)
            if worth(back) <= best.get(len(back), -np.inf) + 1e-12:
                break
            held = back
            best[len(held)] = worth(held)
            path.append((tuple(n for n in every if n in held), worth(held)))
    cells.unpersist()
    return path


class ParameterSearch:
    """Searches a space {parameter: values} for the best mean metric over folds, then fits it on all rows.

    how: "grid" tries all, "random" n_iter of them, "tpe" n_iter, drawn by how much more often their values stand among the best quarter so far,
    "halving" all on a share of the rows, the best 1 / factor of them on factor times as many, until one is left or all rows are used.
    trials: (parameters, share of the rows, mean metric).
    """

    def __init__(self, space: Mapping[str, Sequence], how: str = "grid", n_iter: int = 10, factor: int = 3, kind: str = "gbt", fixed: Mapping | None = None, folds: int = 5, metric: str = "auc", seed: int = 123):
        if how not in ("grid", "random", "tpe", "halving"):
            raise ValueError("how is grid, random, tpe or halving")
        self.space, self.how, self.n_iter, self.factor, self.kind, self.fixed, self.folds, self.metric, self.seed = {k: list(v) for k, v in space.items()}, how, n_iter, factor, kind, dict(fixed or {}), folds, metric, seed
        self.trials: list[tuple[dict, float, float]] = []

    def _try(self, cells: DataFrame, target: str, names: Sequence[str], chosen: dict, share: float = 1.0) -> float:
        found = cross_validated(cells, target, names, self.folds, self.metric, self.seed, share, "__count", kind=self.kind, params={**self.fixed, **chosen})
        self.trials.append((chosen, share, float(np.mean(found)) if found else -np.inf))
        return self.trials[-1][2]

    def suggested(self, rng: np.random.Generator, left: list[dict]) -> dict:
        """Of the untried sets, one whose values are likelier among the best quarter of the trials than among the others."""
        ranked = sorted(self.trials, key=lambda t: -t[2])
        cut = max(1, len(ranked) // 4)
        if len(ranked) < 4:
            return left[rng.integers(len(left))]

        def odds(chosen: dict) -> float:
            share = lambda rows, k: (sum(t[0][k] == chosen[k] for t in rows) + 1) / (len(rows) + len(self.space[k]))
            return sum(np.log(share(ranked[:cut], k) / share(ranked[cut:], k)) for k in self.space)

        some = [left[i] for i in rng.permutation(len(left))[:24]]
        return max(some, key=odds)

    def fit(self, df: DataFrame, target: str, names: Sequence[str] | None = None) -> ParameterSearch:
        names = list(names or [c for c in df.columns if c != target])
        every = [dict(zip(self.space, values)) for values in product(*self.space.values())]
        rng, self.trials = np.random.default_rng(self.seed), []
        cells = distinct_rows(df, [*names, target]).persist()  # all trials read these
        if self.how == "halving":
            left, share = every, min(1.0, float(self.factor) ** -int(np.floor(np.log(max(len(every), 2)) / np.log(self.factor) + 1e-9)))
            while True:
                worth = [self._try(cells, target, names, c, share) for c in left]
                order = sorted(range(len(left)), key=lambda i: (-worth[i], i))
                left = [left[i] for i in order[: max(1, len(left) // self.factor)]]
                if len(left) == 1 or share >= 1:
                    break
                share = min(1.0, share * self.factor)
            self.best = left[0]
        else:
            left = list(every)
            for _ in range(len(every) if self.how == "grid" else min(self.n_iter, len(every))):
                chosen = left[0] if self.how == "grid" else left[rng.integers(len(left))] if self.how == "random" else self.suggested(rng, left)
                left.remove(chosen)
                self._try(cells, target, names, chosen)
            self.best = max(self.trials, key=lambda t: t[2])[0]
        self.model = TreeModel(self.kind, {**self.fixed, **self.best}, self.seed)
        self.model.fit(*((cells, target, names, "__count") if self.model._as_weights() else (df, target, names)))
        cells.unpersist()
        return self

    def transform(self, df: DataFrame, score: str | None = None) -> DataFrame:
        return self.model.transform(df, score)
