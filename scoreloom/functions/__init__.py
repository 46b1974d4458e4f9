"""Column functions of scores: scaled scores, logistic link and focal loss."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def scaled_score(p: Column, pdo: float = 75.0, base: float = 660.0, ratio: float = 1 / 15) -> Column:
    """round(A - B * log-odds); halves go to even. Null for a probability of 0 or 1."""
    b = pdo / math.log(2)
    return F.bround(F.lit(base + b * math.log(ratio)) - F.lit(b) * F.log(F.try_divide(p, 1 - p)))


def log_loss(y: Column, p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -(y * F.log(held) + (1 - y) * F.log(1 - held))


def focal_loss(y: Column, p: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """-a * (1 - pt) ** gamma * log(pt), pt the probability of what is so, kept off 0 and 1 by 1e-15."""
    held = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    pt, a = F.when(y == 1, held).otherwise(1 - held), F.when(y == 1, alpha).otherwise(1 - alpha)
    return -a * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)


def focal_gradient(y: Column, p: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """The derivative of focal_loss by the log-odds."""
    held = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    sign, pt, a = 2 * y - 1, F.when(y == 1, held).otherwise(1 - held), F.when(y == 1, alpha).otherwise(1 - alpha)
    return a * sign * F.pow(1 - pt, F.lit(gamma)) * (gamma * pt * F.log(pt) + pt - 1)


def focal_hessian(y: Column, p: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """The second derivative of focal_loss by the log-odds."""
    held = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    pt, a = F.when(y == 1, held).otherwise(1 - held), F.when(y == 1, alpha).otherwise(1 - alpha)
    inner = gamma * pt * F.log(pt) + pt - 1
    return a * pt * F.pow(1 - pt, F.lit(gamma)) * ((1 - pt) * (gamma * F.log(pt) + gamma + 1) - gamma * inner)
