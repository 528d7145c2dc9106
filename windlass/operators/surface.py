"""Surface fits by normal equations: the data is reduced to sums of monomials, whatever its size, and solved once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monomials(x: Column, y: Column, degree: int) -> list[Column]:
    power = lambda v, n: F.lit(1.0) if n == 0 else F.pow(v, F.lit(float(n)))
    return [power(x, i) * power(y, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def ridge_fit(points: DataFrame, x: Column, y: Column, z: Column, degree: int, alpha: float) -> list[float]:
    """Coefficients of z = sum c * x**i * y**j with a penalty of alpha on all but the constant."""
    terms = monomials(x, y, degree)
    n = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(t * z).alias(f"b{i}") for i, t in enumerate(terms)]
    row = points.agg(*sums).first()
    a, b = np.zeros((n, n)), np.array([row[f"b{i}"] or 0.0 for i in range(n)])
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    penalty = alpha * np.eye(n)
    penalty[0, 0] = 0.0
    return np.linalg.lstsq(a + penalty, b, rcond=None)[0].tolist()


def trimmed_fit(points: DataFrame, x: Column, y: Column, z: Column, degree: int, alpha: float, rounds: int = 3, keep: float = 0.8) -> list[float]:
    """Refits on the rows within the `keep` quantile of the last residuals."""
    coefficients = ridge_fit(points, x, y, z, degree, alpha)
    for _ in range(rounds):
        r = F.abs(z - sum((F.lit(c) * t for c, t in zip(coefficients, monomials(x, y, degree), strict=True)), F.lit(0.0)))
        limit = points.select(r.alias("r")).approxQuantile("r", [keep], 0.001)[0]
        coefficients = ridge_fit(points.where(r <= limit), x, y, z, degree, alpha)
    return coefficients
