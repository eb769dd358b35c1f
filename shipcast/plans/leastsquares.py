"""Least squares by QR factors of row blocks, merged a few at a time.

Each task reduces its rows to the triangular factor of [1, x, y]; factors are
stacked and factored again until one is left.  The normal matrix is never formed,
so columns that nearly repeat each other keep their digits.  The last factor (as
many numbers as the square of the columns) goes to the driver and holds all there
is to know: coefficients, standard errors, R^2, and the map that gives leverages.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FAN_IN = 16
INTERCEPT = "(Intercept)"


def _factor(rows: np.ndarray) -> np.ndarray:
    """Square upper triangular factor of ``rows`` (padded with zeros where there are fewer rows than columns)."""
    r = np.linalg.qr(rows, mode="r")
    if len(r) < rows.shape[1]:
        r = np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])
    return r


def triangular_factor(df: DataFrame, columns: list[str], fan_in: int = FAN_IN) -> tuple[np.ndarray, int]:
    """(R, n): factor of the matrix of ``columns`` over rows without a missing value, and their number."""
    width = len(columns)
    # incomplete rows are left out in the batches: a filter on all columns under these new names would have the
    # optimizer list every mixture of old and new names (2 to the number of columns) when the factors are checkpointed
    data = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("r", pa.list_(pa.float64()))])

    def local(batches):
        from pyspark import TaskContext
        r, n = np.zeros((width, width)), 0
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = rows[~np.isnan(rows).any(axis=1)]  # a missing value is NaN here
            if len(rows):
                r, n = _factor(np.vstack([r, rows])), n + len(rows)
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "r": [r.ravel().tolist()]}, schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        stacked = table.column("r").combine_chunks().flatten().to_numpy().reshape(-1, width)
        return pa.table({"part": [table.column("part")[0].as_py() // fan_in], "n": [sum(table.column("n").to_pylist())],
                         "r": [_factor(stacked).ravel().tolist()]}, schema=schema)

    kinds = "part long, n long, r array<double>"
    parts = cut_lineage(data.mapInArrow(local, kinds))
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return np.zeros((width, width)), 0
    while last > 0:
        parts = parts.groupBy(F.expr(f"part div {fan_in}")).applyInArrow(merge, kinds)
        last //= fan_in
    row = parts.first()
    return np.array(row["r"]).reshape(width, width), row["n"]


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz rounds)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, dof: int) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    if math.isnan(t) or math.isinf(t):
        return math.nan if math.isnan(t) else 0.0
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@dataclass
class LeastSquares:
    """y ~ 1 + predictors.  Where columns depend on each other the shortest of the equal solutions is taken."""

    predictors: list[str]
    n: int
    factor: np.ndarray  # of [1, x], each column over its length
    lengths: np.ndarray
    beta: np.ndarray  # intercept first
    sse: float
    sst: float

    @property
    def intercept(self) -> float:
        return float(self.beta[0])

    @property
    def coefficients(self) -> list[float]:
        return [float(b) for b in self.beta[1:]]

    @property
    def r2(self) -> float:
        return 1 - self.sse / self.sst if self.sst > 0 else math.nan

    @property
    def dof(self) -> int:
        return self.n - len(self.predictors) - 1

    @property
    def sigma(self) -> float:
        return math.sqrt(self.sse / self.dof) if self.dof > 0 else math.nan

    def inverse(self) -> np.ndarray:
        """W with leverage(x) = |W' [1, x]|^2."""
        return np.linalg.pinv(self.factor, rcond=1e-13) / self.lengths[:, None]

    def std_errors(self) -> np.ndarray:
        return self.sigma * np.sqrt((self.inverse() ** 2).sum(axis=1))

    def fitted(self) -> Column:
        return F.lit(self.intercept) + sum((F.lit(c) * F.col(x).cast("double") for c, x in zip(self.coefficients, self.predictors)),
                                           F.lit(0.0))

    def leverage(self) -> Column:
        terms = [F.lit(1.0)] + [F.col(x).cast("double") for x in self.predictors]
        w = self.inverse()
        rows = [sum(F.lit(float(w[j, k])) * t for j, t in enumerate(terms)) for k in range(len(terms))]
        return sum(r * r for r in rows)


def least_squares(df: DataFrame, label: str, predictors: list[str], fan_in: int = FAN_IN) -> LeastSquares:
    """Fit over the rows of ``df`` without a missing label or predictor."""
    one = "_one"
    r, n = triangular_factor(df.withColumn(one, F.lit(1.0)), [one, *predictors, label], fan_in)
    x, y = r[:-1, :-1], r[:-1, -1]
    lengths = np.sqrt((x * x).sum(axis=0))
    lengths[lengths == 0] = 1.0
    scaled = x / lengths
    beta = np.linalg.lstsq(scaled, y, rcond=1e-13)[0] / lengths
    sse = float(r[-1, -1] ** 2 + ((y - x @ beta) ** 2).sum())
    return LeastSquares(list(predictors), n, scaled, lengths, beta, sse, float((r[1:, -1] ** 2).sum()))
