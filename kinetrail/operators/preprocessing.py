"""Scalers, imputers and filters over feature arrays.

Fitted numbers come from one aggregation with an expression for each feature, so
Spark aggregates partially before the shuffle; transforms are array expressions.
Feature numbers are fixed at ``fit`` from the first row.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.plans.trajectories import Trajectories


def width_of(df: DataFrame, features: str) -> int:
    """Number of features, by the first row that has any."""
    row = df.where(F.col(features).isNotNull()).select(F.size(features)).first()
    if row is None:
        raise ValueError("no row has features")
    return row[0]


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def each(features: str, n: int, *functions) -> list[Column]:
    """Aggregates of every feature, ``f{k}_{i}`` for function k and feature i."""
    return [f(F.col(features)[i].cast("double")).alias(f"f{k}_{i}") for k, f in enumerate(functions) for i in range(n)]


class Transformer:
    """``fit`` learns numbers, ``transform`` replaces the column ``features`` or writes ``out``."""

    features = "features"

    def fit(self, df: DataFrame) -> Transformer:
        return self

    def expression(self, x: Column) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        return df.withColumn(out or self.features, self.expression(F.col(self.features)))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _stats(self, df: DataFrame, *functions) -> list[np.ndarray]:
        n = self.n_features_ = width_of(df, self.features)
        row = df.agg(*each(self.features, n, *functions)).first()
        return [np.array([np.nan if row[f"f{k}_{i}"] is None else float(row[f"f{k}_{i}"]) for i in range(n)]) for k in range(len(functions))]


class _Scaler(Transformer):
    """(x - centre) / scale, with scales of 0 taken as 1."""

    def __init__(self, features: str = "features"):
        self.features = features

    def _set(self, centre, scale) -> _Scaler:
        self.center_ = np.asarray(centre, float)
        self.scale_ = np.where(np.asarray(scale, float) == 0, 1.0, scale)
        return self

    def expression(self, x: Column) -> Column:
        pairs = F.arrays_zip(x.alias("x"), literal(self.center_).alias("c"), literal(self.scale_).alias("s"))
        return F.transform(pairs, lambda p: (p["x"] - p["c"]) / p["s"])

    def inverse(self, x: Column) -> Column:
        pairs = F.arrays_zip(x.alias("x"), literal(self.center_).alias("c"), literal(self.scale_).alias("s"))
        return F.transform(pairs, lambda p: p["x"] * p["s"] + p["c"])


class StandardScaler(_Scaler):
    """Zero mean and unit population variance. ``partial_fit`` adds more data to the moments."""

    n_: np.ndarray | None = None

    def fit(self, df: DataFrame) -> StandardScaler:
        self.n_ = None
        return self.partial_fit(df)

    def partial_fit(self, df: DataFrame) -> StandardScaler:
        n, mean, m2 = self._stats(df, F.count, F.avg, lambda c: F.var_pop(c) * F.count(c))
        if self.n_ is None:
            self.n_, self.mean_, self.m2_ = n, mean, m2
        else:  # moments of two parts together
            total, delta = self.n_ + n, mean - self.mean_
            self.m2_ = self.m2_ + m2 + delta**2 * self.n_ * n / total
            self.mean_ = self.mean_ + delta * n / total
            self.n_ = total
        self.var_ = self.m2_ / self.n_
        return self._set(self.mean_, np.sqrt(self.var_))


class MinMaxScaler(_Scaler):
    """To the range 0 to 1."""

    def fit(self, df: DataFrame) -> MinMaxScaler:
        low, high = self._stats(df, F.min, F.max)
        return self._set(low, high - low)


class MaxAbsScaler(_Scaler):
    def fit(self, df: DataFrame) -> MaxAbsScaler:
        (most,) = self._stats(df, lambda c: F.max(F.abs(c)))
        return self._set(np.zeros(len(most)), most)


class RobustScaler(_Scaler):
    """(x - median) / interquartile range, with exact linear-interpolated percentiles.

    With ``accuracy`` the percentiles are approximate and the aggregation of bounded size, for data of any size.
    """

    def __init__(self, features: str = "features", accuracy: int | None = None):
        super().__init__(features)
        self.accuracy = accuracy

    def fit(self, df: DataFrame) -> RobustScaler:
        f = (lambda p: lambda c: F.percentile_approx(c, p, self.accuracy)) if self.accuracy else (lambda p: lambda c: F.percentile(c, F.lit(p)))
        q1, median, q3 = self._stats(df, f(0.25), f(0.5), f(0.75))
        return self._set(median, q3 - q1)


class Normalizer(Transformer):
    """Each row to norm 1 in ``l1``, ``l2`` or ``max``; a row of zeros stays."""

    def __init__(self, norm: str = "l2", features: str = "features"):
        if norm not in ("l1", "l2", "max"):
            raise ValueError(f"unknown norm {norm!r}")
        self.norm, self.features = norm, features

    def expression(self, x: Column) -> Column:
        if self.norm == "max":
            size = F.array_max(F.transform(x, F.abs))
        else:
            part = (lambda v: F.abs(v)) if self.norm == "l1" else (lambda v: v * v)
            size = F.aggregate(x, F.lit(0.0), lambda a, v: a + part(v.cast("double")))
            size = size if self.norm == "l1" else F.sqrt(size)
        return F.transform(x, lambda v: v / F.when(size == 0, F.lit(1.0)).otherwise(size))


class Binarizer(Transformer):
    def __init__(self, threshold: float = 0.0, features: str = "features"):
        self.threshold, self.features = threshold, features

    def expression(self, x: Column) -> Column:
        return F.transform(x, lambda v: F.when(v > self.threshold, 1.0).otherwise(0.0))


class Imputer(Transformer):
    """NULL and NaN to the mean, median or most frequent value of the feature."""

    def __init__(self, strategy: str = "mean", features: str = "features"):
        if strategy not in ("mean", "median", "most_frequent"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.strategy, self.features = strategy, features

    def fit(self, df: DataFrame) -> Imputer:
        known = lambda c: F.when(~F.isnan(c), c)
        f = {"mean": lambda c: F.avg(known(c)), "median": lambda c: F.percentile(known(c), F.lit(0.5)), "most_frequent": lambda c: F.mode(known(c), True)}
        (self.statistics_,) = self._stats(df, f[self.strategy])
        return self

    def expression(self, x: Column) -> Column:
        pairs = F.arrays_zip(x.alias("x"), literal(self.statistics_).alias("s"))
        return F.transform(pairs, lambda p: F.when(p["x"].isNull() | F.isnan(p["x"]), p["s"]).otherwise(p["x"]))


class VarianceThreshold(Transformer):
    """Features whose population variance exceeds a threshold."""

    def __init__(self, threshold: float = 0.0, features: str = "features"):
        self.threshold, self.features = threshold, features

    def fit(self, df: DataFrame) -> VarianceThreshold:
        (self.variances_,) = self._stats(df, F.var_pop)
        self.support_ = np.flatnonzero(self.variances_ > self.threshold)
        if not len(self.support_):
            raise ValueError("no feature exceeds the threshold")
        return self

    def expression(self, x: Column) -> Column:
        return F.array(*(x[int(i)] for i in self.support_))


class PolynomialFeatures(Transformer):
    """All monomials up to a degree, the constant first, then by degree and feature."""

    def __init__(self, degree: int = 2, interaction_only: bool = False, include_bias: bool = True, features: str = "features"):
        self.degree, self.interaction_only, self.include_bias, self.features = degree, interaction_only, include_bias, features

    def fit(self, df: DataFrame) -> PolynomialFeatures:
        n = width_of(df, self.features)
        pick = combinations if self.interaction_only else combinations_with_replacement
        self.powers_ = [p for d in range(0 if self.include_bias else 1, self.degree + 1) for p in pick(range(n), d)]
        return self

    def expression(self, x: Column) -> Column:
        def term(power: tuple[int, ...]) -> Column:
            out = F.lit(1.0)
            for i in power:
                out = out * x[i]
            return out

        return F.array(*(term(p) for p in self.powers_))


class FunctionTransformer(Transformer):
    """A user's function of a matrix (rows, features), run on Arrow batches."""

    def __init__(self, func, features: str = "features"):
        self.func, self.features = func, features

    def expression(self, x: Column) -> Column:
        func = self.func

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def apply(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.asarray(func(np.stack(rows.to_numpy())), float)))

        return apply(x)


class LabelBinarizer:
    """A label to a row with a 1 at its place among the sorted labels."""

    def fit(self, df: DataFrame, label: str) -> LabelBinarizer:
        self.classes_ = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
        return self

    def transform(self, df: DataFrame, label: str, out: str = "features") -> DataFrame:
        return df.withColumn(out, F.array(*(F.when(F.col(label) == c, 1.0).otherwise(0.0) for c in self.classes_)))


class MultiLabelBinarizer(LabelBinarizer):
    """A set of labels to a row with a 1 for each that it holds."""

    def fit(self, df: DataFrame, labels: str) -> MultiLabelBinarizer:
        return super().fit(df.select(F.explode(labels).alias(labels)), labels)

    def transform(self, df: DataFrame, labels: str, out: str = "features") -> DataFrame:
        return df.withColumn(out, F.array(*(F.when(F.array_contains(labels, c), 1.0).otherwise(0.0) for c in self.classes_)))


def center_kernel(k: DataFrame, row: str = "i", column: str = "j", value: str = "k") -> DataFrame:
    """A kernel in coordinates, doubly centred: minus its row and column means, plus the grand mean."""
    rows = k.groupBy(row).agg(F.avg(value).alias("__r"))
    columns = k.groupBy(column).agg(F.avg(value).alias("__c"))
    grand = k.agg(F.avg(value).alias("__g"))  # one row
    out = k.join(rows, row).join(columns, column).crossJoin(F.broadcast(grand))
    return out.select(row, column, (F.col(value) - F.col("__r") - F.col("__c") + F.col("__g")).alias(value))


# --- filters along a trajectory: one trajectory is a group, and must fit a worker ---


def _grouped(t: Trajectories, f) -> DataFrame:
    """``traj_id``, ``frame``, ``features`` with a function of each trajectory's matrix applied."""
    frames = t.frames().select("traj_id", "frame", "features")
    schema = T.StructType([frames.schema["traj_id"], frames.schema["frame"], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        out = f(np.stack(pdf["features"].to_numpy()).astype(float))
        return pdf.assign(features=list(np.asarray(out, float)))

    return frames.groupBy("traj_id").applyInPandas(apply, schema)


def butterworth_coefficients(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital low-pass of an order at a share of the Nyquist frequency: prewarped analogue poles, bilinear transform."""
    warped = 2 * np.tan(np.pi * cutoff / 2)
    k = np.arange(1, order + 1)
    poles = warped * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    z = (2 + poles) / (2 - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """One pass of the recursion over rows, from the given state of delays."""
    out, z = np.empty_like(x), z.copy()
    for i, v in enumerate(x):
        out[i] = b[0] * v + z[0]
        z[:-1] = z[1:]
        z[-1] = 0
        z += b[1:, None] * v - a[1:, None] * out[i]
    return out


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Delays under a constant input of 1."""
    n = len(a) - 1
    m = np.eye(n) - np.eye(n, k=1) + np.outer(a[1:], np.eye(n)[0])
    return np.linalg.solve(m, b[1:] - a[1:] * b[0])


def butterworth(t: Trajectories, width: int = 5, order: int = 3) -> DataFrame:
    """Zero-phase Butterworth low-pass: forward and backward over oddly reflected ends. An even width is made odd."""
    width += width % 2 == 0
    b, a = butterworth_coefficients(order, 2.0 / width)
    zi = _steady(b, a)[:, None]

    def both(x: np.ndarray) -> np.ndarray:
        pad = min(width, len(x) - 1)
        y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
        for _ in range(2):
            y = _filtered(b, a, y, zi * y[0])[::-1]
        return y[pad : len(y) - pad] if pad else y

    return _grouped(t, both)


def _alpha(com: float | None, span: float | None, halflife: float | None) -> float:
    given = [x for x in (com, span, halflife) if x is not None]
    if len(given) != 1:
        raise ValueError("exactly one of com, span and halflife is needed")
    return 1 / (1 + com) if com is not None else 2 / (span + 1) if span is not None else 1 - np.exp(np.log(0.5) / halflife)


def ewma(t: Trajectories, com: float | None = None, span: float | None = None, halflife: float | None = None, min_periods: int = 0, adjust: bool = True) -> DataFrame:
    """Exponentially weighted mean of each feature along each trajectory; NaN before ``min_periods`` frames."""
    alpha = _alpha(com, span, halflife)
    return _grouped(t, lambda x: pd.DataFrame(x).ewm(alpha=alpha, min_periods=min_periods, adjust=adjust).mean().to_numpy())


def double_ewma(t: Trajectories, com: float | None = None, span: float | None = None, halflife: float | None = None, min_periods: int = 0, adjust: bool = True, literal_order: bool = False) -> DataFrame:
    """Mean of the forward and the backward exponentially weighted means.

    ``literal_order`` leaves the backward pass in reversed order, as some tools do.
    """
    alpha = _alpha(com, span, halflife)

    def both(x: np.ndarray) -> np.ndarray:
        f = pd.DataFrame(x).ewm(alpha=alpha, min_periods=min_periods, adjust=adjust).mean().to_numpy()
        b = pd.DataFrame(x[::-1]).ewm(alpha=alpha, min_periods=min_periods, adjust=adjust).mean().to_numpy()
        return (f + (b if literal_order else b[::-1])) / 2

    return _grouped(t, both)
