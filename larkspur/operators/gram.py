"""The linear family from sufficient statistics.

Least squares, ridge and lasso depend on the rows only through their number,
the means and the scatter matrix of (features, label). One scan gives these
moments per cell of rows, a cell being for instance a fold, or a fold and a
tenth of the rows; moments of any union of cells follow by merging. So every
fold, training share and penalty is fitted and scored from that one scan: the
squared error of held-out rows is a quadratic form in their moments.

Moments are centred (Chan's merge), so large offsets such as years or prices
cost no digits. Each task adds up its rows cell by cell with matrix products
and hands on one row per cell; those are merged in two steps, by (cell, salt)
and by cell. What reaches the driver is one row per cell, whose size depends on
the number of features alone.

Rows with a NULL or NaN feature or label take part in no cell (an imputer comes
first); the moments count them as ``skipped``. An empty table has no cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split import SPLIT_SEED, assign_folds, with_curve_share

LINEAR_FAMILY = ("linear_regression", "ridge", "lasso")
MERGE_SALTS = 32      # partial merges of one cell
LASSO_TOL = 1e-10     # largest step of a sweep, relative to the label's spread
LASSO_SWEEPS = 100_000


@dataclass
class Moments:
    """Rows, means and centred scatter of (features..., label)."""
    n: float
    mean: np.ndarray
    scatter: np.ndarray
    skipped: int = 0

    @classmethod
    def of(cls, rows: np.ndarray, skipped: int = 0) -> Moments:
        width = rows.shape[1]
        if not len(rows):
            return cls(0.0, np.zeros(width), np.zeros((width, width)), skipped)
        mean = rows.mean(axis=0)
        centred = rows - mean
        return cls(float(len(rows)), mean, centred.T @ centred, skipped)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        skipped = self.skipped + other.skipped
        if not self.n or not other.n:
            full = self if self.n else other
            return Moments(n, full.mean, full.scatter, skipped)
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n),
                       self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n), skipped)


def merged(parts: Iterable[Moments]) -> Moments:
    total = None
    for part in parts:
        total = part if total is None else total + part
    if total is None:
        raise ValueError("no moments to merge")
    return total


@dataclass
class LinearFit:
    coefficients: np.ndarray
    intercept: float

    def squared_error(self, held: Moments) -> float:
        """Sum of squared residuals of the rows behind ``held``."""
        b = np.append(-self.coefficients, 1.0)     # residual = b . (x, y) - intercept
        offset = float(b @ held.mean) - self.intercept
        return max(float(b @ held.scatter @ b), 0.0) + held.n * offset * offset

    def r2(self, held: Moments) -> float:
        total = float(held.scatter[-1, -1])
        error = self.squared_error(held)
        if total == 0:
            return 1.0 if error == 0 else 0.0
        return 1.0 - error / total

    def rmse(self, held: Moments) -> float:
        return float(np.sqrt(self.squared_error(held) / held.n))


def fit_linear(m: Moments, family: str = "linear_regression", alpha: float = 1.0) -> LinearFit:
    """Least squares (least norm among equals), ridge |r|^2 + alpha |w|^2, or
    lasso |r|^2 / 2n + alpha |w|_1; the intercept is free."""
    if not m.n:
        raise ValueError("no rows to fit")
    gram, target = m.scatter[:-1, :-1], m.scatter[:-1, -1]
    if family == "linear_regression":
        # columns scaled to unit length: the rank decision does not depend on units
        size = np.sqrt(np.diag(gram))
        unit = np.where(size > 0, size, 1.0)
        w = np.linalg.pinv(gram / np.outer(unit, unit), rcond=1e-10, hermitian=True) @ (target / unit) / unit
    elif family == "ridge":
        w = np.linalg.solve(gram + alpha * np.eye(len(target)), target)
    elif family == "lasso":
        w = _lasso(gram, target, m.n * alpha, m.scatter[-1, -1])
    else:
        raise ValueError(f"{family!r} is not one of {LINEAR_FAMILY}")
    return LinearFit(w, float(m.mean[-1] - w @ m.mean[:-1]))


def _lasso(gram: np.ndarray, target: np.ndarray, penalty: float, spread: float) -> np.ndarray:
    """Coordinate descent on the Gram matrix."""
    w, size = np.zeros(len(target)), np.diag(gram)
    slope = target.copy()                      # target - gram @ w
    limit = LASSO_TOL * np.sqrt(max(spread, np.finfo(float).tiny))
    for _ in range(LASSO_SWEEPS):
        largest = 0.0
        for j in np.flatnonzero(size > 0):
            pull = slope[j] + size[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / size[j]
            step = new - w[j]
            if step:
                slope -= gram[:, j] * step
                w[j] = new
                largest = max(largest, abs(step) * np.sqrt(size[j]))
        if largest <= limit:
            return w
    raise ArithmeticError("lasso did not settle")


# ------------------------------------------------------------------ one scan

def _schema(keys: Sequence[T.StructField], extra: Sequence[T.StructField] = ()) -> T.StructType:
    number = T.ArrayType(T.DoubleType())
    return T.StructType([*keys, T.StructField("n", T.DoubleType()), T.StructField("mean", number),
                         T.StructField("scatter", number), T.StructField("skipped", T.LongType()), *extra])


def _row(m: Moments) -> list:
    return [m.n, m.mean.tolist(), m.scatter.ravel().tolist(), m.skipped]


def _moments(n, mean, scatter, skipped) -> Moments:
    mean = np.asarray(mean, float)
    return Moments(n, mean, np.asarray(scatter, float).reshape(len(mean), len(mean)), skipped)


def moments(df: DataFrame, features: Sequence[str], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean, scatter row by row, skipped): one row per cell."""
    columns, by = [*features, label], list(by)
    keys = [T.StructField(c, df.schema[c].dataType) for c in by]
    part = T.StructField("salt", T.IntegerType())
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)],
                     (F.spark_partition_id() % MERGE_SALTS).alias("salt"))
    out = _schema(keys, [part])
    types = _arrow(out)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, Moments] = {}
        salt = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            salt = batch.column(batch.num_columns - 1)[0].as_py()
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True)) if by else [()] * batch.num_rows
            values = np.column_stack([batch.column(len(by) + i).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            whole = np.isfinite(values).all(axis=1)
            number = {name: i for i, name in enumerate(dict.fromkeys(names))}
            cell = np.fromiter((number[n] for n in names), int, len(names))
            for name, i in number.items():
                here = cell == i
                got = Moments.of(values[here & whole], int((here & ~whole).sum()))
                cells[name] = cells[name] + got if name in cells else got
        if cells:
            yield _batch([[*name, *_row(m), salt] for name, m in cells.items()], out, types)

    partial = rows.mapInArrow(add_up, out)
    salted = partial.groupBy(*by, "salt").applyInArrow(_merger(by, out, ["salt"]), out)
    final = _schema(keys)
    if not by:
        return salted.groupBy(F.lit(0).alias("_all")).applyInArrow(_merger([], final, []), final)
    return salted.drop("salt").groupBy(*by).applyInArrow(_merger(by, final, []), final)


def _merger(by: list[str], out: T.StructType, tail: list[str]):
    types, names = _arrow(out), [*by, *tail]

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = merged(_moments(r["n"], r["mean"], r["scatter"], r["skipped"]) for r in rows)
        first = rows[0]
        row = [*[first[c] for c in by], *_row(total), *[first[c] for c in names[len(by):]]]
        return pa.Table.from_batches([_batch([row], out, types)])

    return merge


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(f.dataType) for f in schema.fields]


def _batch(rows: list[list], schema: T.StructType, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=[f.name for f in schema.fields])


def cells(df: DataFrame, features: Sequence[str], label: str = "label", by: Sequence[str] = ()) -> dict[tuple, Moments]:
    """The moments of every cell, on the driver: one small row per cell."""
    return {tuple(r[c] for c in by): _moments(r["n"], r["mean"], r["scatter"], r["skipped"])
            for r in moments(df, features, label, by).collect()}


# ---------------------------------------------------------------- operators

def _folds(found: dict[tuple, Moments]) -> Iterator[tuple[int, Moments, Moments]]:
    """(fold, moments of the other folds, moments of the fold)."""
    for (fold,), held in sorted(found.items()):
        rest = [m for other, m in found.items() if other != (fold,)]
        if rest and held.n:
            yield fold, merged(rest), held


def fold_scores(df: DataFrame, features: Sequence[str], label: str = "label", variants: dict[str, tuple[str, float]] | None = None,
                k: int = 5, key: str = "id", seed: int = SPLIT_SEED, fold_col: str = "fold") -> DataFrame:
    """R2 of every variant (name -> (family, alpha)) on each of k hash folds:
    (variant, ordinal, fold, n_train, n, r2_score), from one scan."""
    variants = variants or {f: (f, 1.0) for f in LINEAR_FAMILY}
    found = cells(assign_folds(df, key, k, seed, fold_col), features, label, [fold_col])
    rows = []
    for fold, train, held in _folds(found):
        for i, (name, (family, alpha)) in enumerate(variants.items(), 1):
            rows.append((name, i, int(fold), int(train.n), int(held.n), fit_linear(train, family, alpha).r2(held)))
    return df.sparkSession.createDataFrame(
        rows, "variant string, ordinal int, fold int, n_train long, n long, r2_score double")


def alpha_grid(df: DataFrame, features: Sequence[str], label: str = "label", family: str = "ridge", alphas: Sequence[float] = (1.0,),
               k: int = 3, key: str = "id", seed: int = SPLIT_SEED,
               validating: int | None = None) -> tuple[float, LinearFit, list[tuple[float, float]]]:
    """M10 for one penalty: (best alpha, its fit on all rows, [(alpha, mean R2
    over the folds, or over the first ``validating`` of them)]); of equal means
    the first alpha wins."""
    found = cells(assign_folds(df, key, k, seed, "_fold"), features, label, ["_fold"])
    folds = list(_folds(found))[:validating]
    scores = [(a, float(np.mean([fit_linear(train, family, a).r2(held) for _, train, held in folds]))) for a in alphas]
    best = max(range(len(scores)), key=lambda i: (scores[i][1], -i))
    return scores[best][0], fit_linear(merged(found.values()), family, scores[best][0]), scores


def learning_curve(df: DataFrame, features: Sequence[str], label: str = "label", family: str = "linear_regression", alpha: float = 1.0,
                   k: int = 5, steps: int = 10, key: str = "id", seed: int = SPLIT_SEED) -> DataFrame:
    """For each of ``steps`` nested shares of the training folds and each of
    k folds: (fraction, fold, n_train, train_r2, validation_r2). Cells are
    (fold, step in which a row joins), so all fits come from one scan."""
    shared = with_curve_share(assign_folds(df, key, k, seed, "_fold"), key, seed, col="_share")
    joined = shared.withColumn("_step", F.least(F.floor(F.col("_share") * steps), F.lit(steps - 1)).cast("int"))
    found = cells(joined, features, label, ["_fold", "_step"])
    folds = sorted({fold for fold, _ in found})
    rows = []
    for fold in folds:
        held = merged(m for (f, _), m in found.items() if f == fold)
        for step in range(1, steps + 1):
            parts = [m for (f, s), m in found.items() if f != fold and s < step]
            if not parts or not held.n:
                continue
            train = merged(parts)
            fit = fit_linear(train, family, alpha)
            rows.append((step / steps, int(fold), int(train.n), fit.r2(train), fit.r2(held)))
    return df.sparkSession.createDataFrame(
        rows, "fraction double, fold int, n_train long, train_r2 double, validation_r2 double")


def curve_spread(curve: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds, per fraction."""
    return curve.groupBy("fraction").agg(
        F.count("*").alias("folds"), F.avg("train_r2").alias("train_mean"), F.stddev_pop("train_r2").alias("train_std"),
        F.avg("validation_r2").alias("validation_mean"), F.stddev_pop("validation_r2").alias("validation_std"))
