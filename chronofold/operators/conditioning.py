"""Conditioning of time series: statistics, normalising, downsampling, running medians.

Series are rows with an array column; every operator on them runs where the row is, without a shuffle.
The long forms (rows of t and value) are plain aggregates for series that are too long for one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.functions.numerics import half_away, positive
from chronofold.operators.dedisperse import batches_of


def checked(x: np.ndarray) -> np.ndarray:
    if not len(x):
        raise ValueError("time series is empty")
    if not np.isfinite(x).all():
        raise ValueError("time series has values that are not finite")
    return x


def stats(x: np.ndarray) -> tuple[float, float, float]:
    """Mean, population variance and standard deviation; a variance just below 0 counts as 0."""
    wide = checked(x).astype(np.float64)
    mean = float(wide.mean())
    var = float((wide * wide).mean()) - mean * mean
    if -1e-12 < var < 0:
        var = 0.0
    return mean, var, math.sqrt(var) if var >= 0 else math.nan


def normalise(x: np.ndarray, reject_constant: bool = True) -> np.ndarray:
    """Zero mean and unit deviation; a constant series is an error, or zeros."""
    mean, _, std = stats(x)
    if not std > 0:
        if reject_constant:
            raise ValueError("time series is constant")
        return np.zeros(len(x), np.float32)
    return ((x.astype(np.float64) - mean) * (1.0 / std)).astype(np.float32)


def downsampled_size(n: int, factor: float) -> int:
    if not (math.isfinite(factor) and 1 < factor <= n):
        raise ValueError("downsample factor must be above 1 and at most the number of samples")
    return int(n / factor)


def downsampled_variance(n: int, factor: float) -> float:
    """Variance of weighted sums of unit noise over intervals of ``factor`` samples."""
    downsampled_size(n, factor)
    whole = math.floor(factor)
    slip = math.floor(n / factor) * (factor - whole)
    return factor - 1 / 3 if slip > 1 else (whole - 1.0) ** 2 + 2 / 3 * slip**2 - slip + 1.0


def downsample(x: np.ndarray, factor: float) -> np.ndarray:
    """Sums over consecutive intervals of ``factor`` samples, samples at an edge counted by their overlap.

    Sums run from left to right in float32.
    """
    n = len(x)
    k = np.arange(downsampled_size(n, factor), dtype=np.float64)
    low, high = k * factor, (k + 1) * factor
    first = np.floor(low).astype(np.int64)
    last = np.minimum(np.floor(high).astype(np.int64), n - 1)
    out = (first + 1.0 - low).astype(np.float32) * x[first]
    for step in range(1, int((last - first).max(initial=1))):
        at = first + step
        inner = at < last
        out = np.where(inner, out + x[np.minimum(at, n - 1)], out)
    return out + (high - last).astype(np.float32) * x[last]


def median_window(seconds: float, tsamp: float) -> int:
    """An odd number of samples, at least 1, nearest to a length."""
    n = max(1, half_away(positive("window", seconds) / positive("tsamp", tsamp)))
    return n + 1 - n % 2


def running_median(x: np.ndarray, window: int) -> np.ndarray:
    """Median of a centred odd window; beyond the ends the end values go on."""
    if window <= 0 or window % 2 == 0:
        raise ValueError("median window must be odd and positive")
    if window >= len(x):
        raise ValueError("median window must be shorter than the series")
    if window == 1:
        return x.astype(np.float32)
    half = window // 2
    padded = np.concatenate([np.repeat(x[:1], half), x, np.repeat(x[-1:], half)])
    view = np.lib.stride_tricks.sliding_window_view(padded, window)
    rows = max(1, (1 << 22) // window)  # a bounded copy at a time
    return np.concatenate([np.partition(view[a : a + rows], half, axis=1)[:, half] for a in range(0, len(x), rows)]).astype(np.float32)


def scrunch(x: np.ndarray, factor: int) -> np.ndarray:
    """Means of whole blocks; a tail that fills no block drops out."""
    n = len(x) // factor
    return x[: n * factor].reshape(n, factor).astype(np.float64).mean(1).astype(np.float32)


def unscrunch(low: np.ndarray, factor: int, n: int) -> np.ndarray:
    """Linear interpolation between block centres, constant beyond the outer ones."""
    at = np.clip((np.arange(n) - 0.5 * (factor - 1)) / factor, 0, len(low) - 1)
    left = np.minimum(at.astype(np.int64), len(low) - 1)
    right = np.minimum(left + 1, len(low) - 1)
    part = at - left
    return (low[left] * (1 - part) + low[right] * part).astype(np.float32)


def fast_running_median(x: np.ndarray, window: int, min_points: int) -> np.ndarray:
    """A running median over block means, so that a window holds about ``min_points`` of them."""
    factor = max(1, int(window / min_points))
    if factor == 1:
        return running_median(x, window)
    low = scrunch(x, factor)
    if len(low) <= min_points:
        raise ValueError("the scrunched series must be longer than min_points")
    return unscrunch(running_median(low, min_points), factor, len(x))


@dataclass(frozen=True)
class Detrend:
    """Subtract a running median."""

    window: int = 101
    min_points: int = 101

    def __post_init__(self):
        for name, k in (("window", self.window), ("min_points", self.min_points)):
            if k <= 0 or k % 2 == 0:
                raise ValueError(f"{name} must be odd and positive")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return checked(x) - fast_running_median(x, self.window, self.min_points)


@dataclass(frozen=True)
class Normalise:
    reject_constant: bool = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return normalise(x, self.reject_constant)


@dataclass(frozen=True)
class Downsample:
    factor: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return downsample(checked(x), self.factor)


Step = Callable[[np.ndarray], np.ndarray]


def riptide_steps(tsamp: float, width_s: float = 5.0, min_points: int = 101, normalised: bool = True) -> tuple[Step, ...]:
    """The usual plan: detrend over a width in seconds, then normalise."""
    steps: list[Step] = [Detrend(median_window(width_s, tsamp), min_points)]
    return (*steps, Normalise()) if normalised else tuple(steps)


def preprocess(x: np.ndarray, steps: Sequence[Step]) -> np.ndarray:
    if not steps:
        raise ValueError("preprocess plan is empty")
    for step in steps:
        x = step(x)
    return x


def map_series(series: DataFrame, steps: Sequence[Step], column: str = "data") -> DataFrame:
    """``series`` with its array column put through the steps."""
    if not steps:
        raise ValueError("preprocess plan is empty")
    names = series.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [preprocess(x, steps) for x in batches_of(batch.column(at))]
            columns = list(batch.columns)
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.float32)
            columns[at] = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(series.dtypes) | {column: "array<float>"}
    return series.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def explode_series(series: DataFrame, keys: Sequence[str], column: str = "data") -> DataFrame:
    """(keys, t, value) of every series."""
    return series.select(*keys, F.posexplode(column).alias("t", "value")).select(*keys, F.col("t").cast("long").alias("t"), "value")


def long_stats(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, mean, variance, stddev) of long series: one partial and one final aggregate."""
    v = F.col(value).cast("double")
    found = rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.avg(v * v).alias("_sq"))
    var = F.col("_sq") - F.col("mean") * F.col("mean")
    var = F.when((var > -1e-12) & (var < 0), F.lit(0.0)).otherwise(var)
    return found.select(*keys, "mean", var.alias("variance"), F.sqrt(var).alias("stddev"))


def long_normalise(rows: DataFrame, keys: Sequence[str], value: str = "value", t: str = "t") -> DataFrame:
    """(keys, t, value) of long series at zero mean and unit deviation: one row of statistics joins each series."""
    scale = long_stats(rows, keys, value)
    shifted = (F.col(value).cast("double") - F.col("mean")) * (F.lit(1.0) / F.col("stddev"))
    return rows.join(scale, list(keys)).select(*keys, t, shifted.cast("float").alias("value"))


def long_scrunch(rows: DataFrame, keys: Sequence[str], factor: int, nsamples: int, value: str = "value", t: str = "t") -> DataFrame:
    """(keys, t, value): means of whole blocks of ``factor`` samples."""
    whole = nsamples // factor * factor
    block = F.floor(F.col(t) / factor).cast("long")
    return rows.where(F.col(t) < whole).groupBy(*keys, block.alias("t")).agg(F.avg(F.col(value).cast("double")).alias("value"))


def long_downsample(rows: DataFrame, keys: Sequence[str], factor: float, nsamples: int, value: str = "value", t: str = "t") -> DataFrame:
    """(keys, t, value): weighted sums, each sample dealt to the intervals that it overlaps."""
    n = downsampled_size(nsamples, factor)
    at = F.col(t).cast("double")
    low, high = F.floor(at / factor), F.ceil((at + 1) / factor) - 1
    dealt = rows.withColumn("_k", F.explode(F.sequence(low.cast("long"), F.greatest(low, high).cast("long")))).where(F.col("_k") < n)
    weight = F.least(at + 1, (F.col("_k") + 1) * F.lit(float(factor))) - F.greatest(at, F.col("_k") * F.lit(float(factor)))
    return dealt.groupBy(*keys, F.col("_k").alias("t")).agg(F.sum(weight * F.col(value)).alias("value"))


def long_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str):
    """The value of a column in the row before, within its keys."""
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
