"""Scalar rules that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Dispersion constant, MHz^2 s cm^3 / pc.
DISPERSION = 4148.808


def half_away(x: float) -> int:
    """Round to the nearest integer, halves away from zero (as SQL's round does; numpy's does not)."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x)) if abs(x) < 2**52 else int(x)


def finite(name: str, x: float) -> float:
    if not math.isfinite(x):
        raise ValueError(f"{name} must be finite")
    return x


def positive(name: str, x: float) -> float:
    if not (math.isfinite(x) and x > 0):
        raise ValueError(f"{name} must be finite and positive")
    return x


def delay_bins(dm: Column, freq: Column, fref: float, tsamp: float) -> Column:
    """Samples by which a frequency lags the reference frequency at a dispersion measure."""
    seconds = F.lit(DISPERSION) * dm * (F.lit(1.0) / (freq * freq) - F.lit(1.0 / (fref * fref)))
    return F.round(seconds / F.lit(tsamp)).cast("int")


def delay_of(dm: float, freq: float, fref: float, tsamp: float) -> int:
    bins = half_away(DISPERSION * dm * (1.0 / (freq * freq) - 1.0 / (fref * fref)) / tsamp)
    if not -(2**31) <= bins < 2**31:
        raise OverflowError("dispersion delay exceeds 32 bits")
    return bins


def vector_add(lhs: Column, rhs: Column) -> Column:
    """Elementwise sum of two arrays of one length; another length is an error, empty gives empty."""
    same = F.assert_true(F.size(lhs) == F.size(rhs), F.lit("vectors must have the same length"))
    return F.when(same.isNull(), F.zip_with(lhs, rhs, lambda x, y: x + y))
