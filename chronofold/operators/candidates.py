"""Search over dispersion measures, clustering of peaks into candidates, and harmonics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.functions.numerics import DISPERSION, positive
from chronofold.operators.conditioning import Step
from chronofold.operators.ffa import peak_order, search_series
from chronofold.plans.ffa_plan import Plan


def dm_peaks(series: DataFrame, plan: Plan, steps: Sequence[Step] = (), threshold: float = 6.0, max_peaks: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dm_index, dm, peak columns) of every dedispersed series (keys, dm_index, dm, data)."""
    return search_series(series, plan, [*keys, "dm_index", "dm"], steps, threshold, max_peaks)


@dataclass(frozen=True)
class Clustering:
    frequency_radius: float = 0.1  # in units of 1 / observation length
    dm_radius: int = 1
    across_widths: bool = True
    max_candidates: int = 0

    def __post_init__(self):
        if not (math.isfinite(self.frequency_radius) and self.frequency_radius >= 0):
            raise ValueError("frequency radius must be finite and not negative")
        if self.dm_radius < 0 or self.max_candidates < 0:
            raise ValueError("dm radius and max_candidates must not be negative")


_BEST = ("period", "frequency", "width", "phase", "shift", "bins", "dm_index", "dm")


def _cells(radius: float) -> tuple[Column, Column]:
    """A grid of half the radius over frequency: peaks of one cell always chain.

    Where half the radius is below what a double can tell apart, each frequency is a cell of its own.
    """
    f = F.col("frequency").cast("double")
    fine = F.coalesce(F.abs(f) * 2.0**-50 >= radius / 2, F.lit(True))
    return fine, F.when(fine, f).otherwise(F.floor(f / F.lit(radius / 2 or 1.0)).cast("double"))


def _merged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.min_by("best_peak", "_o").alias("best_peak"), F.min("_o").alias("_o"), F.sum("peak_count").alias("peak_count"),
        F.min("frequency_min").alias("frequency_min"), F.max("frequency_max").alias("frequency_max"),
    )


def select_candidates(peaks: DataFrame, observation_seconds: float, how: Clustering = Clustering(), keys: Sequence[str] = ()) -> DataFrame:
    """Candidates with their rank: peaks chained by frequency, and within a chain by trial.

    Gaps and islands: a running count of gaps numbers the chains.  Gaps are to the previous peak, so a
    chain may be longer than the radius.  Peaks are first combined by frequency cell, trial and width,
    map-side too, so the windows see the search grid's cells and not every peak of an observation.
    """
    positive("observation_seconds", observation_seconds)
    keys = list(keys)
    radius = how.frequency_radius / observation_seconds
    fine, cell = _cells(radius)
    snr = F.col("snr")
    odd = F.isnan(snr) | (F.abs(snr) == F.lit(float("inf")))
    rows = peaks.select(
        *keys, fine.alias("_fine"), cell.alias("_cell"), "dm_index", "width",
        F.struct(*[c for c in peaks.columns if c not in keys]).alias("best_peak"),
        F.struct(odd.alias("o"), (-snr).alias("s"), *_BEST).alias("_o"),
        F.lit(1).cast("long").alias("peak_count"), F.col("frequency").alias("frequency_min"), F.col("frequency").alias("frequency_max"),
    )
    rows = _merged(rows, [*keys, "_fine", "_cell", "dm_index", "width"])
    by_f = Window.partitionBy(*keys).orderBy("frequency_min", "frequency_max", "dm_index", "width")
    gap = F.col("frequency_min") - F.max("frequency_max").over(by_f.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_cut", (F.coalesce(gap, F.lit(0.0)) > radius).cast("int"))
    rows = rows.withColumn("_f", F.sum("_cut").over(by_f.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _merged(rows, [*keys, "_f", "dm_index", "width"])
    by_dm = Window.partitionBy(*keys, "_f").orderBy(*(["dm_index", "width"] if how.across_widths else ["width", "dm_index"]))
    apart = F.col("dm_index") > F.lag("dm_index").over(by_dm) + how.dm_radius
    if not how.across_widths:
        apart = apart | (F.col("width") != F.lag("width").over(by_dm))
    rows = rows.withColumn("_cut", F.coalesce(apart, F.lit(False)).cast("int"))
    rows = rows.withColumn("_c", F.sum("_cut").over(by_dm.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*keys, "_f", "_c").agg(
        F.min_by("best_peak", "_o").alias("best_peak"), F.sum("peak_count").alias("peak_count"),
        F.min("dm_index").alias("dm_index_min"), F.max("dm_index").alias("dm_index_max"),
        F.min("frequency_min").alias("frequency_min"), F.max("frequency_max").alias("frequency_max"),
    )
    flat = ["dm", "dm_index", "period", "frequency", "width", "duty_cycle", "snr"]
    found = found.select(*keys, *[F.col(f"best_peak.{c}").alias(c) for c in flat], "peak_count", "dm_index_min", "dm_index_max", "frequency_min", "frequency_max", "best_peak")
    order = [odd.asc(), snr.desc(), *[F.col(f"best_peak.{c}").asc() for c in _BEST], F.col("peak_count").desc(), F.col("frequency").asc(), F.col("dm_index").asc()]
    ranked = found.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return ranked.where(F.col("candidate_rank") < how.max_candidates) if how.max_candidates else ranked


@dataclass(frozen=True)
class Harmonics:
    observation_seconds: float
    frequency_low: float  # MHz
    frequency_high: float
    max_harmonic: int = 16
    denominator_max: int = 5
    frequency_tolerance_bins: float = 1.5
    phase_distance_max: float = 1.0
    dm_distance_max: float = 3.0
    use_snr: bool = False
    snr_distance_max: float = 3.0
    #: The band delay counts in milliseconds, though the constant gives seconds: results must agree.
    delay_scale: float = 1e-3

    def __post_init__(self):
        for name in ("observation_seconds", "frequency_low", "frequency_high"):
            positive(name, getattr(self, name))
        if self.max_harmonic < 1 or self.denominator_max < 1:
            raise ValueError("harmonic orders must be positive")
        for name in ("frequency_tolerance_bins", "phase_distance_max", "dm_distance_max", "snr_distance_max"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) >= 0):
                raise ValueError(f"{name} must be finite and not negative")

    @property
    def ratios(self) -> list[tuple[float, int, int]]:
        """(value, numerator, denominator) of all reduced ratios but 1, rising."""
        pairs = {(p // math.gcd(p, q), q // math.gcd(p, q)) for p in range(1, self.max_harmonic + 1) for q in range(1, self.denominator_max + 1)}
        return sorted((p / q, p, q) for p, q in pairs if p != q)


def flag(table: pd.DataFrame, how: Harmonics) -> pd.DataFrame:
    """Candidates strongest first, each harmonic with its parent's place and how it relates.

    A parent is tested against all weaker candidates at once; those flagged are no parents later.
    """
    table = table.assign(_in=np.arange(len(table))).sort_values(["snr", "peak_count", "frequency", "dm_index", "_in"], ascending=[False, False, True, True, True], kind="stable")
    table = table.drop(columns="_in").reset_index(drop=True)
    n = len(table)
    f, duty = table["frequency"].to_numpy(float), table["duty_cycle"].to_numpy(float)
    dm, snr = table["dm"].to_numpy(float), table["snr"].to_numpy(float)
    width = table["period"].to_numpy(float) * duty
    ratios = how.ratios
    values = np.array([r[0] for r in ratios])
    top = np.array([r[1] for r in ratios])
    low = np.array([r[2] for r in ratios])
    band = DISPERSION * abs(1 / min(how.frequency_low, how.frequency_high) ** 2 - 1 / max(how.frequency_low, how.frequency_high) ** 2)
    out = {c: np.full(n, np.nan) for c in ("frequency_error_bins", "phase_distance", "dm_distance", "expected_snr", "snr_distance")}
    parent_of, num, den = np.full(n, -1), np.zeros(n, int), np.zeros(n, int)
    for parent in range(n):
        if parent_of[parent] >= 0 or not len(values):
            continue
        child = np.flatnonzero((parent_of < 0) & (np.arange(n) > parent))
        if not len(child):
            continue
        ratio = f[child] / f[parent]
        up = np.minimum(np.searchsorted(values, ratio, side="left"), len(values) - 1)
        down = np.maximum(up - 1, 0)
        near = np.where(np.abs(values[down] - ratio) < np.abs(values[up] - ratio), down, up)  # of equals the upper
        error = np.abs(f[child] - f[parent] * values[near]) * how.observation_seconds
        phase = error / np.where(f[child] >= f[parent], duty[child], duty[parent])
        distance = np.abs(dm[parent] - dm[child]) * band * how.delay_scale / np.minimum(width[parent], width[child])
        expected = snr[parent] / np.sqrt(top[near] * low[near].astype(float))
        off = np.abs(snr[child] - expected)
        ok = (error <= how.frequency_tolerance_bins) & (phase <= how.phase_distance_max) & (distance <= how.dm_distance_max)
        if how.use_snr:
            ok &= off <= how.snr_distance_max
        at = child[ok]
        parent_of[at], num[at], den[at] = parent, top[near[ok]], low[near[ok]]
        for name, v in zip(out, (error, phase, distance, expected, off), strict=True):
            out[name][at] = v[ok]
    return table.assign(
        harmonic_rank=np.arange(n), is_harmonic=parent_of >= 0,
        parent_index=pd.array(np.where(parent_of >= 0, parent_of, 0), dtype="Int64").copy() if not n else pd.Series(parent_of).where(parent_of >= 0).astype("Int64"),
        numerator=num, denominator=den, **out,
    )


def flag_harmonics(candidates: DataFrame, how: Harmonics, keys: Sequence[str] = ()) -> DataFrame:
    """Candidates with harmonic_rank, is_harmonic, parent_index (null: none) and the relation.

    Whether a candidate can be a parent depends on stronger ones, so the candidates of one observation
    (peaks after clustering, few) are one group.
    """
    columns = [c for c in candidates.columns if c != "best_peak"]
    kinds = dict(candidates.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    schema += ", harmonic_rank long, is_harmonic boolean, parent_index long, numerator int, denominator int"
    schema += ", frequency_error_bins double, phase_distance double, dm_distance double, expected_snr double, snr_distance double"
    return candidates.select(*columns).groupBy(*keys).applyInPandas(lambda table: flag(table, how), schema)


def remove_harmonics(flagged: DataFrame, max_candidates: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Candidates that are no harmonics, ranked as flagged; the first ``max_candidates`` if above 0."""
    left = flagged.where(~F.col("is_harmonic"))
    if not max_candidates:
        return left
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("harmonic_rank"))
    return left.withColumn("_k", place).where(F.col("_k") <= max_candidates).drop("_k")


def best_peaks(peaks: DataFrame, n: int) -> DataFrame:
    """The n best peaks; Spark keeps only n rows a task for it."""
    return peaks.orderBy(*peak_order("dm_index", "dm")).limit(n)
