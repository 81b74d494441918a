"""Folding at a known period, as weighted aggregates.

A sample covers an interval of phase; it is dealt to the bins that the interval overlaps (one or two,
unless bins are shorter than samples), so a fold is one explode and one aggregate that Spark combines
before the shuffle.  No join of intervals is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.numerics import half_away, positive


@dataclass(frozen=True)
class Fold:
    period: float
    tsamp: float
    nbin: int
    start_sample: int = 0

    def __post_init__(self):
        positive("period", self.period)
        positive("tsamp", self.tsamp)
        if self.nbin <= 0:
            raise ValueError("nbin must be positive")
        if self.start_sample < 0:
            raise ValueError("start_sample must not be negative")

    @property
    def step(self) -> float:
        """Bins that a sample covers."""
        return self.tsamp / self.period * self.nbin


def _dealt(samples: DataFrame, fold: Fold) -> DataFrame:
    """Each sample once for each phase bin it overlaps: columns bin and w."""
    low = (F.col("t") + F.lit(fold.start_sample)).cast("double") * F.lit(fold.step)
    rows = samples.withColumn("_lo", low).withColumn("_hi", low + F.lit(fold.step))
    first, last = F.floor("_lo").cast("long"), (F.ceil("_hi") - 1).cast("long")
    rows = rows.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))
    bin_ = F.col("_b").cast("double")
    weight = F.least(F.col("_hi"), bin_ + 1) - F.greatest(F.col("_lo"), bin_)
    rows = rows.withColumn("w", weight).where("w > 0")
    return rows.withColumn("bin", F.pmod("_b", F.lit(fold.nbin)).cast("int")).drop("_lo", "_hi", "_b")


def _mean(total: Column, weight: Column) -> Column:
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0)).cast("float")


def fold_profile(series: DataFrame, fold: Fold, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, phase, profile, exposure) of series rows (t, value); bins without exposure are there, as 0."""
    w, v = F.col("w"), F.col("value").cast("double")
    found = _dealt(series, fold).groupBy(*keys, "bin").agg(F.sum(v * w).alias("_s"), F.sum("w").alias("exposure"))
    return _all_bins(found, fold, keys).select(*keys, "bin", _phase(fold), _mean(F.col("_s"), F.col("exposure")).alias("profile"), "exposure")


def _all_bins(found: DataFrame, fold: Fold, keys: Sequence[str]) -> DataFrame:
    """A row for every bin of each key; sums of bins that no sample met are 0."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(fold.nbin - 1))).alias("bin")
    if keys:
        every = found.select(*keys).distinct().select(*keys, bins)
    else:
        every = found.sparkSession.range(1).select(bins)
    return every.join(found, [*keys, "bin"], "left").na.fill(0.0)


def _phase(fold: Fold) -> Column:
    return (F.col("bin") / F.lit(float(fold.nbin))).cast("float").alias("phase")


def subint_samples(tsubint: float, tsamp: float) -> int:
    return max(1, half_away(positive("tsubint", tsubint) / positive("tsamp", tsamp)))


@dataclass
class Folded:
    """cube: subint, chan, bin, value; exposure: subint, bin, exposure (both with all bins)."""

    cube: DataFrame
    exposure: DataFrame
    fold: Fold
    nchans: int
    tsubint: float

    def profile(self) -> DataFrame:
        """(bin, phase, profile): the mean over subints and channels by exposure."""
        w, v = F.col("exposure"), F.col("value").cast("double")
        found = self._weighted().groupBy("bin").agg(F.sum(v * w).alias("s"), F.sum(w).alias("e"))
        return found.select("bin", _phase(self.fold), _mean(F.col("s"), F.col("e")).alias("profile"))

    def freq_phase(self) -> DataFrame:
        """(chan, bin, value): the mean over subints by exposure."""
        w, v = F.col("exposure"), F.col("value").cast("double")
        found = self._weighted().groupBy("chan", "bin").agg(F.sum(v * w).alias("s"), F.sum(w).alias("e"))
        return found.select("chan", "bin", _mean(F.col("s"), F.col("e")).alias("value"))

    def time_phase(self) -> DataFrame:
        """(subint, time, bin, value): the plain mean over channels; time is the middle of a full subint."""
        found = self.cube.groupBy("subint", "bin").agg(F.avg(F.col("value").cast("double")).cast("float").alias("value"))
        return found.select("subint", ((F.col("subint") + 0.5) * F.lit(self.tsubint)).alias("time"), "bin", "value")

    def _weighted(self) -> DataFrame:
        return self.cube.join(self.exposure, ["subint", "bin"])


def fold_spectrum(samples: DataFrame, fold: Fold, subint: int, nchans: int, nsamples: int, output_channels: int = 0) -> Folded:
    """The cube of samples (t, chan, value): folded by subint of ``subint`` samples and channel.

    ``output_channels`` averages neighbouring channels first.  Exposure does not depend on the data: it
    comes from the sample numbers alone.
    """
    if subint <= 0:
        raise ValueError("subint_samples must be positive")
    out = output_channels or nchans
    if out <= 0 or nchans % out:
        raise ValueError("channels must divide evenly into output channels")
    if out != nchans:
        band = F.floor(F.col("chan") / (nchans // out)).cast("int")
        samples = samples.groupBy("t", band.alias("chan")).agg(F.avg(F.col("value").cast("double")).alias("value"))
    block = F.floor(F.col("t") / subint).cast("int").alias("subint")
    grid = samples.sparkSession.range(-(-nsamples // subint)).select(F.col("id").cast("int").alias("subint"), F.explode(F.sequence(F.lit(0), F.lit(fold.nbin - 1))).alias("bin"))
    ticks = samples.sparkSession.range(nsamples).select(F.col("id").alias("t"))
    met = _dealt(ticks, fold).groupBy(block, "bin").agg(F.sum("w").alias("exposure"))
    exposure = grid.join(met, ["subint", "bin"], "left").na.fill(0.0)
    sums = _dealt(samples, fold).groupBy(block, F.col("chan").cast("int").alias("chan"), "bin").agg(F.sum(F.col("value").cast("double") * F.col("w")).alias("s"))
    every = exposure.withColumn("chan", F.explode(F.sequence(F.lit(0), F.lit(out - 1))))
    cube = every.join(sums, ["subint", "chan", "bin"], "left")
    cube = cube.select("subint", "chan", "bin", _mean(F.coalesce("s", F.lit(0.0)), F.col("exposure")).alias("value"))
    return Folded(cube, exposure, fold, out, subint * fold.tsamp)


def fold_dedispersed_spectrum(samples: DataFrame, period: float, tsamp: float, nbin: int, nchans: int, nsamples: int, tsubint: float = 10.0, output_channels: int = 0) -> Folded:
    """``fold_spectrum`` with the subint's length in seconds; ``tsubint`` of the result is the real one."""
    return fold_spectrum(samples, Fold(period, tsamp, nbin), subint_samples(tsubint, tsamp), nchans, nsamples, output_channels)
