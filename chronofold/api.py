"""The interface for arrays and files: the same objects and names as array programs use.

Results hold a DataFrame; ``data`` and the other arrays collect it, so use them on results of a size
that one machine holds.  For large data take the DataFrame and the operators.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import dedisperse as dd
from chronofold.operators import ffa as ffa_ops
from chronofold.operators import fold as fold_ops
from chronofold.plans.ffa_plan import Plan, SearchOptions, make_plan
from chronofold.sources import filterbank as fb
from chronofold.sources.tables import samples_from_numpy

BACKENDS = ("cpu", "cuda", "spark")


def _backend(name: str) -> str:
    """Backends are labels here: Spark runs all of them, with the same results."""
    if name not in BACKENDS:
        raise ValueError(f"backend must be one of {BACKENDS}")
    return name


def _session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


class Filterbank:
    """A filterbank file: header, samples (a DataFrame) and, collected, data."""

    def __init__(self, path: str, *, channel_order: str = "frequency_ascending", reverse_backend: str = "auto", io_buffer_bytes: int = 64 << 20, openmp_min_rows: int = 4096, spark: SparkSession | None = None):
        if reverse_backend not in fb.REVERSE_BACKENDS:
            raise ValueError(f"reverse_backend must be one of {fb.REVERSE_BACKENDS}")
        if io_buffer_bytes <= 0 or openmp_min_rows < 0:
            raise ValueError("io_buffer_bytes must be positive and openmp_min_rows not negative")
        self.path, self.channel_order = str(path), channel_order
        self.header, self._turn = fb.read_header(self.path, channel_order)
        self.spark = spark or _session()
        fb.register(self.spark)
        self.samples = self.spark.read.format("filterbank").option("channelOrder", channel_order).option("chunkBytes", io_buffer_bytes).load(self.path)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.header.shape

    @property
    def dtype(self) -> np.dtype:
        return self.header.dtype

    @property
    def nbytes(self) -> int:
        return int(np.prod(self.shape)) * self.dtype.itemsize

    @cached_property
    def data(self) -> np.ndarray:
        source, _ = fb._open(self.path)
        with source:
            return np.ascontiguousarray(fb._rows(source, self.header, self._turn, 0, self.header.nsamples))

    def __repr__(self) -> str:
        return f"Filterbank(shape={self.shape}, dtype={self.dtype})"

    def _single_if(self) -> DataFrame:
        if self.header.nifs != 1:
            raise ValueError("dedispersion takes data of one IF")
        if not self.header.nsamples:
            raise ValueError("no samples")
        return self.samples.select("t", "chan", "value")

    def _band(self) -> dd.Band:
        table = tuple(self.header.frequency_table)
        return dd.Band(table, max(table), self.header.tsamp)


def _grid(frame: DataFrame, row: str, column: str, shape: tuple[int, int], dtype) -> np.ndarray:
    out = np.zeros(shape, dtype)
    table = frame.select(row, column, "value").toArrow()
    out[table[row].to_numpy(), table[column].to_numpy()] = table["value"].to_numpy()
    return out


class DedispersedResult:
    """Series by trial, from a DataFrame (dm_index, t, value) or wrapped from a [dm][time] array."""

    def __init__(self, data, *, tsamp: float, dm_low: float = 0.0, dm_step: float = 0.0, backend: str = "external", shape: tuple[int, int] | None = None, dtype=None, spark: SparkSession | None = None):
        self.tsamp, self.dm_low, self.dm_step, self.backend = fb_positive(tsamp), float(dm_low), float(dm_step), backend
        if isinstance(data, DataFrame):
            self.frame, self.shape, self.dtype = data, shape, np.dtype(dtype)
            return
        if not isinstance(data, np.ndarray) or data.ndim != 2:
            raise ValueError("dedispersed data must be a two-dimensional array")
        if data.dtype not in (np.uint32, np.float32):
            raise TypeError("dedispersed data must be uint32 or float32")
        if not data.flags.c_contiguous:
            raise ValueError("dedispersed data must be C-contiguous")
        if not data.size:
            raise ValueError("dedispersed data is empty")
        self.shape, self.dtype = data.shape, data.dtype
        self.__dict__["data"] = data
        self._spark = spark

    @cached_property
    def frame(self) -> DataFrame:
        return samples_from_numpy(self._spark or _session(), self.data).select(F.col("t").cast("int").alias("dm_index"), F.col("chan").cast("long").alias("t"), "value")

    @cached_property
    def data(self) -> np.ndarray:
        return _grid(self.frame, "dm_index", "t", self.shape, self.dtype)

    @property
    def ndm(self) -> int:
        return self.shape[0]

    @property
    def nsamples(self) -> int:
        return self.shape[1]

    @property
    def nbytes(self) -> int:
        return int(np.prod(self.shape)) * self.dtype.itemsize

    def series(self, dm_index: int) -> DataFrame:
        if not 0 <= dm_index < self.ndm:
            raise IndexError("dm_index out of range")
        return self.frame.where(F.col("dm_index") == dm_index).select("t", F.col("value").cast("float").alias("value"))

    def __repr__(self) -> str:
        return f"DedispersedResult(shape={self.shape}, dtype={self.dtype}, backend={self.backend!r})"


class DedispersedSpectrum:
    """A spectrum at one trial, from a DataFrame (t, chan, value) or wrapped from a [time][channel] array."""

    def __init__(self, data, *, tsamp: float, dm: float = 0.0, chan_begin: int = 0, chan_end: int | None = None, backend: str = "external", shape: tuple[int, int] | None = None, dtype=None, spark: SparkSession | None = None):
        self.tsamp, self.dm, self.backend, self.chan_begin = fb_positive(tsamp), float(dm), backend, chan_begin
        if isinstance(data, DataFrame):
            self.frame, self.shape, self.dtype = data, shape, np.dtype(dtype)
        else:
            if not isinstance(data, np.ndarray) or data.ndim != 2:
                raise ValueError("spectrum data must be a two-dimensional array")
            if data.dtype not in (np.uint8, np.uint16, np.float32):
                raise TypeError("spectrum data must be uint8, uint16 or float32")
            if not data.flags.c_contiguous:
                raise ValueError("spectrum data must be C-contiguous")
            if not data.size:
                raise ValueError("spectrum data is empty")
            self.shape, self.dtype, self._spark = data.shape, data.dtype, spark
            self.__dict__["data"] = data
        self.chan_end = chan_begin + self.shape[1] if chan_end is None else chan_end
        if chan_begin < 0 or self.chan_end - chan_begin != self.shape[1]:
            raise ValueError("the channel range does not match the number of channels")

    @cached_property
    def frame(self) -> DataFrame:
        return samples_from_numpy(self._spark or _session(), self.data)

    @cached_property
    def data(self) -> np.ndarray:
        return _grid(self.frame, "t", "chan", self.shape, self.dtype)

    @property
    def nsamples(self) -> int:
        return self.shape[0]

    @property
    def nchans(self) -> int:
        return self.shape[1]

    @property
    def nbytes(self) -> int:
        return int(np.prod(self.shape)) * self.dtype.itemsize

    def __repr__(self) -> str:
        return f"DedispersedSpectrum(shape={self.shape}, dtype={self.dtype}, dm={self.dm}, backend={self.backend!r})"


def fb_positive(tsamp: float) -> float:
    if not (np.isfinite(tsamp) and tsamp > 0):
        raise ValueError("tsamp must be finite and positive")
    return float(tsamp)


def _sum_type(dtype: np.dtype):
    return np.float32 if dtype == np.float32 else np.uint32


def dedisperse_spectrum(filterbank: Filterbank, *, dm: float, backend: str = "cpu", device_id: int = 0) -> DedispersedSpectrum:
    samples, band = filterbank._single_if(), filterbank._band()
    n = dd.valid_samples(filterbank.header.nsamples, band, dd.Trials(dm, 0.0, 1))
    frame = dd.dedisperse_spectrum(samples, band, dm, filterbank.header.nsamples)
    return DedispersedSpectrum(frame, tsamp=band.tsamp, dm=dm, backend=_backend(backend), shape=(n, len(band.selected)), dtype=filterbank.dtype)


def dedisperse_single_dm(filterbank: Filterbank, *, dm: float, backend: str = "cpu", device_id: int = 0) -> DedispersedResult:
    return dedisperse_multi_dm(filterbank, dm_low=dm, dm_step=0.0, ndm=1, backend=backend)


def dedisperse_multi_dm(filterbank: Filterbank, *, dm_low: float, dm_step: float, ndm: int, backend: str = "cpu", device_id: int = 0) -> DedispersedResult:
    samples, band, trials = filterbank._single_if(), filterbank._band(), dd.Trials(dm_low, dm_step, ndm)
    n = dd.valid_samples(filterbank.header.nsamples, band, trials)
    frame = dd.dedisperse_blocks(samples, band, trials, filterbank.header.nsamples).select("dm_index", "t", "value")
    return DedispersedResult(frame, tsamp=band.tsamp, dm_low=dm_low, dm_step=dm_step, backend=_backend(backend), shape=(ndm, n), dtype=_sum_type(filterbank.dtype))


def dedisperse_subband(filterbank: Filterbank, *, dm_low: float, dm_step: float, ndm: int, backend: str = "cuda", device_id: int = 0, subband_channels: int = 32, ndm_per_nominal: int = 32) -> DedispersedResult:
    samples, band, trials = filterbank._single_if(), filterbank._band(), dd.Trials(dm_low, dm_step, ndm)
    n = dd.valid_samples(filterbank.header.nsamples, band, trials)
    frame = dd.dedisperse_subband(samples, band, trials, filterbank.header.nsamples, dd.Subbands(subband_channels, ndm_per_nominal)).select("dm_index", "t", "value")
    return DedispersedResult(frame, tsamp=band.tsamp, dm_low=dm_low, dm_step=dm_step, backend=_backend(backend), shape=(ndm, n), dtype=_sum_type(filterbank.dtype))


FfaPlan = Plan


def make_riptide_plan(*, nsamples: int, tsamp: float, period_min: float, period_max: float, bins_min: int = 180, bins_max: int = 256, min_periods: int = 1, duty_cycle_max: float = 0.2, width_trial_spacing: float = 1.5, max_tasks: int = 1_000_000) -> Plan:
    return make_plan(nsamples, tsamp, SearchOptions(period_min, period_max, bins_min, bins_max, min_periods, duty_cycle_max, width_trial_spacing, max_tasks))


@dataclass(frozen=True)
class FfaPeak:
    period: float
    frequency: float
    snr: float
    width: int
    duty_cycle: float
    phase: int
    shift: int
    bins: int
    width_index: int
    period_index: int


def ffa_search(time_series: np.ndarray, plan: Plan, *, snr_threshold: float = 6.0, max_peaks: int | None = None, backend: str = "cpu", device_id: int = 0) -> list[FfaPeak]:
    """Peaks of one conditioned series, best first."""
    if backend not in ("cpu", "cuda"):
        raise ValueError("backend must be 'cpu' or 'cuda'")
    if backend == "cpu" and device_id != 0:
        raise ValueError("device_id is only valid with backend='cuda'")
    if device_id < 0:
        raise ValueError("device_id must be non-negative")
    if max_peaks is not None and max_peaks <= 0:
        raise ValueError("max_peaks must be positive or None")
    if not isinstance(time_series, np.ndarray) or time_series.dtype != np.float32:
        raise TypeError("time_series must be a float32 array")
    if time_series.ndim != 1 or not time_series.flags.c_contiguous:
        raise ValueError("time_series must be one-dimensional and C-contiguous")
    return [FfaPeak(*p) for p in ffa_ops.search(time_series, plan, snr_threshold, max_peaks or 0)]


class FoldedProfile:
    def __init__(self, frame: DataFrame, nbin: int, period: float, tsamp: float):
        self.frame, self.nbin, self.period, self.tsamp = frame, nbin, period, tsamp

    @cached_property
    def _table(self):
        return self.frame.orderBy("bin").toArrow()

    profile = property(lambda self: self._table["profile"].to_numpy())
    exposure = property(lambda self: self._table["exposure"].to_numpy())
    phase = property(lambda self: self._table["phase"].to_numpy())

    def __repr__(self) -> str:
        return f"FoldedProfile(nbin={self.nbin}, period={self.period})"


class FoldResult:
    def __init__(self, folded: fold_ops.Folded, nsubint: int):
        self.folded, self.nsubint, self.nchans, self.nbin = folded, nsubint, folded.nchans, folded.fold.nbin
        self.period, self.tsamp, self.tsubint = folded.fold.period, folded.fold.tsamp, folded.tsubint

    @cached_property
    def cube(self) -> np.ndarray:
        table = self.folded.cube.toArrow()
        out = np.zeros((self.nsubint, self.nchans, self.nbin), np.float32)
        out[table["subint"].to_numpy(), table["chan"].to_numpy(), table["bin"].to_numpy()] = table["value"].to_numpy()
        return out

    @cached_property
    def exposure(self) -> np.ndarray:
        return _grid(self.folded.exposure.withColumnRenamed("exposure", "value"), "subint", "bin", (self.nsubint, self.nbin), np.float64)

    @cached_property
    def profile(self) -> np.ndarray:
        return self.folded.profile().orderBy("bin").toArrow()["profile"].to_numpy()

    @cached_property
    def freq_phase(self) -> np.ndarray:
        return _grid(self.folded.freq_phase(), "chan", "bin", (self.nchans, self.nbin), np.float32)

    @cached_property
    def time_phase(self) -> np.ndarray:
        return _grid(self.folded.time_phase(), "subint", "bin", (self.nsubint, self.nbin), np.float32)

    @property
    def phase(self) -> np.ndarray:
        return (np.arange(self.nbin) / self.nbin).astype(np.float32)

    @property
    def time(self) -> np.ndarray:
        return (np.arange(self.nsubint) + 0.5) * self.tsubint

    def __repr__(self) -> str:
        return f"FoldResult(nsubint={self.nsubint}, nchans={self.nchans}, nbin={self.nbin})"


def fold_profile(dedispersed: DedispersedResult, *, period: float, nbin: int, dm_index: int = 0) -> FoldedProfile:
    if dm_index < 0:
        raise ValueError("dm_index must be non-negative")
    how = fold_ops.Fold(period, dedispersed.tsamp, nbin)
    return FoldedProfile(fold_ops.fold_profile(dedispersed.series(dm_index), how), nbin, period, dedispersed.tsamp)


def fold_spectrum(spectrum: DedispersedSpectrum, *, period: float, nbin: int, tsubint: float = 10.0, nsubband: int | None = None) -> FoldResult:
    if nsubband is not None and nsubband <= 0:
        raise ValueError("nsubband must be positive")
    n = fold_ops.subint_samples(tsubint, spectrum.tsamp)
    folded = fold_ops.fold_dedispersed_spectrum(spectrum.frame, period, spectrum.tsamp, nbin, spectrum.nchans, spectrum.nsamples, tsubint, nsubband or 0)
    return FoldResult(folded, -(-spectrum.nsamples // n))


def fold(data, **options):
    """Fold a result or a spectrum."""
    if isinstance(data, DedispersedResult):
        return fold_profile(data, **options)
    if isinstance(data, DedispersedSpectrum):
        return fold_spectrum(data, **options)
    raise TypeError("fold takes a DedispersedResult or a DedispersedSpectrum")


def vector_add(lhs, rhs) -> np.ndarray:
    a, b = np.asarray(lhs, np.float32), np.asarray(rhs, np.float32)
    if a.shape != b.shape:
        raise ValueError("vectors must have the same length")
    return a + b


def cuda_device_count() -> int:
    """No device is used."""
    return 0


def cuda_runtime_version() -> int:
    return 0
