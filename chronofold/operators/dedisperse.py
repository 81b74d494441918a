"""Dedispersion: remove the frequency-dependent delay, one or many trial dispersion measures at a time.

Samples are rows (t, chan, value), optionally keyed by observation columns.  The delay table is the
only other input; it has a row for each channel and trial, so its size is fixed by the plan and it is
broadcast.  Two physical forms of the many-trial sum exist: a relational one (join and aggregate)
and one over blocks of time with a halo, which shuffles each sample once instead of once a trial.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.numerics import delay_bins, delay_of, positive

#: Rows of a delay table (channels x trials) up to which it is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 4_000_000


@dataclass(frozen=True)
class Band:
    """frequencies: MHz by channel; fref: MHz; tsamp: s; channels [begin, end)."""

    frequencies: tuple[float, ...]
    fref: float
    tsamp: float
    begin: int = 0
    end: int | None = None

    def __post_init__(self):
        positive("tsamp", self.tsamp)
        positive("reference frequency", self.fref)
        if not self.frequencies:
            raise ValueError("no channels")
        for f in self.frequencies:
            positive("frequency", f)
        if not 0 <= self.begin < self.stop <= len(self.frequencies):
            raise IndexError("channel range is empty or out of range")
        if max(self.selected) > self.fref:
            raise ValueError("a selected frequency is above the reference frequency")

    @property
    def stop(self) -> int:
        return len(self.frequencies) if self.end is None else self.end

    @property
    def selected(self) -> tuple[float, ...]:
        return self.frequencies[self.begin : self.stop]


@dataclass(frozen=True)
class Trials:
    """Dispersion measures low, low + step, ..., count of them."""

    low: float
    step: float
    count: int

    def __post_init__(self):
        if not (np.isfinite(self.low) and self.low >= 0):
            raise ValueError("dm must be finite and not negative")
        if self.count <= 0:
            raise ValueError("ndm must be positive")
        if self.count > 1 or self.step:
            positive("dm_step", self.step)

    def dm(self, index: int) -> float:
        return self.low + index * self.step


@dataclass(frozen=True)
class Subbands:
    """Channels in a subband, and trials that share a nominal one."""

    channels: int = 32
    trials: int = 32

    def __post_init__(self):
        if self.channels <= 0 or self.trials <= 0:
            raise ValueError("subband options must be positive")


def max_delay(band: Band, trials: Trials) -> int:
    """The delay of the largest trial at the lowest selected frequency."""
    return delay_of(trials.dm(trials.count - 1), min(band.selected), band.fref, band.tsamp)


def valid_samples(nsamples: int, band: Band, trials: Trials) -> int:
    """Output samples for which every selected channel has input."""
    if nsamples <= 0:
        raise ValueError("no samples")
    n = nsamples - max_delay(band, trials)
    if n <= 0:
        raise ValueError("the delay range leaves no valid output samples")
    return n


def delay_table(spark: SparkSession, band: Band, trials: Trials) -> DataFrame:
    """(dm_index, dm, chan, freq, delay) for the selected channels."""
    channels = [(band.begin + k, float(f)) for k, f in enumerate(band.selected)]
    chan = spark.createDataFrame(channels, "chan int, freq double").coalesce(1)
    dm = spark.range(0, trials.count, 1, 1).select(F.col("id").cast("int").alias("dm_index"), (F.lit(float(trials.low)) + F.col("id") * F.lit(float(trials.step))).alias("dm"))
    return dm.crossJoin(F.broadcast(chan)).select("dm_index", "dm", "chan", "freq", delay_bins(F.col("dm"), F.col("freq"), band.fref, band.tsamp).alias("delay"))


def _sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _shifted(samples: DataFrame, delays: DataFrame, rows: int, nout: int) -> DataFrame:
    joined = samples.join(_sized(delays, rows), "chan")
    return joined.withColumn("t", (F.col("t") - F.col("delay")).cast("long")).where((F.col("t") >= 0) & (F.col("t") < nout))


def _total(kind: str):
    """Integers add up as long, floating samples as double."""
    return F.sum(F.col("value").cast("double" if kind in ("float", "double") else "long"))


def dedisperse_spectrum(samples: DataFrame, band: Band, dm: float, nsamples: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, chan, value): delays removed, channels kept and counted from the range's first.  No shuffle."""
    trials = Trials(dm, 0.0, 1)
    delays = delay_table(samples.sparkSession, band, trials).select("chan", "delay")
    moved = _shifted(samples, delays, len(band.selected), valid_samples(nsamples, band, trials))
    return moved.select(*keys, "t", (F.col("chan") - band.begin).cast("int").alias("chan"), "value")


def dedisperse_single(samples: DataFrame, band: Band, dm: float, nsamples: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, value): the sum over the selected channels at one dispersion measure."""
    trials = Trials(dm, 0.0, 1)
    delays = delay_table(samples.sparkSession, band, trials).select("chan", "delay")
    moved = _shifted(samples, delays, len(band.selected), valid_samples(nsamples, band, trials))
    return moved.groupBy(*keys, "t").agg(_total(dict(samples.dtypes)["value"]).alias("value"))


def dedisperse_multi(samples: DataFrame, band: Band, trials: Trials, nsamples: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dm_index, dm, t, value) for all trials, each of the length that the largest allows.

    Relational form: joins the samples with the broadcast table and adds up, partly before the
    shuffle.  It makes a row for each sample and trial; ``dedisperse_blocks`` is for large inputs.
    """
    delays = delay_table(samples.sparkSession, band, trials).select("dm_index", "dm", "chan", "delay")
    rows = len(band.selected) * trials.count
    moved = _shifted(samples, delays, rows, valid_samples(nsamples, band, trials))
    return moved.groupBy(*keys, "dm_index", "dm", "t").agg(_total(dict(samples.dtypes)["value"]).alias("value"))


def dedisperse_blocks(samples: DataFrame, band: Band, trials: Trials, nsamples: int, keys: Sequence[str] = (), block: int = 1 << 14) -> DataFrame:
    """Like ``dedisperse_multi``, over blocks of ``block`` output samples.

    A sample goes to the blocks whose outputs can need it (its own and those up to the largest delay
    before), a small factor where blocks are longer than the delay.  A task holds one block of one
    observation: (block + delay) x channels samples, whatever the input's size.  Sums of floating
    samples are float32 in channel order.
    """
    nout = valid_samples(nsamples, band, trials)
    reach = max_delay(band, trials)
    floating = dict(samples.dtypes)["value"] in ("float", "double")
    chans = np.arange(band.begin, band.stop)
    delays = np.array([[delay_of(trials.dm(i), band.frequencies[c], band.fref, band.tsamp) for c in chans] for i in range(trials.count)])
    t = F.col("t")
    own = F.floor(t / block)
    first = F.greatest(F.lit(0), F.floor((t - reach) / block))
    dealt = samples.where(F.col("chan").between(band.begin, band.stop - 1)).withColumn("block", F.explode(F.sequence(first.cast("long"), own.cast("long"))))
    dealt = dealt.where(F.col("block") * block < nout).select(*keys, "block", "t", "chan", "value")

    def run(table: pa.Table) -> pa.Table:
        at = table["block"][0].as_py() * block
        n = min(block, nout - at)
        cube = np.zeros((len(chans), n + reach), np.float32 if floating else np.int64)
        rel = table["t"].to_numpy() - at
        keep = rel < n + reach
        cube[table["chan"].to_numpy()[keep] - band.begin, rel[keep]] = table["value"].to_numpy()[keep]
        out = np.zeros((trials.count, n), cube.dtype)
        for i in range(trials.count):
            for c, delay in enumerate(delays[i]):
                out[i] += cube[c, delay : delay + n]
        size = trials.count * n
        index = np.repeat(np.arange(trials.count, dtype=np.int32), n)
        columns = [pa.repeat(table[k][0], size) for k in keys]
        columns += [pa.array(index), pa.array(trials.low + index * float(trials.step)), pa.array(np.tile(np.arange(at, at + n), trials.count)), pa.array(out.ravel().astype(np.float64 if floating else np.int64))]
        return pa.Table.from_arrays(columns, names=[*keys, "dm_index", "dm", "t", "value"])

    kinds = dict(samples.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"dm_index int, dm double, t long, value {'double' if floating else 'long'}"])
    return dealt.groupBy(*keys, "block").applyInArrow(run, schema)


def dedisperse_subband(samples: DataFrame, band: Band, trials: Trials, nsamples: int, subbands: Subbands = Subbands(), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dm_index, dm, t, value) by two stages, an approximation of ``dedisperse_multi``.

    First channels of a subband are summed at the delays of a nominal trial; then each trial sums the
    subbands at the delay that remains at the subband's centre.  Terms beyond the input drop out.
    """
    spark = samples.sparkSession
    nout = valid_samples(nsamples, band, trials)
    coarse, fine = [], []
    groups = range(-(-trials.count // subbands.trials))
    for s, a in enumerate(range(band.begin, band.stop, subbands.channels)):
        b = min(a + subbands.channels, band.stop)
        centre = band.frequencies[(a + b - 1) // 2]
        for g in groups:
            nominal = trials.dm(g * subbands.trials)
            coarse += [(g, s, c, delay_of(nominal, band.frequencies[c], band.fref, band.tsamp)) for c in range(a, b)]
            for i in range(g * subbands.trials, min((g + 1) * subbands.trials, trials.count)):
                fine.append((g, s, i, float(trials.dm(i)), delay_of(trials.dm(i) - nominal, centre, band.fref, band.tsamp)))
    first = spark.createDataFrame(coarse, "g int, s int, chan int, delay int")
    second = spark.createDataFrame(fine, "g int, s int, dm_index int, dm double, rest int")
    total = _total(dict(samples.dtypes)["value"])
    stage = samples.join(_sized(first, len(coarse)), "chan").withColumn("u", (F.col("t") - F.col("delay")).cast("long"))
    stage = stage.where((F.col("u") >= 0) & (F.col("u") < nsamples)).groupBy(*keys, "g", "s", "u").agg(total.alias("value"))
    moved = stage.join(_sized(second, len(fine)), ["g", "s"]).withColumn("t", F.col("u") - F.col("rest"))
    moved = moved.where((F.col("t") >= 0) & (F.col("t") < nout))
    return moved.groupBy(*keys, "dm_index", "dm", "t").agg(F.sum("value").alias("value"))


def to_series(rows: DataFrame, keys: Sequence[str], value: str = "value", t: str = "t") -> DataFrame:
    """(keys, data): rows of a series as one array of floats in order of time."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(t), F.col(value).cast("float").alias("v"))))
    return rows.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.col("_p.v").alias("data"))


def batches_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Each array of a list column as float32."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield flat[a:b].astype(np.float32, copy=False)
