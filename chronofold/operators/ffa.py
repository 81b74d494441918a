"""The fast folding algorithm: transform, circular boxcar detection and the search of a series.

Transform and detection stay in one function per series and downsampling factor, so profiles are
never shuffled; only peaks leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.conditioning import Step, checked, downsample, downsampled_variance, preprocess
from chronofold.operators.dedisperse import batches_of
from chronofold.plans.ffa_plan import Plan, Task, trial_period

_F = np.float32


def _rows_for(part: int, rows: int, shifts: np.ndarray) -> np.ndarray:
    """The row of a part's transform that each shift of the whole takes, rounded in float32."""
    ratio = _F(_F(part - 1) / _F(rows - 1))
    return np.floor(ratio * shifts.astype(_F) + _F(0.5)).astype(np.int64)


def transform(block: np.ndarray, rows_eval: int | None = None) -> np.ndarray:
    """Folded profiles of a (rows, bins) block, one for each shift; the first ``rows_eval`` of them.

    Halves are transformed and merged: of each shift, a row of the head and a row of the tail rolled
    by what is left of the shift.  Only the last merge is cut, since lower ones need all rows.
    """
    rows, bins = block.shape
    n = rows if rows_eval is None else min(rows, rows_eval)
    if rows == 1:
        return block[:n].astype(_F)
    head, tail = transform(block[: rows // 2]), transform(block[rows // 2 :])
    shifts = np.arange(n)
    h, t = _rows_for(len(head), rows, shifts), _rows_for(len(tail), rows, shifts)
    at = (np.arange(bins)[None, :] + (shifts - t)[:, None]) % bins
    return head[h] + np.take_along_axis(tail[t], at, axis=1)


def transform_series(x: np.ndarray, bins: int) -> np.ndarray:
    """The transform of a series' whole rows; a tail that fills no row drops out."""
    if bins < 2:
        raise ValueError("bins must be above 1")
    rows = len(x) // bins
    if rows < 1:
        raise ValueError("the series is shorter than one row")
    return transform(np.asarray(x, _F)[: rows * bins].reshape(rows, bins))


def trial_periods(rows: int, bins: int, tsamp: float) -> list[float]:
    return [trial_period(tsamp, bins, rows, s) for s in range(rows)]


def trial_period_column(tsamp: Column, bins: Column, rows: Column, shift: Column) -> Column:
    slip = F.when(rows > 1, shift / (rows - 1)).otherwise(F.lit(0.0))
    return tsamp * bins * bins / (bins - slip)


def boxcars(widths: Sequence[int], bins: int) -> list[tuple[int, int, np.float32, np.float32, float]]:
    """(width_index, width, height, baseline, duty cycle) of matched boxcars of zero mean and unit power."""
    out = []
    for k, w in enumerate(widths):
        if not 0 < w < bins:
            raise ValueError("boxcar widths must be above 0 and below the number of bins")
        height = _F(math.sqrt((bins - w) / (bins * w)))
        out.append((k, w, height, _F(_F(w / (bins - w)) * height), w / bins))
    return out


def noise(task: Task) -> np.float32:
    """Deviation of a folded profile's bins for unit noise in the series."""
    var = 1.0 if task.downsample_factor == 1.0 else downsampled_variance(task.input_nsamples, task.downsample_factor)
    return _F(math.sqrt(task.rows * var))


PEAK = ["period", "frequency", "snr", "width", "duty_cycle", "phase", "shift", "bins", "width_index", "period_index"]


def detect(profiles: np.ndarray, task: Task, widths: Sequence[int], sigma: np.float32, threshold: float) -> list[tuple]:
    """A peak for each profile and boxcar width whose best circular sum reaches the threshold."""
    if not (math.isfinite(threshold)):
        raise ValueError("snr threshold must be finite")
    if not (math.isfinite(sigma) and sigma > 0):
        raise ValueError("noise must be finite and positive")
    bins = profiles.shape[1]
    trials = boxcars(widths, bins)
    most = max(widths)
    sums = np.cumsum(np.concatenate([profiles, profiles[:, :most]], axis=1), axis=1, dtype=_F)
    total = sums[:, bins - 1]
    out = []
    for k, w, height, base, duty in trials:
        box = sums[:, w - 1 : w - 1 + bins].copy()
        box[:, 1:] -= sums[:, : bins - 1]
        phase = box.argmax(1)
        snr = ((height + base) * box[np.arange(len(box)), phase] - base * total) * (_F(1) / sigma)
        for s in np.flatnonzero(snr >= _F(threshold)).tolist():
            period = trial_period(task.effective_tsamp, bins, task.rows, s)
            out.append((period, 1.0 / period, float(snr[s]), w, duty, int(phase[s]), s, bins, k, s))
    return out


def peak_key(p: tuple) -> tuple:
    """Best first: finite signal to noise, then larger; then period, frequency, width, phase, shift, bins."""
    return (not math.isfinite(p[2]), -p[2], p[0], p[1], p[3], p[5], p[6], p[7])


def search(x: np.ndarray, plan: Plan, threshold: float = 6.0, max_peaks: int = 0, tasks: Sequence[Task] | None = None) -> list[tuple]:
    """All peaks of one series, best first.  More than ``max_peaks`` (0: no limit) is an error, never a cut."""
    checked(x)
    if len(x) != plan.nsamples:
        raise ValueError("the series has another length than the plan")
    found: list[tuple] = []
    factor, prepared = None, x
    for task in plan.tasks if tasks is None else tasks:
        if task.downsample_factor != factor:  # neighbours share the downsampled input
            factor = task.downsample_factor
            prepared = np.asarray(x, _F) if factor == 1.0 else downsample(np.asarray(x, _F), factor)
        block = prepared[: task.rows * task.bins].reshape(task.rows, task.bins)
        found += detect(transform(block, task.rows_eval), task, plan.widths, noise(task), threshold)
        if max_peaks and len(found) > max_peaks:
            raise RuntimeError("more peaks than max_peaks")
    return sorted(found, key=peak_key)


_KINDS = [pa.float64(), pa.float64(), pa.float32(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
PEAK_SCHEMA = "period double, frequency double, snr float, width int, duty_cycle double, phase int, shift long, bins int, width_index int, period_index long"


def search_series(series: DataFrame, plan: Plan, keys: Sequence[str], steps: Sequence[Step] = (), threshold: float = 6.0, max_peaks: int = 0, column: str = "data") -> DataFrame:
    """(keys, peak columns) of every series, conditioned by ``steps`` first.

    The unit of work is a series and a downsampling factor, so a few long series still fill a cluster;
    without a limit on peaks each factor is a row of its own.  A limit counts over a whole series, which
    then is one unit.
    """
    factors = sorted({t.downsample_factor for t in plan.tasks})
    units = [list(plan.tasks)] if max_peaks else [[t for t in plan.tasks if t.downsample_factor == f] for f in factors]
    names = [*keys]
    rows = series.select(*keys, F.col(column).alias("_data"), F.explode(F.sequence(F.lit(0), F.lit(len(units) - 1))).alias("_unit"))
    rows = rows.repartition(*[F.col(k) for k in keys], F.col("_unit"))
    kinds = dict(series.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, x in enumerate(batches_of(batch.column(len(names)))):
                x = preprocess(x, steps) if steps else x
                found = search(x, plan, threshold, max_peaks, units[batch.column(len(names) + 1)[r].as_py()])
                if found:
                    columns = [pa.repeat(batch.column(k)[r], len(found)) for k in range(len(names))]
                    columns += [pa.array(c, t) for c, t in zip(zip(*found, strict=True), _KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, *PEAK])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", " + PEAK_SCHEMA)


def transform_frame(series: DataFrame, bins: int, keys: Sequence[str], column: str = "data") -> DataFrame:
    """(keys, shift, profile) of every series."""
    names = [*keys]
    kinds = dict(series.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, x in enumerate(batches_of(batch.column(len(names)))):
                out = transform_series(x, bins)
                edges = pa.array(np.arange(len(out) + 1, dtype=np.int32) * bins)
                columns = [pa.repeat(batch.column(k)[r], len(out)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(out))), pa.ListArray.from_arrays(edges, pa.array(out.ravel()))], names=[*names, "shift", "profile"])

    source = series.select(*keys, column)
    return source.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", shift long, profile array<float>")


def peak_order(*more: str) -> list[Column]:
    """Columns that sort peaks best first; ``more`` break ties."""
    snr = F.col("snr")
    odd = F.isnan(snr) | (F.abs(snr) == F.lit(float("inf")))
    return [odd.asc(), snr.desc(), *[F.col(c).asc() for c in ("period", "frequency", "width", "phase", "shift", "bins", *more)]]
