"""Plans of a fast-folding search: which downsampled lengths and numbers of phase bins to fold at."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from chronofold.functions.numerics import positive


@dataclass(frozen=True)
class SearchOptions:
    period_min: float
    period_max: float
    bins_min: int
    bins_max: int
    min_periods: int = 1
    duty_cycle_max: float = 0.2
    width_trial_spacing: float = 1.5
    max_tasks: int = 1_000_000

    def __post_init__(self):
        positive("period_min", self.period_min)
        positive("period_max", self.period_max)
        if self.period_max <= self.period_min:
            raise ValueError("period_max must be above period_min")
        if self.bins_min < 2 or self.bins_max < self.bins_min:
            raise ValueError("bins must satisfy 2 <= bins_min <= bins_max")
        if self.min_periods < 1:
            raise ValueError("min_periods must be positive")
        if not 0 < self.duty_cycle_max < 1:
            raise ValueError("duty_cycle_max must be between 0 and 1")
        if not (math.isfinite(self.width_trial_spacing) and self.width_trial_spacing > 1):
            raise ValueError("width_trial_spacing must be above 1")
        if self.max_tasks < 1:
            raise ValueError("max_tasks must be positive")


@dataclass(frozen=True)
class Task:
    task_id: int
    downsample_factor: float
    effective_tsamp: float
    input_nsamples: int
    prepared_nsamples: int
    bins: int
    rows: int
    rows_eval: int
    period_begin: float
    period_end: float


@dataclass(frozen=True)
class Plan:
    tasks: tuple[Task, ...]
    widths: tuple[int, ...]
    nsamples: int
    tsamp: float

    @property
    def task_count(self) -> int:
        return len(self.tasks)

    @property
    def width_trials(self) -> tuple[int, ...]:
        return self.widths

    def tasks_frame(self, spark: SparkSession) -> DataFrame:
        schema = (
            "task_id int, downsample_factor double, effective_tsamp double, input_nsamples long, prepared_nsamples long, "
            "bins int, rows long, rows_eval long, period_begin double, period_end double"
        )
        return spark.createDataFrame([tuple(asdict(t).values()) for t in self.tasks], schema)

    def widths_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.widths)), "width_index int, width int")


def width_trials(bins_min: int, duty_cycle_max: float, spacing: float) -> tuple[int, ...]:
    """1, then by the spacing, but at least 1 more each time, up to the largest duty cycle."""
    out, most = [1], max(1, math.floor(duty_cycle_max * bins_min))
    while (w := max(out[-1] + 1, math.floor(spacing * out[-1]))) <= most:
        out.append(w)
    return tuple(out)


def trial_period(tsamp: float, bins: int, rows: int, shift: int) -> float:
    return tsamp * bins * bins / (bins - (shift / (rows - 1) if rows > 1 else 0.0))


def make_plan(nsamples: int, tsamp: float, o: SearchOptions) -> Plan:
    """All tasks, by cycles of geometric downsampling and, in each, numbers of bins."""
    if nsamples <= 0:
        raise ValueError("nsamples must be positive")
    positive("tsamp", tsamp)
    longest = min(o.period_max, nsamples * tsamp / o.min_periods)
    if longest <= o.period_min:
        raise ValueError("no period can be searched in a series this short")
    start = o.period_min / (tsamp * o.bins_min)
    if start < 1:
        raise ValueError("period_min is too short for bins_min at this sampling time")
    growth = (o.bins_max + 1) / o.bins_min
    tasks: list[Task] = []
    for cycle in range(math.ceil(math.log(longest / o.period_min) / math.log(growth))):
        factor = start * growth**cycle
        ts = factor * tsamp
        n = nsamples if factor == 1.0 else math.floor(nsamples / factor)
        samples = longest / ts
        for bins in range(o.bins_min, min(o.bins_max, n, math.floor(samples)) + 1):
            rows = n // bins
            if rows < o.min_periods:
                continue
            reach = min(samples, bins + 1.0)
            rows_eval = min(rows, math.ceil(bins * (rows - 1.0) * (1.0 - bins / reach)))
            if rows_eval <= 0:
                continue
            if len(tasks) >= o.max_tasks:
                raise RuntimeError("the plan has more tasks than max_tasks")
            tasks.append(Task(len(tasks), factor, ts, nsamples, n, bins, rows, rows_eval, ts * bins, trial_period(ts, bins, rows, rows_eval - 1)))
    return Plan(tuple(tasks), width_trials(o.bins_min, o.duty_cycle_max, o.width_trial_spacing), nsamples, tsamp)
