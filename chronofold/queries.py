"""The registered queries of the time-series engine, over the driver's tables, and their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.numerics import DISPERSION, vector_add
from chronofold.operators import candidates as cand
from chronofold.operators import conditioning as cond
from chronofold.operators import dedisperse as dd
from chronofold.operators import ffa
from chronofold.operators import fold as fo
from chronofold.plans.ffa_plan import Plan, SearchOptions, make_plan
from chronofold.sources import filterbank as fb
from chronofold.sources.tables import embedding_samples, event_series, shipping_series

NCHAN, TSAMP, FREF = 64, 0.01, 1630.0
FREQUENCIES = tuple(1000.0 + 10 * c for c in range(NCHAN))
BAND = dd.Band(FREQUENCIES, FREF, TSAMP)
PART = dd.Band(FREQUENCIES, FREF, TSAMP, 16, 48)
TRIALS = dd.Trials(0.0, 10.0, 8)
SINGLE_DM = 50.0
SUBBANDS = dd.Subbands(8, 4)
HOURS = 720
WINDOW, FAST_WINDOW, FAST_POINTS, FACTOR = 25, 49, 7, 2.5
BINS = 24
#: Thresholds lie well away from the values.
EVENT_SNR, DM_SNR = 3.0, 2.0
#: Below this some best phases of ``dm_peaks`` tie but for single precision.
SHOWN_SNR = 2.5
DM_OPTIONS = SearchOptions(0.2, 0.5, 16, 20, 4, 0.2, 1.5)
FOLD = fo.Fold(0.25, TSAMP, 16)
SUBINT = 50


def _n(samples: DataFrame) -> int:
    """Samples of an observation, known from its metadata in a file and from its last time in a table."""
    return samples.agg(F.max("t")).first()[0] + 1


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.to_series(event_series(spark, sf_dir, HOURS), ["event_type"])


def _rounded(rows: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def delay_table(spark, sf_dir):
    return dd.delay_table(spark, BAND, TRIALS)


def valid_range(spark, sf_dir):
    n = _n(embedding_samples(spark, sf_dir))
    row = [(n, dd.max_delay(BAND, TRIALS), dd.valid_samples(n, BAND, TRIALS))]
    return spark.createDataFrame(row, "nsamples long, max_delay long, nout long")


def dedisperse_single(spark, sf_dir):
    s = embedding_samples(spark, sf_dir)
    return dd.dedisperse_single(s, BAND, SINGLE_DM, _n(s))


def dedisperse_channel_range(spark, sf_dir):
    s = embedding_samples(spark, sf_dir)
    return dd.dedisperse_single(s, PART, SINGLE_DM, _n(s))


def dedisperse_spectrum(spark, sf_dir):
    s = embedding_samples(spark, sf_dir)
    return dd.dedisperse_spectrum(s, BAND, SINGLE_DM, _n(s))


def dedisperse_multi(spark, sf_dir):
    s = embedding_samples(spark, sf_dir)
    return dd.dedisperse_multi(s, BAND, TRIALS, _n(s))


def dedisperse_blocks(spark, sf_dir):
    s = embedding_samples(spark, sf_dir)
    return dd.dedisperse_blocks(s, BAND, TRIALS, _n(s), block=256)


def dedisperse_subband(spark, sf_dir):
    s = embedding_samples(spark, sf_dir)
    return dd.dedisperse_subband(s, BAND, TRIALS, _n(s), SUBBANDS)


def dm_time_series(spark, sf_dir):
    s = embedding_samples(spark, sf_dir)
    return dd.dedisperse_multi(s, BAND, TRIALS, _n(s)).where("dm_index = 3").select("t", F.col("value").cast("float").alias("value"))


def ts_stats(spark, sf_dir):
    return _rounded(cond.long_stats(event_series(spark, sf_dir, HOURS), ["event_type"]), "mean", "variance", "stddev")


def shipping_stats(spark, sf_dir):
    rows = shipping_series(spark, sf_dir).withColumn("series", F.lit("shipping"))
    return _rounded(cond.long_stats(rows, ["series"]), "mean", "variance", "stddev", digits=4)


def normalise(spark, sf_dir):
    rows = cond.long_normalise(event_series(spark, sf_dir, HOURS), ["event_type"])
    return _rounded(rows, "value", digits=4)


def normalise_series(spark, sf_dir):
    rows = cond.explode_series(cond.map_series(_events(spark, sf_dir), [cond.Normalise()]), ["event_type"])
    return _rounded(rows, "value", digits=4)


def scrunch(spark, sf_dir):
    return _rounded(cond.long_scrunch(event_series(spark, sf_dir, HOURS), ["event_type"], 7, HOURS), "value")


def running_median(spark, sf_dir):
    step = lambda x: cond.running_median(x, WINDOW)
    rows = cond.explode_series(cond.map_series(_events(spark, sf_dir), [step]), ["event_type"])
    return rows.withColumn("value", F.col("value").cast("long"))


def detrend(spark, sf_dir):
    rows = cond.explode_series(cond.map_series(_events(spark, sf_dir), [cond.Detrend(WINDOW, WINDOW)]), ["event_type"])
    return rows.withColumn("value", F.col("value").cast("long"))


def fast_running_median(spark, sf_dir):
    step = lambda x: cond.fast_running_median(x, FAST_WINDOW, FAST_POINTS)
    rows = cond.explode_series(cond.map_series(_events(spark, sf_dir), [step]), ["event_type"])
    return _rounded(rows, "value", digits=3)


def downsample(spark, sf_dir):
    rows = cond.explode_series(cond.map_series(_events(spark, sf_dir), [cond.Downsample(FACTOR)]), ["event_type"])
    return rows.withColumn("value", F.col("value").cast("double"))


def downsample_long(spark, sf_dir):
    rows = cond.long_downsample(event_series(spark, sf_dir, HOURS), ["event_type"], FACTOR, HOURS)
    return rows.withColumn("value", F.col("value").cast("double"))


CASES = ((16, 2.0), (16, 4.0), (8, 2.5), (5, 2.5), (720, 1.75))


def downsample_variance(spark, sf_dir):
    rows = [(n, f, cond.downsampled_variance(n, f)) for n, f in CASES]
    return _rounded(spark.createDataFrame(rows, "n long, factor double, variance double"), "variance", digits=9)


def preprocess(spark, sf_dir):
    steps = cond.riptide_steps(1.0, WINDOW, WINDOW)
    rows = cond.explode_series(cond.map_series(_events(spark, sf_dir), steps), ["event_type"])
    return _rounded(rows, "value", digits=4)


PLAN_OPTIONS = SearchOptions(1.0, 4.0, 4, 5, 2, 0.5)


def ffa_plan(spark, sf_dir):
    return _rounded(make_plan(64, 0.25, PLAN_OPTIONS).tasks_frame(spark), "downsample_factor", "effective_tsamp", "period_begin", "period_end", digits=9)


def width_trials(spark, sf_dir):
    return make_plan(10_000, 0.001, SearchOptions(0.24, 0.5, 240, 260)).widths_frame(spark)


def trial_periods(spark, sf_dir):
    rows = make_plan(64, 0.25, PLAN_OPTIONS).tasks_frame(spark).withColumn("shift", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows_eval") - 1)))
    period = ffa.trial_period_column(F.col("effective_tsamp"), F.col("bins"), F.col("rows"), F.col("shift"))
    return _rounded(rows.select("task_id", "shift", period.alias("period")), "period", digits=9)


def ffa_transform(spark, sf_dir):
    rows = ffa.transform_frame(_events(spark, sf_dir), BINS, ["event_type"])
    return rows.select("event_type", "shift", F.posexplode("profile").alias("bin", "value")).withColumn("value", F.col("value").cast("long"))


def _event_plan() -> Plan:
    full = make_plan(HOURS, 1.0, SearchOptions(24.0, 25.0, 24, 24, 4, 0.2, 1.5))
    return full


def ffa_search(spark, sf_dir):
    found = ffa.search_series(_events(spark, sf_dir), _event_plan(), ["event_type"], threshold=EVENT_SNR)
    rows = found.select("event_type", "width", "phase", "shift", "bins", "width_index", "period_index", "period", "frequency", "duty_cycle", "snr")
    return _rounded(_rounded(rows, "period", "frequency", "duty_cycle"), "snr", digits=2)


def boxcar_detect(spark, sf_dir):
    found = ffa.search_series(_events(spark, sf_dir), _event_plan(), ["event_type"], threshold=-1e6)
    return _rounded(found.select("event_type", "shift", "width", "phase", "snr"), "snr", digits=2)


def _dm_peaks(spark, sf_dir, threshold: float = DM_SNR) -> tuple[DataFrame, int]:
    s = embedding_samples(spark, sf_dir)
    n = _n(s)
    series = dd.to_series(dd.dedisperse_blocks(s, BAND, TRIALS, n), ["dm_index", "dm"])
    nout = dd.valid_samples(n, BAND, TRIALS)
    plan = make_plan(nout, TSAMP, DM_OPTIONS)
    return cand.dm_peaks(series, plan, cond.riptide_steps(TSAMP, 0.5, 51), threshold), n


def dm_peaks(spark, sf_dir):
    return _shown_peaks(_dm_peaks(spark, sf_dir, SHOWN_SNR)[0])


def _shown_peaks(rows: DataFrame) -> DataFrame:
    return _rounded(_rounded(rows, "period", "frequency", "duty_cycle"), "snr", digits=2)


def dm_peaks_topk(spark, sf_dir):
    return _shown_peaks(cand.best_peaks(_dm_peaks(spark, sf_dir)[0], 20))


def _candidates(spark, sf_dir) -> tuple[DataFrame, float]:
    peaks, n = _dm_peaks(spark, sf_dir)
    return cand.select_candidates(peaks, n * TSAMP, cand.Clustering(0.1, 1)), n * TSAMP


#: Peaks of a made-up search: customers by account, as if frequency, trial and strength.
def _table_peaks(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    f = (F.lit(1.0) + (k * 7919 % 10007) / 1024.0).alias("frequency")
    snr = (F.lit(6.0) + (k * 104729 % 4096) / 64.0).cast("float").alias("snr")
    rows = c.select(
        (k % 40).cast("int").alias("dm_index"), (F.lit(0.5) * (k % 40)).alias("dm"), f, snr,
        (k % 3 + 1).cast("int").alias("width"), ((k % 3 + 1) / 64.0).alias("duty_cycle"), (k % 64).cast("int").alias("phase"),
        k.cast("long").alias("shift"), F.lit(64).alias("bins"), (k % 3).cast("int").alias("width_index"), k.cast("long").alias("period_index"),
    )
    return rows.withColumn("period", F.lit(1.0) / F.col("frequency"))


T_OBS = 4.0


def candidate_clusters(spark, sf_dir):
    found = cand.select_candidates(_table_peaks(spark, sf_dir), T_OBS, cand.Clustering(0.03, 2))
    return _rounded(found.withColumn("best_shift", F.col("best_peak.shift")).drop("best_peak", "period"), "snr", "frequency")


def candidate_clusters_by_width(spark, sf_dir):
    found = cand.select_candidates(_table_peaks(spark, sf_dir), T_OBS, cand.Clustering(0.03, 2, False, 25))
    return _rounded(found.withColumn("best_shift", F.col("best_peak.shift")).drop("best_peak", "period"), "snr", "frequency")


def harmonic_flags(spark, sf_dir):
    found, seconds = _candidates(spark, sf_dir)
    return _shown_flags(cand.flag_harmonics(found, cand.Harmonics(seconds, 1000.0, FREF)), 1)


def harmonic_removed(spark, sf_dir):
    found, seconds = _candidates(spark, sf_dir)
    flagged = cand.flag_harmonics(found, cand.Harmonics(seconds, 1000.0, FREF))
    return _shown_flags(cand.remove_harmonics(flagged, 50), 1)


#: A longer observation than the clustering's, so that about a fifth of these candidates are harmonics.
TABLE_HARMONICS = cand.Harmonics(1000.0, 1000.0, FREF)
_RELATION = ("frequency_error_bins", "phase_distance", "dm_distance", "expected_snr", "snr_distance")


def _table_flags(spark, sf_dir) -> DataFrame:
    found = cand.select_candidates(_table_peaks(spark, sf_dir), T_OBS, cand.Clustering(0.03, 2))
    return cand.flag_harmonics(found, TABLE_HARMONICS)


def _shown_flags(flagged: DataFrame, digits: int = 6) -> DataFrame:
    """No relation is shown as parent -1 and zeros; ``digits``: of signals to noise, which a search sums in single precision."""
    flagged = flagged.withColumns({c: F.when(F.col("is_harmonic"), F.col(c)).otherwise(F.lit(0.0)) for c in _RELATION})
    flagged = flagged.withColumn("parent_index", F.coalesce("parent_index", F.lit(-1).cast("long")))
    shown = flagged.select("harmonic_rank", "frequency", "dm", "dm_index", "snr", "peak_count", "is_harmonic", "parent_index", "numerator", "denominator", *_RELATION)
    noisy = ["snr", "expected_snr", "snr_distance"]
    return _rounded(_rounded(shown, "frequency", *[c for c in _RELATION if c not in noisy]), *noisy, digits=digits)


def candidate_harmonics(spark, sf_dir):
    return _shown_flags(_table_flags(spark, sf_dir))


def candidate_harmonics_removed(spark, sf_dir):
    return _shown_flags(cand.remove_harmonics(_table_flags(spark, sf_dir), 200))


def harmonic_ratios(spark, sf_dir):
    rows = [(k, p, q) for k, (_, p, q) in enumerate(cand.Harmonics(1.0, 1.0, 2.0).ratios)]
    return spark.createDataFrame(rows, "ratio_index int, numerator int, denominator int")


def fold_profile(spark, sf_dir):
    s = embedding_samples(spark, sf_dir)
    series = dd.dedisperse_single(s, BAND, SINGLE_DM, _n(s))
    return _rounded(fo.fold_profile(series, FOLD), "phase", "profile", "exposure", digits=3)


def _folded(spark, sf_dir, out: int = 0) -> fo.Folded:
    s = embedding_samples(spark, sf_dir)
    n = dd.valid_samples(_n(s), BAND, dd.Trials(SINGLE_DM, 0.0, 1))
    return fo.fold_spectrum(dd.dedisperse_spectrum(s, BAND, SINGLE_DM, _n(s)), FOLD, SUBINT, NCHAN, n, out)


def fold_cube(spark, sf_dir):
    return _rounded(_folded(spark, sf_dir).cube, "value", digits=3)


def fold_cube_subbands(spark, sf_dir):
    return _rounded(_folded(spark, sf_dir, 8).cube, "value", digits=3)


def fold_exposure(spark, sf_dir):
    return _rounded(_folded(spark, sf_dir).exposure, "exposure")


def fold_integrated(spark, sf_dir):
    return _rounded(_folded(spark, sf_dir).profile(), "phase", "profile", digits=3)


def fold_freq_phase(spark, sf_dir):
    return _rounded(_folded(spark, sf_dir).freq_phase(), "value", digits=3)


def fold_time_phase(spark, sf_dir):
    return _rounded(_folded(spark, sf_dir).time_phase(), "time", "value", digits=3)


def vector_sum(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    added = vector_add(F.col("embedding"), F.reverse("embedding"))
    rows = e.select("vec_id", F.posexplode(added).alias("k", "value"))
    return _rounded(rows, "value", digits=4)


def _file_round_trip(spark, rows: DataFrame, h: fb.Header, n: int) -> DataFrame:
    """Rows (t, ifno, chan, value) written as a file in the shared folder and read by rising frequency."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="chronofold-")
        atexit.register(shutil.rmtree, root, True)
    store, folder = pyarrow.fs.FileSystem.from_uri(root) if ":" in root else (pyarrow.fs.LocalFileSystem(), root)
    store.create_dir(folder, recursive=True)
    path = f"{root.rstrip('/')}/round-trip-{uuid.uuid4().hex}.fil"
    atexit.register(_forget, store, f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}")
    fb.write_filterbank(rows, h, path, nsamples=n)
    fb.register(spark)
    return spark.read.format("filterbank").option("chunkBytes", 1 << 16).load(path)


def _forget(store: pyarrow.fs.FileSystem, path: str) -> None:
    if store.get_file_info(path).type == pyarrow.fs.FileType.File:
        store.delete_file(path)


def filterbank_round_trip(spark, sf_dir):
    """The embedding spectra written as a file of 16-bit samples, channels falling, and read by ascending frequency."""
    s = embedding_samples(spark, sf_dir)
    rows = s.select("t", F.lit(0).alias("ifno"), (F.lit(NCHAN - 1) - F.col("chan")).alias("chan"), "value")
    h = fb.Header(nbits=16, nifs=1, nchans=NCHAN, tsamp=TSAMP, fch1=FREQUENCIES[-1], foff=-10.0, source_name="embeddings")
    return _file_round_trip(spark, rows, h, _n(s)).select("t", "chan", F.col("value").cast("long").alias("value"))


def filterbank_two_ifs(spark, sf_dir):
    """8-bit samples of two IFs, the second the first one's complement, with a falling frequency table."""
    s = embedding_samples(spark, sf_dir)
    both = s.select("t", (F.lit(NCHAN - 1) - F.col("chan")).alias("chan"), F.posexplode(F.array(F.col("value"), 255 - F.col("value"))).alias("ifno", "value"))
    h = fb.Header(nbits=8, nifs=2, nchans=NCHAN, tsamp=TSAMP, frequency_table=list(FREQUENCIES[::-1]), uses_frequency_table=True)
    return _file_round_trip(spark, both, h, _n(s)).select("t", "ifno", "chan", F.col("value").cast("long").alias("value"))


def filterbank_float(spark, sf_dir):
    """The embeddings themselves as 32-bit floating-point samples, channels rising."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.lit(0).alias("ifno"), F.posexplode("embedding").alias("chan", "value"))
    h = fb.Header(nbits=32, nifs=1, nchans=NCHAN, tsamp=TSAMP, fch1=FREQUENCIES[0], foff=10.0)
    return _rounded(_file_round_trip(spark, e, h, _n(e)).select("t", "chan", "value"), "value")


def dedisperse_float(spark, sf_dir):
    """Many trials over floating-point samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("chan", "value"))
    return _rounded(dd.dedisperse_multi(e, BAND, TRIALS, _n(e)), "value", digits=3)


def fold_by_seconds(spark, sf_dir):
    """A dedispersed spectrum folded with the subint's length in seconds."""
    s = embedding_samples(spark, sf_dir)
    n = dd.valid_samples(_n(s), BAND, dd.Trials(SINGLE_DM, 0.0, 1))
    spectrum = dd.dedisperse_spectrum(s, BAND, SINGLE_DM, _n(s))
    return _rounded(fo.fold_dedispersed_spectrum(spectrum, FOLD.period, TSAMP, FOLD.nbin, NCHAN, n, SUBINT * TSAMP).cube, "value", digits=3)


def dm_search(spark, sf_dir):
    """The flagship: dedisperse, condition, search, cluster."""
    found = _candidates(spark, sf_dir)[0].drop("best_peak")
    return _rounded(_rounded(found, "period", "frequency", "duty_cycle", "frequency_min", "frequency_max"), "snr", digits=2)


NAMES: tuple[Callable, ...] = (
    delay_table, valid_range, dedisperse_single, dedisperse_channel_range, dedisperse_spectrum, dedisperse_multi, dedisperse_blocks,
    dedisperse_subband, dm_time_series, ts_stats, shipping_stats, normalise, normalise_series, scrunch, running_median, detrend,
    fast_running_median, downsample, downsample_long, downsample_variance, preprocess, ffa_plan, width_trials, trial_periods,
    ffa_transform, ffa_search, boxcar_detect, dm_peaks, dm_peaks_topk, candidate_clusters, candidate_clusters_by_width, harmonic_flags,
    harmonic_removed, candidate_harmonics, candidate_harmonics_removed, harmonic_ratios, fold_profile, fold_cube, fold_cube_subbands, fold_exposure, fold_integrated, fold_freq_phase,
    fold_time_phase, fold_by_seconds, filterbank_round_trip, filterbank_two_ifs, filterbank_float, dedisperse_float, dm_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES} | {"vector_add": vector_sum}


# ---- SQL ----

_FB = """
s AS (SELECT CAST(vec_id AS BIGINT) AS t, CAST(c AS INTEGER) AS chan, CAST(floor((CAST(embedding[c + 1] AS DOUBLE) + 4) * 16) AS BIGINT) AS value
      FROM embeddings, range(64) AS r(c)),
n AS (SELECT max(t) + 1 AS n FROM s)"""


def _delays(low: float, step: float, count: int, begin: int = 0, end: int = NCHAN) -> str:
    return f"""
d AS (SELECT CAST(i AS INTEGER) AS dm_index, {low!r}::DOUBLE + i * {step!r}::DOUBLE AS dm, CAST(c AS INTEGER) AS chan, 1000.0::DOUBLE + 10 * c AS freq,
      CAST(round({DISPERSION}::DOUBLE * ({low!r}::DOUBLE + i * {step!r}::DOUBLE) * (1.0::DOUBLE / ((1000.0::DOUBLE + 10 * c) * (1000.0::DOUBLE + 10 * c)) - 1.0::DOUBLE / ({FREF}::DOUBLE * {FREF}::DOUBLE)) / {TSAMP}::DOUBLE) AS INTEGER) AS delay
      FROM range({count}) AS a(i), range({begin}, {end}) AS b(c)),
m AS (SELECT max(delay) AS m FROM d)"""


_ONE, _ALL = _delays(SINGLE_DM, 0.0, 1), _delays(0.0, 10.0, 8)
_FLOAT_FB = _FB.replace("CAST(floor((CAST(embedding[c + 1] AS DOUBLE) + 4) * 16) AS BIGINT)", "CAST(embedding[c + 1] AS DOUBLE)")
_SPEC = f"WITH {_FB}, {_ONE}, x AS (SELECT s.t - d.delay AS t, s.chan, s.value FROM s JOIN d USING (chan), n, m WHERE s.t - d.delay >= 0 AND s.t - d.delay < n.n - m.m)"
_MULTI = f"WITH {_FB}, {_ALL}, x AS (SELECT d.dm_index, d.dm, s.t - d.delay AS t, CAST(sum(s.value) AS BIGINT) AS value FROM s JOIN d USING (chan), n, m WHERE s.t - d.delay >= 0 AND s.t - d.delay < n.n - m.m GROUP BY ALL)"


def _subband() -> str:
    delay = lambda dm, f: f"CAST(round({DISPERSION}::DOUBLE * ({dm}) * (1.0::DOUBLE / (({f}) * ({f})) - 1.0::DOUBLE / ({FREF}::DOUBLE * {FREF}::DOUBLE)) / {TSAMP}::DOUBLE) AS INTEGER)"
    return f"""WITH {_FB}, {_ALL},
c AS (SELECT g, chan // 8 AS s, chan, {delay("g * 40.0::DOUBLE", "1000.0::DOUBLE + 10 * chan")} AS delay FROM range(2) AS a(g), range(64) AS b(chan)),
f AS (SELECT i // 4 AS g, s, CAST(i AS INTEGER) AS dm_index, i * 10.0::DOUBLE AS dm, {delay("i * 10.0::DOUBLE - (i // 4) * 40.0::DOUBLE", "1000.0::DOUBLE + 10 * (s * 8 + 3)")} AS rest FROM range(8) AS a(i), range(8) AS b(s)),
one AS (SELECT c.g, c.s, s.t - c.delay AS u, sum(s.value) AS value FROM s JOIN c USING (chan), n WHERE s.t - c.delay >= 0 AND s.t - c.delay < n.n GROUP BY ALL)
SELECT f.dm_index, f.dm, one.u - f.rest AS t, CAST(sum(one.value) AS BIGINT) AS value FROM one JOIN f ON one.g = f.g AND one.s = f.s, n, m
WHERE one.u - f.rest >= 0 AND one.u - f.rest < n.n - m.m GROUP BY ALL"""


_EV = f"""
h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL),
h0 AS (SELECT min(h) AS h0 FROM h),
e AS (SELECT g.event_type, CAST(g.t AS BIGINT) AS t, CAST(coalesce(h.n, 0) AS BIGINT) AS value
      FROM (SELECT DISTINCT event_type, t FROM h, range({HOURS}) AS r(t)) g CROSS JOIN h0 LEFT JOIN h ON h.event_type = g.event_type AND h.h = h0.h0 + to_hours(CAST(g.t AS BIGINT)))"""
_STATS = "st AS (SELECT event_type, avg(CAST(value AS DOUBLE)) AS mean, avg(CAST(value AS DOUBLE) * value) - avg(CAST(value AS DOUBLE)) * avg(CAST(value AS DOUBLE)) AS variance FROM e GROUP BY ALL)"


def _median(source: str, n: str, window: int, name: str) -> str:
    """``name``(event_type, t, value): the running median of ``source`` (event_type, t, value), edges repeated."""
    half = window // 2
    return f"""
{name}_p AS (SELECT q.event_type, q.t, x.value FROM (SELECT DISTINCT event_type, r.t FROM {source}, range(-{half}, {n} + {half}) AS r(t)) AS q(event_type, t)
      JOIN {source} x ON x.event_type = q.event_type AND x.t = least(greatest(q.t, 0), {n} - 1)),
{name} AS (SELECT event_type, t, value FROM (SELECT event_type, t, quantile_disc(value, 0.5) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS value FROM {name}_p) WHERE t >= 0 AND t < {n})"""


_MEDIAN_SOURCE = "ee AS (SELECT event_type, t, value FROM e)"
_MED = f"WITH {_EV}, {_median('e', str(HOURS), WINDOW, 'md')}"
_NLOW = HOURS // 7
_FAST = f"""WITH {_EV}, lo AS (SELECT event_type, t // 7 AS t, CAST(avg(CAST(value AS DOUBLE)) AS FLOAT) AS value FROM e WHERE t < {_NLOW * 7} GROUP BY event_type, t // 7), {_median('lo', str(_NLOW), FAST_POINTS, 'md')},
p AS (SELECT event_type, t, least(greatest((t - 3) / 7.0::DOUBLE, 0), {_NLOW - 1}) AS x FROM e)
SELECT p.event_type, p.t, round(CAST(CAST(a.value * (1 - (x - floor(x))) + b.value * (x - floor(x)) AS FLOAT) AS DOUBLE), 3) AS value
FROM p JOIN md a ON a.event_type = p.event_type AND a.t = CAST(floor(x) AS BIGINT) JOIN md b ON b.event_type = p.event_type AND b.t = least(CAST(floor(x) AS BIGINT) + 1, {_NLOW - 1})"""

_DOWN = f"""WITH {_EV}, k AS (SELECT k, k * 2.5::DOUBLE AS a, (k + 1) * 2.5::DOUBLE AS b FROM range({int(HOURS / FACTOR)}) AS r(k))
SELECT e.event_type, CAST(k.k AS BIGINT) AS t, CAST(sum((least(e.t + 1, k.b) - greatest(e.t, k.a)) * e.value) AS DOUBLE) AS value
FROM e JOIN k ON e.t < k.b AND e.t + 1 > k.a GROUP BY e.event_type, k.k"""

_PREP = f"""{_MED}, x AS (SELECT e.event_type, e.t, CAST(e.value - md.value AS DOUBLE) AS v FROM e JOIN md ON e.event_type = md.event_type AND e.t = md.t),
st AS (SELECT event_type, avg(v) AS mean, sqrt(avg(v * v) - avg(v) * avg(v)) AS std FROM x GROUP BY ALL)
SELECT x.event_type, x.t, round(CAST(CAST((v - mean) * (1.0::DOUBLE / std) AS FLOAT) AS DOUBLE), 4) AS value FROM x JOIN st ON x.event_type = st.event_type"""

_PLAN = """WITH RECURSIVE o AS (SELECT 64::BIGINT AS n, 0.25::DOUBLE AS ts, 1.0::DOUBLE AS pmin, least(4.0::DOUBLE, 64 * 0.25::DOUBLE / 2) AS pmax, 4 AS b0, 5 AS b1, 2 AS mp),
c AS (SELECT j, pmin / (ts * b0) * power(CAST(b1 + 1 AS DOUBLE) / b0, j) AS f FROM o, range(20) AS r(j) WHERE j < ceil(ln(pmax / pmin) / ln(CAST(b1 + 1 AS DOUBLE) / b0))),
t AS (SELECT j, f, f * ts AS ets, n, CASE WHEN f = 1 THEN n ELSE CAST(floor(n / f) AS BIGINT) END AS pn, pmax / (f * ts) AS ps, b0, b1, mp FROM c, o),
b AS (SELECT t.*, CAST(bins AS INTEGER) AS bins, pn // bins AS rows FROM t, range(4, 6) AS r(bins) WHERE bins <= least(b1, pn, floor(ps)) AND pn // bins >= mp),
e AS (SELECT *, CAST(least(rows, ceil(bins * (rows - 1.0::DOUBLE) * (1 - bins / least(ps, bins + 1.0::DOUBLE)))) AS BIGINT) AS re FROM b)
, q AS (SELECT CAST(row_number() OVER (ORDER BY j, bins) - 1 AS INTEGER) AS task_id, * FROM e WHERE re > 0)"""

_GATHER = f"""WITH RECURSIVE {_EV}, g(s, row0, r, sh, off) AS (
  SELECT s, 0, {HOURS // BINS}, s, 0 FROM range({HOURS // BINS}) AS x(s)
  UNION ALL
  SELECT s, CASE WHEN part = 0 THEN row0 ELSE row0 + r // 2 END, CASE WHEN part = 0 THEN r // 2 ELSE r - r // 2 END,
    CASE WHEN part = 0 THEN h ELSE t END, CASE WHEN part = 0 THEN off ELSE off + sh - t END
  FROM (SELECT g.*, CAST(floor(CAST(CAST(CAST(r // 2 - 1 AS FLOAT) / CAST(r - 1 AS FLOAT) AS FLOAT) * CAST(sh AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT)) AS BIGINT) AS h,
    CAST(floor(CAST(CAST(CAST(r - r // 2 - 1 AS FLOAT) / CAST(r - 1 AS FLOAT) AS FLOAT) * CAST(sh AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT)) AS BIGINT) AS t
    FROM g WHERE r > 1) y, range(2) AS z(part)),
tr AS (SELECT e.event_type, CAST(g.s AS BIGINT) AS shift, CAST(b AS INTEGER) AS bin, CAST(sum(e.value) AS BIGINT) AS value
  FROM g, range({BINS}) AS q(b), e WHERE g.r = 1 AND e.t = g.row0 * {BINS} + (b + g.off) % {BINS} GROUP BY ALL)"""
_BOX = f"""{_GATHER}, w(width_index, w) AS (VALUES {", ".join(f"({k}, {w})" for k, w in enumerate(make_plan(HOURS, 1.0, SearchOptions(24.0, 25.0, 24, 24, 4)).widths))}),
sm AS (SELECT a.event_type, a.shift, w.width_index, w.w, a.bin AS phase, CAST(sum(x.value) AS DOUBLE) AS box FROM tr a, w, range({BINS}) AS o(k), tr x
  WHERE k < w.w AND x.event_type = a.event_type AND x.shift = a.shift AND x.bin = (a.bin + k) % {BINS} GROUP BY ALL),
tt AS (SELECT event_type, shift, CAST(sum(value) AS DOUBLE) AS total FROM tr GROUP BY ALL),
pk AS (SELECT event_type, shift, width_index, w, max(box) AS box, first(phase ORDER BY box DESC, phase) AS phase FROM sm GROUP BY ALL),
sn AS (SELECT pk.*, (sqrt(({BINS} - w) / CAST({BINS} * w AS DOUBLE)) * (1 + w / CAST({BINS} - w AS DOUBLE)) * box - w / CAST({BINS} - w AS DOUBLE) * sqrt(({BINS} - w) / CAST({BINS} * w AS DOUBLE)) * total) / sqrt({HOURS // BINS}::DOUBLE) AS snr
  FROM pk JOIN tt USING (event_type, shift))"""

_PK = """pk AS (SELECT CAST(c_custkey % 40 AS INTEGER) AS dm_index, 0.5::DOUBLE * (c_custkey % 40) AS dm, 1.0::DOUBLE + (c_custkey * 7919 % 10007) / 1024.0::DOUBLE AS frequency,
  CAST(6.0::DOUBLE + (c_custkey * 104729 % 4096) / 64.0::DOUBLE AS FLOAT) AS snr, CAST(c_custkey % 3 + 1 AS INTEGER) AS width, (c_custkey % 3 + 1) / 64.0::DOUBLE AS duty_cycle,
  CAST(c_custkey % 64 AS INTEGER) AS phase, CAST(c_custkey AS BIGINT) AS shift FROM customer)"""


def _cluster_tables(across: bool, peaks: str = "", radius: str = f"0.03::DOUBLE / {T_OBS}::DOUBLE", trials: int = 2) -> str:
    """``peaks`` defines pk; chains of it by frequency and trial, and in g the best of each, ranked."""
    order = "dm_index, width, frequency" if across else "width, dm_index, frequency"
    split = "" if across else f" OR width <> lag(width) OVER (PARTITION BY f ORDER BY {order})"
    return f"""{peaks or _PK}, a AS (SELECT *, CASE WHEN frequency - lag(frequency) OVER (ORDER BY frequency, width, dm_index) > {radius} THEN 1 ELSE 0 END AS cut FROM pk),
b AS (SELECT *, sum(cut) OVER (ORDER BY frequency, width, dm_index ROWS UNBOUNDED PRECEDING) AS f FROM a),
c AS (SELECT *, CASE WHEN dm_index > lag(dm_index) OVER (PARTITION BY f ORDER BY {order}) + {trials}{split} THEN 1 ELSE 0 END AS cut2 FROM b),
dd AS (SELECT *, sum(cut2) OVER (PARTITION BY f ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS c FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY f, c ORDER BY snr DESC, frequency DESC, width, phase, shift, dm_index) AS k, count(*) OVER (PARTITION BY f, c) AS n,
  min(dm_index) OVER (PARTITION BY f, c) AS d0, max(dm_index) OVER (PARTITION BY f, c) AS d1, min(frequency) OVER (PARTITION BY f, c) AS f0, max(frequency) OVER (PARTITION BY f, c) AS f1 FROM dd),
g AS (SELECT *, row_number() OVER (ORDER BY snr DESC, frequency DESC, width, phase, shift, dm_index, n DESC) - 1 AS r FROM e WHERE k = 1)"""


def _clusters(across: bool, cap: int) -> str:
    return f"""WITH {_cluster_tables(across)}
SELECT dm, dm_index, round(frequency, 6) AS frequency, width, duty_cycle, round(CAST(snr AS DOUBLE), 6) AS snr, CAST(n AS BIGINT) AS peak_count, d0 AS dm_index_min, d1 AS dm_index_max,
  f0 AS frequency_min, f1 AS frequency_max, CAST(r AS INTEGER) AS candidate_rank, shift AS best_shift FROM g{f" WHERE r < {cap}" if cap else ""}"""


_H = TABLE_HARMONICS
_BAND_DELAY = DISPERSION * abs(1 / _H.frequency_low**2 - 1 / _H.frequency_high**2)


def _harmonic(tables: str, seconds: str, digits: int) -> str:
    """Flags in fl of the candidates in g; ``seconds``: the observation's length."""
    return f"""{tables},
ca AS (SELECT row_number() OVER (ORDER BY snr DESC, n DESC, frequency, dm_index) - 1 AS i, frequency AS hz, 1.0::DOUBLE / frequency * duty_cycle AS seconds, duty_cycle AS duty, dm, dm_index, CAST(snr AS DOUBLE) AS snr, n FROM g),
ra AS (SELECT DISTINCT x // gcd(x, y) AS p, y // gcd(x, y) AS q, CAST(x // gcd(x, y) AS DOUBLE) / (y // gcd(x, y)) AS v FROM range(1, {_H.max_harmonic + 1}) AS o(x), range(1, {_H.denominator_max + 1}) AS u(y) WHERE x <> y),
ne AS (SELECT a.i AS parent, h.i AS child, min({{'off': abs(v - h.hz / a.hz), 'below': -v, 'p': p, 'q': q, 'v': v}}) AS near FROM ca a, ca h, ra WHERE a.i < h.i GROUP BY ALL),
er AS (SELECT ne.*, abs(h.hz - a.hz * near.v) * {seconds} AS err, CASE WHEN h.hz >= a.hz THEN h.duty ELSE a.duty END AS duty,
  abs(a.dm - h.dm) * {_BAND_DELAY!r}::DOUBLE * {_H.delay_scale}::DOUBLE / least(a.seconds, h.seconds) AS dist, a.snr / sqrt(CAST(near.p * near.q AS DOUBLE)) AS want, h.snr AS snr
  FROM ne JOIN ca a ON a.i = parent JOIN ca h ON h.i = child),
ok AS MATERIALIZED (SELECT *, err / duty AS phase, abs(snr - want) AS miss FROM er WHERE err <= {_H.frequency_tolerance_bins}::DOUBLE AND err / duty <= {_H.phase_distance_max}::DOUBLE AND dist <= {_H.dm_distance_max}::DOUBLE),
st(k, i, parent) AS (
  SELECT CAST(0 AS BIGINT), i, CAST(NULL AS BIGINT) FROM ca
  UNION ALL
  SELECT s.k + 1, s.i, CASE WHEN s.parent IS NULL AND s.used = 0 AND ok.child IS NOT NULL THEN s.k ELSE s.parent END
  FROM (SELECT *, max(CASE WHEN i = k AND parent IS NOT NULL THEN 1 ELSE 0 END) OVER () AS used FROM st) s LEFT JOIN ok ON ok.parent = s.k AND ok.child = s.i
  WHERE s.k < (SELECT count(*) FROM ca)),
hf AS (SELECT i, parent FROM st WHERE k = (SELECT count(*) FROM ca)),
fl AS (SELECT CAST(ca.i AS BIGINT) AS harmonic_rank, round(ca.hz, 6) AS frequency, ca.dm, ca.dm_index, round(ca.snr, {digits}) AS snr, CAST(ca.n AS BIGINT) AS peak_count, hf.parent IS NOT NULL AS is_harmonic,
  coalesce(hf.parent, -1) AS parent_index, CAST(coalesce(near.p, 0) AS INTEGER) AS numerator, CAST(coalesce(near.q, 0) AS INTEGER) AS denominator, round(coalesce(err, 0), 6) AS frequency_error_bins,
  round(coalesce(phase, 0), 6) AS phase_distance, round(coalesce(dist, 0), 6) AS dm_distance, round(coalesce(want, 0), {digits}) AS expected_snr, round(coalesce(miss, 0), {digits}) AS snr_distance
  FROM ca JOIN hf ON hf.i = ca.i LEFT JOIN ok ON ok.parent = hf.parent AND ok.child = ca.i)"""


_HARMONIC = _harmonic(f"WITH RECURSIVE {_cluster_tables(True)}", f"{_H.observation_seconds}::DOUBLE", 6)


def _dm_search() -> str:
    """pk: the peaks of the search over trials, from samples to signal to noise, in double precision."""
    o = DM_OPTIONS
    widths = make_plan(10_000, TSAMP, o).widths
    half = cond.median_window(0.5, TSAMP) // 2
    part = lambda r, n: f"CAST(floor(CAST(CAST(CAST({n} - 1 AS FLOAT) / CAST({r} - 1 AS FLOAT) AS FLOAT) * CAST(sh AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT)) AS BIGINT)"
    return f"""WITH RECURSIVE {_FB}, {_ALL}, x AS (SELECT d.dm_index, d.dm, s.t - d.delay AS t, CAST(sum(s.value) AS DOUBLE) AS value FROM s JOIN d USING (chan), n, m WHERE s.t - d.delay >= 0 AND s.t - d.delay < n.n - m.m GROUP BY ALL),
no AS (SELECT n.n - m.m AS n FROM n, m),
mp AS (SELECT dm_index, q.t, x.value FROM (SELECT unnest(range(-{half}, n + {half})) AS t, n FROM no) q JOIN x ON x.t = least(greatest(q.t, 0), q.n - 1)),
md AS (SELECT dm_index, t, quantile_disc(value, 0.5) OVER (PARTITION BY dm_index ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS md FROM mp),
z AS (SELECT x.dm_index, x.dm, x.t, x.value - md AS v FROM x JOIN md ON md.dm_index = x.dm_index AND md.t = x.t),
sd AS (SELECT dm_index, avg(v) AS mean, sqrt(avg(v * v) - avg(v) * avg(v)) AS std FROM z GROUP BY dm_index),
se AS (SELECT z.dm_index, dm, t, CAST(CAST((v - mean) * (1.0::DOUBLE / std) AS FLOAT) AS DOUBLE) AS v FROM z JOIN sd ON sd.dm_index = z.dm_index),
lo AS (SELECT n, least({o.period_max}::DOUBLE, n * {TSAMP}::DOUBLE / {o.min_periods}) AS pmax FROM no),
cy AS (SELECT n, pmax, j, {o.period_min}::DOUBLE / ({TSAMP}::DOUBLE * {o.bins_min}) * power({o.bins_max + 1}.0::DOUBLE / {o.bins_min}, j) AS f
  FROM lo, range(60) AS r(j) WHERE j < ceil(ln(pmax / {o.period_min}::DOUBLE) / ln({o.bins_max + 1}.0::DOUBLE / {o.bins_min}))),
fa AS (SELECT *, f * {TSAMP}::DOUBLE AS ets, CASE WHEN f = 1 THEN n ELSE CAST(floor(n / f) AS BIGINT) END AS pn, floor(n / f) * (f - floor(f)) AS slip FROM cy),
ta AS (SELECT *, pn // bins AS rows, least(pmax / ets, bins + 1.0::DOUBLE) AS reach,
  CASE WHEN f = 1 THEN 1.0 WHEN slip > 1 THEN f - 1 / 3.0::DOUBLE ELSE (floor(f) - 1) * (floor(f) - 1) + 2 / 3.0::DOUBLE * slip * slip - slip + 1 END AS var
  FROM fa, range({o.bins_min}, {o.bins_max + 1}) AS r(bins) WHERE bins <= least(pn, floor(pmax / ets)) AND pn // bins >= {o.min_periods}),
tk AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(least(rows, ceil(bins * (rows - 1.0::DOUBLE) * (1 - bins / reach))) AS BIGINT) AS re FROM ta) WHERE re > 0),
iv AS (SELECT j, f, unnest(range(pn)) AS k FROM fa),
ds AS MATERIALIZED (SELECT se.dm_index, iv.j, iv.k, sum((least(se.t + 1, (iv.k + 1) * iv.f) - greatest(se.t, iv.k * iv.f)) * se.v) AS v
  FROM iv JOIN se ON se.t < (iv.k + 1) * iv.f AND se.t + 1 > iv.k * iv.f GROUP BY ALL),
ga(whole, s, row0, r, sh, off) AS (
  SELECT rows, s, 0::BIGINT, rows, s, 0::BIGINT FROM (SELECT rows, max(re) AS re FROM tk GROUP BY rows) y, range(10000) AS w(s) WHERE s < re
  UNION ALL
  SELECT whole, s, CASE WHEN part = 0 THEN row0 ELSE row0 + r // 2 END, CASE WHEN part = 0 THEN r // 2 ELSE r - r // 2 END, CASE WHEN part = 0 THEN h ELSE t END, CASE WHEN part = 0 THEN off ELSE off + sh - t END
  FROM (SELECT ga.*, {part("r", "r // 2")} AS h, {part("r", "(r - r // 2)")} AS t FROM ga WHERE r > 1) y, range(2) AS w(part)),
tr AS MATERIALIZED (SELECT ds.dm_index, tk.j, tk.bins, ga.s, b.b, sum(ds.v) AS v
  FROM tk JOIN ga ON ga.whole = tk.rows AND ga.s < tk.re AND ga.r = 1, range({o.bins_max}) AS b(b), ds
  WHERE b.b < tk.bins AND ds.j = tk.j AND ds.k = ga.row0 * tk.bins + (b.b + ga.off) % tk.bins GROUP BY ALL),
wi(width_index, w) AS (VALUES {", ".join(f"({k}, {w})" for k, w in enumerate(widths))}),
bx AS (SELECT a.dm_index, a.j, a.bins, a.s, wi.width_index, wi.w, a.b AS phase, sum(c.v) AS box
  FROM tr a, wi, range({max(widths)}) AS o(o), tr c WHERE o < wi.w AND c.dm_index = a.dm_index AND c.j = a.j AND c.bins = a.bins AND c.s = a.s AND c.b = (a.b + o) % a.bins GROUP BY ALL),
tt AS (SELECT dm_index, j, bins, s, sum(v) AS total FROM tr GROUP BY ALL),
be AS (SELECT dm_index, j, bins, s, width_index, w, max(box) AS box, first(phase ORDER BY box DESC, phase) AS phase FROM bx GROUP BY ALL),
sn AS (SELECT be.*, tk.ets, tk.rows, (sqrt((be.bins - w) / CAST(be.bins * w AS DOUBLE)) * (1 + w / CAST(be.bins - w AS DOUBLE)) * box - w / CAST(be.bins - w AS DOUBLE) * sqrt((be.bins - w) / CAST(be.bins * w AS DOUBLE)) * total) / sqrt(tk.rows * var) AS snr
  FROM be JOIN tt ON tt.dm_index = be.dm_index AND tt.j = be.j AND tt.bins = be.bins AND tt.s = be.s JOIN tk ON tk.j = be.j AND tk.bins = be.bins),
pk AS MATERIALIZED (SELECT sn.dm_index, dm.dm, ets * bins * bins / (bins - s / (rows - 1.0::DOUBLE)) AS period, 1 / (ets * bins * bins / (bins - s / (rows - 1.0::DOUBLE))) AS frequency, snr,
  CAST(w AS INTEGER) AS width, w / CAST(bins AS DOUBLE) AS duty_cycle, CAST(phase AS INTEGER) AS phase, CAST(s AS BIGINT) AS shift, CAST(bins AS INTEGER) AS bins, width_index, CAST(s AS BIGINT) AS period_index
  FROM sn JOIN (SELECT DISTINCT dm_index, dm FROM d) dm ON dm.dm_index = sn.dm_index WHERE snr >= {DM_SNR})"""


_PEAK_SHOWN = "dm_index, dm, round(period, 6) AS period, round(frequency, 6) AS frequency, round(snr, 2) AS snr, width, round(duty_cycle, 6) AS duty_cycle, phase, shift, bins, width_index, period_index"
_DM_TABLES = _cluster_tables(True, _dm_search(), f"0.1::DOUBLE / ((SELECT n FROM n) * {TSAMP}::DOUBLE)", 1)
_DM_HARMONIC = _harmonic(_DM_TABLES, f"((SELECT n FROM n) * {TSAMP}::DOUBLE)", 1)


def _fold(source: str, select: str, by: str) -> str:
    """Overlap sums of ``source`` (t, ...) over phase bins, grouped."""
    step = f"({TSAMP}::DOUBLE / {FOLD.period}::DOUBLE * {FOLD.nbin})"
    return f"""SELECT {by}, CAST(((b % {FOLD.nbin}) + {FOLD.nbin}) % {FOLD.nbin} AS INTEGER) AS bin, {select} FROM (SELECT *, least(lo + {step}, b + 1) - greatest(lo, b) AS w
FROM (SELECT *, unnest(range(CAST(floor(lo) AS BIGINT), greatest(CAST(ceil(lo + {step}) AS BIGINT), CAST(floor(lo) AS BIGINT) + 1))) AS b FROM (SELECT *, t * {step} AS lo FROM {source}))) WHERE w > 0 GROUP BY ALL"""


_CUBE = f"""{_SPEC}, nt AS (SELECT max(t) + 1 AS nt FROM x), tk AS (SELECT DISTINCT t FROM x),
ex AS ({_fold("tk", "sum(w) AS exposure", f"CAST(t // {SUBINT} AS INTEGER) AS subint")}),
su AS ({_fold("x", "sum(CAST(value AS DOUBLE) * w) AS s", f"CAST(t // {SUBINT} AS INTEGER) AS subint, chan")}),
gr AS (SELECT CAST(i AS INTEGER) AS subint, CAST(b AS INTEGER) AS bin FROM nt, range(10000) AS q(i), range({FOLD.nbin}) AS r(b) WHERE i * {SUBINT} < nt.nt),
ee AS (SELECT gr.subint, gr.bin, coalesce(ex.exposure, 0) AS exposure FROM gr LEFT JOIN ex ON ex.subint = gr.subint AND ex.bin = gr.bin),
cu AS (SELECT ee.subint, CAST(c AS INTEGER) AS chan, ee.bin, ee.exposure, CAST(CASE WHEN ee.exposure > 0 THEN coalesce(su.s, 0) / ee.exposure ELSE 0 END AS FLOAT) AS value
  FROM ee CROSS JOIN range({NCHAN}) AS q(c) LEFT JOIN su ON su.subint = ee.subint AND su.chan = c AND su.bin = ee.bin)"""
_BANDS = _CUBE.replace(", nt AS", ", x8 AS (SELECT t, chan // 8 AS chan, avg(CAST(value AS DOUBLE)) AS value FROM x GROUP BY t, chan // 8), nt AS", 1).replace("FROM (SELECT *, t * (0.01::DOUBLE / 0.25::DOUBLE * 16) AS lo FROM x)", "FROM (SELECT *, t * (0.01::DOUBLE / 0.25::DOUBLE * 16) AS lo FROM x8)").replace(f"range({NCHAN}) AS q(c)", "range(8) AS q(c)")


def oracle_sql() -> dict[str, str]:
    sql = {
        "delay_table": f"WITH {_ALL} SELECT dm_index, dm, chan, freq, delay FROM d",
        "valid_range": f"WITH {_FB}, {_ALL} SELECT n.n AS nsamples, CAST(m.m AS BIGINT) AS max_delay, n.n - m.m AS nout FROM n, m",
        "dedisperse_single": f"{_SPEC} SELECT t, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY t",
        "dedisperse_channel_range": f"WITH {_FB}, {_delays(SINGLE_DM, 0.0, 1, 16, 48)}, x AS (SELECT s.t - d.delay AS t, s.chan, s.value FROM s JOIN d USING (chan), n, m WHERE s.t - d.delay >= 0 AND s.t - d.delay < n.n - m.m) SELECT t, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY t",
        "dedisperse_spectrum": f"{_SPEC} SELECT t, chan, value FROM x",
        "dedisperse_multi": f"{_MULTI} SELECT * FROM x",
        "dedisperse_blocks": f"{_MULTI} SELECT * FROM x",
        "dedisperse_subband": _subband(),
        "dm_time_series": f"{_MULTI} SELECT t, CAST(value AS FLOAT) AS value FROM x WHERE dm_index = 3",
        "ts_stats": f"WITH {_EV}, {_STATS} SELECT event_type, round(mean, 6) AS mean, round(variance, 6) AS variance, round(sqrt(variance), 6) AS stddev FROM st",
        "shipping_stats": "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS v FROM lineitem GROUP BY ALL) SELECT 'shipping' AS series, round(avg(v), 4) AS mean, round(avg(v * v) - avg(v) * avg(v), 4) AS variance, round(sqrt(avg(v * v) - avg(v) * avg(v)), 4) AS stddev FROM d",
        "normalise": f"WITH {_EV}, {_STATS} SELECT e.event_type, t, round(CAST(CAST((value - mean) * (1.0::DOUBLE / sqrt(variance)) AS FLOAT) AS DOUBLE), 4) AS value FROM e JOIN st ON e.event_type = st.event_type",
        "scrunch": f"WITH {_EV} SELECT event_type, t // 7 AS t, round(avg(CAST(value AS DOUBLE)), 6) AS value FROM e WHERE t < {_NLOW * 7} GROUP BY event_type, t // 7",
        "running_median": f"{_MED} SELECT event_type, CAST(t AS BIGINT) AS t, value FROM md",
        "detrend": f"{_MED} SELECT e.event_type, e.t, e.value - md.value AS value FROM e JOIN md ON e.event_type = md.event_type AND e.t = md.t",
        "fast_running_median": _FAST,
        "downsample": _DOWN,
        "downsample_long": _DOWN,
        "downsample_variance": "WITH c(n, factor) AS (VALUES " + ", ".join(f"({n}::BIGINT, {f}::DOUBLE)" for n, f in CASES) + "), s AS (SELECT *, floor(factor) AS w, floor(n / factor) * (factor - floor(factor)) AS s FROM c) SELECT n, factor, round(CASE WHEN s > 1 THEN factor - 1 / 3.0::DOUBLE ELSE (w - 1) * (w - 1) + 2 / 3.0::DOUBLE * s * s - s + 1 END, 9) AS variance FROM s",
        "preprocess": _PREP,
        "ffa_plan": f"{_PLAN} SELECT task_id, round(f, 9) AS downsample_factor, round(ets, 9) AS effective_tsamp, n AS input_nsamples, pn AS prepared_nsamples, bins, rows, re AS rows_eval, round(ets * bins, 9) AS period_begin, round(ets * bins * bins / (bins - (re - 1) / (rows - 1.0::DOUBLE)), 9) AS period_end FROM q",
        "width_trials": "WITH RECURSIVE w(k, w) AS (SELECT 0, 1 UNION ALL SELECT k + 1, greatest(w + 1, CAST(floor(1.5::DOUBLE * w) AS INTEGER)) FROM w WHERE greatest(w + 1, floor(1.5::DOUBLE * w)) <= floor(0.2::DOUBLE * 240)) SELECT k AS width_index, w AS width FROM w",
        "trial_periods": f"{_PLAN} SELECT task_id, CAST(s AS BIGINT) AS shift, round(ets * bins * bins / (bins - s / (rows - 1.0::DOUBLE)), 9) AS period FROM q, range(100) AS z(s) WHERE s < re",
        "ffa_transform": f"{_GATHER} SELECT * FROM tr",
        "boxcar_detect": f"{_BOX} SELECT event_type, shift, w AS width, phase, round(snr, 2) AS snr FROM sn WHERE shift < {make_plan(HOURS, 1.0, SearchOptions(24.0, 25.0, 24, 24, 4)).tasks[0].rows_eval}",
        "ffa_search": f"{_BOX} SELECT event_type, w AS width, phase, shift, {BINS} AS bins, width_index, shift AS period_index, round({BINS * BINS} / ({BINS} - shift / {HOURS // BINS - 1}.0::DOUBLE), 6) AS period, round(({BINS} - shift / {HOURS // BINS - 1}.0::DOUBLE) / {BINS * BINS}, 6) AS frequency, round(w / {BINS}.0::DOUBLE, 6) AS duty_cycle, round(snr, 2) AS snr FROM sn WHERE snr >= {EVENT_SNR} AND shift < {make_plan(HOURS, 1.0, SearchOptions(24.0, 25.0, 24, 24, 4)).tasks[0].rows_eval}",
        "candidate_clusters": _clusters(True, 0),
        "candidate_harmonics": f"{_HARMONIC} SELECT * FROM fl",
        "candidate_harmonics_removed": f"{_HARMONIC} SELECT * FROM fl WHERE NOT is_harmonic ORDER BY harmonic_rank LIMIT 200",
        "candidate_clusters_by_width": _clusters(False, 25),
        "dm_peaks": f"{_dm_search()} SELECT {_PEAK_SHOWN} FROM pk WHERE pk.snr >= {SHOWN_SNR}",
        "dm_peaks_topk": f"{_dm_search()} SELECT {_PEAK_SHOWN} FROM pk ORDER BY pk.snr DESC, pk.period LIMIT 20",
        "dm_search": f"{_DM_TABLES} SELECT dm, dm_index, round(period, 6) AS period, round(frequency, 6) AS frequency, width, round(duty_cycle, 6) AS duty_cycle, round(snr, 2) AS snr, CAST(n AS BIGINT) AS peak_count, d0 AS dm_index_min, d1 AS dm_index_max, round(f0, 6) AS frequency_min, round(f1, 6) AS frequency_max, CAST(r AS INTEGER) AS candidate_rank FROM g",
        "harmonic_flags": f"{_DM_HARMONIC} SELECT * FROM fl",
        "harmonic_removed": f"{_DM_HARMONIC} SELECT * FROM fl WHERE NOT is_harmonic ORDER BY harmonic_rank LIMIT 50",
        "harmonic_ratios": "WITH r AS (SELECT DISTINCT p // gcd(p, q) AS p, q // gcd(p, q) AS q FROM range(1, 17) AS a(p), range(1, 6) AS b(q)) SELECT CAST(row_number() OVER (ORDER BY p / CAST(q AS DOUBLE)) - 1 AS INTEGER) AS ratio_index, CAST(p AS INTEGER) AS numerator, CAST(q AS INTEGER) AS denominator FROM r WHERE p <> q",
        "fold_profile": f"{_SPEC}, ts AS (SELECT t, CAST(sum(value) AS DOUBLE) AS v FROM x GROUP BY t), f AS ({_fold('ts', 'sum(v * w) AS s, sum(w) AS e', '1 AS one')}) SELECT CAST(b AS INTEGER) AS bin, round(b / {FOLD.nbin}.0::DOUBLE, 3) AS phase, round(CAST(CAST(coalesce(s / e, 0) AS FLOAT) AS DOUBLE), 3) AS profile, round(coalesce(e, 0), 3) AS exposure FROM range({FOLD.nbin}) AS q(b) LEFT JOIN f ON f.bin = b",
        "fold_cube": f"{_CUBE} SELECT subint, chan, bin, round(CAST(value AS DOUBLE), 3) AS value FROM cu",
        "fold_cube_subbands": f"{_BANDS} SELECT subint, chan, bin, round(CAST(value AS DOUBLE), 3) AS value FROM cu",
        "fold_exposure": f"{_CUBE} SELECT subint, bin, round(exposure, 6) AS exposure FROM ee",
        "fold_integrated": f"{_CUBE} SELECT bin, round(bin / {FOLD.nbin}.0::DOUBLE, 3) AS phase, round(CAST(CAST(CASE WHEN sum(exposure) > 0 THEN sum(value * exposure) / sum(exposure) ELSE 0 END AS FLOAT) AS DOUBLE), 3) AS profile FROM cu GROUP BY bin",
        "fold_freq_phase": f"{_CUBE} SELECT chan, bin, round(CAST(CAST(CASE WHEN sum(exposure) > 0 THEN sum(value * exposure) / sum(exposure) ELSE 0 END AS FLOAT) AS DOUBLE), 3) AS value FROM cu GROUP BY chan, bin",
        "fold_time_phase": f"{_CUBE} SELECT subint, round((subint + 0.5::DOUBLE) * ({SUBINT} * {TSAMP}::DOUBLE), 3) AS time, bin, round(CAST(CAST(avg(CAST(value AS DOUBLE)) AS FLOAT) AS DOUBLE), 3) AS value FROM cu GROUP BY subint, bin",
        "filterbank_round_trip": f"WITH {_FB} SELECT t, chan, value FROM s",
        "filterbank_two_ifs": f"WITH {_FB} SELECT t, CAST(i AS INTEGER) AS ifno, chan, CAST(CASE WHEN i = 0 THEN value ELSE 255 - value END AS BIGINT) AS value FROM s, range(2) AS r(i)",
        "filterbank_float": "SELECT CAST(vec_id AS BIGINT) AS t, CAST(c AS INTEGER) AS chan, round(CAST(embedding[c + 1] AS DOUBLE), 6) AS value FROM embeddings, range(64) AS r(c)",
        "dedisperse_float": f"{_MULTI.replace(_FB, _FLOAT_FB).replace('CAST(sum(s.value) AS BIGINT)', 'sum(s.value)')} SELECT dm_index, dm, t, round(CAST(value AS DOUBLE), 3) AS value FROM x",
        "fold_by_seconds": f"{_CUBE} SELECT subint, chan, bin, round(CAST(value AS DOUBLE), 3) AS value FROM cu",
        "vector_add": "SELECT vec_id, CAST(k AS INTEGER) AS k, round(CAST(embedding[k + 1] + embedding[64 - k] AS DOUBLE), 4) AS value FROM embeddings, range(64) AS r(k)",
    }
    sql["normalise_series"] = sql["normalise"]
    return sql
