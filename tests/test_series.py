"""Golden values, invariants and the error contract of the time-series engine."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronofold import api
from chronofold.functions.numerics import delay_of, half_away, vector_add
from chronofold.operators import candidates as cand
from chronofold.operators import conditioning as cond
from chronofold.operators import dedisperse as dd
from chronofold.operators import ffa
from chronofold.operators import fold as fo
from chronofold.plans.ffa_plan import Plan, SearchOptions, Task, make_plan, width_trials
from chronofold.sources import filterbank as fb
from chronofold.sources.tables import samples_from_numpy, series_from_numpy

TSAMP = 0.003111606


def _samples(spark, rows, dtype=np.uint8):
    return samples_from_numpy(spark, np.array(rows, dtype))


def _values(df, *order):
    return [r["value"] for r in df.orderBy(*order).collect()]


def test_half_away():
    assert [half_away(x) for x in (0.5, 1.5, 2.5, -0.5, -2.5, 0.49)] == [1, 2, 3, -1, -3, 0]


def test_single_dm(spark):
    data = _samples(spark, [[1, 2, 3], [4, 5, 6]])
    band = dd.Band((1000.0, 1200.0, 1500.0), 2000.0, TSAMP)
    assert _values(dd.dedisperse_single(data, band, 0.0, 2), "t") == [6, 15]
    band = dd.Band((1000.0, 2000.0, 2000.0), 2000.0, TSAMP)
    assert [delay_of(1.0, f, 2000.0, TSAMP) for f in band.frequencies] == [1, 0, 0]
    assert _values(dd.dedisperse_single(data, band, 1.0, 2), "t") == [9]


def test_subband(spark):
    data = _samples(spark, [[1, 2, 3, 4], [5, 6, 7, 8]])
    band = dd.Band((1000.0, 1200.0, 1500.0, 2000.0), 2000.0, TSAMP)
    trials = dd.Trials(0.0, 1.0, 1)
    assert _values(dd.dedisperse_subband(data, band, trials, 2, dd.Subbands(2, 32)), "t") == [10, 26]


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16, np.float32])
def test_forms_agree(spark, dtype):
    rng = np.random.default_rng(1)
    cube = rng.integers(0, 200, (60, 6)).astype(dtype)
    data = samples_from_numpy(spark, cube)
    band = dd.Band(tuple(1000.0 + 50 * c for c in range(6)), 1250.0, 0.001, 1, 5)
    trials = dd.Trials(2.0, 3.0, 4)
    multi = dd.dedisperse_multi(data, band, trials, 60)
    blocks = dd.dedisperse_blocks(data, band, trials, 60, block=7)
    plain = dd.dedisperse_subband(data, band, trials, 60, dd.Subbands(1, 1))
    key = ("dm_index", "t")
    assert _values(multi, *key) == _values(blocks, *key) == _values(plain, *key)
    n = dd.valid_samples(60, band, trials)
    expect = []
    for i in range(4):
        for t in range(n):
            expect.append(sum(float(cube[t + delay_of(trials.dm(i), band.frequencies[c], 1250.0, 0.001), c]) for c in range(1, 5)))
    assert _values(multi, *key) == expect
    one = dd.dedisperse_single(data, band, 8.0, 60)
    spectrum = dd.dedisperse_spectrum(data, band, 8.0, 60).groupBy("t").agg(F.sum("value").alias("value"))
    assert _values(one, "t") == _values(spectrum, "t")


def test_band_errors():
    for bad in (lambda: dd.Band((), 1.0, 1.0), lambda: dd.Band((1.0,), 1.0, 0.0), lambda: dd.Band((2.0,), 1.0, 1.0), lambda: dd.Trials(-1.0, 1.0, 1), lambda: dd.Trials(0.0, 1.0, 0), lambda: dd.Trials(0.0, -1.0, 2), lambda: dd.Subbands(0, 1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        dd.Band((1.0, 2.0), 2.0, 1.0, 1, 1)
    with pytest.raises(ValueError):
        dd.valid_samples(2, dd.Band((1000.0, 2000.0), 2000.0, TSAMP), dd.Trials(100.0, 0.0, 1))


def test_downsample():
    f = lambda x, k: cond.downsample(np.array(x, np.float32), k).tolist()
    assert f([1, 2, 3, 4], 2.0) == [3, 7]
    assert f([1, 2, 3, 4, 5], 2.5) == [4.5, 10.5]
    assert f([1, 2, 3, 4, 5, 6], 2.25) == [3.75, 8.75]
    got = [cond.downsampled_variance(*x) for x in ((16, 2), (16, 4), (8, 2.5), (5, 2.5))]
    assert got == pytest.approx([2, 10, 2.5 - 1 / 3, 5 / 3])
    for factor in (1.0, 9.0, math.nan):
        with pytest.raises(ValueError):
            cond.downsampled_size(8, factor)


def test_running_median():
    x = np.array([100, 0, 1, 2, 3], np.float32)
    assert cond.Detrend(3, 3)(x).tolist() == [0, -1, 0, 0, 0]
    x = np.array([1, 1, 1, 9, 9, 9] * 2, np.float32)
    out = cond.Detrend(7, 3)(x)
    assert out[[0, 1, 2, 3, 9, 10, 11]].tolist() == [0, -1, -3, 4, 3, 1, 0]
    for bad in (lambda: cond.running_median(x, 4), lambda: cond.running_median(x, 13), lambda: cond.Detrend(2, 3), lambda: cond.preprocess(x, ()), lambda: cond.checked(np.array([np.nan]))):
        with pytest.raises(ValueError):
            bad()
    assert cond.median_window(5.0, 1.0) == 5 and cond.median_window(4.0, 1.0) == 5 and cond.median_window(0.1, 1.0) == 1


def test_normalise():
    x = np.random.default_rng(0).normal(3, 2, 500).astype(np.float32)
    out = cond.normalise(x)
    assert abs(out.mean()) < 1e-5 and abs(out.std() - 1) < 1e-5
    assert cond.normalise(np.ones(4, np.float32), False).tolist() == [0] * 4
    with pytest.raises(ValueError):
        cond.normalise(np.ones(4, np.float32))


def test_plan():
    plan = make_plan(64, 0.25, SearchOptions(1.0, 4.0, 4, 5, 2, 0.5))
    got = [(t.downsample_factor, t.prepared_nsamples, t.bins, t.rows, t.rows_eval) for t in plan.tasks]
    assert got == [(1, 64, 4, 16, 12), (1, 64, 5, 12, 10), (1.5, 42, 4, 10, 8), (1.5, 42, 5, 8, 6), (2.25, 28, 4, 7, 5), (2.25, 28, 5, 5, 4), (3.375, 18, 4, 4, 2)]
    assert plan.widths == (1, 2)
    assert width_trials(240, 0.2, 1.5) == (1, 2, 3, 4, 6, 9, 13, 19, 28, 42)
    with pytest.raises(RuntimeError):
        make_plan(64, 0.25, SearchOptions(1.0, 4.0, 4, 5, 2, 0.5, max_tasks=3))
    for bad in ((0.0, 4.0, 4, 5), (1.0, 1.0, 4, 5), (1.0, 4.0, 1, 5), (1.0, 4.0, 5, 4), (1.0, 4.0, 4, 5, 0), (1.0, 4.0, 4, 5, 1, 1.0), (1.0, 4.0, 4, 5, 1, 0.5, 1.0)):
        with pytest.raises(ValueError):
            SearchOptions(*bad)
    with pytest.raises(ValueError):
        make_plan(64, 0.25, SearchOptions(1.0, 4.0, 4, 5, 40))


def test_transform():
    out = ffa.transform(np.arange(1, 21, dtype=np.float32).reshape(5, 4))
    assert out.tolist() == [[45, 50, 55, 60], [46, 51, 56, 57], [50, 55, 56, 49], [52, 53, 54, 51], [51, 52, 53, 54]]
    block = np.random.default_rng(3).normal(size=(37, 11)).astype(np.float32)
    whole = ffa.transform(block)
    assert (ffa.transform(block, 9) == whole[:9]).all()
    assert np.allclose(np.roll(ffa.transform(np.roll(block, 3, 1)), -3, 1), whole, atol=1e-5)
    assert np.allclose(whole[0], block.sum(0), atol=1e-5)
    assert ffa.trial_periods(42, 127, TSAMP)[5] == pytest.approx(TSAMP * 127**2 / (127 - 5 / 41))


def _task(bins, rows=2, factor=1.0, n=0):
    return Task(0, factor, 0.25 * factor, n, rows * bins, bins, rows, rows, 0.0, 0.0)


def test_detection():
    find = lambda x, w: ffa.detect(np.array([x], np.float32), _task(len(x)), [w], np.float32(1), 0.0)[0]
    peak = dict(zip(ffa.PEAK, find([0, 0, 5, 0], 1), strict=True))
    assert (peak["phase"], peak["period"], peak["duty_cycle"]) == (2, 1.0, 0.25)
    assert find([4, 0, 0, 5], 2)[5] == 3
    assert find([1, 1, 0, 1, 1, 0], 2)[5] == 0
    with pytest.raises(ValueError):
        ffa.boxcars([4], 4)


def test_search_downsampled_and_limits(spark):
    x = np.array([0, 0, 0, 4, 0, 0, 0, 4], np.float32)
    task = Task(0, 2.0, 2.0, 8, 4, 2, 2, 2, 4.0, 4.0)
    plan = Plan((task,), (1,), 8, 1.0)
    found = ffa.search(x, plan, 0.0)
    assert found[0][0] == 4.0
    with pytest.raises(RuntimeError):
        ffa.search(x, plan, -10.0, 1)
    with pytest.raises(ValueError):
        ffa.search(x[:4], plan)
    rows = series_from_numpy(spark, np.stack([x, x[::-1].copy()]), 1.0, 5.0, 1.0)
    got = ffa.search_series(rows, plan, ["dm_index"], threshold=0.0).where("dm_index = 0").orderBy(*ffa.peak_order()).collect()
    assert [r["period"] for r in got] == [p[0] for p in found]


def test_search_finds_a_pulse():
    rng = np.random.default_rng(5)
    n, ts, period = 8192, 0.01, 0.7
    x = rng.normal(size=n)
    x[((np.arange(n) * ts / period) % 1) < 0.05] += 3
    plan = make_plan(n, ts, SearchOptions(0.4, 1.0, 32, 40))
    best = ffa.search(cond.normalise(x.astype(np.float32)), plan, 8.0)[0]
    assert abs(best[0] - period) < 0.002


def _peaks(spark, rows):
    full = [(f, d, 0.5 * d, s, w, 1 / f, w / 64, 0, k, 64) for k, (f, d, s, w) in enumerate(rows)]
    return spark.createDataFrame(full, "frequency double, dm_index int, dm double, snr float, width int, period double, duty_cycle double, phase int, shift long, bins int")


def test_candidates(spark):
    one = cand.select_candidates(_peaks(spark, [(1.0, 0, 8.0, 1), (1.0005, 1, 10.0, 1), (1.0009, 2, 9.0, 1)]), 100.0).collect()
    assert [(r["peak_count"], r["snr"], r["dm_index"], r["dm_index_min"], r["dm_index_max"]) for r in one] == [(3, 10.0, 1, 0, 2)]
    apart = _peaks(spark, [(1.0, 0, 8.0, 1), (1.0, 5, 9.0, 1), (2.0, 0, 7.0, 2), (2.0, 0, 7.5, 3)])
    assert cand.select_candidates(apart, 100.0).count() == 3
    assert cand.select_candidates(apart, 100.0, cand.Clustering(across_widths=False)).count() == 4
    best = cand.select_candidates(apart, 100.0, cand.Clustering(max_candidates=1)).collect()
    assert len(best) == 1 and best[0]["snr"] == 9.0


def _chained(rows, radius, dm_radius, across):
    """Peaks in order, cut wherever the one before is too far: sizes and extents of the groups."""
    chains, out = [], []
    for p in sorted(rows):
        if not chains or p[0] - chains[-1][-1][0] > radius:
            chains.append([])
        chains[-1].append(p)
    for chain in chains:
        before = None
        for p in sorted(chain, key=lambda p: (p[1],) if across else (p[3], p[1])):
            if before is None or p[1] > before[1] + dm_radius or (not across and p[3] != before[3]):
                out.append([])
            out[-1].append(p)
            before = p
    return sorted((len(g), min(p[0] for p in g), max(p[0] for p in g), min(p[1] for p in g), max(p[1] for p in g), max(p[2] for p in g)) for g in out)


@pytest.mark.parametrize("radius", [0.0, 1e-18, 0.05, 0.5])
@pytest.mark.parametrize("across", [True, False])
def test_candidates_brute_force(spark, radius, across):
    rng = np.random.default_rng(5)
    steps = rng.choice([0.0, 0.0004, 0.0005, 0.0006, 0.003], 300)  # gaps at, below and above the radius
    rows = [(float(f), int(d), float(s), int(w)) for f, d, s, w in zip(1.0 + np.cumsum(steps), rng.integers(0, 6, 300), rng.integers(6, 99, 300), rng.integers(1, 3, 300), strict=True)]
    found = cand.select_candidates(_peaks(spark, rows), 100.0, cand.Clustering(radius, 1, across)).collect()
    got = sorted((r["peak_count"], r["frequency_min"], r["frequency_max"], r["dm_index_min"], r["dm_index_max"], r["snr"]) for r in found)
    assert got == _chained(rows, radius / 100.0, 1, across)
    assert sorted(r["candidate_rank"] for r in found) == list(range(len(found)))


def _candidate(f, snr, dm=0.0, duty=0.1):
    return {"frequency": f, "period": 1 / f, "snr": snr, "dm": dm, "dm_index": int(dm), "duty_cycle": duty, "peak_count": 1}


@pytest.mark.parametrize(("child", "ratio"), [(2.0, (2, 1)), (1.5, (3, 2)), (0.5, (1, 2)), (1.23456, None)])
def test_harmonics(child, ratio):
    how = cand.Harmonics(100.0, 1000.0, 1500.0)
    out = cand.flag(pd.DataFrame([_candidate(child, 10.0), _candidate(1.0, 20.0)]), how)
    assert out["frequency"].tolist() == [1.0, child]
    assert out["is_harmonic"].tolist() == [False, ratio is not None]
    if ratio:
        assert (out["numerator"][1], out["denominator"][1], out["parent_index"][1]) == (*ratio, 0)


def test_harmonic_gates(spark):
    how = cand.Harmonics(100.0, 1000.0, 1500.0)
    far = cand.flag(pd.DataFrame([_candidate(1.0, 20.0), _candidate(2.0, 10.0, dm=1e6)]), how)
    assert not far["is_harmonic"].any()
    weak = cand.Harmonics(100.0, 1000.0, 1500.0, use_snr=True)
    assert not cand.flag(pd.DataFrame([_candidate(1.0, 20.0), _candidate(2.0, 1.0)]), weak)["is_harmonic"].any()
    rows = spark.createDataFrame([("a", 1.0, 1.0, 20.0, 0.0, 0, 0.1, 1), ("a", 2.0, 0.5, 9.0, 0.0, 0, 0.1, 1), ("b", 2.0, 0.5, 9.0, 0.0, 0, 0.1, 1)], "obs string, frequency double, period double, snr double, dm double, dm_index int, duty_cycle double, peak_count long")
    flagged = cand.flag_harmonics(rows, how, ["obs"])
    assert {(r["obs"], r["frequency"]) for r in cand.remove_harmonics(flagged, 1, ["obs"]).collect()} == {("a", 1.0), ("b", 2.0)}
    assert flagged.where("parent_index is null").count() == 2


def _series(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "t long, value double")


def test_fold_profile(spark):
    out = fo.fold_profile(_series(spark, [1, 3]), fo.Fold(1.0, 0.25, 2)).orderBy("bin").collect()
    assert [(r["profile"], r["exposure"]) for r in out] == [(2.0, 1.0), (0.0, 0.0)]
    out = fo.fold_profile(_series(spark, [2]), fo.Fold(1.0, 0.375, 4)).orderBy("bin").collect()
    assert [r["profile"] for r in out] == [2, 2, 0, 0] and [r["exposure"] for r in out][:2] == [1, 0.5]
    for bad in ((0.0, 1.0, 2), (1.0, 0.0, 2), (1.0, 1.0, 0), (1.0, 1.0, 2, -1)):
        with pytest.raises(ValueError):
            fo.Fold(*bad)


def test_fold_cube(spark):
    data = np.arange(1, 9, dtype=np.float32).reshape(4, 2)
    out = api.fold(api.DedispersedSpectrum(data, tsamp=0.25, spark=spark), period=1.0, nbin=2, tsubint=0.5)
    assert (out.nsubint, out.nchans, out.tsubint) == (2, 2, 0.5)
    assert out.cube[0, :, 0].tolist() == [2, 3] and out.cube[1, :, 1].tolist() == [6, 7]
    assert out.profile.tolist() == [2.5, 6.5]
    assert out.freq_phase.tolist() == [[2, 6], [3, 7]]
    assert out.time_phase.tolist() == [[2.5, 0], [0, 6.5]]
    assert out.phase.tolist() == [0, 0.5] and out.time.tolist() == [0.25, 0.75]
    half = api.fold_spectrum(api.DedispersedSpectrum(data, tsamp=0.25, spark=spark), period=1.0, nbin=2, tsubint=0.5, nsubband=1)
    assert half.cube[:, 0].tolist() == [[2.5, 0], [0, 6.5]]


def _write(path, data, **fields):
    h = fb.Header(nbits=data.dtype.itemsize * 8, nifs=fields.pop("nifs", 1), nchans=data.shape[-1], tsamp=fields.pop("tsamp", 0.5), **fields)
    path.write_bytes(fb.header_bytes(h) + data.tobytes())
    return str(path)


@pytest.mark.parametrize(
    ("data", "fields", "order", "expect", "table"),
    [
        (np.arange(1, 9, dtype=np.uint8).reshape(2, 4), {"fch1": 1000.0, "foff": 1.0}, "frequency_ascending", [1, 2, 3, 4, 5, 6, 7, 8], [1000, 1001, 1002, 1003]),
        (np.arange(1, 9, dtype=np.uint8).reshape(2, 4), {"fch1": 1000.0, "foff": -1.0}, "frequency_ascending", [4, 3, 2, 1, 8, 7, 6, 5], [997, 998, 999, 1000]),
        (np.arange(1, 9, dtype=np.uint8).reshape(2, 4), {"fch1": 1000.0, "foff": -1.0}, "preserve_file_order", [1, 2, 3, 4, 5, 6, 7, 8], [1000, 999, 998, 997]),
        (np.array([[[1, 2, 3], [10, 11, 12]]], np.uint16), {"fch1": 9.0, "foff": -2.0, "nifs": 2}, "frequency_ascending", [3, 2, 1, 12, 11, 10], [5, 7, 9]),
        (np.array([[1.5, 2.5]], np.float32), {"fch1": 9.0, "foff": -0.5}, "frequency_ascending", [2.5, 1.5], [8.5, 9]),
        (np.array([[7, 8, 9]], np.uint8), {"frequency_table": [30.0, 20.0, 10.0], "uses_frequency_table": True}, "frequency_ascending", [9, 8, 7], [10, 20, 30]),
    ],
)
def test_filterbank(spark, tmp_path, data, fields, order, expect, table):
    path = _write(tmp_path / "x.fil", data, **fields)
    got = api.Filterbank(path, channel_order=order, io_buffer_bytes=4, spark=spark)
    assert got.data.ravel().tolist() == expect and got.header.frequency_table == table
    assert _values(got.samples, "t", "ifno", "chan") == expect
    assert got.header.fch1 == (0.0 if fields.get("uses_frequency_table") and table == fields["frequency_table"] else table[0])
    assert got.shape == (len(data), fields.get("nifs", 1) if data.ndim == 2 else data.shape[1], data.shape[-1])


def test_filterbank_errors(spark, tmp_path):
    ok = fb.header_bytes(fb.Header(nbits=8, nifs=1, nchans=2, tsamp=1.0))
    word = lambda t: len(t).to_bytes(4, "little") + t
    cases = {
        b"": "Truncated", word(b"HELLO"): "missing HEADER_START", (0).to_bytes(4, "little"): "string length",
        word(b"HEADER_START") + word(b"odd"): "Unknown", word(b"HEADER_START") + word(b"fchannel"): "outside",
        ok + b"\1\2\3": "whole number", fb.header_bytes(fb.Header(nbits=4, nifs=1, nchans=2)): "nbits",
        fb.header_bytes(fb.Header(nbits=8, nifs=0, nchans=2)): "nifs", fb.header_bytes(fb.Header(nbits=8, nifs=1, nchans=0)): "nchans",
    }
    for data, text in cases.items():
        (tmp_path / "bad.fil").write_bytes(data)
        with pytest.raises(RuntimeError, match=text):
            fb.read_header(str(tmp_path / "bad.fil"))
    with pytest.raises(RuntimeError, match="open"):
        fb.read_header(str(tmp_path / "none.fil"))
    with pytest.raises(ValueError):
        fb.read_header(_write(tmp_path / "y.fil", np.zeros((1, 2), np.uint8)), "other")


def test_written_files_read_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    cube = rng.integers(0, 255, (30, 8)).astype(np.uint8)
    h = fb.Header(nbits=8, nifs=1, nchans=8, tsamp=0.001, fch1=1000.0, foff=10.0, source_name="made up", tstart=5.0)
    path = str(tmp_path / "w.fil")
    fb.write_filterbank(samples_from_numpy(spark, cube).withColumn("ifno", F.lit(0)), h, path)
    got = api.Filterbank(path, spark=spark)
    assert (got.data[:, 0] == cube).all() and got.header.source_name == "made up" and got.header.tstart == 5.0
    multi = api.dedisperse_multi_dm(got, dm_low=1.0, dm_step=2.0, ndm=3)
    for i in range(3):
        one = api.dedisperse_single_dm(got, dm=1.0 + 2 * i)
        assert (multi.data[i] == one.data[0, : multi.nsamples]).all()
    spectrum = api.dedisperse_spectrum(got, dm=1.0)
    assert (spectrum.data.sum(1) == api.dedisperse_single_dm(got, dm=1.0).data[0]).all()
    assert api.dedisperse_subband(got, dm_low=1.0, dm_step=2.0, ndm=3, subband_channels=1, ndm_per_nominal=1).data.tolist() == multi.data.tolist()
    profile = api.fold(multi, period=0.01, nbin=4, dm_index=1)
    assert profile.profile.shape == (4,) and profile.exposure.sum() == pytest.approx(multi.nsamples * 0.4)


def test_wrapper_errors(spark):
    ok = np.zeros((2, 4), np.float32)
    with pytest.raises(ValueError, match="two-dim"):
        api.DedispersedResult(ok[0], tsamp=1.0)
    with pytest.raises(TypeError):
        api.DedispersedResult(ok.astype(np.float64), tsamp=1.0)
    with pytest.raises(ValueError, match="contiguous"):
        api.DedispersedResult(ok.T, tsamp=1.0)
    with pytest.raises(ValueError):
        api.DedispersedSpectrum(ok, tsamp=1.0, chan_end=3)
    with pytest.raises(IndexError):
        api.fold_profile(api.DedispersedResult(ok, tsamp=1.0, spark=spark), period=1.0, nbin=2, dm_index=2)
    with pytest.raises(TypeError):
        api.fold(ok, period=1.0, nbin=2)
    plan = api.make_riptide_plan(nsamples=64, tsamp=0.25, period_min=1.0, period_max=4.0, bins_min=4, bins_max=5)
    with pytest.raises(ValueError):
        api.ffa_search(np.zeros(64, np.float32), plan, device_id=1)
    with pytest.raises(TypeError):
        api.ffa_search(np.zeros(64), plan)
    with pytest.raises(ValueError):
        api.ffa_search(np.zeros(64, np.float32), plan, max_peaks=0)


def test_vector_add(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert rows.select(vector_add(F.col("a"), F.col("b")).alias("c")).first()["c"] == [4.0, 6.0]
    with pytest.raises(Exception, match="same length"):
        rows.select(vector_add(F.col("a"), F.slice("b", 1, 1))).collect()
    assert api.vector_add([], []).tolist() == [] and api.cuda_device_count() == 0
