"""Kernels against formulas written another way, and planted patterns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import components, kernels as K, latent, loss, sequences, signals, spatial, spectral, surrogates, waves

rng = np.random.default_rng(0)


def test_smooth_lengths_and_errors():
    x = rng.random(50)
    assert len(K.smooth(x, 11)) == 60
    assert np.allclose(K.smooth(np.ones(30), 5, "flat"), 1)
    with pytest.raises(ValueError):
        K.smooth(x[:5], 11)
    with pytest.raises(ValueError):
        K.smooth(x, 11, "none")


def test_savitzky_golay_keeps_cubics():
    t = np.arange(30.0)
    y = 0.1 * t**3 - t**2 + 3
    assert np.allclose(K.savitzky_golay(y), y)
    inside = K.savitzky_golay(rng.random(30) * 0 + np.arange(30) % 2)
    c = np.array([-3, 12, 17, 12, -3]) / 35
    assert np.isclose(inside[10], c @ (np.arange(8, 13) % 2))


def test_band_pass_keeps_the_band():
    t = np.arange(4000) / 200
    b, a = K.butter_bandpass(6, 10, 200, 3)
    gain = lambda f: K.lfilter(b, a, np.sin(2 * np.pi * f * t))[2000:].std() / np.sqrt(0.5)
    assert gain(8) > 0.9 and gain(2) < 0.05 and gain(30) < 0.05


def test_morlet_equals_direct_convolution():
    x, rate = rng.random(200), 50.0
    w = K.morlet(rate, 5.0, 4)
    direct = np.convolve(x, w)[(len(w) - 1) // 2 :][:200]
    assert np.allclose(K.morlet_power(x, rate, [5.0], [4])[0], np.abs(direct) ** 2)
    w = K.morlet(rate, 1.0, 6, np.arange(-100, 101) / rate)  # cut off after two seconds
    direct = np.convolve(x, w)[100:][:200]
    assert np.allclose(K.morlet_power(x, rate, [1.0], [6], 2.0)[0], np.abs(direct) ** 2)


def test_cycles_grow_as_frequencies_do():
    o = spectral.WaveletOptions(1, 100, 3, log_freqs=True, cycles=4, max_cycles=16)
    assert np.allclose(o.freqs(), [1, 10, 100]) and np.allclose(o.cycle_counts(), [4, 8, 16])
    assert np.allclose(spectral.WaveletOptions(1, 3, 3, cycles=4, max_cycles=16).cycle_counts(), [4, 10, 16])


def test_sine_burst_is_an_episode():
    rate = 100.0
    x = 0.1 * rng.standard_normal(1000)
    x[400:500] += np.sin(2 * np.pi * 8 * np.arange(100) / rate)
    p = K.morlet_power(x, rate, [8.0], [6])[0]
    assert p[420:480].min() > 5 * np.median(p)


def test_welch_peak():
    f, p = K.welch(np.sin(2 * np.pi * 7 * np.arange(2000) / 100), 100)
    assert abs(f[p.argmax()] - 7) < 0.2


def test_nnls():
    a = rng.random((40, 6))
    x = np.array([1.0, 0, 2, 0, 0.5, 0])
    assert np.allclose(K.nnls(a, a @ x), x, atol=1e-6)


def test_find_peaks():
    x = np.array([0, 2, 0, 3, 3, 0, 1, 0.0])
    assert K.find_peaks(x) == [1, 3, 6]
    assert K.find_peaks(x, 1, 2) == [1, 3]
    assert K.find_peaks(x, 3) == [3, 6]


def test_silhouettes_by_hand():
    x = np.array([0.0, 1, 10, 11])
    s = K.silhouettes(np.abs(x[:, None] - x), np.array([0, 0, 1, 1]))
    assert s[0] == pytest.approx((10.5 - 1) / 10.5)


def test_latent_gradients():
    f, s = rng.random((3, 40)), latent.stimulus_rows(np.arange(40) % 3)
    m = latent.Model(rng.random(3) + 1, rng.random(3), rng.random((3, 2)), rng.random((3, 2)), rng.random((2, 40)), np.ones(3), latent.calcium_kernel(2, 8, 40), 1.0)
    v, g = latent.pack(m), np.concatenate([x.ravel() for x in latent.static_gradient(m, f, s)])
    h = 1e-6
    num = [(latent.log_joint(latent.unpack(v + h * d, m), f, s) - latent.log_joint(latent.unpack(v - h * d, m), f, s)) / (2 * h) for d in np.eye(len(v))]
    assert np.allclose(g, num, rtol=1e-4, atol=1e-3)
    i = (1, 7)
    up, down = m.x.copy(), m.x.copy()
    up[i] += h
    down[i] -= h
    from dataclasses import replace

    n = (latent.log_joint(replace(m, x=up), f, s) - latent.log_joint(replace(m, x=down), f, s)) / (2 * h)
    assert latent.latent_gradient(m, f, s)[i] == pytest.approx(n, rel=1e-4)


def test_latent_fit_improves():
    s = latent.stimulus_rows((np.arange(60) % 10 == 0).astype(int))
    k = latent.calcium_kernel(2, 8, 60)
    f = 2 * latent.convolve(k, s) + 0.05 * rng.standard_normal((4, 60))
    m = latent.train(f, s, 1, 2, 10)
    assert np.abs(latent.reconstruction(m, s) - f).mean() < 0.1
    r, d, err = latent.fit_time_constants(f, s, 0.0, 3, (1.0, 4.0))
    assert err[-1] <= err[0]


def test_planted_sequence_is_found():
    cells, times = 5, {c: [] for c in range(5)}
    for k in range(10):
        for c in range(cells):
            if (k, c) != (4, 2):
                times[c].append(20 * k + 2 * c)
    t = {c: np.array(v) for c, v in times.items()}
    o = sequences.SequenceOptions(1, 4, 4, 2, error_rate=0.2)
    occ = sequences.replay(list(range(5)), t, o)
    assert len(occ) == 10 and [4 * 20, 82, -1, 86, 88] in occ
    found = sequences.walk_ordered([t[c] for c in range(5)], o)
    assert len(found[tuple(range(5))]) >= 10


def test_loss_prefers_the_planted_order():
    rows = [np.arange(10) * 20 + 2 * c for c in range(6)]
    good = loss.order_loss(rows[::-1], 220, 0, 4)
    bad = loss.order_loss([rows[i] for i in (3, 0, 5, 1, 4, 2)], 220, 0, 4)
    assert 0 <= good < bad
    with pytest.raises(ValueError):
        loss.order_loss(rows[:3], 220, 0, 4)


def test_wave_of_constant_slope():
    rows = [np.array([10 + 3 * c, 100 + 3 * c]) for c in range(6)]
    found = waves.slope_waves(rows, 200, [0.0, 3.0], 1, 0.2)
    assert [s for s, _ in found] == [3.0, 3.0]
    assert found[0][1] == [10, 13, 16, 19, 22, 25]
    assert len(waves.repetitions(rows, 1, 6, 0.2)) == 2


def test_longest_paths():
    assert waves.longest_paths([(0, 1, 1), (1, 2, 1), (2, 3, 1), (5, 6, 1)]) == [[0, 1, 2, 3], [5, 6]]


def test_components_centre_and_otsu():
    assert components.otsu(np.array([10] * 50 + [200] * 50)) in range(10, 200)
    a, b = rng.random(30), rng.random(30)
    mid = components.cross_covariance(a, b, 0)[0]
    assert mid == pytest.approx(((a - a.mean()) * (b - b.mean())).sum())


def test_shapes():
    sq = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2]])
    assert {tuple(p) for p in spatial.hull(sq)} == {(0, 0), (4, 0), (4, 4), (0, 4)}
    assert spatial.triangle_area((0, 0), (4, 0), (0, 3)) == 6
    c = spatial.colour([(0, 1), (1, 2), (2, 0), (2, 3)])
    assert all(c[a] != c[b] for a, b in [(0, 1), (1, 2), (2, 0), (2, 3)])


def test_regions_equal_a_flood_fill(spark):
    """Random maps over several stretches of time, with corners that touch and snakes that turn back."""
    r = np.random.default_rng(8)
    maps = {"a": r.random((6, 700)) < 0.42, "b": r.random((9, 40)) < 0.5, "snake": np.zeros((7, 20), bool)}
    for k in range(0, 7, 2):
        maps["snake"][k] = True
        if k:
            maps["snake"][k - 1, -1 if k % 4 else 0] = True
    rows = [(k, int(i), int(t)) for k, m in maps.items() for i, t in zip(*np.nonzero(m), strict=True)]
    got = spectral.regions(spark.createDataFrame(rows, "segment string, row int, t int")).collect()
    want = []
    for k, m in maps.items():
        left = {(int(i), int(t)) for i, t in zip(*np.nonzero(m), strict=True)}
        while left:
            stack, cells = [left.pop()], []
            while stack:
                i, t = stack.pop()
                cells.append((i, t))
                near = {(i + a, t + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                stack += near
            i, t = zip(*cells, strict=True)
            want.append((k, min(i), max(i), min(t), max(t) + 1, len(cells)))
    assert sorted((x.segment, x.first_row, x.last_row, x.start_t, x.end_t, x.size) for x in got) == sorted(want)
    assert sorted(x.region for x in got if x.segment == "b") == list(range(sum(x[0] == "b" for x in want)))


def test_bleaching_is_a_cubic_fit(spark):
    x = {0: rng.random(50) + 3, 1: rng.random(4) + 1, 2: np.array([5.0])}
    s = spark.createDataFrame([("r", c, 3 * i, float(v)) for c, y in x.items() for i, v in enumerate(y)], "recording_id string, cell int, frame int, value double")
    got = signals.bleaching_correction(s).toPandas()
    for c, y in x.items():
        t = np.arange(len(y))
        fit = np.polyval(np.polyfit(t, y, min(3, len(y) - 1)), t)
        assert np.allclose(got[got.cell == c].sort_values("frame").value, y / fit)


def test_randomized_trains_keep_their_numbers(spark):
    t = spark.createDataFrame([("r", c, float(i)) for c, n in ((0, 5), (1, 20), (2, 30)) for i in range(n)], "recording_id string, cell int, t double")
    got = surrogates.randomized(t, 0, 20, seed=3)
    n = {r.cell: (r.n, r.d, r.lo, r.hi) for r in got.groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct("t").alias("d"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert n[0][:2] == (5, 5) and n[1] == (20, 20, 0.0, 19.0) and n[2] == (20, 20, 0.0, 19.0)
    assert got.dtypes == t.dtypes and sorted(got.collect()) == sorted(surrogates.randomized(t.repartition(3), 0, 20, seed=3).collect())
    assert sorted(got.collect()) != sorted(surrogates.randomized(t, 0, 20, seed=4).collect())


def test_peak_events_by_their_rules():
    """Events of a made series, found by hand-written loops over the smoothed averages."""
    r = np.random.default_rng(2)
    raw = r.poisson(3, 1500).astype(float)
    for c in (200, 500, 560, 900, 1450):
        raw[c : c + 60] += 12
    mean_of = [raw[i : i + 100].mean() if i < 1400 else raw[i] for i in range(1500)]
    w = [0.54 - 0.46 * np.cos(2 * np.pi * k / 10) for k in range(11)]
    at = lambda i: mean_of[-i if i < 0 else 2 * 1500 - 2 - i if i >= 1500 else i]
    x = np.array([sum(w[k] * at(i + k - 5) for k in range(11)) / sum(w) for i in range(1500)])
    peaks = K.find_peaks(x, 100, x.mean())
    drop = set()
    for p, q in zip(peaks, peaks[1:]):
        if min(x[p : q + 1]) >= x.mean():
            drop.add(q if x[p] > x[q] else p)
    want = []
    peaks = [p for p in peaks if p not in drop and p < 1400]
    for k, p in enumerate(peaks):
        lo, hi = peaks[k - 1] if k else 0, peaks[k + 1] if k + 1 < len(peaks) else 1400
        first = max((i for i in range(lo, p) if x[i] < x.mean()), default=None)
        first = min(range(lo, p), key=lambda i: (x[i], i)) if first is None else first
        last = min((i for i in range(p, hi) if x[i] < x.mean() - 1.5 * x.std()), default=None)
        last = min(range(p, hi), key=lambda i: (x[i], -i)) if last is None else last
        want.append((first, last, p))
    assert len(want) >= 3 and K.peak_events(raw) == want


def plain_component_order(x: np.ndarray, n_components: int = 10, lags: int = 200) -> list[tuple[int, int, float, int]]:
    """(component, cell, correlation, lag): cells over the level of their best correlation with a component's slope, by lag."""
    width = x.shape[1] / 20
    y = K.gauss_blur_1d(K.gauss_blur_1d(x, width), width)
    _, courses = components.lagged_components(y, min(n_components, *y.shape))
    out = []
    for k, course in enumerate(courses):
        slope = np.diff(course, append=course[-1])
        rows = []
        for c in range(len(y)):
            if y[c].std() == 0 or slope.std() == 0:
                continue
            r = components.cross_covariance(y[c], slope, lags, True)
            at = int(np.argmax(r))
            rows.append((k, c, float(r[at]), at - (len(r) - 1) // 2))
        if rows:
            level = np.round(K.norm01(np.array([r[2] for r in rows])) * 255)
            cut = components.otsu(level)
            out += sorted((r for r, v in zip(rows, level, strict=True) if v > cut), key=lambda r: (r[3], r[1]))
    return out


@pytest.mark.parametrize("stretch", [16, 2048])
def test_component_order_equals_the_whole_computation(spark, stretch, monkeypatch):
    """Waves that pass the cells in order, with gaps, over stretches shorter than the recording."""
    monkeypatch.setattr(components, "STRETCH", stretch)
    r = np.random.default_rng(9)
    mats = {}
    for rec, n in (("a", 8), ("b", 5)):
        x = 0.1 * r.random((n, 200))
        for start in range(5, 180, 40):
            for c in range(n):
                x[c, start + 2 * c : start + 2 * c + 6] += 1
        x[r.random(x.shape) < 0.1] = 0
        mats[rec] = x
    rows = [(rec, c, 3 * t, float(v)) for rec, x in mats.items() for (c, t), v in np.ndenumerate(x) if v]
    got = components.order_by_components(spark.createDataFrame(rows, "recording_id string, cell int, frame int, value double"), 3, 20).collect()
    for rec, x in mats.items():
        want = plain_component_order(x, 3, 20)
        mine = sorted(((g.component, g.place, g.cell, g.correlation, g.lag) for g in got if g.recording_id == rec))
        assert [(k, c, lag) for k, _, c, _, lag in mine] == [(k, c, lag) for k, c, _, lag in want]
        assert [v for *_, v, _ in mine] == pytest.approx([v for _, _, v, _ in want])
