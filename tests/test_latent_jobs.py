"""The latent model fitted by jobs against the same model held whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import latent, latent_jobs as J

N, T, KEY = 5, 80, {"tau_rise": 2.0, "tau_decay": 8.0}


@pytest.fixture(scope="module")
def data(spark):
    """Traces of two recordings driven by a stimulus and one hidden factor."""
    r = np.random.default_rng(1)
    f, s = {}, {}
    for rec in ("a", "b"):
        s[rec] = latent.stimulus_rows((np.arange(T) % 9 == 0) * (1 + np.arange(T) // 9 % 2))
        x = (r.random((1, T)) < 0.05) * r.random((1, T))
        f[rec] = (r.random((N, 1)) + 1) * latent.convolve(latent.calcium_kernel(2, 8, T), r.random((N, 2)) @ s[rec] + r.random((N, 1)) @ x) + 0.2 + 0.03 * r.standard_normal((N, T))
    traces = spark.createDataFrame([(rec, c, t, float(v)) for rec, m in f.items() for (c, t), v in np.ndenumerate(m)], "recording_id string, cell int, frame int, value double")
    stim = spark.createDataFrame([(rec, int(k), int(t)) for rec, m in s.items() for k, t in zip(*np.nonzero(m), strict=True)], "recording_id string, k int, t int")
    return f, s, traces, stim


def whole(neurons, shared, rec, model=0):
    """The tables of one fit as one model."""
    n = sorted((r for r in neurons.collect() if (r.recording_id, r.model) == (rec, model)), key=lambda r: r.cell)
    h = next(r for r in shared.collect() if (r.recording_id, r.model) == (rec, model))
    a = lambda c: np.array([getattr(r, c) for r in n])
    return latent.Model(a("alpha"), a("beta"), a("w"), a("b"), np.array(h.x), a("sigma"), latent.calcium_kernel(h.tau_rise, h.tau_decay, T), h.gamma), np.array([r.f for r in n]), np.array(h.s)


def test_first_values_and_log_joint(data):
    f, s, traces, stim = data
    neurons, shared = J.prepared(traces, stim, [{"n_factors": 2}, {"n_factors": 1, "gamma": 0.5}])
    got = {(r.recording_id, r.model): r.log_joint for r in J.log_joint(neurons, shared).collect()}
    assert len(got) == 4
    for rec, k in got:
        m, ff, ss = whole(neurons, shared, rec, k)
        assert np.array_equal(ff, f[rec]) and np.array_equal(ss, s[rec]) and m.x.shape == (2 - k, T)
        assert np.allclose(m.w, latent.filters(f[rec], s[rec], m.kernel)) and np.allclose(m.beta, np.median(f[rec], 1))
        assert got[rec, k] == pytest.approx(-latent.log_joint(m, ff, ss))


def test_latent_steps_lower_the_cost_towards_the_whole_fit(data):
    _, _, traces, stim = data
    neurons, shared = J.prepared(traces, stim, [{"n_factors": 1}])
    after = J.latent_step(neurons, shared, 6)
    m, f, s = whole(neurons, shared, "a")
    up, _, _ = whole(neurons, after, "a")
    assert (up.x >= 0).all() and latent.log_joint(up, f, s) < latent.log_joint(m, f, s)
    best = latent.log_joint(latent.fit_latents(m, f, s, 200), f, s)
    first = latent.log_joint(m, f, s)
    assert latent.log_joint(up, f, s) - best < 0.5 * (first - best)
    one = J.latent_step(neurons, shared, 0)
    assert np.array_equal(whole(neurons, one, "b")[0].x, whole(neurons, shared, "b")[0].x)


def test_costs_and_gradients_are_those_of_the_whole_model(data):
    _, _, traces, stim = data
    neurons, shared = J.prepared(traces, stim, [{"n_factors": 2}])
    out = {r.recording_id: r for r in J._costs(neurons, shared.withColumn("at", F.lit(0))).collect()}
    for rec in ("a", "b"):
        m, f, s = whole(neurons, shared, rec)
        assert out[rec].cost + m.x.sum() / m.gamma == pytest.approx(latent.log_joint(m, f, s))
        assert np.allclose(np.array(out[rec].gradient).reshape(m.x.shape) + 1 / m.gamma, latent.latent_gradient(m, f, s))


def test_static_step_fits_each_neuron(data):
    _, _, traces, stim = data
    neurons, shared = J.prepared(traces, stim, [{"n_factors": 1}])
    after = J.static_step(neurons, shared, 15)
    for rec in ("a", "b"):
        m, f, s = whole(neurons, shared, rec)
        n, _, _ = whole(after, shared, rec)
        each = [latent.fit_static(latent.Model(m.alpha[i : i + 1], m.beta[i : i + 1], m.w[i : i + 1], m.b[i : i + 1], m.x, m.sigma[i : i + 1], m.kernel, m.gamma), f[i : i + 1], s, 15) for i in range(N)]
        assert np.allclose(n.alpha, [e.alpha[0] for e in each]) and np.allclose(n.w, [e.w[0] for e in each]) and np.allclose(n.b, [e.b[0] for e in each])
        assert latent.log_joint(n, f, s) < latent.log_joint(m, f, s) and (n.w >= 0).all() and (n.b >= 0).all()


def test_a_fit_is_identified_and_its_parts_add_up(data):
    _, _, traces, stim = data
    neurons, shared = J.fit(traces, stim, [{"n_factors": 2, "alternations": 2, "rounds": 3}, {"n_factors": 1, "alternations": 1, "rounds": 2}])
    m, f, s = whole(neurons, shared, "a")
    assert np.allclose(np.linalg.norm(m.x, axis=1), 1) and np.allclose((m.w**2).sum(1) + (m.b**2).sum(1), 1)
    rows = J.parts_of_traces(neurons, shared).where("model = 0 and recording_id = 'a'").toPandas()
    fitted = rows.pivot(index="cell", columns="frame", values="fitted").to_numpy()
    assert np.allclose(fitted, latent.reconstruction(m, s))
    beta = rows.cell.map(dict(enumerate(m.beta)))
    assert np.allclose(rows.evoked + rows.spontaneous + beta, rows.fitted)
    assert np.abs(rows.fitted - rows.value).mean() < 0.2
    own, latents = J.estimate_latents(neurons, traces, stim, [{"n_factors": 2}, {"n_factors": 1}], 2)
    h, _, _ = whole(own, latents, "b")
    assert np.allclose(h.alpha, whole(neurons, shared, "b")[0].alpha) and h.x.shape == (2, T)


def test_models_are_identified_alike(data):
    _, _, traces, stim = data
    neurons, shared = J.prepared(traces, stim, [{"n_factors": 2}])
    m, f, s = whole(neurons, shared, "b")
    got, _, _ = whole(*J.identified(neurons, shared), "b")
    want = latent.identify(m)
    for c in ("alpha", "beta", "w", "b", "x"):
        assert np.allclose(getattr(got, c), getattr(want, c))
    assert np.allclose(latent.reconstruction(got, s), latent.reconstruction(m, s))


def test_time_constants_are_found(spark):
    """Traces made with a rise of 1.5 and a decay of 9 frames, from a start far off."""
    r = np.random.default_rng(3)
    s = latent.stimulus_rows((np.arange(160) % 20 == 0).astype(int))
    f = {rec: (r.random((4, 1)) + 1) * latent.convolve(latent.calcium_kernel(a, b, 160), s) + 0.01 * r.standard_normal((4, 160)) for rec, (a, b) in (("a", (1.5, 9.0)), ("b", (3.0, 6.0)))}
    traces = spark.createDataFrame([(rec, c, t, float(v)) for rec, m in f.items() for (c, t), v in np.ndenumerate(m)], "recording_id string, cell int, frame int, value double")
    stim = spark.createDataFrame([(rec, 0, int(t)) for rec in f for t in np.flatnonzero(s[0])], "recording_id string, k int, t int")
    got = {x.recording_id: x for x in J.time_constants(traces, stim, 0.0, 10, (2.0, 5.0)).collect()}
    assert got["a"].tau_rise == pytest.approx(1.5, rel=0.25) and got["a"].tau_decay == pytest.approx(9, rel=0.15)
    for rec, m in f.items():
        start = latent.reconstruction_error(m, s, 2.0, 5.0, latent.filters(m, s, latent.calcium_kernel(2.0, 7.0, 160)), 0.0)
        assert got[rec].error < start
