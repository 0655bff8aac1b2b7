"""Latent factor model of fluorescence: traces as a kernel on stimulus-driven and latent activity.

f[n, t] = alpha[n] * (kernel * (w s + b x))[n, t] + beta[n] + noise, with x >= 0 under an
exponential prior of scale ``gamma``. Static parameters separate by neuron; the latent factors are
shared, and their gradient is a sum over neurons. These are the formulas for a few
neurons in a task; ``latent_jobs`` fits recordings with them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import kernels as K


@dataclass
class Model:
    alpha: np.ndarray
    beta: np.ndarray
    w: np.ndarray
    b: np.ndarray
    x: np.ndarray
    sigma: np.ndarray
    kernel: np.ndarray
    gamma: float


def calcium_kernel(tau_rise: float, tau_decay: float, n: int) -> np.ndarray:
    t = np.arange(n)
    return np.exp(-t / tau_decay) - np.exp(-t / tau_rise)


def convolve(kernel: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Causal convolution of each row, cut to its length."""
    n = rows.shape[-1]
    m = K.next_power(n + len(kernel) - 1)
    return np.fft.irfft(np.fft.rfft(rows, m) * np.fft.rfft(kernel, m), m)[..., :n]


def correlate(kernel: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The adjoint of ``convolve``."""
    return convolve(kernel, rows[..., ::-1])[..., ::-1]


def noise_deviation(f: np.ndarray, rate: float) -> float:
    """Root of the mean periodogram between a quarter and a half of the sampling rate."""
    n = len(f)
    p = np.abs(np.fft.rfft(f - f.mean())) ** 2 / n
    freq = np.fft.rfftfreq(n, 1 / rate)
    return float(np.sqrt(p[(freq > rate / 4) & (freq <= rate / 2)].mean()))


def drive(m: Model, s: np.ndarray) -> np.ndarray:
    return m.w @ s + m.b @ m.x


def reconstruction(m: Model, s: np.ndarray) -> np.ndarray:
    return m.alpha[:, None] * convolve(m.kernel, drive(m, s)) + m.beta[:, None]


def decoupled(m: Model, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The evoked and the spontaneous part of each trace, for any number of factors."""
    return m.alpha[:, None] * convolve(m.kernel, m.w @ s), m.alpha[:, None] * convolve(m.kernel, m.b @ m.x)


def log_joint(m: Model, f: np.ndarray, s: np.ndarray) -> float:
    """Negative logarithm of the joint density, without constants."""
    r = f - reconstruction(m, s)
    return float((r**2 / (2 * m.sigma[:, None] ** 2)).sum() + m.x.sum() / m.gamma)


def static_gradient(m: Model, f: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of alpha, beta, w and b."""
    lam = convolve(m.kernel, drive(m, s))
    r = -(f - m.alpha[:, None] * lam - m.beta[:, None]) / m.sigma[:, None] ** 2
    back = correlate(m.kernel, r) * m.alpha[:, None]
    return (r * lam).sum(1), r.sum(1), back @ s.T, back @ m.x.T


def latent_gradient(m: Model, f: np.ndarray, s: np.ndarray) -> np.ndarray:
    r = -(f - reconstruction(m, s)) / m.sigma[:, None] ** 2
    return m.b.T @ (correlate(m.kernel, r) * m.alpha[:, None]) + 1 / m.gamma


def pack(m: Model) -> np.ndarray:
    return np.concatenate([m.alpha, m.beta, m.w.ravel(), m.b.ravel()])


def unpack(v: np.ndarray, m: Model) -> Model:
    n, k, f = len(m.alpha), m.w.shape[1], m.b.shape[1]
    a, b, w, c = np.split(v, np.cumsum([n, n, n * k]))
    return replace(m, alpha=a, beta=b, w=w.reshape(n, k), b=c.reshape(n, f))


def fit_static(m: Model, f: np.ndarray, s: np.ndarray, rounds: int) -> Model:
    """Static parameters with x fixed; all but beta are not negative."""
    x0 = pack(m)
    low = np.zeros_like(x0)
    low[len(m.alpha) : 2 * len(m.alpha)] = -np.inf

    def cost(v: np.ndarray) -> tuple[float, np.ndarray]:
        c = unpack(v, m)
        a, b, w, d = static_gradient(c, f, s)
        return log_joint(c, f, s), np.concatenate([a, b, w.ravel(), d.ravel()])

    return unpack(K.lbfgs_box(cost, x0, low, np.full_like(x0, np.inf), rounds)[0], m)


def fit_latents(m: Model, f: np.ndarray, s: np.ndarray, rounds: int) -> Model:
    """Latent factors with static parameters fixed."""

    def cost(v: np.ndarray) -> tuple[float, np.ndarray]:
        c = replace(m, x=v.reshape(m.x.shape))
        return log_joint(c, f, s), latent_gradient(c, f, s).ravel()

    x0 = m.x.ravel()
    return replace(m, x=K.lbfgs_box(cost, x0, np.zeros_like(x0), np.full_like(x0, np.inf), rounds)[0].reshape(m.x.shape))


def alternate(m: Model, f: np.ndarray, s: np.ndarray, alternations: int, rounds: int) -> Model:
    for _ in range(alternations):
        m = fit_static(fit_latents(m, f, s, rounds), f, s, rounds)
    return m


def filters(f: np.ndarray, s: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Non-negative least squares of each trace on the convolved stimuli."""
    a = convolve(kernel, s).T
    return np.array([K.nnls(a, y) for y in f])


def identify(m: Model) -> Model:
    """Factors of unit norm by falling size, drives of unit norm, their scales in b and alpha."""
    norm = np.linalg.norm(m.x, axis=1)
    order = np.argsort(-norm, kind="stable")
    scale = np.where(norm > 0, norm, 1)[order]
    x, b = m.x[order] / scale[:, None], m.b[:, order] * scale
    size = np.sqrt((m.w**2).sum(1) + (b**2).sum(1))
    size = np.where(size > 0, size, 1)
    return replace(m, x=x, b=b / size[:, None], w=m.w / size[:, None], alpha=m.alpha * size)


def train(f: np.ndarray, s: np.ndarray, n_factors: int = 3, alternations: int = 40, rounds: int = 40, gamma: float = 1.0, tau_rise: float = 2.0, tau_decay: float = 8.0, rate: float = 1.0, seed: int = 0) -> Model:
    """Noise, first values, alternating fit, identification."""
    kernel = calcium_kernel(tau_rise, tau_decay, f.shape[1])
    rng = np.random.default_rng(seed)
    n = len(f)
    m = Model(np.ones(n), np.array([np.median(y) for y in f]), filters(f, s, kernel), rng.random((n, n_factors)), rng.random((n_factors, f.shape[1])), np.array([max(noise_deviation(y, rate), 1e-6) for y in f]), kernel, gamma)
    return identify(alternate(m, f, s, alternations, rounds))


def held_out(m: Model, f: np.ndarray, s: np.ndarray, rounds: int = 100, seed: int = 0) -> Model:
    """Latent factors of new data under fixed static parameters."""
    x = np.random.default_rng(seed).random((m.b.shape[1], f.shape[1]))
    return fit_latents(replace(m, x=x, kernel=calcium_cut(m.kernel, f.shape[1])), f, s, rounds)


def calcium_cut(kernel: np.ndarray, n: int) -> np.ndarray:
    return kernel[:n] if len(kernel) >= n else np.pad(kernel, (0, n - len(kernel)))


def reconstruction_error(f: np.ndarray, s: np.ndarray, tau_rise: float, delta: float, beta: np.ndarray, eta: float) -> float:
    """Half the squared error of beta on the convolved stimuli, and a penalty on both time constants."""
    r = f - beta @ convolve(calcium_kernel(tau_rise, tau_rise + delta, f.shape[1]), s)
    return float((r**2).sum() / 2 + eta * (2 * tau_rise + delta))


def fit_time_constants(f: np.ndarray, s: np.ndarray, eta: float = 0.1, rounds: int = 20, start: tuple[float, float] = (2.0, 5.0)) -> tuple[float, float, list[float]]:
    """(rise, decay, errors): regressors by least squares and time constants by quasi-Newton steps in turn."""
    tau, errors = np.array(start), []
    for _ in range(rounds):
        beta = filters(f, s, calcium_kernel(tau[0], tau.sum(), f.shape[1]))

        def cost(v: np.ndarray, beta=beta) -> tuple[float, np.ndarray]:
            e = lambda u: reconstruction_error(f, s, u[0], u[1], beta, eta)
            h = 1e-5
            return e(v), np.array([(e(v + h * d) - e(v - h * d)) / (2 * h) for d in np.eye(2)])

        tau, err = K.lbfgs_box(cost, tau, np.array([1e-2, 1e-2]), np.array([np.inf, np.inf]), 20)
        errors.append(err)
    return float(tau[0]), float(tau.sum()), errors


def stimulus_rows(ids: np.ndarray) -> np.ndarray:
    """One row per stimulus of a series of ids; 0 is none."""
    ids = np.asarray(ids, int)
    return (ids == np.arange(1, ids.max(initial=0) + 1)[:, None]).astype(float)


def best_models(fits: DataFrame) -> DataFrame:
    """The setting of best log joint per recording, the first of equals."""
    s = fits.where("param = 'log_joint'")
    return s.groupBy("recording_id").agg(F.max(F.struct("v", (-F.col("model")).alias("m"))).alias("x")).select("recording_id", (-F.col("x.m")).alias("model"), F.col("x.v").alias("log_joint"))
