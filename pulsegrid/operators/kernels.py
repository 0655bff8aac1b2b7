"""NumPy kernels that the operators run per series, cell or segment."""

from __future__ import annotations

import numpy as np

WINDOWS = {"flat": np.ones, "hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}


def smooth(x: np.ndarray, length: int = 11, window: str = "hanning") -> np.ndarray:
    """Window smoothing with reflected ends; n + length - 1 values."""
    x = np.asarray(x, float)
    if x.ndim != 1:
        raise ValueError("one series at a time")
    if len(x) < length:
        raise ValueError("the series is shorter than the window")
    if length < 3:
        return x
    if window not in WINDOWS:
        raise ValueError(f"window must be one of {', '.join(WINDOWS)}")
    w = WINDOWS[window](length)
    ends = np.concatenate([x[1:length][::-1], x, x[-length:-1][::-1]])
    return np.convolve(w / w.sum(), ends, "valid")


def exponential_smooth(x, factor: float = 0.8) -> np.ndarray:
    """s_i = factor * s_{i-1} + (1 - factor) * x_i."""
    out = np.array(x, float)
    for i in range(1, len(out)):
        out[i] = factor * out[i - 1] + (1 - factor) * out[i]
    return out


def find_peaks(x: np.ndarray, distance: int = 1, height: float | None = None) -> list[int]:
    """Local maxima (the middle of a plateau) of at least ``height``, the higher ones keeping others ``distance`` away."""
    x = np.asarray(x, float)
    peaks, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j
        i += 1
    p = np.array([k for k in peaks if height is None or x[k] >= height], int)
    keep = np.ones(len(p), bool)
    for k in np.argsort(x[p], kind="stable")[::-1] if len(p) else ():
        if keep[k]:
            keep[(np.abs(p - p[k]) < distance) & (np.arange(len(p)) != k)] = False
    return p[keep].tolist()


def forward_mean(x: np.ndarray, width: int = 100) -> np.ndarray:
    """Mean of the ``width`` values from each on; the last ``width`` values stay."""
    out = np.array(x, float)
    if len(x) > width:
        total = np.concatenate([[0.0], np.cumsum(out)])
        n = len(x) - width
        out[:n] = (total[width : width + n] - total[:n]) / width
    return out


def peak_events(activity: np.ndarray, width: int = 100) -> list[tuple[int, int, int]]:
    """(first, last, peak) of events around peaks of the averaged and then smoothed activity.

    Peaks of at least the mean are ``width`` apart; of two neighbours between which the
    activity never falls under the mean the lower goes (of equals the first), and those of
    the last ``width`` frames, where no average is taken, go too.
    """
    if len(activity) < 11:
        return []
    x = smooth(forward_mean(activity, width), 11, "hamming")[5:-5]
    mean, std = x.mean(), x.std()
    peaks = find_peaks(x, width, mean)
    keep = np.ones(len(peaks), bool)
    for k, (p, q) in enumerate(zip(peaks, peaks[1:])):
        if x[p : q + 1].min() >= mean:
            keep[k + 1 if x[p] > x[q] else k] = False
    stop = max(len(x) - width, 0)
    peaks = [p for p, k in zip(peaks, keep, strict=True) if k and p < stop]
    out = []
    for k, p in enumerate(peaks):
        lo = peaks[k - 1] if k else 0
        hi = peaks[k + 1] if k + 1 < len(peaks) else stop
        under = np.flatnonzero(x[lo:p] < mean)
        first = lo + (under[-1] if len(under) else int(np.argmin(x[lo:p])) if p > lo else 0)
        under = np.flatnonzero(x[p:hi] < mean - 1.5 * std)
        last = p + (under[0] if len(under) else len(x[p:hi]) - 1 - int(np.argmin(x[p:hi][::-1])))
        out.append((int(first), int(last), int(p)))
    return out


def gauss_blur_1d(x: np.ndarray, width: float, axis: int = -1) -> np.ndarray:
    """Gaussian blur of a width in samples, made in the frequency domain along an axis."""
    x = np.asarray(x, float)
    n = x.shape[axis]
    f = np.fft.fftfreq(n)
    shape = [1] * x.ndim
    shape[axis] = n
    return np.fft.ifft(np.fft.fft(x, axis=axis) * np.exp(-2 * (np.pi * f * width) ** 2).reshape(shape), axis=axis).real


def gauss_blur_2d(x: np.ndarray, width: float) -> np.ndarray:
    return gauss_blur_1d(gauss_blur_1d(x, width, 0), width, 1)


def norm01(x: np.ndarray) -> np.ndarray:
    """Min-max scaling; a constant series is 0."""
    x = np.asarray(x, float)
    span = x.max() - x.min() if x.size else 0
    return (x - x.min()) / span if span else np.zeros_like(x)


def savitzky_golay(x: np.ndarray, width: int = 5, order: int = 3) -> np.ndarray:
    """Polynomial smoothing; the ends use the fit of the first and last window."""
    x = np.asarray(x, float)
    h = width // 2
    if len(x) < width:
        raise ValueError("the series is shorter than the window")
    a = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    fit = np.linalg.pinv(a)
    out = np.convolve(x, fit[0][::-1], "same")
    out[:h] = (a @ (fit @ x[:width]))[:h]
    out[-h:] = (a @ (fit @ x[-width:]))[-h:]
    return out


def bleaching(x: np.ndarray) -> np.ndarray:
    """The series over its own cubic fit."""
    t = np.arange(len(x), dtype=float)
    return np.asarray(x, float) / np.polyval(np.polyfit(t, x, 3), t)


def butter_bandpass(low: float, high: float, rate: float, order: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a Butterworth band-pass by the bilinear transform with prewarping."""
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    w1, w2 = (4 * np.tan(np.pi * f / rate) for f in (low, high))
    bw, w0 = w2 - w1, np.sqrt(w1 * w2)
    half = poles * bw / 2
    root = np.sqrt(half**2 - w0**2 + 0j)
    p = np.concatenate([half + root, half - root])
    gain = bw**order * np.prod(4.0 / np.ones(order)) / np.prod(4 - p)
    z = np.concatenate([np.ones(order), -np.ones(order)])
    return np.real(gain * np.poly(z)), np.real(np.poly((4 + p) / (4 - p)))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal filter in transposed direct form."""
    n = max(len(a), len(b))
    b, a = (np.pad(np.asarray(c, float), (0, n - len(c))) / a[0] for c in (b, a))
    state, out = np.zeros(n), np.empty(len(x))
    for i, v in enumerate(np.asarray(x, float)):
        y = b[0] * v + state[0]
        state[:-1] = state[1:] + b[1:] * v - a[1:] * y
        out[i] = y
    return out


def next_power(n: float) -> int:
    """Smallest power of two that is not under n."""
    p = 1
    while p < n:
        p *= 2
    return p


def morlet(rate: float, freq: float, cycles: float = 4, time: np.ndarray | None = None) -> np.ndarray:
    """Complex Morlet wavelet of unit energy."""
    s = cycles / (2 * np.pi * freq)
    t = np.arange(-4 * s, 4 * s + 0.5 / rate, 1 / rate) if time is None else time
    return (s * np.sqrt(np.pi)) ** -0.5 * np.exp(2j * np.pi * freq * t) * np.exp(-(t**2) / (2 * s**2))


def morlet_power(x: np.ndarray, rate: float, freqs, cycles, seconds: float | None = None) -> np.ndarray:
    """Power per (frequency, sample), of wavelets over ``seconds`` on either side (None: until they fade): one FFT of the series for all frequencies.

    Power is that of the sum over samples; it is not divided by the rate.
    """
    x = np.asarray(x, float)
    reach = None if seconds is None else int(round(seconds * rate))
    time = None if reach is None else np.arange(-reach, reach + 1) / rate
    waves = [morlet(rate, f, c, time) for f, c in zip(freqs, np.broadcast_to(cycles, (len(freqs),)), strict=True)]
    n = next_power(len(x) + max(map(len, waves)) - 1)
    spectrum, out = np.fft.fft(x, n), np.empty((len(waves), len(x)))
    for i, w in enumerate(waves):
        y = np.fft.ifft(spectrum * np.fft.fft(w, n))
        at = (len(w) - 1) // 2
        out[i] = np.abs(y[at : at + len(x)]) ** 2
    return out


def welch(x: np.ndarray, rate: float, seconds: float = 2.0, pad: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density): half-overlapping Hann segments without their mean, zero-padded ``pad`` times."""
    x = np.asarray(x, float)
    n = min(int(seconds * rate), len(x))
    nfft = max(n, int(seconds * pad * rate))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = max(1, n - n // 2)
    segments = [x[i : i + n] for i in range(0, len(x) - n + 1, step)]
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w, nfft)) ** 2 for s in segments], 0) / (rate * (w**2).sum())
    p[1 : -1 if nfft % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nfft, 1 / rate), p


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-10 * max(1.0, np.abs(a.T @ y).max(initial=0))
    for _ in range(rounds):
        g = a.T @ (y - a @ x)
        if free.all() or (g[~free] <= tol).all():
            break
        free[np.flatnonzero(~free)[np.argmax(g[~free])]] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            if (s[free] > 0).all():
                x = s
                break
            bad = free & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def silhouettes(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Silhouette of each row of a distance matrix; 0 for the only member of a cluster."""
    ids, own = np.unique(labels, return_inverse=True)
    if len(ids) < 2:
        return np.zeros(len(labels))
    one = np.eye(len(ids))[own]
    size = one.sum(0)
    total = d @ one
    a = total[np.arange(len(labels)), own] / np.maximum(size[own] - 1, 1)
    mean = total / size
    mean[np.arange(len(labels)), own] = np.inf
    b = mean.min(1)
    s = (b - a) / np.maximum(np.maximum(a, b), 1e-300)
    return np.where(size[own] > 1, s, 0.0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 300) -> np.ndarray:
    """Labels of one run of k-means from spread-out starts."""
    n = len(x)
    centres = [x[rng.integers(n)]]
    for _ in range(1, min(k, n)):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(n, p=d / d.sum())] if d.sum() > 0 else x[rng.integers(n)])
    c, labels = np.array(centres), None
    sq = (x**2).sum(1)[:, None]
    for _ in range(rounds):
        new = np.argmin(sq - 2 * x @ c.T + (c**2).sum(1), 1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        c = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(len(c))])
    return labels


def lbfgs_box(fun, x0: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 40, memory: int = 8) -> tuple[np.ndarray, float]:
    """Minimum within bounds by projected limited-memory quasi-Newton steps; ``fun`` returns (value, gradient)."""
    x = np.clip(x0, low, high)
    f, g = fun(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-8:
            break
        q, alphas = np.where(free, g, 0.0), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            alphas.append(a)
            q = q - a * y
        if pairs:
            s, y, _ = pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(pairs, reversed(alphas), strict=True):
            q = q + s * (a - r * (y @ q))
        d = -np.where(free, q, 0.0)
        if d @ g >= 0:
            d, pairs = -np.where(free, g, 0.0), []
        step = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(d).max(), 1e-12))
        for _ in range(40):
            new = np.clip(x + step * d, low, high)
            fn, gn = fun(new)
            if fn <= f + 1e-4 * g @ (new - x):
                break
            step /= 2
        else:
            break
        s, y = new - x, gn - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        done = abs(f - fn) <= 1e-12 * max(1.0, abs(f))
        x, f, g = new, fn, gn
        if done:
            break
    return x, f
