"""The latent factor model fitted by Spark jobs: neurons in parallel, shared factors by sums over neurons.

The density of ``latent`` is a sum over neurons given the factors, and so is its gradient
by the factors. A fit is two tables: ``neurons`` (a trace and its static parameters a row)
and ``shared`` (the factors, the stimuli and the settings of a recording and model a row).

* static step: each neuron's own bounded problem, as many tasks as there are neurons;
* latent step: a round is one job. The neurons give their parts of cost and gradient at
  a ladder of projected gradient steps, the parts are summed by place, and the step of
  least cost is taken.

All recordings and settings of a grid go side by side; no task holds a recording.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import latent as L
from pulsegrid.sources.durable import durable

KEY = ["recording_id", "model"]
NEURONS = "recording_id string, model int, cell int, f array<double>, sigma double, alpha double, beta double, w array<double>, b array<double>"
SHARED = "recording_id string, model int, n int, s array<array<double>>, x array<array<double>>, step double, gamma double, tau_rise double, tau_decay double"
#: Steps of a ladder, as multiples of the last one taken; 0 stays.
LADDER = (4.0, 1.0, 0.25, 0.0625, 0.0039, 0.0)
#: Settings of a fit and their defaults.
DEFAULTS = {"n_factors": 3, "alternations": 40, "rounds": 40, "gamma": 1.0, "tau_rise": 2.0, "tau_decay": 8.0, "rate": 1.0, "seed": 0}


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in rows])


def _model(r, x: np.ndarray) -> tuple[L.Model, np.ndarray, np.ndarray]:
    """One neuron's model, its trace as one row, and the stimuli."""
    s = _matrix(r.s)
    kernel = L.calcium_kernel(r.tau_rise, r.tau_decay, len(r.f))
    row = lambda v: np.asarray(v, float)[None]
    return L.Model(np.array([r.alpha]), np.array([r.beta]), row(r.w), row(r.b), x, np.array([r.sigma]), kernel, r.gamma), row(r.f), s


def _neuron_rows(neurons: DataFrame, shared: DataFrame, change, schema: str) -> DataFrame:
    """``change(row)`` to a tuple, for each neuron beside what it shares."""
    names = [c.split(" ", 1)[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([change(r) for r in pdf.itertuples()], columns=names)

    return neurons.join(shared, KEY).mapInPandas(run, schema)


def prepared(traces: DataFrame, stimuli: DataFrame, grid: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(neurons, shared) with first values: noise, medians, filters by non-negative least squares, drawn weights and factors."""
    spark = traces.sparkSession
    rec = "recording_id"
    t = traces.select(rec, F.col("cell").cast("int").alias("cell"), F.col("frame").cast("int").alias("frame"), F.col("value").cast("double").alias("value"))
    s = stimuli.select(rec, F.col("k").cast("int").alias("k"), F.col("t").cast("int").alias("t")).distinct()
    extent = t.select(rec, "frame").union(s.select(rec, "t")).groupBy(rec).agg((F.max("frame") + 1).alias("n"))
    # a trace and a stimulus are rows of as many numbers as the recording has frames
    lists = t.groupBy(rec, "cell").agg(F.collect_list(F.struct("frame", "value")).alias("samples")).join(extent, rec)
    shown = extent.join(s.groupBy(rec).agg(F.collect_list(F.struct("k", "t")).alias("shown")), rec, "left")
    settings = spark.createDataFrame([(i, *{**DEFAULTS, **g}.values()) for i, g in enumerate(grid)], "model int, n_factors int, alternations int, rounds int, gamma double, tau_rise double, tau_decay double, rate double, seed long")
    each = F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("model")
    shared = shown.select("*", each).join(F.broadcast(settings), "model")  # one row a setting

    def first_shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                seen = [] if r.shown is None else r.shown
                s = np.zeros((max((p["k"] for p in seen), default=0) + 1, r.n))
                for p in seen:
                    s[p["k"], p["t"]] = 1
                x = np.random.default_rng([r.seed, zlib.crc32(r.recording_id.encode())]).random((r.n_factors, r.n))
                out.append((r.recording_id, r.model, r.n, s.tolist(), x.tolist(), 0.0, r.gamma, r.tau_rise, r.tau_decay))
            yield pd.DataFrame(out, columns=[c.split(" ", 1)[0] for c in SHARED.split(", ")])

    held = durable(shared.mapInPandas(first_shared, SHARED))
    rates = settings.select("model", "rate", "seed", "n_factors")

    def first_neuron(r) -> tuple:
        f = np.zeros(r.n)
        for p in r.samples:
            f[p["frame"]] = p["value"]
        w = L.filters(f[None], _matrix(r.s), L.calcium_kernel(r.tau_rise, r.tau_decay, r.n))[0]
        b = np.random.default_rng([r.seed, zlib.crc32(r.recording_id.encode()), r.cell & 0xFFFFFFFF]).random(r.n_factors)
        return r.recording_id, r.model, r.cell, f.tolist(), max(L.noise_deviation(f, r.rate), 1e-6), 1.0, float(np.median(f)), w.tolist(), b.tolist()

    neurons = _neuron_rows(lists.drop("n").select("*", each).join(F.broadcast(rates), "model"), held, first_neuron, NEURONS)
    return durable(neurons), held


def static_step(neurons: DataFrame, shared: DataFrame, rounds: int) -> DataFrame:
    """The neurons with their static parameters fitted to the factors."""

    def fit(r) -> tuple:
        m, f, s = _model(r, _matrix(r.x))
        m = L.fit_static(m, f, s, rounds)
        return r.recording_id, r.model, r.cell, list(r.f), r.sigma, float(m.alpha[0]), float(m.beta[0]), m.w[0].tolist(), m.b[0].tolist()

    return durable(_neuron_rows(neurons, shared, fit, NEURONS))


def _costs(neurons: DataFrame, tried: DataFrame) -> DataFrame:
    """(recording_id, model, at, cost, gradient): sums over neurons for each of the factors tried, ``tried(.., at, x)``."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                m, f, s = _model(r, _matrix(r.x))
                rest = f - L.reconstruction(m, s)
                cost = float((rest**2 / (2 * m.sigma[:, None] ** 2)).sum())
                g = m.b.T @ (L.correlate(m.kernel, -rest / m.sigma[:, None] ** 2) * m.alpha[:, None])
                held = sums.setdefault((r.recording_id, r.model, r.at), [0.0, 0.0])
                held[0] += cost
                held[1] = held[1] + g.ravel()
        yield pd.DataFrame([(*k, c, g) for k, (c, g) in sums.items()], columns=["recording_id", "model", "at", "cost", "gradient"])

    each = neurons.join(tried, KEY).mapInPandas(parts, "recording_id string, model int, at int, cost double, gradient array<double>")
    by = [*KEY, "at"]
    g = each.select(*by, F.posexplode("gradient").alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))
    g = g.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("gradient"))
    return each.groupBy(*by).agg(F.sum("cost").alias("cost")).join(g, by)


def latent_step(neurons: DataFrame, shared: DataFrame, rounds: int) -> DataFrame:
    """The shared factors after ``rounds`` ladders of projected gradient steps with the static parameters fixed; the cost never rises."""
    names = [c.split(" ", 1)[0] for c in SHARED.split(", ")]
    more = SHARED + ", at int"

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = _matrix(r.x)
                if r.gradient is None:  # where it stands, for the first gradient
                    out.append((*[getattr(r, c) for c in names], len(LADDER) - 1))
                    continue
                g = np.asarray(r.gradient).reshape(x.shape)
                out += [(*[np.maximum(0, x - r.step * k * g).tolist() if c == "x" else getattr(r, c) for c in names], at) for at, k in enumerate(LADDER)]
            yield pd.DataFrame(out, columns=[*names, "at"])

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, first = _matrix(r.x), r.step == 0
                g = np.asarray(r.gradient) + 1 / r.gamma
                size = float(np.linalg.norm(g))
                step = 0.1 * float(np.linalg.norm(x)) / size if first and size else r.step * (LADDER[r.at] or LADDER[-2] / 16)
                out.append((*[step if c == "step" else getattr(r, c) for c in names], g))
            yield pd.DataFrame(out, columns=[*names, "gradient"])

    state = shared.withColumn("step", F.lit(0.0)).withColumn("gradient", F.lit(None).cast("array<double>"))
    for _ in range(rounds + 1):  # the first only measures
        put = durable(state.mapInPandas(tried, more))
        cost = _costs(neurons, put)
        # the prior is the sum of the factors
        prior = F.aggregate("x", F.lit(0.0), lambda a, row: a + F.aggregate(row, F.lit(0.0), lambda c, v: c + v)) / F.col("gamma")
        scored = put.join(cost, [*KEY, "at"]).withColumn("total", F.col("cost") + prior)
        best = scored.groupBy(*KEY).agg(F.min_by("at", F.struct("total", (-F.col("at")).alias("late"))).alias("at"))
        state = durable(scored.join(best, [*KEY, "at"]).select(*names, "at", "gradient").mapInPandas(taken, SHARED + ", gradient array<double>"))
    return state.drop("gradient")


def log_joint(neurons: DataFrame, shared: DataFrame) -> DataFrame:
    """(recording_id, model, log_joint), without constants."""

    def part(r) -> tuple:
        m, f, s = _model(r, _matrix(r.x))
        return r.recording_id, r.model, float(((f - L.reconstruction(m, s)) ** 2 / (2 * m.sigma[:, None] ** 2)).sum())

    cost = _neuron_rows(neurons, shared, part, "recording_id string, model int, cost double").groupBy(*KEY).agg(F.sum("cost").alias("cost"))
    prior = shared.select(*KEY, (F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, v: a + v) / F.col("gamma")).alias("prior"))
    return cost.join(prior, KEY).select(*KEY, (-F.col("cost") - F.col("prior")).alias("log_joint"))


def parts_of_traces(neurons: DataFrame, shared: DataFrame) -> DataFrame:
    """(recording_id, model, cell, frame, value, fitted, evoked, spontaneous): reconstructions, and what stimuli and factors add to each."""

    def part(r) -> tuple:
        m, f, s = _model(r, _matrix(r.x))
        a, b = L.decoupled(m, s)
        return r.recording_id, r.model, r.cell, list(r.f), L.reconstruction(m, s)[0].tolist(), a[0].tolist(), b[0].tolist()

    names = ["value", "fitted", "evoked", "spontaneous"]
    rows = _neuron_rows(neurons, shared, part, "recording_id string, model int, cell int, " + ", ".join(f"{c} array<double>" for c in names))
    return rows.select(*KEY, "cell", F.posexplode(F.arrays_zip(*names)).alias("frame", "p")).select(*KEY, "cell", "frame", *[f"p.{c}" for c in names])


def identified(neurons: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors of unit norm by falling size, drives of unit norm, their scales in b and alpha."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e * e))
    sized = shared.withColumn("norms", F.transform("x", norm))
    # places of the factors by falling norm, the first of equals first
    order = F.transform(F.array_sort(F.transform("norms", lambda n, i: F.struct((-n).alias("m"), i.alias("i")))), lambda e: e["i"])
    sized = sized.withColumn("order", order).withColumn("scale", F.transform("order", lambda i: F.when(F.get("norms", i) > 0, F.get("norms", i)).otherwise(1.0)))
    x = F.transform(F.sequence(F.lit(0), F.size("order") - 1), lambda k: F.transform(F.get("x", F.get("order", k)), lambda v: v / F.get("scale", k)))
    after = sized.withColumn("x", x)
    b = F.transform(F.sequence(F.lit(0), F.size("order") - 1), lambda k: F.get("b", F.get("order", k)) * F.get("scale", k))
    n = neurons.join(after.select(*KEY, "order", "scale"), KEY).withColumn("b", b)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e * e)
    n = n.withColumn("size", F.sqrt(square("w") + square("b"))).withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(1.0))
    n = n.withColumn("w", F.transform("w", lambda v: v / F.col("size"))).withColumn("b", F.transform("b", lambda v: v / F.col("size"))).withColumn("alpha", F.col("alpha") * F.col("size"))
    return n.drop("order", "scale", "size"), after.drop("norms", "order", "scale")


def fit(traces: DataFrame, stimuli: DataFrame, grid: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(neurons, shared) of a fit for each recording and setting, alternating between factors and static parameters.

    ``traces(recording_id, cell, frame, value)``, ``stimuli(recording_id, k, t)``. Settings with
    the same numbers of rounds go together.
    """
    full = [{**DEFAULTS, **g} for g in grid]
    neurons, shared = prepared(traces, stimuli, grid)
    done = None
    for alternations, rounds in sorted({(g["alternations"], g["rounds"]) for g in full}):
        mine = [i for i, g in enumerate(full) if (g["alternations"], g["rounds"]) == (alternations, rounds)]
        n, s = (df.where(F.col("model").isin(mine)) for df in (neurons, shared))
        for _ in range(alternations):
            s = latent_step(n, s, rounds)
            n = static_step(n, s, rounds)
        n, s = identified(n, s)
        done = (n, s) if done is None else (done[0].union(n), done[1].union(s))
    return done


def estimate_latents(neurons: DataFrame, traces: DataFrame, stimuli: DataFrame, grid: list[dict], rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(neurons, shared) of new traces of the same cells under the static parameters of ``neurons``; only the factors are fitted."""
    fresh, shared = prepared(traces, stimuli, grid)
    own = fresh.select(*KEY, "cell", "f").join(neurons.drop("f"), [*KEY, "cell"]).select(*[c.split(" ", 1)[0] for c in NEURONS.split(", ")])
    own = durable(own)
    return own, latent_step(own, shared, rounds)


def fit_models(traces: DataFrame, stimuli: DataFrame, grid: list[dict]) -> DataFrame:
    """(recording_id, model, param, i, j, v): all parameters of ``fit`` and its log joint, a number a row."""
    neurons, shared = (durable(df) for df in fit(traces, stimuli, grid))
    out = log_joint(neurons, shared).select(*KEY, F.lit("log_joint").alias("param"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("log_joint").alias("v"))
    for name in ("alpha", "beta", "sigma"):
        out = out.union(neurons.select(*KEY, F.lit(name), "cell", F.lit(0), name))
    for name in ("w", "b"):
        out = out.union(neurons.select(*KEY, F.lit(name), "cell", F.posexplode(name)))
    return out.union(shared.select(*KEY, F.posexplode("x").alias("i", "row")).select(*KEY, F.lit("x"), "i", F.posexplode("row")))


#: Factors by which both time constants are tried beside each other in a round.
TRIES = (-1, 0, 1)


def time_constants(traces: DataFrame, stimuli: DataFrame, eta: float = 0.1, rounds: int = 20, start: tuple[float, float] = (2.0, 5.0)) -> DataFrame:
    """(recording_id, tau_rise, tau_decay, error): rise and decay of the kernel that leave the least error of regressors on the stimuli.

    A round is one job: constants a factor longer and shorter are tried beside those of the
    round, each neuron fits its regressors to every pair, the pair of least sum over
    neurons is taken, and the factor shrinks where that is the pair itself.
    """
    neurons, shared = prepared(traces, stimuli, [{"n_factors": 1}])
    rec = "recording_id"
    state = durable(shared.select(*KEY, F.lit(start[0]).alias("rise"), F.lit(start[1]).alias("delta"), F.lit(1.5).alias("by"), F.lit(None).cast("double").alias("error")))
    held = neurons.join(shared.select(*KEY, "s"), KEY).select(*KEY, "f", "s")
    pairs = [(a, b) for a in TRIES for b in TRIES]

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                f, s = np.asarray(r.f, float)[None], _matrix(r.s)
                each = np.zeros(len(pairs))
                for at, (a, b) in enumerate(pairs):
                    rise, delta = r.rise * r.by**a, r.delta * r.by**b
                    beta = L.filters(f, s, L.calcium_kernel(rise, rise + delta, f.shape[1]))
                    each[at] = L.reconstruction_error(f, s, rise, delta, beta, 0.0)
                sums[r.recording_id] = sums.get(r.recording_id, 0.0) + each
        yield pd.DataFrame([(k, a, b, float(e)) for k, v in sums.items() for (a, b), e in zip(pairs, v, strict=True)], columns=[rec, "a", "b", "e"])

    for _ in range(rounds):
        parts = held.join(state, KEY).mapInPandas(errors, "recording_id string, a int, b int, e double").groupBy(rec, "a", "b").agg(F.sum("e").alias("e"))
        rise, delta = F.col("rise") * F.pow("by", F.col("a")), F.col("delta") * F.pow("by", F.col("b"))
        tried = parts.join(state.drop("error"), rec).select(*KEY, rise.alias("rise"), delta.alias("delta"), "by", (F.col("e") + eta * (2 * rise + delta)).alias("error"), ((F.col("a") == 0) & (F.col("b") == 0)).alias("same"))
        best = tried.groupBy(*KEY).agg(F.min(F.struct("error", (~F.col("same")).alias("moved"), "rise", "delta", "by")).alias("m"))
        state = durable(best.select(*KEY, "m.rise", "m.delta", F.when(F.col("m.moved"), F.col("m.by")).otherwise(F.sqrt("m.by")).alias("by"), "m.error"))
    return state.select(rec, F.col("rise").alias("tau_rise"), (F.col("rise") + F.col("delta")).alias("tau_decay"), "error")
