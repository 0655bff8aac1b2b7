"""Registered queries on rasters and traces of nations. Those that SQL can express have theirs in
``signal_catalogue``; for the others tests compare the kernels with plain code.

Rasters and traces of nations by ship day (one recording a region) keep the per-recording
kernels at the size they are meant for; every row of the tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import assemblies, components, latent_jobs, loss, merging, raster, sce, sequences, signals, spatial, spectral, surrogates, transitions, waves
from pulsegrid.sources import tables as S
from pulsegrid.sources.durable import durable

N_DAYS = 2600
#: Surrogates of a functional clustering in the registered queries.
S_MERGES = 20


def nation_lines(spark: SparkSession, d: str) -> DataFrame:
    """(recording_id, cell, frame, value): quantity shipped by each nation's suppliers per day."""
    line, sup, nat = (S.table(spark, d, x) for x in ("lineitem", "supplier", "nation"))
    t = line.join(sup, line["l_suppkey"] == sup["s_suppkey"]).join(nat, sup["s_nationkey"] == nat["n_nationkey"])
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("int")
    key = [F.col("n_regionkey").cast("string").alias("recording_id"), F.col("s_nationkey").cast("int").alias("cell"), day.alias("frame")]
    return t.groupBy(*key).agg(F.sum("l_quantity").alias("value"))


def busy_days(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Days on which a nation ships more than nine tenths of its days."""
    lines = nation_lines(spark, d)
    cut = lines.groupBy("recording_id", "cell").agg(F.percentile("value", F.lit(0.9)).alias("cut"))
    s = lines.join(cut, ["recording_id", "cell"]).where("value > cut").select("recording_id", "cell", "frame")
    return s, S.recordings_of(s, N_DAYS), S.cells_of(s)


def rounded(df: DataFrame, name: str = "value") -> DataFrame:
    return df.withColumn(name, F.round(name, 6))


OPTIONS = sequences.SequenceOptions(low=1, high=8, min_len=3, min_reps=2, branches=2, max_depth=5)


def beam_paths(spark, d):
    s, r, _ = busy_days(spark, d)
    paths = sequences.beam_paths(transitions.transitions(s, r, 1, 8), OPTIONS, 25)
    return rounded(paths, "cost").withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


def sequence_search(spark, d):
    s, r, _ = busy_days(spark, d)
    paths = sequences.beam_paths(transitions.transitions(s, r, 1, 8), OPTIONS, 25)
    return sequences.without_contained(sequences.find_sequences(s, paths, OPTIONS), OPTIONS)


def significant_sequences(spark, d):
    s, r, c = busy_days(spark, d)
    return sequences.significant_sequences(s, r, c, OPTIONS, 5)[1]


def best_order(spark, d):
    s, r, c = busy_days(spark, d)
    return sequences.significant_sequences(s, r, c, OPTIONS, 2)[0]


def order_loss(spark, d):
    s, r, c = busy_days(spark, d)
    orders = c.groupBy("recording_id").agg(F.sort_array(F.collect_set("cell")).alias("cells")).withColumn("order_id", F.lit(0))
    return loss.score_orders(s, r, orders, 1, 8)


def graph_paths(spark, d):
    s, r, _ = busy_days(spark, d)
    return waves.find_graph_sequences(s, r, 1, 8, 10)[0]


def graph_waves(spark, d):
    s, r, _ = busy_days(spark, d)
    return waves.find_graph_sequences(s, r, 1, 8, 10, slopes=(-2.0, 0.0, 2.0), error_rate=0.4)[1]


def order_repetitions(spark, d):
    s, _, c = busy_days(spark, d)
    return waves.order_repetitions(s, c.groupBy("recording_id").agg(F.sort_array(F.collect_set("cell")).alias("cells")), 1, 8)


def _events(spark, d):
    s = S.event_spikes(S.table(spark, d, "events"))
    r = S.recordings_of(s, 720)
    e = durable(sce.detect(s, r, 1, sce.detection_threshold(s, r, 1, 100)))  # surrogates are drawn once
    return s, r, e


def kmeans_events(spark, d):
    s, _, e = _events(spark, d)
    return assemblies.cluster_events(sce.sce_cells(s, e), [2, 3, 4], n_surrogates=10, trials=10)


def assembly_cells(spark, d):
    s, _, e = _events(spark, d)
    cells = durable(sce.sce_cells(s, e))
    k = assemblies.cluster_events(cells, [3], n_surrogates=5, trials=10)
    return assemblies.assemblies(cells, k.select("recording_id", "sce_id", "label"), n_surrogates=100)[0]


def peak_events(spark, d):
    s = S.event_spikes(S.table(spark, d, "events"))
    r = S.recordings_of(s, 720)
    return sce.detect_peaks(s, r)


def sce_no_redundancy(spark, d):
    s = S.event_spikes(S.table(spark, d, "events"))
    r = S.recordings_of(s, 720)
    return sce.detect_no_redundancy(s, r, 3, sce.detection_threshold(s, r, 3, 20))


def trace_events(spark, d):
    t = nation_lines(spark, d)
    rec = t.select("recording_id").distinct().withColumn("n_frames", F.lit(N_DAYS))
    return sce.detect_on_traces(t, rec, n_cells=1)


def _merges(spark, d, early_stop):
    s, _, _ = busy_days(spark, d)
    return merging.cluster_trains(s.withColumn("t", F.col("frame").cast("double")), S_MERGES, sigma=3.0, early_stop=early_stop)


def fca_merges(spark, d):
    return rounded(_merges(spark, d, False), "scale")


def fca_tree(spark, d):
    return rounded(rounded(rounded(merging.tree_nodes(_merges(spark, d, False)), "scale"), "lowest"), "height")


def fca_clusters(spark, d):
    s, _, _ = busy_days(spark, d)
    return merging.named_leaves(merging.tree_clusters(_merges(spark, d, True)), s)


def train_jitter(spark, d):
    s, _, _ = busy_days(spark, d)
    return rounded(surrogates.uniform_jitter(s.withColumn("t", F.col("frame").cast("double")).drop("frame"), 5.0, 1), "t")


def train_dither(spark, d):
    s, _, _ = busy_days(spark, d)
    return surrogates.dithered(s.withColumn("t", F.col("frame").cast("long")).drop("frame"), 5, 0, N_DAYS, 1)


def smoothed(spark, d):
    return rounded(signals.smooth(nation_lines(spark, d), 11, "hamming"))


def savitzky_golay(spark, d):
    return rounded(signals.savitzky_golay(nation_lines(spark, d)))


def band_passed(spark, d):
    return signals.band_pass(nation_lines(spark, d), 0.05, 0.2, 1.0, 3)


def blurred(spark, d):
    return rounded(signals.gauss_blur(nation_lines(spark, d), 5.0))


def _signal(spark, d):
    return nation_lines(spark, d).select(F.col("cell").alias("segment"), F.col("frame").alias("sample"), "value")


#: Samples a second, as the days of a nation's shipments are read as a signal, and the frequencies explored.
RATE = 30.0
WAVES = spectral.WaveletOptions(0.6, 12, 12, cycles=4, max_cycles=8, log_freqs=True)


def morlet_spectrum(spark, d):
    return rounded(rounded(spectral.power_spectrum(spectral.morlet_power(_signal(spark, d), RATE, WAVES)), "power"), "freq")


def welch_spectrum(spark, d):
    return rounded(rounded(spectral.welch_change(_signal(spark, d).withColumn("sample", F.col("sample").cast("int")), 30.0), "power"), "freq")


def oscillations(spark, d):
    raw = spectral.morlet_power(_signal(spark, d), RATE, WAVES)
    found = spectral.episodes(raw, spectral.thresholds(spectral.background_fit(raw), RATE, 0.8, 2.0))
    return rounded(found, "freq")


def component_order(spark, d):
    return components.order_by_components(nation_lines(spark, d), 3, 30)


def latent_fit(spark, d):
    t = nation_lines(spark, d)
    stim = t.select("recording_id", (F.col("frame") % 7).alias("k"), F.col("frame").alias("t")).distinct()
    return latent_jobs.fit_models(t, stim, [{"n_factors": 2, "alternations": 1, "rounds": 4}])


def latent_parts(spark, d):
    """Evoked and spontaneous parts of every nation's signal."""
    t = nation_lines(spark, d)
    stim = t.select("recording_id", (F.col("frame") % 7).alias("k"), F.col("frame").alias("t")).distinct()
    return latent_jobs.parts_of_traces(*latent_jobs.fit(t, stim, [{"n_factors": 2, "alternations": 1, "rounds": 2}]))


def graph_colours(spark, d):
    s, r, _ = busy_days(spark, d)
    return spatial.colour_graphs(transitions.top_followers(transitions.transitions(s, r, 1, 8), 2), "recording_id")


def run_transitions(spark, d):
    s, r, _ = busy_days(spark, d)
    return rounded(transitions.run_transitions(raster.runs(s), s, r, 1, 8), "mean_lag")


QUERIES = {
    f.__name__: f
    for f in (
        beam_paths, sequence_search, significant_sequences, best_order, order_loss, graph_paths, graph_waves, order_repetitions, kmeans_events, assembly_cells, peak_events,
        sce_no_redundancy, trace_events, fca_merges, fca_tree, fca_clusters, train_jitter, train_dither, smoothed, savitzky_golay, band_passed, blurred, morlet_spectrum, welch_spectrum, oscillations,
        component_order, latent_fit, latent_parts, graph_colours, run_transitions,
    )
}
