"""The registered queries over the shared tables and the SQL each is compared with.

Two rasters are used: ``ev`` (user, hour; 720 frames) of events and ``sd`` (supplier,
ship day; 2,600 frames) of line items. All rows of the tables take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import assemblies, distributions, raster, sce, signals, spatial, spectral, surrogates, sweeps, trains, transitions
from pulsegrid.plans import kernels_catalogue, shape_catalogue, signal_catalogue
from pulsegrid.sources import graphs
from pulsegrid.sources import tables as S
from pulsegrid.sources.durable import shared_place

N_FRAMES = 720
N_DAYS = 2600
#: Surrogates of a threshold and of an edge filter in the registered queries.
S_ACTIVITY, S_EDGES = 100, 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT DISTINCT CAST(user_id AS INTEGER) AS cell, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INTEGER) AS frame FROM events)"
SD = "ev AS (SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS cell, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame FROM lineitem)"
CELLS = "cells AS (SELECT DISTINCT cell FROM ev)"
FRAMES = f"frames AS (SELECT CAST(unnest(range({N_FRAMES})) AS INTEGER) AS frame)"
RUNS = """isl AS (SELECT cell, frame, frame - row_number() OVER (PARTITION BY cell ORDER BY frame) AS g FROM ev),
r0 AS (SELECT cell, g, min(frame) AS start_frame, max(frame) AS end_frame FROM isl GROUP BY cell, g),
runs AS (SELECT cell, CAST(row_number() OVER (PARTITION BY cell ORDER BY start_frame) - 1 AS INTEGER) AS run_id, start_frame, end_frame,
  CAST(end_frame - start_frame + 1 AS INTEGER) AS length FROM r0)"""


def rolled_sql(n: int) -> str:
    return (
        f"surr AS (SELECT unnest(range({n})) AS surr), rolled AS (SELECT surr, cell, "
        f"(frame + (surr * 7919 + CAST(cell AS BIGINT) * 104729 + surr * cell * 31 + CAST(cell AS BIGINT) * cell * 17) % {N_FRAMES - 1} + 1) % {N_FRAMES} AS frame FROM ev, surr)"
    )


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__.removeprefix("q_")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def ev(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = S.event_spikes(S.table(spark, d, "events"))
    return s, S.recordings_of(s, N_FRAMES), S.cells_of(s)


def long_(c: str):
    return F.col(c).cast("long").alias(c)


@query(f"WITH {EV} SELECT cell, CAST(count(*) AS DOUBLE) / {N_FRAMES} AS rate FROM ev GROUP BY cell")
def q_spike_rates(spark, d):
    s, r, c = ev(spark, d)
    return raster.spike_rates(s, r, c).select("cell", "rate")


@query(f"WITH {EV}, {FRAMES} SELECT frames.frame, count(DISTINCT cell) AS n FROM frames LEFT JOIN ev ON ev.frame = frames.frame GROUP BY 1")
def q_activity_sum(spark, d):
    s, r, _ = ev(spark, d)
    return raster.activity_sum(s, r).select("frame", long_("n_cells_active").alias("n"))


@query(f"WITH {EV}, {FRAMES}, {CELLS} SELECT frames.frame, round(count(DISTINCT cell) * 100.0 / (SELECT count(*) FROM cells), 6) AS percent FROM frames LEFT JOIN ev ON ev.frame = frames.frame GROUP BY 1")
def q_activity_percent(spark, d):
    s, r, _ = ev(spark, d)
    return raster.activity_sum(s, r, percent=True).select("frame", F.round("percent", 6).alias("percent"))


@query(f"WITH {EV}, i AS (SELECT cell, frame, frame - lag(frame) OVER (PARTITION BY cell ORDER BY frame) AS isi FROM ev) SELECT cell, frame, isi FROM i WHERE isi IS NOT NULL")
def q_isi(spark, d):
    return raster.isi(ev(spark, d)[0]).select("cell", "frame", "isi")


@query(f"WITH {EV}, b AS (SELECT DISTINCT cell, frame // 5 AS b FROM ev) SELECT cell, CAST(b * 5 + k AS INTEGER) AS frame FROM b, (SELECT unnest(range(5)) AS k) WHERE b * 5 + k < {N_FRAMES}")
def q_bin_or(spark, d):
    s, r, _ = ev(spark, d)
    return raster.bin_or(s, r, 5).select("cell", "frame")


@query(f"WITH {EV} SELECT cell, CAST(frame // 5 AS INTEGER) AS bin, count(*) AS n FROM ev GROUP BY 1, 2")
def q_bin_sum(spark, d):
    return raster.bin_sum(ev(spark, d)[0], 5).select("cell", "bin", "n")


@query(f"WITH {EV}, {RUNS} SELECT * FROM runs")
def q_runs(spark, d):
    return raster.runs(ev(spark, d)[0]).drop("recording_id")


@query(f"WITH {SD}, {RUNS} SELECT * FROM runs")
def q_runs_shipments(spark, d):
    return raster.runs(S.ship_day_spikes(S.table(spark, d, "lineitem"), distinct=False)).drop("recording_id")


@query(f"WITH {EV}, {RUNS} SELECT cell, string_agg(CAST(length AS VARCHAR), ',' ORDER BY run_id) AS durations FROM runs GROUP BY cell")
def q_run_durations(spark, d):
    s, _, c = ev(spark, d)
    return raster.run_durations(s, c).select("cell", F.array_join(F.col("durations").cast("array<string>"), ",").alias("durations"))


@query(f"WITH {EV}, {RUNS}, {FRAMES}, {CELLS} SELECT cells.cell, frames.frame, coalesce(run_id, -1) AS run_id FROM cells CROSS JOIN frames LEFT JOIN runs ON runs.cell = cells.cell AND frames.frame BETWEEN start_frame AND end_frame")
def q_transient_ids(spark, d):
    return raster.transient_ids(*ev(spark, d)).select("cell", "frame", "run_id")


@query(f"WITH {EV}, f AS (SELECT DISTINCT frame FROM ev), g AS (SELECT frame, frame - row_number() OVER (ORDER BY frame) AS g FROM f), r AS (SELECT min(frame) AS start_frame, max(frame) AS end_frame FROM g GROUP BY g) SELECT *, CAST(end_frame - start_frame + 1 AS INTEGER) AS length FROM r")
def q_continuous_frames(spark, d):
    return raster.continuous_frames(ev(spark, d)[0]).select("start_frame", "end_frame", "length")


THR = f"""act AS (SELECT surr, frame, count(*) AS n FROM rolled GROUP BY 1, 2),
full_ AS (SELECT surr.surr, frames.frame, coalesce(n, 0) AS n FROM surr CROSS JOIN frames LEFT JOIN act ON act.surr = surr.surr AND act.frame = frames.frame)"""
THR95 = f"{EV}, {FRAMES}, {rolled_sql(S_ACTIVITY)}, {THR}, thr AS (SELECT quantile_cont(n, 0.95) AS threshold FROM full_)"
SCE1 = f"""{THR95}, a AS (SELECT frames.frame, count(ev.cell) AS n FROM frames LEFT JOIN ev ON ev.frame = frames.frame GROUP BY 1),
over_ AS (SELECT frame, n FROM a, thr WHERE n >= threshold),
gi AS (SELECT frame, n, frame - row_number() OVER (ORDER BY frame) AS g FROM over_),
sce0 AS (SELECT min(frame) AS start_frame, max(frame) AS end_frame, max(n) AS peak FROM gi GROUP BY g),
sce AS (SELECT CAST(row_number() OVER (ORDER BY start_frame) - 1 AS INTEGER) AS sce_id, start_frame, end_frame, peak FROM sce0)"""


@query(f"WITH {THR95} SELECT threshold FROM thr")
def q_sce_threshold(spark, d):
    s, r, _ = ev(spark, d)
    return sce.detection_threshold(s, r, 1, S_ACTIVITY).select("threshold")


@query(f"WITH {EV}, {FRAMES}, {rolled_sql(S_ACTIVITY)}, {THR}, m AS (SELECT surr, max(n) AS n FROM full_ GROUP BY surr) SELECT quantile_cont(n, 0.95) AS threshold FROM m")
def q_sce_threshold_max(spark, d):
    s, r, _ = ev(spark, d)
    return sce.detection_threshold(s, r, 1, S_ACTIVITY, use_max=True).select("threshold")


@query(f"WITH {EV}, {FRAMES}, {rolled_sql(S_ACTIVITY)}, {THR}, m AS (SELECT surr, min(n) AS n FROM full_ GROUP BY surr) SELECT quantile_cont(n, 0.05) AS threshold FROM m")
def q_low_activity_threshold(spark, d):
    s, r, _ = ev(spark, d)
    return sce.low_activity_threshold(s, r, 1, S_ACTIVITY, use_min=True).select("threshold")


@query(f"WITH {EV}, {rolled_sql(S_EDGES)} SELECT CAST(surr AS INTEGER) AS surr, cell, CAST(frame AS INTEGER) AS frame FROM rolled")
def q_roll_surrogates(spark, d):
    s, r, _ = ev(spark, d)
    return surrogates.rolled(s, r, S_EDGES).select("surr", "cell", "frame")


@query(f"WITH {SCE1} SELECT * FROM sce")
def q_sce_w1(spark, d):
    return _sce1(spark, d)[0].drop("recording_id")


def _sce1(spark, d):
    s, r, c = ev(spark, d)
    return sce.detect(s, r, 1, sce.detection_threshold(s, r, 1, S_ACTIVITY)), s, r, c


@query(f"WITH {SCE1} SELECT DISTINCT sce_id, cell FROM sce JOIN ev ON ev.frame BETWEEN start_frame AND end_frame")
def q_sce_matrix(spark, d):
    e, s, _, _ = _sce1(spark, d)
    return sce.sce_cells(s, e).select("sce_id", "cell")


@query(f"WITH {SCE1} SELECT frames.frame, coalesce(sce_id, -1) AS sce_id FROM frames LEFT JOIN sce ON frames.frame BETWEEN start_frame AND end_frame")
def q_sce_mask(spark, d):
    e, _, r, _ = _sce1(spark, d)
    return sce.sce_mask(e, r).select("frame", "sce_id")


W3 = f"""{EV}, st AS (SELECT CAST(unnest(range({N_FRAMES - 3})) AS INTEGER) AS t), a3 AS (SELECT t, count(DISTINCT cell) AS n FROM st LEFT JOIN ev ON ev.frame >= t AND ev.frame < t + 3 GROUP BY t)"""
W3SCE = f"""{W3}, thr AS (SELECT quantile_cont(n, 0.95) AS threshold FROM a3), o3 AS (SELECT t, n FROM a3, thr WHERE n >= threshold),
g3 AS (SELECT t, n, t - row_number() OVER (ORDER BY t) AS g FROM o3), e3 AS (SELECT min(t) AS start_frame, CAST(max(t) + 2 AS INTEGER) AS end_frame, max(n) AS peak FROM g3 GROUP BY g),
sce AS (SELECT CAST(row_number() OVER (ORDER BY start_frame) - 1 AS INTEGER) AS sce_id, * FROM e3)"""


def _sce3(spark, d):
    s, r, c = ev(spark, d)
    a = raster.window_activity(s, r, 3)
    thr = a.groupBy("recording_id").agg(F.percentile("n", F.lit(0.95)).alias("threshold"))
    return sce.detect(s, r, 3, thr), s, r, c


@query(f"WITH {W3} SELECT t AS frame, n FROM a3")
def q_window_activity(spark, d):
    s, r, _ = ev(spark, d)
    return raster.window_activity(s, r, 3).select("frame", "n")


@query(f"WITH {W3SCE} SELECT * FROM sce")
def q_sce_w3(spark, d):
    return _sce3(spark, d)[0].drop("recording_id")


@query(f"""WITH {W3SCE}, w AS (SELECT sce_id, CAST(unnest(range(start_frame, end_frame - 1)) AS INTEGER) AS t FROM sce),
c AS (SELECT sce_id, t, count(DISTINCT cell) AS n FROM w LEFT JOIN ev ON frame >= t AND frame < t + 3 GROUP BY 1, 2),
p AS (SELECT sce_id, max(n) AS max_cells, round(avg(n), 6) AS mean_cells FROM c GROUP BY 1)
SELECT sce.sce_id, CAST(end_frame - start_frame + 1 AS INTEGER) AS duration, max_cells, mean_cells, (SELECT count(DISTINCT cell) FROM ev WHERE frame BETWEEN start_frame AND end_frame) AS n_cells FROM sce JOIN p USING (sce_id)""")
def q_sce_stats(spark, d):
    e, s, _, _ = _sce3(spark, d)
    return sce.sce_statistics(s, e, 3).select("sce_id", F.col("duration").cast("int").alias("duration"), "max_cells", F.round("mean_cells", 6).alias("mean_cells"), "n_cells")


@query(f"""WITH {W3SCE}, win AS (SELECT sce_id, greatest(0, start_frame - 5) AS lo, least(end_frame + 6, {N_FRAMES - 1}) AS hi FROM sce),
ins AS (SELECT sce_id, cell, frame FROM win JOIN ev ON frame >= lo AND frame < hi), fst AS (SELECT sce_id, cell, min(frame) AS own FROM ins GROUP BY 1, 2),
l AS (SELECT fst.cell, own - ins.frame AS lag FROM fst JOIN ins ON fst.sce_id = ins.sce_id AND fst.cell <> ins.cell), k AS (SELECT cell, lag, count(*) AS n FROM l GROUP BY 1, 2)
SELECT cell, round(sum(lag * n) * 1.0 / sum(n), 6) AS avg_lag, round(max(n) * 1.0 / sum(n), 6) AS correlation FROM k GROUP BY cell""")
def q_time_correlation(spark, d):
    e, s, r, _ = _sce3(spark, d)
    out = raster.time_correlation(s, r, e.withColumnRenamed("sce_id", "event_id"))
    return out.select("cell", F.round("avg_lag", 6).alias("avg_lag"), F.round("correlation", 6).alias("correlation"))


@query("SELECT event_type, event_id, round(100 * cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS rank FROM events")
def q_percentile_rank(spark, d):
    e = S.table(spark, d, "events")
    return raster.percentile_ranks(e, "value", ["event_type"]).select("event_type", "event_id", F.round("rank", 6).alias("rank"))


TRACE = "tr AS (SELECT CAST(user_id AS INTEGER) AS cell, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, value FROM events)"


def _trace(spark, d):
    return S.event_traces(S.table(spark, d, "events"))


@query(f"WITH {TRACE}, m AS (SELECT cell, quantile_cont(value, 0.5) AS m FROM tr GROUP BY cell) SELECT tr.cell, frame, round(CASE WHEN m <> 0 THEN value / m END, 6) AS value FROM tr JOIN m USING (cell)")
def q_median_norm(spark, d):
    return signals.median_normalised(_trace(spark, d)).select("cell", "frame", F.round("value", 6).alias("value"))


@query(f"WITH {TRACE}, m AS (SELECT cell, min(value) AS lo, max(value) AS hi FROM tr GROUP BY cell) SELECT tr.cell, frame, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM tr JOIN m USING (cell)")
def q_min_max_norm(spark, d):
    return signals.min_max(_trace(spark, d)).select("cell", "frame", F.round("value", 6).alias("value"))


@query(f"WITH {TRACE} SELECT cell, frame, round(avg(value) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 6) AS value FROM tr")
def q_moving_mean(spark, d):
    return signals.moving_mean(_trace(spark, d), 10).select("cell", "frame", F.round("value", 6).alias("value"))


TR = "fl AS (SELECT a.cell AS src, a.frame AS sf, b.cell AS dst, min(b.frame - a.frame) AS lag FROM ev a JOIN ev b ON b.frame >= a.frame + 1 AND b.frame < a.frame + 3 AND a.cell <> b.cell GROUP BY 1, 2, 3), tr AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight, avg(lag) AS mean_lag FROM fl GROUP BY 1, 2)"


def to_micros(name: str):
    """A positive number rounded to six places, without the decimals that ``round`` makes: there are as many as pairs."""
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


@query(f"WITH {EV}, {TR} SELECT src, dst, weight, round(mean_lag, 6) AS mean_lag FROM tr")
def q_transitions(spark, d):
    s, r, _ = ev(spark, d)
    return transitions.transitions(s, r, 1, 3).select("src", "dst", "weight", to_micros("mean_lag"))


@query(f"WITH {EV}, {TR}, rt AS (SELECT cell, count(*) * 1.0 / {N_FRAMES} AS rate FROM ev GROUP BY 1) SELECT src, dst, round(weight * (1 - rate), 6) AS weight FROM tr JOIN rt ON rt.cell = dst")
def q_transitions_weighted(spark, d):
    s, r, c = ev(spark, d)
    return transitions.transitions(s, r, 1, 3, rates=raster.spike_rates(s, r, c), lags=False).select("src", "dst", to_micros("weight"))


@query(f"WITH {EV}, {TR} SELECT a.src, a.dst, a.weight - coalesce(b.weight, 0) AS weight FROM tr a LEFT JOIN tr b ON a.src = b.dst AND a.dst = b.src WHERE a.weight > coalesce(b.weight, 0)")
def q_transitions_no_reverse(spark, d):
    s, r, _ = ev(spark, d)
    return transitions.transitions(s, r, 1, 3, no_reverse=True, lags=False).select("src", "dst", "weight")


@query(f"WITH {EV}, {TR}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM tr) SELECT src, dst, weight, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 2")
def q_topk_graph(spark, d):
    s, r, _ = ev(spark, d)
    return transitions.top_transitions(s, r, 1, 3, 2).select("src", "dst", "weight", "rank")


@query(f"WITH {EV}, {TR}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM tr) SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, weight FROM k WHERE rank <= 2")
def q_graph_files(spark, d):
    """The follower graph, written as GraphML by the executors and read back."""
    s, r, _ = ev(spark, d)
    edges = transitions.top_transitions(s, r, 1, 3, 2)
    path = shared_place(spark, "graph")
    graphs.write_graph(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight"), path)
    return graphs.read_graph(spark, path)


@query(f"""WITH {EV}, {TR}, {rolled_sql(S_EDGES)},
sf AS (SELECT a.surr, a.cell AS src, a.frame AS f, b.cell AS dst FROM rolled a JOIN rolled b ON a.surr = b.surr AND b.frame >= a.frame + 1 AND b.frame < a.frame + 3 AND a.cell <> b.cell GROUP BY ALL),
sw AS (SELECT surr, src, dst, count(*) AS w FROM sf GROUP BY ALL), al AS (SELECT tr.src, tr.dst, tr.weight, coalesce(sw.w, 0) AS w FROM tr CROSS JOIN surr LEFT JOIN sw ON sw.surr = surr.surr AND sw.src = tr.src AND sw.dst = tr.dst)
SELECT src, dst, weight, round(quantile_cont(w, 0.95), 6) AS cut FROM al GROUP BY src, dst, weight HAVING weight > quantile_cont(w, 0.95)""")
def q_edge_filter(spark, d):
    s, r, _ = ev(spark, d)
    return transitions.significant_transitions(s, r, 1, 3, S_EDGES).select("src", "dst", "weight", F.round("cut", 6).alias("cut"))


@query(f"WITH {EV}, {TR}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM tr) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def q_graph_degrees(spark, d):
    s, r, _ = ev(spark, d)
    return transitions.transition_degrees(s, r, 1, 3).select("node", "degree")


COV = f"""{SCE1}, {CELLS}, m AS (SELECT DISTINCT sce_id, cell FROM sce JOIN ev ON ev.frame BETWEEN start_frame AND end_frame), n AS (SELECT sce_id, count(*) AS n FROM m GROUP BY 1),
nn AS (SELECT count(*) AS n_cells FROM cells), ns AS (SELECT count(*) AS n_sce FROM n), b AS (SELECT x.sce_id AS a, y.sce_id AS b, count(*) AS n_both FROM m x JOIN m y ON x.cell = y.cell AND x.sce_id < y.sce_id GROUP BY 1, 2)"""


@query(f"""WITH {COV}, v AS (SELECT a, b, n_both, p.n * 1.0 AS na, q.n * 1.0 AS nb, n_cells * 1.0 AS c, n_sce FROM b JOIN n p ON p.sce_id = a JOIN n q ON q.sce_id = b, nn, ns)
SELECT a, b, n_both, round(CASE WHEN na < c AND nb < c THEN (n_both - na * nb / c) / (sqrt(na / c * (1 - na / c)) * sqrt(nb / c * (1 - nb / c)) * n_sce) ELSE 0 END, 6) AS similarity FROM v""")
def q_covnorm(spark, d):
    e, s, r, _ = _sce1(spark, d)
    return assemblies.event_similarity(sce.sce_cells(s, e), r).select("a", "b", "n_both", F.round("similarity", 6).alias("similarity"))


LBL = "lb AS (SELECT sce_id, sce_id % 4 AS label FROM sce)"


@query(f"""WITH {COV}, {LBL}, z AS (SELECT label, count(*) AS size FROM lb GROUP BY 1), k AS (SELECT cell, label, count(*) AS n FROM m JOIN lb USING (sce_id) GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT cell, label, row_number() OVER (PARTITION BY cell ORDER BY n * 1.0 / size DESC, n DESC, label) AS r FROM k JOIN z USING (label))
SELECT cells.cell, coalesce(label, -1) AS cluster FROM cells LEFT JOIN (SELECT * FROM t WHERE r = 1) t USING (cell)""")
def q_cluster_labels(spark, d):
    e, s, _, c = _sce1(spark, d)
    labels = e.select("recording_id", "sce_id", (F.col("sce_id") % 4).alias("label"))
    return assemblies.cluster_cells(sce.sce_cells(s, e), labels, c).select("cell", "cluster")


@query(f"""WITH {EV}, c AS (SELECT DISTINCT cell, cell % 30 AS cluster FROM ev), z AS (SELECT cluster, count(*) AS size FROM c GROUP BY 1), st AS (SELECT CAST(unnest(range({N_FRAMES - 12})) AS INTEGER) AS t),
a AS (SELECT cluster, t, count(DISTINCT ev.cell) AS n FROM ev JOIN c USING (cell) JOIN st ON frame >= t AND frame < t + 12 GROUP BY 1, 2),
o AS (SELECT cluster, t, t - row_number() OVER (PARTITION BY cluster ORDER BY t) AS g FROM a JOIN z USING (cluster) WHERE n >= 0.5 * size)
SELECT cluster, min(t) AS start_frame, CAST(max(t) + 11 AS INTEGER) AS end_frame FROM o GROUP BY cluster, g""")
def q_cluster_activations(spark, d):
    s, r, c = ev(spark, d)
    return assemblies.activations(s, r, c.withColumn("cluster", F.col("cell") % 30), 12).select("cluster", "start_frame", "end_frame")


#: Activations of clusters of cells, 30 clusters and windows of 12 frames.
ACT = f"act AS ({ORACLES['cluster_activations']})"
SEGMENTS = """ch AS (SELECT frame, n, CASE WHEN n IS DISTINCT FROM lag(n) OVER (ORDER BY frame) THEN 1 ELSE 0 END AS c FROM f),
sg AS (SELECT frame, n, sum(c) OVER (ORDER BY frame) AS g FROM ch), nc AS (SELECT count(DISTINCT CAST(user_id AS INTEGER) % 30) AS n_items FROM events)"""


def _activations(spark, d):
    """Activations of 30 clusters of cells, and how many clusters there are."""
    s, r, c = ev(spark, d)
    clusters = c.withColumn("cluster", F.col("cell") % 30)
    return assemblies.activations(s, r, clusters, 12), r, clusters.groupBy("recording_id").agg(F.count_distinct("cluster").alias("n_items"))


@query(f"""WITH {ACT}, {FRAMES}, f AS (SELECT frame, count(DISTINCT cluster) AS n FROM frames LEFT JOIN act ON frame BETWEEN start_frame AND end_frame GROUP BY frame), {SEGMENTS}
SELECT min(frame) AS start_frame, max(frame) AS end_frame, n, round(n * 100.0 / n_items, 6) AS percent FROM sg, nc GROUP BY g, n, n_items""")
def q_active_clusters(spark, d):
    a, r, n = _activations(spark, d)
    return sweeps.open_share(a, r, n).select("start_frame", "end_frame", "n", F.round("percent", 6).alias("percent"))


@query(f"""WITH {ACT}, {FRAMES}, f AS (SELECT frame, count(DISTINCT cluster) AS n FROM frames LEFT JOIN act ON start_frame < frame + 24 AND end_frame >= frame WHERE frame < {N_FRAMES - 24} GROUP BY frame), {SEGMENTS},
e AS (SELECT min(frame) AS start_frame, max(frame) AS end_frame, n FROM sg GROUP BY g, n)
SELECT start_frame, CASE WHEN end_frame = {N_FRAMES - 25} THEN {N_FRAMES - 1} ELSE end_frame END AS end_frame, n, round(n * 100.0 / n_items, 6) AS percent FROM e, nc""")
def q_active_clusters_windowed(spark, d):
    a, r, n = _activations(spark, d)
    return sweeps.open_share(a, r, n, window=24).select("start_frame", "end_frame", "n", F.round("percent", 6).alias("percent"))


PATTERNS = f"""{SCE1}, m AS (SELECT DISTINCT sce_id, cell FROM sce JOIN ev ON ev.frame BETWEEN start_frame AND end_frame),
pa AS (SELECT sce_id, cell % 6 AS cluster FROM m GROUP BY ALL HAVING count(DISTINCT cell) * 6 >= (SELECT count(DISTINCT cell) FROM ev) * 0.15),
pt AS (SELECT sce_id, string_agg(CAST(cluster AS VARCHAR), ',' ORDER BY cluster) AS pattern FROM pa GROUP BY sce_id),
fq AS (SELECT coalesce(pattern, '') AS pattern, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM sce) AS percent FROM sce LEFT JOIN pt USING (sce_id) GROUP BY 1)"""


def _patterns(spark, d):
    """Patterns of six clusters of cells over the events; a cluster takes part with 15 % of a sixth of the cells or more."""
    e, s, _, c = _sce1(spark, d)
    least = c.groupBy("recording_id").agg((F.count("*") * 0.15 / 6).alias("least"))
    n = sce.sce_cells(s, e).withColumn("cluster", F.col("cell") % 6).groupBy("recording_id", "sce_id", "cluster").agg(F.count_distinct("cell").alias("n"))
    return distributions.pattern_frequency(n.join(least, "recording_id").where("n >= least"), e)


@query(f"WITH {PATTERNS} SELECT pattern, CAST(CASE WHEN pattern = '' THEN 0 ELSE len(string_split(pattern, ',')) END AS INTEGER) AS n_clusters, n, round(percent, 6) AS percent FROM fq")
def q_pattern_frequency(spark, d):
    return _patterns(spark, d).select(F.array_join(F.col("pattern").cast("array<string>"), ",").alias("pattern"), "n_clusters", "n", F.round("percent", 6).alias("percent"))


@query(f"""WITH {PATTERNS}, g AS (SELECT count(*) AS total, min(percent) AS lo, max(percent) AS hi FROM fq), e AS (SELECT total, hi, CAST(unnest(range(10)) AS INTEGER) AS bin, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS l, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS h FROM g),
b AS (SELECT bin, total, l + bin * ((h - l) / 10) AS a, CASE WHEN bin = 9 THEN h ELSE l + (bin + 1) * ((h - l) / 10) END AS z FROM e)
SELECT bin, round(a, 6) AS left_edge, round(z, 6) AS right_edge, count(percent) AS n, round(count(percent) * 100.0 / total, 6) AS percent FROM b LEFT JOIN fq ON percent >= a AND (percent < z OR (bin = 9 AND percent <= z)) GROUP BY bin, a, z, total""")
def q_pattern_histogram(spark, d):
    out = distributions.histogram(_patterns(spark, d), "percent", bins=10)
    return out.select("bin", F.round("left_edge", 6).alias("left_edge"), F.round("right_edge", 6).alias("right_edge"), "n", F.round("percent", 6).alias("percent"))


#: A functional clustering compares all pairs of one group of cells: the nations of one region are a group.
GROUPED = "tg AS (SELECT CAST(n_regionkey AS INTEGER) AS g, CAST(s_nationkey AS INTEGER) AS cell, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"


@query(f"""WITH {GROUPED}, h AS (SELECT a.g, a.cell AS x, b.cell AS y, a.frame, min(abs(a.frame - b.frame)) AS m FROM tg a JOIN tg b ON a.g = b.g AND a.cell <> b.cell GROUP BY ALL)
SELECT least(x, y) AS i, greatest(x, y) AS j, CAST(sum(m) AS DOUBLE) / 2 AS d FROM h GROUP BY 1, 2""")
def q_fca_distance(spark, d):
    return trains.train_distances(_nation_trains(spark, d)).select("i", "j", "d")


def _nation_trains(spark, d):
    """Ship days of each nation's suppliers; the regions are recordings."""
    line, sup, nat = (S.table(spark, d, x) for x in ("lineitem", "supplier", "nation"))
    t = line.join(sup, line["l_suppkey"] == sup["s_suppkey"]).join(nat, sup["s_nationkey"] == nat["n_nationkey"])
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return t.select(F.col("n_regionkey").cast("string").alias("recording_id"), F.col("s_nationkey").cast("int").alias("cell"), day.cast("double").alias("t")).distinct()


@query(f"""WITH {GROUPED}, u AS (SELECT unnest(range(10)) AS surr), ts AS (SELECT surr, g, cell, (frame + (surr * 7919 + CAST(cell AS BIGINT) * 104729 + surr * cell * 31 + CAST(cell AS BIGINT) * cell * 17) % {N_DAYS - 1} + 1) % {N_DAYS} AS frame FROM tg, u),
h AS (SELECT a.g, a.cell AS x, b.cell AS y, a.frame, min(abs(a.frame - b.frame)) AS m FROM tg a JOIN tg b ON a.g = b.g AND a.cell <> b.cell GROUP BY ALL), dr AS (SELECT least(x, y) AS i, greatest(x, y) AS j, sum(m) / 2 AS d FROM h GROUP BY 1, 2),
hs AS (SELECT a.surr, a.g, a.cell AS x, b.cell AS y, a.frame, min(abs(a.frame - b.frame)) AS m FROM ts a JOIN ts b ON a.surr = b.surr AND a.g = b.g AND a.cell <> b.cell GROUP BY ALL), ds AS (SELECT surr, least(x, y) AS i, greatest(x, y) AS j, sum(m) / 2 AS d FROM hs GROUP BY 1, 2, 3)
SELECT dr.i, dr.j, CAST(dr.d AS DOUBLE) AS d, round(greatest(0, (5 - count(*) FILTER (WHERE ds.d < dr.d)) / 4.5), 6) AS scaled FROM dr JOIN ds ON ds.i = dr.i AND ds.j = dr.j GROUP BY dr.i, dr.j, dr.d""")
def q_fca_scaled(spark, d):
    t = _nation_trains(spark, d)
    s = t.select("recording_id", "cell", F.col("t").cast("int").alias("frame"))
    r = t.select("recording_id").distinct().withColumn("n_frames", F.lit(N_DAYS))
    u = surrogates.rolled(s, r, 10).select("recording_id", "surr", "cell", F.col("frame").cast("double").alias("t"))
    out = trains.scaled_significance(trains.train_distances(t), trains.train_distances(u, ["surr"]), 10)
    return out.select("i", "j", "d", F.round("scaled", 6).alias("scaled"))


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1),
u AS (SELECT v.vec_id, label, i, x / norm AS x FROM v JOIN n USING (vec_id)), s AS (SELECT label AS c, i, sum(x) AS s FROM u GROUP BY 1, 2), z AS (SELECT label AS c, count(*) AS m FROM embeddings GROUP BY 1),
d AS (SELECT vec_id, label, u2.c, sum(x * s) AS d FROM u JOIN s u2 ON u.i = u2.i GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, label, max(CASE WHEN d.c = label AND m > 1 THEN (m - d) / (m - 1) END) AS a, min(CASE WHEN d.c <> label THEN 1 - d / m END) AS b FROM d JOIN z ON z.c = d.c GROUP BY 1, 2)
SELECT vec_id, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab""")
def q_silhouette_cosine(spark, d):
    e = S.table(spark, d, "embeddings")
    return assemblies.cosine_silhouette(e, "embedding", "label", "vec_id").select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


@query("""WITH a AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings), b AS (SELECT vec_id, embedding[3]::DOUBLE * 100 AS x, embedding[4]::DOUBLE * 100 AS y FROM embeddings),
d AS (SELECT a.vec_id AS cell, b.vec_id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM a JOIN b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2),
k AS (SELECT cell, other, row_number() OVER (PARTITION BY cell ORDER BY d, other) AS r FROM d WHERE d <= 2) SELECT a.vec_id AS cell, coalesce(other, -1) AS matched FROM a LEFT JOIN (SELECT * FROM k WHERE r = 1) k ON k.cell = a.vec_id""")
def q_nearest_cells(spark, d):
    """Two plane projections of the vectors as the cell centres of two sessions."""
    e = S.table(spark, d, "embeddings")
    at = lambda i, j: e.select(F.col("vec_id").alias("cell"), (F.col("embedding")[i].cast("double") * 100).alias("cx"), (F.col("embedding")[j].cast("double") * 100).alias("cy"))
    return spatial.match_cells(at(0, 1), at(2, 3), 2.0)


POWER = "pw AS (SELECT event_type, CAST(date_part('hour', ts) AS INTEGER) + 1 AS freq, CAST(floor((epoch(ts) - 1704067200) / 86400) AS INTEGER) AS t, avg(value) AS power FROM events WHERE value > 0 GROUP BY ALL)"


def _power(spark, d):
    """Mean value per (type, hour of day, day): a small spectrogram by segment."""
    e = S.table(spark, d, "events").where("value > 0")
    sec = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.groupBy(F.col("event_type").alias("segment"), (F.floor(sec / 3600) % 24 + 1).cast("int").alias("freq"), F.floor(sec / 86400).cast("int").alias("t")).agg(F.avg("value").alias("power"))


@query(f"WITH {POWER}, m AS (SELECT event_type, freq, avg(log10(power)) AS y FROM pw GROUP BY ALL), f AS (SELECT event_type, regr_slope(y, log10(freq)) AS a, regr_intercept(y, log10(freq)) AS b FROM m GROUP BY 1) SELECT m.event_type AS segment, freq, round(10 ** (a * log10(freq) + b), 6) AS mean_power FROM m JOIN f USING (event_type)")
def q_bosc_fit(spark, d):
    return spectral.background_fit(_power(spark, d)).select("segment", "freq", F.round("mean_power", 6).alias("mean_power"))


@query(f"WITH {POWER}, m AS (SELECT event_type, freq, avg(log10(power)) AS y FROM pw GROUP BY ALL), f AS (SELECT event_type, regr_slope(y, log10(freq)) AS a, regr_intercept(y, log10(freq)) AS b FROM m GROUP BY 1) SELECT m.event_type AS segment, freq, round(-ln(1 - 0.6) * 10 ** (a * log10(freq) + b), 6) AS power_threshold, round(3.0 * 10 / freq, 6) AS duration_threshold FROM m JOIN f USING (event_type)")
def q_bosc_threshold(spark, d):
    t = spectral.thresholds(spectral.background_fit(_power(spark, d)), 10.0, 0.6, 3.0)
    return t.select("segment", "freq", F.round("power_threshold", 6).alias("power_threshold"), F.round("duration_threshold", 6).alias("duration_threshold"))


@query(f"""WITH {POWER}, m AS (SELECT event_type, freq, avg(log10(power)) AS y FROM pw GROUP BY ALL), f AS (SELECT event_type, regr_slope(y, log10(freq)) AS a, regr_intercept(y, log10(freq)) AS b FROM m GROUP BY 1),
o AS (SELECT pw.event_type, pw.freq, t FROM pw JOIN f USING (event_type) WHERE power > -ln(1 - 0.4) * 10 ** (a * log10(freq) + b)), g AS (SELECT *, t - row_number() OVER (PARTITION BY event_type, freq ORDER BY t) AS g FROM o)
SELECT event_type AS segment, freq, min(t) AS start_t, CAST(max(t) + 1 AS INTEGER) AS end_t FROM g GROUP BY event_type, freq, g HAVING max(t) + 1 - min(t) >= 30.0 / freq""")
def q_bosc_episodes(spark, d):
    p = _power(spark, d)
    return spectral.episodes(p, spectral.thresholds(spectral.background_fit(p), 10.0, 0.4, 3.0)).select("segment", "freq", "start_t", "end_t")




@query(ORACLES["sce_threshold"])
def q_run_raster_threshold(spark, d):
    s, r, _ = ev(spark, d)
    frames = raster.runs(s).select("recording_id", "cell", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return sce.run_raster_threshold(frames, r, S_ACTIVITY).select("threshold")


QUERIES |= kernels_catalogue.QUERIES | signal_catalogue.QUERIES | shape_catalogue.QUERIES
ORACLES |= signal_catalogue.ORACLES | shape_catalogue.ORACLES
