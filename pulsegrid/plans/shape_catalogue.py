"""Queries of distributions, sweep lines and movies, and their SQL, written from the rules and not from the operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import tables as functions
from pulsegrid.operators import assemblies, distributions, movies, raster, sce, signals, spatial, spectral, surrogates
from pulsegrid.plans.kernels_catalogue import N_DAYS, RATE, WAVES, _signal
from pulsegrid.plans.signal_catalogue import BUSY, SERIES, busy_days, drawn, nation_lines, rounded
from pulsegrid.plans.signal_catalogue import WAVES as WAVES_SQL
from pulsegrid.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def all_rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = rounded(df, n)
    return df


HIST = """g0 AS (SELECT event_type, count(value) AS total, min(value) AS lo0, max(value) AS hi0 FROM events WHERE value IS NOT NULL GROUP BY 1),
g AS (SELECT event_type, total, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi, CASE WHEN hi0 > 1 THEN CAST(floor(hi0) AS INTEGER) ELSE 1 END AS bins FROM g0),
e0 AS (SELECT *, unnest(range(bins)) AS i FROM g),
e AS (SELECT event_type, total, bins, CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / bins) AS left_edge, CASE WHEN i + 1 = bins THEN hi ELSE lo + (i + 1) * ((hi - lo) / bins) END AS right_edge FROM e0),
h AS (SELECT e.event_type, e.bin, any_value(left_edge) AS left_edge, any_value(right_edge) AS right_edge, any_value(total) AS total, count(value) AS n
  FROM e LEFT JOIN events v ON v.event_type = e.event_type AND value >= left_edge AND (value < right_edge OR (e.bin = bins - 1 AND value <= right_edge)) GROUP BY 1, 2)"""


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return distributions.histogram(S.table(spark, d, "events"), "value", ["event_type"], factor=1)


@query(f"WITH {HIST} SELECT event_type, bin, round(left_edge, 6) AS left_edge, round(right_edge, 6) AS right_edge, n, round(n * 100.0 / total, 6) AS percent FROM h")
def value_histogram(spark, d):
    return all_rounded(_bins(spark, d), "left_edge", "right_edge", "percent")


@query(f"""WITH {HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS after FROM h), q AS (SELECT *, after - n AS before, total * 30 / 100.0 AS want FROM r)
SELECT event_type, CAST(count(*) FILTER (WHERE after < want) AS INTEGER) AS full_bins, max(bin) FILTER (WHERE before < want AND after > want) AS cut_bin,
  round(coalesce(max(left_edge + (right_edge - left_edge) * (want - before) / n) FILTER (WHERE before < want AND after > want), min(right_edge) FILTER (WHERE after >= want)), 6) AS cut_value FROM q GROUP BY event_type""")
def share_cut(spark, d):
    return rounded(distributions.share_cut(_bins(spark, d), 30, ["event_type"]), "cut_value")


@query(f"""WITH {HIST}, m AS (SELECT event_type, avg(value) AS mark FROM events GROUP BY 1 UNION ALL SELECT event_type, max(value) FROM events GROUP BY 1)
SELECT e.event_type, e.bin, count(*) AS n_marks FROM e JOIN m ON m.event_type = e.event_type AND mark >= left_edge AND (mark < right_edge OR (e.bin = bins - 1 AND mark <= right_edge)) GROUP BY 1, 2""")
def marked_bins(spark, d):
    """The bins that hold each type's mean and largest value."""
    e = S.table(spark, d, "events")
    marks = e.groupBy("event_type").agg(F.avg("value").alias("mark")).union(e.groupBy("event_type").agg(F.max("value").alias("mark")))
    return distributions.histogram(e, "value", ["event_type"], factor=1, marks=marks).where("n_marks > 0").select("event_type", "bin", "n_marks")


BOX = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1),
b AS (SELECT q.event_type, any_value(q.n) AS n, any_value(mean) AS mean, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
  least(any_value(q1), coalesce(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), any_value(q1))) AS whisker_low,
  greatest(any_value(q3), coalesce(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), any_value(q3))) AS whisker_high FROM q JOIN events USING (event_type) GROUP BY 1)"""


@query(f"WITH {BOX} SELECT event_type, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high FROM b")
def value_boxes(spark, d):
    return all_rounded(distributions.boxes(S.table(spark, d, "events"), "value", ["event_type"]), "mean", "q1", "median", "q3", "whisker_low", "whisker_high")


@query(f"WITH {BOX} SELECT event_type, event_id, value FROM events JOIN b USING (event_type) WHERE value < whisker_low OR value > whisker_high")
def value_outliers(spark, d):
    return distributions.outliers(S.table(spark, d, "events"), "value", ["event_type"]).select("event_type", "event_id", "value")


# movies: a frame a day, a pixel by quantity against discount and tax, bright by price

WIDTH, HEIGHT, AROUND = 52, 180, 2
MOVIE = """mv AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame, CAST(l_quantity AS INTEGER) AS x, CAST(round(l_discount * 100) + 20 * floor(l_tax * 100) AS INTEGER) AS y, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"""
BOXES = f"""pt AS (SELECT CAST(s_nationkey AS INTEGER) AS cell, s_suppkey * 11 % 40 AS x, s_suppkey * 17 % 150 AS y FROM supplier WHERE s_suppkey % 4 = s_nationkey % 4),
bx AS (SELECT cell, greatest(0, min(x) - {AROUND}) AS min_x, greatest(0, min(y) - {AROUND}) AS min_y, least({WIDTH - 1}, max(x) + {AROUND}) AS max_x, least({HEIGHT - 1}, max(y) + {AROUND}) AS max_y FROM pt GROUP BY cell)"""
SPANS = f"""{BUSY}, isl AS (SELECT cell, frame, frame - row_number() OVER (PARTITION BY cell ORDER BY frame) AS g FROM busy), sp AS (SELECT cell, min(frame) AS transient, min(frame) AS start_frame, max(frame) AS end_frame FROM isl GROUP BY cell, g)"""
WEIGHTS = "w AS (SELECT cell, frame, value + (SELECT abs(min(value)) FROM nl) AS w FROM nl)"


def movie(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    y = F.round(F.col("l_discount") * 100) + 20 * F.floor(F.col("l_tax") * 100)
    return S.table(spark, d, "lineitem").groupBy(day.cast("int").alias("frame"), F.col("l_quantity").cast("int").alias("x"), y.cast("int").alias("y")).agg(F.sum("l_extendedprice").alias("v"))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Contours of nations: some of their suppliers as points of the movie's frame."""
    s = S.table(spark, d, "supplier").where("s_suppkey % 4 = s_nationkey % 4")
    return s.groupBy(F.col("s_nationkey").cast("int").alias("cell")).agg(F.collect_list(F.struct((F.col("s_suppkey") * 11 % 40).alias("x"), (F.col("s_suppkey") * 17 % 150).alias("y"))).alias("contour"))


def cell_boxes(spark: SparkSession, d: str) -> DataFrame:
    return movies.boxes(shapes(spark, d), WIDTH, HEIGHT, AROUND)


def busy_spans(spark: SparkSession, d: str) -> DataFrame:
    r = raster.runs(busy_days(spark, d)[0])
    return r.select("cell", F.col("start_frame").alias("transient"), "start_frame", "end_frame")


@query(f"WITH {BOXES} SELECT pt.cell, CAST(x - min_x AS INTEGER) AS x, CAST(y - min_y AS INTEGER) AS y FROM pt JOIN bx USING (cell)")
def contour_in_box(spark, d):
    points = shapes(spark, d).select("cell", F.explode("contour").alias("p")).select("cell", "p.x", "p.y")
    return movies.shifted_points(points, cell_boxes(spark, d))


@query(f"WITH {MOVIE}, {BOXES}, {SPANS} SELECT sp.cell, transient, mv.frame, CAST(x - min_x AS INTEGER) AS x, CAST(y - min_y AS INTEGER) AS y, round(v, 4) AS v FROM sp JOIN bx USING (cell) JOIN mv ON mv.frame BETWEEN start_frame AND end_frame AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y")
def movie_cut(spark, d):
    out = movies.cut_out(movie(spark, d), cell_boxes(spark, d), busy_spans(spark, d))
    return out.withColumn("v", F.round("v", 4))


MOVIE_PROFILES = f"""{MOVIE}, {BOXES}, {SPANS}, {WEIGHTS},
tot AS (SELECT sp.cell, transient, sum(w) AS total FROM sp JOIN w ON w.cell = sp.cell AND w.frame BETWEEN start_frame AND end_frame GROUP BY ALL),
pf AS (SELECT sp.cell, transient, CAST(x - min_x AS INTEGER) AS x, CAST(y - min_y AS INTEGER) AS y, sum(v * w) / any_value(total) AS v FROM sp JOIN tot USING (cell, transient) JOIN bx USING (cell)
  JOIN mv ON mv.frame BETWEEN start_frame AND end_frame AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y JOIN w ON w.cell = sp.cell AND w.frame = mv.frame GROUP BY ALL)"""


@query(f"WITH {MOVIE_PROFILES} SELECT cell, transient, x, y, round(v, 3) AS v FROM pf")
def movie_profiles(spark, d):
    out = movies.span_profiles(movie(spark, d), cell_boxes(spark, d), nation_lines(spark, d), busy_spans(spark, d))
    return out.withColumn("v", F.round("v", 3))


#: The reference rule for the peaks of a source: over the 95th percentile, then no more than about ten and no fewer than about five.
SOURCES = f"""{MOVIE}, {BOXES}, {SPANS}, {WEIGHTS},
pk AS (SELECT busy.cell, busy.frame, value FROM busy JOIN nl ON nl.cell = busy.cell AND nl.frame = busy.frame),
k AS (SELECT cell, count(*) AS n, list(value ORDER BY value) AS vs, quantile_cont(value, 0.95) AS t FROM pk GROUP BY cell),
k2 AS (SELECT k.cell, any_value(n) AS n, any_value(vs) AS vs, count(*) FILTER (WHERE value > t) AS m FROM k JOIN pk USING (cell) GROUP BY k.cell),
k3 AS (SELECT cell, n, vs, (n - 1) * CASE WHEN m > 10 THEN 1 - 10 / n WHEN m < 5 AND n > 5 THEN 1 - 5 / n ELSE 0.95 END AS h FROM k2),
k4 AS (SELECT cell, vs[CAST(floor(h) AS BIGINT) + 1] + (vs[CAST(ceil(h) AS BIGINT) + 1] - vs[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)) AS t FROM k3),
ch AS (SELECT pk.cell, pk.frame FROM pk JOIN k4 USING (cell) WHERE value > t), nch AS (SELECT cell, count(*) AS n FROM ch GROUP BY cell),
ri AS (SELECT ch.cell, ch.frame AS transient, max(sp.start_frame) AS start_frame, ch.frame AS end_frame FROM ch JOIN sp ON sp.cell = ch.cell AND sp.start_frame <= ch.frame GROUP BY ALL),
tot AS (SELECT ri.cell, transient, sum(w) AS total FROM ri JOIN w ON w.cell = ri.cell AND w.frame BETWEEN start_frame AND end_frame GROUP BY ALL),
pf AS (SELECT ri.cell, transient, CAST(x - min_x AS INTEGER) AS x, CAST(y - min_y AS INTEGER) AS y, sum(v * w) / any_value(total) AS v FROM ri JOIN tot USING (cell, transient) JOIN bx USING (cell)
  JOIN mv ON mv.frame BETWEEN start_frame AND end_frame AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y JOIN w ON w.cell = ri.cell AND w.frame = mv.frame GROUP BY ALL),
so AS (SELECT cell, x, y, sum(v) / any_value(n) AS v FROM pf JOIN nch USING (cell) GROUP BY ALL)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    busy, lines = busy_days(spark, d)[0].select("cell", "frame"), nation_lines(spark, d)
    onsets = busy_spans(spark, d).select("cell", F.col("start_frame").alias("frame"))
    return movies.movie_sources(movie(spark, d), cell_boxes(spark, d), lines, busy, onsets)


@query(f"WITH {SOURCES} SELECT cell, x, y, round(v, 3) AS v FROM so")
def movie_sources(spark, d):
    return _sources(spark, d).withColumn("v", F.round("v", 3))


@query(f"""WITH {SOURCES}, pr AS (SELECT sp.cell, transient, CAST(x - min_x AS INTEGER) AS x, CAST(y - min_y AS INTEGER) AS y, sum(v * w) / any_value(total) AS v
  FROM sp JOIN (SELECT sp.cell, sp.transient, sum(w) AS total FROM sp JOIN w ON w.cell = sp.cell AND w.frame BETWEEN start_frame AND end_frame GROUP BY ALL) t USING (cell, transient) JOIN bx USING (cell)
  JOIN mv ON mv.frame BETWEEN start_frame AND end_frame AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y JOIN w ON w.cell = sp.cell AND w.frame = mv.frame GROUP BY ALL),
px AS (SELECT cell, transient, CAST(unnest(range(max_x - min_x + 1)) AS INTEGER) AS x, max_y - min_y AS top FROM bx JOIN (SELECT DISTINCT cell, transient FROM pr) USING (cell)),
pxy AS (SELECT cell, transient, x, CAST(unnest(range(top + 1)) AS INTEGER) AS y FROM px)
SELECT pxy.cell, pxy.transient, round(corr(coalesce(pr.v, 0), coalesce(so.v, 0)), 4) AS r FROM pxy LEFT JOIN pr ON pr.cell = pxy.cell AND pr.transient = pxy.transient AND pr.x = pxy.x AND pr.y = pxy.y
  LEFT JOIN so ON so.cell = pxy.cell AND so.x = pxy.x AND so.y = pxy.y WHERE pxy.cell IN (SELECT cell FROM so) GROUP BY ALL""")
def movie_correlations(spark, d):
    """Every transient's picture against the cell's source, over the whole box."""
    box = cell_boxes(spark, d)
    prof = movies.boxed(movies.span_profiles(movie(spark, d), box, nation_lines(spark, d), busy_spans(spark, d)), box, ["cell", "transient"])
    source = movies.boxed(_sources(spark, d), box, ["cell"])
    out = spatial.profile_correlation(prof, source, source.select("cell", "x", "y"))
    return out.withColumn("r", F.round("r", 4))


# scores of trials: labellings of the vectors, three trials for each of three numbers of clusters

TRIALS = """t AS (SELECT vec_id, k, trial, CAST((label + trial * (vec_id % 3)) % k AS INTEGER) AS label, embedding FROM embeddings, (SELECT unnest([2, 3, 5]) AS k), (SELECT unnest(range(3)) AS trial)),
v AS (SELECT k, trial, vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM t), n AS (SELECT k, trial, vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
u AS (SELECT v.k, v.trial, v.vec_id, label, i, x / norm AS x FROM v JOIN n USING (k, trial, vec_id)), s AS (SELECT k, trial, label AS c, i, sum(x) AS s FROM u GROUP BY ALL), z AS (SELECT k, trial, label AS c, count(*) AS m FROM t GROUP BY ALL),
d AS (SELECT u.k, u.trial, vec_id, label, s.c, sum(x * s.s) AS d FROM u JOIN s ON u.k = s.k AND u.trial = s.trial AND u.i = s.i GROUP BY ALL),
ab AS (SELECT d.k, d.trial, vec_id, label, max(CASE WHEN d.c = label AND m > 1 THEN (m - d) / (m - 1) END) AS a, min(CASE WHEN d.c <> label THEN 1 - d / m END) AS b FROM d JOIN z ON z.k = d.k AND z.trial = d.trial AND z.c = d.c GROUP BY ALL),
cs AS (SELECT k, trial, label, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY ALL)"""
BEST_TRIAL = "SELECT CAST(k AS INTEGER) AS k, CAST(trial AS INTEGER) AS trial, round(score, 6) AS score FROM (SELECT k, trial, {}(silhouette) AS score FROM cs GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, trial) = 1"


def _silhouettes(spark: SparkSession, d: str) -> DataFrame:
    """(k, trial, cluster, silhouette) of all labellings."""
    e = S.table(spark, d, "embeddings").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (2, 3, 5)]))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(2))))
    e = e.withColumn("label", ((F.col("label") + F.col("trial") * (F.col("vec_id") % 3)) % F.col("k")).cast("int"))
    each = assemblies.cosine_silhouette(e, "embedding", "label", "vec_id", ["k", "trial"])
    return each.groupBy("k", "trial", F.col("label").alias("cluster")).agg(F.avg("silhouette").alias("silhouette"))


@query(f"WITH {TRIALS} {BEST_TRIAL.format('avg')}")
def best_trials_mean(spark, d):
    return rounded(assemblies.best_trials(_silhouettes(spark, d), ["k"], "mean"), "score")


@query(f"WITH {TRIALS} {BEST_TRIAL.format('median')}")
def best_trials_median(spark, d):
    """The score as a user's own aggregate."""

    @F.pandas_udf("double")
    def middle(v: pd.Series) -> float:
        return float(v.median())

    return rounded(assemblies.best_trials(_silhouettes(spark, d), ["k"], middle), "score")


# functions of SQL, joined laterally

#: A quadrilateral for each supplier.
CORNERS = """qd AS (SELECT s_suppkey AS cell, [s_suppkey % 7, 20 + s_suppkey % 11, 25 + s_suppkey % 6, 4 + s_suppkey % 3] AS xs, [s_suppkey % 5, 3 + s_suppkey % 4, 20 + s_suppkey % 9, 15 + s_suppkey % 8] AS ys FROM supplier)"""


def _corners(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    put = lambda *a: F.array(*[F.lit(x) + k % y for x, y in a]).cast("array<double>")
    return S.table(spark, d, "supplier").select(k.cast("long").alias("cell"), put((0, 7), (20, 11), (25, 6), (4, 3)).alias("xs"), put((0, 5), (3, 4), (20, 9), (15, 8)).alias("ys"))


@query(f"""WITH {CORNERS}, ed AS (SELECT cell, xs[i] AS x1, ys[i] AS y1, xs[i % 4 + 1] AS x2, ys[i % 4 + 1] AS y2 FROM qd, (SELECT unnest(range(1, 5)) AS i)),
px AS (SELECT cell, x, y FROM qd, (SELECT unnest(range(0, 33)) AS x), (SELECT unnest(range(0, 33)) AS y)),
cr AS (SELECT px.cell, x, y,
  bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge,
  count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) AS crossings FROM px JOIN ed USING (cell) GROUP BY ALL)
SELECT cell, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM cr WHERE edge OR crossings % 2 = 1""")
def filled_masks(spark, d):
    functions.register(spark)
    return spark.sql("SELECT cell, p.x, p.y FROM {cells}, LATERAL mask_pixels(xs, ys) p", cells=_corners(spark, d).repartition(4 * spark.sparkContext.defaultParallelism))  # the table is one small file


@query(f"""WITH {BUSY}, isl AS (SELECT cell, frame, frame - row_number() OVER (PARTITION BY cell ORDER BY frame) AS g FROM busy), rn AS (SELECT cell, min(frame) AS t FROM isl GROUP BY cell, g),
e AS (SELECT cell, t, p AS place, round_even(t + 2.5 * (p - 0), 0) AS mid FROM rn, (SELECT unnest(range(1, 7)) AS p)),
ok AS (SELECT cell, t FROM e GROUP BY cell, t HAVING min(mid) - 3 >= 0 AND max(mid) + 3 <= 2600)
SELECT cell, t, CAST(place AS INTEGER) AS place, CAST(mid - 3 AS INTEGER) AS first_frame, CAST(mid + 2 AS INTEGER) AS last_frame FROM e JOIN ok USING (cell, t)""")
def wave_ranges(spark, d):
    """Where waves of 2.5 frames a place are looked for, from each run's start on, over seven places."""
    functions.register(spark)
    starts = busy_spans(spark, d).select("cell", F.col("start_frame").alias("t"))
    return spark.sql("SELECT cell, t, p.place, p.first_frame, p.last_frame FROM {starts}, LATERAL slope_ranges(0, 6, t, CAST(2.5 AS DOUBLE), 2600, 3) p", starts=starts)


# traces and trains

@query(f"""WITH {SERIES}, p AS (SELECT recording_id, cell, i, n, value, 1.0 AS p0, i - (n - 1) / 2.0 AS p1 FROM y), p2 AS (SELECT *, p1 * p1 - (n * n - 1) / 12.0 AS p2, p1 * p1 * p1 - p1 * (3 * n * n - 7) / 20.0 AS p3 FROM p),
s AS (SELECT recording_id, cell, avg(value) AS c0, sum(value * p1) / nullif(sum(p1 * p1), 0) AS c1, sum(value * p2) / nullif(sum(p2 * p2), 0) AS c2, sum(value * p3) / nullif(sum(p3 * p3), 0) AS c3 FROM p2 GROUP BY ALL),
fr AS (SELECT recording_id, cell, frame, row_number() OVER (PARTITION BY recording_id, cell ORDER BY frame) - 1 AS i FROM nl)
SELECT recording_id, cell, fr.frame, round(value / (c0 + coalesce(c1 * p1, 0) + coalesce(c2 * p2, 0) + coalesce(c3 * p3, 0)), 6) AS value FROM p2 JOIN s USING (recording_id, cell) JOIN fr USING (recording_id, cell, i)""")
def bleached(spark, d):
    return rounded(signals.bleaching_correction(nation_lines(spark, d)))


@query(f"""WITH {BUSY}, n AS (SELECT recording_id, cell, count(*) AS n FROM busy GROUP BY ALL), a AS (SELECT recording_id, cell, n, unnest(range({N_DAYS})) AS t FROM n)
SELECT recording_id, cell, CAST(t AS DOUBLE) AS t FROM a QUALIFY row_number() OVER (PARTITION BY recording_id, cell ORDER BY {drawn(0, "recording_id", "cell", "t")}, t) <= n""")
def train_randomized(spark, d):
    trains = busy_days(spark, d)[0].select("recording_id", "cell", F.col("frame").cast("double").alias("t"))
    return surrogates.randomized(trains, 0, N_DAYS)


#: Windows of three days over all recordings' busy days, counted by spikes.
@query(f"""WITH {BUSY}, st AS (SELECT recording_id, CAST(unnest(range({N_DAYS - 3})) AS INTEGER) AS t FROM (SELECT DISTINCT recording_id FROM busy)),
a AS (SELECT st.recording_id, t, count(cell) AS n FROM st LEFT JOIN busy ON busy.recording_id = st.recording_id AND frame >= t AND frame < t + 3 GROUP BY ALL),
o AS (SELECT *, t - row_number() OVER (PARTITION BY recording_id ORDER BY t) AS g FROM a WHERE n >= 4), e AS (SELECT recording_id, min(t) AS start_frame, CAST(max(t) + 2 AS INTEGER) AS end_frame, max(n) AS peak FROM o GROUP BY recording_id, g)
SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_frame) - 1 AS INTEGER) AS sce_id, start_frame, end_frame, peak FROM e""")
def sce_by_spikes(spark, d):
    s, r, _ = busy_days(spark, d)
    return sce.detect(s, r, 3, r.select("recording_id", F.lit(4.0).alias("threshold")), distinct=False)


# spectrograms

LIMIT = f"""{WAVES_SQL}, db AS (SELECT segment, k, freq, t, 10 * log10(power) AS power FROM pw), th AS (SELECT segment, avg(power) + stddev_pop(power) AS threshold FROM db GROUP BY 1)"""


def _decibels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    power = spectral.normalise(spectral.morlet_power(_signal(spark, d), RATE, WAVES))
    return power, spectral.power_threshold(power)


@query(f"WITH {LIMIT} SELECT segment, round(threshold, 6) AS threshold FROM th")
def decibel_threshold(spark, d):
    return rounded(_decibels(spark, d)[1], "threshold")


@query(f"""WITH RECURSIVE {LIMIT}, hot AS (SELECT segment, t FROM db JOIN th USING (segment) WHERE power > threshold * 1.05 GROUP BY segment, t HAVING count(*) > 0.25 * 12),
h AS (SELECT segment, list(t ORDER BY t) AS hits FROM hot GROUP BY 1),
sp(segment, t, hits) AS (SELECT segment, hits[1], hits FROM h UNION ALL SELECT segment, list_filter(hits, lambda x: x >= t + 6)[1], hits FROM sp WHERE len(list_filter(hits, lambda x: x >= t + 6)) > 0)
SELECT segment, t FROM sp""")
def spectral_spikes(spark, d):
    """Moments at which over a quarter of the frequencies stand out; a fifth of a second is skipped after each."""
    return spectral.spikes(*_decibels(spark, d), RATE, 0.25, 1.05)


BAND = spectral.Band("slow", 1, 5)


@query(f"""WITH {LIMIT}, s AS (SELECT DISTINCT segment, floor(freq - 1) AS slice, t FROM db JOIN th USING (segment) WHERE freq >= 1 AND freq < 5 AND power > threshold),
g AS (SELECT *, t - row_number() OVER (PARTITION BY segment, slice ORDER BY t) AS g FROM s)
SELECT segment, 1.0 + slice AS low, 2.0 + slice AS high, min(t) AS start_t, CAST(max(t) + 1 AS INTEGER) AS end_t FROM g GROUP BY segment, slice, g HAVING max(t) + 1 - min(t) > 1.0 * 30""")
def band_episodes(spark, d):
    return spectral.band_episodes(*_decibels(spark, d), BAND, RATE).withColumn("low", F.col("low").cast("double")).withColumn("high", F.col("high").cast("double"))


@query(f"""WITH RECURSIVE {LIMIT}, o AS (SELECT segment, k, freq, t FROM db JOIN th USING (segment) WHERE freq BETWEEN 1 AND 5 AND power > threshold),
g AS (SELECT *, t - row_number() OVER (PARTITION BY segment, k ORDER BY t) AS g FROM o), r AS (SELECT segment, k, freq, min(t) AS a, max(t) AS z, row_number() OVER (ORDER BY segment, min(t), k) AS id FROM g GROUP BY segment, k, freq, g),
l AS (SELECT u.id AS u, v.id AS v FROM r u JOIN r v ON u.segment = v.segment AND abs(u.k - v.k) = 1 AND v.a <= u.z + 1 AND v.z >= u.a - 1),
reach(u, v) AS (SELECT id, id FROM r UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v), root AS (SELECT u AS id, min(v) AS root FROM reach GROUP BY 1)
SELECT segment, round(min(freq), 6) AS low, round(max(freq), 6) AS high, min(a) AS start_t, CAST(max(z) + 1 AS INTEGER) AS end_t FROM r JOIN root USING (id) GROUP BY segment, root HAVING max(z) + 1 - min(a) > 1.0 * 30""")
def spectrum_regions(spark, d):
    """Connected regions of the spectrogram that last a second or more."""
    return all_rounded(spectral.region_episodes(*_decibels(spark, d), BAND, RATE), "low", "high")


HULL = """pt AS (SELECT DISTINCT CAST(s_nationkey AS INTEGER) AS cell, CAST(s_suppkey * 11 % 40 AS DOUBLE) AS x, CAST(s_suppkey * 17 % 150 AS DOUBLE) AS y FROM supplier),
sg AS (SELECT p.cell, p.x, p.y FROM pt p JOIN pt a ON a.cell = p.cell AND (a.x, a.y) <> (p.x, p.y) JOIN pt b ON b.cell = p.cell AND (b.x, b.y) > (a.x, a.y) AND (b.x, b.y) <> (p.x, p.y)
  WHERE (b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) AND p.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND p.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)),
tr AS (SELECT p.cell, p.x, p.y FROM pt p JOIN pt a ON a.cell = p.cell JOIN pt b ON b.cell = p.cell JOIN pt c ON c.cell = p.cell
  WHERE (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) > 0 AND (c.x - b.x) * (p.y - b.y) - (c.y - b.y) * (p.x - b.x) > 0 AND (a.x - c.x) * (p.y - c.y) - (a.y - c.y) * (p.x - c.x) > 0)"""


@query(f"WITH {HULL} SELECT cell, x, y FROM pt EXCEPT (SELECT * FROM sg UNION SELECT * FROM tr)")
def shape_hulls(spark, d):
    """Corners of the hulls of each nation's suppliers: points that lie on no line and in no triangle of others."""
    s = S.table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("cell"), (F.col("s_suppkey") * 11 % 40).cast("double").alias("x"), (F.col("s_suppkey") * 17 % 150).cast("double").alias("y"))
    return spatial.hulls(s, "cell").select("cell", "x", "y")


@query("""WITH p AS (SELECT a.vec_id, a.label, b.label AS c, b.vec_id AS other, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) AS d FROM embeddings a, embeddings b),
n AS (SELECT label AS c, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT vec_id, label, p.c, sum(d) AS d, any_value(n) AS n FROM p JOIN n USING (c) GROUP BY vec_id, label, p.c),
ab AS (SELECT vec_id, label, max(CASE WHEN c = label AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN c <> label THEN d / n END) AS b FROM m GROUP BY 1, 2)
SELECT vec_id, label, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab""")
def silhouette_euclidean(spark, d):
    return rounded(assemblies.silhouette(S.table(spark, d, "embeddings"), "embedding", "label", "vec_id"), "silhouette")
