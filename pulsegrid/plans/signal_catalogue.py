"""Queries on the nations' traces and trains with the SQL each is compared with, and SQL for those of ``kernels_catalogue``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import raster, signals, spatial, surrogates, transitions
from pulsegrid.plans.kernels_catalogue import N_DAYS, busy_days, nation_lines, rounded
from pulsegrid.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINES = """nl AS (SELECT CAST(n_regionkey AS VARCHAR) AS recording_id, CAST(s_nationkey AS INTEGER) AS cell,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame, sum(l_quantity) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""
SERIES = f"""{LINES}, y AS (SELECT recording_id, cell, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY recording_id, cell) AS n
  FROM nl WINDOW w AS (PARTITION BY recording_id, cell ORDER BY frame))"""
BUSY = f"""{LINES}, busy AS (SELECT recording_id, cell, frame FROM nl
  JOIN (SELECT recording_id, cell, quantile_cont(value, 0.9) AS cut FROM nl GROUP BY ALL) USING (recording_id, cell) WHERE value > cut)"""
RUNS = f"""{BUSY}, isl AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_id, cell ORDER BY frame) AS g FROM busy),
runs AS (SELECT recording_id, cell, min(frame) AS start_frame, max(frame) AS end_frame FROM isl GROUP BY recording_id, cell, g)"""
EDGES = f"""{RUNS}, met AS (SELECT r.recording_id, r.cell AS src, start_frame, b.cell AS dst, min(b.frame - start_frame) AS lag
  FROM runs r JOIN busy b ON b.recording_id = r.recording_id AND b.cell <> r.cell
  AND b.frame BETWEEN greatest(0, start_frame + 1) AND least(end_frame + 8, {N_DAYS}) - 1 GROUP BY ALL),
edges AS (SELECT recording_id, src, dst, CAST(count(*) AS DOUBLE) AS weight, avg(lag) AS mean_lag FROM met GROUP BY ALL)"""


def drawn(seed: int, *cols: str) -> str:
    """The number in [0, 1) that ``surrogates.uniform`` draws."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)})), 1, 13) AS BIGINT) / {float(1 << 52)!r})"


ORACLES["smoothed"] = f"""WITH {SERIES}, e AS (SELECT DISTINCT recording_id, cell, n FROM y),
k AS (SELECT k, 0.54 - 0.46 * cos(2 * pi() * k / 10) AS w FROM (SELECT unnest(range(11)) AS k)),
j AS (SELECT recording_id, cell, n, unnest(range(n + 10)) AS j FROM e),
p AS (SELECT j.*, w, j + k - 10 AS m FROM j, k),
q AS (SELECT *, CASE WHEN m < 0 THEN -m WHEN m >= n THEN 2 * n - 2 - m ELSE m END AS i FROM p)
SELECT q.recording_id, q.cell, CAST(j AS INTEGER) AS frame, round(sum(w * value) / sum(w), 6) AS value FROM q JOIN y USING (recording_id, cell, i) GROUP BY ALL"""

ORACLES["savitzky_golay"] = f"""WITH {SERIES}, h(kind, k, w) AS (VALUES
  ('in', -2, -3 / 35), ('in', -1, 12 / 35), ('in', 0, 17 / 35), ('in', 1, 12 / 35), ('in', 2, -3 / 35),
  ('first', 0, 69 / 70), ('first', 1, 4 / 70), ('first', 2, -6 / 70), ('first', 3, 4 / 70), ('first', 4, -1 / 70),
  ('second', -1, 2 / 35), ('second', 0, 27 / 35), ('second', 1, 12 / 35), ('second', 2, -8 / 35), ('second', 3, 2 / 35)),
o AS (SELECT recording_id, cell, i, CASE WHEN i = 0 OR i = n - 1 THEN 'first' WHEN i = 1 OR i = n - 2 THEN 'second' ELSE 'in' END AS kind, CASE WHEN i >= n - 2 THEN -1 ELSE 1 END AS dir FROM y),
p AS (SELECT recording_id, cell, o.i AS pos, o.i + dir * k AS i, w FROM o JOIN h USING (kind))
SELECT p.recording_id, p.cell, CAST(pos AS INTEGER) AS frame, round(sum(w * value), 6) AS value FROM p JOIN y USING (recording_id, cell, i) GROUP BY ALL"""

ORACLES["blurred"] = f"""WITH {SERIES}, k AS (SELECT k, exp(-k * k / 50.0) / (5 * sqrt(2 * pi())) AS w FROM (SELECT unnest(range(-64, 65)) AS k)),
p AS (SELECT recording_id, cell, i AS pos, ((i + k) % n + n) % n AS i, w FROM y, k)
SELECT p.recording_id, p.cell, CAST(pos AS INTEGER) AS frame, round(sum(w * value), 6) AS value FROM p JOIN y USING (recording_id, cell, i) GROUP BY ALL"""

ORACLES["train_jitter"] = f"""WITH {BUSY}, t AS (SELECT recording_id, cell, CAST(frame AS DOUBLE) AS t FROM busy),
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id, cell ORDER BY {drawn(1, "recording_id", "cell", "t")}, t) - 1 AS place, count(*) OVER (PARTITION BY recording_id, cell) AS n FROM t)
SELECT recording_id, cell, round(t - 5 + CASE WHEN n > 1 THEN 10.0 * place / (n - 1) ELSE 0 END, 6) AS t FROM o"""

ORACLES["run_transitions"] = f"WITH {EDGES} SELECT recording_id, src, dst, weight, round(mean_lag, 6) AS mean_lag FROM edges"

TRANSITIONS = f"""{BUSY}, met AS (SELECT a.recording_id, a.cell AS src, a.frame, b.cell AS dst, min(b.frame) - a.frame AS lag FROM busy a JOIN busy b
  ON b.recording_id = a.recording_id AND b.cell <> a.cell AND b.frame BETWEEN greatest(0, a.frame + 1) AND least(a.frame + 8, {N_DAYS}) - 1 GROUP BY a.recording_id, a.cell, a.frame, b.cell),
tr AS (SELECT recording_id, src, dst, CAST(count(*) AS DOUBLE) AS weight, avg(lag) AS mean_lag FROM met GROUP BY ALL)"""

ORACLES["graph_colours"] = f"""WITH RECURSIVE {TRANSITIONS},
top AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY recording_id, src ORDER BY weight DESC, dst) <= 2),
nb AS (SELECT recording_id, node, list(DISTINCT other) AS near FROM (SELECT recording_id, src AS node, dst AS other FROM top UNION ALL SELECT recording_id, dst, src FROM top) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY len(near), node) AS place FROM nb),
c(recording_id, place, done) AS (
  SELECT DISTINCT recording_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(node INTEGER, colour BIGINT)[]) FROM o
  UNION ALL
  SELECT o.recording_id, o.place, list_append(c.done, struct_pack(node := o.node, colour := list_filter(range(99), lambda x: NOT list_contains(list_transform(list_filter(c.done, lambda d: list_contains(o.near, d.node)), lambda d: d.colour), x))[1]))
  FROM c JOIN o ON o.recording_id = c.recording_id AND o.place = c.place + 1),
l AS (SELECT recording_id, unnest(done) AS d FROM c QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY place DESC) = 1)
SELECT recording_id, d.node AS node, CAST(d.colour AS INTEGER) AS colour FROM l"""


def beam_sql(branches: int = 2, depth: int = 5, n_cells: int = 25) -> str:
    parts = [f"""WITH {TRANSITIONS}, fl AS (SELECT recording_id, greatest(0, sum(weight) / {n_cells * n_cells}.0) AS floor FROM tr GROUP BY 1),
st AS (SELECT recording_id, src AS node, dst, weight FROM tr JOIN fl USING (recording_id) WHERE weight > floor
  QUALIFY row_number() OVER (PARTITION BY recording_id, src ORDER BY weight DESC, dst) <= {branches + depth}),
l0 AS (SELECT DISTINCT recording_id, n AS start, [n] AS path, CAST(0 AS DOUBLE) AS cost, n AS node FROM (SELECT recording_id, unnest([src, dst]) AS n FROM tr))"""]
    for k in range(1, depth):
        parts.append(f"""g{k} AS (SELECT recording_id, start, list_append(path, dst) AS path, cost - ln(weight) AS cost, dst AS node FROM l{k - 1} JOIN st USING (recording_id, node) WHERE NOT list_contains(path, dst)
  QUALIFY row_number() OVER (PARTITION BY recording_id, path ORDER BY weight DESC, dst) <= {branches}),
l{k} AS (SELECT * FROM g{k} QUALIFY row_number() OVER (PARTITION BY recording_id, start ORDER BY round(cost, 9), path) <= {branches})""")
    ended = " UNION ALL ".join(
        [f"SELECT * FROM l{k} a WHERE NOT EXISTS (SELECT 1 FROM l{k + 1} b WHERE b.recording_id = a.recording_id AND b.path[1:{k + 1}] = a.path)" for k in range(depth - 1)] + [f"SELECT * FROM l{depth - 1}"]
    )
    return ",\n".join(parts) + f"\nSELECT recording_id, start, array_to_string(path, ',') AS path, round(cost, 6) AS cost FROM ({ended})"


ORACLES["beam_paths"] = beam_sql()

ORACLES["welch_spectrum"] = f"""WITH {SERIES}, j AS (SELECT unnest(range(60)) AS j), s AS (SELECT cell, unnest(range((n - 60) // 30 + 1)) AS s FROM (SELECT DISTINCT cell, n FROM y) WHERE n >= 60),
v AS (SELECT y.cell, s, j, value - avg(value) OVER (PARTITION BY y.cell, s) AS v FROM s, j, y WHERE y.cell = s.cell AND y.i = 30 * s + j),
w AS (SELECT cell, s, j, v * (0.5 - 0.5 * cos(2 * pi() * j / 60)) AS v FROM v), k AS (SELECT unnest(range(121)) AS k),
f AS (SELECT cell, s, k, sum(v * cos(2 * pi() * k * j / 240)) AS re, sum(v * sin(2 * pi() * k * j / 240)) AS im FROM w, k GROUP BY ALL)
SELECT cell AS segment, round(k / 8.0, 6) AS freq, round(avg(re * re + im * im) * CASE WHEN k IN (0, 120) THEN 1 ELSE 2 END / (30 * (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * j / 60), 2)) FROM j)), 6) AS power
FROM f GROUP BY cell, k"""

#: Power of twelve frequencies from 0.6 to 12 and of 4 to 8 cycles, both growing by factors; wavelets last two seconds on either side, at 30 samples a second.
WAVES = f"""{SERIES}, f AS (SELECT k, 0.6 * power(20.0, k / 11.0) AS freq, 4 * power(2.0, k / 11.0) / (2 * pi() * 0.6 * power(20.0, k / 11.0)) AS s FROM (SELECT unnest(range(12)) AS k)),
q AS (SELECT k, freq, s, unnest(range(-60, 61)) AS off FROM f),
w AS (SELECT k, freq, off, power(s * sqrt(pi()), -0.5) * exp(-power(off / 30.0, 2) / (2 * s * s)) AS a, 2 * pi() * freq * off / 30.0 AS phase FROM q),
c AS (SELECT y.cell, k, any_value(freq) AS freq, y.i + off AS t, sum(value * a * cos(phase)) AS re, sum(value * a * sin(phase)) AS im FROM y, w WHERE y.i + off BETWEEN 0 AND n - 1 GROUP BY y.cell, k, y.i + off),
pw AS (SELECT cell AS segment, k, freq, CAST(t AS INTEGER) AS t, re * re + im * im AS power FROM c)"""

ORACLES["morlet_spectrum"] = f"WITH {WAVES} SELECT segment, round(freq, 6) AS freq, round(avg(power), 6) AS power FROM pw GROUP BY segment, freq"

ORACLES["oscillations"] = f"""WITH {WAVES}, m AS (SELECT segment, k, freq, avg(log10(power)) AS y FROM pw GROUP BY ALL),
l AS (SELECT segment, regr_slope(y, log10(freq)) AS a, regr_intercept(y, log10(freq)) AS b FROM m GROUP BY 1),
o AS (SELECT pw.segment, k, freq, t FROM pw JOIN l USING (segment) WHERE power > -ln(1 - 0.8) * 10 ** (a * log10(freq) + b)),
g AS (SELECT *, t - row_number() OVER (PARTITION BY segment, k ORDER BY t) AS g FROM o)
SELECT segment, round(freq, 6) AS freq, min(t) AS start_t, CAST(max(t) + 1 AS INTEGER) AS end_t FROM g GROUP BY segment, k, freq, g HAVING max(t) + 1 - min(t) >= 2.0 * 30 / freq"""

ORACLES["trace_events"] = f"""WITH RECURSIVE {LINES},
m AS (SELECT *, quantile_cont(value, 0.5) OVER w AS m, quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w AS iqr FROM nl
  WINDOW w AS (PARTITION BY recording_id, cell ORDER BY frame ROWS BETWEEN 40 PRECEDING AND 39 FOLLOWING)),
o AS (SELECT recording_id, cell, quantile_cont(value, 0.5) AS m_all, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr_all, max(frame) AS last FROM nl GROUP BY ALL),
hit AS (SELECT recording_id, cell, frame FROM m JOIN o USING (recording_id, cell) WHERE value - m > 3 * iqr AND m < m_all + iqr_all / 2 AND frame BETWEEN 41 AND last - 40 AND (frame - 41) % 5 = 0),
h AS (SELECT recording_id, cell, list(frame ORDER BY frame) AS hits FROM hit GROUP BY ALL),
t(recording_id, cell, frame, hits) AS (SELECT recording_id, cell, hits[1], hits FROM h
  UNION ALL SELECT recording_id, cell, list_filter(hits, lambda x: x > frame + 10)[1], hits FROM t WHERE len(list_filter(hits, lambda x: x > frame + 10)) > 0),
p AS (SELECT recording_id, frame, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY frame) - 1 AS INTEGER) AS sce_id
  FROM (SELECT DISTINCT recording_id, frame FROM t WHERE frame BETWEEN 1 AND {N_DAYS - 2}))
SELECT recording_id, sce_id, frame, cell FROM p JOIN t USING (recording_id, frame)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def busy_trains(spark: SparkSession, d: str) -> DataFrame:
    return busy_days(spark, d)[0].select("recording_id", "cell", F.col("frame").cast("double").alias("t"))


TRAINS = f"{BUSY}, t AS (SELECT recording_id, cell, CAST(frame AS DOUBLE) AS t FROM busy)"


@query(f"WITH {TRAINS} SELECT recording_id, cell, (((t + floor({drawn(2, 'recording_id', 'cell')} * 41) - 20) % {N_DAYS}) + {N_DAYS}) % {N_DAYS} AS t FROM t")
def train_shift(spark, d):
    return surrogates.shifted(busy_trains(spark, d), 20, 0, N_DAYS, 2)


@query(f"WITH {TRAINS} SELECT DISTINCT recording_id, cell, greatest(0, least({N_DAYS - 1}, t + floor({drawn(3, 'recording_id', 'cell', 't')} * 41) - 20)) AS t FROM t")
def train_fast_dither(spark, d):
    return surrogates.dithered_fast(busy_trains(spark, d), 20, 0, N_DAYS, 3)


@query(f"""WITH {TRAINS}, u AS (SELECT *, greatest({drawn(4, 'recording_id', 'cell', 't')}, 1e-16) AS u, {drawn(4 + 1_000_003, 'recording_id', 'cell', 't')} AS v FROM t)
SELECT recording_id, cell, round(t + 3 * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) AS t FROM u""")
def train_normal_jitter(spark, d):
    return rounded(surrogates.gaussian_jitter(busy_trains(spark, d), 3.0, 4), "t")


@query(f"""WITH {TRAINS}, s AS (SELECT *, CAST(unnest(range(5)) AS INTEGER) AS surr FROM t)
SELECT recording_id, surr, cell, (((t + floor({drawn(5, 'recording_id', 'surr', 'cell')} * 41) - 20) % {N_DAYS}) + {N_DAYS}) % {N_DAYS} AS t FROM s""")
def train_surrogates(spark, d):
    return surrogates.surrogate_trains(busy_trains(spark, d), 5, "shift", 20, 0, N_DAYS, 5)


@query(f"WITH {TRAINS}, l AS (SELECT recording_id, min(t) AS low FROM t GROUP BY 1) SELECT DISTINCT recording_id, cell, CAST(floor(t - low) AS INTEGER) AS frame FROM t JOIN l USING (recording_id)")
def train_frames(spark, d):
    return raster.trains_to_spikes(busy_trains(spark, d))


@query(f"WITH {BUSY} SELECT recording_id, cell, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) AS train FROM busy GROUP BY ALL")
def spike_trains(spark, d):
    return raster.spikes_to_trains(busy_days(spark, d)[0]).withColumn("train", F.array_join(F.col("train").cast("array<string>"), ","))


@query(f"WITH {TRAINS} SELECT recording_id, min(t) AS min_t, max(t) AS max_t FROM t GROUP BY ALL")
def train_span(spark, d):
    return raster.train_range(busy_trains(spark, d))


@query(f"""WITH {SERIES}, p AS (SELECT recording_id, cell, i AS pos, unnest(range(greatest(0, i - 150), i + 1)) AS i FROM y)
SELECT p.recording_id, p.cell, CAST(pos AS INTEGER) AS frame, round(sum(power(0.8, pos - p.i) * CASE WHEN p.i = 0 THEN 1 ELSE 0.2 END * value), 6) AS value
FROM p JOIN y USING (recording_id, cell, i) GROUP BY ALL""")
def exponentially_smoothed(spark, d):
    return rounded(signals.exponential_smooth(nation_lines(spark, d)))


@query(f"""WITH {LINES}, c AS (SELECT recording_id, cell, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM nl GROUP BY ALL),
v AS (SELECT nl.recording_id, nl.cell, frame, value - m AS v FROM nl JOIN c USING (recording_id, cell)),
l AS (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS lag),
x AS (SELECT a.recording_id, a.cell AS a, b.cell AS b, lag, sum(a.v * b.v) AS total FROM v a, l, v b
  WHERE a.recording_id = b.recording_id AND a.cell < b.cell AND b.frame = a.frame - lag GROUP BY ALL)
SELECT x.recording_id, a, b, lag, round(total / (ca.sd * cb.sd * ca.n), 6) AS value FROM x JOIN c ca ON ca.recording_id = x.recording_id AND ca.cell = a
JOIN c cb ON cb.recording_id = x.recording_id AND cb.cell = b""")
def lagged_covariance(spark, d):
    t = nation_lines(spark, d)
    cells = t.select("recording_id", "cell").distinct()
    pairs = cells.withColumnRenamed("cell", "a").join(cells.withColumnRenamed("cell", "b"), "recording_id").where("a < b")
    return rounded(signals.cross_covariance(t, pairs, 3, normalised=True))


@query(f"""WITH {EDGES}, best AS (SELECT *, row_number() OVER (PARTITION BY recording_id, src ORDER BY weight DESC, dst) AS r FROM edges)
SELECT a.recording_id || ':' || a.src AS path_id, sum(a.weight + b.weight) AS weight FROM best a JOIN best b ON b.recording_id = a.recording_id AND b.src = a.dst AND b.r = 1 WHERE a.r = 1 GROUP BY 1""")
def follower_path_weights(spark, d):
    s, r, _ = busy_days(spark, d)
    e = transitions.run_transitions(raster.runs(s), s, r, 1, 8)
    top = transitions.top_followers(e, 1).select("recording_id", "src", "dst")
    then = top.select("recording_id", F.col("src").alias("dst"), F.col("dst").alias("last"))
    # nodes named by their recording, as paths of all recordings meet one edge list
    name = lambda c: F.concat_ws(":", "recording_id", c)
    paths = top.join(then, ["recording_id", "dst"]).select(name("src").alias("path_id"), F.array(name("src"), name("dst"), name("last")).alias("path"))
    return transitions.path_weight(paths, e.select(name("src").alias("src"), name("dst").alias("dst"), "weight"))


MASK = """mask AS (SELECT DISTINCT CAST(s_nationkey AS INTEGER) AS cell, CAST(l_quantity AS INTEGER) AS x, CAST(round(l_discount * 100) + 20 * floor(l_tax * 100) AS INTEGER) AS y
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def shipped_pixels(spark: SparkSession, d: str) -> DataFrame:
    """(cell, x, y): nations as cells on the grid of quantity against discount and tax."""
    line, sup = S.table(spark, d, "lineitem"), S.table(spark, d, "supplier")
    y = F.round(F.col("l_discount") * 100) + 20 * F.floor(F.col("l_tax") * 100)
    return line.join(sup, line["l_suppkey"] == sup["s_suppkey"]).select(F.col("s_nationkey").cast("int").alias("cell"), F.col("l_quantity").cast("int").alias("x"), y.cast("int").alias("y")).distinct()


@query(f"WITH {MASK} SELECT a.cell AS a, b.cell AS b, count(*) AS n FROM mask a JOIN mask b ON a.x = b.x AND a.y = b.y AND a.cell < b.cell GROUP BY ALL")
def mask_overlaps(spark, d):
    return spatial.overlaps(shipped_pixels(spark, d))


@query(f"WITH {MASK} SELECT cell, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM mask GROUP BY cell")
def contour_centres(spark, d):
    shapes = shipped_pixels(spark, d).groupBy("cell").agg(F.collect_list(F.struct("x", "y")).alias("contour"))
    return rounded(rounded(spatial.centres(shapes), "cx"), "cy")


PROFILES = f"""{LINES}, px AS (SELECT cell, frame, CAST(frame % 5 AS INTEGER) AS x, CAST(value % 7 AS INTEGER) AS y, value AS v FROM nl),
tr AS (SELECT DISTINCT cell, CAST(floor(frame / 50.0) AS INTEGER) AS transient FROM nl),
f AS (SELECT cell, transient, CAST(unnest(range(transient * 50, transient * 50 + 50)) AS INTEGER) AS frame FROM tr),
prof AS (SELECT f.cell, transient, x, y, sum(v * value) / sum(value) AS v FROM f JOIN nl ON nl.cell = f.cell AND nl.frame = f.frame JOIN px ON px.cell = f.cell AND px.frame = f.frame GROUP BY ALL),
pk AS (SELECT cell, transient, max(v) AS height FROM prof GROUP BY ALL),
bs AS (SELECT cell, transient FROM pk QUALIFY row_number() OVER (PARTITION BY cell ORDER BY height DESC, transient) <= 10),
src AS (SELECT cell, x, y, avg(v) AS v FROM prof JOIN bs USING (cell, transient) GROUP BY ALL)"""


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = nation_lines(spark, d)
    px = t.select("cell", "frame", (F.col("frame") % 5).cast("int").alias("x"), F.round(F.col("value") % 7).cast("int").alias("y"), F.col("value").alias("v"))
    tr = t.select("cell", F.floor(F.col("frame") / 50).cast("int").alias("transient")).distinct()
    tr = tr.select("*", (F.col("transient") * 50).alias("start_frame"), (F.col("transient") * 50 + 49).alias("end_frame"))
    prof = spatial.transient_profiles(px, t, tr)
    return prof, spatial.source_profiles(prof, prof.groupBy("cell", "transient").agg(F.max("v").alias("height")))


@query(f"WITH {PROFILES} SELECT cell, transient, x, y, round(v, 6) AS v FROM prof")
def transient_profiles(spark, d):
    return rounded(_profiles(spark, d)[0], "v")


@query(f"WITH {PROFILES} SELECT cell, x, y, round(v, 6) AS v FROM src")
def source_profiles(spark, d):
    return rounded(_profiles(spark, d)[1], "v")


@query(f"WITH {PROFILES} SELECT cell, transient, round(corr(prof.v, src.v), 6) AS r FROM prof JOIN src USING (cell, x, y) WHERE x <> 4 GROUP BY ALL")
def profile_correlations(spark, d):
    prof, src = _profiles(spark, d)
    return rounded(spatial.profile_correlation(prof, src, src.where("x <> 4").select("cell", "x", "y")), "r")
