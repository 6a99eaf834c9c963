"""Field algebra, projection, objects, tracks and arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from fogline.functions import projection
from fogline.operators import grid, objects
from fogline.queries import _carriers as C
from fogline.queries._registry import query

LEVEL = 4000.0
_F = "WITH " + C.field_sql("f")
_PAIR = "WITH " + C.field_sql("f", "view") + ", " + C.field_sql("o", "click")


def _long(df):
    return C.rounded(df)


@query(f"{_F} SELECT r AS row, c AS col, round(v, 6) AS value, round(sum(v) OVER (ORDER BY r RANGE UNBOUNDED PRECEDING), 6) * 0 + round((SELECT sum(g.v) FROM f g WHERE g.r <= f.r AND g.c <= f.c), 6) AS total FROM f")
def summed_area(spark, sf_dir):
    return _long(grid.summed_area(C.field(spark, sf_dir)))


@query(f"""{_F} SELECT a.r AS row, a.c AS col, round(sum(b.v) / 9.0, 6) AS value FROM f a JOIN f b ON b.r BETWEEN a.r AND a.r + 2 AND b.c BETWEEN a.c AND a.c + 2
WHERE a.r <= {C.NY - 3} AND a.c <= {C.NX - 3} GROUP BY ALL""")
def box_mean(spark, sf_dir):
    return _long(grid.box_mean(C.field(spark, sf_dir), 3))


def _fss_sql(f: str, o: str) -> str:
    return f"""{_PAIR}, p AS (SELECT f.r, f.c, {f} AS f, {o} AS o FROM f JOIN o ON f.r = o.r AND f.c = o.c),
s AS (SELECT unnest([1, 3, 5])::BIGINT AS scale),
w AS (SELECT scale, a.r, a.c, sum(b.f) / (scale * scale)::DOUBLE AS f, sum(b.o) / (scale * scale)::DOUBLE AS o FROM s, p a JOIN p b ON true
      WHERE b.r >= a.r AND b.r < a.r + scale AND b.c >= a.c AND b.c < a.c + scale AND a.r + scale <= {C.NY} AND a.c + scale <= {C.NX} GROUP BY scale, a.r, a.c)
SELECT scale, round(CASE WHEN sum(f * f + o * o) = 0 THEN 1.0 ELSE 1 - sum((f - o) ** 2) / sum(f * f + o * o) END, 6)::DOUBLE AS fss FROM w GROUP BY scale"""


def _two(spark, sf_dir):
    f, o = C.field(spark, sf_dir, "view").withColumnRenamed("value", "forecast"), C.field(spark, sf_dir, "click").withColumnRenamed("value", "observed")
    return f.join(o, ["row", "col"])


@query(_fss_sql("(f.v >= 100)::INT::DOUBLE", "(o.v >= 100)::INT::DOUBLE"))
def fss(spark, sf_dir):
    return _long(grid.fractions_skill(_two(spark, sf_dir), [1, 3, 5], threshold=100.0))


@query(_fss_sql("least(f.v / 1000000, 1.0)::DOUBLE", "(o.v >= 100)::INT::DOUBLE"))
def pfss(spark, sf_dir):
    rows = _two(spark, sf_dir).withColumn("forecast", F.least(F.col("forecast") / 1000000, F.lit(1.0))).withColumn("observed", (F.col("observed") >= 100).cast("double"))
    return _long(grid.probabilistic_fractions_skill(rows, [1, 3, 5]))


#: Target grid: neither axis divides the source, so windows overlap.
TARGET = (7, 10)
_MASKED = f"""{_F}, m AS (SELECT r, c, CASE WHEN (r + c) % 2 = 0 THEN v ELSE -v END AS v, (r * c) % 5 <> 0 AS ok FROM f),
ar AS (SELECT i AS tr, unnest(range((i * {C.NY} // {TARGET[0]})::BIGINT, greatest(i * {C.NY} // {TARGET[0]} + 1, ceil((i + 1) * {C.NY} / {TARGET[0]}::DOUBLE))::BIGINT)) AS r FROM (SELECT unnest(range({TARGET[0]})) AS i)),
ac AS (SELECT i AS tc, unnest(range((i * {C.NX} // {TARGET[1]})::BIGINT, greatest(i * {C.NX} // {TARGET[1]} + 1, ceil((i + 1) * {C.NX} / {TARGET[1]}::DOUBLE))::BIGINT)) AS c FROM (SELECT unnest(range({TARGET[1]})) AS i)),
s AS (SELECT tr, tc, r * {C.NX} + c AS place, CASE WHEN ok THEN v END AS v FROM m JOIN ar USING (r) JOIN ac USING (c)) """
_REDUCE = {
    "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "mean": "avg(v)", "nearest": "arg_min(v, place) FILTER (WHERE v IS NOT NULL)",
    "max_abs": "arg_max(v, struct_pack(a := abs(v), p := -place)) FILTER (WHERE v IS NOT NULL)",
}


def _masked(spark, sf_dir):
    sign = F.when((F.col("row") + F.col("col")) % 2 == 0, 1.0).otherwise(-1.0)
    return C.field(spark, sf_dir).withColumn("value", F.col("value") * sign).withColumn("valid", (F.col("row") * F.col("col")) % 5 != 0)


def _add_regrid(reducer: str) -> None:
    sql = f"{_MASKED} SELECT tr AS row, tc AS col, round(coalesce({_REDUCE[reducer]}, -9999.0), 6) AS value FROM s GROUP BY tr, tc"

    @query(sql, name=f"regrid_{reducer}")
    def run(spark, sf_dir):
        return _long(grid.regrid(_masked(spark, sf_dir), (C.NY, C.NX), TARGET, reducer, fill=-9999.0))


for _name in grid.REDUCERS:
    _add_regrid(_name)


@query(f"{_MASKED} SELECT tr AS row, tc AS col, round(coalesce({_REDUCE['max_abs']}, -9999.0), 6) AS value FROM s GROUP BY tr, tc")
def regrid_policy(spark, sf_dir):
    return _long(grid.regrid_policy(_masked(spark, sf_dir), (C.NY, C.NX), TARGET, "signed-max-abs", fill=-9999.0))


@query(f"""{_F}, t AS (SELECT a.i AS tr, b.j AS tc, a.i * {C.NY - 1}.0::DOUBLE / 7 AS y, b.j * {C.NX - 1}.0::DOUBLE / 11 AS x
  FROM (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(12)) AS j) b),
n AS (SELECT *, floor(y)::BIGINT AS y0, least(floor(y) + 1, {C.NY - 1})::BIGINT AS y1, floor(x)::BIGINT AS x0, least(floor(x) + 1, {C.NX - 1})::BIGINT AS x1 FROM t)
SELECT tr AS row, tc AS col, round((1 - (y - y0)) * ((1 - (x - x0)) * a.v + (x - x0) * b.v) + (y - y0) * ((1 - (x - x0)) * c.v + (x - x0) * d.v), 6) AS value
FROM n JOIN f a ON a.r = y0 AND a.c = x0 JOIN f b ON b.r = y0 AND b.c = x1 JOIN f c ON c.r = y1 AND c.c = x0 JOIN f d ON d.r = y1 AND d.c = x1""")
def bilinear(spark, sf_dir):
    return _long(grid.bilinear(C.field(spark, sf_dir), (C.NY, C.NX), (8, 12)))


def _points(spark, sf_dir):
    rows = C.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", (F.lit(18.0) + (F.col("c_custkey") % 100) / 10.0).alias("lat"), (F.lit(80.0) + (F.col("c_custkey") % 140) / 10.0).alias("lon"))


def _projected_sql() -> str:
    d = projection.DOMAINS["pilot_e"]
    cone, scale, rho0 = projection.conic_constants(23, 21, 25)
    e = projection.ECCENTRICITY
    return f"""WITH p AS (SELECT c_custkey, radians(18.0 + (c_custkey % 100) / 10.0::DOUBLE) AS phi, radians(80.0 + (c_custkey % 140) / 10.0::DOUBLE) AS lam FROM customer),
q AS (SELECT c_custkey, {projection.SEMI_MAJOR * scale!r} * power(tan(pi() / 4 - phi / 2) / power((1 - {e!r} * sin(phi)) / (1 + {e!r} * sin(phi)), {e / 2!r}), {cone!r}) AS rho, {cone!r} * (lam - radians(87)) AS theta FROM p),
x AS (SELECT c_custkey, rho * sin(theta) AS x, {rho0!r} - rho * cos(theta) AS y FROM q)
SELECT c_custkey, round(x, 3) AS x, round(y, 3) AS y, round((y - {d.north!r}) / -{d.spacing!r}, 6) AS row, round((x - {d.west!r}) / {d.spacing!r}, 6) AS col FROM x"""


@query(_projected_sql())
def grid_index(spark, sf_dir):
    """Points projected into the first pilot domain, and their fractional cells."""
    d = projection.DOMAINS["pilot_e"]
    x, y = projection.project(d, F.col("lat"), F.col("lon"))
    row, col = projection.grid_index(d, F.col("lat"), F.col("lon"))
    return _points(spark, sf_dir).select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(row, 6).alias("row"), F.round(col, 6).alias("col"))


@query("""WITH p AS (SELECT c_custkey, 18.0 + (c_custkey % 100) / 10.0::DOUBLE AS lat, 80.0 + (c_custkey % 140) / 10.0::DOUBLE AS lon FROM customer),
c AS (SELECT c_custkey, floor((38 - lat) / 0.04::DOUBLE + 0.003)::BIGINT AS row, floor((lon - 66) / 0.04::DOUBLE + 0.003)::BIGINT AS col FROM p)
SELECT c_custkey, row, col, round(66 + (col + 0.5::DOUBLE) * 0.04::DOUBLE, 6) AS x, round(38 - (row + 0.5::DOUBLE) * 0.04::DOUBLE, 6) AS y FROM c""")
def grid_centres(spark, sf_dir):
    """The centre of the cell that each point lies in, on the national grid."""
    points = _points(spark, sf_dir).select("c_custkey", F.floor((38 - F.col("lat")) / 0.04 + 0.003).cast("int").alias("row"), F.floor((F.col("lon") - 66) / 0.04 + 0.003).cast("int").alias("col"))
    return _long(points.join(projection.centres(spark, projection.DOMAINS["national_s"]), ["row", "col"]).select("c_custkey", "row", "col", "x", "y"))


def _motion(spark, ny=C.NY, nx=C.NX):
    """Half-integer motion, so that rounding to even shows."""
    return grid.dense(spark.createDataFrame([(0, 0, 0.0)], "row int, col int, value double"), ny, nx).select("row", "col", ((F.col("col") % 5 - 2) / 2.0).alias("u"), ((F.col("row") % 3 - 1) / 2.0).alias("v"))


_LOOK = f"""{_F}, l AS (SELECT unnest([1, 2, 3]) AS lead), k AS (SELECT lead, r, c, r - ((r % 3 - 1) / 2.0::DOUBLE) * lead AS y, c - ((c % 5 - 2) / 2.0::DOUBLE) * lead AS x FROM f, l),
a AS (SELECT k.lead, k.r AS row, k.c AS col, coalesce(g.v, 0.0)::DOUBLE AS v FROM k LEFT JOIN f g ON g.r = round_even(y, 0)::BIGINT AND g.c = round_even(x, 0)::BIGINT) """


@query(_LOOK + "SELECT lead::BIGINT AS lead, row, col, round(v, 6) AS value FROM a")
def advect(spark, sf_dir):
    return _long(grid.lagrangian_persistence(C.field(spark, sf_dir), _motion(spark), 3))


@query(f"{_F} SELECT r AS row, c AS col, round(v, 6) AS value, lead FROM f, (SELECT unnest([1, 2, 3, 4])::BIGINT AS lead)")
def persistence(spark, sf_dir):
    return _long(grid.persistence(C.field(spark, sf_dir), 4))


@query(_LOOK + f", e AS (SELECT r, c, v FROM f) SELECT a.lead::BIGINT AS lead, a.row, a.col, round(0.25 * a.v + 0.75 * e.v, 6) AS value FROM a JOIN e ON e.r = a.row AND e.c = a.col")
def blend(spark, sf_dir):
    """Noise-free members blended with a model field."""
    field = C.field(spark, sf_dir)
    members, _ = grid.ensemble(field, _motion(spark), leads=3, members=2, noise=0.0)
    model = grid.persistence(field, 3)
    return _long(grid.blend(members, model, 0.25)[0])


_MEMBERS = 24
_UNIFORM = lambda at: "(" + " + ".join(f"(strpos('0123456789abcdef', substr(h, {at + i}, 1)) - 1) * {16 ** (12 - i)}::DOUBLE" for i in range(13)) + f" + 0.5) / {float(1 << 52)!r}"


@query(_LOOK + f""", s AS (SELECT stddev_pop(v) * 0.02::DOUBLE AS spread FROM f),
m AS (SELECT lead, member, v, md5('0|' || member || '|' || lead || '|' || row || '|' || col) AS h FROM a, (SELECT unnest(range({_MEMBERS})) AS member)),
x AS (SELECT lead, member, greatest(v + sqrt(-2 * ln({_UNIFORM(1)})) * cos(2 * pi() * {_UNIFORM(14)}) * spread, 0.0) AS v FROM m, s)
SELECT lead::BIGINT AS lead, member, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS spread, count(*) AS n FROM x GROUP BY ALL""")
def ensemble(spark, sf_dir):
    """Mean and spread of every member and lead: the draw is a digest of seed, member, lead and cell."""
    members, _ = grid.ensemble(C.field(spark, sf_dir), _motion(spark), leads=3, members=_MEMBERS)
    return _long(members.groupBy("lead", "member").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("spread"), F.count(F.lit(1)).alias("n")))


def _channels(spark, sf_dir):
    rows = C.events(spark, sf_dir)
    return rows.groupBy(F.col("event_type").alias("channel"), (F.dayofmonth("ts") - 1).alias("row"), F.hour("ts").alias("col")).agg((F.max("k") >= 50).alias("valid"))


@query(f"""WITH {C.EVENTS}, c AS (SELECT event_type, day(ts) - 1 AS r, hour(ts) AS c, max(k) >= 50 AS ok FROM ev WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL)
SELECT r AS row, c AS col, bool_and(ok) AND count(DISTINCT event_type) = 3 AS valid FROM c GROUP BY ALL""")
def combined_mask(spark, sf_dir):
    return _long(grid.combined_mask(_channels(spark, sf_dir), ["click", "view", "error"]))


#: Cells of a daily frame: groups of users.
SIDE = 6


def _frames(spark, sf_dir, domain):
    rows = C.table(spark, sf_dir, "events").withColumn("domain", domain)
    cell = F.col("user_id") % (SIDE * SIDE)
    return rows.groupBy("domain", F.to_date("ts").alias("frame_time"), F.floor(cell / SIDE).cast("int").alias("row"), (cell % SIDE).cast("int").alias("col")).agg(F.round(F.sum("value"), 2).alias("value"))


def _detected(spark, sf_dir, domain=None):
    active = _frames(spark, sf_dir, F.lit("users") if domain is None else F.col(domain))
    typical = active.groupBy("domain", "frame_time").agg(F.avg("value").alias("typical"))
    scaled = active.join(typical, ["domain", "frame_time"]).withColumn("value", 40 * F.col("value") / F.col("typical"))
    return objects.detect_objects(scaled, 40.0, SIDE, ["domain", "frame_time"], min_area=2)


@query(f"""WITH RECURSIVE c AS (SELECT ts::DATE AS day, user_id % {SIDE * SIDE} AS cell, round(sum(value), 2) AS v FROM events GROUP BY ALL),
a AS (SELECT day, cell, v, cell // {SIDE} AS r, cell % {SIDE} AS c FROM (SELECT *, avg(v) OVER (PARTITION BY day) AS m FROM c) WHERE 40 * v / m >= 40.0),
reach AS (SELECT day, cell AS start, cell, r, c FROM a
  UNION SELECT reach.day, reach.start, a.cell, a.r, a.c FROM reach JOIN a ON a.day = reach.day AND abs(a.r - reach.r) <= 1 AND abs(a.c - reach.c) <= 1),
l AS (SELECT day, cell, min(start) AS label FROM reach GROUP BY ALL),
o AS (SELECT day, label, count(*) AS area_cells, list(cell ORDER BY cell) AS cells FROM l GROUP BY ALL HAVING count(*) >= 2)
SELECT strftime(day, '%Y-%m-%d') AS frame, row_number() OVER (PARTITION BY day ORDER BY label) - 1 AS object, area_cells, array_to_string(cells, ',') AS cells FROM o""")
def storm_objects(spark, sf_dir):
    found = _detected(spark, sf_dir)
    return found.select(F.date_format("frame_time", "yyyy-MM-dd").alias("frame"), F.col("object").cast("long").alias("object"), F.col("area_cells").cast("long").alias("area_cells"), F.array_join("cells", ",").alias("cells"))


@query()
def storm_tracks(spark, sf_dir):
    """Tracks of every domain; the types of events are the domains."""
    tracks = objects.track_objects(_detected(spark, sf_dir, "event_type"))
    return tracks.withColumn("frame_time", F.date_format("frame_time", "yyyy-MM-dd"))


_OBJECTS = f"""c AS (SELECT ts::DATE AS day, user_id % {SIDE * SIDE} AS cell, round(sum(value), 2) AS v FROM events GROUP BY ALL),
a AS (SELECT day, cell, v, cell // {SIDE} AS r, cell % {SIDE} AS c FROM (SELECT *, avg(v) OVER (PARTITION BY day) AS m FROM c) WHERE 40 * v / m >= 40.0),
reach AS (SELECT day, cell AS start, cell, r, c FROM a
  UNION SELECT reach.day, reach.start, a.cell, a.r, a.c FROM reach JOIN a ON a.day = reach.day AND abs(a.r - reach.r) <= 1 AND abs(a.c - reach.c) <= 1),
l AS (SELECT day, cell, min(start) AS label FROM reach GROUP BY ALL),
big AS (SELECT day, label, row_number() OVER (PARTITION BY day ORDER BY label) - 1 AS object FROM l GROUP BY day, label HAVING count(*) >= 2)"""
_STEPS, _TARGETS = 12, [("centre", 3.0, 3.0, 2.0), ("corner", 0.0, 5.0, 3.0)]


@query(f"""WITH RECURSIVE {_OBJECTS},
g AS (SELECT m, r.i AS r, k.i AS c, rint_r AS sr, rint_c AS sc FROM (SELECT unnest(range(4)) AS m) mm, (SELECT unnest(range({SIDE})) AS i) r, (SELECT unnest(range({SIDE})) AS i) k,
  LATERAL (SELECT round_even(r.i - ((r.i % 3 - 1) / 2.0::DOUBLE), 0)::BIGINT AS rint_r, round_even(k.i - ((k.i % 5 - 2) / 2.0::DOUBLE) * m / 2.0, 0)::BIGINT AS rint_c) q),
w AS (SELECT strftime(l.day, '%Y%m%d') || '-' || object AS track, m, 0 AS step, cell // {SIDE} AS r, cell % {SIDE} AS c FROM l JOIN big USING (day, label), (SELECT unnest(range(4)) AS m)
  UNION ALL SELECT w.track, w.m, w.step + 1, g.r, g.c FROM w JOIN g ON g.m = w.m AND g.sr = w.r AND g.sc = w.c WHERE w.step < {_STEPS}),
t AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x}, {y}, {radius}::DOUBLE)" for n, x, y, radius in _TARGETS)}) v(target, x, y, radius)),
h AS (SELECT w.track, t.target, t.radius, w.m, min(step) FILTER (WHERE step > 0 AND (w.c - x) ** 2 + (w.r - y) ** 2 <= (radius / 2) ** 2) * 10 AS minutes FROM w, t GROUP BY ALL),
q AS (SELECT track, target, radius, count(minutes) / count(*)::DOUBLE AS p, list(minutes ORDER BY minutes) FILTER (WHERE minutes IS NOT NULL) AS xs FROM h GROUP BY ALL)
SELECT track AS track_id, target AS target_id, radius AS radius_km, round(p, 6) AS p_arrival, xs[ceil(0.1 * (len(xs) - 1))::INT + 1]::BIGINT AS t10, xs[ceil(0.5 * (len(xs) - 1))::INT + 1]::BIGINT AS t50, xs[ceil(0.9 * (len(xs) - 1))::INT + 1]::BIGINT AS t90, 0.0::DOUBLE AS p_decay FROM q""")
def storm_arrivals(spark, sf_dir):
    """Arrival windows of the storms of all days at two targets, over four motion members."""
    storms = _detected(spark, sf_dir).select(F.concat_ws("-", F.date_format("frame_time", "yyyyMMdd"), "object").alias("track_id"), "cells")
    targets = spark.createDataFrame(_TARGETS, "target_id string, x double, y double, radius_km double")
    base = _motion(spark, SIDE, SIDE)
    motion = base.withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("u", F.col("u") * F.col("member") / 2)
    times = objects.arrival_times(storms, targets, motion, (SIDE, SIDE), steps=_STEPS)
    return _long(objects.arrival_windows(times))


@query(f"""WITH d AS (SELECT value AS d FROM events WHERE value > 0), c AS (SELECT user_id::VARCHAR AS key, max(value) / 2 AS at FROM events GROUP BY user_id)
SELECT key, round((SELECT count(*) FROM d WHERE d.d <= c.at) / (SELECT count(*) FROM d)::DOUBLE, 6) AS p_decay FROM c""")
def decay_probability(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events")
    cutoffs = rows.groupBy(F.col("user_id").cast("string").alias("key")).agg((F.max("value") / 2).alias("cutoff"))
    return _long(objects.decay_probability(rows, cutoffs, "value"))
