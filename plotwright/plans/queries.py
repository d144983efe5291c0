"""The registered queries of the library's own operators, each beside its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import axes as A
from ..operators import curves as C
from ..operators import masks as K
from ..operators import matching as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key``, so that one task doesn't draw the pixels of all."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# stand-ins: event types as curves, embeddings as points

CURVES = """c as (select event_type as curve_id, row_number() over (partition by event_type order by ts, event_id) - 1 as seq,
  (epoch_us(ts) - min(epoch_us(ts)) over (partition by event_type)) / 1e6 as x, value as y, event_id from events)"""
POINTS = """p as (select vec_id as id, label::bigint as image_id, embedding[1]::double * 400 + 600 as x, embedding[2]::double * 300 + 400 as y from embeddings)"""
DAILY = f"""{CURVES}, daily as (select curve_id, floor(x / 86400) * 1.0 as x, avg(y) as y, row_number() over (partition by curve_id order by floor(x / 86400)) - 1 as seq from c group by curve_id, floor(x / 86400))"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("curve_id"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("seq"), ((micros - F.min(micros).over(w)) / 1e6).alias("x"), F.col("value").alias("y"), "event_id")
    return rows


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curves(spark, sf_dir).groupBy("curve_id", (F.floor(F.col("x") / 86400) * 1.0).cast("double").alias("x")).agg(F.avg("y").alias("y"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("curve_id").orderBy("x")) - 1)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("image_id"), (e[0].cast("double") * 400 + 600).alias("x"), (e[1].cast("double") * 300 + 400).alias("y"))


_RENORM = f"""{CURVES}, n as (select curve_id, seq, event_id, (x - min(x) over w) / (max(x) over w - min(x) over w + 1e-10) as x,
  (y - min(y) over w) / (max(y) over w - min(y) over w + 1e-10) as y from c window w as (partition by curve_id))"""


def _mad(source: str) -> str:
    return f"""m1 as (select *, median(y) over (partition by curve_id) as m from {source}),
  m2 as (select *, median(abs(y - m)) over (partition by curve_id) as d from m1),
  kept as (select curve_id, seq, x, y from m2 where d = 0 or abs(0.6745 * (y - m) / d) <= 3.0)"""


def _grid(source: str) -> str:
    return f"""s as (select *, lead(x) over o as x1, lead(y) over o as y1, min(x) over w as lo, max(x) over w as hi, greatest(500, 2 * count(*) over w) as size
    from {source} window w as (partition by curve_id), o as (partition by curve_id order by x, seq)),
  g as (select *, (hi - lo) / (size - 1) as step from s),
  k as (select *, case when x1 is null then size - 1 else ceil((x - lo) / step)::bigint end as k0,
    case when x1 is null then size - 1 else least(ceil((x1 - lo) / step)::bigint - 1, size - 2) end as k1 from g where hi > lo),
  e as (select *, unnest(generate_series(k0, k1)) as k from k where k1 >= k0),
  f as (select *, case when k = size - 1 then hi else lo + k * step end as gx from e)"""


@query(f"""with {_RENORM}, mapped as (select curve_id, seq, 0.0 + x * 100.0 as x, pow(10.0, 0.0 + y * 3.0) as y from n), {_mad("mapped")}, {_grid("kept")}
select curve_id, k, round(gx, 6) as x, round(case when x1 is null then y else y + (y1 - y) * (gx - x) / (x1 - x) end, 6) as y from f""")
def correct_curves(spark, sf_dir):
    out = C.correct(curves(spark, sf_dir), (0.0, 100.0), (1.0, 1000.0), "linear", "log10", "renorm", "mad", 3.0, "interp")
    return out.select("curve_id", "k", r6("x").alias("x"), r6("y").alias("y"))


def _mapping(scale: str, low: float, high: float, sql: str):
    def run(spark, sf_dir):
        rows = C.renormalize(curves(spark, sf_dir), ("y",))
        return rows.select("event_id", r6(S.map_coords(F.col("y"), low, high, scale)).alias("value"))

    run.__name__ = f"map_{scale}"
    query(f"with {_RENORM} select event_id, round({sql}, 6) as value from n")(run)


_mapping("linear", -1.0, 10.0, "-1.0 + y * 11.0")
_mapping("log10", 0.1, 1000.0, "pow(10.0, -1.0 + y * 4.0)")
_mapping("inverse", 0.5, 20.0, "1.0 / (2.0 + y * (0.05 - 2.0))")

_BOX, _RANGE = (100.0, 50.0, 1100.0, 750.0), (0.0, 30.0, 1.0, 1000.0)


@query(f"""with {POINTS} select id, round(0.0 + (x - 100.0) / 1000.0 * 30.0, 6) as x, round(pow(10.0, (1.0 - (y - 50.0) / 700.0) * 3.0), 6) as y,
  not (x between 100.0 and 1100.0 and y between 50.0 and 750.0) as outside from p""")
def pixel_to_data(spark, sf_dir):
    x, y = S.pixel_to_data(F.col("x"), F.col("y"), _BOX, _RANGE, "linear", "log10")
    return points(spark, sf_dir).select("id", r6(x).alias("x"), r6(y).alias("y"), (~S.contains(tuple(map(F.lit, _BOX)), F.col("x"), F.col("y"))).alias("outside"))


@query("""with p as (select l_orderkey, l_linenumber, l_quantity / 50.0 * 30.0 as x, l_extendedprice as y from lineitem)
select l_orderkey, l_linenumber, round(100.0 + x / 30.0 * 1000.0, 6) as px, round(750.0 - log10(y) / 3.0 * 700.0, 6) as py from p""")
def data_to_pixel(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0 * 30.0).alias("x"), F.col("l_extendedprice").alias("y"))
    px, py = S.data_to_pixel(F.col("x"), F.col("y"), _BOX, _RANGE, "linear", "log10")
    return rows.select("l_orderkey", "l_linenumber", r6(px).alias("px"), r6(py).alias("py"))


@query(f"with {CURVES} select event_id, greatest(0.0, least(1.0, y / 400.0 - 0.1)) as y from c")
def dirty_clip(spark, sf_dir):
    return C.clip(curves(spark, sf_dir).withColumn("y", F.col("y") / 400.0 - 0.1), ("y",)).select("event_id", "y")


@query(f"with {_RENORM} select event_id, round(x, 6) as x, round(y, 6) as y from n")
def dirty_renorm(spark, sf_dir):
    return C.renormalize(curves(spark, sf_dir)).select("event_id", r6("x").alias("x"), r6("y").alias("y"))


_CORNERS = f"""{POINTS}, b as (select image_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p group by image_id),
  spots as (select image_id, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * 0.6 as lim, unnest([0, 1, 2, 3]) as corner, unnest([x0, x1, x0, x1]) as cx, unnest([y0, y0, y1, y1]) as cy from b),
  ds as (select p.image_id, corner, id, x, y, lim, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) as d from p join spots using (image_id)),
  near as (select *, row_number() over (partition by image_id, corner order by d, id) as rn from ds)"""


@query(f"with {_CORNERS} select image_id::varchar as curve_id, corner, id as seq, round(d, 6) as distance, d <= lim as ok from near where rn = 1")
def corner_nearest(spark, sf_dir):
    rows = points(spark, sf_dir).select(F.col("image_id").cast("string").alias("curve_id"), F.col("id").alias("seq"), "x", "y")
    return C.corners(rows, 0.6).select("curve_id", "corner", "seq", r6("distance").alias("distance"), "ok")


@query(f"""with {_CORNERS}, q as (select image_id, id, x, y, (corner % 2)::double as u, floor(corner / 2)::double as v, d <= lim as ok from near where rn = 1),
  a as (select image_id, bool_and(ok) and count(distinct id) = 4 as applied, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(v) as mv,
    sum(x * x) - 4 * avg(x) * avg(x) as sxx, sum(x * y) - 4 * avg(x) * avg(y) as sxy, sum(y * y) - 4 * avg(y) * avg(y) as syy,
    sum(x * u) - 4 * avg(x) * avg(u) as xu, sum(y * u) - 4 * avg(y) * avg(u) as yu, sum(x * v) - 4 * avg(x) * avg(v) as xv, sum(y * v) - 4 * avg(y) * avg(v) as yv from q group by image_id),
  t as (select *, sxx * syy - sxy * sxy as det from a)
select p.image_id::varchar as curve_id, p.id as seq, applied,
  round(case when applied then mu + (xu * syy - yu * sxy) / det * (x - mx) + (yu * sxx - xu * sxy) / det * (y - my) else x end, 5) as x,
  round(case when applied then mv + (xv * syy - yv * sxy) / det * (x - mx) + (yv * sxx - xv * sxy) / det * (y - my) else y end, 5) as y
from p join t using (image_id) where not (applied and p.id in (select id from q where q.image_id = p.image_id))""")
def corner_affine(spark, sf_dir):
    rows = points(spark, sf_dir).select(F.col("image_id").cast("string").alias("curve_id"), F.col("id").alias("seq"), "x", "y")
    return C.corner_affine(rows, 0.6).select("curve_id", "seq", "applied", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"""with c as (select l_returnflag as curve_id, l_orderkey * 10 + l_linenumber as seq, 0 as x, l_extendedprice as y from lineitem), {_mad("c")} select curve_id, seq, y from kept""")
def clean_mad(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("curve_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("y"))
    return C.clean_mad(rows).select("curve_id", "seq", "y")


def _savgol_sql() -> str:
    hat, cases = C._hat(11), []
    for at in range(11):
        terms = " + ".join(f"({float(h)!r}) * " + ("y" if k == at else f"lag(y, {at - k}) over o" if k < at else f"lead(y, {k - at}) over o") for k, h in enumerate(hat[at]))
        cases.append(f"when i - least(greatest(i - 5, 0), n - 11) = {at} then {terms}")
    return f"""with {CURVES}, r as (select *, row_number() over (partition by curve_id order by seq) - 1 as i, count(*) over (partition by curve_id) as n from c),
  s as (select *, case {' '.join(cases)} end as smooth from r window o as (partition by curve_id order by seq)),
  t as (select *, stddev_pop(abs(y - smooth)) over (partition by curve_id) as sd from s)
select event_id, round(smooth, 6) as smooth, abs(y - smooth) <= 3.0 * sd as kept from t"""


@query(_savgol_sql())
def clean_savgol(spark, sf_dir):
    return C.flag_savgol(curves(spark, sf_dir)).select("event_id", r6("smooth").alias("smooth"), "kept")


@query(f"with {DAILY}, {_grid('daily')} select curve_id, k, round(gx, 6) as x, round(case when x1 is null then y else y + (y1 - y) * (gx - x) / (x1 - x) end, 6) as y from f")
def resample_linear(spark, sf_dir):
    return C.resample_linear(daily(spark, sf_dir)).select("curve_id", "k", r6("x").alias("x"), r6("y").alias("y"))


def _pchip_sql() -> str:
    def end(h0: str, h1: str, d0: str, d1: str) -> str:
        e = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
        return f"case when {d1} is null then {d0} when sign({e}) <> sign({d0}) then 0.0 when sign({d0}) <> sign({d1}) and abs({e}) > 3 * abs({d0}) then 3 * {d0} else {e} end"

    return f"""with {DAILY}, l as (select *, lead(x) over o - x as h, (lead(y) over o - y) / (lead(x) over o - x) as d from daily window o as (partition by curve_id order by x)),
  n as (select *, lag(h) over o as hp, lag(d) over o as dp, lag(h, 2) over o as hpp, lag(d, 2) over o as dpp, lead(h) over o as hn, lead(d) over o as dn from l window o as (partition by curve_id order by x)),
  m as (select curve_id, x, y, seq, h, case when dp is null then {end('h', 'hn', 'd', 'dn')} when d is null then {end('hp', 'hpp', 'dp', 'dpp')} when dp * d <= 0 then 0.0
    else (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) end as m from n),
  mm as (select *, lead(m) over (partition by curve_id order by x) as m1 from m), {_grid('mm')}, t as (select *, (gx - x) / h as t from f)
select curve_id, k, round(gx, 6) as x, round(case when x1 is null then y else (2*t*t*t - 3*t*t + 1) * y + (t*t*t - 2*t*t + t) * h * m + (3*t*t - 2*t*t*t) * y1 + (t*t*t - t*t) * h * m1 end, 6) as y from t"""


@query(_pchip_sql())
def resample_pchip(spark, sf_dir):
    return C.resample_pchip(daily(spark, sf_dir)).select("curve_id", "k", r6("x").alias("x"), r6("y").alias("y"))


@query()
def resample_bspline(spark, sf_dir):
    return C.resample_bspline(daily(spark, sf_dir)).select("curve_id", "k", r6("x").alias("x"), r6("y").alias("y"))


@query()
def resample_gpr(spark, sf_dir):
    return C.resample_gpr(daily(spark, sf_dir)).select("curve_id", "k", *[F.round(c, 4).alias(c) for c in ("x", "y", "y_std")])


@query(f"with {CURVES} select curve_id, round_even(x / 3600, 0) as x, round_even(avg(y), 0) as y, count(*) as n from c group by curve_id, round_even(x / 3600, 0)")
def rebuild_by_x(spark, sf_dir):
    return C.average_by_x(curves(spark, sf_dir).withColumn("x", F.col("x") / 3600), rounded=True).select("curve_id", "x", "y", "n")


@query(f"""with {CURVES}, b as (select curve_id, round_even(x / 3600, 0) as x, round_even(avg(y), 0) as y from c group by curve_id, round_even(x / 3600, 0))
select curve_id, x, round_even(avg(y) over (partition by curve_id order by x rows between 7 preceding and 7 following), 0) as y from b""")
def smooth_ma(spark, sf_dir):
    rows = C.average_by_x(curves(spark, sf_dir).withColumn("x", F.col("x") / 3600), rounded=True)
    return C.moving_average(rows).select("curve_id", "x", "y")


@query(f"""with {CURVES}, q as (select curve_id, seq, x / 600 as x, y from c),
  r as (select *, lead(x) over o as x1, lead(y) over o as y1, lag(x) over o as xp, lag(y) over o as yp, lead(x, 2) over o as x2, lead(y, 2) over o as y2 from q window o as (partition by curve_id order by seq)),
  a as (select *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) as d, degrees(atan2(y1 - y, x1 - x)) as g, degrees(atan2(y - yp, x - xp)) as g0, degrees(atan2(y2 - y1, x2 - x1)) as g2 from r),
  b as (select *, case when x - xp > 0 then least(abs(g - g0) % 360.0, 360.0 - abs(g - g0) % 360.0) else 0.0 end as t0, case when x2 - x1 > 0 then least(abs(g - g2) % 360.0, 360.0 - abs(g - g2) % 360.0) else 0.0 end as t2 from a),
  s as (select *, case when coalesce(d > 1 and d <= 95 and x1 - x > 0 and abs(y1 - y) <= greatest(32.0, abs(x1 - x) * 0.85) and greatest(t0, t2) <= 70.0, false) then greatest(1, floor(d / 4.0)::int) else 1 end as steps from b),
  e as (select *, unnest(range(steps)) as i from s)
select curve_id, seq, i::int as i, round(case when i = 0 then x else x + (x1 - x) * (i / steps) end, 6) as x, round(case when i = 0 then y else y + (y1 - y) * (i / steps) end, 6) as y, i > 0 as completed from e""")
def gap_fill(spark, sf_dir):
    rows = C.gap_points(curves(spark, sf_dir).withColumn("x", F.col("x") / 600))
    return rows.select("curve_id", "seq", "i", r6("x").alias("x"), r6("y").alias("y"), "completed")


@query(f"""with {CURVES}, s as (select *, sqrt(pow(x / 600 - lag(x / 600) over o, 2) + pow(y - lag(y) over o, 2)) as d from c window o as (partition by curve_id order by seq))
select curve_id, round(sum(d), 4) as length, round(max(x / 600) - min(x / 600), 6) as x_span, count(*) as n from s group by curve_id""")
def path_length(spark, sf_dir):
    rows = C.path_lengths(curves(spark, sf_dir).withColumn("x", F.col("x") / 600))
    return rows.select("curve_id", F.round("length", 4).alias("length"), r6("x_span").alias("x_span"), "n")


@query(f"""with {CURVES}, t as (select event_id, (x - lag(x, 5) over o) / 600 as ax, y - lag(y, 5) over o as ay, (lead(x, 5) over o - x) / 600 as bx, lead(y, 5) over o - y as b_y from c window o as (partition by curve_id order by seq))
select event_id, round(case when ax * ax + ay * ay = 0 or bx * bx + b_y * b_y = 0 then 0.0 else degrees(acos(greatest(-1.0, least(1.0, (ax * bx + ay * b_y) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + b_y * b_y)))))) end, 4) as turn from t where ax is not null and bx is not null""")
def tangents(spark, sf_dir):
    w = Window.partitionBy("curve_id").orderBy("seq")
    c = F.col
    rows = curves(spark, sf_dir).withColumns({"ax": (c("x") - F.lag("x", 5).over(w)) / 600, "ay": c("y") - F.lag("y", 5).over(w), "bx": (F.lead("x", 5).over(w) - c("x")) / 600, "by": F.lead("y", 5).over(w) - c("y")})
    return rows.where("ax is not null and bx is not null").select("event_id", F.round(S.angle_between(c("ax"), c("ay"), c("bx"), c("by")), 4).alias("turn"))


_CHAMFER = f"""{POINTS}, a as (select image_id // 2 as image_id, id, x, y from p where image_id % 2 = 0), t as (select image_id // 2 as image_id, id, x, y from p where image_id % 2 = 1),
  d as (select 'pred' as way, a.image_id, a.id, min(sqrt(pow(a.x - t.x, 2) + pow(a.y - t.y, 2))) as d from a join t using (image_id) group by all
    union all select 'truth', t.image_id, t.id, min(sqrt(pow(a.x - t.x, 2) + pow(a.y - t.y, 2))) from t join a using (image_id) group by all)"""


def _halves(spark, sf_dir):
    rows = points(spark, sf_dir)
    half = lambda i: rows.where(F.col("image_id") % 2 == i).select(F.floor(F.col("image_id") / 2).alias("image_id"), "id", "x", "y")
    return half(0), half(1)


@query(f"""with {_CHAMFER} select image_id, round(avg(d) filter (way = 'pred'), 6) as mean_pred_to_truth, round(avg(d) filter (way = 'truth'), 6) as mean_truth_to_pred, round(max(d), 6) as hausdorff,
  round(quantile_cont(d, 0.95) filter (way = 'pred'), 6) as p95_pred_to_truth, round(quantile_cont(d, 0.95) filter (way = 'truth'), 6) as p95_truth_to_pred,
  round((avg(d) filter (way = 'pred') + avg(d) filter (way = 'truth')) / 2, 6) as chamfer from d group by image_id""")
def nn_chamfer(spark, sf_dir):
    found = M.path_metrics(*_halves(spark, sf_dir), cell=16.0)
    return found.select("image_id", *[r6(c).alias(c) for c in found.columns if c != "image_id"])


_INTERP = f"""{DAILY}, pr as (select curve_id, event_id as id, x / 86400 as x, y from c), tr as (select curve_id, x, y, lead(x) over o as x1, lead(y) over o as y1 from daily window o as (partition by curve_id order by x)),
  j as (select pr.curve_id, id, pr.x, pr.y, case when pr.x = tr.x then tr.y else tr.y + (y1 - tr.y) * (pr.x - tr.x) / (x1 - tr.x) end as y_true from pr join tr on pr.curve_id = tr.curve_id and pr.x >= tr.x and (pr.x < x1 or (x1 is null and pr.x = tr.x)))"""


@query(f"""with {_INTERP}, e as (select curve_id, count(*) as n, avg(abs(y - y_true)) as mae, sqrt(avg(pow(y - y_true, 2))) as rmse, max(abs(y - y_true)) as max_error, quantile_cont(abs(y - y_true), 0.95) as p95_error,
  1 - sum(pow(y - y_true, 2)) / nullif(var_pop(y_true) * count(*), 0) as r2, max(x) - min(x) as s from j group by curve_id)
select e.curve_id, n, round(mae, 6) as mae, round(rmse, 6) as rmse, round(max_error, 6) as max_error, round(p95_error, 6) as p95_error, round(r2, 6) as r2, round(least(1.0, s / span), 6) as x_coverage
from e join (select curve_id, max(x) - min(x) as span from daily group by curve_id) using (curve_id)""")
def interp_metrics(spark, sf_dir):
    truth = daily(spark, sf_dir)
    pred = curves(spark, sf_dir).select("curve_id", F.col("event_id").alias("id"), (F.col("x") / 86400).alias("x"), "y")
    found = M.data_metrics(pred, truth)
    return found.select("curve_id", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "max_error", "p95_error", "r2", "x_coverage")])


_BOXES = """a as (select s_suppkey as id, s_nationkey as n, s_suppkey % 7 * 10.0 as x0, s_suppkey % 11 * 5.0 as y0, s_suppkey % 7 * 10.0 + 20 + s_suppkey % 13 as x1, s_suppkey % 11 * 5.0 + 15 + s_suppkey % 5 as y1 from supplier)"""


def boxes(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("image_id"), k.alias("id"), (k % 7 * 10.0).alias("x0"), (k % 11 * 5.0).alias("y0"), (k % 7 * 10.0 + 20 + k % 13).alias("x1"), (k % 11 * 5.0 + 15 + k % 5).alias("y1"), (F.col("s_acctbal") / 10000).alias("score"))


def _box_pairs(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    a, b = (rows.select("image_id", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "x0", "y0", "x1", "y1")]) for s in "ab")
    pair = a.join(b, "image_id").where("id_a < id_b")
    return pair, tuple(F.col(f"{c}_a") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"{c}_b") for c in ("x0", "y0", "x1", "y1"))


_SHARED = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_SIZE = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"


@query(f"with {_BOXES} select a.id as id_a, b.id as id_b, round({_SHARED} / greatest(1.0, {_SIZE.format('a')} + {_SIZE.format('b')} - {_SHARED}), 6) as iou from a join a b on a.n = b.n and a.id < b.id")
def bbox_iou(spark, sf_dir):
    pair, a, b = _box_pairs(spark, sf_dir)
    return pair.select("id_a", "id_b", r6(S.bbox_iou(a, b)).alias("iou"))


@query(f"with {_BOXES} select a.id as id_a, b.id as id_b, round({_SHARED} / greatest(1.0, least({_SIZE.format('a')}, {_SIZE.format('b')})), 6) as containment from a join a b on a.n = b.n and a.id < b.id")
def bbox_contain(spark, sf_dir):
    pair, a, b = _box_pairs(spark, sf_dir)
    return pair.select("id_a", "id_b", r6(S.bbox_containment(a, b)).alias("containment"))


@query(f"""with {POINTS} select id, case when x < 500 then 0 when x <= 700 then 1 else 2 end + 3 * case when y < 300 then 0 when y <= 500 then 1 else 2 end as region from p""")
def nine_grid(spark, sf_dir):
    third = lambda c, a, b: F.when(F.col(c) < a, 0).when(F.col(c) <= b, 1).otherwise(2)
    return points(spark, sf_dir).select("id", (third("x", 500, 700) + 3 * third("y", 300, 500)).alias("region"))


@query("""select conv_id, count(*) as texts, max(turn) as last_turn, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' order by turn, role, text) as label from conversations group by conv_id""")
def label_join(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", S.normalize_label(F.col("text")).alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "t")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("texts"), F.max("turn").alias("last_turn"), F.array_join(F.transform(parts, lambda s: s.getField("t")), " ").alias("label"))


@query("""select o_orderkey, trim(regexp_replace('  ' || o_orderstatus || chr(9) || '  ' || o_orderpriority || chr(10) || ' ', '\\s+', ' ', 'g')) as label from orders""")
def normalize_text(spark, sf_dir):
    padded = F.concat(F.lit("  "), "o_orderstatus", F.lit("\t  "), "o_orderpriority", F.lit("\n "))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.normalize_label(padded).alias("label"))


@query("""with t as (select l_orderkey, l_linenumber, l_quantity::int::varchar || ' ' || l_discount::varchar as s from lineitem where regexp_matches(l_quantity::int::varchar || ' ' || l_discount::varchar, '^[\\d.\\-]+\\s+[\\d.\\-]+'))
select l_orderkey, l_linenumber, unnest([0, 1]) as i, unnest(string_split(s, ' ')) as part, unnest([0.0, 50.0]) as x0 from t""")
def split_numbers(spark, sf_dir):
    text = F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), F.col("l_discount").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("s")).where(F.col("s").rlike(r"^[\d.\-]+\s+[\d.\-]+"))
    parts = F.split("s", " +")
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(parts).alias("i", "part"), F.size(parts).alias("n")).select("l_orderkey", "l_linenumber", "i", "part", (F.col("i") * 100.0 / F.col("n")).alias("x0"))


@query("""with k as (select p_partkey, p_partkey * 2654435 % 16777216 as v, p_partkey * 40503 % 16777216 as u from part),
  h as (select p_partkey, v, u, (v // 65536)::int as r, (v // 256 % 256)::int as g, (v % 256)::int as b, (u // 65536)::int as r2, (u // 256 % 256)::int as g2, (u % 256)::int as b2 from k)
select p_partkey, r, g, b, round(greatest(0.0, 1 - sqrt(pow(r - r2, 2) + pow(g - g2, 2) + pow(b - b2, 2)) / 441.67295593), 6) as similarity,
  greatest(abs(r - g), abs(r - b), abs(g - b)) <= 18 as achromatic from h""")
def hex_rgb(spark, sf_dir):
    code = lambda m: F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * m % 16777216)), 6, "0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", code(2654435).alias("a"), code(40503).alias("b"))
    a, b = S.hex_channels(F.col("a")), S.hex_channels(F.col("b"))
    return rows.select("p_partkey", *[c.alias(n) for c, n in zip(a, "rgb")], r6(S.rgb_similarity(a, b)).alias("similarity"), S.is_achromatic(a).alias("achromatic"))


@query("""with e as (select user_id, event_id, case when event_id - lag(event_id) over (partition by user_id order by event_id) > 40 then 1 else 0 end as new from events),
  i as (select *, sum(new) over (partition by user_id order by event_id rows unbounded preceding) as island from e)
select user_id, island, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from i group by user_id, island""")
def row_islands(spark, sf_dir):
    rows = C.islands(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 40)
    return rows.groupBy("user_id", "island").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"))


@query(f"""with {POINTS}, m as (select p.image_id, p.id, count(*) as n, count(*) filter (o.y < p.y or (o.y = p.y and o.id < p.id)) as r from p join p o on o.image_id = p.image_id and abs(o.x - p.x) <= 14 group by p.image_id, p.id)
select image_id, id, greatest(0, least(3, case when n = 4 then r else round_even(r * 3.0 / greatest(n - 1, 1), 0) end))::int as rank_group from m where n >= 2""")
def x_rank(spark, sf_dir):
    return M.band_rank(points(spark, sf_dir), 4, 14.0).select("image_id", "id", "rank_group")


@query()
def kmeans_1d(spark, sf_dir):
    return M.kmeans_1d(points(spark, sf_dir).withColumn("weight", F.lit(1.0)), 4)


@query()
def trajectory(spark, sf_dir):
    # the hypotheses are all pairs of an image's points: one image has 30
    rows = points(spark, sf_dir).withColumn("image_id", F.floor(F.col("id") / 30))
    return M.trajectories(rows, 3)


@query(f"with {CURVES} select curve_id, round(regr_slope(y, x / 86400), 6) as slope, round(regr_intercept(y, x / 86400), 5) as intercept from c group by curve_id")
def ols_line(spark, sf_dir):
    x = F.col("x") / 86400
    return curves(spark, sf_dir).groupBy("curve_id").agg(r6(F.regr_slope("y", x)).alias("slope"), F.round(F.regr_intercept("y", x), 5).alias("intercept"))


_STYLES = ("solid", "dashed", "dotted", "unknown")
_SCORES = """n as (select n_nationkey as id, n_nationkey * 37 % 256 as r, n_nationkey * 91 % 256 as g, n_nationkey * 53 % 256 as b, ['solid', 'dashed', 'dotted', 'unknown'][1 + n_nationkey % 4] as st from nation),
  q as (select r_regionkey as id, r_regionkey * 101 % 256 as r, r_regionkey * 67 % 256 as g, r_regionkey * 29 % 256 as b, ['solid', 'dashed', 'dotted', 'unknown'][1 + r_regionkey % 4] as st from region),
  s as (select q.id as left_id, n.id as right_id, greatest(0.0, 1 - sqrt(pow(n.r - q.r, 2) + pow(n.g - q.g, 2) + pow(n.b - q.b, 2)) / 441.67295593) as color,
    case when q.st = 'unknown' or n.st = 'unknown' then 0.45 when q.st = n.st then 1.0 when q.st in ('dashed', 'dotted') and n.st in ('dashed', 'dotted') then 0.65 else 0.20 end as style,
    greatest(0.0, 1.0 - abs(q.id - n.id) / 24.0) as ordinal from q cross join n)"""


def _scores(spark, sf_dir):
    def side(name, key, m):
        k = F.col(key)
        style = F.element_at(F.array(*map(F.lit, _STYLES)), (k % 4 + 1).cast("int"))
        return table(spark, sf_dir, name).select(k.cast("long").alias(f"{name}_id"), style.alias(f"{name}_style"), *[(k * x % 256).cast("double").alias(f"{name}_{c}") for c, x in zip("rgb", m)])

    # a few prototypes against the targets of one image
    both = side("region", "r_regionkey", (101, 67, 29)).join(F.broadcast(side("nation", "n_nationkey", (37, 91, 53))))
    color = S.rgb_similarity([F.col(f"region_{c}") for c in "rgb"], [F.col(f"nation_{c}") for c in "rgb"])
    style = S.style_similarity(F.col("region_style"), F.col("nation_style"))
    ordinal = S.ordinal_similarity(F.col("region_id"), F.col("nation_id"), F.lit(5), F.lit(25))
    return both.select(F.col("region_id").alias("left_id"), F.col("nation_id").alias("right_id"), color.alias("color"), style.alias("style"), ordinal.alias("ordinal"))


@query(f"with {_SCORES} select left_id, right_id, round(0.6 * color + 0.25 * style + 0.15 * ordinal, 6) as score from s")
def bind_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("left_id", "right_id", r6(0.6 * F.col("color") + 0.25 * F.col("style") + 0.15 * F.col("ordinal")).alias("score"))


@query(f"""with recursive {_SCORES}, o as (select left_id, right_id, score, row_number() over (order by score desc, left_id, right_id) as k from (select left_id, right_id, round(0.6 * color + 0.25 * style + 0.15 * ordinal, 6) as score from s)),
  g as (select 0::bigint as k, []::bigint[] as ls, []::bigint[] as rs, false as ok
    union all select o.k, case when list_contains(ls, left_id) or list_contains(rs, right_id) then ls else list_append(ls, left_id::bigint) end, case when list_contains(ls, left_id) or list_contains(rs, right_id) then rs else list_append(rs, right_id::bigint) end,
      not (list_contains(ls, left_id) or list_contains(rs, right_id)) from g join o on o.k = g.k + 1)
select left_id, right_id, score from g join o using (k) where ok""")
def bind_greedy(spark, sf_dir):
    pairs = bind_scores(spark, sf_dir).withColumn("image_id", F.lit(0).cast("long"))
    return M.greedy_match(pairs).select("left_id", "right_id", "score")


@query()
def nms(spark, sf_dir):
    return M.suppress(boxes(spark, sf_dir)).select("image_id", "id", "score")


@query()
def palette_merge(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select((k % 50).alias("image_id"), k.alias("id"), (k * 37 % 256).cast("double").alias("l"), (k * 91 % 256).cast("double").alias("a"), (k * 53 % 256).cast("double").alias("b"), (k * 17 % 997 + 1).cast("double").alias("area"))
    found = M.merge_palette(rows)
    return found.select("image_id", "color", *[r6(c).alias(c) for c in ("l", "a", "b", "area")], "n")


_MASKS = f"""{POINTS}, u as (select distinct floor(x / 20)::bigint as x, floor(y / 20)::bigint as y, image_id % 2 as side, image_id // 2 as image_id from p), a as (select * from u where side = 0), t as (select * from u where side = 1)"""


def _masks(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    pixel = lambda m: m.select("image_id", F.floor(F.col("x") / 20).alias("x"), F.floor(F.col("y") / 20).alias("y"))
    return pixel(a), pixel(b)


def _mask_sql(near: str) -> str:
    return f"""with {_MASKS}, hp as (select image_id, count(*) as n from a where exists (select 1 from t where t.image_id = a.image_id and {near}) group by image_id),
  ht as (select image_id, count(*) as n from t where exists (select 1 from a where a.image_id = t.image_id and {near}) group by image_id),
  m as (select image_id, pc, tc, coalesce(hp.n, 0) as h1, coalesce(ht.n, 0) as h2 from (select image_id, count(*) as pc from a group by image_id) full join (select image_id, count(*) as tc from t group by image_id) using (image_id) left join hp using (image_id) left join ht using (image_id))
select image_id, pc as pred_count, tc as truth_count, round(h1 / pc, 6) as precision, round(h2 / tc, 6) as recall, round(2 * (h1 / pc) * (h2 / tc) / nullif(h1 / pc + h2 / tc, 0), 6) as f1, round(h1 / (pc + tc - h1), 6) as iou from m"""


def _masked(spark, sf_dir, tolerance):
    found = M.mask_metrics(*_masks(spark, sf_dir), tolerance)
    return found.select("image_id", "pred_count", "truth_count", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query(_mask_sql("a.x = t.x and a.y = t.y"))
def mask_metrics(spark, sf_dir):
    return _masked(spark, sf_dir, 0)


@query(_mask_sql("abs(a.y - t.y) <= 2 and abs(a.x - t.x) <= case when abs(a.y - t.y) = 2 then 0 else 2 end"))
def mask_tolerant(spark, sf_dir):
    return _masked(spark, sf_dir, 2)


_CLASS = "case when l_quantity >= 35 then 'line_like' when l_quantity >= 10 then 'marker_like' else 'noise' end"


@query(f"""select l_suppkey, count(*) as n, count(*) filter ({_CLASS} = 'line_like') as line_like, count(*) filter ({_CLASS} = 'marker_like') as marker_like, count(*) filter ({_CLASS} = 'noise') as noise,
  min(l_quantity) as x0, max(l_quantity) as x1, max(l_quantity) - min(l_quantity) + 1 as span from lineitem group by l_suppkey""")
def component_summary(spark, sf_dir):
    q = F.col("l_quantity")
    kind = F.when(q >= 35, "line_like").when(q >= 10, "marker_like").otherwise("noise")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), *[F.count_if(kind == c).alias(c) for c in ("line_like", "marker_like", "noise")], F.min(q).alias("x0"), F.max(q).alias("x1"), (F.max(q) - F.min(q) + 1).alias("span"))


@query("""with l as (select l_orderkey, count(*) as points, count(*) filter (l_returnflag = 'R') as completed, sum(l_quantity) as observed from lineitem group by l_orderkey)
select o_orderkey, c_mktsegment, coalesce(points, 0) as points, round((points - completed) / nullif(observed, 0), 6) as coverage, round(completed / points, 6) as completed_ratio,
  case when points is null then 'no path' else '' end as warnings from orders left join customer on c_custkey = o_custkey left join l on l_orderkey = o_orderkey""")
def quality_row(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("p"), F.count_if(F.col("l_returnflag") == "R").alias("done"), F.sum("l_quantity").alias("seen"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left").join(lines, "o_orderkey", "left")
    return rows.select("o_orderkey", "c_mktsegment", F.coalesce("p", F.lit(0)).alias("points"), r6(S.safe_ratio(F.col("p") - F.col("done"), F.col("seen"))).alias("coverage"), r6(S.safe_ratio(F.col("done"), F.col("p"))).alias("completed_ratio"), F.when(F.col("p").isNull(), "no path").otherwise("").alias("warnings"))


@query(f"with {CURVES} select curve_id, seq, round(100.0 + x / 86400, 6) as px, round(750.0 - y, 6) as py from c where seq % 35 = 0")
def truth_markers(spark, sf_dir):
    rows = curves(spark, sf_dir).where(F.col("seq") % 35 == 0)
    return rows.select("curve_id", "seq", r6(100.0 + F.col("x") / 86400).alias("px"), r6(750.0 - F.col("y")).alias("py"))


# Bend centres of the default family of six curves (fixed values of the fixture's seed).
BENDS = (18.121886831901772, 17.584006357503803, 18.300180478322584, 18.376225886556487, 17.219585924538464, 17.479128197255072)


@query(f"""with g as (select i, k, k * 30.0 / 799 as x, [{', '.join(map(repr, BENDS))}][i + 1] as b from range(6) a(i) cross join range(800) t(k))
select i::int as curve, k, round(x, 6) as x, round(0.4 * sin(0.55 * x) + 0.07 * x + (0.18 + 0.04 * i) * sin(0.9 * x + i * 0.7) + 0.06 * cos(1.7 * x + i * 0.7 / 2) + i * 0.38
  + exp(-pow(x - 9.0, 2) / 18.0) * (0.25 - 0.04 * i) + 0.12 * exp(-pow(x - b, 2) / 2.5) * sin(2.5 + i), 6) as y from g""")
def synth_family(spark, sf_dir):
    rows = spark.range(6 * 800).select(F.floor(F.col("id") / 800).cast("int").alias("curve"), (F.col("id") % 800).alias("k"))
    x, i = F.col("k") * 30.0 / 799, F.col("curve")
    bend = F.element_at(F.array(*map(F.lit, BENDS)), i + 1)
    y = 0.4 * F.sin(0.55 * x) + 0.07 * x + (0.18 + 0.04 * i) * F.sin(0.9 * x + i * 0.7) + 0.06 * F.cos(1.7 * x + i * 0.7 / 2) + i * 0.38
    y = y + F.exp(-F.pow(x - 9.0, F.lit(2)) / 18.0) * (0.25 - 0.04 * i) + 0.12 * F.exp(-F.pow(x - bend, F.lit(2)) / 2.5) * F.sin(2.5 + i)
    return rows.select("curve", "k", r6(x).alias("x"), r6(y).alias("y"))


# stand-in: parts as pixels of images 60 wide and high, coloured by their keys

PIXELS = """px as (select p_partkey // 3600 as image_id, p_partkey % 60 as x, p_partkey // 60 % 60 as y, p_partkey * 37 % 256 as r, p_partkey * 101 % 256 as g, p_partkey * 53 % 256 as b from part),
 lin as (select image_id, x, y, [case when c / 255.0 <= 0.04045 then c / 255.0 / 12.92 else pow((c / 255.0 + 0.055) / 1.055, 2.4) end for c in [r::double, g::double, b::double]] as v from px),
 xyz as (select image_id, x, y, [(0.412453::double * v[1] + 0.357580::double * v[2] + 0.180423::double * v[3]) / 0.950456::double, 0.212671::double * v[1] + 0.715160::double * v[2] + 0.072169::double * v[3], (0.019334::double * v[1] + 0.119193::double * v[2] + 0.950227::double * v[3]) / 1.088754::double] as t from lin),
 roots as (select image_id, x, y, t[2] as w, [case when c > 0.008856 then pow(c, 1 / 3::double) else 7.787::double * c + 16 / 116::double end for c in t] as f from xyz),
 labs as (select image_id, x, y, case when w > 0.008856 then 116 * f[2] - 16 else 903.3::double * w end * 2.55::double as l, 500 * (f[1] - f[2]) + 128 as a, 200 * (f[2] - f[3]) + 128 as b2 from roots)"""


def lab_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 3600").alias("image_id"), (k % 60).alias("x"), F.expr("p_partkey div 60 % 60").alias("y"), (k * 37 % 256).alias("r"), (k * 101 % 256).alias("g"), (k * 53 % 256).alias("b"))
    return K.with_lab(rows)


@query(f"with {PIXELS} select image_id, x, y, round(l, 6) as l, round(a, 6) as a, round(b2, 6) as b2 from labs")
def lab_colors(spark, sf_dir):
    return lab_pixels(spark, sf_dir).select("image_id", "x", "y", r6("l").alias("l"), r6("a").alias("a"), r6("b2").alias("b2"))


@query(f"with {PIXELS} select image_id, count(*) as area, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from labs where abs(l - 140) <= 55 and sqrt((a - 128) * (a - 128) + (b2 - 140) * (b2 - 140)) <= 60 and not (x >= 20 and x < 30 and y >= 5 and y < 25) group by image_id")
def color_masks(spark, sf_dir):
    mask = K.exclude(K.color_mask(lab_pixels(spark, sf_dir), (140.0, 128.0, 140.0), 55.0, 60.0), [(20.4, 5.0, 30.9, 25.0)])
    return mask.groupBy("image_id").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query(f"with {PIXELS} select m.image_id, m.x, m.y from labs m where m.l > 120 and not exists (select 1 from labs d where d.l <= 80 and d.image_id = m.image_id and abs(d.x - m.x) + abs(d.y - m.y) <= 1)")
def dark_neighbors(spark, sf_dir):
    pixels = lab_pixels(spark, sf_dir)
    return K.suppress_dark(pixels.where("l > 120").select("image_id", "x", "y"), pixels)


@query(f"""with {PIXELS}, m as (select image_id, x, y from labs where l > 140)
select a.image_id, a.x, a.y, count(b.x) as degree, case count(b.x) when 0 then 'alone' when 1 then 'endpoint' when 2 then 'path' else 'junction' end as kind
from m a left join m b on a.image_id = b.image_id and b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1 and (a.x <> b.x or a.y <> b.y) group by all""")
def skeleton_nodes(spark, sf_dir):
    return K.skeleton_nodes(lab_pixels(spark, sf_dir).where("l > 140").select("image_id", "x", "y"))


@query()
def mask_components(spark, sf_dir):
    return K.keep_components(K.component_stats(K.label_components(lab_pixels(spark, sf_dir).where("l > 140"))), 60, 60, min_area=1, min_x_span=1)


@query()
def skeletons(spark, sf_dir):
    return K.skeleton(lab_pixels(spark, sf_dir).where("l > 60"))


# Each supplier has a drawn frame of 400 x 320 pixels with ticks; the SQL knows the frame from the key alone.


@query("""with k as (select s_suppkey as image_id, 40 + s_suppkey % 30 as x0, 20 + s_suppkey % 10 as y0, 380 - s_suppkey % 20 as x1, 300 - s_suppkey % 40 as y1 from supplier)
select image_id, x0 as x_min, y0 as y_min, x1 as x_max, y1 as y_max, round(0.75::double * ((x1 - x0) / 400.0::double + (y1 - y0) / 320.0::double) / 2 + 0.25::double * (x1 - x0) * (y1 - y0) / 128000, 6) as confidence from k""")
def detect_axes(spark, sf_dir):
    k = F.col("s_suppkey")
    box = table(spark, sf_dir, "supplier").select(k.alias("image_id"), (40 + k % 30).alias("x0"), (20 + k % 10).alias("y0"), (380 - k % 20).alias("x1"), (300 - k % 40).alias("y1"))

    def row(y: Column) -> Column:
        return F.transform(F.sequence(F.col("x0"), F.col("x1")), lambda x: F.struct(x.alias("x"), y.alias("y")))

    def column(x: Column) -> Column:
        return F.transform(F.sequence(F.col("y0"), F.col("y1")), lambda y: F.struct(x.alias("x"), y.alias("y")))

    ticks = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct((F.col("x0") + 60 * i).alias("x"), (F.col("y1") + 1).alias("y")))
    lines = [row(F.col("y0")), row(F.col("y1")), column(F.col("x0")), column(F.col("x1")), ticks]
    drawn = dealt(box, "image_id").select("image_id", F.explode(F.concat(*lines)).alias("p")).select("image_id", "p.x", "p.y", *(F.lit(20).alias(c) for c in "rgb"))
    found = A.detect_axes(box.select("image_id", F.lit(400).alias("width"), F.lit(320).alias("height")), drawn)
    return found.select("image_id", "x_min", "y_min", "x_max", "y_max", r6("confidence").alias("confidence"))


@query()
def traced_paths(spark, sf_dir):
    return K.trace_paths(K.prune_spurs(K.skeleton(lab_pixels(spark, sf_dir).where("l > 60"))))
