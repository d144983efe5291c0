"""The registered queries of texts, regions, joined lines, levels and drawn charts; see ``queries`` for the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import families as W
from ..operators import axes as A
from ..operators import completion as C
from ..operators import readers as R
from ..operators import synthetic as Y
from .queries import CURVES, POINTS, curves, points, query, r6, table

_TEXTS = """t as (select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then l_quantity::int::varchar || ' ' || l_discount::varchar when l_linenumber % 3 = 1 then '--' else l_shipmode end as txt,
  l_orderkey % 50 * 1.0 as x0, l_linenumber * 10.0 as y0, l_orderkey % 50 + 10.0 + l_quantity as x1, l_linenumber * 10.0 + l_quantity % 30 as y1 from (select *, ['AIR', 'up-1 2', 'MAIL 3'][l_linenumber % 3 + 1] as l_shipmode from lineitem))"""


def texts(spark, sf_dir):
    c = F.col
    kind = c("l_linenumber") % 3
    said = F.when(kind == 0, F.concat_ws(" ", c("l_quantity").cast("int").cast("string"), c("l_discount").cast("string"))).when(kind == 1, "--").otherwise(F.element_at(F.array(F.lit("AIR"), F.lit("up-1 2"), F.lit("MAIL 3")), (kind + 1).cast("int")))
    x0, y0 = c("l_orderkey") % 50 * 1.0, c("l_linenumber") * 10.0
    x1, y1 = c("l_orderkey") % 50 + 10.0 + c("l_quantity"), y0 + c("l_quantity") % 30
    polygon = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    return R.boxed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", said.alias("text"), polygon.alias("polygon")))


@query(f"with {_TEXTS} select l_orderkey, l_linenumber, round((x0 + x1) / 2, 6) as cx, round((y0 + y1) / 2, 6) as cy from t where not (txt in ('-', '—', '--', '_') and (y1 - y0) / (x1 - x0 + 1e-6) > 0.6)")
def text_filters(spark, sf_dir):
    return R.filter_texts(texts(spark, sf_dir)).select("l_orderkey", "l_linenumber", r6("cx").alias("cx"), r6("cy").alias("cy"))


@query(f"""with {_TEXTS}, p as (select *, case when regexp_matches(txt, '^[\\d.\\-]+\\s+[\\d.\\-]+') then string_split(txt, ' ') else [txt] end as parts from t), e as (select *, unnest(parts) as part, unnest(range(len(parts))) as i, len(parts) as n from p)
select l_orderkey, l_linenumber, i::int as part, part as text, round(x0 + i * (x1 - x0) / n, 6) as x_min, round(x0 + (i + 1) * (x1 - x0) / n, 6) as x_max from e""")
def split_boxes(spark, sf_dir):
    return R.split_numbers(texts(spark, sf_dir)).select("l_orderkey", "l_linenumber", "part", "text", r6("x_min").alias("x_min"), r6("x_max").alias("x_max"))


@query("""with p as (select s_suppkey as k, 50 + s_suppkey % 40 as l, 20 + s_suppkey % 13 as t, 400 + s_suppkey % 60 as r, 250 + s_suppkey % 31 as b from supplier)
select k as image_id, 0 as region, l as x0, t as y0, r + 1 as x1, b + 1 as y1 from p union all select k, 1, 0, 0, l + 1, 300 from p union all select k, 2, 0, b, 500, 300 from p union all select k, 3, r, 0, 500, 300 from p union all select k, 4, 0, 0, 500, t + 1 from p""")
def plot_regions(spark, sf_dir):
    k = F.col("s_suppkey")
    plots = table(spark, sf_dir, "supplier").select(k.alias("image_id"), F.lit(500).alias("width"), F.lit(300).alias("height"), (50 + k % 40).alias("x_min"), (20 + k % 13).alias("y_min"), (400 + k % 60).alias("x_max"), (250 + k % 31).alias("y_max"))
    return C.region_bounds(C.regions(plots))


@query(f"""with {POINTS}, q as (select id // 40 as image_id, id % 256 as gray, count(*) as n from (select id, (id * 7919 + id // 3) % 1000 as k from p), range(3) group by id // 40, id % 256),
  a as (select *, sum(n) over o as w, sum(n * gray) over o as s, sum(n) over e as wt, sum(n * gray) over e as st from q window o as (partition by image_id order by gray), e as (partition by image_id)),
  b as (select *, case when wt = w then 0.0 else (w * (wt - w))::double * pow(s::double / w - (st - s)::double / (wt - w), 2) end as v from a), r as (select *, row_number() over (partition by image_id order by round(v, 3) desc, gray) as k from b)
select image_id, gray as threshold from r where k = 1""")
def otsu_levels(spark, sf_dir):
    rows = points(spark, sf_dir).select(F.floor(F.col("id") / 40).alias("image_id"), (F.col("id") % 256).alias("gray")).groupBy("image_id", "gray").agg((F.count("*") * 3).alias("n"))
    return A.otsu(rows)


@query(f"""with {CURVES}, k as (select event_id, x / 86400 as x, event_id % 4 as i from c)
select event_id, round(50 + 30 * sin(2 * pi() * case when x <= 60 then x / 60 when x <= 120 then 1 + 2 * (x - 60) / 60 else 5 + 4 * (x - 120) / 60 end), 6) as rising, round((20 + 5 * i) * sin((0.02 + 0.005 * i) * x + i * pi() / 2) + 20 * cos(0.01 * x), 6) as slow,
  round((30 + 10 * i) * sin((0.1 + 0.03 * i) * x + i * pi() / 2) * cos(0.015 * x) + 20 * sin(0.2 * x), 6) as beating, round((2000 + 500 * i) * sin((0.002 + 0.0005 * i) * x + i * 0.8) + 1000 * cos(0.001 * x), 5) as wide,
  round((0.8 + 0.4 * sin(i)) * sin(x + 0.8 * i), 6) as sine, round((0.8 + 0.4 * sin(i)) * cos(x + 0.8 * i) * exp(-(x + 0.8 * i) / 10), 6) as damped, round((0.8 + 0.4 * sin(i)) * (2 * sin(0.8 * (x + 0.8 * i)) + 0.5 * cos(3 * (x + 0.8 * i))), 6) as harmonics, round((0.8 + 0.4 * sin(i)) * sqrt(x + 0.8 * i) * sin(x + 0.8 * i), 6) as modulated from k""")
def wave_families(spark, sf_dir):
    rows = curves(spark, sf_dir).select("event_id", (F.col("x") / 86400).alias("x"), (F.col("event_id") % 4).alias("i"))
    x, i = F.col("x"), F.col("i")
    lines = {name: W.shifted_line(x, i, name) for name in W.LINES}
    return rows.select("event_id", r6(W.rising_frequencies(x)).alias("rising"), r6(W.slow_waves(x, i)).alias("slow"), r6(W.beating_waves(x, i)).alias("beating"), F.round(W.wide_waves(x, i), 5).alias("wide"), *[r6(v).alias(n) for n, v in lines.items()])


@query("""with g as (select i, k, k * 30.0 / 799 as x from range(6) a(i) cross join range(800) t(k))
select i::int as curve, k::int as point_index, round(x, 6) as x, round(2.05 + (i - 2.5) * 0.045 + [0.58, -0.50, 0.34, -0.30, 0.18, -0.16][i + 1] * (x - 15.0) / 6.0 + 0.08 * sin(0.7 * x + i * 0.9), 6) as y from g""")
def crossing_family(spark, sf_dir):
    _, found, rows = Y.truth(spark, [Y.Chart("c", crossing=True)])
    return rows.join(found.select("curve_id", F.col("number").alias("curve")), "curve_id").select("curve", "point_index", r6("x").alias("x"), r6("y").alias("y"))


# stand-in: ten parts in a row as the short lines of an image, a piece each on three rows


@query("""with p as (select p_partkey // 30 as image_id, p_partkey % 3 as row_, p_partkey % 30 // 3 as i from part), n as (select image_id, row_, min(i) as lo, max(i) as hi, count(*) as n from p group by image_id, row_)
select image_id, 'h' as way, lo * 60.0 as x0, row_ * 100.0 as y0, hi * 60.0 + 40 as x1, n::int as lines from n where hi * 60.0 + 40 - lo * 60.0 >= 50""")
def joined_lines(spark, sf_dir):
    k = F.col("p_partkey")
    i = F.floor(k % 30 / 3)
    rows = table(spark, sf_dir, "part").select(F.floor(k / 30).alias("image_id"), k.alias("id"), (i * 60.0).alias("x0"), (k % 3 * 100.0).alias("y0"), (i * 60.0 + 40).alias("x1"), (k % 3 * 100.0).alias("y1"))
    return C.connect_lines(rows).select("image_id", "way", "x0", "y0", "x1", "lines")


@query()
def end_matches(spark, sf_dir):
    rows = points(spark, sf_dir).select(F.floor(F.col("id") / 20).alias("image_id"), "id", F.floor(F.col("id") / 2).alias("piece"), "x", "y")
    return C.connect_ends(rows, 200.0).select("image_id", "a", "b", r6("distance").alias("distance"))
