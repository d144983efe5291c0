"""The registered queries of pieces, markers, legends, bindings and extraction; see ``queries`` for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import binding as B
from ..operators import colors as H
from ..operators import components as P
from ..operators import extraction as E
from ..operators import instances as I
from ..operators import legends as L
from ..operators import masks as K
from ..operators import quality as Q
from ..operators import segments as G
from .queries import CURVES, POINTS, curves, dealt, lab_pixels, points, query, r6, table

_PIECES = f"""{CURVES}, g as (select curve_id, seq // 40 as k, count(*) as n, min(x) / 600 as lo, max(x) / 600 as hi, list(x / 600 order by seq) as xs, list(y order by seq) as ys from c group by curve_id, seq // 40),
  s as (select curve_id, k, n, lo, hi, xs[1] as sx, ys[1] as sy, xs[n] as ex, ys[n] as ey, case when n < 2 then 1.0 else xs[least(6, n)] - xs[1] end as sdx, case when n < 2 then 0.0 else ys[least(6, n)] - ys[1] end as sdy,
    case when n < 2 then 1.0 else xs[n] - xs[greatest(1, n - 5)] end as edx, case when n < 2 then 0.0 else ys[n] - ys[greatest(1, n - 5)] end as edy from g)"""


def _turn(ax: str, ay: str, bx: str, by: str) -> str:
    n = f"(sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({bx} * {bx} + {by} * {by}))"
    return f"case when {n} = 0 then 0.0 else degrees(acos(greatest(-1.0, least(1.0, ({ax} * {bx} + {ay} * {by}) / {n})))) end"


@query(f"""with {_PIECES}, p as (select a.curve_id, a.k as a, b.k as b, b.sx - a.ex as dx, b.sy - a.ey as dy, a.edx, a.edy, b.sdx, b.sdy, greatest(0.0, a.hi - b.lo) as over_ from s a join s b on a.curve_id = b.curve_id and b.k = a.k + 1)
select curve_id, a, b, round(case when dx < -2 then null else sqrt(dx * dx + dy * dy) + 0.18 * {_turn('edx', 'edy', 'dx', 'dy')} + 0.12 * {_turn('dx', 'dy', 'sdx', 'sdy')} + 0.03 * {_turn('edx', 'edy', 'sdx', 'sdy')} + case when over_ > 0 then 20.0 else 0.0 end end, 4) as cost from p""")
def seg_cost(spark, sf_dir):
    rows = curves(spark, sf_dir).select(F.col("curve_id").alias("image_id"), F.floor(F.col("seq") / 40).alias("component"), "seq", (F.col("x") / 600).alias("x"), "y")
    parts = G.segments(rows)
    pairs = parts.select("image_id", F.col("component").alias("a"), (F.col("component") + 1).alias("b"))
    return G.costs(parts, pairs).select(F.col("image_id").alias("curve_id"), "a", "b", F.round("cost", 4).alias("cost"))


@query(f"""with {CURVES}, q as (select event_id, x / 60 - lag(x / 60) over o as dx, y - lag(y) over o as dy, lag(x / 60) over o - lag(x / 60, 2) over o as bx, lag(y) over o - lag(y, 2) over o as b_y, lead(x / 60) over o - x / 60 as ax, lead(y) over o - y as ay from c window o as (partition by curve_id order by seq)),
  r as (select *, sqrt(dx * dx + dy * dy) as far from q where dx is not null)
select event_id, coalesce(far > 1.5 and far <= 45 and dx >= -1 and abs(degrees(atan2(dy, case when dx = 0 then 1e-9 else dx end))) <= 60 and coalesce({_turn('bx', 'b_y', 'dx', 'dy')} <= 55, true) and coalesce({_turn('dx', 'dy', 'ax', 'ay')} <= 55, true), false) as accepted from r""")
def gap_accept(spark, sf_dir):
    w, c = Window.partitionBy("curve_id").orderBy("seq"), F.col
    rows = curves(spark, sf_dir).withColumn("x", c("x") / 60)
    step = lambda n, k: (c(n) - F.lag(n).over(w)) if k == 0 else (F.lag(n).over(w) - F.lag(n, 2).over(w)) if k < 0 else (F.lead(n).over(w) - c(n))
    rows = rows.withColumns({f"{v}{n}": step(n, k) for v, k in (("d", 0), ("b", -1), ("a", 1)) for n in "xy"}).where("dx is not null")
    return rows.select("event_id", G.gap_accepted(c("dx"), c("dy"), (c("bx"), c("by")), (c("ax"), c("ay"))).alias("accepted"))


@query("""with p as (select p_partkey, p_partkey * 37 % 101 / 100.0::double as f, p_partkey * 53 % 101 / 100.0::double as c, 1 + p_partkey * 17 % 40 / 20.0::double as a from part)
select p_partkey, case when a <= 1.18 and f >= 0.82 then 'square_like' when a <= 1.25 and c >= 0.72 then 'circle_like' when f <= 0.45 then 'cross_like' else 'unknown' end as shape,
  round(greatest(0.0, least(1.0, 0.25 + 0.35 * least(1.0, f) + 0.25 * least(1.0, c) + 0.15 * greatest(0.0, 1.0 - abs(a - 1.0)))), 6) as confidence from p""")
def marker_shapes(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, (k * 37 % 101 / 100.0).alias("f"), (k * 53 % 101 / 100.0).alias("c"), (1 + k * 17 % 40 / 20.0).alias("a"))
    return rows.select("p_partkey", S.marker_shape(F.col("f"), F.col("c"), F.col("a")).alias("shape"), r6(S.marker_confidence(F.col("f"), F.col("c"), F.col("a"))).alias("confidence"))


# stand-in: order lines as pieces of the images of their orders

PIECES = """p as (select l_orderkey, l_linenumber, l_quantity::bigint as w, (l_linenumber * 5)::bigint as h, (l_quantity + l_linenumber)::bigint - 1 as area from lineitem),
  d as (select *, greatest(w, h) as span, greatest(w, h) / greatest(least(w, h), 1)::double as aspect from p),
  e as (select *, w <= 18 and h <= 18 and aspect <= 1.8 as compact, area >= 40 or span >= 35 or (aspect > 1.8 and span >= 8) as anchor from d)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("image_id"), c("l_linenumber").alias("component"), c("l_quantity").cast("long").alias("width"), (c("l_linenumber") * 5).cast("long").alias("height"), ((c("l_quantity") + c("l_linenumber")).cast("long") - 1).alias("area"))
    return P.described(rows)


@query(f"""with {PIECES} select l_orderkey as image_id, l_linenumber as component, case when area <= 2 then 'noise' when anchor then 'line_like' when compact then 'marker_like' else 'noise' end as class_label,
  round(case when area <= 2 then 0.7 when anchor then least(1.0, 0.55 + span / 70.0) when compact then least(1.0, 0.55 + area / 40.0) else 0.45 end, 6) as confidence, not (area <= 2 or anchor or compact) as ambiguous from e""")
def component_classes(spark, sf_dir):
    return P.classified(pieces(spark, sf_dir)).select("image_id", "component", "class_label", r6("confidence").alias("confidence"), (F.size("warnings") > 0).alias("ambiguous"))


@query(f"""with {PIECES}, v as (select *, bool_or(anchor) over w as line, count(*) filter (not compact) over w as kept, count(*) over w as n from e window w as (partition by l_orderkey))
select l_orderkey as image_id, l_linenumber as component, case when line and kept > 0 then n - kept else 0 end as skipped from v where not (line and kept > 0) or not compact""")
def marker_filter(spark, sf_dir):
    return P.drop_marker_like(pieces(spark, sf_dir)).select("image_id", "component", "skipped")


@query("""with p as (select l_orderkey as image_id, l_linenumber as id, l_extendedprice / 150 as y from lineitem), m as (select *, count(*) over w as n, median(y) over w as m from p window w as (partition by image_id)),
  k as (select *, abs(y - m) <= 130 as near, count(*) filter (abs(y - m) <= 130) over (partition by image_id) as kept from m), t as (select *, n >= 4 and kept >= greatest(2, n // 3) as cut from k)
select image_id, id, case when cut then n - kept else 0 end as outliers from t where not cut or near""")
def y_outliers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("id"), (F.col("l_extendedprice") / 150).alias("center_y"))
    return I.trimmed(rows, ["image_id"]).select("image_id", "id", "outliers")


@query("""with s as (select l_orderkey as image_id, count(*) as n, count(*) filter (l_quantity >= 45) as long_, count(*) filter (l_quantity < 25) as short from lineitem group by l_orderkey)
select image_id, case when n = 0 then 'unknown' when long_ >= greatest(1, n // 3) then 'solid' when n >= 8 and short >= 0.6 * n then 'dotted' when n >= 3 then 'dashed' else 'unknown' end as style,
  case when n >= 16 then least(8, greatest(2, round_even(n / 18.0, 0)))::int else 1 end as groups from s""")
def line_styles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 45).alias("long_"), F.count_if(F.col("l_quantity") < 25).alias("short"))
    return rows.select("image_id", I.line_style(F.col("n"), F.col("long_"), F.col("short")).alias("style"), I.inferred_groups(F.col("n")).alias("groups"))


@query(f"""with {PIECES}, q as (select l_orderkey as image_id, l_linenumber as component, case when area <= 2 then 'noise' when anchor then 'line_like' when compact then 'marker_like' else 'noise' end as class_label, w, h, l_linenumber * 10 as y0, l_linenumber * 10 + h as y1 from e)
select image_id, component from q where not (class_label = 'line_like' and w >= 0.2 * 120 and h <= 8 and (abs(y0 - 15.0) <= 10 or abs(y1 - 90.0) <= 10))""")
def border_lines(spark, sf_dir):
    rows = P.classified(pieces(spark, sf_dir)).withColumns({"y0": F.col("component") * 10, "y1": F.col("component") * 10 + F.col("height")})
    plots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(0.0).alias("x_min"), F.lit(15.0).alias("y_min"), F.lit(120.0).alias("x_max"), F.lit(90.0).alias("y_max"))
    return I.drop_borders(rows, plots).select("image_id", "component")


@query("""with p as (select p_partkey, p_partkey * 37 % 997 as x, p_partkey * 53 % 499 as y, 20 + p_partkey % 180 as w, 20 + p_partkey % 90 as h, p_partkey * 7 % 211 / 4000.0::double + 0.004 as share, p_partkey * 11 % 307 / 1000.0::double + 0.025 as density, p_partkey % 101 / 100.0::double as frame from part)
select p_partkey, round(greatest(0.15, least(1.0, 0.35 + 0.30 * least(1.0, share / 0.05) + 0.20 * (1.0 - least(1.0, abs(density - 0.08) / 0.08)) + 0.15 * frame)), 6) as score,
  (x / 997.0::double <= 0.06 or (x + w) / 997.0::double >= 0.94) and (y / 499.0::double <= 0.06 or (y + h) / 499.0::double >= 0.94) as corner from p""")
def legend_scores(spark, sf_dir):
    k, c = F.col("p_partkey"), F.col
    rows = table(spark, sf_dir, "part").select(k, (k * 37 % 997).alias("x"), (k * 53 % 499).alias("y"), (20 + k % 180).alias("w"), (20 + k % 90).alias("h"), (k * 7 % 211 / 4000.0 + 0.004).alias("share"), (k * 11 % 307 / 1000.0 + 0.025).alias("density"), (k % 101 / 100.0).alias("frame"))
    return rows.select("p_partkey", r6(L.candidate_score(c("share"), c("density"), c("frame"))).alias("score"), L.near_corner(c("x"), c("y"), c("w"), c("h"), F.lit(997), F.lit(499)).alias("corner"))


# stand-in: ten suppliers as the items of an image's legend, 150 customers as its texts

_ITEMS = """i as (select s_suppkey // 10 as image_id, s_suppkey as item, 100.0 as x0, s_suppkey % 10 * 20.0 as y0, 180.0 as x1, s_suppkey % 10 * 20.0 + 15 as y1 from supplier),
  t as (select c_custkey // 150 as image_id, c_custkey as id, c_mktsegment as txt, 60.0 + c_custkey * 7 % 150 as x0, c_custkey * 13 % 210 * 1.0 as y0, 60.0 + c_custkey * 7 % 150 + 25 + c_custkey % 11 as x1, c_custkey * 13 % 210 + 9.0 as y1 from customer)"""


def _items(spark, sf_dir):
    c, k, s = F.col, F.col("c_custkey"), F.col("s_suppkey")
    items = table(spark, sf_dir, "supplier").select(F.floor(s / 10).alias("image_id"), s.cast("string").alias("item_id"), F.array(F.lit(100.0), s % 10 * 20.0, F.lit(180.0), s % 10 * 20.0 + 15).alias("text"), F.array().cast("array<string>").alias("warnings"))
    texts = table(spark, sf_dir, "customer").select(F.floor(k / 150).alias("image_id"), k.alias("id"), c("c_mktsegment").alias("text"), (60.0 + k * 7 % 150).alias("x_min"), (k * 13 % 210 * 1.0).alias("y_min"), (60.0 + k * 7 % 150 + 25 + k % 11).alias("x_max"), (k * 13 % 210 + 9.0).alias("y_max"))
    return items, texts.withColumns({"cx": (c("x_min") + c("x_max")) / 2, "cy": (c("y_min") + c("y_max")) / 2})


@query(f"""with {_ITEMS}, m as (select i.image_id, item, string_agg(txt, ' ' order by t.y0, t.x0, id) as label from i join t using (image_id)
  where ((t.x0 + t.x1) / 2 between i.x0 and i.x1 and (t.y0 + t.y1) / 2 between i.y0 and i.y1) or greatest(0.0, least(t.x1, i.x1) - greatest(t.x0, i.x0)) * greatest(0.0, least(t.y1, i.y1) - greatest(t.y0, i.y0)) / greatest(1.0, least((t.x1 - t.x0) * (t.y1 - t.y0), (i.x1 - i.x0) * (i.y1 - i.y0))) >= 0.2 group by i.image_id, item)
select i.image_id, i.item::varchar as item_id, label, case when label is null and exists (select 1 from t where t.image_id = i.image_id) then 'legend_label_missing' else '' end as warnings from i left join m using (image_id, item)""")
def legend_labels(spark, sf_dir):
    return L.assign_labels(*_items(spark, sf_dir)).select("image_id", "item_id", "label", F.array_join("warnings", " ").alias("warnings"))


# stand-in: the parts of five keys in a row as the prototypes, those of eight as the curves of an image

_BIND = """s as (select p_partkey as k, p_partkey // 5 as image_id, p_partkey % 5 as i, ['solid', 'dashed', 'dotted', 'unknown'][p_partkey % 4 + 1] as line, ['unknown', 'single_compact', 'circle_like'][p_partkey % 3 + 1] as mark, p_partkey * 37 % 256 as r, p_partkey * 91 % 256 as g, p_partkey * 53 % 256 as b, 0.5::double + p_partkey % 50 / 100.0::double as sure from part),
  v as (select p_partkey as k, p_partkey // 8 as image_id, p_partkey * 101 % 256 as r, p_partkey * 67 % 256 as g, p_partkey * 29 % 256 as b, 0.3::double + p_partkey % 70 / 100.0::double as seen, case when p_partkey % 2 = 0 then 'guided_gray' else 'direct' end as src, p_partkey % 7 as lines, p_partkey % 5 as marks, p_size % 4 as shapes from part),
  j as (select s.k as proto, v.k as target, line, mark, sure, seen, src, greatest(0.0, 1 - sqrt(pow(s.r - v.r, 2) + pow(s.g - v.g, 2) + pow(s.b - v.b, 2)) / 441.67295593::double) as color, greatest(abs(s.r - s.g), abs(s.r - s.b), abs(s.g - s.b)) <= 18 as gray,
    case when lines + marks = 0 then 0.0 when line = 'unknown' then case when lines > 0 then 0.5 else 0.25 end when line = 'solid' then case when lines > 0 then 1.0 else 0.25 end when marks > lines then 0.85 when lines + marks > 3 then 0.65 else 0.35 end::double as ls,
    case when shapes = 0 then 0.0 when mark = 'unknown' then 0.5 when shapes = 1 then 0.35 when shapes = 2 and mark = 'circle_like' then 1.0 when mark = 'single_compact' then 0.75 else 0.25 end::double as ms from s join v using (image_id)),
  w as (select *, gray and line <> 'unknown' and mark = 'unknown' as styled, seen < 0.8 as weak, seen < 0.8 and src = 'guided_gray' and color >= 0.85 and gray as spared from j)"""


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images to a prototype's key: a prototype meets the curves of the image of its number."""
    k, c = F.col("p_partkey"), F.col
    part = table(spark, sf_dir, "part")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    protos = part.select(F.floor(k / 5).alias("image_id"), (k % 5).cast("int").alias("number"), k.cast("string").alias("prototype_id"), k.cast("string").alias("legend_item_id"), pick(("solid", "dashed", "dotted", "unknown"), k % 4).alias("line_style"), pick(("unknown", "single_compact", "circle_like"), k % 3).alias("marker_style"), *[(k * m % 256).alias(n) for n, m in zip("rgb", (37, 91, 53))], (0.5 + k % 50 / 100.0).alias("confidence"))
    targets = part.select(F.floor(k / 8).alias("image_id"), k.cast("string").alias("curve_id"), *[(k * m % 256).alias(n) for n, m in zip("rgb", (101, 67, 29))], (0.3 + k % 70 / 100.0).alias("confidence"), F.when(k % 2 == 0, "guided_gray").otherwise("direct").alias("source"), (k % 7).alias("lines"), (k % 5).alias("marks"), (c("p_size") % 4).alias("shapes"))
    some = lambda n, label: targets.where(c(n) > 0).select("image_id", "curve_id", F.explode(F.array_repeat(F.lit(label), c(n).cast("int"))).alias("class_label"))
    marks = targets.where("shapes > 0").select("image_id", "curve_id", pick(("", "unknown", "circle_like", "square_like"), c("shapes")).alias("shape"))
    none = spark.createDataFrame([], "image_id long, instance_id string, center_y double, marker_count long, warnings array<string>, estimated_line_style string, confidence double")
    return B.scores(protos, targets, some("lines", "line_like").unionByName(some("marks", "marker_like")), marks, none, none)


@query(f"""with {_BIND}, z as (select *, (0.55 * color + 0.20 * ls + 0.25 * ms) * case when styled then 0.75 else 1.0 end * case when weak and not spared then greatest(0.25, seen) else 1.0 end as score from w)
select proto::varchar as prototype_id, target::varchar as target_id, round(score, 6) as score, round(least(1.0, score * sure), 6) as confidence, round(ls, 6) as line_similarity, round(ms, 6) as marker_similarity,
  styled::int + (weak and not spared)::int + spared::int + (mark = 'unknown')::int as warnings from z""")
def prototype_scores(spark, sf_dir):
    return _bindings(spark, sf_dir).select("prototype_id", "target_id", *[r6(n).alias(n) for n in ("score", "confidence", "line_similarity", "marker_similarity")], F.size("warnings").alias("warnings"))


@query()
def prototype_choice(spark, sf_dir):
    return B.best(_bindings(spark, sf_dir)).select("image_id", "prototype_id", "target_id", r6("score").alias("score"))


@query("""select o_orderkey, case when o_clerk_style in ('-', 'solid') then 'solid' when o_clerk_style in ('--', '-.', 'dashed') or o_clerk_style like '%5, 1%' then 'dashed' when o_clerk_style in (':', 'dotted') or o_clerk_style like '%1, 1%' then 'dotted' else 'unknown' end as style
from (select o_orderkey, ['-', '--', '-.', ':', '(0, (5, 1))', '(0, (1, 1))', 'None', 'solid'][o_orderkey % 8 + 1] as o_clerk_style from orders)""")
def truth_styles(spark, sf_dir):
    style = F.element_at(F.array(*map(F.lit, ("-", "--", "-.", ":", "(0, (5, 1))", "(0, (1, 1))", "None", "solid"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.truth_line_style(style).alias("style"))


_HEX = "'#' || lpad(lower(to_hex(p_partkey * 2654435 % 16777216)), 6, '0')"


@query(f"""with t as (select p_partkey // 6 as image_id, p_partkey as truth_id, p_partkey * 2654435 % 16777216 as v from part), q as (select p_partkey // 6 as image_id, p_partkey as curve_id, p_partkey * 37 % 256 as r, p_partkey * 91 % 256 as g, p_partkey * 53 % 256 as b from part),
  d as (select image_id, truth_id, curve_id, sqrt(pow(v // 65536 - r, 2) + pow(v // 256 % 256 - g, 2) + pow(v % 256 - b, 2)) as distance from t join q using (image_id)), n as (select *, row_number() over (partition by image_id, truth_id order by distance, curve_id::varchar) as k from d)
select truth_id::varchar as truth_id, curve_id::varchar as curve_id, round(distance, 6) as distance from n where k = 1""")
def color_match(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    truth = part.select(F.floor(k / 6).alias("image_id"), k.cast("string").alias("curve_id"), F.concat(F.lit("#"), F.lpad(F.lower(F.hex(k * 2654435 % 16777216)), 6, "0")).alias("color"))
    protos = part.select(F.floor(k / 6).alias("image_id"), k.cast("string").alias("curve_id"), *[(k * m % 256).alias(n) for n, m in zip("rgb", (37, 91, 53))])
    return Q.match_prototypes(truth, protos).select("truth_id", "curve_id", r6("distance").alias("distance"))


@query(f"""with {POINTS}, a as (select image_id // 2 as image_id, id, x, y from p where image_id % 2 = 0), t as (select image_id // 2 as image_id, id, x, y from p where image_id % 2 = 1),
  d as (select t.image_id, t.id as tid, a.id as aid, sqrt(pow(a.x - t.x, 2) + pow(a.y - t.y, 2)) as far from t join a using (image_id) where abs(a.x - t.x) <= 10 and abs(a.y - t.y) <= 10),
  n as (select *, row_number() over (partition by image_id, tid order by far, aid) as k from d where far <= 10), m as (select image_id, count(*) as mt, count(distinct aid) as mc from n where k = 1 group by image_id)
select image_id, tc as truth_count, ac as candidate_count, coalesce(mt, 0) as matched_truth, coalesce(mc, 0) as matched_candidates, round(coalesce(mt, 0) / tc, 6) as recall, round(coalesce(mc, 0) / ac, 6) as precision
from (select image_id, count(*) as tc from t group by image_id) join (select image_id, count(*) as ac from a group by image_id) using (image_id) left join m using (image_id)""")
def marker_recall(spark, sf_dir):
    rows = points(spark, sf_dir)
    half = lambda i: rows.where(F.col("image_id") % 2 == i).select(F.floor(F.col("image_id") / 2).alias("image_id"), "id", "x", "y")
    found = Q.marker_recall(half(0), half(1))
    return found.select("image_id", "truth_count", "candidate_count", "matched_truth", "matched_candidates", r6("recall").alias("recall"), r6("precision").alias("precision"))


@query("""select s_suppkey as image_id, 20.0 + s_suppkey % 9 + 8 as x_min, 10.0 + s_suppkey % 7 + 8 as y_min, least(150.0 + s_suppkey % 200, 20.0 + s_suppkey % 9 + 210) as x_max, least(90.0 + s_suppkey % 150, 10.0 + s_suppkey % 7 + 34 + 20 * n) as y_max
from supplier join (select l_suppkey, count(*) as n from lineitem group by l_suppkey) on l_suppkey = s_suppkey""")
def legend_exclusions(spark, sf_dir):
    k = F.col("s_suppkey")
    plots = table(spark, sf_dir, "supplier").select(k.alias("image_id"), (20.0 + k % 9).alias("x_min"), (10.0 + k % 7).alias("y_min"), (150.0 + k % 200).alias("x_max"), (90.0 + k % 150).alias("y_max"))
    return Q.legend_exclusions(plots, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"))).select("image_id", "x_min", "y_min", "x_max", "y_max")


@query("""select l_orderkey as image_id, l_linenumber as seq, l_returnflag = 'R' as completed, round(case when l_returnflag = 'R' then least(1 - l_discount, 0.35) else 1 - l_discount end, 6) as confidence from lineitem""")
def point_confidences(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), (F.col("l_returnflag") == "R").alias("completed"), "l_discount")
    return G.confidences(rows, 1 - F.col("l_discount")).select("image_id", "seq", "completed", r6("confidence").alias("confidence"))


@query("""with i as (select l_suppkey as image_id, l_linenumber as label, count(*) as n, least(1.0, count(*) / 8.0) as conf, case when l_linenumber % 2 = 0 then 'x_rank' else 'y_kmeans' end as how from lineitem group by l_suppkey, l_linenumber)
select image_id, count(*) as instances, sum(n)::bigint as members, round(avg(n), 6) as mean_members, round(avg(conf), 6) as mean_confidence, array_to_string(list_sort(list(distinct how)), ',') as methods from i group by image_id""")
def instance_summary(spark, sf_dir):
    n = F.count("*")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), "l_linenumber").agg(n.alias("n"), F.least(F.lit(1.0), n / 8.0).alias("confidence"), F.when(F.first(F.col("l_linenumber") % 2) == 0, "x_rank").otherwise("y_kmeans").alias("grouping_method"))
    found = I.instance_summary(rows, "n")
    return found.select("image_id", "instances", "members", r6("mean_members").alias("mean_members"), r6("mean_confidence").alias("mean_confidence"), F.array_join("methods", ",").alias("methods"))


@query(f"""with {POINTS}, n as (select id // 30 as image_id, count(*) as n from p group by id // 30) select image_id, n, case when n >= 16 then 2 else 1 end as groups from n""")
def marker_groups(spark, sf_dir):
    rows = points(spark, sf_dir).select(F.floor(F.col("id") / 30).alias("image_id"), "id", "x", "y", F.lit("a").alias("curve_id"))
    found = I.marker_instances(rows, tolerance=60.0)
    # every marker of a group by k-means has one; groups by rank leave lonely ones out, so their images are told by the groups alone
    n = rows.groupBy("image_id").agg(F.count("*").alias("n"))
    return n.join(found.groupBy("image_id").agg(F.count("*").cast("int").alias("groups")), "image_id").select("image_id", "n", "groups")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab_pixels(spark, sf_dir).where("l > 60").select("image_id", "x", "y")


@query()
def marker_spots(spark, sf_dir):
    return P.marker_candidates(_masks(spark, sf_dir), 60, 60).select("image_id", "id", "x", "y", "pixel_count", "shape", r6("confidence").alias("confidence"))


@query()
def line_pieces(spark, sf_dir):
    return P.line_components(K.prune_spurs(K.skeleton(_masks(spark, sf_dir)))).select("image_id", "component", "class_label", "area", "endpoints", "junctions", r6("path_length").alias("path_length"))


@query()
def whole_paths(spark, sf_dir):
    thin = K.prune_spurs(K.skeleton(_masks(spark, sf_dir)))
    found, _ = G.curve_paths(K.trace_paths(thin), thin)
    return found.select("image_id", "seq", "x", "y", "completed", "confidence")


# stand-in: each supplier's chart of 200 x 140 pixels, with axes and two wavy lines


def charts(spark: SparkSession, sf_dir: str, name: str = "supplier", key: str = "s_suppkey") -> tuple[DataFrame, DataFrame]:
    k, c = F.col(key).cast("long"), F.col
    images = dealt(table(spark, sf_dir, name).select(k.alias("image_id"), F.lit(200).alias("width"), F.lit(140).alias("height")), "image_id")
    at = images.select("image_id", F.explode(F.sequence(F.lit(10), F.lit(190))).alias("x"))
    line = lambda y, rgb: at.where("x >= 15 and x <= 185").select("image_id", "x", F.explode(F.array(*[F.bround(y).cast("int") + d for d in (-1, 0, 1)])).alias("y"), *[F.lit(v).alias(n) for n, v in zip("rgb", rgb)])
    axis = at.select("image_id", "x", F.lit(120).alias("y"), *[F.lit(0).alias(n) for n in "rgb"]).unionByName(images.select("image_id", F.lit(10).alias("x"), F.explode(F.sequence(F.lit(8), F.lit(119))).alias("y"), *[F.lit(0).alias(n) for n in "rgb"]))
    phase = c("image_id") % 7
    return images, axis.unionByName(line(40 + 9 * F.sin(c("x") / 14.0 + phase), (200, 30, 30))).unionByName(line(85 + 7 * F.cos(c("x") / 11.0 + phase), (30, 60, 200)))


def chart_axes_sql(value: str) -> str:
    return f"select s_suppkey as image_id, {value} from supplier"


@query(chart_axes_sql("true as axis_success, 10.0 as x_min_error, 0.0 as y_min_error, 0.0 as x_max_error, (s_suppkey % 3)::double as y_max_error, round((10.0 + s_suppkey % 3) / 4, 6) as mean_error, round(sqrt(100.0 + pow(s_suppkey % 3, 2)), 6) as origin_error"))
def axis_errors(spark, sf_dir):
    images, pixels = charts(spark, sf_dir)
    k = F.col("image_id")
    truth = images.select("image_id", F.lit(0.0).alias("x_min"), F.lit(8.0).alias("y_min"), F.lit(190.0).alias("x_max"), (120.0 + k % 3).alias("y_max"))
    from ..operators import axes as A

    found = Q.evaluate_axes(A.detect_axes(images, pixels), truth)
    return found.select("image_id", "axis_success", *[F.col(f"{b}_error").cast("double").alias(f"{b}_error") for b in Q.BOX], r6("mean_error").alias("mean_error"), r6("origin_error").alias("origin_error"))


_CHARTS = "select n_nationkey as image_id, {} from nation"


# the blue is dark enough to count among the dark pieces as well, and both are merged
@query(" union all ".join(_CHARTS.format(f"'{k}' as kind, {n}::bigint as area") for k, n in (("red", 513), ("blue", 2 * 513), ("dark", 293))))
def color_prototypes(spark, sf_dir):
    images, pixels = charts(spark, sf_dir, "nation", "n_nationkey")
    plots = images.select("*", *[F.lit(None).cast("double").alias(n) for n in Q.BOX])
    kind = F.when(F.greatest("r", "g", "b") < 60, "dark").when(F.col("r") > F.col("b"), "red").otherwise("blue")
    return H.prototypes(pixels, plots).select("image_id", kind.alias("kind"), "area")


@query(_CHARTS.format("true as axis_success, 2::bigint as curve_count, 2::bigint as paths_count, 0::bigint as legends_count, true as whole"))
def extraction(spark, sf_dir):
    images, pixels = charts(spark, sf_dir, "nation", "n_nationkey")
    found = E.extract(images, pixels, None, (0.0, 10.0), (0.0, 1.0))
    whole = (F.col("mean_path_coverage_ratio") > 0.85) & (F.col("data_points") >= 330)
    return found.report.select("image_id", "axis_success", "curve_count", "paths_count", "legends_count", whole.alias("whole"))
