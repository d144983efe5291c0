"""Colour regions, prototypes, masks and legends on drawn images and against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright.operators import colors as H
from plotwright.operators import legends as L
from plotwright.operators import masks as K

RGB = "image_id long, x long, y long, r int, g int, b int"
PLOT = "image_id long, width int, height int, x_min double, y_min double, x_max double, y_max double"


def rows(image, rgb):
    ys, xs = np.nonzero((rgb != 255).any(axis=2))
    return [(image, int(x), int(y), *(int(v) for v in rgb[y, x])) for x, y in zip(xs, ys)]


def test_lab_goes_there_and_back(spark):
    r = random.Random(1)
    rgb = [(r.randrange(256), r.randrange(256), r.randrange(256)) for _ in range(300)] + [(0, 0, 0), (255, 255, 255)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(rgb)], "id long, r int, g int, b int")
    want = [[math.floor(v + 0.5) for v in (x.l, x.a, x.b2)] for x in K.with_lab(frame).orderBy("id").collect()]
    got = H.lab8(np.array(rgb))
    assert np.abs(got - np.array(want)).max() <= 1 and (got == np.array(want)).mean() > 0.999
    assert np.abs(H.rgb8(got) - np.array(rgb)).max() <= 12 and np.abs(H.rgb8(got) - np.array(rgb)).mean() < 1.5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grown_regions_equal_flooding(seed):
    r = np.random.default_rng(seed)
    lab = r.choice([100.0, 108.0, 118.0, 140.0], (14, 17, 3))
    excluded = np.zeros((14, 17), bool)
    excluded[2:5, 3:9] = True
    rule = H.Coloring(achromatic=False)
    got_lab, got_area = H.regions(lab, excluded, rule)
    done = (np.hypot(lab[..., 1] - 128, lab[..., 2] - 128) < 10) | (lab[..., 0] < 10) | (lab[..., 0] > 240) | excluded
    want = []
    for y in range(14):
        for x in range(17):
            if done[y, x]:
                continue
            todo, mine = [(y, x)], set()
            while todo:
                p = todo.pop()
                if 0 <= p[0] < 14 and 0 <= p[1] < 17 and p not in mine and max(abs(lab[p] - lab[y, x])) <= 15:
                    mine.add(p)
                    todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
            for p in mine:
                done[p] = True
            mean = np.mean([lab[p] for p in mine], axis=0)
            if len(mine) >= 2 and 10 <= mean[0] <= 240 and math.hypot(mean[1] - 128, mean[2] - 128) >= 10:
                want.append((len(mine), *mean))
    assert sorted(map(tuple, np.column_stack([got_area, got_lab]).round(6))) == sorted(tuple(np.round(x, 6)) for x in want)


def chart():
    rgb = np.full((200, 300, 3), 255)
    for x in range(25, 275):
        rgb[60 + round(10 * math.sin(x / 20)) + np.arange(3), x] = (200, 30, 30)
        rgb[130 + round(8 * math.cos(x / 25)) + np.arange(3), x] = (30, 60, 200)
        rgb[165:168, x] = (120, 120, 120)
    rgb[10:190, 20] = rgb[190, 20:281] = 0
    return rgb


def test_prototypes_and_masks_of_a_chart(spark):
    image = chart()
    pixels = spark.createDataFrame(rows(0, image) + rows(1, image[:5]), RGB).cache()
    plots = spark.createDataFrame([(0, 300, 200, 20.0, 10.0, 281.0, 190.0), (1, 300, 200, None, None, None, None)], PLOT)
    found = {(x.r > 150, x.b > 150, x.image_id): x for x in H.prototypes(pixels, plots).collect()}
    assert set(found) == {(True, False, 0), (False, True, 0), (False, False, 0)}
    red = found[True, False, 0]
    assert red.area == 750 and abs(red.r - 200) <= 12 and red.ratio == pytest.approx(750 / (255 * 174)) and red.confidence == 1.0
    protos = H.prototypes(pixels, plots)
    masks = H.prototype_masks(pixels, plots, protos, spark.createDataFrame([(0, 100.0, 0.0, 120.0, 100.0)], "image_id long, x_min double, y_min double, x_max double, y_max double"))
    info = {x.curve_id: x for x in H.mask_rows(masks, protos).collect()}
    assert info[red.curve_id].pixel_count == 3 * 230 and info[red.curve_id].x_min == 25.0 and info[red.curve_id].x_max == 274.0
    gray = found[False, False, 0]
    # the straight gray line looks like a grid line
    assert info[gray.curve_id].pixel_count == 0 and info[gray.curve_id].warnings == ["empty mask"]
    assert H.prototypes(pixels.limit(0), plots).count() == 0
    pale = spark.createDataFrame([(0, x, 50, 250, 250, 250) for x in range(30, 60)], RGB)
    assert H.prototypes(pale, plots).count() == 0


def test_finer_grays_where_a_legend_tells_them_apart(spark):
    rgb = np.full((120, 200, 3), 255)
    for k, v in enumerate((40, 110, 150, 190)):
        for x in range(10, 190):
            rgb[20 + 25 * k + round(4 * math.sin(x / 9)) + np.arange(3), x] = v
    pixels = spark.createDataFrame(rows(0, rgb), RGB)
    plots = spark.createDataFrame([(0, 200, 120, 0.0, 0.0, 200.0, 120.0)], PLOT)
    plain = H.prototypes(pixels, plots).count()
    levels = spark.createDataFrame([(0, float(v)) for v in (40, 115, 155, 195)], "image_id long, l double")
    found = H.guided_prototypes(pixels, plots, levels, 4).collect()
    assert plain < 4 <= len(found) and {x.source for x in found} == {"guided_gray"}
    assert H.guided_prototypes(pixels, plots, levels.limit(2), 4).count() == plain


def legend(rgb, x, y, items, frame=True):
    h = 16 * len(items) + 8
    if frame:
        rgb[y, x : x + 120] = rgb[y + h, x : x + 120] = 0
        rgb[y : y + h, x] = rgb[y : y + h, x + 119] = 0
    for k, (colour, style) in enumerate(items):
        top = y + 8 + 16 * k
        cols = [c for c in range(30) if style == "solid" or (style == "dashed" and c % 10 < 7) or (style == "dotted" and c % 6 < 3)]
        for c in cols:
            rgb[top : top + 3, x + 10 + c] = colour
        r = np.random.default_rng(k)
        word = r.random((8, 50)) < 0.5
        word[:, 0] = word[0, :] = True
        rgb[top - 3 : top + 5, x + 52 : x + 102][word] = 20


ITEMS = [((200, 30, 30), "solid"), ((30, 60, 200), "dashed"), ((20, 140, 30), "dotted")]


def test_a_framed_legend_and_its_items(spark):
    rgb = np.full((300, 500, 3), 255)
    legend(rgb, 40, 30, ITEMS)
    pixels = spark.createDataFrame(rows(0, rgb), RGB).cache()
    plots = spark.createDataFrame([(0, 500, 300, 20.0, 20.0, 480.0, 280.0)], PLOT)
    found = L.pixel_legends(pixels, plots).collect()
    # text and samples touch nothing, so the frame alone is one piece; it is thin but framed
    assert len(found) == 1 and (found[0].x_min, found[0].y_min, found[0].x_max) == (30.0, 20.0, 170.0)
    legends = L.merge_legends(spark.createDataFrame(found).unionByName(spark.createDataFrame(found).withColumn("confidence", F.lit(0.1))))
    assert legends.count() == 1
    exact = spark.createDataFrame([(0, 0, 40.0, 30.0, 160.0, 87.0)], "image_id long, legend_index int, x_min double, y_min double, x_max double, y_max double")
    read = L.legend_items(pixels, exact, plots).cache()
    items = read.orderBy("row").collect()
    assert [x.item_id for x in items] == [f"legend_00_item_0{k}" for k in range(3)]
    assert [x.line_style for x in items] == ["solid", "dashed", "dotted"]
    assert [(x.r, x.g, x.b) for x in items] == [c for c, _ in ITEMS] and all(x.text is not None and x.warnings == [] for x in items)
    assert items[0].sample[0] == 48.0 and items[0].sample[2] == 82.0
    words = spark.createDataFrame([(0, 2, "A ", 120.0, 34.0, 140.0, 42.0, 130.0, 38.0), (0, 1, " Curve", 92.0, 34.0, 118.0, 42.0, 105.0, 38.0), (0, 3, "  ", 92.0, 50.0, 118.0, 58.0, 105.0, 54.0)], "image_id long, id long, text string, x_min double, y_min double, x_max double, y_max double, cx double, cy double")
    labelled = L.assign_labels(read, words)
    named = labelled.orderBy("row").collect()
    assert [x.label for x in named] == ["Curve A", None, None] and named[1].warnings == ["legend_label_missing"]
    protos = L.visual_prototypes(labelled).orderBy("number").collect()
    assert [x.prototype_id for x in protos] == ["legend_proto_00", "legend_proto_01", "legend_proto_02"] and protos[0].label == "Curve A"


def test_an_open_legend_in_the_upper_right(spark):
    rgb = np.full((300, 500, 3), 255)
    legend(rgb, 360, 30, [*ITEMS, ITEMS[0]], frame=False)
    pixels = spark.createDataFrame(rows(0, rgb), RGB)
    plots = spark.createDataFrame([(0, 500, 300, 20.0, 20.0, 480.0, 280.0)], PLOT)
    found = L.pixel_legends(pixels, plots).collect()
    assert len(found) == 1 and found[0].x_min <= 370 and found[0].x_max >= 460 and found[0].y_max >= 70 + 10
    assert L.pixel_legends(pixels.limit(0), plots).count() == 0


def test_texts_in_rows_and_columns(spark):
    text = "image_id long, id long, x_min double, y_min double, x_max double, y_max double, cx double, cy double"
    box = lambda i, x, y, w=30, m=0: (m, i, float(x), float(y), float(x + w), float(y + 10), x + w / 2, y + 5.0)
    texts = spark.createDataFrame([box(0, 100, 50), box(1, 140, 52), box(2, 105, 90), box(3, 300, 150), box(4, 900, 10), *[box(10 + k, 100, 200 + 3 * k, m=1) for k in range(13)]], text)
    plots = spark.createDataFrame([(0, 0.0, 0.0, 400.0, 300.0), (1, 0.0, 0.0, 400.0, 300.0)], "image_id long, x_min double, y_min double, x_max double, y_max double")
    clusters = {x.id: x.cluster for x in L.text_clusters(texts.where("image_id = 0 and id < 4")).collect()}
    assert clusters == {0: 0, 1: 0, 2: 0, 3: 1}
    found = sorted(L.text_legends(texts, plots).collect(), key=lambda x: x.y_min)
    assert [(x.text_ids, x.confidence) for x in found] == [([0, 1, 2], pytest.approx(0.7)), ([3], pytest.approx(0.4))]
    assert (found[0].x_min, found[0].y_min, found[0].x_max, found[0].y_max) == (55.0, 40.0, 180.0, 110.0)


def test_marker_samples():
    mask = np.zeros((12, 40), bool)
    mask[2:9, 5:12] = True
    assert L.sample_marker_style(mask) == "single_compact" and L.sample_line_style(mask) == "unknown"
    mask[2:9, 20:27] = True
    assert L.sample_marker_style(mask) == "repeated_compact"
    assert L.sample_marker_style(mask & False) == "unknown" and L.sample_line_style(mask & False) == "unknown"
