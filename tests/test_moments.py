"""Cuts with carried state against a plain scan; plates, colours and samples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from burstlake.operators import moments


def distance(a, b):
    return min(1.0, max(0.0, 1 - sum(min(x, y) for x, y in zip(a, b, strict=True)) / 255))


def plain(rows, r):
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    out, state, n = {}, None, 0
    for seq, taken, box, scene, livery, pan in rows:
        subject = box if box and size(box) >= r.least_area else None
        cut = False
        if state:
            far = distance(livery, state["livery"]) if subject and livery and state["livery"] else None
            if r.pause > 0 and taken is not None and state["taken"] is not None and taken - state["taken"] > r.pause:
                cut = bool(scene and state["scene"] and distance(scene, state["scene"]) > r.scene) or (far is not None and far > r.pause_livery)
            if not cut and subject and state["last"]:
                a, b = state["last"], subject
                k = r.pan if pan and state["pan"] else 1.0
                shift = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) / math.sqrt(2)
                cut = max(size(a), size(b)) > r.scale * k * min(size(a), size(b)) or shift > r.shift * k or (far is not None and far > r.livery)
        if state is None or cut:
            n += cut
            state = {"last": subject, "livery": livery if subject else None, "pan": pan, "taken": taken, "scene": scene}
        else:
            if subject:
                state |= {"last": subject, "livery": livery, "pan": pan}
            state |= {"taken": taken, "scene": scene}
        out[seq] = n
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_moments_equal_a_plain_scan(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for burst in range(12):
        t, mine = 0.0, []
        for k in range(40):
            t += rng.choice([0.1, 0.5, 1.0, 2.0])
            x, w = rng.choice([0.1, 0.15, 0.5]), rng.choice([0.01, 0.2, 0.3, 0.5])
            box = (x, x, x + w, x + w) if rng.random() < 0.7 else None
            levels = lambda: rng.choice([[255, 0], [200, 55], [60, 195]]) if rng.random() < 0.8 else None
            mine.append((k, t if rng.random() < 0.9 else None, box, levels(), levels(), rng.random() < 0.5))
        rows += [(burst, *m) for m in mine]
        want |= {(burst, k): v for k, v in plain(mine, moments.Rules()).items()}
    schema = "burst long, seq long, taken double, box struct<x1:double,y1:double,x2:double,y2:double>, scene array<int>, livery array<int>, panning boolean"
    got = moments.split_moments(spark.createDataFrame(rows, schema).repartition(5))
    assert {(r["burst"], r["seq"]): r["moment"] for r in got.collect()} == want


def test_plates_join_groups_as_they_grow(spark):
    rows = [(1, 1, "car", ["AB0"], [1]), (1, 2, "car", ["ABO"], [2]), (1, 3, "car", ["ABQ"], [2]), (1, 4, "bike", ["AB0"], [9]), (1, 5, None, [], [5]), (1, 6, "car", ["XYZ"], [6])]
    df = spark.createDataFrame(rows, "album long, grp long, cls string, plates array<string>, frames array<long>")
    got = {r["grp"]: r["merged"] for r in moments.merge_on_plates(df, "album").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_colours_and_peaks(spark):
    row = spark.range(1).select(
        moments.hsv(F.lit("#ff0000")).alias("red"), moments.hsv(F.lit("#ff00ff")).alias("pink"), moments.hsv(F.lit("#808080")).alias("grey"), moments.hsv(F.lit("none")).alias("none"),
        moments.peak_frame(F.array(F.lit(0.2), F.lit(0.9)), 0.5).alias("peak"), moments.peak_frame(F.array(F.lit(0.9), F.lit(0.9)), 0.5).alias("tie"),
    )
    got = row.first()
    assert tuple(got["red"]) == (0.0, 1.0, 1.0) and got["pink"]["h"] == pytest.approx(5 / 6) and got["none"] is None
    assert got["peak"] == 1 and got["tie"] is None
    same = row.select(moments.same_swatch(F.col("red"), F.col("pink")).alias("a"), moments.same_swatch(F.col("red"), F.col("grey")).alias("b"), moments.same_swatch(F.col("red"), F.col("none")).alias("c")).first()
    assert tuple(same) == (False, False, True)
