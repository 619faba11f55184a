"""Ordered scans by ranges, and the whole regroup plan, against plain scans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.operators import evaluate, grouping, ranges, sequence
from burstlake.operators.moments import Rules
from burstlake.plans.regroup import SET_KEY_BASE, main_subjects, regroup, subject_keepers

NONE = float("nan")


def random_frames(rng, n, cameras=("c",), albums=(1,)):
    """Frames in streaks: brackets, stacks, even intervals, pauses of all lengths, boxes and looks that change now and then."""
    rows, clock, x, look = [], dict.fromkeys([(a, c) for a in albums for c in cameras], 1000.0), 0.2, 0
    step, kind = 1.0, 0
    for k in range(n):
        at = (rng.choice(albums), rng.choice(cameras))
        if rng.random() < 0.06:
            step, kind = rng.choice([0.3, 1.0, 2.0, 5.0, 15.0, 200.0]), rng.randrange(4)
        clock[at] += step * (1 if kind == 3 else rng.choice([0.5, 1, 1.2]))
        if rng.random() < 0.15:
            x, look = rng.random() * 0.6, rng.randrange(3)
        scene = [200 if j == look else 27 for j in range(3)] if rng.random() < 0.9 else None
        box = (x, 0.2, x + 0.3, 0.6) if rng.random() < 0.8 else (None,) * 4
        t = None if rng.random() < 0.02 else clock[at]
        rows.append((at[0], at[1], f"p{rng.randrange(50)}", k, t, rng.random() < 0.05, scene, scene if rng.random() < 0.6 else None, *box, rng.random() < 0.2, float(k % 4) if kind < 2 else 0.0, float(k % 9 + 1) if kind else 1.0, 50.0, 8.0, 0.01))
    return rows


SCHEMA = "album long, camera string, path string, " + grouping.READ


def plain_grouping(rows, gap, merge, rules):
    """The same, frame by frame, straight from the rules."""
    out = {}
    order = lambda r: (r[4] is None, r[4] or 0.0, r[2], r[3])
    far = lambda a, b: NONE if a is None or b is None else min(1.0, max(0.0, 1 - sum(map(min, a, b)) / 255))
    size = lambda b: 0.0 if b is None else max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0)

    def jump(a, b, scale, shift):
        moved = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) / math.sqrt(2)
        return max(size(a), size(b)) / min(size(a), size(b)) > scale or moved > shift

    for key in {(r[0], r[1]) for r in rows}:
        before = group = began = moment = None
        for r in sorted((r for r in rows if (r[0], r[1]) == key), key=order):
            t, portrait, scene, livery, box, pan = r[4], r[5], r[6], r[7], None if r[8] is None else r[8:12], r[12]
            new = before is None or t is None or before[4] is None or t - before[4] > gap
            joins = False
            if new and merge and before is not None and t is not None and before[4] is not None:
                old = None if before[8] is None else before[8:12]
                joins = t - before[4] <= 10 and portrait == before[5] and far(scene, before[6]) <= 0.12 and not far(livery, before[7]) > 0.5 and t - began <= 30
                joins = joins and not (old and box and jump(old, box, 4.5, 0.45))
            if new and not joins:
                group, began, moment = r[3], t, None
            boxed = box if size(box) >= rules.least_area else None
            stays = moment is not None
            if stays:
                _, last, last_livery, last_pan = moment
                if rules.pause > 0 and t is not None and before[4] is not None and t - before[4] > rules.pause and (far(scene, before[6]) > rules.scene or (boxed and far(livery, last_livery) > rules.pause_livery)):
                    stays = False
                elif boxed and last:
                    k = rules.pan if last_pan and pan else 1.0
                    stays = not jump(last, boxed, rules.scale * k, rules.shift * k) and not far(livery, last_livery) > rules.livery
            if not stays:
                moment = [r[3], None, None, False]
            if boxed:
                moment[1:] = [boxed, livery, pan]
            before = r
            out[r[3]] = (new, group, moment[0])
    return out


def test_one_pass_equals_a_plain_scan_however_it_is_split(spark):
    rng = random.Random(31)
    rows = random_frames(rng, 500)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = plain_grouping(rows, 1.5, True, Rules())
    whole = None
    for n in [1, 3, 40, *rng.sample(range(4, 120), 2)]:
        got = {r["frame_id"]: tuple(r) for r in grouping.grouped(df, ranges=n).collect()}
        assert {k: (v[2], v[4], v[5]) for k, v in got.items()} == plain
        whole = whole or got
        assert got == whole  # with its sets
    assert len({v[7] for v in whole.values()}) >= 3 and len({v[5] for v in whole.values()}) > len({v[4] for v in whole.values()}) > 5
    several = random_frames(rng, 300, ("a", "b", None), (1, 2))
    df = spark.createDataFrame(several, SCHEMA)
    got = {r["frame_id"]: (r["begins"], r["grp"], r["moment"]) for r in grouping.grouped(df, gap=3.0, keep_sets=False, ranges=9).collect()}
    assert got == plain_grouping(several, 3.0, True, Rules())


def test_sets_of_one_camera_do_not_depend_on_the_ranges(spark):
    rng = random.Random(32)
    t, rows = 0.0, []
    for k in range(400):
        t += rng.choice([0.4, 0.5, 1.0, 1.0, 1.0, 3.0] if k % 50 else [500.0])
        rows.append(("c", k, None if k % 97 == 5 else t, float(rng.choice([k % 3, k % 5])) if k % 13 else None, float(k % 17), 50.0 if k % 30 else 70.0))
    rows += [("c", 1000 + k, 5000.0 + k, None, None, None) for k in range(200)]  # one interval, longer than most ranges
    df = spark.createDataFrame(rows, "camera string, frame_id long, taken double, ev double, focus double, focal double")
    want = sorted(tuple(r) for r in sequence.sets(df, ranges=1).select("frame_id", "set_id", F.coalesce("set_kind", F.lit(""))).fillna(-1).collect())
    assert {w[2] for w in want} == {"", "bracket", "stack", "interval"} and sum(w[1] == 1000 for w in want) == 200
    for n in (2, 7, 60):
        assert sorted(tuple(r) for r in sequence.sets(df, ranges=n).select("frame_id", "set_id", F.coalesce("set_kind", F.lit(""))).fillna(-1).collect()) == want


def test_bursts_of_one_camera_are_joined_by_ranges(spark):
    rng = random.Random(33)
    t, rows = 0.0, []
    for k in range(300):
        t += rng.choice([1.0, 3.0, 12.0])
        rows.append((rng.choice(["c", "c", "c", None]), k, t, t + 1.0, rng.randrange(3)))
    want, open_, last = {}, {}, {}
    for camera, k, start, end, n in rows:
        joins = camera in last and 0 <= start - last[camera][0] <= 10 and abs(last[camera][1] - n) <= 1
        if not joins or start - open_[camera][1] > 30:
            open_[camera] = (k, start)
        want[k], last[camera] = open_[camera][0], (end, n)
    df = spark.createDataFrame(rows, "camera string, burst long, started double, ended double, n long")
    for n in (1, 5, 50):
        got = {r["burst"]: r["merged"] for r in sequence.merge_bursts(df, "camera", F.abs(F.col("a.n") - F.col("b.n")) <= 1, ranges=n).collect()}
        assert got == want


def test_spaced_places_by_ranges(spark):
    rng = random.Random(34)
    places = sorted(rng.sample(range(2000), 700))
    want, last = [], None
    for p in places:
        if last is None or p - last >= 7:
            want.append(p)
            last = p
    df = spark.createDataFrame([("g", p) for p in places], "g string, p long")
    for n in (1, 4, 30):
        assert sorted(r["p"] for r in evaluate.spaced(df, "g", "p", 7, ranges=n).collect()) == want


def test_what_is_open_goes_through_all_ranges(spark):
    class Running:
        """Never begins afresh, so that every range depends on the one before it."""

        def __init__(self):
            self.total = 0

        def restarts(self, rows, before):
            return np.zeros(len(rows), bool)

        def step(self, rows, last):
            sums = self.total + rows["v"].cumsum()
            if len(rows):
                self.total = int(sums.iat[-1])
            yield rows.assign(total=sums)

        def held(self):
            return self.total or None

    rows = [("a" if k < 30 else None, k, 1 if k % 3 else 0) for k in range(60)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    schema = spark.createDataFrame([], "k string, at long, v long, total long").schema
    got = {r["at"]: r["total"] for r in ranges.scanned(df, [F.col("k")], [F.col("at")], Running, schema, 6).collect()}
    want = {at: sum(v for k2, b, v in rows if k2 == k and b <= at) for k, at, _ in rows}
    assert got == want
    assert ranges.scanned(df.limit(0), [F.col("k")], [F.col("at")], Running, schema, 6).collect() == []


@pytest.fixture
def album(spark):
    frame = "id long, job_id long, path string, status string, camera string, taken_at double, width double, height double, rating double, sharpness double, stars long, rejected long, copy_of long, burst_key long, time_burst long, burst_pick long, set_id long, set_kind string, scene array<int>, livery array<int>, exposure_time double, focus_distance double, af_x1 double, af_y1 double, af_x2 double, af_y2 double"
    red, blue = [255, 0], [0, 255]
    row = lambda i, cam, t, scene, rating=0.8, **k: (i, k.get("job", 1), f"p{i}", k.get("status", "done"), cam, t, 100.0, 80.0, rating, None, k.get("stars"), None, k.get("copy"), 9, 9, 9, 9, "x", scene, scene, None, None, *k.get("af", (None,) * 4))
    frames = [
        row(1, "b", 10.0, red), row(2, "b", 10.5, red, 0.9), row(3, "b", 14.0, red), row(4, "b", 15.2, blue),  # 3 joins the first session; 4 is another moment of it
        row(5, "a", 20.0, red), row(6, "a", None, red), row(7, "a", 20.2, red, copy=5), row(8, "a", 20.3, red, status="error"), row(9, "b", 10.2, red, job=2, stars=4, rating=0.1), row(10, "b", 60.0, None, af=(0.1, 0.1, 0.4, 0.4)),
    ]
    subject = "id long, image_id long, x1 double, y1 double, x2 double, y2 double, region_type string, panning long, bystander long, af_bystander long, rating double, sharpness double, stars long, rejected long, group_key long"
    boxes = [(100 + i, i, 10.0, 10.0, 50.0, 50.0, "vehicle", 0, 0, 0, 0.75 + i / 25, None, None, 0, 1 if i < 5 else None) for i in (1, 2, 3, 4, 5, 6, 9)]
    boxes += [(201, 1, 0.0, 0.0, 90.0, 70.0, "person", 1, 1, 0, 0.99, None, None, 0, 2), (202, 2, 20.0, 20.0, 30.0, 30.0, "person", 1, 0, 0, 0.99, None, None, 0, None)]
    return spark.createDataFrame(frames, frame), spark.createDataFrame(boxes, subject)


def test_a_whole_album_is_regrouped(spark, album):
    frames, subjects = album
    found = regroup(main_subjects(frames, subjects), ranges=4)
    got = {r["id"]: (r["time_burst"], r["burst_key"], r["burst_pick"]) for r in found.collect()}
    # camera a comes first by name; keys follow time, with untimed frames at 0
    assert got == {1: (3, 2, None), 2: (3, 2, 1), 3: (3, 2, None), 4: (3, 3, 1), 5: (1, 4, 1), 6: (2, 1, 1), 7: (None,) * 3, 8: (None,) * 3, 9: (1, 1, 1), 10: (5, 5, 1)}
    apart = {r["id"]: (r["time_burst"], r["burst_key"]) for r in regroup(main_subjects(frames, subjects), merge=False).collect()}
    assert apart[3] == (4, 3) and apart[4][0] == 4
    alone = {r["id"]: (r["burst_key"], r["burst_pick"]) for r in regroup(frames, stacks=False).collect()}
    assert alone == {6: (1, 0), 1: (2, 0), 2: (3, 0), 3: (4, 0), 4: (5, 0), 5: (6, 0), 10: (7, 0), 9: (1, 0), 7: (None, None), 8: (None, None)}
    assert {r["id"]: r["box"] is not None for r in main_subjects(frames, subjects, False).collect()}[10] is False


def test_keepers_of_subjects(spark, album):
    frames, subjects = album
    found = regroup(main_subjects(frames, subjects))
    got = {r["id"]: r["burst_pick"] for r in subject_keepers(found, subjects).collect()}
    # 103 is the best of group 1 in its burst, 104 in its own; 202 is ungrouped beside a grouped pick; the bystander 201 does not compete
    assert got == {101: None, 102: None, 103: 1, 104: 1, 105: 1, 106: 1, 109: 1, 201: None, 202: None}


def test_sets_have_keys_of_their_own_over_moments(spark, album):
    frames = album[0].where("id < 4").withColumns({"taken_at": F.col("id") / 2, "exposure_time": F.pow(F.lit(2.0), F.col("id").cast("double"))})
    got = {r["id"]: (r["burst_key"], r["time_burst"], r["set_id"], r["set_kind"]) for r in regroup(frames).collect()}
    assert got == {k: (SET_KEY_BASE + 1, 1, 1, "bracket") for k in (1, 2, 3)}


def test_keepers_follow_stars_and_bands_alone(spark):
    # 0.725 and 0.73 lie in one band of ratings on both sides of the score that makes a row eligible: of equals the first wins
    frames = spark.createDataFrame([(1, 1, "a", "1", "done", 0, 0.725, None, 3, 0), (2, 1, "a", "2", "done", 0, 0.73, None, 3, 0)], "id long, job_id long, camera string, path string, status string, copy_of long, rating double, sharpness double, stars long, rejected long").withColumns({"taken_at": F.col("id") / 10, **{c: F.lit(None).cast("long") for c in ("burst_key", "burst_pick", "time_burst", "set_id")}, "set_kind": F.lit(None).cast("string")})
    made = regroup(frames)
    assert {r["id"]: (r["burst_key"], r["burst_pick"]) for r in made.collect()} == {1: (1, 1), 2: (1, None)}
    subjects = spark.createDataFrame([(10, 1, 0.725, None, 3, 0, 0, 5), (11, 2, 0.73, None, 3, 0, 0, 5)], "id long, image_id long, rating double, sharpness double, stars long, rejected long, bystander long, group_key long").withColumn("burst_pick", F.lit(None).cast("int"))
    assert {r["id"]: r["burst_pick"] for r in subject_keepers(made, subjects).collect()} == {10: 1, 11: None}
