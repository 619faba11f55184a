"""Near plates by masked keys against the comparison of all, and readings of all kinds of values."""

import json
import random
from itertools import product

from pyspark.sql import functions as F

from burstlake.functions.text import CONFUSABLE
from burstlake.operators import registry


def near(a, b):
    differing = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return len(a) == len(b) and len(differing) == 1 and any(set(differing[0]) <= set(c) for c in CONFUSABLE)


def test_near_plates_meet_by_their_keys(spark):
    rng = random.Random(41)
    plates = sorted({"".join(rng.choice("047OQ8BX1CG6") for _ in range(rng.choice([2, 3]))) for _ in range(250)} | {"", "Z", "2"})
    df = spark.createDataFrame([(p,) for p in plates] + [(None,), ("Z",)], "plate string")
    got = sorted(tuple(r) for r in registry.near_plates(df, df).collect())
    assert got == sorted((a, b) for a, b in product(plates, plates) if near(a, b))


def test_values_that_say_something(spark):
    said = {"a": " x ", "b": ["y", "", None, 0, 5, [1]], "c": 0, "d": False, "e": True, "f": 2.5, "g": None, "h": {"k": 1}, "i": {}, "j": "   "}
    df = spark.createDataFrame([(json.dumps(said),), ("[1, 2]",), ("no json",), (None,)], "t string")
    got = df.select(*[registry.field_values(registry.attributes_of(F.col("t")), f).alias(f) for f in said], registry.string_of(registry.attributes_of(F.col("t")), "a").alias("s"), registry.string_of(registry.attributes_of(F.col("t")), "f").alias("n")).collect()
    first = got[0].asDict()
    assert {k: first[k] or [] for k in said} == {"a": ["x"], "b": ["y", "5", "[1]"], "c": [], "d": [], "e": ["True"], "f": ["2.5"], "g": [], "h": ['{"k":1}'], "i": [], "j": [""]}
    assert first["s"] == " x " and first["n"] is None
    assert all(not r[f] for r in got[1:] for f in said)


def test_readings_fill_the_registry(spark):
    row = lambda i, group, plate, number=None, **a: (i, 1, group, plate, json.dumps(a), number)
    rows = [
        row(1, 7, "ab 1o", colour="red"), row(2, 7, "AB10", colour=["blue"], sponsors=["S1", "S2"], make="M"), row(3, 7, "AB10", colour="blue", sponsors="S2", group_make="late"),
        row(4, 7, None, team="T"), row(5, None, "AB10", number="9", model="loose", team=""), row(6, None, "CD22", number="4"), row(7, None, "EE1"), (8, 1, None, "FF1", "[]", "3"), row(9, 8, "GG1", race_number=12, group_model=""),
    ]
    found = registry.readings(spark.createDataFrame(rows, "id long, job_id long, group_key long, plate string, attributes string, number string"))
    got = {(r["plate"], r["rank"]["id"]): r for r in found.collect()}
    assert set(got) == {("AB10", 1), ("AB10", 5), ("CD22", 6), ("EE1", 7), ("GG1", 9)}
    car = got["AB10", 1]
    assert (car["make"], car["model"], car["colour"], car["team"], car["sponsors"], car["aliases"]) == ("M", None, "blue", None, "S2, S1", ["AB1O"])
    known = spark.createDataFrame([("AB10", "ab1q", "", None, "green", None, None, None, None), ("ZZ9", "x", "Z", None, None, None, None, None, None)], "plate string, aliases string, make string, model string, colour string, body_type string, team string, sponsors string, race_number string")
    after = {r["plate"]: tuple(r)[1:] for r in registry.seeded(known, found).collect()}
    assert after == {
        "AB10": ("AB1O, AB1Q", "M", "loose", "green", None, None, "S2, S1", "9"), "ZZ9": ("x", "Z", None, None, None, None, None, None),
        "CD22": ("", None, None, None, None, None, None, "4"), "GG1": ("", None, None, None, None, None, None, "12"),
    }
    assert registry.seeded(known, found.limit(0)).count() == 2


def test_near_frames_in_a_busy_minute(spark):
    from burstlake.operators import clusters

    rng = random.Random(42)
    frames, looks = [], {}
    for k in range(300):
        t = rng.choice([1000 + rng.random() * 5, 1000 + rng.random() * 5000, None])  # a third of all frames in five seconds
        h = sum(1 << b for b in rng.sample(range(12), 6)) | (1 << 63 if k % 2 else 0)
        frames.append((k, t, h - (1 << 64) if h >> 63 else h, rng.choice([None, 1, 2, 3])))
        looks[k] = [[rng.choice([0.0, 1.0]), rng.choice([0.0, 1.0])] for _ in range(rng.randrange(3))]

    def shows_the_same(a, b, far):
        if not looks[a] or not looks[b]:
            return far <= 4
        return any(sum(p * q for p, q in zip(x, y, strict=True)) >= 0.9 for x in looks[a] for y in looks[b])

    want = []
    for a, ta, ha, ba in frames:
        for b, tb, hb, bb in frames[a + 1 :]:
            far = ((ha ^ hb) & (1 << 64) - 1).bit_count()
            if ta is not None and tb is not None and abs(ta - tb) <= 600 and far <= 10 and (ba is None or ba != bb) and shows_the_same(a, b, far):
                want.append((a, b, far))
    df = spark.createDataFrame(frames, "id long, taken double, phash long, burst long")
    vectors = spark.createDataFrame([(k, v) for k, vs in looks.items() for v in vs], "id long, embedding array<double>")
    for block in (7, 64, 1000):
        assert sorted(tuple(r) for r in clusters.near_in_time(df, vectors, block=block).collect()) == sorted(want)
    assert sorted(tuple(r)[:2] for r in clusters.near_in_time(df).collect()) == sorted((a, b) for a, b, far in [(a, b, ((frames[a][2] ^ frames[b][2]) & (1 << 64) - 1).bit_count()) for a in range(300) for b in range(a + 1, 300)] if far <= 4 and None not in (frames[a][1], frames[b][1]) and abs(frames[a][1] - frames[b][1]) <= 600 and (frames[a][3] is None or frames[a][3] != frames[b][3]))
    assert clusters.near_in_time(df.limit(0), vectors).collect() == []
