"""Readings, plates, views, clusters and measures on rows whose results are worked out by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from burstlake.functions import framing, vehicles
from burstlake.functions import times as D
from burstlake.operators import clusters, evaluate, identity, linkage, rating, selection, sequence
from burstlake.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def readings(*rows):
    return F.array(*[F.struct(F.lit(a).alias("make"), F.lit(b).alias("model"), F.lit(n).cast("long").alias("n"), F.lit(s).alias("stated")) for a, b, n, s in rows])


def test_readings_are_reconciled(spark):
    said = readings(("Ford", "Falcon FG", 5, True), ("", "Commodore", 2, True), ("ford", "X-Trail", 1, True))
    assert one(spark, vehicles.plurality_make(said)) == "Ford"
    assert one(spark, vehicles.plurality_make(readings(("A", "x", 2, True), ("B", "y", 2, True)))) is None
    got = one(spark, vehicles.reconciled(F.lit("Ford"), F.lit("Falcon MkII"), said))
    assert (got["make"], got["model"], got["rejected"]) == ("Ford", "Falcon", ["Falcon MkII"])
    got = one(spark, vehicles.reconciled(F.lit("Opel"), F.lit(None).cast("string"), said))
    assert (got["make"], got["model"], got["rejected"]) == ("Ford", "Falcon FG", ["Opel None"])
    assert one(spark, vehicles.acceptable_model(F.lit("X Trail"), said)) == "X-Trail"
    assert one(spark, vehicles.acceptable_make(F.lit("Holden"), said)) == "Holden"  # its nameplate was read
    assert one(spark, vehicles.acceptable_make(F.lit("Audi"), said)) is None
    assert one(spark, vehicles.cache_key(said)).split("\n")[0] == "5x Ford Falcon FG"
    assert tuple(one(spark, vehicles.reading_of(F.lit("Land Rover Defender"))))[:2] == ("Land", "Rover Defender")


def test_plates_are_read_among_mottoes(spark):
    lines = lambda *rows: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(s)).alias("score")) for t, s in rows])
    got = one(spark, vehicles.interpret_plate(lines(("Queensland", 0.9), ("SUNSHINE STATE", 0.9), ("1ABC-123", 0.7), ("7777", 0.99), ("xyz 987", 0.85))))
    assert (got["text"], got["state"], got["candidates"]) == ("XYZ987", "QLD", ["1ABC123", "XYZ987"]) and got["confidence"] == pytest.approx(1.0)
    none = one(spark, vehicles.interpret_plate(lines(("NSW", 0.9), ("", 0.5))))
    assert (none["text"], none["state"], none["confidence"]) == (None, "NSW", 0.0)
    assert one(spark, vehicles.trim_to_format(F.lit("ABC1234"))) == "ABC123" and one(spark, vehicles.trim_to_format(F.lit("ABC123."))) == "ABC123"


def test_tags_and_times(spark):
    tags = lambda **kw: F.create_map(*[F.lit(x) for pair in kw.items() for x in pair])
    assert one(spark, D.taken_at(tags(DateTimeOriginal="2024:01:02 03:04:05", SubSecTimeOriginal="5"))) == pytest.approx(1704164645.5)
    assert one(spark, D.taken_at(tags(SubSecDateTimeOriginal="", DateTimeOriginal="2024:01:02 03:04:05", SubSecTime="5"))) == pytest.approx(1704164645.0)
    assert one(spark, D.epoch_of_iso(F.lit("2026-11-19T16:00Z"))) == 1795104000 and one(spark, D.epoch_of_iso(F.lit("19 Nov"))) is None
    cull = one(spark, vehicles.cull_of(tags(Rating="-1", Label="Red")))
    assert tuple(cull) == (0, "Red", True)
    frames = spark.createDataFrame([({"SourceFile": "a.cr3", "Model": "M", "DateTimeOriginal": "1970:01:02 00:00:00"},)], "tags map<string,string>")
    row = vehicles.described(frames, "tags", F.lit("folder")).first()
    assert (row["path"], row["camera"], row["taken"]) == ("a.cr3", "M", 86400.0)


def test_views_of_a_small_album(spark):
    frames = [(1, 1, "a/x10.jpg", 5, None, None, 0, 0.9), (2, 1, "a/x9.jpg", 5, None, None, 0, 0.95), (3, 1, "b.jpg", 5, None, 1, 0, 0.99), (4, 1, "c.jpg", 6, None, None, 1, 0.2), (5, 1, "d.jpg", None, 4, None, 0, 0.1), (6, 1, "e.jpg", 7, None, None, 0, 0.1), (7, 1, "f.jpg", 7, None, None, 0, 0.2)]
    f = spark.createDataFrame(frames, "id long, job_id long, path string, burst_key long, stars int, rejected int, picked int, rating double")
    subjects = [(10, 1, "vehicle", "7", None, 0, None, 0, None, 1, None), (11, 2, None, None, None, 1, None, 0, None, 0, None), (12, 6, "vehicle", "8", None, 0, None, 0, "soft", 0, None), (13, 7, "vehicle", "8", None, 0, None, 0, None, 0, 0.2)]
    s = spark.createDataFrame(subjects, "id long, image_id long, region_type string, number string, plate string, reviewed int, rejected int, bystander int, cull_reason string, burst_pick int, group_agreement double").withColumns({"panning": F.lit(0), "stars": F.lit(None).cast("int")})
    known = selection.facts(f, s)
    shown = lambda v, **kw: sorted(r["id"] for r in selection.view(known, v, **kw).collect())
    assert shown("keepers") == [1, 4] and shown("rejected") == [3, 6] and shown("undecided") == [1, 2, 5, 7]
    assert shown("needsLook") == [2, 7] and shown("top3") == [1, 2, 4, 5, 6, 7] and shown("all", least_stars=4) == [1, 2, 3, 5]
    assert shown("all", facet=("numbers", "8")) == [6, 7] and shown("all", needle=" X1") == [1] and shown("review") == [1, 4, 5, 7]
    rows = selection.view(known)
    order = lambda name: [r["id"] for r in rows.orderBy(*selection.ordered(rows, name)).collect()]
    assert order("frame") == [3, 4, 5, 6, 7, 2, 1] and order("best")[:2] == [3, 5] and order("pick")[:2] == [1, 4] and order("review")[-1] == 5
    assert [(r["id"], r["size"]) for r in selection.suggestion_sizes(known).collect()] == [(1, 3)]
    assert sorted(r["id"] for r in selection.singleton_ids(known).collect()) == [4, 5]
    assert [(r["burst_key"], r["size"], r["best"]) for r in selection.soft_bursts(known).collect()] == [(7, 2, 1)]
    assert selection.any_row(known, F.col("id") == 7) and not selection.any_row(known, F.col("id") == 70)


def test_signature_clusters(spark):
    paint, none = (0.0, 0.9, 0.9), None
    rows = [(1, 1, 1, 1, 0b1111, "car", None, None, none), (1, 2, 2, 1, 0b1110, "car", None, None, none), (1, 3, 2, 1, 0b1111, "car", None, None, none), (1, 4, 90, 2, 0b1111, "car", None, None, none), (1, 5, 91, 2, 0b1111, "bike", None, None, none), (1, 6, 300, 9, 0, "car", "Opel", "AB12", paint), (1, 7, 500, 11, -1, "car", None, "A812", none), (1, 8, 501, 12, 0, "car", "opel", None, paint), (1, 9, 502, 12, 0, "car", "Ford", None, (0.5, 0.9, 0.9))]
    rows = [(*r[:5], [0.5, 0.5], *r[5:]) for r in rows] + [(2, 20, 1, 1, 0b1111, [0.5, 0.5], "car", None, None, None), (1, 10, 503, 13, 0, [1.0], "car", None, None, None), (1, 11, 504, 13, None, None, "car", None, None, None)]
    df = spark.createDataFrame(rows, "album long, det long, frame long, burst long, shape long, colours array<double>, cls string, make string, plate string, paint struct<h:double,s:double,v:double>")
    got = {r["det"]: r["grp"] for r in clusters.cluster_by_signature(df, "album").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 5, 8: 5, 9: 6, 10: 7, 20: 1}


def test_consensus_of_a_group(spark):
    rows = [("g", 1, "Ford", "Falcon", "red", "#100000", "AB1", 0.4, "7", 0.5, ["Repco"], "A"), ("g", 2, "ford", "falcon", "Blue", "#200000", "AB2", 0.9, "8", 0.5, ["repco", "Castrol"], "B"), ("g", 3, "Holden", None, "red", "#300000", None, None, None, 0.9, None, "B"), ("h", 4, "A", "x", None, None, None, 0.0, None, None, None, None), ("h", 5, "B", "y", None, None, "no", 0.0, None, None, None, None), ("h", 6, "B", "z", None, None, None, None, None, None, None, None), ("h", 7, "b", "w", None, None, None, None, None, None, None, None), ("k", 8, None, " ", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "g string, seq long, make string, model string, colour string, colour_hex string, plate string, plate_conf double, race_number string, number_conf double, sponsors array<string>, team string")
    got = {r["g"]: r for r in identity.consensus(df, "g", "seq").collect()}
    g, h, k = got["g"], got["h"], got["k"]
    assert (g["members"], g["make"], g["model"], g["colour"], g["colour_hex"], g["plate"], g["race_number"], g["team"], g["sponsors"]) == (3, "Ford", "Falcon", "red", "#200000", "AB2", "7", "B", ["Repco", "Castrol"])
    assert g["agreement"] == pytest.approx(2 / 3) and g["disputed"] == []
    assert (h["make"], h["model"], h["agreement"], h["disputed"], h["plate"]) == ("B", None, 0.75, ["A x", "B y", "B z", "b w"], None)
    assert (k["members"], k["make"], k["agreement"]) == (1, None, None)


def test_consolidated_album(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [("x", 1, 1, 1, v, "AB1", "Ford", "Falcon", None), ("x", 1, 2, 2, v, None, "Ford", "Falcon", "Opel"), ("x", 2, 3, 3, v, "AB1", " ", None, None), ("x", 2, 4, 4, w, None, "Audi", "TT", None), ("y", 1, 5, 5, v, None, "BMW", "M3", None), ("y", 1, 6, 6, None, None, "BMW", "M3", None)]
    df = spark.createDataFrame(rows, "album string, burst long, frame long, det long, embedding array<double>, plate string, make string, model string, own_make string").withColumns({"cls": F.lit("car"), "plate_conf": F.lit(0.5)})
    got = {r["det"]: r for r in identity.consolidate(df, "album").collect()}
    assert {d: (r["group_key"], r["group_size"]) for d, r in got.items()} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (2, 1), 5: (1, 1), 6: (None, None)}
    # each frame votes with what it read itself: Ford, Opel and nothing, so the first pair holds half
    assert [got[d]["make"] for d in (1, 2, 3, 4)] == ["Ford", "Ford", "Ford", "Audi"] and got[3]["model"] == "Falcon" and got[2]["own_make"] == "Opel" and got[2]["plate"] == "AB1"
    assert got[1]["group_agreement"] == 0.5 and got[6]["make"] == "BMW"


def test_choices_are_learned(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for g in range(60):
        x = rng.normal(0, 1, (4, 2))
        best = int(np.argmax(x @ [2.0, -1.0]))
        rows += [(g, float(a), float(b), k == best) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "g long, a double, b double, y boolean")
    got = evaluate.fit_choice(df, ["g"], ["a", "b"], "y", rounds=8, rate=0.2)
    w, m, v = np.zeros(2), np.zeros(2), np.zeros(2)
    x = np.array([[r[1], r[2]] for r in rows]).reshape(60, 4, 2)
    y = np.array([r[3] for r in rows]).reshape(60, 4)
    for t in range(1, 9):
        e = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        grad = np.einsum("gk,gkc->c", e / e.sum(1, keepdims=True) - y, x) / 60 + 0.01 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert got == pytest.approx(w) and got[0] > 0 > got[1]
    line = evaluate.fit_logistic(df.withColumn("y", F.col("y").cast("int")), ["a", "b"], "y", rounds=5, rate=0.1)
    assert line[0] > 0 > line[1]


def test_bootstrap_interval(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("double").alias("hit"))
    a, b = (evaluate.bootstrap_interval(df.repartition(n), "hit", "k", 400).first() for n in (1, 5))
    wide = 1.96 * math.sqrt(0.25 * 0.75 / 400)
    assert tuple(a) == pytest.approx(tuple(b))
    assert a["low"] == pytest.approx(0.25 - wide, abs=0.012) and a["high"] == pytest.approx(0.25 + wide, abs=0.012)


def test_fuzzy_matches(spark):
    rows = [(1, ["Castrol", "Repco ", "Mobil 1"], ["castrol edge", "Repco", "Shell"]), (2, ["Penrite Oil", "Penrite"], ["penrite oils"]), (3, None, ["a"]), (4, [], [])]
    got = {r["id"]: (r["matches"], r["precision"], r["recall"]) for r in evaluate.fuzzy_matches(spark.createDataFrame(rows, "id long, a array<string>, b array<string>"), "id", "a", "b").collect()}
    assert got[1] == (2, pytest.approx(2 / 3), pytest.approx(2 / 3)) and got[2] == (1, 0.5, 1.0) and got[3] == (0, None, 0.0) and got[4] == (0, None, None)


def test_merge_sweep(spark):
    ends = spark.createDataFrame([("c", 1, 0.0, 1.0), ("c", 2, 5.0, 6.0), ("c", 3, 30.0, 31.0), ("d", 4, 0.0, 1.0)], "camera string, burst long, started double, ended double")
    frames = spark.createDataFrame([("c", 1, True), ("c", 1, False), ("c", 2, True), ("c", 3, False), ("d", 4, True)], "camera string, burst long, exported boolean")
    rules = spark.createDataFrame([("a", 10.0, 30.0), ("b", 60.0, 60.0), ("c", 1.0, 30.0)], "rule string, gap double, span double")
    got = {r["rule"]: (r["frames"], r["groups"], r["joined"], r["one_sent"], r["two_sent"]) for r in evaluate.merge_sweep(ends, frames, "camera", rules, F.lit(True)).collect()}
    assert got == {"a": (5, 3, 3, 0, 1), "b": (5, 2, 4, 0, 1), "c": (5, 4, 0, 0, 0)}


def test_sliding_rate(spark):
    rows = [("a", 0, 0), ("a", 10, 100), ("a", 20, 150), ("a", 100, 200), ("b", 5, 1)]
    got = {(r["k"], r["t"]): r["rate"] for r in sequence.sliding_rate(spark.createDataFrame(rows, "k string, t long, n long"), "k", "t", "n", 15).collect()}
    assert got == {("a", 0): None, ("a", 10): 10.0, ("a", 20): 5.0, ("a", 100): 50 / 80, ("b", 5): None}


def test_live_sessions(spark, tmp_path):
    from burstlake.streaming.watch import live_sessions

    rows = [("u", 0), ("u", 60), ("u", 600), ("v", 30), ("v", 9000)]
    df = spark.createDataFrame(rows, "user string, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = live_sessions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "user", "ts", "5 minutes", "1 minute")
    out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["user"], int(r["started"].timestamp()), int(r["ended"].timestamp()), r["n"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [("u", 0, 360, 2), ("u", 600, 900, 1), ("v", 30, 330, 1)]  # the last one is still open


def test_entries_and_packages(spark, tmp_path):
    evidence = spark.createDataFrame([(1, ["Team", "J. Smithers racing"]), (2, ["Ann Lee #7"]), (3, ["Smith"]), (4, ["nobody"]), (5, ["Jo Smith", "Smith"])], "id long, lines array<string>")
    entries = spark.createDataFrame([("7", ["Ann Lee"]), ("8", ["Jo Smith"]), ("9", ["Al Smith", "Bo Smithers"])], "number string, drivers array<string>")
    got = {r["id"]: (r["entry"], r["score"]) for r in linkage.entry_of_evidence(evidence, entries, "id", "lines", "number", "drivers").collect()}
    assert got == {1: ("9", 2), 2: ("7", 3), 5: ("8", 3)}  # a surname that two share decides nothing
    paths = spark.createDataFrame([(1, "C:\\a\\x.jpg"), (1, "c:/A/y.jpg"), (2, "/a/x"), (2, "/b/y"), (3, "alone"), (3, "/a/x")], "g long, path string")
    assert {r["g"]: r["parent"] for r in linkage.common_parent(paths, ["g"]).collect()} == {1: "C:\\a", 2: None, 3: None}
    (tmp_path / "map.csv").write_text("Team, No. ,Driver,Driver\nA;B,#07,x,Ann\n,12,,\n")
    numbers = {r["number"]: r for r in files.read_number_map(spark, str(tmp_path / "map.csv")).collect()}
    assert numbers["7"]["fields"] == {"Team": "A;B", "Driver": "Ann"} and numbers["12"]["fields"] == {} and numbers["7"]["described"] == "A;B, Ann"
    box = tmp_path / "in"
    box.mkdir()
    for name, created in (("old", "2024-01-01T00:00:00Z"), ("new", "2024-01-01T01:00:00Z"), ("skip.tmp", "2024-01-01T01:00:00Z")):
        (box / f"{name}.json" if name != "skip.tmp" else box / name).write_text(json.dumps({"format": "f", "version": 1, "created_at": created, "album": {"label": name}, "photos": [{"path": "p"}]}))
    waiting = files.pending_packages(spark, str(box), 1704074400.0).collect()
    assert [(r["name"], r["album"], r["photos"], r["age_s"]) for r in waiting] == [("new", "new", 1, 3600), ("old", "old", 1, 7200)]


def test_inbox_moves_files_once(spark, tmp_path):
    from burstlake.streaming.watch import consume_inbox

    box = tmp_path / "in"
    box.mkdir()
    for name, fmt, path in (("good", "f", "p"), ("left", "f", "unknown"), ("bad", "other", "p")):
        (box / f"{name}.json").write_text(json.dumps({"format": fmt, "version": 1, "photos": [{"path": path, "rating": 3}]}))
    seen = []
    known = spark.createDataFrame([("p",)], "path string")
    moved = consume_inbox(spark, str(box), "f", known, lambda rows: seen.append([tuple(r) for r in rows.select("path", "rating").collect()]))
    assert {(r["name"], r["to"]) for r in moved.collect()} == {("good.json", "done"), ("left.json", "left"), ("bad.json", "failed")}
    assert seen == [[("p", 3)]] and (box / "done" / "good.json").exists() and (box / "failed" / "bad.json").exists() and (box / "left.json").exists()
    again = consume_inbox(spark, str(box), "f", known, lambda rows: seen.append("again"))
    assert {(r["name"], r["to"]) for r in again.collect()} == {("left.json", "left")} and seen[1:] == []


def test_composition(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    see = lambda b, others=none, dx=None, dy=None, signed=True: one(spark, framing.measured(F.lit(1000.0), F.lit(1000.0), b, others, F.lit(dx).cast("double"), F.lit(dy).cast("double"), F.lit(signed)))
    edge = see(box(0, 400, 200, 600))
    assert (edge["cut_sides"], edge["band"], edge["lead"], edge["centred"]) == (1, "good", None, False)
    assert see(box(0, 0, 1000, 1000))["cut_sides"] == 0 and see(box(0, 0, 1000, 1000))["band"] == "tight"
    assert see(box(100, 400, 300, 600), dx=1.0, dy=0.0)["lead"] == pytest.approx(0.6) and see(box(700, 400, 900, 600), dx=1.0, dy=0.0, signed=False)["lead"] == pytest.approx(0.6)
    half = see(box(400, 400, 600, 600), F.array(box(500, 300, 900, 700)))
    assert half["occlusion"] == pytest.approx(0.5) and half["centred"] and half["balance"] == pytest.approx((40000 * 0 + 160000 * 0.4) / 200000)
    m = framing.measured(F.lit(1000.0), F.lit(1000.0), box(400, 400, 600, 600), none, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True))
    assert one(spark, framing.framing_score(m, F.lit(None).cast("double"))) == pytest.approx(1.0)
    assert one(spark, framing.framing_score(m, F.lit(9.0), framing.PORTRAIT)) == pytest.approx(0.90 / 0.95)
    rows = [(1, 1, 0, (50.0, 0.0, 100.0, 80.0)), (1, 2, 19, (0.0, 40.0, 150.0, 200.0)), (1, 3, 0, (400.0, 0.0, 450.0, 80.0)), (2, 4, 0, (0.0, 0.0, 10.0, 30.0)), (2, 5, 32, (40.0, 0.0, 45.0, 5.0)), (3, 6, 19, (0.0, 0.0, 9.0, 9.0)), (3, 7, 0, (50.0, 50.0, 90.0, 90.0))]
    df = spark.createDataFrame(rows, "image long, id long, cls int, box struct<x1:double,y1:double,x2:double,y2:double>")
    assert [(r["person"], r["animal"], r["above"]) for r in framing.riders(df, "image").collect()] == [(1, 2, True)]
    assert [(r["person"], r["distance"], r["in_play"]) for r in framing.ball_contexts(df, "image").collect()] == [(4, 1.0, True)]
    assert {r["image"]: r["kind"] for r in framing.decisive_subjects(df, "image").collect()} == {1: "rider", 2: "person", 3: "animal"}


def test_focus_areas(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    ask = lambda area, kind, *boxes: one(spark, rating.area_is_subject(area, F.lit(kind), F.array(*boxes), F.lit(6000), F.lit(4000)))
    car, tiny = box(1000, 1000, 3000, 2000), box(10, 10, 100, 100)
    assert ask(box(1850, 1400, 2150, 1600), "point", car) is False and ask(box(4850, 3400, 5150, 3600), "point", car) is True
    assert ask(box(3000, 1400, 3150, 1600), "point", car) is False  # just beside it
    assert ask(box(4850, 3400, 5150, 3600), "grid", car) is None and ask(box(4850, 3400, 5150, 3600), "grid", tiny) is True
    assert ask(box(0, 0, 6000, 4000), "point", car) is None
    opinion = lambda area: one(spark, rating.area_opinion(area, F.lit("point"), F.array(car), F.lit(6000), F.lit(4000)))
    assert opinion(box(0, 0, 300, 200)) is None and opinion(box(0, 0, 1000, 1000)) is not None
    marked = rating.mark_bystanders(spark.createDataFrame([(1, 0, "soft"), (2, 0, "soft")], "image_id long, bystander int, cull_reason string"), spark.createDataFrame([(1, "area"), (2, "none")], "id long, call string"))
    assert {r["image_id"]: (r["bystander"], r["cull_reason"]) for r in marked.collect()} == {1: (1, None), 2: (0, "soft")}


def test_large_numbers_of_candidates_are_spaced_in_batches(spark):
    rng = random.Random(4)
    places = sorted(rng.sample(range(3000), 900))
    want, last = [], None
    for p in places:
        if last is None or p - last >= 7:
            want.append(p)
            last = p
    df = spark.createDataFrame([("g", p) for p in places], "g string, p long")
    assert sorted(r["p"] for r in evaluate.spaced(df, "g", "p", 7).collect()) == want


def test_regroup_with_sets_and_without_stacks(spark):
    from burstlake.plans.regroup import SET_KEY_BASE, regroup
    from burstlake.schemas import FRAMES, conform

    rows = [(k, 1, f"p{k}", "done", "c", 0.5 * k, 0.01 * 2**k, 0.9) for k in range(3)] + [(10, 1, "p10", "done", "c", 50.0, 0.01, 0.8), (11, 1, "p11", "done", "c", 51.0, 0.01, 0.95), (12, 1, "p12", "error", "c", 51.0, 0.01, 0.95), (13, 2, "p13", "done", "c", None, None, 0.95)]
    df = conform(spark.createDataFrame(rows, "id long, job_id long, path string, status string, camera string, taken_at double, exposure_time double, rating double"), FRAMES).withColumns({"focus_distance": F.lit(None).cast("double"), "exposure_bias": F.lit(0.0)})
    got = {r["id"]: (r["burst_key"], r["time_burst"], r["burst_pick"], r["set_kind"]) for r in regroup(df).collect()}
    assert got == {0: (SET_KEY_BASE, 1, 1, "bracket"), 1: (SET_KEY_BASE, 1, None, "bracket"), 2: (SET_KEY_BASE, 1, None, "bracket"), 10: (2, 2, None, None), 11: (2, 2, 1, None), 12: (None, None, None, None), 13: (1, 1, 1, None)}
    alone = {r["id"]: r["burst_key"] for r in regroup(df, stacks=False, keep_sets=False).collect()}
    assert alone == {0: 1, 1: 2, 2: 3, 10: 4, 11: 5, 12: None, 13: 1}


def test_rates_tell_what_is_left(spark):
    rows = [("a", 0, 0, 100), ("a", 10, 50, 100), ("a", 20, 50, 100), ("a", 60, 90, 100)]
    got = {r["t"]: r["eta"] for r in sequence.sliding_rate(spark.createDataFrame(rows, "k string, t long, n long, whole long"), "k", "t", "n", 10, "whole").collect()}
    assert got == {0: None, 10: 10.0, 20: None, 60: 10.0}


def test_streams_are_joined_in_a_band(spark, tmp_path):
    from burstlake.streaming.watch import joined_streams

    a = [("x", 0), ("x", 100), ("y", 50), ("z", 5000)]
    b = [("x", 20), ("x", 200), ("y", 500), ("z", 5000)]
    for name, rows in (("a", a), ("b", b)):
        spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), F.col("s")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    stream = lambda name: spark.readStream.schema("k string, ts timestamp, s long").parquet(f"{tmp_path}/{name}")
    out = joined_streams(stream("a"), stream("b"), "k", "ts", "60 seconds", "10 minutes").select("k", "s", "s_r")
    out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()) == [("x", 0, 20), ("z", 5000, 5000)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from burstlake.operators.lineage import work_dir

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        work_dir(session)
    session.conf = SimpleNamespace(get=lambda key, default=None: "file:///shared/")
    assert work_dir(session) == "file:///shared"


def test_overlapping_boxes_are_suppressed(spark):
    rows = [(1, 1, "car", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, "car", 0.8, 1.0, 0.0, 11.0, 10.0), (1, 3, "bike", 0.7, 1.0, 0.0, 11.0, 10.0), (1, 4, "car", 0.6, 20.0, 0.0, 30.0, 10.0), (1, 5, "car", 0.6, 20.0, 0.0, 30.0, 10.0), (2, 6, "car", 0.1, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "image long, id long, cls string, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["id"] for r in clusters.suppress_overlaps(df, "image", 0.5).collect()) == [1, 3, 4, 6]


def test_packages_and_catalogues(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1, None, "")], "format string, version int, direction string, created_at string")
    files.write_packages(rows, f"{tmp_path}/out")
    assert json.loads(spark.read.text(f"{tmp_path}/out").first()["value"]) == {"format": "f", "version": 1, "created_at": ""}
    compact = rows.select(files.compact_json(["format", "version", "direction", "created_at"]).alias("j")).first()["j"]
    assert json.loads(compact) == {"format": "f", "version": "1"}
    f = spark.createDataFrame([(1, 10, "x.cr3")], "file_id long, folder long, file_name string")
    d = spark.createDataFrame([(10, 100, "2024/")], "folder_id long, root long, folder_path string")
    r = spark.createDataFrame([(100, "/p/")], "root_id long, root_path string")
    i = spark.createDataFrame([(7, 1, 4, 1, "red"), (8, 2, 4, 1, "red")], "image_id long, file long, rating int, pick int, label string")
    assert [tuple(x) for x in files.catalogue(f, d, r, i).collect()] == [(7, "/p/2024/x.cr3", 4, 1, "red")]


def test_moments_and_marks_of_files(spark):
    row = spark.range(1).select(F.from_json(F.lit('[{"tag":"a","p":0.9},{"tag":"b","p":0.95},{"tag":"c","p":0.6}]'), "array<struct<tag:string,p:double>>").alias("r"))
    weights = F.create_map(F.lit("a"), F.lit(0.9), F.lit("c"), F.lit(1.0))
    got = row.select(rating.moment_lift(F.col("r"), weights, F.lit(0.5)).alias("l"), rating.moment_lift(F.col("r"), F.create_map(F.lit("z"), F.lit(1.0)), F.lit(1.0)).alias("n"), F.size(rating.maybe_readings(F.col("r"))).alias("m"), rating.lift_bucket(F.lit(0.45)).alias("b")).first()
    assert (got["l"]["tag"], got["l"]["amount"], got["n"], got["m"], got["b"]) == ("a", 0.45, None, 1, 2)
    stars, label = linkage.file_marks(F.col("s"), F.col("l"))
    marks = spark.createDataFrame([(0, " "), (5, "Red"), (6, None)], "s int, l string").select(stars.alias("s"), label.alias("l"))
    assert [tuple(x) for x in marks.collect()] == [(None, None), (5, "Red"), (None, None)]
