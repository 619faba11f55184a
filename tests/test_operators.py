"""Order-dependent operators against row-at-a-time Python, and edge rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from burstlake.operators import clusters, evaluate, identity, keeper, lineage, linkage, mutations, sequence, votes
from burstlake.plans import stats
from burstlake.schemas import FRAMES, SUBJECTS, conform


def plain_sessions(rows, gap):
    out, key = {}, 0
    for camera in sorted({r[1] for r in rows}):
        mine = sorted((r for r in rows if r[1] == camera), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        last = None
        for k, (path, _, taken) in enumerate(mine):
            if k == 0 or taken is None or last is None or taken - last > gap:
                key += 1
            last = taken
            out[path] = key
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_sessions_equal_a_plain_scan_however_rows_are_dealt(spark, parts):
    rng = random.Random(parts)
    rows = [(f"p{k:03}", rng.choice("abc"), rng.choice([None, round(rng.uniform(0, 60) * 2) / 2])) for k in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "path string, camera string, taken double").repartition(parts)
    got = sequence.number_sessions(sequence.sessionise(df, "camera", "taken", "path"), "camera")
    assert {r["path"]: r["burst"] for r in got.collect()} == plain_sessions(rows, 1.5)
    assert sequence.sessionise(df.limit(0), "camera", "taken", "path").collect() == []


def test_merged_bursts_reset_their_span(spark):
    ends = [("c", k, 9.0 * k, 9.0 * k + 1, 5) for k in range(1, 9)] + [("d", 20, None, None, 5), ("d", 21, 1.0, 2.0, 5)]
    df = spark.createDataFrame(ends, "camera string, burst long, started double, ended double, n long")
    got = {r["burst"]: r["merged"] for r in sequence.merge_bursts(df, "camera", F.lit(True)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5, 20: 20, 21: 21}


def test_sets(spark):
    nan = float("nan")
    rows = [("c", k, k * 0.5, ev, nan, 50.0) for k, ev in enumerate([0.0, 1.0, 2.0])]
    rows += [("c", 10 + k, 100.0 + k, 0.0, 10.0 + k, 50.0) for k in range(4)]
    rows += [("c", 20 + k, 200 + 5.0 * k, 0.0, nan, 50.0) for k in range(12)]
    rows += [("c", 40, 900.0, 0.0, nan, 50.0)]
    df = spark.createDataFrame(rows, "camera string, frame_id long, taken double, ev double, focus double, focal double")
    got = {r["frame_id"]: (r["set_kind"], r["set_id"]) for r in sequence.sets(df).collect()}
    assert got[0] == got[2] == ("bracket", 0)
    assert got[10] == got[13] == ("stack", 10)
    assert got[20] == got[31] == ("interval", 20)
    assert got[40] == (None, None)


def test_sets_keep_aperture_and_shutter(spark):
    nan = float("nan")
    rows = [("a", k, k * 0.5, ev, nan, 50.0, f, 0.01) for k, (ev, f) in enumerate([(0.0, 8.0), (1.0, 8.0), (2.0, 8.5)])]  # a third of a stop is the same
    rows += [("b", 100 + k, k * 0.5, ev, nan, 50.0, f, 0.01) for k, (ev, f) in enumerate([(0.0, 8.0), (1.0, 8.0), (2.0, 11.0)])]
    rows += [("c", 200 + k, float(k), 0.0, 10.0 + k, 50.0, 8.0, t) for k, t in enumerate([0.01, 0.01, 0.02])]
    rows += [("d", 300 + k, float(k), 0.0, 10.0 + k, 50.0, None, t) for k, t in enumerate([0.01, 0.01, 0.012])]
    rows += [("e", 400 + k, 5.0 * k, 0.0, nan, 50.0, 4.0 if k < 6 else 8.0, 0.01) for k in range(12)]
    df = spark.createDataFrame(rows, "camera string, frame_id long, taken double, ev double, focus double, focal double, aperture double, shutter double")
    kinds = {}
    for r in sequence.sets(df).collect():
        kinds.setdefault(r["camera"], set()).add(r["set_kind"])
    assert kinds == {"a": {"bracket"}, "b": {None}, "c": {None}, "d": {"stack"}, "e": {None}}


def test_bursts_of_one_subject_are_joined(spark):
    box, scene, other = (0.1, 0.1, 0.5, 0.5), [200, 55], [0, 255]
    look = lambda portrait=False, s=scene, livery=None, b=box: (portrait, s, livery, b)
    pairs = [(look(), look()), (look(), look(portrait=True)), (look(), look(s=other)), (look(), look(s=None)), (look(), look(b=(0.7, 0.7, 0.72, 0.72))), (look(), look(b=None)), (look(livery=[255, 0]), look(livery=[0, 255])), (look(livery=[255, 0]), look(livery=None))]
    rows = [(k, 2 * k + j, 3.0 * j, 3.0 * j + 1, side, side) for k, pair in enumerate(pairs) for j, side in enumerate(pair)]
    kind = "struct<portrait:boolean,scene:array<int>,livery:array<int>,box:struct<x1:double,y1:double,x2:double,y2:double>>"
    df = spark.createDataFrame(rows, f"camera int, burst long, started double, ended double, first {kind}, last {kind}")
    got = {r["camera"] for r in sequence.merge_bursts(df, "camera").collect() if r["burst"] % 2 and r["merged"] == r["burst"] - 1}
    assert got == {0, 5, 7}


def test_misspellings_are_folded_where_they_are_rare(spark):
    said = [["Michelin"]] * 12 + [["Michelim"]] * 4 + [["Michxlxn"]] + [["Castro"]] * 5 + [["Castrol"]] * 6 + [["abc"]] * 9 + [["abd"], ["Late", " "], None]
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate(said)], "g string, seq long, sponsors array<string>")
    got = identity.accumulate(df, "g", "sponsors", "seq").first()["sponsors"]
    assert got == ["Michelin", "abc", "Castrol", "Castro", "abd", "Late"]  # 16 + 1: two edits, over ten times rarer


def test_plates_decide_clusters(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 1, 1, "car", v, "AB-12"), (1, 2, 2, "car", v, "XY 99"), (1, 3, 3, "car", w, "AB12"), (1, 4, 4, "car", v, None), (1, 5, 5, "car", v, "A812"), (2, 6, 6, "car", w, "ab12"), (2, 7, 7, "car", w, None), (3, 6, 8, "car", v, "AB12")]
    df = spark.createDataFrame([("x", *r) for r in rows], "album string, burst long, frame long, det long, cls string, embedding array<double>, plate string")
    got = {r["det"]: r["grp"] for r in clusters.cluster_by_look(df).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}
    whole = {r["det"]: r["vehicle"] for r in clusters.vehicles(df, "album").collect()}
    assert whole == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 8}  # 8 shares a frame with 6


def test_copies_give_their_hand_work_to_the_survivor(spark):
    rows = [(1, 1.0, 10, 5, 0, 0, None, 1), (2, 1.0, 10, None, 1, 0, None, None), (3, 1.0, 10, 2, 0, 1, None, None), (4, 2.0, 10, None, 0, 1, None, None), (5, 2.0, 10, None, 0, 1, None, None), (6, None, 10, 1, 0, 0, None, None), (7, None, 10, 1, 0, 0, None, None), (8, 9.0, 10, 1, 0, 0, 1, None), (9, 1.0, 10, 1, 0, 0, 2, None)]
    df = spark.createDataFrame(rows, "id long, taken double, width int, stars int, picked int, rejected int, copy_of long, burst_pick int")
    got = {r["id"]: (r["copy_of"], r["stars"], r["picked"], r["rejected"]) for r in clusters.collapse_copies(df, [F.round(F.col("taken") * 1000), F.col("width")], "id").collect()}
    assert got[2] == (None, 5, 1, 0) and got[1][0] == 2 and got[3][0] == 2 and got[1][2] == 0
    assert got[4] == (None, None, 0, 1) and got[5][0] == 4
    assert got[6][0] is None and got[7][0] is None and got[8] == (2, 1, 0, 0) and got[9] == (2, 1, 0, 0)
    back = clusters.restore_copies(df.withColumn("job_id", F.lit(1)), 1)
    assert back.where("copy_of is not null").count() == 0


def test_marks(spark):
    frames = spark.createDataFrame([(k, 3, 1, 0) for k in range(1, 7)], "id long, stars int, rejected int, picked int")
    marks = spark.createDataFrame([(1, None, 1, 1, False), (2, None, 0, None, False), (3, None, None, 1, False), (4, None, None, None, True), (5, 0, 1, 0, False)], "id long, stars int, rejected int, picked int, clear_stars boolean")
    got = {r["id"]: tuple(r)[1:] for r in mutations.mark(frames, marks).collect()}
    assert got == {1: (3, 0, 1), 2: (3, 0, 0), 3: (3, 0, 1), 4: (None, 1, 0), 5: (0, 1, 0), 6: (3, 1, 0)}
    subjects = spark.createDataFrame([(10 + k, k, 3, 1, "soft") for k in range(1, 7)], "id long, image_id long, stars int, rejected int, cull_reason string")
    got = {r["image_id"]: (r["stars"], r["rejected"], r["cull_reason"]) for r in mutations.mark_subjects(subjects, marks).collect()}
    assert got == {1: (3, 1, "soft"), 2: (3, 0, None), 3: (3, 1, "soft"), 4: (None, 1, "soft"), 5: (0, 1, "soft"), 6: (3, 1, "soft")}


def test_units_that_mix_bands_are_folded(spark):
    # a vehicle and two faces that beat each other in a circle: the order of frames decides
    a, b, c = (0.740, 0.03, 0.2), (0.735, 0.005, 0.3), (0.742, 0.005, 0.1)
    orders = {"abc": (a, b, c), "cab": (c, a, b), "bca": (b, c, a)}
    rows = [(u, k, 100 * n + k, *x) for n, (u, three) in enumerate(orders.items()) for k, x in enumerate(three)]
    rows += [("one", 9, 900, 0.8, 0.03, 0.1), ("one", 9, 901, 0.8, 0.03, 0.2), ("soft", 1, 950, 0.1, 0.03, 0.9), ("soft", 1, 951, 0.1, 0.005, 0.9), ("abc2", 1, 2, 0.9, 0.03, 0.5)]
    df = spark.createDataFrame(rows, "unit string, frame long, row long, score double, band double, area double")
    got = {(r["unit"], r["row"]) for r in keeper.pick_keepers(df, ["unit"], "frame", "row", "band").where("picked = 1").collect()}
    want = set()
    for n, (u, three) in enumerate(orders.items()):
        held = None
        for k, (score, band, area) in enumerate(three):
            new = (k, score, band, area)
            if held is None or (int(score / max(band, held[2])), area) > (int(held[1] / max(band, held[2])), held[3]):
                held = new
        want.add((u, 100 * n + held[0]))
    assert got == want | {("one", 901), ("abc2", 2)} and len({orders[u][r % 100] for u, r in want}) == 3


def test_a_row_may_win_in_one_unit_only(spark):
    rows = [("u", 1, 7, 0.9), ("v", 1, 7, 0.8), ("v", 2, 8, 0.95), (None, 3, 9, 0.9)]
    df = spark.createDataFrame(rows, "unit string, frame long, row long, score double")
    got = sorted(((r["unit"], r["row"], r["picked"]) for r in keeper.pick_keepers(df, ["unit"], "frame", "row").collect()), key=repr)
    assert got == sorted([("u", 7, 1), ("v", 7, None), ("v", 8, 1), (None, 9, 1)], key=repr)


def test_keeper_ties_nan_and_hand_marks(spark):
    rows = [("u", 1, 1, 0.80, 0), ("u", 2, 2, 0.80, 0), ("v", 3, 3, 0.99, 0), ("v", 4, 4, 0.10, 4), ("w", 5, 5, float("nan"), 0), ("w", 6, 6, None, 0), ("x", 7, 7, 0.5, 0)]
    df = spark.createDataFrame(rows, "unit string, frame long, row long, score double, by_hand long")
    picked = [r["row"] for r in keeper.pick_keepers(df, ["unit"], "frame", "row").where("picked = 1").collect()]
    assert sorted(picked) == [1, 4]


def test_votes(spark):
    rows = [("g", 1, "Audi"), ("g", 2, "bmw"), ("g", 3, "BMW"), ("g", 4, "audi"), ("g", 5, " "), ("g", 6, None), ("h", 7, None)]
    df = spark.createDataFrame(rows, "g string, seq long, v string")
    won = votes.vote(df, "g", F.col("v"), "seq").collect()
    assert [(r["g"], r["winner"], r["votes"], r["share"]) for r in won] == [("g", "Audi", 2, 0.5)]
    assert votes.plurality(df.where("seq < 7"), "g", F.col("v"), "seq").first()["winner"] is None
    colours = spark.createDataFrame([("g", "#000000"), ("g", "#102030"), ("g", "#ff"), ("h", "bad")], "g string, c string")
    assert {r["g"]: r["c"] for r in votes.median_colour(colours, "g", "c").collect()} == {"g": "#102030", "h": None}


def test_linkage_of_ambiguous_paths(spark):
    left = spark.createDataFrame([(1, "a", "n", 10.0), (2, "b", "n", 10.0), (3, "c", "m", 50.0), (4, "d", None, None)], "id long, path string, name string, time double")
    right = spark.createDataFrame([(11, "a", "x", 0.0), (12, "b", "n", 10.0), (13, "b", "n", 10.0), (14, "z", "m", 52.0), (15, "y", "m", 90.0)], "id long, path string, name string, time double")
    got = {(r["left_id"], r["right_id"], r["how"]) for r in linkage.link_records(left, right).collect()}
    assert got == {(1, 11, "path"), (3, 14, "name")}


def test_near_frames_and_components(spark):
    frames = [(1, 0.0, 0b1111, 1), (2, 500.0, 0b1110, 2), (3, 1000.0, 0b1100, 3), (4, 5000.0, 0b1111, 4), (5, None, 0b1101, 5), (6, 1.0, 0b1111, 1)]
    df = spark.createDataFrame(frames, "id long, taken double, phash long, burst long")
    edges = clusters.near_frames(df)
    got = {(r["a"], r["b"]) for r in edges.collect()}
    assert got == {(1, 2), (2, 3), (2, 6), (1, 5), (2, 5), (3, 5), (4, 5), (5, 6)}
    assert {r["component"] for r in clusters.components(edges).collect()} == {1}
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 60)], "a long, b long")
    assert {r["component"] for r in clusters.components(chain).collect()} == {1}
    assert clusters.components(chain.limit(0)).collect() == []


def test_components_of_random_graphs(spark):
    rng = random.Random(13)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, 500), (None, 3), (7, None), (1000, 999), (1000, 998), (997, 1000)]
    least = {v: v for e in edges if None not in e for v in e}
    while True:
        new = dict(least)
        for a, b in edges:
            if a is not None and b is not None:
                new[a] = new[b] = min(new[a], new[b])
        if new == least:
            break
        least = new
    got = clusters.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["v"]: r["component"] for r in got.collect()} == least


def test_greedy_clusters_never_hold_a_frame_twice(spark):
    rows = [(1, 1, 1, "car", [1.0, 0.0]), (1, 1, 2, "car", [1.0, 0.0]), (1, 2, 3, "car", [0.99, 0.1]), (1, 3, 4, "bike", [1.0, 0.0]), (1, 3, 5, None, None), (None, 9, 6, "car", [0.0, 1.0]), (None, 8, 7, "car", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "burst long, frame long, det long, cls string, embedding array<double>")
    got = {r["det"]: r["grp"] for r in clusters.cluster_by_look(df).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2, 5: None, 6: 0, 7: 0}


def test_ridge_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, (80, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0)], "a double, b double, y double")
    model = evaluate.fit_ridge(df, ["a", "b"], "y")
    z = (x - x.mean(0)) / x.std(0)
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + 2 * np.eye(2), z.T @ (y - y.mean())))
    assert evaluate.fit_ridge(df.limit(50), ["a", "b"], "y") is None
    assert df.select(model.predict(["a", "b"]).alias("p")).where("p is null").count() == 2


def test_edits(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    delta = spark.createDataFrame([(2, None, None), (3, "c", 3)], "id long, x string, y int")
    assert sorted(map(tuple, mutations.upsert(base, delta, "id", ("y",)).collect())) == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
    assert sorted(map(tuple, mutations.apply_delta(base, delta, "id", ["x"]).collect())) == [(1, "a", 1), (2, "b", 2)]
    assert [tuple(r) for r in mutations.changed_only(base, delta, "id", ["x", "y"]).collect()] == [(2, None, None)]
    assert sorted(map(tuple, mutations.reset(base, ["id"], F.col("id") == 1).collect()), key=lambda r: r[0]) == [(1, None, None), (2, "b", 2)]
    assert [r["id"] for r in mutations.undo_last(base, "id").collect()] == [1]


def test_reports_over_empty_and_partial_tables(spark):
    frames = conform(spark.createDataFrame([(1, 1, "done")], "id long, job_id long, status string"), FRAMES)
    subjects = conform(spark.createDataFrame([], "id long, image_id long"), SUBJECTS)
    row = stats.shoot_stats(frames, subjects).first()
    assert (row["frames"], row["subjects"], row["keepers"]) == (1, 0, 0)
    assert stats.shoot_stats(frames.limit(0), subjects).collect() == []


def test_files(spark, tmp_path):
    from burstlake.sources import files

    (tmp_path / "known.csv").write_text("\ufeffPlate, Make ,make\nab 12,Audi,BMW\n , x,y\n", encoding="utf-8")
    known, skipped = files.read_registry(spark, str(tmp_path / "known.csv"))
    assert [(r["plate"], r["make"]) for r in known.collect()] == [("AB12", "BMW")] and skipped.first()["skipped"] == 1
    files.write_registry(known, str(tmp_path / "out"))
    assert files.read_registry(spark, str(tmp_path / "out"))[0].count() == 1
    (tmp_path / "entries.csv").write_text("Number,Driver,Team\n#007,Ann,\n,Bo,x\n")
    assert [(r["number"], r["fields"]) for r in files.read_entries(spark, str(tmp_path / "entries.csv")).collect()] == [("7", {"driver": "Ann"})]
    (tmp_path / "entries.json").write_text(json.dumps([{"No": 5, "Driver": "Cy"}]))
    assert files.read_entries(spark, str(tmp_path / "entries.json")).first()["number"] == "5"
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.json").write_text(json.dumps({"format": "f", "version": 1, "album": {"job_id": 3}, "photos": [{"path": "p", "rating": 4}]}))
    (box / "b.json").write_text("{broken")
    (box / "c.json").write_text(json.dumps({"format": "other", "version": 1, "photos": []}))
    good, bad = files.read_packages(spark, str(box), "f")
    assert [(r["job_id"], r["path"], r["rating"]) for r in files.photos(good).collect()] == [(3, "p", 4)]
    assert sorted(r["reason"] for r in bad.collect()) == ["another format", "not JSON"]
    (tmp_path / "x.CR3").write_bytes(b"1234")
    (tmp_path / "x.txt").write_bytes(b"1")
    assert [r["size"] for r in files.scan_images(spark, str(tmp_path)).collect()] == [4]


def test_files_are_offered_once_settled(spark, tmp_path):
    from burstlake.streaming.watch import settled

    schema = "path string, size long, mtime double, seen double"
    rows = [("a", 1, 1.0, 0.0), ("a", 2, 2.0, 15.0), ("a", 2, 2.0, 30.0), ("a", 2, 2.0, 40.0), ("a", 2, 2.0, 60.0), ("b", 1, 1.0, 40.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = settled(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert [(r["path"], r["seen"]) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()] == [("a", 40.0)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_places_of_large_groups_need_no_lists(spark):
    values = [("a", float(k * 37 % 101)) for k in range(101)] + [("b", 5.0)] * 40 + [("b", 7.0)] * 10 + [(None, 1.0), ("c", None), ("b", None)]
    df = spark.createDataFrame(values, "g string, v double")
    got = evaluate.nearest_percentile(df, ["g"], "v", 90)
    assert {r["g"]: r["v"] for r in got.collect()} == {"a": 90.0, "b": 7.0, None: 1.0, "c": None}
    colours = spark.createDataFrame([("g", f"#{k:02x}{255 - k:02x}07") for k in range(200)], "g string, c string")
    middle = votes.median_colour(colours, "g", "c")
    assert [tuple(r) for r in middle.collect()] == [("g", "#649c07")]
    assert "collect_list" not in plan(got) + plan(middle)


def test_numbers_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = lineage.numbered(df.repartition(4), [F.col("x").desc()], "place")
    assert {(r["x"], r["place"]) for r in got.collect()} == {(x, 1000 - x) for x in range(1000)}


def test_large_cameras_and_albums_are_scanned_in_batches(spark):
    frames = [(c, 100 * k + j, 40.0 * k + j, float(j), None, 50.0) for c in ("x", None) for k in range(30) for j in range(3)]  # brackets
    frames += [("x", 10_000 + k, 20_000.0 + 60 * k, None, None, 50.0) for k in range(40)] + [("x", 90_000, None, 1.0, 1.0, 50.0)]
    df = spark.createDataFrame(frames, "camera string, frame_id long, taken double, ev double, focus double, focal double")
    faces = spark.createDataFrame([(k % 2, k, [1.0, 0.1 * (k % 3)] if k % 5 else [-0.1, 1.0]) for k in range(60)], "album int, det long, v array<double>")
    before, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for n in (10_000, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found, people = sequence.sets(df), clusters.cluster_faces(faces, "album", "det", "v")
            assert "FlatMapGroups" not in plan(found) + plan(people)
            got.append((sorted(map(repr, found.collect())), sorted(map(tuple, people.collect()))))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1]
    assert len(got[0][0]) == len(frames) and len(got[0][1]) == 60
    assert sum("bracket" in r for r in got[0][0]) == 180 and sum("interval" in r for r in got[0][0]) == 40
    assert {(r[0], r[2]) for r in got[0][1]} == {(0, 0), (0, 2), (1, 1), (1, 5)}
