"""Stored sums against reports from scratch, sketches against exact counts, and resets over several tables."""

import pytest
from pyspark.sql import functions as F

from burstlake.operators import resets
from burstlake.plans import rollups

FRAME = "id long, job_id long, path string, status string, copy_of long, camera string, lens string, iso long, f_number double, exposure_time double, focal_length double, taken_at double, file_size long, stars long, rejected long, picked long, burst_pick long, burst_key long, time_burst long, catalog_pick long, af_x1 double, af_y1 double, af_x2 double, af_y2 double, af_sharpness double, width double, height double"


def frame(k, job, **v):
    row = {"id": k, "job_id": job, "path": f"p{k}", "status": "done", "copy_of": 0, "camera": "c", "lens": "l", "iso": 100, "f_number": 2.8, "exposure_time": 0.01, "focal_length": 50.0, "taken_at": 100.0 * job + k, "file_size": 10, "burst_key": k % 3, "time_burst": k % 3, "width": 10.0, "height": 10.0} | v
    return tuple(row.get(c.split()[0]) for c in FRAME.split(", "))


@pytest.fixture
def library(spark):
    rows = [frame(k, 1 + k % 3, picked=int(k == 4), burst_pick=int(k % 4 == 0), catalog_pick=k % 2, stars=k % 3 or None) for k in range(30)]
    rows += [frame(50, 4), frame(51, 5, taken_at=None), frame(52, 1, status="error"), frame(53, 2, copy_of=9), frame(54, 5, lens="")]
    subjects = spark.createDataFrame([(k, 0, 0, "sharp", 1, "vehicle", 0.0, 0.0, 5.0, 5.0) for k in range(0, 30, 2)], "image_id long, panning long, burst_pick long, sharpness_verdict string, stars long, region_type string, x1 double, y1 double, x2 double, y2 double")
    return rows, subjects


def collected(found):
    return [sorted((tuple(r) for r in df.collect()), key=repr) for df in found]


def test_reports_after_an_edit_equal_those_from_scratch(spark, library):
    rows, subjects = library
    before = spark.createDataFrame(rows, FRAME)
    known = rollups.rolled_up(before, subjects)
    # a frame of album 1 is rejected, album 4 goes, album 6 comes
    after = spark.createDataFrame([frame(3, 1, rejected=1) if r[0] == 3 else r for r in rows if r[1] != 4] + [frame(60, 6), frame(61, 6, iso=400)], FRAME)
    now = rollups.refreshed(known, after, subjects, spark.createDataFrame([(1,), (4,), (6,), (1,)], "job_id long"))
    whole = rollups.rolled_up(after, subjects)
    assert collected(rollups.album_reports(now)) == collected(rollups.album_reports(whole)) != collected(rollups.album_reports(known))
    assert collected(rollups.library_reports(now)) == collected(rollups.library_reports(whole))
    total = rollups.library_reports(whole)[0].first().asDict()
    assert (total["albums"], total["frames"], total["complete_albums"], total["complete_frames"], total["copies_hidden"]) == (5, 34, 4, 32, 1)
    assert total["timed_albums"] == 4 and total["longest_seconds"] == 27.0 and total["shooting_seconds"] == 27.0 * 3 + 1
    one = {r["job_id"]: r for r in rollups.album_reports(whole)[0].collect()}[2]
    # album 2 holds 1, 4, ..., 28: 4 by hand in its burst 1, and the engine's 16 and 28 of that burst give way
    assert (one["compared"], one["matched"], one["match_percent"]) == (1, 0, 0)


def test_blank_details_are_filled_from_headers(spark):
    rows = [frame(1, 1, lens=None), frame(2, 1, lens=""), frame(3, 1, iso=None), frame(4, 1), frame(5, 1, lens=None)]
    headers = spark.createDataFrame([("p1", "kit", 50), ("p2", "kit", None), ("p3", "other", 200), ("p4", "other", 300)], "path string, lens string, iso long")
    found = rollups.backfilled(spark.createDataFrame(rows, FRAME), headers)
    assert [(r["lens"], r["iso"], r["was_filled"]) for r in found.orderBy("id").collect()] == [("kit", 100, True), ("kit", 100, True), ("l", 200, True), ("l", 100, False), (None, 100, False)]
    assert [f.dataType for f in found.schema][:-1] == [f.dataType for f in spark.createDataFrame(rows, FRAME).schema]


def test_sketches_are_near_exact_counts(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("album"), (F.col("id") % 11).alias("day"), (F.col("id") * 7919 % 20_011).alias("item"))
    partial = rollups.distinct_rollup(rows, ["album", "day"], "item")
    got = {(r["level"], r["album"], r["day"]): r for r in rollups.distinct_by_sets(partial, [["album", "day"], ["album"], []]).collect()}
    for level, keys in enumerate([["album", "day"], ["album"], []]):
        for r in rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("item").alias("d")).collect():
            found = got[level, r.asDict().get("album"), r.asDict().get("day")]
            assert found["rows"] == r["n"] and abs(found["about"] - r["d"]) <= 4 * 0.0163 * r["d"]


@pytest.fixture
def tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "jobs": make([(1, "done"), (2, "done")], "id long, status string"),
        "images": make([(10, 1, "a", "done", 3, 1, 1, 0.5, 7, "e"), (11, 1, "b", "done", None, 0, 0, 0.6, 8, None), (20, 2, "c", "done", 4, 1, 0, 0.7, 9, None), (30, 9, "d", "done", 5, 1, 0, 0.1, 1, None)], "id long, job_id long, path string, status string, stars long, rejected long, picked long, rating double, burst_key long, error string"),
        "detections": make([(100, 10, 0, "{}", "7", "vlm", 0.5, 1, 2, 1, "x"), (101, 10, 1, "{1}", "8", "ocr", 0.6, 1, 3, 0, None), (200, 20, 0, "{2}", "9", "vlm", 0.7, 2, 4, 1, "y"), (300, 99, 0, "{3}", "1", "vlm", 0.9, 3, 5, 1, None)], "id long, image_id long, reviewed long, attributes string, number string, number_source string, number_conf double, group_key long, stars long, rejected long, crop_path string"),
        "faces": make([(1000, 100), (2000, 200)], "id long, detection_id long"),
        "registry": make([("AB1",)], "plate string"),
    }


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_resets(spark, tables):
    out = resets.reset_identifications(tables, 1)["detections"]
    assert rows(out, "id", "attributes", "number", "number_conf", "group_key") == [(100, None, None, None, None), (101, "{1}", "8", 0.6, None), (200, "{2}", "9", 0.7, 2), (300, "{3}", "1", 0.9, 3)]
    out = resets.reset_ratings(tables, 1)
    assert rows(out["images"], "id", "stars", "rejected") == [(10, None, 0), (11, None, 0), (20, 4, 1), (30, 5, 1)]
    assert rows(out["detections"], "id", "stars", "rejected") == [(100, None, 0), (101, None, 0), (200, 4, 1), (300, 5, 1)]
    out = resets.reset_detections(tables, 1)
    assert rows(out["detections"], "id") == [(200,), (300,)] and rows(out["faces"], "id") == [(2000,)]
    assert rows(out["images"], "id", "status", "rating", "burst_key", "stars", "error")[0] == (10, "pending", None, None, 3, None) and rows(out["jobs"], "id", "status") == [(1, "stopped"), (2, "done")]
    out = resets.reset_album(tables, 1)
    assert rows(out["images"], "id", "path", "status", "stars", "rejected", "picked", "rating") == [(10, "a", "pending", None, 0, 0, None), (11, "b", "pending", None, 0, 0, None), (20, "c", "done", 4, 1, 0, 0.7), (30, "d", "done", 5, 1, 0, 0.1)]
    assert rows(out["jobs"], "id", "status") == [(1, "indexed"), (2, "done")]
    out = resets.reset_all(tables)
    assert [out[t].count() for t in ("jobs", "images", "detections", "faces", "registry")] == [0, 1, 1, 0, 1]  # what no album is known of stays
    out = resets.reset_ratings(tables)
    assert rows(out["images"], "stars") == [(None,)] * 4 and rows(out["detections"], "id", "stars") == [(100, None), (101, None), (200, None), (300, 5)]


def test_cascades_follow_declared_keys(spark):
    keys = resets.Keys({"a": "id", "b": "id", "c": "id"}, (("c", "b_id", "b"), ("c", "a_id", "a"), ("b", "a_id", "a")))
    assert [p[0] for p in keys.depending("a")].index("b") < [p[::2] for p in keys.depending("a")].index(("c", "b"))
    with pytest.raises(ValueError, match="circle"):
        resets.Keys({"a": "id", "b": "id"}, (("b", "a_id", "a"), ("a", "b_id", "b"))).depending("a")
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = resets.without({"a": make([(1,), (2,)], "id long"), "b": make([(5, 1), (6, 2), (7, None)], "id long, a_id long"), "c": make([(8, 5, 2), (9, 6, 1), (10, 6, 2), (11, 7, None)], "id long, b_id long, a_id long")}, "a", F.col("id") == 1, keys)
    assert [rows(found[t], "id") for t in "abc"] == [[(2,)], [(6,), (7,)], [(10,), (11,)]]


def test_cached_files_that_nothing_refers_to(spark, tables):
    files = spark.createDataFrame([("/c/thumb-10.jpg", 10), ("/c/view-10.jpg", 100), ("/c/crop-100.jpg", 1000), ("/c/crop-101.jpg", 1), ("/c/thumb-9999.jpg", 20), ("/c/view-9999.jpg", 200), ("/c/crop-10.jpg", 2000), ("/c/notes.txt", 5), ("/c/thumb-x.jpg", 7), ("/c/view-99999999999999999999.jpg", 7), ("view-20.jpg", 3)], "path string, bytes long")
    found = resets.cached(files, tables["images"], tables["detections"])
    assert {r["slot"]: (r["files"], r["bytes"]) for r in resets.cache_survey(found).collect()} == {"thumb": (1, 10), "view": (2, 103), "crop": (1, 1000), "orphaned": (4, 2221), "total": (8, 3334)}
    assert rows(resets.doomed(found), "id") == [(10,), (101,), (9999,), (9999,)]
    assert rows(resets.doomed(found, orphaned=False, of_frames=spark.createDataFrame([(20,)], "id long")), "path") == [("view-20.jpg",)]
    assert rows(resets.doomed(found, orphaned=False, previews=True), "id") == [(10,), (20,), (9999,)]
