"""What the third round's findings showed, on small tables."""

import duckdb

from burstlake.plans import queries, review  # noqa: F401  registers its queries, too


def test_burst_marks_without_singles(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k * 97 AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(20 AS BIGINT) AS user_id, 'view' AS event_type, 80.0 AS value FROM range(0, 60, 20) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for name in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = {r["what"]: (r["n"], r["total"]) for r in queries.QUERIES["v3_burst_marks"](spark, str(tmp_path)).collect()}
    assert got["single"] == (0, 0)
    assert got == {what: (n, total) for what, n, total in con.execute(queries.ORACLES["v3_burst_marks"]).fetchall()}


def test_names_keep_all_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["f19_names"](spark, sf)
    assert found.columns == ["p_partkey", "sidecar", "stem", "settled", "colour"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(con.execute(queries.ORACLES["f19_names"]).fetchall(), key=repr)


def test_near_frames_are_decided_where_they_meet(spark):
    """What is near in hash alone is not written: at 60 times the frames a minute that was 3,600 times the pairs on disk."""
    import os

    from pyspark.sql import functions as F

    from burstlake.operators import clusters, lineage

    folder = f"{lineage.work_dir(spark)}/burstlake"
    held = lambda: {f for f in os.listdir(folder) if not f.startswith(("placed", "meet"))} if os.path.isdir(folder) else set()
    before = held()
    frames = spark.range(600).select("id", (F.col("id") / 2).alias("taken"), F.lit(0).cast("long").alias("phash"), F.lit(None).cast("long").alias("burst"))
    looks = frames.select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k == F.col("id") % 10).cast("double")).alias("embedding"))
    found = clusters.near_in_time(frames, looks, block=50)
    assert {(r["a"] % 10, r["b"] % 10) for r in found.collect()} == {(k, k) for k in range(10)} and found.count() == 10 * 60 * 59 // 2
    assert held() == before  # no table of candidate pairs


def test_sets_read_a_long_streak_once():
    """An uneven streak is no interval from any of its frames: each was read to its end from each frame on."""
    import time

    import numpy as np
    import pandas as pd

    from burstlake.operators.sequence import SetScan

    n = 20_000
    taken = np.cumsum(np.where(np.arange(n) % 2, 3.0, 5.0))
    rows = pd.DataFrame({"frame_id": np.arange(n), "taken": taken, "ev": np.nan, "focus": np.nan, "focal": 50.0})
    began = time.time()
    found = pd.concat(list(SetScan().step(rows, True)))
    assert len(found) == n and found["set_id"].isna().all()
    assert time.time() - began < 20  # minutes before
    even = pd.concat(list(SetScan().step(rows.assign(taken=np.arange(n) * 3.0), True)))
    assert set(even["set_id"]) == {0} and set(even["set_kind"]) == {"interval"}


def test_choices_of_groups_over_batches(spark):
    """Groups that Arrow batches cut, and steps that shuffle nothing."""
    import numpy as np
    import pytest

    from burstlake.operators import evaluate

    rng = np.random.default_rng(3)
    rows = [(g, float(a), k == g % n) for g, n in enumerate([1, 7, 40, 3, 25]) for k, a in enumerate(rng.normal(0, 1, n))]
    df = spark.createDataFrame(rows, "g long, a double, y boolean").repartition(3)
    want = evaluate.fit_choice(df, ["g"], ["a"], "y", rounds=3, rate=0.2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert evaluate.fit_choice(df, ["g"], ["a"], "y", rounds=3, rate=0.2) == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = {g: np.array([r[1] for r in rows if r[0] == g]) for g in range(5)}
    e = {g: np.exp(v) / np.exp(v).sum() for g, v in x.items()}
    gradient = sum(float(v @ e[g]) - v[g % len(v)] for g, v in x.items())
    held = evaluate._choice_gradient(np.array([1.0]))
    import pyarrow as pa

    flat = [(a, int(k == g % len(v)), k == 0) for g, v in x.items() for k, a in enumerate(v)]
    table = pa.table({"a": [f[0] for f in flat], "_y": pa.array([f[1] for f in flat], pa.int32()), "_new": [f[2] for f in flat]})
    for size in (1, 3, 1000):
        assert sum(b.column(0).to_pylist()[0] for b in held(iter(table.to_batches(max_chunksize=size)))) == pytest.approx(gradient)


def test_merge_sweep_reads_its_bursts_once(spark):
    """Bursts and members were made anew for each rule."""
    from pyspark.sql import functions as F

    from burstlake.operators import evaluate

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frames = spark.createDataFrame([("c", 1, True), ("c", 2, True), ("c", 3, False)], "camera string, burst long, exported boolean").mapInArrow(count, "camera string, burst long, exported boolean")
    ends = spark.createDataFrame([("c", 1, 0.0, 1.0), ("c", 2, 5.0, 6.0), ("c", 3, 30.0, 31.0)], "camera string, burst long, started double, ended double")
    rules = spark.createDataFrame([("a", 10.0, 30.0), ("b", 60.0, 60.0), ("c", 1.0, 30.0)], "rule string, gap double, span double")
    got = {r["rule"]: (r["groups"], r["two_sent"]) for r in evaluate.merge_sweep(ends, frames, "camera", rules, F.lit(True)).collect()}
    assert got == {"a": (2, 1), "b": (1, 1), "c": (3, 0)}
    assert seen.value == 3


def test_spans_are_found_a_batch_at_a_time(spark):
    """The table function was called once a row; a run that batches cut is still one."""
    import numpy as np
    import pyarrow as pa

    from burstlake.functions import extend

    n = 200_000
    taken = np.cumsum(np.where(np.arange(n) % 10, 1.0, 5.0))
    scan = extend.BurstSpans.func()
    out = []
    for at in range(0, n, 777):
        part = pa.array([None, *taken[at : at + 777].tolist()], pa.float64())
        out += scan.eval(pa.array([2.0] * len(part)), pa.RecordBatch.from_arrays([pa.array(["a"] * len(part)), part], names=["key", "taken"]))
    out += scan.terminate()
    spans = pa.Table.from_batches(out).to_pydict()
    assert spans["session"] == list(range(n // 10)) and set(spans["n"]) == {10} and set(spans["key"]) == {"a"}
    assert spans["started"] == taken[::10].tolist() and spans["ended"] == taken[9::10].tolist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        extend.register(spark)
        rows = spark.createDataFrame([(k, float(t)) for k in "ab" for t in (0, 1, 2, 3, 9, 10, 20, 21, 22, 23)], "key string, taken double")
        got = spark.sql("SELECT * FROM burst_spans(2.0D, TABLE(SELECT * FROM {rows}) PARTITION BY key ORDER BY taken)", rows=rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(k, *s) for k in "ab" for s in ((0, 0.0, 3.0, 4), (1, 9.0, 10.0, 2), (2, 20.0, 23.0, 4))]


def test_readings_read_attributes_once(spark):
    """JSON was parsed anew for plates, fields, first rows and loose ones, and several times for each value."""
    from burstlake.operators import registry

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "id long, job_id long, group_key long, plate string, attributes string, number string"
    rows = [(1, 1, 7, "AB1", '{"make": ["Kia", "", null, 0], "race_number": 12, "sponsors": ["Oil", true, {}]}', None), (2, 1, 7, "ab-1", '{"make": "Kia", "team": [], "group_model": "Rio"}', None), (3, 1, None, "CD2", '{"team": " Red ", "race_number": 3}', "8"), (4, 1, None, "EF3", "[1]", "9"), (5, 1, 8, "", "{}", None)]
    found = registry.readings(spark.createDataFrame(rows, kind).mapInArrow(count, kind))
    got = {r["plate"]: (r["make"], r["model"], r["team"], r["sponsors"], r["race_number"]) for r in found.collect()}
    assert got == {"AB1": ("Kia", None, None, "Oil, True", "12"), "CD2": (None, None, " Red ", None, "8")}
    assert seen.value == len(rows)


def test_scans_of_small_keys_go_out_together():
    """Each small key was a frame of its own, made and sent for itself."""
    from functools import partial

    import numpy as np
    import pandas as pd

    from burstlake.operators import grouping, ranges
    from burstlake.operators.moments import Rules

    keys, n = 500, 20
    rows = pd.DataFrame({"frame_id": np.arange(keys * n), "taken": np.tile(np.arange(n) // 5 * 9.0 + np.arange(n) % 5, keys), "portrait": False, "panning": False, "scene": None, "livery": None} | {c: np.nan for c in ("x1", "y1", "x2", "y2", "ev", "focus", "focal", "aperture", "shutter")})
    rows = rows.assign(_key=[f"={k}" for k in np.arange(keys * n) // n], _part=np.int32(0), _at=np.arange(keys * n), _state=None)
    names = [c.split()[0] for c in grouping.FOUND.split(", ")]
    for sets in (False, True):
        run = ranges._runner(partial(grouping.Grouping, 1.5, True, Rules(), sets), names, {}, {}, False)
        found = list(run(rows[k : k + 3333] for k in range(0, len(rows), 3333)))
        assert len(found) <= 4
        whole = pd.concat(found).sort_values("frame_id")
        assert whole["frame_id"].tolist() == rows["frame_id"].tolist()
        assert whole["moment"].tolist() == (rows["frame_id"] // 5 * 5).tolist() and whole["begins"].tolist() == (rows["frame_id"] % 5 == 0).tolist()


def test_one_python_function_a_task(spark, monkeypatch):
    from burstlake.llm import decontaminate, shared

    seen, stored = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, *more: seen.append(df) or stored(df, *more))
    item = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"well {item} then"), (2, "nothing here"), (None, item)], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    steps = [df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for df in (*seen, found)]
    assert max(steps) == 1 and sum(steps) >= 7
    assert sorted(((r["doc_id"], r["item_id"], r["start"]) for r in found.collect()), key=str) == [(1, 5, 5), (None, 5, 0)]


def test_labelled_rows_are_picked_without_python_on_executors(spark, monkeypatch):
    from pyspark import SparkContext

    from burstlake.llm import toxicity

    rows = [(k, f"{'vile filth' if k % 2 else 'kind words'} of text {k}") for k in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    held = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, weight: held.append(rows) or toxicity.Model())
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: 1 / 0)
    toxicity.learned(docs, labels)
    assert len(held[0]) > 30 and set(held[0]) <= {(t, k % 2) for k, t in rows}
