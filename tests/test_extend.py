"""Functions that users add: SQL calls, and judges whose failures stay with their rows."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from burstlake.functions import extend


def test_a_failing_picture_costs_its_own_row_only(spark):
    rows = [(k, None if k == 7 else b"" if k == 8 else (b"x" if k % 5 == 0 else b"p") + b"jump" * (k % 3)) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, image binary").repartition(3)
    got = {r["id"]: r for r in extend.judged(df, partial(extend.ByteJudge, ord("x")), "id", "image", "c", ["jump", "um", "smoke"], 8).collect()}
    assert len(got) == 40
    for k, image in rows:
        r = got[k]
        if image is None:
            assert (r["moments"], r["error"]) == (None, None)
        elif k % 5 == 0:
            assert r["moments"] is None and r["error"] == "RuntimeError: no answer"
        else:
            assert r["moments"] == (["jump", "um"] if k % 3 and image else []) and r["error"] is None and 0 <= r["confidence"] <= 1


def test_answers_are_checked():
    class Odd:
        name = "odd"

        def judge(self, context, vocabulary, images):
            return [{"moments": ["b", "zz", "a", "a"], "confidence": 7}] * (len(images) if len(images) < 3 else 1)

    found = extend._answers(Odd(), "", ["a", "b"], [b"1", b"2", b"3"])  # one answer to three is none; alone they are answered
    assert found == [(["a", "b"], 1.0, "odd", None)] * 3

    class Silent(Odd):
        def judge(self, context, vocabulary, images):
            return [{"moments": []}]

    assert extend._answers(Silent(), "", [], [b"1"])[0][3] == "KeyError: 'confidence'"


def test_functions_are_called_in_sql(spark):
    extend.register(spark)
    extend.register(spark)
    rows = [("a", t) for t in (0.0, 1.0, 9.0, 10.5, None)] + [(None, 3.0), ("b", None)]
    spark.createDataFrame(rows, "key string, taken double").createOrReplaceTempView("shots")
    got = spark.sql("SELECT * FROM burst_spans(2.0D, TABLE(SELECT * FROM shots) PARTITION BY key ORDER BY taken)").collect()
    assert sorted((tuple(r) for r in got), key=repr) == [("a", 0, 0.0, 1.0, 2), ("a", 1, 9.0, 10.5, 2), (None, 0, 3.0, 3.0, 1)]
    scores = spark.createDataFrame([("g", 0.1, False), ("g", 0.4, True), ("g", 0.4, False), ("g", None, True), ("h", 1.0, True)], "g string, s double, t boolean")
    assert {r["g"]: r["a"] for r in scores.groupBy("g").agg(extend.auc("s", "t").alias("a")).collect()} == {"g": pytest.approx(0.75), "h": None}
    plan = spark.sql("SELECT needs_review(taken, NULL, NULL, NULL, 0.5D) AS r FROM shots")
    assert [r["r"] for r in plan.collect()] == [True, False, False, False, False, False, False]
    assert "PythonUDF" not in plan._jdf.queryExecution().toString()


def test_framing_in_steps_equals_the_expression(spark):
    import random

    from burstlake.functions import framing

    rng = random.Random(51)
    box = lambda: tuple(rng.uniform(-10, 110) for _ in range(4))
    rows = [(k, *box(), [box() for _ in range(k % 3)], rng.choice([None, 0.0, 1.0, -2.0]), rng.choice([None, 0.0, 1.0]), bool(k % 2), rng.choice([None, 2.0]), 0.0 if k == 5 else 100.0) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double, others array<struct<x1:double,y1:double,x2:double,y2:double>>, dx double, dy double, signed boolean, tilt double, w double")
    given = {k: F.lit(80.0) if k == "h" else F.col(k) for k in framing.GIVEN}
    names = [*framing.MEASURED, "score"]
    steps = framing.framed(df, given, F.col("tilt"))
    m = framing.measured(F.col("w"), F.lit(80.0), F.struct("x1", "y1", "x2", "y2"), F.col("others"), F.col("dx"), F.col("dy"), F.col("signed"))
    whole = df.select("id", m.alias("m")).join(df.select("id", "tilt"), "id").select("id", "m.*", framing.framing_score(F.col("m"), F.col("tilt")).alias("score"))
    one, two = ({r["id"]: tuple(r[c] for c in names) for r in x.collect()} for x in (steps, whole))
    assert one == two and one[5][:9] == (None,) * 9 and one[5][9] == 0.5
    assert steps._jdf.queryExecution().executedPlan().toString().count("greatest(") < 60
