"""Streams: files that settle, go and come again, and batches that run twice."""

import os

import pytest
from pyspark.sql import functions as F

from burstlake.streaming.watch import regroup_into, settled

SEEN = "path string, size long, mtime double, seen double"


def polls(spark, tmp_path, batches, **options):
    """One batch a list of sightings."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = settled(spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), late="0 seconds", **options)
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        now = sorted((r["path"], r["size"], r["seen"]) for r in spark.read.schema(SEEN).parquet(f"{tmp_path}/out").collect())
        out.append([x for x in now if x not in sum(out, [])])
    return out


def test_a_file_that_goes_and_comes_again_settles_anew(spark, tmp_path):
    a, b = lambda t: ("a", 1, 1.0, 1000.0 + t), lambda t: ("b", 5, 1.0, 1000.0 + t)
    got = polls(spark, tmp_path, [[a(0), b(0)], [a(10), b(10)], [a(20), b(20)], [b(40)], [b(90)], [b(120)], [a(130), b(130)], [a(140), b(140)], [a(150), b(150)]], settle=20.0, gone=60.0)
    # b is offered once though it stays; a is offered, gone for 110 s, and offered again 20 s after it came back
    assert got == [[], [], [("a", 1, 1020.0), ("b", 5, 1020.0)], [], [], [], [], [], [("a", 1, 1150.0)]]


def test_a_change_settles_without_another_word(spark, tmp_path):
    got = polls(spark, tmp_path, [[("a", 1, 1.0, 0.0), ("b", 1, 1.0, 5.0)], [("a", 2, 2.0, 10.0)], [("b", None, None, 20.0)], [("c", 1, 1.0, 100.0)]], settle=20.0, polled=False)
    assert sum(got, []) == [("a", 2, 30.0)]  # b had gone, c has not settled yet


def test_a_batch_that_runs_twice_leaves_one_result(spark, tmp_path):
    frames = lambda rows: spark.createDataFrame(rows, "id long, job_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/frames")
    read = lambda: spark.read.parquet(f"{tmp_path}/frames")
    stream = lambda: spark.readStream.schema("id long, job_id long").parquet(f"{tmp_path}/frames")
    count = lambda df: df.groupBy("job_id").agg(F.count("*").alias("n"), F.max("id").alias("latest"))
    rows = lambda: sorted((r["job_id"], r["n"], r["latest"]) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    go = lambda plan: regroup_into(stream(), read, plan, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()

    frames([(1, 1), (2, 1), (3, 2)])
    go(count)
    assert rows() == [(1, 2, 2), (2, 1, 3)]
    frames([(4, 2)])

    class Stopped(Exception):
        pass

    def fails_after_the_write(df):
        found = count(df)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{tmp_path}/out/rows")
        raise Stopped

    with pytest.raises(Exception, match="Stopped"):
        go(fails_after_the_write)
    assert rows() == [(1, 2, 2), (2, 2, 4)]
    frames([(5, 3)])
    go(count)  # the failed batch first, then the new one
    assert rows() == [(1, 2, 2), (2, 2, 4), (3, 1, 5)]
    last = max(os.listdir(f"{tmp_path}/ck/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    for name in (last, f".{last}.crc"):
        os.remove(f"{tmp_path}/ck/commits/{name}")
    calls = []
    go(lambda df: calls.append(1) or count(df))  # its commit was lost, but the ledger has it
    assert calls == [] and rows() == [(1, 2, 2), (2, 2, 4), (3, 1, 5)]
