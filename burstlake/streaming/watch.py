"""Live albums: files that have settled, regrouping of touched albums, and live counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lineage import cut
from ..sources.files import photos, read_packages

#: Seconds without a change until a file is taken, and without a sighting until it is forgotten.
SETTLE, GONE = 20.0, 60.0


def settled(sightings: DataFrame, settle: float = SETTLE, gone: float | None = GONE, late: str = "10 seconds", polled: bool = True) -> DataFrame:
    """(path, size, mtime, seen) of files once they have not changed for ``settle`` seconds, each once.

    ``sightings``: a stream of (path, size, mtime, seen), a row for each file and poll. A first sighting is never enough, and a change starts the
    clock again. A file that no poll has seen for ``gone`` seconds (null: never) is forgotten, and its state goes with a timer once the watermark
    (``late`` behind the latest sighting) has passed; if it comes back, it settles anew. Where only changes are told, not ``polled``, a file settles
    without a further sighting, when the watermark has passed its last change by ``settle``; a null size says that it has gone.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, mtime, since, last, offered = state.get if state.exists else (-1, -1.0, 0.0, 0.0, False)
        known, out = state.exists, []
        if state.hasTimedOut:
            if not polled and not offered:
                out.append((key[0], size, mtime, since + settle))
            state.remove()
            yield pd.DataFrame(out, columns=["path", "size", "mtime", "seen"])
            return
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["size", "mtime", "seen"])]).sort_values("seen")
        for s, m, seen in zip(rows["size"], rows["mtime"], rows["seen"], strict=True):
            if pd.isna(s):
                known = False
                continue
            if not polled and known and not offered and seen - since >= settle:
                out.append((key[0], size, mtime, since + settle))  # it had settled before this change
            if not known or (s, m) != (size, mtime) or (gone is not None and polled and seen - last > gone):
                known, size, mtime, since, offered = True, int(s), float(m), float(seen), False
            elif polled and not offered and seen - since >= settle:
                offered = True
                out.append((key[0], size, mtime, float(seen)))
            last = float(seen)
        if known:
            state.update((size, mtime, since, last, offered))
            wait = since + settle if not polled else None if gone is None else last + gone
            if wait is not None:
                state.setTimeoutTimestamp(max(int(wait * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["path", "size", "mtime", "seen"])

    timed = sightings.withColumn("_at", F.timestamp_micros((F.col("seen") * 1_000_000).cast("long"))).withWatermark("_at", late)
    return timed.groupBy("path").applyInPandasWithState(step, "path string, size long, mtime double, seen double", "size long, mtime double, since double, last double, offered boolean", "append", GroupStateTimeout.EventTimeTimeout)


def live_sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Counts of each session of ``key`` once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def live_counts(events: DataFrame, at: str, width: str, slide: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), *keys, "n")


def regroup_touched(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], plan: Callable[[DataFrame], DataFrame], checkpoint: str, album: str = "job_id") -> StreamingQuery:
    """After each batch, ``plan`` over the albums that it touched: a late frame can join bursts, so they are made anew."""

    def batch(rows: DataFrame, number: int) -> None:
        touched = rows.select(album).distinct()
        write(plan(read().join(touched, album, "left_semi")), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regroup_into(stream: DataFrame, read: Callable[[], DataFrame], plan: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, album: str = "job_id") -> StreamingQuery:
    """``plan`` over the albums that each batch touches, into ``folder``/rows, a partition an album, so that a batch that runs twice leaves one result.

    Albums are written over, not appended, and a ledger in ``folder``/ledger tells which batches are done: one that had failed before its entry
    is made anew from what the frames are now, and replaces what it had left; one that has its entry is passed over.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger/batch={number}")
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(place):
            return
        touched = rows.select(album).distinct()
        made = plan(read().join(touched, album, "left_semi"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(album).parquet(f"{folder}/rows")
        store.mkdirs(place)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """A pass that is taken up again only sees rows whose result is missing."""
    return rows.join(done.select(key), key, "left_anti")


def consume_inbox(spark: SparkSession, folder: str, name: str, known: DataFrame, apply: Callable[[DataFrame], None]) -> DataFrame:
    """The packages in ``folder``, each taken once; name and to (done, failed or left) of every file.

    Bad files are moved to ``failed`` with what is wrong in the name's ``.reason`` file; good ones whose photos are ``known`` (path) go to ``apply`` together and are moved to
    ``done`` before it is called, so that one that ends in the middle is not applied again; those that match nothing stay. Files are moved by the store's own rename.
    """
    good, bad = read_packages(spark, folder, name)
    rows = photos(good)
    hit = rows.join(known.select("path").distinct(), "path", "left_semi")
    matched = [r["file"] for r in hit.select("file").distinct().collect()]  # packages of one inbox, as listed by the store
    every, failed = [r["file"] for r in good.select("file").distinct().collect()], {r["file"]: r["reason"] for r in bad.collect()}
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = cut(hit)
    out = []
    for file in sorted([*every, *failed]):
        to = "failed" if file in failed else "done" if file in matched else "left"
        if to != "left":
            store.mkdirs(path(f"{folder}/{to}"))
            store.rename(path(file), path(f"{folder}/{to}/{path(file).getName()}"))
        if file in failed:
            note = store.create(path(f"{folder}/failed/{path(file).getName()}.reason"))
            note.write(bytearray(failed[file].encode()))
            note.close()
        out.append((path(file).getName(), to))
    if matched:
        apply(taken)
    return spark.createDataFrame(out, "name string, to string")


def joined_streams(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str) -> DataFrame:
    """Rows of two streams with one ``key`` at most ``within`` apart in ``at`` (columns of the right side end in _r); both forget what is older than ``late`` and that."""
    a = left.withWatermark(at, late)
    b = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns]).withWatermark(f"{at}_r", late)
    near = F.col(f"{at}_r").between(F.col(at) - F.expr(f"interval {within}"), F.col(at) + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col(f"{key}_r")) & near)
