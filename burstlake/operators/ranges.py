"""Ordered scans of keys of any size: ranges are scanned side by side, and what is open at the end of one is handed to the next."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut, tabled

#: Rows that a scan of many small keys gives at once.
OUT_ROWS = 4096

CONTROL = "_part int, _first boolean, _upto long, _state binary, _digest string"


class Scan(Protocol):
    """One pass over the rows of a key. It is handed on pickled, so it holds plain values only."""

    def restarts(self, rows: pd.DataFrame, before: pd.DataFrame | None) -> np.ndarray:
        """Where a scan begins afresh whatever came earlier, as seen from a row and the one ``before`` it (a frame of one row). At the first row of all, where there is none, it does not."""

    def step(self, rows: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
        """What is decided with these rows, where ``last`` says that the scan ends with them; rows may be none."""

    def held(self) -> object:
        """What is open, as plain values; none if nothing is."""


def _digest(scan: Scan) -> str | None:
    held = scan.held()
    return None if held is None else hashlib.blake2b(repr(held).encode(), digest_size=16).hexdigest()


def _runner(make: Callable[[], Scan], names: list[str], opens: dict[int, str], entered: dict[int, str], again: bool):
    """Scans whole ranges, each in order. ``opens``: the key that goes on after a range; ``entered``: the key that came into it.

    Rows of a scan that began with a range whose key came into it are marked as first: another state may change them. ``again``: only
    those rows are given, after a row with the state that they begin with, and they end where the next scan begins.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, now, first, before, empty = None, None, False, None, None
        kept: list[tuple[pd.DataFrame, int, bool]] = []  # most keys have few rows: theirs go out together

        def keep(frames: Iterator[pd.DataFrame]) -> None:
            kept.extend((pdf if list(pdf.columns) == names else pdf[names], now[0], first) for pdf in frames if len(pdf))

        def out(least: int = 1) -> Iterator[pd.DataFrame]:
            sizes = [len(pdf) for pdf, _, _ in kept]
            if sum(sizes) >= least:
                told_of = {"_part": np.repeat(np.array([p for _, p, _ in kept], np.int32), sizes), "_first": np.repeat([f for _, _, f in kept], sizes)}
                whole = pd.concat([pdf for pdf, _, _ in kept], ignore_index=True) if len(kept) > 1 else kept[0][0]
                kept.clear()
                yield whole.assign(**told_of, _upto=pd.array([None] * len(whole), "Int64"), _state=None, _digest=None)

        def told(upto: int | None, state: bytes | None, digest: str | None) -> pd.DataFrame:
            row = {c: [None] for c in names} | {"_part": [np.int32(now[0])], "_first": [False], "_upto": pd.array([upto], "Int64"), "_state": [state], "_digest": [digest]}
            return pd.DataFrame(row)

        def end(goes_on: bool) -> Iterator[pd.DataFrame]:
            """The key ends here, or the range does and the key goes on."""
            if goes_on:
                if (digest := _digest(scan)) is not None:
                    yield told(None, cloudpickle.dumps(scan), digest)
            else:
                keep(scan.step(empty, True))

        for pdf in batches:
            parts, keys, given = pdf["_part"].to_numpy(), pdf["_key"].to_numpy(), pdf["_state"].notna().to_numpy()
            cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1])) + 1).tolist(), len(pdf)] if len(pdf) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                part, key = int(parts[low]), keys[low]
                if (part, key) != now:
                    if scan is not None:
                        yield from end(opens.get(now[0]) == now[1])
                    scan, now, before = make(), (part, key), None
                    first = entered.get(part) == key
                if given[low]:
                    scan = cloudpickle.loads(pdf["_state"].iat[low])
                    low += 1
                    if low == high:
                        empty = pdf.iloc[:0]
                        continue
                block, empty = pdf.iloc[low:high], pdf.iloc[:0]
                if first and not again:  # up to the first place where a scan begins afresh, what is found may change; after it no place matters
                    starts = np.flatnonzero(scan.restarts(block, before))
                    before = block.iloc[-1:]
                    if len(starts):
                        j = int(starts[0])
                        if j:
                            keep(scan.step(block.iloc[:j], False))
                        keep(scan.step(empty, True))
                        yield told(int(block["_at"].iat[j]), None, None)
                        scan, first, block = make(), False, block.iloc[j:]
                # a key that another follows is at its end
                whole = high < len(pdf) and opens.get(part) != key
                keep(scan.step(block, whole))
                if whole:
                    scan = None
                yield from out(OUT_ROWS)
        if scan is not None:
            yield from end(opens.get(now[0]) == now[1])
        yield from out()

    return run


def scanned(rows: DataFrame, key: list[Column], order: list[Column], make: Callable[[], Scan], schema: T.StructType, ranges: int | None = None, unread: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` of each ``key`` in ``order`` through scans that ``make`` makes, with the columns of ``schema``.

    Rows are sorted by ranges of key and order (one shuffle), and each range is scanned on its own, batch by batch. A scan that is
    open at a range's end is handed on if its key goes on. The next range had begun without it: its rows up to the first place where
    a scan begins afresh are scanned again with what was handed, all such ranges side by side. If a range has no such place, what is
    open at its end may have changed, and it is handed on again, until nothing changes. One row a range comes to the driver. Which
    ranges there are does not change the result; ``ranges`` is their number (that of shuffled partitions, if none is given). Columns
    that are ``unread`` serve the order alone.
    """
    spark = rows.sparkSession
    names = [f.name for f in schema.fields]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in key])
    keyed = rows.withColumn("_key", whole)
    ordered = cut(keyed.repartitionByRange(n, "_key", *order).sortWithinPartitions("_key", *order).withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}).drop(*unread))
    edges = ordered.groupBy("_part").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).orderBy("_part").collect()
    after = {a["_part"]: b["_part"] for a, b in zip(edges, edges[1:], strict=False) if a["hi"] == b["lo"]}
    entered = {b["_part"]: b["lo"] for b in edges if b["_part"] in after.values()}
    opens = {a["_part"]: a["hi"] for a in edges if a["_part"] in after}
    only = {e["_part"] for e in edges if e["lo"] == e["hi"]}
    # rows that tell of a range have none of the columns
    kind = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], *T.StructType.fromDDL(CONTROL).fields])
    given = ordered.withColumn("_state", F.lit(None).cast("binary"))
    rounds = [tabled(given.mapInPandas(_runner(make, names, opens, entered, False), kind), "scan")]
    control = rounds[0].where("_upto is not null or _digest is not null").groupBy("_part").agg(F.min("_upto").alias("upto"), F.max("_digest").alias("digest")).collect()
    upto = {r["_part"]: r["upto"] for r in control if r["upto"] is not None}
    now = {r["_part"]: r["digest"] for r in control}
    used: dict[int, str | None] = {}
    made, stated = ({e["_part"]: 0 for e in edges} for _ in range(2))  # the rounds whose first rows, and whose state at the end, hold
    while dirty := [(p, q) for p, q in after.items() if now.get(p) != used.get(q)]:
        wanted = spark.createDataFrame([(p, q, entered[q], upto.get(q), stated[p]) for p, q in dirty], "from_part int, to_part int, lo string, upto long, made int")
        state = None
        for k, done in enumerate(rounds):
            part = done.where("_digest is not null").join(wanted.where(F.col("made") == k), F.col("_part") == F.col("from_part")).select(F.col("to_part").alias("_part"), F.col("lo").alias("_key"), "_state")
            state = part if state is None else state.union(part)
        mine = given.join(wanted.select(F.col("to_part").alias("_part"), F.col("lo").alias("_key"), "upto"), ["_part", "_key"]).where("upto is null or _at < upto").drop("upto")
        both = mine.unionByName(state, allowMissingColumns=True).repartition("_part").sortWithinPartitions("_part", F.col("_state").isNull(), "_at")
        goes_on = {q: opens[q] for _, q in dirty if q in opens and q in only and q not in upto}
        done = tabled(both.mapInPandas(_runner(make, names, goes_on, entered, True), kind), "scan")
        rounds.append(done)
        found = {r["_part"]: r["_digest"] for r in done.where("_digest is not null").select("_part", "_digest").collect()}
        before = dict(now)
        for p, q in dirty:
            used[q] = before.get(p)
            made[q] = len(rounds) - 1
            if q in goes_on:
                now[q], stated[q] = found.get(q), len(rounds) - 1
    out = None
    for k, done in enumerate(rounds):
        parts = [p for p, r in made.items() if r == k]
        data = done.where("_upto is null and _digest is null")
        held = F.col("_part").isin(parts)
        data = data.where(~F.col("_first") | held if not k else held).select(*names)
        out = data if out is None else out.union(data)
    return out


def with_previous(rows: DataFrame, key: list[Column], order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the row before in ``order`` (distinct) of the same ``key``, as a struct, null for the first. A key of any size is dealt to ranges; the last row of each is the first of the next, too."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*key)
    marked = rows.withColumns({name: F.struct(*[F.col(c) for c in rows.columns]), "_key": whole})
    ordered = cut(marked.repartitionByRange(n, "_key", *order).sortWithinPartitions("_key", *order).withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    lasts = ordered.groupBy("_part").agg(F.max_by(F.struct("_key", name), "_at").alias("m"))
    halo = lasts.select(F.lead("_part").over(Window.orderBy("_part")).alias("_part"), "m._key", F.col(f"m.{name}").alias(name)).where("_part is not null").withColumn("_at", F.lit(-1).cast("long"))
    both = ordered.unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy("_part").orderBy("_at")
    before = F.when(F.lag("_key").over(w) == F.col("_key"), F.lag(name).over(w))
    return both.withColumn("_before", before).where("_at >= 0").drop(name, "_key", "_at", "_part").withColumnRenamed("_before", name)
