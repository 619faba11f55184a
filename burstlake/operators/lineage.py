"""Cutting lineage, and sums, places and scans in order that need no whole table or group in one place."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``. Where none is set, a local folder is chosen in local mode (tests); on a cluster that is an error,
    as executors and the driver share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not path:
        current = context._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="burstlake-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def tabled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage is cut, and it has a size to plan with."""
    path = f"{work_dir(df.sparkSession)}/burstlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(rows: DataFrame, by: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with ``<c>_sum``: the sum of each column over the rows up to this one in order of ``by`` (distinct values).

    Rows are dealt by ranges of ``by``; each range is summed on its own, and only one row a range meets in one task.
    """
    order = F.desc(by) if descending else F.asc(by)
    parted = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    parts = parted.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parted.withColumns({f"{c}_sum": F.sum(c).over(within) for c in columns}).join(base, "_part").withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.col(f"_{c}") for c in columns}).drop("_part", *[f"_{c}" for c in columns])


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 1 in ``order`` (distinct). Ranges are numbered on their own, as sums are."""
    parted = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*order)
    return parted.withColumn(name, F.row_number().over(within)).join(base, "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


def at_place(rows: DataFrame, group: list[str], value: str, place: Callable[[Column], Column]) -> DataFrame:
    """group, value: of each group's sorted values that at ``place`` of their count (from 0), null if there is none; nulls are no values.

    Equal values are counted before they move, and a group's values are dealt by ranges; no list of a group is made.
    """
    counted = rows.groupBy(*group, value).agg(F.count(value).alias("_n"))
    parted = cut(counted.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))
    base = parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_all"))
    within = Window.partitionBy("_part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    summed = parted.withColumn("_upto", F.sum("_n").over(within)).join(base, same)
    after = place(F.col("_all")) - F.col("_base")
    here = (after < F.col("_upto")) & (after >= F.col("_upto") - F.col("_n"))
    return summed.groupBy(*group).agg(F.max(F.when(here, F.col(value))).alias(value))


def scanned(rows: DataFrame, key: str, order: list[Column], scan: Callable[[], Callable[[pd.DataFrame, bool], Iterator[pd.DataFrame]]], schema) -> DataFrame:
    """The rows of each ``key`` in ``order``, batch by batch, through a function that ``scan`` makes for the key.

    It gets a batch and whether the key ends after it (a last batch may be empty), and keeps what it needs for the next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, now, empty = None, None, None
        for pdf in batches:
            for k, part in pdf.groupby(pdf[key].astype(object).where(pdf[key].notna(), None), sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if step is None or k != now:
                    if step is not None:
                        yield from step(empty, True)
                    step, now = scan(), k
                empty = part.iloc[:0]
                yield from step(part, False)
        if step is not None:
            yield from step(empty, True)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
