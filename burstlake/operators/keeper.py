"""Choosing the keeper of a unit (a burst, or a subject's group in it) by an explicit lexicographic order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import bucket, exact
from .lineage import scanned

#: The band of ratings, and that of faces and eyes; the score that makes a frame eligible; the softness rule.
BAND, FINE_BAND = 0.03, 0.005
ELIGIBLE, HAND, SOFT_SHARE, SOFT_BELOW, SOFT_AREA = 0.728, 3, 0.70, 0.55, 0.02
#: Fields in order of weight; a field that the rows do not have is the constant 0.
FIELDS = ("by_hand", "unculled", "subject", "rating_band", "bright", "moment", "peak", "soft", "buck", "uncut", "area", "framing", "eyes", "smile", "rating", "quality", "sharpness")


def key_of(rows: DataFrame, band: float | str, frame: str, row: str) -> Column:
    """The ordering struct: greater is better, and of equals the earlier frame, then the earlier row. ``band``: a width, or a column of widths."""
    has = {c.lower() for c in rows.columns}
    out = []
    for name in FIELDS:
        if name == "rating_band":
            out.append(bucket(F.col("score").cast("double"), F.col(band) if isinstance(band, str) else F.lit(band)).alias(name))
        elif name == "subject":
            out.append((F.coalesce(F.col("score"), F.lit(0.0)) >= ELIGIBLE).cast("int").alias(name) if name not in has else F.col(name).cast("int").alias(name))
        elif name == "uncut":
            out.append((-F.coalesce(F.col("cut_sides"), F.lit(0)) if "cut_sides" in has else F.lit(0)).alias(name))
        elif name in has:
            out.append(exact(F.col(name).cast("double")).alias(name))
        else:
            out.append(F.lit(0).alias(name))
    return F.struct(*out, (-F.col(frame)).alias("frame"), (-F.col(row)).alias("row"))


def with_soft_flag(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Adds ``soft``: 0 where a large enough subject is clearly less sharp than its unit's sharpest, else 1."""
    top = F.max("tile").over(Window.partitionBy(*unit))
    return rows.withColumn("soft", F.when((F.col("tile") < SOFT_SHARE * top) & (F.col("tile") < SOFT_BELOW) & (F.col("area") >= SOFT_AREA), 0).otherwise(1))


def primary_region(rows: DataFrame, frame: str, rank: str) -> DataFrame:
    """Only rows of the best region of their frame compete."""
    return rows.withColumn("_best", F.min(rank).over(Window.partitionBy(frame))).where(F.col("_best") == F.col(rank)).drop("_best")


def pick_keepers(rows: DataFrame, unit: list[str], frame: str, row: str, band: float | str = BAND) -> DataFrame:
    """All ``rows`` with ``picked``: 1 on the best eligible row of each unit, null elsewhere.

    Eligible: by_hand of 3 or more, or a score of 0.728 or more. Candidates are reduced on the map side (a
    max over structs), and only winners come back in the join. ``band`` may name a column: faces and eyes are told apart more
    finely than vehicles. Two rows meet in the wider of their bands, which is no order over a unit that mixes bands; such units
    are folded in order of frame and row, batch by batch, and what is held is one candidate. A row may compete in several units.
    """
    by_hand = F.coalesce(F.col("by_hand"), F.lit(0)) if "by_hand" in rows.columns else F.lit(0)
    may = rows.where((by_hand >= HAND) | (exact(F.col("score").cast("double")) >= ELIGIBLE))
    best = lambda df: df.groupBy(*unit).agg(F.max_by(row, key_of(rows, band, frame, row)).alias("_winner"))
    if isinstance(band, str):
        widths = may.groupBy(*unit).agg((F.min(band) < F.max(band)).alias("_mixed"))
        same = F.lit(True)
        for c in unit:
            same = same & F.col(c).eqNullSafe(F.col(f"_u_{c}"))
        sorted_out = may.join(widths.select(*[F.col(c).alias(f"_u_{c}") for c in unit], "_mixed"), same).drop(*[f"_u_{c}" for c in unit])
        winners = best(sorted_out.where("not _mixed")).unionByName(_folded(sorted_out.where("_mixed"), unit, frame, row, band))
    else:
        winners = best(may)
    same = F.col(row) == F.col("_winner")
    for c in unit:
        same = same & F.col(c).eqNullSafe(F.col(f"_u_{c}"))
    picked = winners.select(*[F.col(c).alias(f"_u_{c}") for c in unit], "_winner", F.lit(1).alias("picked"))
    return rows.join(picked, same, "left").drop(*[f"_u_{c}" for c in unit], "_winner")


def _folded(rows: DataFrame, unit: list[str], frame: str, row: str, band: str) -> DataFrame:
    """unit, _winner of units that mix bands: each row in order of frame and row against the one held so far."""
    score = exact(F.col("score").cast("double"))
    asked = rows.select(F.struct(*unit).alias("_unit"), F.col(frame).alias("_frame"), F.col(row).alias("_row"), score.alias("_score"), F.col(band).cast("double").alias("_band"), key_of(rows, 1.0, frame, row).alias("_key"))
    asked = asked.select(F.xxhash64("_unit").alias("_id"), F.to_json("_unit").alias("_name"), "_unit", "_frame", "_row", "_score", "_band", F.array(*[F.col(f"_key.{f}").cast("double") for f in FIELDS]).alias("_fields"))
    at = FIELDS.index("rating_band")

    def scan():
        held: list = []

        def better(new: tuple, old: tuple) -> bool:
            width = max(new[1], old[1])
            band_of = lambda c: math.floor(c[0] / width) if math.isfinite(c[0]) else 0
            key = lambda c: (*c[2][:at], band_of(c), *c[2][at + 1 :], -c[3], -c[4])
            return key(new) > key(old)

        def step(pdf: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            for score_, width, fields, frame_, row_, name in pdf[["_score", "_band", "_fields", "_frame", "_row", "_name"]].itertuples(index=False):
                new = (score_, width, tuple(fields), frame_, row_)
                if not held or better(new, held[0]):
                    held[:] = [new, name]
            if last and held:
                yield pd.DataFrame({"_name": [held[1]], "_winner": [held[0][4]]})

        return step

    kind = rows.schema[row].dataType
    won = scanned(asked.drop("_unit", "_id"), "_name", [F.col("_frame"), F.col("_row")], scan, T.StructType([T.StructField("_name", T.StringType()), T.StructField("_winner", kind)]))
    units = asked.select("_name", "_unit").distinct()
    return won.join(units, "_name").select(*[F.col(f"_unit.{c}").alias(c) for c in unit], "_winner")


def drop_spare_picks(picks: DataFrame, burst: str, grouped: str) -> DataFrame:
    """A frame's own pick goes where a grouped subject of its burst was picked."""
    any_grouped = F.max(F.when((F.col("picked") == 1) & F.col(grouped).isNotNull(), 1).otherwise(0)).over(Window.partitionBy(burst))
    return picks.withColumn("picked", F.when((any_grouped == 1) & F.col(grouped).isNull(), None).otherwise(F.col("picked")))


def top_ranks(rows: DataFrame, unit: list[str], order: list[Column], picked: Column, most: int = 3) -> DataFrame:
    """The first ``most`` of each unit with ``rank``; the pick is always first."""
    w = Window.partitionBy(*unit).orderBy(F.coalesce(picked.cast("int"), F.lit(0)).desc(), *order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def stack_lead(rows: DataFrame, stack: str, item: str) -> DataFrame:
    """stack, lead: the keeper if there is one, else the best that is not rejected by stars * 10 + rating * 5 (first of equals)."""
    worth = F.coalesce(F.col("stars"), F.lit(0)) * 10 + F.coalesce(F.col("rating"), F.lit(0.0)) * 5
    order = F.struct(F.coalesce(F.col("keeper").cast("int"), F.lit(0)), -F.coalesce(F.col("rejected").cast("int"), F.lit(0)), worth, -F.col(item))
    return rows.groupBy(stack).agg(F.max_by(item, order).alias("lead"))
