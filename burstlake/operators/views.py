"""What a client shows: decisions, filters, stacks, groups of vehicles and their shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def decision() -> Column:
    """By hand before by machine: rejected, picked, culled, else undecided."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return F.when(zero("rejected") == 1, "rejected").when(zero("picked") == 1, "picked").when(F.col("cull_reason").isNotNull(), "culled").otherwise("undecided")


def cull_gate(rating: Column, label: Column, rejected: Column, skip_rejected: bool = False, least: int = 0, required: str | None = None) -> Column:
    """struct(ok, reason): whether a frame passes the settings, and what holds it back."""
    reason = F.when(F.lit(skip_rejected) & F.coalesce(rejected, F.lit(False)), "rejected").when(F.coalesce(rating, F.lit(0)) < least, "rating")
    if required:
        reason = reason.when(F.lower(F.coalesce(label, F.lit(""))) != required.lower(), "label")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def search(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose columns, put together, hold ``needle`` in any case."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(needle.strip().lower()))


def excluded_frames(subjects: DataFrame, image: str) -> DataFrame:
    """Frames all of whose subjects are rejected or bystanders."""
    out = (F.coalesce("rejected", F.lit(0)) == 1) | (F.coalesce("bystander", F.lit(0)) == 1)
    return subjects.groupBy(image).agg(F.bool_and(out).alias("excluded"))


def needs_look(subjects: DataFrame, image: str) -> DataFrame:
    """Frames with a vehicle that has neither number nor plate, or whose group agrees by less than half."""
    unread = blank_to_null(F.col("number")).isNull() & blank_to_null(F.col("plate")).isNull()
    return subjects.groupBy(image).agg(F.bool_or(unread | (F.coalesce("agreement", F.lit(1.0)) < 0.5)).alias("needs_look"))


def page(rows: DataFrame, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of 500 rows unless asked otherwise, 1 to 5000."""
    return rows.orderBy(order).offset(max(0, offset)).limit(min(5000, max(1, 500 if limit is None else limit)))


def vehicle_groups(subjects: DataFrame, item: str) -> DataFrame:
    """grp, items, frames: by group if there is one, else identity, else burst and class, else the subject alone."""
    key = F.coalesce(F.concat(F.lit("g:"), F.col("group_key").cast("string")), F.concat(F.lit("i:"), blank_to_null(F.col("identity"))), F.concat(F.lit("b:"), F.col("burst_key").cast("string"), F.lit(":"), F.col("cls")), F.concat(F.lit("s:"), F.col(item).cast("string")))
    return subjects.groupBy(key.alias("grp")).agg(F.count("*").alias("items"), F.count_distinct("image_id").alias("frames"))


def stacks(frames: DataFrame, keep: Column) -> DataFrame:
    """Rows that ``keep`` holds for, with the size and the least id of their whole stack: the window comes before the filter."""
    whole = Window.partitionBy("job_id", "burst_key")
    alone = F.col("burst_key").isNull()
    return frames.withColumns({"stack_size": F.when(alone, 1).otherwise(F.count("*").over(whole)), "stack": F.when(alone, F.col("id")).otherwise(F.min("id").over(whole))}).where(keep)


def neighbours(rows: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """Adds before and after: the items next to each in its order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"before": F.lag(item).over(w), "after": F.lead(item).over(w)})


def share(part: Column, whole: Column) -> Column:
    """Whole percent within 0 and 100; 0 of nothing."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.round(F.try_divide(100 * part, whole)), F.lit(0)))).cast("int")


def readiness(rows: DataFrame, group: list[str]) -> DataFrame:
    """Measures of a cull against what was delivered, with a word for each: PASS, WARN or FAIL.

    ``rows``: exported, sharp and picked (0 or 1), score, seconds; ``group``: the burst.
    """
    w = Window.partitionBy(*group)
    ranked = rows.withColumns({"_n": F.count("*").over(w), "_top": F.max("score").over(w), "_any": F.max("picked").over(w)})
    total = ranked.agg(
        F.avg(F.when(F.col("exported") == 1, 1 - F.coalesce("culled", F.lit(0)))).alias("kept_share"),
        F.avg(F.when(F.col("exported") == 1, F.col("sharp"))).alias("sharp_share"),
        F.avg(F.when(F.col("picked") == 1, F.col("exported"))).alias("pick_hits"),
        F.avg(F.when(F.col("exported") == 1, 1 / F.col("_n"))).alias("chance"),
        F.avg(F.col("_any")).alias("burst_has_pick"),
        F.avg("seconds").alias("seconds"),
    )
    word = lambda good, fair: F.when(good, "PASS").when(fair, "WARN").otherwise("FAIL")
    return total.withColumns({"pick_word": word(F.col("pick_hits") >= 2 * F.col("chance"), F.col("pick_hits") >= F.col("chance")), "speed_word": word(F.col("seconds") <= 1.5, F.col("seconds") <= 3.0)})
