"""Reports from stored sums: one table an album, one a value, both made anew only for albums that were touched, and both reports from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import percent
from ..operators.lineage import tabled
from ..operators.linkage import fill_blanks
from ..schemas import visible
from . import stats

#: Columns of ``albums`` that are added up over albums; times are least and greatest, spans of at least two timed frames are added, counted and compared.
SUMMED = ("frames", "size_bytes", "pans", "bursts", "blurred", "soft", "sharp", "af_missing", "af_off_subject", "af_no_subject", "af_soft", "keepers", "rejected", "copies_hidden", "backfilled", "compared", "matched")


@dataclass
class Rollup:
    """albums: a row for each album (SUMMED, taken_from, taken_to, timed, whole); values: job_id, list, value, number, n."""

    albums: DataFrame
    values: DataFrame


def backfilled(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """``frames`` whose blank shot details (camera, lens, settings, file_size) are filled from the ``headers`` of their path, with ``was_filled``: whether one was."""
    columns = [c for c in (*stats.LISTED, "file_size") if c in headers.columns and c in frames.columns]
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    before = frames.withColumns({f"_was_{c}": blank(c) for c in columns})
    text = fill_blanks(before.withColumns({c: F.col(c).cast("string") for c in columns}), headers.select("path", *[F.col(c).cast("string").alias(c) for c in columns]), "path", columns)
    filled = text.withColumns({c: F.when(F.col(f"_was_{c}").isNotNull(), F.col(f"_was_{c}")).otherwise(F.col(c)) for c in columns})
    was = F.lit(False)
    for c in columns:
        was = was | (F.col(f"_was_{c}").isNull() & F.col(c).isNotNull())
    typed = filled.withColumn("was_filled", was).withColumns({c: F.col(c).cast(frames.schema[c].dataType) for c in columns})
    return typed.select(*frames.columns, "was_filled")


def _albums(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    seen = frames.where(visible())
    filled = F.count_if("was_filled") if "was_filled" in frames.columns else F.lit(0).cast("long")
    whole = F.lit(True)
    for c in stats.LISTED:
        whole = whole & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    more = seen.groupBy("job_id").agg(F.count("taken_at").alias("timed"), F.bool_and(whole).alias("whole"), filled.alias("backfilled"))
    picked = F.coalesce(F.col("catalog_pick"), F.lit(0)) == 1 if "catalog_pick" in frames.columns else F.lit(False)
    match = stats.keepers(seen).groupBy("job_id").agg(F.count("*").alias("compared"), F.count_if(picked).alias("matched"))
    return stats.shoot_numbers(frames, subjects).join(more, "job_id", "left").join(match, "job_id", "left").fillna(0, ["timed", "backfilled", "compared", "matched"]).fillna({"whole": False})


def _values(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    return stats.value_counts(frames, subjects, ["job_id"])


def rolled_up(frames: DataFrame, subjects: DataFrame) -> Rollup:
    """The stored sums of all albums of ``frames`` (was_filled and catalog_pick if they are known) and their ``subjects``."""
    return Rollup(tabled(_albums(frames, subjects), "albums"), tabled(_values(frames, subjects), "values"))


def refreshed(known: Rollup, frames: DataFrame, subjects: DataFrame, touched: DataFrame) -> Rollup:
    """``known`` with the albums in ``touched`` (job_id) made anew from what ``frames`` and ``subjects`` are now; an album without frames goes.

    Only frames of those albums are counted again, and only their subjects meet them.
    """
    albums = touched.select("job_id").distinct()
    own = frames.join(albums, "job_id", "left_semi")
    theirs = subjects.join(own.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    new = rolled_up(own, theirs)
    keep = lambda old, fresh: old.join(albums, "job_id", "left_anti").unionByName(fresh)
    return Rollup(tabled(keep(known.albums, new.albums), "albums"), tabled(keep(known.values, new.values), "values"))


def album_reports(known: Rollup) -> tuple[DataFrame, DataFrame]:
    """A row for each album (its numbers, and match_percent: how many of its keepers the catalogue picked, too), and its lists with their places."""
    numbers = known.albums.drop("whole", "timed").withColumn("match_percent", percent(F.col("matched"), F.col("compared")).cast("long"))
    return numbers, stats.placed(known.values, ["job_id"])


def library_reports(known: Rollup) -> tuple[DataFrame, DataFrame]:
    """One row over all albums, and the lists over complete albums, whose frames have all settings, so that their headers can be trusted.

    Seconds from an album's first to its last frame are its shooting time, if two frames are timed: in all, the mean, the longest, and how many albums.
    """
    a = known.albums
    span = F.when(F.col("timed") >= 2, F.col("taken_to") - F.col("taken_from"))
    frames_of = F.when(F.col("whole"), F.col("frames"))
    total = a.agg(
        F.count_if(F.col("frames") > 0).alias("albums"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMED], F.min("taken_from").alias("taken_from"), F.max("taken_to").alias("taken_to"), F.count_if("whole").alias("complete_albums"), F.coalesce(F.sum(frames_of), F.lit(0)).alias("complete_frames"),
        F.coalesce(F.sum(span), F.lit(0.0)).alias("shooting_seconds"), F.avg(span).alias("mean_seconds"), F.max(span).alias("longest_seconds"), F.count(span).alias("timed_albums"),
    )
    values = known.values.join(a.where("whole").select("job_id"), "job_id", "left_semi").groupBy("list", "value", "number").agg(F.sum("n").alias("n"))
    return total, stats.placed(values, [])


def distinct_rollup(rows: DataFrame, keys: list[str], item: str, bits: int = 12) -> DataFrame:
    """keys, n, sketch: for each combination of ``keys`` the count of rows and a sketch of its distinct ``item`` values, which can be merged."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, bits).alias("sketch"))


def distinct_by_sets(partial: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The distinct counts of every grouping set from the stored sketches: rows, about (estimate of distinct items), and level (the set's place), with null for keys that a set leaves out.

    Sketches of one group are united; items are not read again. With 12 bits the estimate is off by 1.6 % (one deviation).
    """
    keys = [c for c in partial.columns if c not in ("n", "sketch")]
    out = None
    for level, chosen in enumerate(sets):
        united = partial.groupBy(*chosen).agg(F.sum("n").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
        row = united.select(*[F.col(k) if k in chosen else F.lit(None).cast(partial.schema[k].dataType).alias(k) for k in keys], "rows", "about", F.lit(level).alias("level"))
        out = row if out is None else out.unionByName(row)
    return out

