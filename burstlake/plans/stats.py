"""Album and library reports: one wide aggregate for the numbers, small group-bys for the lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import is_vehicle, visible


def counts(rows: DataFrame, key: Column, name: str = "value", top: int | None = None) -> DataFrame:
    """value, n: commonest first, then by value."""
    out = rows.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out.limit(top) if top else out


def shares(counted: DataFrame, name: str, top: int) -> DataFrame:
    """The first ``top`` values with their share of all in whole percent, and of the greatest."""
    whole = counted.agg(F.sum("n").alias("whole"), F.max("n").alias("most"))
    first = counted.orderBy(F.desc("n"), name).limit(top)
    return first.join(F.broadcast(whole)).select(name, "n", F.round(100 * F.col("n") / F.col("whole")).cast("long").alias("share"), (F.col("n") / F.col("most")).alias("bar"))


def verdict_counts(rows: DataFrame, group: list[str], verdict: str, kinds: tuple[str, ...] = ("blurred", "soft", "sharp")) -> DataFrame:
    """A column for each kind, 0 where there is none."""
    return rows.groupBy(*group).pivot(verdict, list(kinds)).agg(F.count(F.lit(1))).fillna(0, list(kinds))


def spans(frames: DataFrame, group: list[str], taken: str) -> DataFrame:
    """bursts, total, mean, longest: seconds that groups with two timed frames or more last."""
    each = frames.where(F.col(taken).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), (F.max(taken) - F.min(taken)).alias("span")).where("n >= 2")
    return each.agg(F.count("*").alias("bursts"), F.round(F.sum("span"), 1).alias("total"), F.round(F.avg("span"), 2).alias("mean"), F.round(F.max("span"), 1).alias("longest"))


def star_histogram(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """stars, n: of a frame its own, else its subjects' best, else 0."""
    best = subjects.groupBy(F.col("image_id").alias("id")).agg(F.max("stars").alias("_best"))
    return frames.join(best, "id", "left").groupBy(F.coalesce("stars", "_best", F.lit(0)).alias("stars")).agg(F.count("*").alias("n"))


def keepers(frames: DataFrame) -> DataFrame:
    """Frames picked by hand, and those picked by the engine in bursts without a visible hand pick (a null burst has none)."""
    hand = frames.where(F.col("picked") == 1).select("job_id", "burst_key").where("burst_key is not null").distinct()
    own = frames.where(F.coalesce("picked", F.lit(0)) == 1)
    engine = frames.where((F.coalesce("picked", F.lit(0)) != 1) & (F.col("burst_pick") == 1)).join(hand, ["job_id", "burst_key"], "left_anti")
    return own.unionByName(engine)


def shoot_stats(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """A row for each album: totals, times, verdicts, keepers and the common settings, over visible frames."""
    seen = frames.where(visible())
    per = subjects.where(is_vehicle()).groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("_subjects"), F.max("rating").alias("_best"))
    joined = seen.join(per, "id", "left")
    wide = joined.groupBy("job_id").agg(
        F.count("*").alias("frames"),
        F.count_if(F.col("_subjects") > 0).alias("with_subject"),
        F.coalesce(F.sum("_subjects"), F.lit(0)).alias("subjects"),
        F.count_distinct("burst_key").alias("bursts"),
        F.count_distinct("camera").alias("cameras"),
        F.min("taken_at").alias("first_taken"),
        F.max("taken_at").alias("last_taken"),
        F.count_if(F.col("rejected") == 1).alias("rejected"),
        F.count_if(F.col("burst_pick") == 1).alias("engine_picks"),
        *[F.count_if(F.col("rating_verdict") == v).alias(v) for v in ("blurred", "soft", "sharp")],
        F.expr("mode() within group (order by lens)").alias("common_lens"),
        F.expr("mode() within group (order by iso)").alias("common_iso"),
    )
    kept = keepers(seen).groupBy("job_id").agg(F.count("*").alias("keepers"))
    return wide.join(kept, "job_id", "left").withColumn("keepers", F.coalesce("keepers", F.lit(0)))


def global_stats(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row over all albums: the sums of shoot_stats, and distinct (album, burst) pairs."""
    each = shoot_stats(frames, subjects)
    total = each.agg(F.count("*").alias("albums"), *[F.sum(c).alias(c) for c in ("frames", "with_subject", "subjects", "rejected", "engine_picks", "blurred", "soft", "sharp", "keepers")], F.min("first_taken").alias("first_taken"), F.max("last_taken").alias("last_taken"))
    pairs = frames.where(visible()).agg(F.count_distinct("job_id", "burst_key").alias("bursts"))
    return total.join(F.broadcast(pairs))


def job_list(jobs: DataFrame, frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """``jobs`` with total, done, failed, subjects and numbers read."""
    f = frames.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("failed"))
    s = subjects.join(frames.select(F.col("id").alias("image_id"), "job_id"), "image_id").groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("subjects"), F.count_if(F.coalesce("number", F.lit("")) != "").alias("numbers"))
    names = ["total", "done", "failed", "subjects", "numbers"]
    return jobs.join(f, "id", "left").join(s, "id", "left").fillna(0, names)


#: Columns of the lists of a report, and those of them where a blank value is none.
LISTED, NAMED = ("camera", "lens", "f_number", "exposure_time", "iso", "focal_length"), ("camera", "lens")


def focus_folds(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """id, detected, held of frames with a focus area (af_x1 to af_y2, fractions): a vehicle or person is there, and the middle of the area lies in one (pixels of width and height)."""
    areas = frames.where("af_x1 is not null and af_y1 is not null and af_x2 is not null and af_y2 is not null")
    boxes = subjects.where(F.coalesce("region_type", F.lit("vehicle")).isin("vehicle", "person")).select(F.col("image_id").alias("id"), "x1", "y1", "x2", "y2")
    x, y = (F.col("af_x1") + F.col("af_x2")) / 2, (F.col("af_y1") + F.col("af_y2")) / 2
    inside = (x * F.col("width")).between(F.col("x1"), F.col("x2")) & (y * F.col("height")).between(F.col("y1"), F.col("y2"))
    return areas.join(boxes, "id", "left").groupBy("id").agg(F.bool_or(F.col("x1").isNotNull()).alias("detected"), F.bool_or(F.coalesce(inside, F.lit(False))).alias("held"))


def shoot_numbers(frames: DataFrame, subjects: DataFrame, blurred: float = 0.606) -> DataFrame:
    """A row for each album: frames, copies_hidden, size_bytes, pans, bursts (of time), subjects that are blurred, soft and sharp, focus areas that are missing, off the
    subject, without one and soft, keepers (the engine's, of a frame or a subject of it), rejected, taken_from, taken_to. All but the copies count visible frames."""
    seen = frames.where(visible())
    copies = frames.groupBy("job_id").agg(F.count_if(F.coalesce("copy_of", F.lit(0)) != 0).alias("copies_hidden"))
    verdicts = [F.count_if(F.col("sharpness_verdict") == v).alias(v) for v in ("blurred", "soft", "sharp")]
    per = subjects.groupBy(F.col("image_id").alias("id")).agg(F.max(F.coalesce("panning", F.lit(0))).alias("_pan"), F.max(F.coalesce("burst_pick", F.lit(0))).alias("_pick"), *verdicts)
    focus = focus_folds(seen, subjects)
    bursts = seen.where("time_burst is not null").select("job_id", "time_burst").distinct().groupBy("job_id").agg(F.count("*").alias("bursts"))
    wide = seen.join(per, "id", "left").join(focus, "id", "left").groupBy("job_id").agg(
        F.count("*").alias("frames"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size_bytes"), F.count_if(F.col("_pan") == 1).alias("pans"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("blurred", "soft", "sharp")],
        F.count_if(F.col("af_x1").isNull()).alias("af_missing"), F.count_if(F.col("detected") & ~F.col("held")).alias("af_off_subject"), F.count_if(~F.col("detected")).alias("af_no_subject"), F.count_if(F.col("af_sharpness") < blurred).alias("af_soft"),
        F.count_if((F.coalesce("burst_pick", F.lit(0)) == 1) | (F.coalesce("_pick", F.lit(0)) == 1)).alias("keepers"), F.count_if(F.coalesce("rejected", F.lit(0)) == 1).alias("rejected"), F.min("taken_at").alias("taken_from"), F.max("taken_at").alias("taken_to"),
    )
    return copies.join(wide, "job_id", "left").join(bursts, "job_id", "left").fillna(0, ["frames", "size_bytes", "pans", "bursts", "blurred", "soft", "sharp", "af_missing", "af_off_subject", "af_no_subject", "af_soft", "keepers", "rejected"])


def value_counts(frames: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, list, value (text), number, n: how often each camera, lens, setting and star comes. One pass unpivots the columns; values are counted before they move."""
    best = subjects.groupBy(F.col("image_id").alias("id")).agg(F.max("stars").alias("_best"))
    rows = frames.where(visible()).join(best, "id", "left").withColumn("_stars", F.coalesce("stars", "_best", F.lit(0)))
    value = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in NAMED else F.col(c).cast("string")
    number = lambda c: F.lit(None).cast("double") if c in NAMED else F.col(c).cast("double")
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("list"), value(c).alias("value"), number(c).alias("number")) for n, c in [*((c, c) for c in LISTED if c in frames.columns), ("stars", "_stars")]]))
    return rows.select(*keys, parts.alias("p")).select(*keys, "p.*").where("value is not null").groupBy(*keys, "list", "value", "number").agg(F.count("*").alias("n"))


def placed(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, list, value, n, place: commonest first (of equals the lesser value)."""
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "list").orderBy(F.desc("n"), "number", "value"))).drop("number")


def shoot_lists(frames: DataFrame, subjects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys (job_id), list, value (text), n, place: how often each camera, lens, setting and star comes, commonest first (of equals the lesser value); place 1 is the most used."""
    keys = ["job_id"] if keys is None else keys
    return placed(value_counts(frames, subjects, keys), keys)


def complete_albums(frames: DataFrame) -> DataFrame:
    """job_id of albums all of whose visible frames have a camera, a lens and all settings."""
    whole = F.lit(True)
    for c in LISTED:
        whole = whole & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return frames.where(visible()).groupBy("job_id").agg(F.bool_and(whole).alias("_whole")).where("_whole").select("job_id")


def library_report(frames: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row over all albums (the sums of ``shoot_numbers``, albums and complete albums), and the lists over the complete albums, whose headers can be trusted."""
    each = shoot_numbers(frames, subjects)
    sums = [c for c in each.columns if c not in ("job_id", "taken_from", "taken_to")]
    complete = complete_albums(frames)
    total = each.agg(F.count_if(F.col("frames") > 0).alias("albums"), *[F.sum(c).alias(c) for c in sums], F.min("taken_from").alias("taken_from"), F.max("taken_to").alias("taken_to"))
    return total.join(F.broadcast(complete.agg(F.count("*").alias("complete")))), shoot_lists(frames.join(complete, "job_id", "left_semi"), subjects, [])
