"""Choosing rows of an album: by state, by what was read, by the views and orders of a review list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exact, stars
from ..functions.text import natural_key
from ..schemas import visible

#: The stars that a burst must reach to have a keeper, and the length of the list of what was read.
KEEPER_STARS, LISTED = 3, 400


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def pending(frames: DataFrame, album: int, status: str = "pending") -> DataFrame:
    """Frames of ``album`` in ``status``, by id."""
    return frames.where((F.col("job_id") == album) & (F.col("status") == status)).orderBy("id")


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows whose ``key`` is ``value``; the test reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def any_row(rows: DataFrame, where: Column) -> bool:
    """Whether ``where`` holds for some row: it stops at the first."""
    return not rows.where(where).isEmpty()


def unfinished(frames: DataFrame, album: int | None = None) -> DataFrame:
    """Frames that are still to be read: not done, not rejected by hand, no hidden copy."""
    return of_album(frames, album).where((F.col("status") != "done") & (_zero("rejected") == 0) & (_zero("copy_of") == 0))


def failed(frames: DataFrame, album: int | None = None, samples: int = 3) -> DataFrame:
    """job_id, n, samples: frames that could not be read, and the first few by id as ``name: reason``."""
    bad = unfinished(frames, album).where("status = 'error'")
    name = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    ranked = bad.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy("id")))
    said = F.when(F.col("_n") <= samples, F.struct("_n", F.concat(name, F.lit(": "), F.coalesce("error", F.lit("could not be read"))).alias("s")))
    return ranked.groupBy("job_id").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(said)), lambda x: x["s"]).alias("samples"))


def of_album(rows: DataFrame, album: int | None) -> DataFrame:
    """The rows of one album, or all if none is named: no test that is always true reaches the plan."""
    return rows if album is None else rows.where(F.col("job_id") == album)


def unread(subjects: DataFrame, frames: DataFrame, album: int | None = None) -> DataFrame:
    """Subjects that no number reading was tried on."""
    return subjects.where("number_source is null").join(of_album(frames, album).select(F.col("id").alias("image_id")), "image_id", "left_semi")


def read_any() -> Column:
    """A number, a plate or attributes were read off the subject."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (said("number") != "") | (said("plate") != "") | ~said("attributes").isin("", "{}", "null")


def identified(subjects: DataFrame, frames: DataFrame, album: int, most: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """What was read in ``album``: the first ``most`` rows (not reviewed before reviewed, read before not, by frame), and one row of
    total, unreviewed and shown, which ``most`` does not limit."""
    own = frames.where((F.col("job_id") == album) & (_zero("copy_of") == 0)).select(F.col("id").alias("image_id"), F.col("path").alias("frame_path"))
    rows = subjects.where(read_any()).join(own, "image_id")
    blank = (F.coalesce("number", F.lit("")) == "") & (F.coalesce("plate", F.lit("")) == "")
    first = rows.orderBy(_zero("reviewed"), blank, "image_id", "id").limit(most)
    total = rows.agg(F.count("*").alias("total"), F.count_if(_zero("reviewed") == 0).alias("unreviewed"))
    return first, total.withColumn("shown", F.least(F.lit(most), F.col("total")))


def album_states(jobs: DataFrame, frames: DataFrame) -> DataFrame:
    """``jobs`` (id, stage, stopped, broken) with status and resume: how a finished run left the album, and where it goes on.

    Where all that is missing failed frame by frame it is ``done_errors``, else ``error``. What is not a known stage, and ``done``, resume with the scan.
    """
    left = unfinished(frames).groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("_left"), F.count_if(F.col("status") == "error").alias("_bad"))
    rows = jobs.join(left, "id", "left").fillna(0, ["_left", "_bad"])
    status = F.when(F.coalesce("stopped", F.lit(False)), "stopped").when(F.coalesce("broken", F.lit(False)), "error").when((F.col("_left") > 0) & (F.col("_left") == F.col("_bad")), "done_errors").when(F.col("_left") > 0, "error").otherwise("done")
    resume = F.when(F.col("stage").isin("group", "pick", "identify", "taste"), F.col("stage")).otherwise("scan")
    return rows.withColumns({"status": status, "resume": F.when(F.col("_left") > 0, "scan").otherwise(resume)}).select(*jobs.columns, "status", "resume")


def latest(rows: DataFrame, key: str = "id") -> DataFrame:
    """The row of the greatest ``key``."""
    return rows.orderBy(F.desc(key)).limit(1)


def random_unlabelled(rows: DataFrame, labels: DataFrame, keys: list[str], score: str, low: float, high: float, seed: int) -> DataFrame:
    """One row of those without a label whose score lies in [low, high): by a seeded hash, so that a retry picks the same."""
    free = rows.where((F.col(score) >= low) & (F.col(score) < high)).join(labels.select(*keys).distinct(), keys, "left_anti")
    return free.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(1)


def by_time(rows: DataFrame, taken: str = "taken_at", path: str = "path") -> DataFrame:
    """In order of time, then path; a missing time is 0."""
    return rows.orderBy(F.coalesce(F.col(taken).cast("double"), F.lit(0.0)), path)


def facts(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """A row for each frame: what its subjects say (by id), which the views below and searches read.

    n, numbers, plates, reviewed (all are, and there is one), panned, pick, excluded, needs_look, level. A frame is excluded if it is
    rejected or all its subjects are: rejected, bystanders, or culled without stars by hand on either. ``level``: the stars by hand, else of the rating.
    """
    vehicle = F.coalesce("region_type", F.lit("vehicle")) == "vehicle"
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    listed = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(~blank(c), F.struct("id", c)))), lambda x: x[c]))
    hand = frames.select(F.col("id").alias("image_id"), F.col("stars").alias("_frame_stars"))
    culled = (F.coalesce("cull_reason", F.lit("")) != "") & F.col("stars").isNull() & F.col("_frame_stars").isNull()
    per = subjects.join(hand, "image_id").groupBy(F.col("image_id").alias("id")).agg(
        F.count("*").alias("n"), listed("number").alias("numbers"), listed("plate").alias("plates"), F.bool_and(_zero("reviewed") != 0).alias("reviewed"), F.bool_or(_zero("panning") != 0).alias("panned"),
        F.bool_or(_zero("burst_pick") != 0).alias("pick"), F.bool_and((_zero("rejected") != 0) | (_zero("bystander") != 0) | culled).alias("all_out"),
        F.bool_or(vehicle & ((blank("number") & blank("plate")) | (F.coalesce("group_agreement", F.lit(1.0)) < 0.5))).alias("needs_look"),
    )
    none = {c: F.coalesce(c, F.lit(False)) for c in ("reviewed", "panned", "all_out", "needs_look")}
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("numbers", "plates")}
    out = frames.join(per, "id", "left").fillna(0, ["n"]).withColumns(none | lists | {"pick": F.coalesce("pick", F.lit(False)) | (_zero("burst_pick") != 0) if "burst_pick" in frames.columns else F.coalesce("pick", F.lit(False))})
    level = F.coalesce("stars", F.when(F.col("rating").isNull(), 0).otherwise(stars(F.col("rating"))))
    return out.withColumns({"excluded": (_zero("rejected") != 0) | F.col("all_out"), "level": level}).drop("all_out")


def decision() -> Column:
    """Of ``facts``: a rejection by hand, then a pick by hand, then what excludes the frame, else undecided."""
    return F.when(_zero("rejected") != 0, "rejected").when(_zero("picked") != 0, "picked").when(F.col("excluded"), "rejected").otherwise("undecided")


def keeper_ids(known: DataFrame) -> DataFrame:
    """id of the keepers of an album (rows of ``facts``): hand picks of a burst, and if it has none the engine's picks that are not rejected."""
    unit = F.coalesce(F.concat(F.lit("b"), F.col("burst_key").cast("string")), F.concat(F.lit("f"), F.col("id").cast("string")))
    picked = decision() == "picked"
    hand = F.max(F.when(picked, 1).otherwise(0)).over(Window.partitionBy("job_id", "_unit"))
    rows = known.withColumn("_unit", unit).withColumn("_hand", hand)
    return rows.where(picked | ((F.col("_hand") == 0) & F.col("pick") & (decision() != "rejected"))).select("id")


VIEWS = ("keepers", "undecided", "rejected", "review", "top3", "needsLook")


def prepared(known: DataFrame) -> DataFrame:
    """Rows of ``facts`` with decision, keeper and rank (in the burst, of frames that may be ranked): what all views need, in one shuffle by album and burst."""
    unit = F.coalesce(F.concat(F.lit("b"), F.col("burst_key").cast("string")), F.concat(F.lit("f"), F.col("id").cast("string")))
    rows = known.withColumns({"decision": decision(), "_unit": unit})
    hand = F.max((F.col("decision") == "picked").cast("int")).over(Window.partitionBy("job_id", "_unit"))
    rows = rows.withColumn("_hand", hand).withColumn("keeper", (F.col("decision") == "picked") | ((F.col("_hand") == 0) & F.col("pick") & (F.col("decision") != "rejected")))
    # a rejected frame is no candidate unless it has stars by hand
    rows = rows.withColumn("_may", (_zero("rejected") == 0) | F.col("stars").isNotNull())
    order = [F.desc("keeper"), F.col("stars").isNull(), F.desc_nulls_last("stars"), exact(F.col("rating")).desc(), F.col("id")]
    rank = F.row_number().over(Window.partitionBy("job_id", "_unit", "_may").orderBy(*order))
    return rows.withColumn("rank", F.when(F.col("_may"), rank)).drop("_unit", "_hand", "_may")


def shown_in(name: str) -> Column:
    """Of ``prepared``: the view holds the row."""
    tests = {"keepers": F.col("keeper"), "undecided": F.col("decision") == "undecided", "rejected": F.col("decision") == "rejected", "review": ~F.col("excluded") & ~F.col("reviewed"), "needsLook": ~F.col("excluded") & F.col("needs_look"), "top3": F.coalesce(F.col("rank") <= 3, F.lit(False))}
    return tests.get(name, F.lit(True))


def view(known: DataFrame, name: str = "all", least_stars: int = 0, facet: tuple[str, str] | None = None, needle: str = "") -> DataFrame:
    """Rows of ``facts`` (or of ``prepared``) that a view shows: all, keepers, undecided, rejected, review, top3 or needsLook; with least stars, one facet value and a search.

    Keepers and ranks are worked out on the whole album before anything is left out.
    """
    rows = known if {"keeper", "rank", "decision"} <= set(known.columns) else prepared(known)
    shown = rows.where(shown_in(name))
    if least_stars:
        shown = shown.where(F.col("level") >= least_stars)
    if facet:
        shown = shown.where(F.array_contains(facet[0], facet[1]))
    if needle.strip():
        shown = shown.where(F.lower(F.concat_ws(" ", "path", F.array_join("plates", " "), F.array_join("numbers", " "))).contains(needle.strip().lower()))
    return shown


def all_views(known: DataFrame, least_stars: dict[str, int] | None = None) -> DataFrame:
    """shown, and the columns of ``prepared``: a row for each view that shows a frame, all views in one pass."""
    least = least_stars or {}
    held = [F.when(shown_in(v) & (F.col("level") >= least.get(v, 0)) if least.get(v) else shown_in(v), v) for v in VIEWS]
    return prepared(known).withColumn("shown", F.explode(F.array_compact(F.array(*held))))


def ordered(rows: DataFrame, name: str) -> list[Column]:
    """The order of a list: frame, review (nearest to three stars, those starred by hand last), best, worst or pick; then by natural name and id."""
    by_name = [natural_key(F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)), F.col("id")]
    level = F.col("level")
    return {"review": [F.when(F.col("stars").isNotNull(), 10).otherwise(F.abs(level - 3)), F.col("id")], "best": [level.desc(), *by_name], "worst": [level, *by_name], "pick": [F.col("keeper").desc(), level.desc(), *by_name]}.get(name, by_name)


def suggestion_sizes(known: DataFrame) -> DataFrame:
    """id, size: the engine's pick of each burst of two frames or more that was not picked by hand."""
    size = known.where("burst_key is not null").groupBy("job_id", "burst_key").agg(F.count("*").alias("size")).where("size > 1")
    return known.join(keeper_ids(known), "id", "left_semi").where(_zero("picked") == 0).join(size, ["job_id", "burst_key"]).select("id", "size")


def singleton_ids(known: DataFrame) -> DataFrame:
    """id of frames that are alone in their burst, or have none."""
    n = F.count("*").over(Window.partitionBy("job_id", "burst_key"))
    return known.withColumn("_n", F.when(F.col("burst_key").isNull(), 1).otherwise(n)).where("_n = 1").select("id")


def soft_bursts(known: DataFrame, least: int = KEEPER_STARS) -> DataFrame:
    """job_id, burst_key, size, best: bursts of two frames or more without a keeper, whose best frame that is not rejected is under ``least`` stars."""
    marked = known.join(keeper_ids(known).withColumn("_k", F.lit(1)), "id", "left")
    live = F.when(decision() != "rejected", F.col("level"))
    return marked.where("burst_key is not null").groupBy("job_id", "burst_key").agg(F.count("*").alias("size"), F.max(live).alias("best"), F.count("_k").alias("_keepers")).where((F.col("size") > 1) & (F.col("_keepers") == 0) & (F.col("best") < least)).drop("_keepers")


def import_plan(jobs: DataFrame, frames: DataFrame, root: str, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The album of ``root`` in any case (the least id, if there is one), the paths of ``found`` that no album has, and how many are known."""
    album = jobs.where(F.lower("root") == root.lower()).orderBy("id").limit(1).select(F.col("id").alias("album"))
    paths = frames.select("path").distinct()
    known = found.join(paths, "path", "left_semi").agg(F.count("*").alias("duplicates"))
    return album, found.join(paths, "path", "left_anti"), known


def summary(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """A row for each album over its visible frames: frames, starred, picked, rejected, subjects, with number, with plate, reviewed and the counts of regions as a map."""
    seen = frames.where(visible())
    own = seen.groupBy("job_id").agg(F.count("*").alias("frames"), F.count_if(_zero("stars") > 0).alias("starred"), F.count_if(_zero("picked") == 1).alias("picked"), F.count_if(_zero("rejected") == 1).alias("rejected"))
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    joined = subjects.join(seen.select(F.col("id").alias("image_id"), "job_id"), "image_id")
    per = joined.groupBy("job_id").agg(F.count("*").alias("subjects"), F.count_if(said("number")).alias("numbers"), F.count_if(said("plate")).alias("plates"), F.count_if(_zero("reviewed") != 0).alias("reviewed"))
    regions = region_counts(joined, ["job_id"]).groupBy("job_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("region", "n")))).alias("regions"))
    return own.join(per, "job_id", "left").fillna(0, ["subjects", "numbers", "plates", "reviewed"]).join(regions, "job_id", "left")


def region_counts(subjects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, region, n: subjects by region; one without is a vehicle."""
    return subjects.groupBy(*keys, F.coalesce("region_type", F.lit("vehicle")).alias("region")).agg(F.count("*").alias("n"))


def cover(frames: DataFrame, subjects: DataFrame, passes: Column | None = None, most: int = 20) -> DataFrame:
    """The frame of an album to show: of its ``most`` best vehicles by conf * area * (1 + sharpness), else of its ``most`` best frames by stars * 0.2 or rating, the first that ``passes``
    (a column on the candidates id and path)."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    shown = frames.where(visible()).select("id", "path", "stars", "rating")
    cars = subjects.where(F.coalesce("region_type", F.lit("vehicle")) == "vehicle").select(F.col("image_id").alias("id"), (F.col("conf") * area * (1 + F.coalesce("sharpness", F.lit(0.0)))).alias("worth"))
    by_car = shown.join(cars, "id").orderBy(F.desc_nulls_last("worth"), "id").limit(most).select("id", "path", "worth", F.lit(0).alias("turn"))
    by_rating = shown.withColumn("worth", F.coalesce(F.col("stars") * 0.2, "rating", F.lit(0.0))).orderBy(F.desc("worth"), "id").limit(most).select("id", "path", "worth", F.lit(1).alias("turn"))
    both = by_car.unionByName(by_rating)
    return (both if passes is None else both.where(passes)).orderBy("turn", F.desc_nulls_last("worth"), "id").limit(1).select("id", "path")
