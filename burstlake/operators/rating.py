"""Ratings of frames: from their subjects, with the camera's focus area, and what moments add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import BLURRED, stars, verdict
from ..schemas import visible

#: The cap of pans, doubt around the threshold, shares of focus areas, and probabilities of moments.
PAN_FLOOR, PAN_SLOPE, DOUBT = 0.728, 0.28, 0.06
MOST_AREA, SMALL_SUBJECT, NEAR, LEAST_OPINION = 0.40, 0.05, 0.02, 0.01
MAYBE, SURE, LEVELS = 0.5, 0.85, 3


def pan_cap(share: Column) -> Column:
    """The rating that a pan may have by its sharp share: three stars at least."""
    return F.greatest(F.lit(PAN_FLOOR), F.least(F.lit(1.0), F.lit(PAN_FLOOR) + share * PAN_SLOPE))


def rescued(detected: Column, focus: Column) -> Column:
    """The camera's focus area can lift a rating, never lower it."""
    return F.when(focus.isNull(), detected).otherwise(F.greatest(detected, focus))


def second_opinion(score: Column, other: Column) -> Column:
    """The lower of two opinions; one that is missing has none."""
    return F.when(other.isNull(), score).otherwise(F.least(score, other))


def doubtful(rating_verdict: Column, score: Column, uncertain: Column, partly: Column, blurred: float = BLURRED) -> Column:
    """A cull that was a close call: poor, and uncertain, near the threshold, or sharp in part."""
    near = F.abs(score - blurred) < DOUBT
    return (rating_verdict == "poor") & F.coalesce(uncertain | near | partly, F.lit(False))


def cullable(rating_verdict: Column, panning: Column) -> Column:
    """Poor, and no pan: a held pan is never culled by rule."""
    return (rating_verdict == "poor") & ~F.coalesce(panning, F.lit(False))


def region_best(subjects: DataFrame) -> DataFrame:
    """id, best: a map of region to rating for each frame: its sharpest subject, but the softer of the eyes. Bystanders say nothing."""
    region = F.coalesce("region_type", F.lit("vehicle"))
    rows = subjects.where((F.coalesce("bystander", F.lit(0)) == 0) & F.col("rating").isNotNull()).groupBy(F.col("image_id").alias("id"), region.alias("region")).agg(F.max("rating").alias("hi"), F.min("rating").alias("lo"))
    value = F.when(F.col("region") == "eye", F.col("lo")).otherwise(F.col("hi"))
    return rows.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("region", value.alias("v"))))).alias("best"))


def frame_ratings(frames: DataFrame, subjects: DataFrame, priority: tuple[str, ...] = ("eye", "face", "person", "vehicle", "whole")) -> DataFrame:
    """``frames`` with rating made anew: of the first region in ``priority`` that has one; ``whole`` is the frame's own sharpness, and nothing is 0.

    A pan (a vehicle or person that pans) is capped by pan_share; af_sharpness may lift it. Frames without a subject that counts are
    rated by ``rate_bare``.
    """
    panning = subjects.where((F.coalesce("bystander", F.lit(0)) == 0) & F.coalesce("region_type", F.lit("vehicle")).isin("vehicle", "person")).groupBy(F.col("image_id").alias("id")).agg(F.bool_or(F.coalesce("panning", F.lit(0)) != 0).alias("_panning"))
    j = frames.join(region_best(subjects), "id", "left").join(panning, "id", "left")
    steps = [F.col("sharpness") if kind == "whole" else F.col("best").getItem(kind) for kind in priority]
    first = F.coalesce(*steps, F.lit(0.0))
    capped = F.when(F.coalesce("_panning", F.lit(False)) & F.col("pan_share").isNotNull(), F.least(first, pan_cap(F.col("pan_share")))).otherwise(first)
    made = F.when(F.col("best").isNull(), F.col("rating")).otherwise(rescued(capped, F.col("af_sharpness")))
    return j.withColumn("rating", made).drop("best", "_panning")


def rerated(frames: DataFrame) -> DataFrame:
    """``frames`` with rating_verdict and, where no hand gave any, stars of their rating."""
    return frames.withColumns({"rating_verdict": verdict(F.col("rating")), "engine_stars": stars(F.col("rating"))})


def parked_ratings(subjects: DataFrame) -> DataFrame:
    """id, parked: the best rating of a frame's subjects that the focus area (no person) made bystanders."""
    return subjects.where(F.coalesce("af_bystander", F.lit(0)) == 1).groupBy(F.col("image_id").alias("id")).agg(F.max("rating").alias("parked"))


def bare_frames(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """Visible frames that were measured and have no subject but bystanders."""
    seen = subjects.where(F.coalesce("bystander", F.lit(0)) == 0).select(F.col("image_id").alias("id"))
    measured = F.col("sharpness").isNotNull() | F.col("af_sharpness").isNotNull()
    return frames.where(visible() & measured).join(seen, "id", "left_anti")


def missed_ids(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """id of frames in a burst where another visible frame has a vehicle or person.

    The mates are those of the time burst where both frames have one, else those of the moment. A frame is no mate of itself: two
    frames with a subject in a burst, or one that is another, decide it, so bursts are summed and no pair is made.
    """
    held = subjects.where((F.coalesce("bystander", F.lit(0)) == 0) & F.coalesce("region_type", F.lit("vehicle")).isin("vehicle", "person")).select(F.col("image_id").alias("id")).distinct()
    # only the mates have to be visible; the frames that ask do not
    mates = frames.where(F.coalesce("copy_of", F.lit(0)) == 0).join(held, "id", "left_semi").select("id", "job_id", "time_burst", "burst_key")
    asked = frames.where("burst_key is not null and sharpness_whole is not null").select("id", "job_id", "time_burst", "burst_key")
    with_some = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    other = (F.col("n") > 1) | (F.col("only") != F.col("id"))
    by_time = asked.where("time_burst is not null").join(with_some(mates.where("time_burst is not null"), ["job_id", "time_burst"]), ["job_id", "time_burst"]).where(other).select("id")
    untimed = with_some(mates.where("time_burst is null and burst_key is not null"), ["job_id", "burst_key"])
    every = with_some(mates.where("burst_key is not null"), ["job_id", "burst_key"])
    by_moment = asked.where("time_burst is not null").join(untimed, ["job_id", "burst_key"]).where(other).select("id").union(asked.where("time_burst is null").join(every, ["job_id", "burst_key"]).where(other).select("id"))
    return by_time.union(by_moment).distinct()


def rate_bare(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """``frames`` where those without a subject that counts are rated anew.

    One that was missed (its burst has subjects) is rated by its whole frame, another by its sharpest patch; the focus area's score
    and the best parked rating lift it.
    """
    bare = bare_frames(frames, subjects).select("id", F.lit(True).alias("_bare"))
    j = frames.join(bare, "id", "left").join(missed_ids(frames, subjects).withColumn("_missed", F.lit(True)), "id", "left").join(parked_ratings(subjects), "id", "left")
    own = F.when(F.col("_missed"), F.col("sharpness_whole")).otherwise(F.col("sharpness"))
    lifted = F.greatest(F.col("af_sharpness"), F.coalesce("parked", own, F.lit(0.0)))
    return j.withColumn("rating", F.when(F.col("_bare"), F.when(F.col("af_sharpness").isNotNull(), lifted).otherwise(own)).otherwise(F.col("rating"))).select(frames.columns)


def area_share(area: Column, width: Column, height: Column) -> Column:
    """The share of the frame that a struct x1, y1, x2, y2 covers."""
    size = F.greatest(area["x2"] - area["x1"], F.lit(0.0)) * F.greatest(area["y2"] - area["y1"], F.lit(0.0))
    return size / (F.greatest(width, F.lit(1)).cast("double") * F.greatest(height, F.lit(1)).cast("double"))


def holds_middle(box: Column, area: Column, margin: Column | float = 0.0) -> Column:
    """The middle of ``area`` lies in ``box``, widened by ``margin``."""
    x, y = (area["x1"] + area["x2"]) / 2, (area["y1"] + area["y2"]) / 2
    return (x >= box["x1"] - margin) & (x <= box["x2"] + margin) & (y >= box["y1"] - margin) & (y <= box["y2"] + margin)


def area_usable(area: Column, kind: Column, boxes: Column, width: Column, height: Column) -> Column:
    """A focus area that is not too large: a point always, a grid only where all subjects (one at least) are small."""
    small = (F.size(boxes) > 0) & F.forall(boxes, lambda b: area_share(b, width, height) < SMALL_SUBJECT)
    return F.coalesce((area_share(area, width, height) <= MOST_AREA) & F.when(kind == "grid", small).otherwise(True), F.lit(False))


def area_opinion(area: Column, kind: Column, boxes: Column, width: Column, height: Column) -> Column:
    """The area where it may speak and is large enough to judge a subject by, else null."""
    return F.when(area_usable(area, kind, boxes, width, height) & (area_share(area, width, height) >= LEAST_OPINION), area)


def area_is_subject(area: Column, kind: Column, boxes: Column, width: Column, height: Column) -> Column:
    """True: the area is off all subjects, and so is what the picture is of. False: a subject holds it. Null: it does not say."""
    near = NEAR * F.greatest(width, height)
    held = F.exists(boxes, lambda b: holds_middle(b, area))
    close = F.exists(boxes, lambda b: holds_middle(b, area, near))
    return F.when(area_usable(area, kind, boxes, width, height), F.when(held, False).otherwise(~close))


def focus_calls(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """id, call: detection, area or none, for frames (id, width, height, af, af_kind, af_score) by their vehicles and persons (image_id, box).

    The area counts as the subject only where it could be measured (af_score).
    """
    box = subjects.where(F.coalesce("region_type", F.lit("vehicle")).isin("vehicle", "person")).groupBy(F.col("image_id").alias("id")).agg(F.sort_array(F.collect_list("box")).alias("boxes"))
    j = frames.join(box, "id", "left")
    boxes = F.coalesce("boxes", F.array().cast(box.schema["boxes"].dataType))
    says = area_is_subject(F.col("af"), F.col("af_kind"), boxes, F.col("width"), F.col("height"))
    call = F.when(F.col("af").isNull() | says.isNull(), "none").when(~says, "detection").when(F.col("af_score").isNull(), "none").otherwise("area")
    return j.select("id", call.alias("call"))


def mark_bystanders(subjects: DataFrame, calls: DataFrame) -> DataFrame:
    """``subjects`` of frames whose focus area is the subject: bystanders, and not culled."""
    off = calls.where("call = 'area'").select(F.col("id").alias("image_id"), F.lit(True).alias("_off"))
    hit = F.col("_off").isNotNull()
    return subjects.join(off, "image_id", "left").withColumns({"bystander": F.when(hit, 1).otherwise(F.col("bystander")), "cull_reason": F.when(~hit, F.col("cull_reason"))}).select(subjects.columns)


def sure_readings(readings: Column, threshold: float = SURE) -> Column:
    """Readings (structs tag, p) that count."""
    return F.filter(readings, lambda r: r["p"] >= threshold)


def maybe_readings(readings: Column, threshold: float = SURE) -> Column:
    """Readings that are shown as likely and count for nothing."""
    return F.filter(readings, lambda r: (r["p"] >= MAYBE) & (r["p"] < threshold))


def moment_lift(readings: Column, weights: Column, strength: Column, threshold: float = SURE) -> Column:
    """struct(amount, tag) of the weightiest sure moment: its weight (a map of tags) times the strength (missing: 1); null if there is none."""
    force = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(strength, F.lit(1.0))))
    known = F.filter(sure_readings(readings, threshold), lambda r: F.map_contains_key(weights, r["tag"]))
    return F.array_max(F.transform(known, lambda r: F.struct((F.element_at(weights, r["tag"]) * force).alias("amount"), r["tag"].alias("tag"))))


def lift_bucket(amount: Column) -> Column:
    """0 to 4, coarse on purpose."""
    return F.round(4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(amount, F.lit(0.0))))).cast("int")


def moment_verdict(answers: Column, tags: tuple[str, ...]) -> Column:
    """struct(readings, strength) of ``answers``, a map of question to struct(noul, score): finite probabilities within 0 and 1 in order of ``tags``, and the strength of its levels."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    asked = F.filter(F.transform(F.array(*map(F.lit, tags)), lambda t: F.struct(t.alias("tag"), F.try_element_at(answers, F.concat(F.lit("m_"), t))["noul"].alias("p"))), lambda r: finite(r["p"]))
    score = F.try_element_at(answers, F.lit("strength"))["score"]
    return F.struct(F.transform(asked, lambda r: F.struct(r["tag"].alias("tag"), unit(r["p"]).alias("p"))).alias("readings"), F.when(finite(score), unit(score / LEVELS)).alias("strength"))


def metadata_verdict(rejected: Column, auto_rejected: Column, by_hand: Column, rating: Column, respect: bool = True) -> Column:
    """struct(stars, label, culled) that a file is to carry: -1 and Red for what is culled, else the stars (by hand before by rating) and the verdict's colour."""
    culled = F.coalesce(rejected, F.lit(False)) | (F.lit(respect) & by_hand.isNull() & F.coalesce(auto_rejected, F.lit(False)))
    word = verdict(rating)
    colour = F.when(word == "sharp", "Green").when(word == "blurred", "Red").otherwise("Yellow")
    return F.struct(F.when(culled, -1).otherwise(F.coalesce(by_hand, stars(rating))).cast("int").alias("stars"), F.when(culled, "Red").otherwise(colour).alias("label"), culled.alias("culled"))
