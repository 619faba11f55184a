"""Resets over several tables, planned from declared keys; and cached files that nothing refers to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutations import clear_groups

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Keys:
    """key: the key of each table; parents: child, the column that refers to the parent, parent."""

    key: dict[str, str]
    parents: tuple[tuple[str, str, str], ...]

    def depending(self, root: str) -> list[tuple[str, str, str]]:
        """The references below ``root``, parents before their children; a cycle is an error."""
        below = self._below(root)
        out, left = [], [p for p in self.parents if p[2] in below]
        while left:
            waiting = {child for child, _, _ in left}
            ready = [p for p in left if p[2] not in waiting]
            if not ready:
                raise ValueError("tables refer to each other in a circle")
            out += ready
            left = [p for p in left if p not in ready]
        return out

    def _below(self, root: str) -> set[str]:
        found = {root}
        while more := {c for c, _, p in self.parents if p in found} - found:
            found |= more
        return found


#: The tables of a library, and what refers to what.
LIBRARY = Keys({"jobs": "id", "images": "id", "detections": "id", "faces": "id"}, (("images", "job_id", "jobs"), ("detections", "image_id", "images"), ("faces", "detection_id", "detections")))
#: What a frame keeps when its album is reset, and what its columns are then (null, if not named).
KEPT, FRESH = ("id", "job_id", "path"), {"status": "pending", "rejected": 0, "picked": 0}
#: What a scan measured, and what a group's vote gave.
MEASURED = ("error", "sharpness", "rating", "burst_key")


def without(tables: Tables, root: str, gone: Column, keys: Keys = LIBRARY) -> Tables:
    """``tables`` without the rows of ``root`` that ``gone`` holds for, and without all that depends on them, table by table in order of dependence.

    A table that is not there is passed over, with what only depends on it. Rows whose parent is not known at all stay.
    """
    out = dict(tables)
    lost = {root: tables[root].where(gone).select(F.col(keys.key[root]).alias("_id"))}
    out[root] = tables[root].where(~F.coalesce(gone, F.lit(False)))
    for child, column, parent in keys.depending(root):
        if child not in tables or parent not in lost:
            continue
        hit = out[child].join(lost[parent].select(F.col("_id").alias(column)).distinct(), column, "left_semi")
        found = hit.select(F.col(keys.key[child]).alias("_id"))
        lost[child] = found if child not in lost else lost[child].union(found)
        out[child] = out[child].join(lost[parent].select(F.col("_id").alias(column)).distinct(), column, "left_anti")
    return out


def _of(tables: Tables, job: int | None) -> Column:
    return F.lit(True) if job is None else F.coalesce(F.col("job_id") == job, F.lit(False))


def _own(tables: Tables, job: int | None) -> DataFrame:
    """Detections with _in: whether they belong to the album (all: they belong to some)."""
    images = tables["images"].where(_of(tables, job)).select(F.col("id").alias("image_id"), F.lit(True).alias("_in"))
    return tables["detections"].join(images, "image_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def _set(df: DataFrame, hit: Column, values: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if c in df.columns})


def reset_identifications(tables: Tables, job: int | None = None) -> Tables:
    """What was read goes: groups, attributes of detections that nobody reviewed, numbers that came from the model. The rest stays."""
    d = _own({**tables, "detections": clear_groups(tables["detections"], tables["images"], job)}, job)
    hit = F.col("_in")
    d = _set(d, hit & (F.col("reviewed") == 0), {"attributes": None})
    d = _set(d.withColumn("_vlm", F.coalesce(F.col("number_source") == "vlm", F.lit(False))), hit & F.col("_vlm"), {"number": None, "number_source": None, "number_conf": None})
    return {**tables, "detections": d.select(tables["detections"].columns)}


def reset_ratings(tables: Tables, job: int | None = None) -> Tables:
    """Stars and rejections by hand go, on frames and detections."""
    images = _set(tables["images"], _of(tables, job), {"stars": None, "rejected": 0})
    return {**tables, "images": images, "detections": _set(_own(tables, job), F.col("_in"), {"stars": None, "rejected": 0}).select(tables["detections"].columns)}


def reset_detections(tables: Tables, job: int | None = None, keys: Keys = LIBRARY) -> Tables:
    """Detections go with what depends on them; frames wait again without what was measured; the album is stopped."""
    out = without({**tables, "detections": _own(tables, job)}, "detections", F.col("_in"), keys)
    jobs = _set(tables["jobs"], F.lit(True) if job is None else F.col("id") == job, {"status": "stopped"})
    images = _set(tables["images"], _of(tables, job), {"status": "pending"} | dict.fromkeys(MEASURED))
    return {**out, "detections": out["detections"].select(tables["detections"].columns), "images": images, "jobs": jobs}


def reset_album(tables: Tables, job: int, keys: Keys = LIBRARY) -> Tables:
    """One album as it was after import: no detections, frames with id, album and path alone."""
    out = reset_detections(tables, job, keys)
    values = {c: FRESH.get(c) for c in tables["images"].columns if c not in KEPT}
    return {**out, "images": _set(tables["images"], _of(tables, job), values), "jobs": _set(tables["jobs"], F.col("id") == job, {"status": "indexed"})}


def reset_all(tables: Tables, keys: Keys = LIBRARY) -> Tables:
    """No album is left, nor anything of one; tables that depend on none stay."""
    return without(tables, "jobs", F.lit(True), keys)


#: Names of cached files.
CACHED = r"^(?:.*[/\\])?(thumb|view|crop)-([0-9]+)\.jpg$"


def cached(files: DataFrame, images: DataFrame, detections: DataFrame) -> DataFrame:
    """``files`` (path, bytes) that are named as the cache names them, with kind (thumb, view, crop), id and orphaned: nothing refers to them.

    Thumbs and previews belong to frames, crops to detections that have one. Two anti joins; other files are not touched.
    """
    kind, of = F.regexp_extract("path", CACHED, 1), F.regexp_extract("path", CACHED, 2).try_cast("long")
    ours = files.select("*", kind.alias("kind"), of.alias("id")).where("kind <> '' and id is not null")
    frames = images.select(F.lit("frame").alias("_owner"), F.col("id"))
    crops = detections.where("crop_path is not null").select(F.lit("crop").alias("_owner"), F.col("id"))
    live = frames.unionByName(crops).distinct().withColumn("_live", F.lit(True))
    owner = F.when(F.col("kind") == "crop", "crop").otherwise("frame")
    return ours.withColumn("_owner", owner).join(live, ["_owner", "id"], "left").withColumn("orphaned", F.col("_live").isNull()).drop("_owner", "_live")


def cache_survey(found: DataFrame) -> DataFrame:
    """slot (thumb, view, crop, orphaned, total), files, bytes of what ``cached`` found."""
    slots = F.explode(F.array(F.when(F.col("orphaned"), "orphaned").otherwise(F.col("kind")), F.lit("total")))
    return found.select(slots.alias("slot"), "bytes").groupBy("slot").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def doomed(found: DataFrame, orphaned: bool = True, previews: bool = False, of_frames: DataFrame | None = None) -> DataFrame:
    """The files that a clearing removes: orphans, all previews, or those of some frames (id)."""
    hit = (F.lit(orphaned) & F.col("orphaned")) | (F.lit(previews) & (F.col("kind") == "view"))
    if of_frames is None:
        return found.where(hit)
    mine = of_frames.select("id").distinct().withColumn("_mine", F.lit(True))
    return found.join(mine, "id", "left").where(hit | ((F.col("kind") == "view") & F.coalesce("_mine", F.lit(False)))).drop("_mine")
