"""Edits as DataFrame deltas: every function returns the new table and leaves the old one as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, key: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with their key, nulls included, but for ``keep_if_null``; new keys are added."""
    d = delta.select(key, F.lit(True).alias("_given"), *[F.col(c).alias(f"_d_{c}") for c in delta.columns if c != key])
    joined = base.join(d, key, "full_outer")
    given = F.coalesce(F.col("_given"), F.lit(False))
    pick = lambda c: F.coalesce(f"_d_{c}", c) if c in keep_if_null else F.when(given, F.col(f"_d_{c}")).otherwise(F.col(c))
    return joined.select(*[pick(c).alias(c) if c != key and c in delta.columns else F.col(c) for c in base.columns])


def insert_ignore(base: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``base`` and the rows of ``new`` whose key it lacks; of equal new keys the first by ``order``."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return base.unionByName(first.join(base.select(*key), key, "left_anti"))


def replace_latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last written row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def apply_delta(base: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A null in the delta leaves the value."""
    d = delta.select(key, *[F.col(c).alias(f"_d_{c}") for c in columns])
    return base.join(d, key, "left").select(*[F.coalesce(f"_d_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def changed_only(base: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``delta`` that differ from ``base`` in any of ``columns`` (null equals null)."""
    b = base.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return delta.join(b, key).where(~same).select(delta.columns)


def reset(base: DataFrame, keep: list[str], where: Column | None = None) -> DataFrame:
    """All columns but ``keep`` set to null (on the rows that ``where`` holds for)."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return base.select(*[F.col(c) if c in keep else F.when(~hit, F.col(c)).alias(c) for c in base.columns])


def undo_last(rows: DataFrame, seq: str) -> DataFrame:
    """Without the row of the greatest ``seq``."""
    return rows.join(F.broadcast(rows.agg(F.max(seq).alias(seq))), seq, "left_anti")


def mark(frames: DataFrame, marks: DataFrame, key: str = "id", clear: str = "clear_stars") -> DataFrame:
    """``marks`` (id, stars, rejected, picked; null leaves) applied: stars, then the rejection, then the pick.

    A rejection clears the pick, and a pick the rejection; so of both together the pick stands. Where ``marks`` has a
    true ``clear_stars``, null stars are meant: the stars go. Of several marks of one frame none is taken before another: give one.
    """
    wipe = F.coalesce(F.col(clear), F.lit(False)) if clear in marks.columns else F.lit(False)
    m = marks.select(key, *[F.col(c).alias(f"_m_{c}") for c in ("stars", "rejected", "picked")], wipe.alias("_wipe"))
    j = frames.join(m, key, "left")
    rejected, picked = F.coalesce("_m_rejected", "rejected"), F.when(F.col("_m_rejected") != 0, 0).otherwise(F.col("picked"))
    out = {
        "stars": F.when(F.col("_wipe") & F.col("_m_stars").isNull(), None).otherwise(F.coalesce("_m_stars", "stars")),
        "rejected": F.when(F.col("_m_picked") != 0, 0).otherwise(rejected),
        "picked": F.coalesce("_m_picked", picked),
    }
    return j.withColumns(out).select(frames.columns)


def mark_subjects(subjects: DataFrame, marks: DataFrame, key: str = "id", image: str = "image_id", clear: str = "clear_stars") -> DataFrame:
    """The same ``marks`` on the subjects of the frames: stars and rejections; what is no longer rejected is not culled either."""
    wipe = F.coalesce(F.col(clear), F.lit(False)) if clear in marks.columns else F.lit(False)
    m = marks.select(F.col(key).alias(image), F.col("stars").alias("_m_stars"), F.col("rejected").alias("_m_rejected"), wipe.alias("_wipe"))
    out = {
        "stars": F.when(F.col("_wipe") & F.col("_m_stars").isNull(), None).otherwise(F.coalesce("_m_stars", "stars")),
        "rejected": F.coalesce("_m_rejected", "rejected"),
        "cull_reason": F.when(F.col("_m_rejected") == 0, None).otherwise(F.col("cull_reason")),
    }
    return subjects.join(m, image, "left").withColumns(out).select(subjects.columns)


def clear_groups(subjects: DataFrame, frames: DataFrame, album: int | None = None) -> DataFrame:
    """``subjects`` without group keys, sizes, agreements and colours (of one album, or of all)."""
    names = ["group_key", "group_size", "group_agreement", "group_colour_hex"]
    have = [c for c in names if c in subjects.columns]
    if album is None:
        return subjects.withColumns({c: F.lit(None).cast(subjects.schema[c].dataType) for c in have})
    own = frames.where(F.col("job_id") == album).select(F.col("id").alias("image_id"), F.lit(True).alias("_own"))
    return subjects.join(own, "image_id", "left").withColumns({c: F.when(F.col("_own").isNull(), F.col(c)) for c in have}).select(subjects.columns)


def clear_culls(subjects: DataFrame, frames: DataFrame, album: int) -> DataFrame:
    """``subjects`` of ``album`` without the reasons that rules gave; rejections by hand stay."""
    own = frames.where(F.col("job_id") == album).select(F.col("id").alias("image_id"), F.lit(True).alias("_own"))
    return subjects.join(own, "image_id", "left").withColumn("cull_reason", F.when(F.col("_own").isNull(), F.col("cull_reason"))).select(subjects.columns)


def drop_orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """A parent that goes takes its children along."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def reconcile(jobs: DataFrame, running: tuple[str, ...] = ("scanning", "culling", "identifying"), to: str = "interrupted") -> DataFrame:
    """After a crash, what was running is not."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*running), to).otherwise(F.col("status")))


def edit(base: DataFrame, delta: DataFrame, key: str, columns: list[str], given: str = "given") -> DataFrame:
    """Rows of ``delta`` (key, columns, given: the names that are meant) applied: a name that is given counts even if its value is null, and a name that is not leaves the value."""
    d = delta.select(key, *[F.col(c).alias(f"_d_{c}") for c in columns], F.col(given).alias("_given"))
    meant = lambda c: F.coalesce(F.array_contains("_given", c), F.lit(False))
    return base.join(d, key, "left").select(*[F.when(meant(c), F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])
