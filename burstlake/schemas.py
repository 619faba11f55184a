"""Table schemas, and reading tables that lack later columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that the operators use; a table may have more.
FRAMES = "id long, job_id long, path string, width long, height long, status string, camera string, taken_at double, burst_key long, time_burst long, copy_of long, phash long, lens string, iso long, sharpness double, rating double, rating_verdict string, stars long, rejected long, picked long, burst_pick long, f_number double, focal_length double, exposure_time double"
SUBJECTS = "id long, image_id long, x1 double, y1 double, x2 double, y2 double, cls string, conf double, number string, plate string, attributes string, reviewed long, rejected long, uncertain long, bystander long, region_type string, group_key long, rating double, stars long, cull_reason string, sharpness double, burst_pick long"
DEFAULTS = {"region_type": "vehicle", "rejected": 0, "picked": 0}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones are added with their default, others are kept."""
    out = df
    have = {c.lower() for c in df.columns}
    for part in schema.split(", "):
        name, kind = part.split(" ")
        if name not in have:
            out = out.withColumn(name, F.lit(DEFAULTS.get(name)).cast(kind))
    return out


def visible(prefix: str = "") -> Column:
    """Done, and not a hidden copy."""
    return (F.col(f"{prefix}status") == "done") & (F.coalesce(F.col(f"{prefix}copy_of"), F.lit(0)) == 0)


def is_vehicle() -> Column:
    return F.coalesce("region_type", F.lit("vehicle")) == "vehicle"


def needs_review(conf: Column, reviewed: Column, rejected: Column, uncertain: Column, threshold: Column) -> Column:
    """Reviewed: no. Rejected: if uncertain. Else: confidence (missing: 1) under the threshold (missing or 0: 0.8)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    bar = F.coalesce(F.nullif(threshold, F.lit(0.0)), F.lit(0.8))
    return F.when(zero(reviewed) != 0, False).when(zero(rejected) != 0, zero(uncertain) != 0).otherwise(F.coalesce(conf, F.lit(1.0)) < bar)
