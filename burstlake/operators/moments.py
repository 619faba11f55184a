"""Moments: bursts cut where the picture becomes another one; and clusters joined by what their plates say."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import area, continuity, histogram_distance
from ..functions.text import CONFUSABLE


@dataclass(frozen=True)
class Rules:
    """Fixed values of the normal sensitivity."""

    scale: float = 3.0
    shift: float = 0.30
    pan: float = 1.5
    least_area: float = 0.005
    pause: float = 0.8
    scene: float = 0.26
    pause_livery: float = 0.45
    livery: float = 0.50

    def at(self, sensitivity: str) -> Rules:
        """gentle, normal or eager; anything else is normal."""
        k = {"gentle": 1.5, "eager": 0.7}.get(sensitivity.strip().lower(), 1.0)
        return replace(self, scale=self.scale * k, shift=self.shift * k, scene=self.scene * k, pause_livery=self.pause_livery * k, livery=self.livery * k)

    def with_pause(self, seconds: float) -> Rules:
        """0 turns cuts at pauses off; 10 at most."""
        return replace(self, pause=min(10.0, max(0.0, seconds)))


def split_moments(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``frames`` (burst, seq, taken, box, scene, livery, panning) with ``moment``, from 0 in each burst.

    A frame is compared with the last boxed one of its moment. A cut that does not depend on it (a pause and another scene) is
    found from neighbours alone; it begins a run, and all other cuts fall on boxed frames, which are themselves the last boxed
    one for what follows. So two windows give what a scan with carried state gives.
    """
    order = Window.partitionBy("burst").orderBy("seq")
    boxed = F.when(area("box") >= rules.least_area, F.struct("box", "livery", "panning"))
    rows = frames.withColumns({"_boxed": boxed, "_before": F.lag("taken").over(order), "_scene": F.lag("scene").over(order)})
    paused = F.coalesce(F.lit(rules.pause > 0) & (F.col("taken") - F.col("_before") > rules.pause), F.lit(False))
    scene_cut = F.coalesce(paused & (histogram_distance(F.col("scene"), F.col("_scene")) > rules.scene), F.lit(False))
    rows = rows.withColumns({"_paused": paused, "_run_cut": scene_cut}).withColumn("_run", F.sum(F.col("_run_cut").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("burst", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.last("_boxed", ignorenulls=True).over(in_run)).withColumns({"_a": F.col("_last.box"), "_b": F.col("_boxed.box")})
    apart = histogram_distance(F.col("_boxed.livery"), F.col("_last.livery"))
    step = continuity("_a", "_b")
    leeway = F.when(F.col("_last.panning") & F.col("panning"), rules.pan).otherwise(1.0)
    jump = F.coalesce((step["scale"] > rules.scale * leeway) | (step["shift"] > rules.shift * leeway), F.lit(False))
    another = F.coalesce((apart > rules.livery) | (F.col("_paused") & (apart > rules.pause_livery)), F.lit(False))
    cut = F.col("_run_cut") | (F.col("_boxed").isNotNull() & F.col("_last").isNotNull() & (jump | another))
    moment = F.sum(cut.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("moment", moment).select(*frames.columns, "moment")


def alike_plates(a: str, b: str) -> bool:
    """One plate, or the same but for one character that is read for another (``text.near_plate`` for scans that hold state)."""
    differing = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return len(a) == len(b) and (not differing or (len(differing) == 1 and any(set(differing[0]) <= set(c) for c in CONFUSABLE)))


def merge_on_plates(groups: DataFrame, album: str) -> DataFrame:
    """album, grp, merged: groups (album, grp, cls, plates, frames) joined to an earlier one that read the same or a near plate.

    Frames must be apart and classes equal; a group grows as it takes others in, so an album's groups (not its detections) are scanned.
    """

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grp", ignore_index=True)
        plates, frames = [set(p if p is not None else ()) for p in pdf["plates"]], [set(f if f is not None else ()) for f in pdf["frames"]]
        cls, to = pdf["cls"].tolist(), list(range(len(pdf)))
        for i in range(len(pdf)):
            if to[i] != i or not plates[i]:
                continue
            for j in range(i + 1, len(pdf)):
                if to[j] != j or not plates[j] or frames[i] & frames[j] or (cls[i] and cls[j] and cls[i] != cls[j]) or not any(alike_plates(p, q) for p in plates[j] for q in plates[i]):
                    continue
                to[j] = i
                plates[i] |= plates[j]
                frames[i] |= frames[j]
                cls[i] = cls[i] or cls[j]
        return pd.DataFrame({album: pdf[album], "grp": pdf["grp"], "merged": [pdf["grp"][t] for t in to]})

    kind = {f.name: f.dataType.simpleString() for f in groups.schema}
    return groups.groupBy(album).applyInPandas(scan, f"{album} {kind[album]}, grp {kind['grp']}, merged {kind['grp']}")


def peak_frame(probabilities: Column, floor: float) -> Column:
    """The position (from 0) of the greatest probability if it reaches ``floor`` and none equals it, else null."""
    top = F.array_max(probabilities)
    alone = F.size(F.filter(probabilities, lambda p: p == top)) == 1
    return F.when((top >= floor) & (top > 0) & alone, F.array_position(probabilities, top) - 1)


def hsv(colour: Column) -> Column:
    """struct(h, s, v), 0 to 1, of ``#rrggbb``; null if it is none."""
    part = lambda k: F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("double") / 255
    r, g, b = (F.when(colour.rlike("^#[0-9A-Fa-f]{6}$"), part(k)) for k in range(3))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    wide = top - low
    hue = F.when(r == top, (g - b) / F.nullif(wide, F.lit(0.0))).when(g == top, 2 + (b - r) / F.nullif(wide, F.lit(0.0))).otherwise(4 + (r - g) / F.nullif(wide, F.lit(0.0)))
    return F.when(top.isNotNull(), F.struct(F.coalesce(F.pmod(hue / 6, F.lit(1.0)), F.lit(0.0)).alias("h"), F.coalesce(F.try_divide(wide, top), F.lit(0.0)).alias("s"), top.alias("v")))


def same_swatch(a: Column, b: Column, hue: float = 0.075, grey: float = 0.18, light: float = 0.45) -> Column:
    """Two paint colours may be one: by hue, by lightness if both are grey; a missing colour is no mismatch."""
    apart = F.abs(a["h"] - b["h"])
    plain = (a["s"] < grey) & (b["s"] < grey)
    return F.coalesce(F.when(plain, F.abs(a["v"] - b["v"]) <= light).when((a["s"] < grey) != (b["s"] < grey), False).otherwise(F.least(apart, 1 - apart) <= hue), F.lit(True))


def eligible_bursts(rows: DataFrame, burst: str, delivered: str, least: int = 2, most: int = 30) -> DataFrame:
    """Rows of bursts of ``least`` to ``most`` frames with exactly one delivered."""
    w = Window.partitionBy(burst)
    return rows.withColumns({"_n": F.count("*").over(w), "_d": F.sum(F.col(delivered).cast("int")).over(w)}).where(f"_d = 1 and _n between {least} and {most}").drop("_n", "_d")


def stratified_cap(rows: DataFrame, strata: list[str], item: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each stratum, by a seeded hash: the same rows whatever the partitions."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), F.col(item)), item)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
