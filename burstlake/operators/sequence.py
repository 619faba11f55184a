"""Operators on time-ordered frames: sessions, their merging, sets, samples and rates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import inf, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import continuity, histogram_distance
from .lineage import numbered, running_sums
from .ranges import scanned, with_previous

#: Seconds between frames of one burst; joining bursts; brackets, stacks and intervals.
GAP, MERGE_GAP, MERGE_SPAN = 1.5, 10.0, 30.0
BRACKET_GAP, BRACKET_FRAMES, BRACKET_STEP, BRACKET_SPAN, BRACKET_REPEAT = 2.0, (3, 9), 0.6, 1.5, 0.2
STACK_GAP, STACK_FRAMES, STACK_RATIO = 1.5, 3, 0.01
INTERVAL_GAP, INTERVAL_FRAMES, INTERVAL_SPREAD = (1.0, 120.0), 10, 0.10
FOCAL_TOLERANCE, APERTURE_TOLERANCE, SHUTTER_TOLERANCE = 0.01, 0.34, 0.34
#: Fixed values of joining bursts: distance of scenes and liveries, and the ratio of areas and the shift of boxes (with leeway).
MERGE_SCENE, MERGE_LIVERY, MERGE_SCALE, MERGE_SHIFT, MERGE_LEEWAY = 0.12, 0.50, 3.0, 0.30, 1.5


def sessionise(frames: DataFrame, camera: str, taken: str, tie: str, gap: float = GAP) -> DataFrame:
    """Adds ``session`` (from 0 within the camera): a new one begins where two frames lie more than ``gap`` seconds apart.

    Frames without a time come after the timed ones and are sessions of their own. One shuffle, by camera.
    """
    order = Window.partitionBy(camera).orderBy(F.col(taken).isNull(), taken, tie)
    apart = F.col(taken) - F.lag(taken).over(order)
    new = F.when(F.col(taken).isNull() | (apart > gap), 1).otherwise(0)
    return frames.withColumn("_new", F.when(F.row_number().over(order) == 1, 0).otherwise(new)).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def number_sessions(frames: DataFrame, camera: str) -> DataFrame:
    """Adds ``burst``: sessions numbered from 1 over all cameras in order of name.

    Cameras are counted and summed by ranges: one row for each range passes through a single task.
    """
    counts = running_sums(frames.groupBy(camera).agg((F.max("session") + 1).alias("_n")), camera, ["_n"])
    base = counts.select(camera, (F.col("_n_sum") - F.col("_n")).alias("_base"))
    return frames.join(base, camera).withColumn("burst", F.col("_base") + F.col("session") + 1).drop("_base")


def bursts(frames: DataFrame, keys: list[str], taken: str, member: str) -> DataFrame:
    """A row for each burst: started, ended, frames (in order of time), n."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(taken, member))), lambda x: x[member])
    return frames.groupBy(*keys).agg(F.min(taken).alias("started"), F.max(taken).alias("ended"), ordered.alias("frames"), F.count("*").alias("n"))


def same_subject(leeway: float = MERGE_LEEWAY) -> Column:
    """The default rule of ``merge_bursts``: the last frame of burst ``a`` and the first of ``b`` show one subject.

    Each burst has ``first`` and ``last``: structs of portrait, scene, livery (histograms; the livery of vehicles only) and
    box (x1, y1, x2, y2 as fractions). The orientation and the scene must be alike; boxes and liveries where both have them.
    """
    step = continuity("a.last.box", "b.first.box")
    boxes = (step["scale"] <= MERGE_SCALE * leeway) & (step["shift"] <= MERGE_SHIFT * leeway)
    both_boxed = F.col("a.last.box").isNotNull() & F.col("b.first.box").isNotNull()
    livery = histogram_distance(F.col("a.last.livery"), F.col("b.first.livery"))
    scene = histogram_distance(F.col("a.last.scene"), F.col("b.first.scene"))
    return (F.col("a.last.portrait") == F.col("b.first.portrait")) & (scene <= MERGE_SCENE) & (~both_boxed | boxes) & F.coalesce(livery <= MERGE_LIVERY, F.lit(True))


class _Spans:
    """A group keeps the key and the start of its first burst; the rest follows from neighbours."""

    def __init__(self, span: float) -> None:
        self.span, self.open = span, None

    def restarts(self, rows: pd.DataFrame, before: pd.DataFrame | None) -> np.ndarray:
        fresh = ~rows["_may"].to_numpy(bool)
        fresh[:1] &= before is not None
        return fresh

    def step(self, rows: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
        keys = []
        for burst, start, may_join in zip(rows["burst"], rows["started"], rows["_may"], strict=True):
            if self.open is None or not may_join or start - self.open[1] > self.span:
                self.open = burst, start
            keys.append(self.open[0])
        yield rows.assign(merged=keys)

    def held(self) -> object:
        return self.open


def merge_bursts(ends: DataFrame, camera: str, joins: Column | None = None, span: float = MERGE_SPAN, gap: float = MERGE_GAP, ranges: int | None = None) -> DataFrame:
    """``ends``: a row for each burst (camera, burst, started, ended). Adds ``merged``: the key of the group's first burst.

    A burst joins the open group if it begins within ``gap`` of the last one's end, ``joins`` holds (a column of
    the rows ``a``, the one before, and ``b``; ``same_subject`` if none is given), and it begins within ``span`` of the group's start. The last rule depends
    on where the group began: bursts (not frames) are scanned in order, by ranges, so that one camera may hold them all.
    """
    return merged_after(before_bursts(ends, camera, ranges), ends, camera, joins, span, gap, ranges)


def before_bursts(ends: DataFrame, camera: str, ranges: int | None = None) -> DataFrame:
    """``ends`` with ``a``, the burst before of the camera: what ``merged_after`` reads, whatever its rule."""
    return with_previous(ends, [F.col(camera)], [F.col("started"), F.col("burst")], "a", ranges)


def merged_after(paired: DataFrame, ends: DataFrame, camera: str, joins: Column | None = None, span: float = MERGE_SPAN, gap: float = MERGE_GAP, ranges: int | None = None) -> DataFrame:
    """``merge_bursts`` of ``paired`` (``before_bursts`` of ``ends``), so that several rules share one sort of neighbours."""
    paired = paired.withColumn("b", F.struct(*[F.col(c) for c in ends.columns]))
    may = F.coalesce((F.col("b.started") >= F.col("a.ended")) & (F.col("b.started") - F.col("a.ended") <= gap) & (same_subject() if joins is None else joins), F.lit(False))
    flagged = paired.withColumn("_may", may).drop("a", "b")
    return scanned(flagged, [F.col(camera)], [F.col("started"), F.col("burst")], partial(_Spans, span), T.StructType([*ends.schema.fields, T.StructField("merged", ends.schema["burst"].dataType)]), ranges)


def renumber(frames: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Adds ``dense``: ``key`` renumbered from 1 by first appearance. One row for each key is sorted, in ranges; a null key is none."""
    firsts = frames.groupBy(key).agg(F.min(F.struct(*order_by)).alias("_first"))
    return frames.join(numbered(firsts.where(F.col(key).isNotNull()), [F.col("_first")], "dense").select(key, "dense"), key)


def _close(a: float, b: float) -> bool:
    return a != a or b != b or abs(a - b) <= FOCAL_TOLERANCE * max(abs(a), abs(b))


def _stops(a: float, b: float, each: float, most: float) -> bool:
    """Two settings are within ``most`` stops, where doubling is ``each``; a setting that is missing or no number over 0 is no mismatch."""
    if a == b or not (a > 0 and b > 0):
        return a != inf or b != inf
    ratio = a / b
    return ratio > 0 and abs(each * log2(ratio)) <= most


class SetScan:
    """Brackets, then focus stacks, then intervals, each on frames that are still free; held are the runs of each kind that are open."""

    def __init__(self) -> None:
        self.open: dict[str, dict[str, list]] = {}

    def restarts(self, rows: pd.DataFrame, before: pd.DataFrame | None) -> np.ndarray:
        """No run of any kind goes on over a longer pause, nor over a frame without a time."""
        first = np.nan if before is None else before["taken"].to_numpy(float, na_value=np.nan)[0]
        fresh = ~(np.diff(rows["taken"].to_numpy(float, na_value=np.nan), prepend=first) <= INTERVAL_GAP[1])
        fresh[:1] &= before is not None
        return fresh

    def step(self, pdf: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
        kept = self.open
        self.open = {}
        for kind, end_of in (("bracket", _bracket_end), ("stack", _stack_end), ("interval", _interval_end)):
            if kind in kept:
                held = pd.DataFrame(kept[kind])
                pdf = pd.concat([held, pdf], ignore_index=True) if len(pdf) else held
            nothing = np.full(len(pdf), np.nan)
            read = [pdf[c].to_numpy(float, na_value=np.nan) if c in pdf.columns else nothing for c in ("taken", "ev", "focus", "focal", "aperture", "shutter")]
            run_end = end_of(*read)
            owner, i, n = np.full(len(pdf), -1), 0, len(pdf)
            while i < n:
                end, good = run_end(i)
                if end == n and not last:  # the run may go on
                    break
                if good:
                    owner[i:end] = i
                i = end if good else i + 1
            if i < len(pdf):
                self.open[kind] = pdf.iloc[i:].to_dict("list")
            taken = owner >= 0
            if taken.any():
                yield pdf[taken].assign(set_id=pd.array(pdf["frame_id"].to_numpy()[owner[taken]], "Int64"), set_kind=kind)
            pdf = pdf[:i][~taken[:i]]
        if len(pdf):
            yield pdf.assign(set_id=pd.array([None] * len(pdf), "Int64"), set_kind=None)

    def held(self) -> object:
        return self.open or None


def sets(frames: DataFrame, camera: str = "camera", ranges: int | None = None) -> DataFrame:
    """``frames`` (camera, frame_id, taken, ev, focus, focal; aperture and shutter if they are known) with set_id (its first frame_id) and set_kind.

    All kinds keep the focal length and the aperture of their first frame, stacks the shutter, too. Greedy runs consume frames,
    so they are scanned in order: by ranges, batch by batch, so that one camera may hold all frames.
    """
    schema = T.StructType([*frames.schema.fields, T.StructField("set_id", T.LongType()), T.StructField("set_kind", T.StringType())])
    return scanned(frames, [F.col(camera)], [F.col("taken").asc_nulls_last(), F.col("frame_id")], SetScan, schema, ranges)


def _bracket_end(taken, ev, focus, focal, aperture, shutter):
    """A function of a frame's place: where the run from it on ends (it is none itself: there), and whether it is a set; so the next two. Plain numbers are read frame by frame."""
    t, ev, focal, aperture = (x.tolist() for x in (taken, ev, focal, aperture))
    n = len(t)

    def run_end(i: int) -> tuple[int, bool]:
        if ev[i] != ev[i]:
            return i, False
        seen, most, y = [ev[i]], min(n, i + BRACKET_FRAMES[1]), i + 1
        while y < most:
            e = ev[y]
            if not (t[y] - t[y - 1] <= BRACKET_GAP) or e != e or abs(e - seen[-1]) < BRACKET_STEP or any(abs(s - e) < BRACKET_REPEAT for s in seen) or not _close(focal[i], focal[y]) or not _stops(aperture[i], aperture[y], 2.0, APERTURE_TOLERANCE):
                break
            seen.append(e)
            y += 1
        return y, len(seen) >= BRACKET_FRAMES[0] and max(seen) - min(seen) >= BRACKET_SPAN

    return run_end


def _stack_end(taken, ev, focus, focal, aperture, shutter):
    t, focus, focal, aperture, shutter = (x.tolist() for x in (taken, focus, focal, aperture, shutter))
    n = len(t)

    def run_end(i: int) -> tuple[int, bool]:
        up, y = None, i + 1
        while y < n:
            a, b = focus[y - 1], focus[y]
            if not (t[y] - t[y - 1] <= STACK_GAP) or not abs(b - a) > STACK_RATIO * max(abs(a), abs(b)) or (up is not None and (b > a) != up) or not _close(focal[i], focal[y]) or not _stops(aperture[i], aperture[y], 2.0, APERTURE_TOLERANCE) or not _stops(shutter[i], shutter[y], 1.0, SHUTTER_TOLERANCE):
                break
            up, y = b > a, y + 1
        return y, y - i >= STACK_FRAMES

    return run_end


def _interval_end(taken, ev, focus, focal, aperture, shutter):
    """Where settings stay as they are, a run ends where its pauses do, and the spread of its pauses follows from sums: a long uneven streak is not read anew from each frame."""
    gaps = np.diff(taken)
    n, cuts = len(taken), np.flatnonzero(~((gaps >= INTERVAL_GAP[0]) & (gaps <= INTERVAL_GAP[1]))) + 1
    ends = np.append(cuts, n)[np.searchsorted(cuts, np.arange(n), "right")].tolist()  # where the pauses break, from each frame on
    moved = lambda x: (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    settings = np.concatenate([[0], np.cumsum(moved(focal) | moved(aperture))]).tolist()
    inside = np.where((gaps >= INTERVAL_GAP[0]) & (gaps <= INTERVAL_GAP[1]), gaps, 0.0)
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]).tolist() for x in (inside, inside * inside))
    focal, aperture = focal.tolist(), aperture.tolist()

    def run_end(i: int) -> tuple[int, bool]:
        end = ends[i]
        if settings[end - 1] != settings[i] or abs(focal[i]) == inf or aperture[i] == inf:
            y = i + 1
            while y < end and _close(focal[i], focal[y]) and _stops(aperture[i], aperture[y], 2.0, APERTURE_TOLERANCE):
                y += 1
            end = y
        if end - i < INTERVAL_FRAMES:
            return end, False
        k = end - 1 - i
        mean = (sums[end - 1] - sums[i]) / k
        variance = (squares[end - 1] - squares[i]) / k - mean * mean
        bound = (INTERVAL_SPREAD * mean) ** 2
        if abs(variance - bound) <= 1e-6 * bound + 1e-12 * squares[end - 1]:  # too near for sums
            return end, bool(gaps[i : end - 1].std() < INTERVAL_SPREAD * gaps[i : end - 1].mean())
        return end, variance < bound

    return run_end


def spread_sample(rows: DataFrame, keys: list[str], order_by: list[str], most: int = 8) -> DataFrame:
    """Evenly spread rows of each group: every ceil(n / most)-th, ``most`` at least never exceeded."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    numbered = rows.withColumn("_at", F.row_number().over(order) - 1).withColumn("_step", F.ceil(F.count("*").over(Window.partitionBy(*keys)) / most))
    return numbered.where("_at % _step = 0 and _at / _step < " + str(most)).drop("_at", "_step")


def relative_features(rows: DataFrame, keys: list[str], value: str, order_by: list[str]) -> DataFrame:
    """Adds value_centred, value_rank (0 to 1 within the group), position, is_first, is_last, log_size."""
    whole, order, rank = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order_by), Window.partitionBy(*keys).orderBy(value, *order_by)
    n = F.count("*").over(whole)
    share = lambda w: F.when(n > 1, (F.row_number().over(w) - 1) / (n - 1)).otherwise(0.0)
    at = F.row_number().over(order)
    return rows.withColumns({"value_centred": F.col(value) - F.avg(value).over(whole), "value_rank": share(rank), "position": share(order), "is_first": at == 1, "is_last": at == n, "log_size": F.ln(n.cast("double"))})


def sliding_rate(samples: DataFrame, key: str, at: str, total: str, span: int, whole: str | None = None) -> DataFrame:
    """Adds ``rate``: units a second between the oldest sample within ``span`` seconds (or the one before) and this one; and, if ``whole`` names
    the column of what there is to do, ``eta``: the seconds that the rest takes at that rate (null at no rate)."""
    recent = Window.partitionBy(key).orderBy(at).rangeBetween(-span, 0)
    order = Window.partitionBy(key).orderBy(at)
    alone = F.count("*").over(recent) < 2
    t0 = F.when(alone, F.lag(at).over(order)).otherwise(F.first(at).over(recent))
    v0 = F.when(alone, F.lag(total).over(order)).otherwise(F.first(total).over(recent))
    rated = samples.withColumn("rate", F.try_divide(F.col(total) - v0, F.col(at) - t0))
    return rated if whole is None else rated.withColumn("eta", F.when(F.col("rate") > 0, F.greatest(F.col(whole) - F.col(total), F.lit(0)) / F.col("rate")))
