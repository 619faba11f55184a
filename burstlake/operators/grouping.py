"""Sessions, their joining, moments and sets of frames in one ordered pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import hypot, isnan, nan, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .moments import Rules
from .ranges import scanned
from .sequence import GAP, INTERVAL_GAP, MERGE_GAP, MERGE_LEEWAY, MERGE_LIVERY, MERGE_SCALE, MERGE_SCENE, MERGE_SHIFT, MERGE_SPAN, SetScan

#: What the pass reads of a frame, beside album, camera and path: box as fractions, scene and livery as histograms (livery of vehicles only).
READ = "frame_id long, taken double, portrait boolean, scene array<int>, livery array<int>, x1 double, y1 double, x2 double, y2 double, panning boolean, ev double, focus double, focal double, aperture double, shutter double"
#: What it gives.
FOUND = "frame_id long, taken double, begins boolean, opens boolean, grp long, moment long, set_id long, set_kind string"


def _apart(a, b) -> float:
    """The distance of two histograms, NaN if one is missing."""
    if a is None or b is None:
        return nan
    n = min(len(a), len(b))
    return min(1.0, max(0.0, 1 - float(np.minimum(a[:n], b[:n]).sum()) / 255.0))


def _area(box: tuple | None) -> float:
    return 0.0 if box is None else max(box[2] - box[0], 0.0) * max(box[3] - box[1], 0.0)


def _jumps(a: tuple, b: tuple, scale: float, shift: float) -> bool:
    big, small = max(_area(a), _area(b)), min(_area(a), _area(b))
    moved = hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) / sqrt(2.0)
    return (small > 0 and big / small > scale) or moved > shift


class Grouping:
    """State of one camera: the frame before, the open group (its first frame and when that was), the open moment (its first frame and its last box), and open sets.

    A session begins after a pause of more than ``gap``. With ``merge`` it joins the open group if the frames on both sides of the pause show one
    subject and the group is young enough. A moment ends where the picture becomes another one (``rules``; none: a group is one moment).
    """

    def __init__(self, gap: float, merge: bool, rules: Rules | None, keep_sets: bool) -> None:
        self.gap, self.merge, self.rules = gap, merge, rules
        self.sets = SetScan() if keep_sets else None
        self.before: tuple | None = None
        self.group = self.moment = self.last = self.began = None

    def restarts(self, rows: pd.DataFrame, before: pd.DataFrame | None) -> np.ndarray:
        """Nothing goes on over a pause that is longer than any rule allows."""
        longest = max(self.gap, MERGE_GAP if self.merge else 0.0, INTERVAL_GAP[1] if self.sets else 0.0)
        first = np.nan if before is None else before["taken"].to_numpy(float, na_value=np.nan)[0]
        fresh = ~(np.diff(rows["taken"].to_numpy(float, na_value=np.nan), prepend=first) <= longest)
        fresh[:1] &= before is not None
        return fresh

    def _joins(self, t: float, now: tuple) -> bool:
        (before, portrait, scene, livery, box), (_, portrait2, scene2, livery2, box2) = self.before, now
        if not (0 <= t - before <= MERGE_GAP) or portrait != portrait2 or not _apart(scene, scene2) <= MERGE_SCENE:
            return False
        if box is not None and box2 is not None and _jumps(box, box2, MERGE_SCALE * MERGE_LEEWAY, MERGE_SHIFT * MERGE_LEEWAY):
            return False
        return not _apart(livery, livery2) > MERGE_LIVERY and t - self.began <= MERGE_SPAN

    def _stays(self, t: float, now: tuple, boxed: tuple | None, panning: bool) -> bool:
        """The frame belongs to the open moment."""
        rules, (before, _, scene, _, _), (_, _, scene2, livery2, _) = self.rules, self.before, now
        box, livery, pan = self.last if self.last is not None else (None, None, False)
        if rules.pause > 0 and t - before > rules.pause:
            if _apart(scene, scene2) > rules.scene or (boxed is not None and _apart(livery, livery2) > rules.pause_livery):
                return False
        if boxed is None or box is None:
            return True
        leeway = rules.pan if pan and panning else 1.0
        return not _jumps(box, boxed, rules.scale * leeway, rules.shift * leeway) and not _apart(livery, livery2) > rules.livery

    def _grouped(self, rows: pd.DataFrame) -> pd.DataFrame:
        begins, opens, groups, moments = [], [], [], []
        read = [rows[c].tolist() for c in ("frame_id", "taken", "portrait", "scene", "livery", "x1", "y1", "x2", "y2", "panning")]
        for frame, t, portrait, scene, livery, x1, y1, x2, y2, panning in zip(*read, strict=True):
            t = nan if t is None else t
            box = None if x1 is None or isnan(x1) else (x1, y1, x2, y2)
            now = (t, bool(portrait), scene, livery, box)
            new = self.before is None or not t - self.before[0] <= self.gap
            joined = new and self.merge and self.before is not None and self._joins(t, now)
            if new and not joined:
                self.group, self.began, self.moment, self.last = frame, t, None, None
            boxed = box if self.rules is not None and _area(box) >= self.rules.least_area else None
            if self.moment is None or (self.rules is not None and not self._stays(t, now, boxed, bool(panning))):
                self.moment, self.last = frame, None
            if boxed is not None:
                self.last = (box, livery, bool(panning))
            self.before = now
            begins.append(new)
            opens.append(frame == self.moment)
            groups.append(self.group)
            moments.append(self.moment)
        found = {"begins": np.array(begins, bool), "opens": np.array(opens, bool), "grp": groups, "moment": moments}
        if self.sets is not None:
            return rows.assign(**found)
        none = {"set_id": pd.array([None] * len(rows), "Int64"), "set_kind": None}
        return pd.DataFrame({"frame_id": rows["frame_id"].array, "taken": rows["taken"].array, **found, **none})

    def step(self, rows: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
        if self.sets is not None:
            yield from self.sets.step(self._grouped(rows), last)
        elif len(rows):
            yield self._grouped(rows)

    def held(self) -> object:
        plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else [plain(y) for y in x] if isinstance(x, tuple | list) else x
        sets = None if self.sets is None else {kind: {c: [plain(v) for v in values] for c, values in held.items()} for kind, held in self.sets.open.items()}
        return plain(self.before), self.group, self.began, self.moment, plain(self.last), sets


def grouped(frames: DataFrame, gap: float = GAP, merge: bool = True, rules: Rules | None = Rules(), keep_sets: bool = True, ranges: int | None = None) -> DataFrame:
    """frame_id, taken, begins (a session), opens (a moment), grp and moment (the first frame_id of each), set_id and set_kind of ``frames`` (READ; album, camera, path).

    One sort, by ranges of album, camera, time and path (untimed frames last, sessions of their own); a camera of any size is dealt to many tasks.
    """
    order = [F.col("taken").asc_nulls_last(), F.col("path"), F.col("frame_id")]
    kind = T.StructType.fromDDL(FOUND)
    return scanned(frames, [F.col("album"), F.col("camera")], order, partial(Grouping, gap, merge, rules, keep_sets), kind, ranges, ("album", "camera", "path"))
