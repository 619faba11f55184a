"""Components, greedy clusters and copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import dot, hamming
from ..functions.text import plain_key, tidy_plate
from .lineage import cut, numbered, scanned, tabled
from .linkage import band_pairs
from .moments import alike_plates, merge_on_plates

#: Bits and seconds of near duplicates; cosines of one look and one face.
DUPE_BITS, SURE_BITS, DUPE_SECONDS, SAME_LOOK, SAME_FACE = 10, 4, 600.0, 0.90, 0.363
#: Frames to a block of the band join.
BLOCK = 2048


def components(edges: DataFrame, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(v, component) for every end of ``edges`` (a, b): the least v reachable. Nulls are no ends; repeats and loops are allowed.

    Every v hooks onto its least neighbour, chains of hooks are jumped, and the edges are contracted to what is left
    between the trees: in two rounds at least half of the trees that still have edges are gone, and the edges shrink
    with them. ``store`` cuts the lineage of each round.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null")
    left = store(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = left.select(F.col("a").alias("v")).union(left.select(F.col("b").alias("v"))).distinct().withColumn("component", F.col("v"))
    left = left.where("a < b")
    while not left.isEmpty():
        hooks = left.select(F.col("b").alias("v"), F.col("a").alias("to")).union(left.select(F.col("a").alias("v"), F.col("b").alias("to")))
        hooks = hooks.groupBy("v").agg(F.min("to").alias("to")).where("to < v")
        while True:  # to the root of each tree
            beyond = hooks.select(F.col("v").alias("to"), F.col("to").alias("beyond"))
            jumped = store(hooks.join(beyond, "to", "left").select("v", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
            hooks = jumped.select("v", "to")
            if jumped.where("moved").isEmpty():
                break
        found = store(found.join(hooks.withColumnRenamed("v", "component"), "component", "left").select("v", F.coalesce("to", "component").alias("component")))
        roots = [hooks.select(F.col("v").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b")]
        moved = left.join(roots[0], "a", "left").join(roots[1], "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b")
        left = store(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found


def _time_blocks(frames: DataFrame, seconds: float, block: int) -> tuple[DataFrame, DataFrame]:
    """``frames`` with ``n``, their block of ``block`` frames in order of time, and (i, n, hi): the blocks n that block i, which ends at ``hi``, meets (its own, and later ones within reach).

    A busy minute is as many blocks as it needs. One row a block is ordered in one task.
    """
    timed = frames.where("taken is not null and phash is not null").select(F.col("id").cast("long").alias("id"), F.col("taken").cast("double").alias("taken"), "phash", F.col("burst").cast("long").alias("burst"))
    placed = tabled(numbered(timed, [F.col("taken"), F.col("id")], "_place").withColumn("n", F.floor((F.col("_place") - 1) / block)).drop("_place"), "placed")
    blocks = placed.groupBy("n").agg(F.min("taken").alias("lo"), F.max("taken").alias("hi"))
    # a second more than they need, against rounding: frames are compared in full
    ends = blocks.select(F.col("lo").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("i"), "hi").union(blocks.select(F.col("hi") + seconds + 1, F.lit(1), "n", "hi"))
    seen = F.sum(1 - F.col("side")).over(Window.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    reach = ends.withColumn("seen", seen).where("side = 1")
    return placed, tabled(reach.select("i", F.explode(F.sequence(F.col("i"), F.col("seen") - 1)).alias("n"), "hi"), "meet")


def _frames_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Arrays of a batch's frames; ``sizes``: how many vectors each has, ``v``: those of all, as rows of a matrix (shorter ones and missing components are 0)."""
    whole = lambda c: pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False)
    out = {c: whole(c) for c in ("i", "n", "id", "taken", "burst")} | {"phash": whole("phash").astype(np.int64).view(np.uint64), "none": batch.column("burst").is_null().to_numpy(zero_copy_only=False)}
    if "v" not in batch.schema.names:
        return out | {"sizes": np.zeros(batch.num_rows, np.int64), "v": np.zeros((0, 0))}
    vectors = batch.column("v").flatten()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten(), 0.0).to_numpy(zero_copy_only=False)
    v = np.zeros((len(lengths), int(lengths.max(initial=0))))
    v[np.arange(v.shape[1]) < lengths[:, None]] = flat
    return out | {"sizes": pc.fill_null(pc.list_value_length(batch.column("v")), 0).to_numpy(zero_copy_only=False).astype(np.int64), "v": v}


def _joined(one: dict[str, np.ndarray], two: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    wide = max(one["v"].shape[1], two["v"].shape[1])
    v = np.concatenate([np.pad(x["v"], ((0, 0), (0, wide - x["v"].shape[1]))) for x in (one, two)])
    return {c: np.concatenate([one[c], two[c]]) for c in one if c != "v"} | {"v": v}


def _part(frames: dict[str, np.ndarray], low: int, high: int) -> dict[str, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(frames["sizes"])])
    return {c: x[low:high] for c, x in frames.items() if c != "v"} | {"v": frames["v"][at[low] : at[high]]}


def _alike(one: dict[str, np.ndarray], two: dict[str, np.ndarray], same: float) -> np.ndarray:
    """For each two frames that have vectors whether any two of these have a product of ``same`` at least (as in Spark, NaN is more than any number)."""
    out = np.zeros((len(one["id"]), len(two["id"])), bool)
    rows, columns = np.flatnonzero(one["sizes"]), np.flatnonzero(two["sizes"])
    if not len(rows) or not len(columns):
        return out
    n = min(one["v"].shape[1], two["v"].shape[1])
    a, b = one["v"][:, :n], two["v"][:, :n]
    with np.errstate(invalid="ignore", over="ignore"):
        product = a @ b.T
        good = ~(product < same)
        for k, m in zip(*np.nonzero(np.abs(product - same) < 1e-9), strict=True):  # component by component, as ``numeric.dot`` adds
            good[k, m] = not sum((a[k] * b[m]).tolist(), 0.0) < same
    first = lambda f: np.cumsum(f["sizes"][f["sizes"] > 0]) - f["sizes"][f["sizes"] > 0]
    out[np.ix_(rows, columns)] = np.logical_or.reduceat(np.logical_or.reduceat(good, first(one), axis=0), first(two), axis=1)
    return out


def _compared(seconds: float, bits: int, sure: int, same: float, most: int = 1024):
    """Pairs of frames near in time and hash, of different bursts (null: of none), that look alike or, where one has no vectors, whose hashes agree but for ``sure`` bits.

    Rows come in order of i, n and time: the frames of a block, which are kept, then those that it meets, which are compared as they pass.
    """

    def pairs(own: dict[str, np.ndarray], them: dict[str, np.ndarray], inside: bool) -> pa.RecordBatch:
        own = _part(own, int(np.searchsorted(own["taken"], them["taken"][0] - seconds - 1)), len(own["id"]))
        far = np.bitwise_count(own["phash"][:, None] ^ them["phash"][None, :])
        near = (far <= bits) & (them["taken"][None, :] - own["taken"][:, None] <= seconds) & ~((own["burst"][:, None] == them["burst"][None, :]) & ~own["none"][:, None] & ~them["none"][None, :])
        if inside:  # the last of its own are these: each pair once
            near &= np.arange(len(own["id"]))[:, None] < np.arange(len(own["id"]) - len(them["id"]), len(own["id"]))[None, :]
        both = (own["sizes"] > 0)[:, None] & (them["sizes"] > 0)[None, :]
        if (near & both).any():
            near &= np.where(both, _alike(own, them, same), far <= sure)
        else:
            near &= far <= sure
        k, m = np.nonzero(near)
        a, b = own["id"][k], them["id"][m]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far[k, m].astype(np.int32))], names=["a", "b", "bits"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            read = _frames_of(batch)
            ends = np.concatenate([[0], np.flatnonzero(np.diff(read["i"]) | np.diff(read["n"])) + 1, [batch.num_rows]]).tolist()
            for low, high in zip(ends, ends[1:], strict=False):
                for at in range(low, high, most):
                    them = _part(read, at, min(high, at + most))
                    i, inside = int(them["i"][0]), them["i"][0] == them["n"][0]
                    if inside:
                        own = them if own is None or own["i"][0] != i else _joined(own, them)
                    found = pairs(own, them, inside)
                    if found.num_rows:
                        yield found

    return compare


def near_in_time(frames: DataFrame, looks: DataFrame | None = None, same: float = SAME_LOOK, bits: int = DUPE_BITS, seconds: float = DUPE_SECONDS, block: int = BLOCK) -> DataFrame:
    """(a, b, bits) of ``frames`` (id, taken, phash, burst) of different bursts, at most ``seconds`` and ``bits`` apart, that show the same.

    ``looks`` (id, embedding) are the unit vectors of what a frame shows: where both have some, any two must have a product of ``same`` at least;
    where one has none, hashes must agree but for SURE_BITS. Frames are joined block by block in order of time, with their vectors: a frame goes once
    to each block that ends within reach before it, and what is near in hash alone is neither stored nor moved. Frames without time or hash have no pairs here.
    """
    placed, meet = _time_blocks(frames, seconds, block)
    if looks is not None:
        vectors = looks.where("embedding is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.collect_list("embedding").alias("v"))  # of one frame
        placed = placed.join(vectors, "id", "left")
    met = placed.join(meet, "n").where((F.col("n") == F.col("i")) | (F.col("taken") - F.col("hi") <= seconds)).drop("hi")
    ordered = met.repartition("i").sortWithinPartitions("i", "n", "taken", "id")
    return ordered.mapInArrow(_compared(seconds, bits, SURE_BITS, same), "a long, b long, bits int")


def near_frames(frames: DataFrame, confirm: Column | None = None, bits: int = DUPE_BITS, seconds: float = DUPE_SECONDS) -> DataFrame:
    """(a, b) of near-duplicate ``frames`` (id, taken, phash, burst) of different bursts.

    At most ``seconds`` apart and ``bits`` bits, and confirmed by ``confirm`` (a column on the structs a and b), or,
    where that is null, at most SURE_BITS. Frames without a time are compared with all frames of a near hash instead.
    """
    far = hamming(F.col("a.phash"), F.col("b.phash"))
    apart = F.coalesce(F.col("a.burst") != F.col("b.burst"), F.lit(True))
    good = (far <= bits) & apart & F.coalesce(confirm if confirm is not None else F.lit(None).cast("boolean"), far <= SURE_BITS)
    timed = band_pairs(frames, "id", "taken", seconds).where(good).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    # of four 16-bit parts one differs in a quarter of the bits at most: an untimed frame asks for all parts so near its own
    row, close = F.struct(*[F.col(c) for c in frames.columns]), bits // 4
    flips = [sum(1 << b for b in chosen) for n in range(close + 1) for chosen in combinations(range(16), n)]
    part = lambda k: F.shiftrightunsigned("phash", 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), part(k).alias("p")) for k in range(4)])).alias("part")
    flipped = lambda k: F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(k).alias("k"), part(k).bitwiseXOR(x).alias("p")))
    near = F.explode(F.flatten(F.array(*map(flipped, range(4))))).alias("part")
    untimed = frames.where("taken is null and phash is not null").select(row.alias("u"), near)
    others = frames.where("phash is not null").select(row.alias("o"), parts)
    met = untimed.join(others, "part").where("u.id <> o.id").where(hamming(F.col("u.phash"), F.col("o.phash")) <= bits)
    met = met.select(F.when(F.col("u.id") < F.col("o.id"), F.col("u")).otherwise(F.col("o")).alias("a"), F.when(F.col("u.id") < F.col("o.id"), F.col("o")).otherwise(F.col("u")).alias("b"))
    return timed.unionByName(met.where(good).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))).distinct()


def cluster_by_look(rows: DataFrame, same: float = SAME_LOOK) -> DataFrame:
    """``rows`` (burst, frame, det, cls, embedding; plate if it is known) with ``grp``, dense within the burst.

    In order of det: a row joins the group with the most similar member if that is ``same`` at least, the group
    does not hold the row's frame, and the classes agree. A group whose plates are clearly others is out, and the first
    that has seen the row's plate, or a near one, takes it at once. The order decides, so each burst is scanned; a null
    burst is one group of its own. A row without embedding gets no group.
    """
    names = rows.columns
    known = rows if "plate" in names else rows.withColumn("plate", F.lit(None).cast("string"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("det", ignore_index=True)
        groups: list[dict] = []
        out = []
        for frame, cls, vec, plate in zip(pdf["frame"], pdf["cls"], pdf["embedding"], pdf["_plate"], strict=True):
            best, score = None, 0.0
            v = None if vec is None else np.asarray(vec, float)
            if v is None:
                out.append(None)
                continue
            for k, g in enumerate(groups):
                if frame in g["frames"] or (cls and g["cls"] and cls != g["cls"]):
                    continue
                if plate and g["plates"]:
                    if any(alike_plates(plate, p) for p in g["plates"]):
                        best, score = k, 1.0
                        break
                    continue
                if g["vectors"].shape[1] != len(v):
                    continue
                s = float((g["vectors"] @ v).max())
                if s > score:
                    best, score = k, s
            if best is None or score < same:
                groups.append({"frames": set(), "vectors": np.zeros((0, len(v))), "cls": cls, "plates": set()})
                best = len(groups) - 1
            g = groups[best]
            g["frames"].add(frame)
            if g["vectors"].shape[1] == len(v):
                g["vectors"] = np.vstack([g["vectors"], v])
            g["cls"] = g["cls"] or cls
            if plate:
                g["plates"].add(plate)
            out.append(best)
        return pdf[names].assign(grp=pd.array(out, "Int64"))

    return known.withColumn("_plate", tidy_plate(F.col("plate"))).groupBy("burst").applyInPandas(scan, T.StructType([*rows.schema.fields, T.StructField("grp", T.LongType())]))


def vehicles(rows: DataFrame, album: str, same: float = SAME_LOOK) -> DataFrame:
    """album, det, vehicle, of ``rows`` (album, burst, frame, det, cls, embedding, plate): clusters by look, joined over bursts by their plates.

    ``vehicle`` is the least det of the first of the joined clusters, in order of their first dets.
    """
    looked = cluster_by_look(rows.withColumn("burst", F.struct(album, "burst")), same).where("grp is not null").withColumn("_plate", tidy_plate(F.col("plate")))
    key = [F.col(f"burst.{album}").alias(album), F.col("burst.burst").alias("burst"), F.col("grp")]
    groups = looked.groupBy("burst", "grp").agg(F.min("det").alias("first"), F.collect_set("_plate").alias("plates"), F.collect_set("frame").alias("frames"), F.min_by("cls", F.when(F.col("cls").isNotNull(), F.col("det"))).alias("cls"))
    merged = merge_on_plates(groups.select(F.col(f"burst.{album}").alias(album), F.col("first").alias("grp"), "cls", "plates", "frames"), album)
    named = groups.select("burst", "grp", F.col("first")).join(merged.select(F.col("grp").alias("first"), F.col("merged").alias("vehicle")), "first")
    return looked.select(*key, "det").withColumn("burst", F.struct(album, "burst")).join(named.select("burst", "grp", "vehicle"), ["burst", "grp"]).select(album, "det", "vehicle")


def cluster_by_signature(rows: DataFrame, album: str, bits: int = 14, colour: float = 0.62, window: int = 6) -> DataFrame:
    """album, det, grp (from 1, in order of det) of ``rows`` (album, det, frame, burst, shape, colours, cls, make, plate, paint).

    ``shape``: a 64-bit hash; ``colours``: a histogram; ``paint``: a measured colour as struct(h, s, v). A row joins the first group that fits: one that
    does not hold its frame, has no other plate (within a burst it may), and either has read its plate or is alike in class, make, colours and paint, and
    near: in shape, in frames, by a near plate, or in the burst. Across bursts shape and frames count only if make or paint agrees. The order
    decides, so each album is scanned in order, batch by batch; what is held is one entry a group. Rows without signature get none.
    """

    def scan():
        groups: list[dict] = []

        def fits(g: dict, r) -> bool:
            same_burst = r.burst is not None and r.burst in g["bursts"]
            near = False
            if r.plate and g["plates"]:
                if r.plate in g["plates"]:
                    return True
                near = any(alike_plates(r.plate, p) for p in g["plates"])
                if not near and not same_burst:
                    return False
            alike_make = not r.make or not g["make"] or r.make == g["make"]
            if (r.cls and g["cls"] and r.cls != g["cls"]) or (not near and not same_burst and not alike_make):
                return False
            if len(r.colours) != len(g["colours"]) or float(np.minimum(r.colours, g["colours"]).sum()) < colour or not _same_paint(r.paint, g["paint"]):
                return False
            close = bin((r.shape ^ g["shape"]) & (2**64 - 1)).count("1") <= bits or abs(r.frame - g["last"]) <= window
            if r.burst is not None and g["bursts"] and not same_burst and not ((r.make and g["make"] and alike_make) or (r.paint is not None and g["paint"] is not None)):
                close = False
            return close or near or same_burst

        def step(pdf: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            out = []
            for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                k = next((k for k, g in enumerate(groups) if r.frame not in g["frames"] and fits(g, r)), None)
                if k is None:
                    groups.append({"frames": set(), "bursts": set(), "plates": set(), "cls": None, "make": None, "colours": r.colours, "shape": r.shape, "paint": r.paint, "last": r.frame})
                    k = len(groups) - 1
                g = groups[k]
                g["frames"].add(r.frame)
                g["bursts"] |= {r.burst} - {None}
                g["plates"] |= {r.plate} - {None}
                g["cls"], g["make"], g["last"] = g["cls"] or r.cls, g["make"] or r.make, max(g["last"], r.frame)
                out.append(k + 1)
            yield pd.DataFrame({album: pdf[album], "det": pdf["det"], "grp": out})

        return step

    signed = rows.where("shape is not null and colours is not null").select(album, "det", "frame", "burst", "shape", "colours", F.nullif("cls", F.lit("")).alias("cls"), F.nullif(plain_key(F.col("make")), F.lit("")).alias("make"), tidy_plate(F.col("plate")).alias("plate"), F.array("paint.h", "paint.s", "paint.v").alias("paint"))
    signed = signed.withColumn("paint", F.when(~F.exists("paint", lambda x: x.isNull()), F.col("paint")))
    kind = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(album, kind[album]), T.StructField("det", kind["det"]), T.StructField("grp", T.LongType())])
    return scanned(signed, album, [F.col("det")], scan, schema)


def _same_paint(a, b, hue: float = 0.075, grey: float = 0.18, light: float = 0.45) -> bool:
    """``moments.same_swatch`` for scans that hold state."""
    if a is None or b is None:
        return True
    if (a[1] < grey) != (b[1] < grey):
        return False
    return abs(a[2] - b[2]) <= light if a[1] < grey else min(abs(a[0] - b[0]), 1 - abs(a[0] - b[0])) <= hue


def cluster_faces(rows: DataFrame, album: str, det: str, vector: str, same: float = SAME_FACE) -> DataFrame:
    """album, det, label: greedy clusters around running sums, labelled by their first det; of equal clusters the last wins.

    The order decides, so each album is scanned; what is held is a batch, and a sum for each cluster.
    """

    def scan():
        sums: list[np.ndarray] = []
        labels: list[int] = []

        def step(pdf: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            out = []
            for d, vec in zip(pdf[det], pdf[vector], strict=True):
                v = np.asarray(vec, float)
                best, score = None, -2.0
                for k, s in enumerate(sums):
                    cosine = float(s @ v) / (np.linalg.norm(s) * np.linalg.norm(v) or 1.0)
                    if cosine >= score:
                        best, score = k, cosine
                if best is None or score < same:
                    sums.append(v.copy())
                    labels.append(d)
                    best = len(sums) - 1
                else:
                    sums[best] += v
                out.append(labels[best])
            yield pd.DataFrame({album: pdf[album], det: pdf[det], "label": out})

        return step

    kind = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(album, kind[album]), T.StructField(det, kind[det]), T.StructField("label", kind[det])])
    return scanned(rows.where(F.col(vector).isNotNull()).select(album, det, vector), album, [F.col(det).asc_nulls_last()], scan, schema)


def collapse_copies(rows: DataFrame, same: list[Column], item: str, worth: list[Column] | None = None) -> DataFrame:
    """``rows`` with copy_of: the survivor of the rows with equal ``same`` (the greatest ``worth``, of equals the least item); null on survivors.

    A row that lacks any of ``same`` (no time, no content) stays alone, and so does one that is hidden already. Without ``worth``
    a picked row comes first, then one not rejected, then stars and reviews. If the rows have stars, picked and rejected, the survivor
    takes over the hand work of its copies: the most stars, any pick, and a rejection only if all were rejected and none picked; a copy
    is no pick any more. What pointed at a row that is now hidden points at its survivor.
    """
    has = set(rows.columns)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int") if c in has else F.lit(0)
    worth = worth or [zero("picked"), (zero("rejected") == 0).cast("int"), zero("stars"), zero("reviewed")]
    hidden = F.coalesce(F.col("copy_of"), F.lit(0)) != 0 if "copy_of" in has else F.lit(False)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(same)])
    whole = ~hidden
    for c in same:
        whole = whole & c.isNotNull()
    named = rows.withColumn("_same", F.when(whole, key))
    carried = [F.max(zero("stars")).alias("_stars"), F.max(zero("picked")).alias("_picked"), F.min(zero("rejected")).alias("_rejected")]
    best = named.where("_same is not null").groupBy("_same").agg(F.max_by(item, F.struct(*worth, -F.col(item))).alias("_kept"), F.count("*").alias("_n"), *carried).where("_n > 1")
    joined = named.join(best, "_same", "left")
    old = F.col("copy_of") if "copy_of" in has else F.lit(None).cast(rows.schema[item].dataType)
    is_copy, is_kept = F.col("_kept") != F.col(item), F.col("_kept") == F.col(item)
    now = joined.withColumn("_copy_of", F.when(is_copy, F.col("_kept")).otherwise(F.nullif(old, F.lit(0)) if "copy_of" in has else old))
    if "stars" in has:
        now = now.withColumn("stars", F.when(is_kept & (F.col("_stars") > 0), F.col("_stars")).otherwise(F.col("stars")))
    if "rejected" in has:
        now = now.withColumn("rejected", F.when(is_kept, F.when(F.col("_picked") == 1, 0).otherwise(F.least(F.col("_rejected"), F.lit(1)))).otherwise(F.col("rejected")))
    if "picked" in has:
        now = now.withColumn("picked", F.when(is_kept, F.col("_picked")).when(is_copy, 0).otherwise(F.col("picked")))
    if "burst_pick" in has:
        now = now.withColumn("burst_pick", F.when(is_copy, None).otherwise(F.col("burst_pick")))
    now = now.drop("copy_of", "_same", "_kept", "_n", "_stars", "_picked", "_rejected").withColumnRenamed("_copy_of", "copy_of")
    if "copy_of" in has:
        moved = named.where("_same is not null").join(best.select("_same", "_kept"), "_same").where(F.col("_kept") != F.col(item)).select(F.col(item).alias("copy_of"), F.col("_kept").alias("_to"))
        now = now.join(moved, "copy_of", "left").withColumn("copy_of", F.coalesce("_to", "copy_of")).drop("_to")
    return now.select(*rows.columns, *([] if "copy_of" in has else ["copy_of"]))


def restore_copies(frames: DataFrame, album: int) -> DataFrame:
    """``frames`` where the hidden copies of ``album`` are shown again (regroup it afterwards)."""
    return frames.withColumn("copy_of", F.when(F.col("job_id") == album, None).otherwise(F.col("copy_of")))


def suppress_overlaps(boxes: DataFrame, image: str, threshold: float) -> DataFrame:
    """Greedy non-maximum suppression: of ``boxes`` (image, cls, conf, x1, y1, x2, y2, id) those that no better kept one of their class overlaps."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "id"], ascending=[False, True], ignore_index=True)
        box = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        size = np.prod(np.maximum(box[:, 2:] - box[:, :2], 0), axis=1)
        kept: list[int] = []
        for k in range(len(box)):
            rest = [j for j in kept if pdf["cls"][j] == pdf["cls"][k]]
            side = np.maximum(np.minimum(box[rest, 2:], box[k, 2:]) - np.maximum(box[rest, :2], box[k, :2]), 0)
            both = np.prod(side, axis=1)
            if not len(rest) or (both <= threshold * (size[rest] + size[k] - both)).all():
                kept.append(k)
        return pdf.iloc[kept]

    return boxes.groupBy(image).applyInPandas(scan, boxes.schema)


def survivors(rows: DataFrame, key: list[str], order: list[Column], flags: list[str], lists: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``, with ``flags`` or-ed and ``lists`` joined over all its copies."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *flags, *lists)
    more = rows.groupBy(*key).agg(*[F.bool_or(f).alias(f) for f in flags], *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])
    return first.join(more, key)


def similarity_to_mean(rows: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    """group, item, similarity: the cosine of each vector to the mean of its group (means by position, not by list)."""
    long = rows.select(group, item, F.posexplode(vector).alias("at", "v"))
    mean = long.groupBy(group, "at").agg(F.avg("v").alias("m")).groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda x: x["m"]).alias("_mean"))
    joined = rows.join(mean, group)
    norm = F.sqrt(dot(F.col("_mean"), F.col("_mean"))) * F.sqrt(dot(F.col(vector), F.col(vector)))
    return joined.select(group, item, F.try_divide(dot(F.col(vector), F.col("_mean")), norm).alias("similarity"))
