"""Composition of a frame from boxes: cuts, size, lead room, grids, balance; and who rides or plays the ball."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Margins and sizes (shares of the frame), grid points and how far from them scores 0, room ahead, balance and tilt.
EDGE, SMALL, TIGHT, WHOLE, CENTRED = 0.02, 0.02, 0.60, 0.98, 0.05
THIRDS, PHI, THIRDS_FAR, PHI_FAR = (1 / 3, 2 / 3), (0.382, 0.618), 1 / 3, 0.382
LEAD, LEAD_NEUTRAL, LOPSIDED, TILT_GOOD, TILT_BAD = 0.34, 0.10, 0.25, 1.0, 3.0
#: Reach of a ball in person-heights; a rider's contact, feet, share and reach; classes of the detector.
BALL_REACH = 1.5
CONTACT, FEET, RIDER_SHARE, RIDER_REACH = 0.05, 0.80, 0.20, 0.50
PERSON_CLASS, BALL_CLASS, ANIMAL_CLASSES = 0, 32, tuple(range(14, 24))


@dataclass(frozen=True)
class Policy:
    """Weights of the terms of a framing score; ``lead`` 0: the room ahead does not count."""

    cut: float = 0.30
    size: float = 0.20
    mode: float = 0.10
    occlusion: float = 0.10
    balance: float = 0.05
    lead: float = 0.25
    tilt: float = 0.05


SPORT = Policy()
PORTRAIT = Policy(cut=0.35, size=0.25, mode=0.20, balance=0.10, lead=0.0)


def unit(x: Column) -> Column:
    """Within 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def size_of(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def shared(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def covered(a: Column, b: Column) -> Column:
    """The share of box ``a`` that ``b`` covers; 0 of nothing."""
    return F.coalesce(F.try_divide(shared(a, b), size_of(a)), F.lit(0.0))


def box_gap(a: Column, b: Column) -> Column:
    """The distance of two boxes' edges, 0 where they touch."""
    dx = F.greatest(F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]), F.lit(0.0))
    dy = F.greatest(F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def within(box: Column, w: Column, h: Column) -> Column:
    """The box with its corners in order, cut to the frame."""
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
    x = F.least(box["x1"], box["x2"]), F.greatest(box["x1"], box["x2"])
    y = F.least(box["y1"], box["y2"]), F.greatest(box["y1"], box["y2"])
    return F.struct(cut(x[0], w).alias("x1"), cut(y[0], h).alias("y1"), cut(x[1], w).alias("x2"), cut(y[1], h).alias("y2"))


Names = dict[str, Column]
Step = Callable[[Names], Names]
#: Bytes of code of a method that the JVM still compiles.
COMPILED = 8000
#: What is given of a frame and a subject (x1 to y2), and what is measured.
GIVEN = ("w", "h", "x1", "y1", "x2", "y2", "dx", "dy", "signed", "others")
MEASURED = ("cut_sides", "frac", "band", "lead", "thirds", "phi", "centred", "balance", "occlusion")


def _placed(s: Names) -> Names:
    """The box with its corners in order and cut to the frame, and how many edges it touches."""
    left, top = F.least(s["x1"], s["x2"]), F.least(s["y1"], s["y2"])
    right, bottom = F.greatest(s["x1"], s["x2"]), F.greatest(s["y1"], s["y2"])
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
    cuts = (left <= EDGE * s["w"]).cast("int") + (top <= EDGE * s["h"]).cast("int") + (right >= (1 - EDGE) * s["w"]).cast("int") + (bottom >= (1 - EDGE) * s["h"]).cast("int")
    return {"bx1": cut(left, s["w"]), "by1": cut(top, s["h"]), "bx2": cut(right, s["w"]), "by2": cut(bottom, s["h"]), "cuts": cuts, "norm": F.sqrt(s["dx"] * s["dx"] + s["dy"] * s["dy"])}


def _centred(s: Names) -> Names:
    """The box's share of the frame, its middle, and the direction it moves in (null: none)."""
    area = F.greatest(s["bx2"] - s["bx1"], F.lit(0.0)) * F.greatest(s["by2"] - s["by1"], F.lit(0.0))
    moves = s["norm"] > 0
    return {"share": F.try_divide(area, s["w"] * s["h"]), "nx": F.try_divide((s["bx1"] + s["bx2"]) / 2, s["w"]), "ny": F.try_divide((s["by1"] + s["by2"]) / 2, s["h"]), "ux": F.when(moves, s["dx"] / s["norm"]), "uy": F.when(moves, s["dy"] / s["norm"])}


def _aligned(s: Names) -> Names:
    """How far the middle is from the grids and from the frame's own; where frame and box begin and end along the motion; what the boxes weigh to one side."""
    off = lambda px, py: F.sqrt((s["nx"] - px) * (s["nx"] - px) + (s["ny"] - py) * (s["ny"] - py))
    grid = lambda points: F.least(*[off(px, py) for px in points for py in points]) / 2**0.5
    along, across = s["ux"] * s["w"], s["uy"] * s["h"]
    near, far = s["ux"] * s["bx1"] + s["uy"] * s["by1"], s["ux"] * s["bx2"] + s["uy"] * s["by2"]
    corners = (F.lit(0.0), along, across, along + across)
    b = F.struct(s["bx1"].alias("x1"), s["by1"].alias("y1"), s["bx2"].alias("x2"), s["by2"].alias("y2"))
    mass = lambda o: F.struct(size_of(within(o, s["w"], s["h"])).alias("a"), (F.try_divide(within(o, s["w"], s["h"])["x1"] + within(o, s["w"], s["h"])["x2"], s["w"]) - 1).alias("m"))
    own = F.struct((s["share"] * s["w"] * s["h"] * (s["nx"] - 0.5) * 2).alias("m"), (s["share"] * s["w"] * s["h"]).alias("a"))
    alone = F.when(own["a"] > 0, own["m"] / own["a"])
    every = F.aggregate(F.transform(s["others"], mass), own, lambda t, x: F.struct((t["m"] + x["a"] * x["m"]).alias("m"), (t["a"] + x["a"]).alias("a")), lambda t: F.try_divide(t["m"], t["a"]))
    some = F.size(s["others"]) > 0
    return {
        "thirds": grid(THIRDS), "phi": grid(PHI), "middle": off(0.5, 0.5) / 2**0.5, "lo": F.least(*corners), "hi": F.greatest(*corners), "nearest": F.least(near, far), "farthest": F.greatest(near, far),
        "lean": F.when(some, every).otherwise(alone), "hidden": F.when(some, F.array_max(F.transform(s["others"], lambda o: covered(b, o)))),
    }


def _seen(s: Names) -> Names:
    """MEASURED, but for what is so already."""
    extent = s["hi"] - s["lo"]
    room = ((s["hi"] - s["farthest"]) - (s["nearest"] - s["lo"])) / extent
    ahead = F.when(s["ux"].isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(extent > 1e-9, room).otherwise(0.0))))
    frac = unit(s["share"])
    return {
        "frac": frac, "cut_sides": F.when(frac >= WHOLE, 0).otherwise(s["cuts"]), "band": F.when(frac < SMALL, "small").when(frac > TIGHT, "tight").otherwise("good"), "lead": F.when(s["signed"], ahead).otherwise(F.abs(ahead)),
        "centred": s["middle"] <= CENTRED, "balance": F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["lean"])), F.lit(0.0)), "occlusion": F.coalesce(unit(s["hidden"]), F.lit(0.0)),
    }


def _terms(policy: Policy) -> Step:
    def terms(s: Names) -> Names:
        size = F.when(s["band"] == "good", 1.0).when(s["band"] == "small", 1 - unit((SMALL - s["frac"]) / SMALL)).otherwise(1 - 0.5 * unit((s["frac"] - TIGHT) / (1 - TIGHT)))
        mode = F.when(s["centred"], 1.0).otherwise(F.greatest(1 - s["thirds"] / THIRDS_FAR, 1 - s["phi"] / PHI_FAR))
        lopsided = F.when(~s["centred"], 1 - F.greatest(F.abs(s["balance"]) - LOPSIDED, F.lit(0.0)) / (1 - LOPSIDED))
        lead = F.when(F.abs(s["lead"]) >= LEAD_NEUTRAL, 1 - F.abs(s["lead"] - LEAD) / (1 - LEAD))
        level = 1 - (F.abs(s["tilt"]) - TILT_GOOD) / (TILT_BAD - TILT_GOOD)
        return {"t_cut": 1 - s["cut_sides"] / 4, "t_size": size, "t_mode": mode, "t_occlusion": 1 - s["occlusion"], "t_balance": lopsided, "t_lead": lead, "t_tilt": level}

    return terms


def _score(policy: Policy) -> Step:
    def score(s: Names) -> Names:
        used = [(s[f"t_{name}"], w) for name, w in vars(policy).items() if w > 0]
        total = sum((F.coalesce(unit(t) * w, F.lit(0.0)) for t, w in used), F.lit(0.0))
        weight = sum((F.when(t.isNotNull(), w).otherwise(0.0) for t, w in used), F.lit(0.0))
        return {"score": F.coalesce(unit(F.try_divide(total, weight)), F.lit(0.5))}

    return score


_MEASURE = (_placed, _centred, _aligned, _seen)


def _bound(given: Names, steps: tuple[Step, ...], wanted: tuple[str, ...]) -> Column:
    """``wanted`` of the steps' names as a struct. What a step makes is bound for the next: a name that is used twice would be written out twice in the plan, and what is made of it four times."""
    def grown(step: Step, names: list[str], made: list[str]) -> Callable[[Column], Column]:
        def grow(v: Column) -> Column:
            new = step({k: v[k] for k in names})
            made[:] = new
            return F.struct(*[v[k].alias(k) for k in names if k not in new], *[c.alias(k) for k, c in new.items()])

        return grow

    value, names = F.struct(*[c.alias(k) for k, c in given.items()]), list(given)
    for step in steps:
        made: list[str] = []
        value = F.get(F.transform(F.array(value), grown(step, names, made)), F.lit(0))
        names = [*[k for k in names if k not in made], *made]
    return F.get(F.transform(F.array(value), lambda v: F.struct(*[v[k].alias(k) for k in wanted])), F.lit(0))


def measured(w: Column, h: Column, box: Column, others: Column, dx: Column, dy: Column, signed: Column) -> Column:
    """struct of what is seen of the framing: cut_sides, frac, band, lead, thirds, phi, centred, balance, occlusion.

    ``others``: boxes of the other subjects. ``dx`` and ``dy``: where the subject moves to (null or 0: unknown); an unsigned motion has no
    front, so its lead room is a distance. Null if the frame has no size. For many rows ``framed`` does the same in generated code.
    """
    given = dict(zip(GIVEN, (w, h, box["x1"], box["y1"], box["x2"], box["y2"], dx, dy, signed, others), strict=True))
    return F.when((w > 0) & (h > 0), _bound(given, _MEASURE, MEASURED))


def framing_score(m: Column, tilt: Column, policy: Policy = SPORT) -> Column:
    """0 to 1, of what was ``measured``: the weighted mean of the terms that could be, 0.5 if none."""
    given = {k: m[k] for k in MEASURED} | {"tilt": tilt}
    return _bound(given, (_terms(policy), _score(policy)), ("score",))["score"]


def framed(rows: DataFrame, given: Names, tilt: Column, policy: Policy = SPORT) -> DataFrame:
    """``rows`` with MEASURED and score, from ``given`` (GIVEN): each step is a projection of plain columns, which Spark keeps apart. A frame without size has nulls, and a score of 0.5.

    The steps fused into one method would be longer than what the JVM compiles, and run five times as long: the session is told to fuse no such method.
    """
    conf = rows.sparkSession.conf
    if int(conf.get("spark.sql.codegen.hugeMethodLimit")) > COMPILED:
        conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
    names: Names = {}
    out = rows
    sized = (given["w"] > 0) & (given["h"] > 0)
    for k, step in enumerate([lambda s: given | {"tilt": tilt, "sized": sized}, *_MEASURE, _terms(policy), _score(policy)]):
        made = step(names)
        out = out.withColumns({f"_{k}_{name}": c for name, c in made.items()})
        names = names | {name: F.col(f"_{k}_{name}") for name in made}
    known = {name: F.when(names["sized"], names[name]) for name in MEASURED} | {"score": F.when(names["sized"], names["score"]).otherwise(0.5)}
    return out.select(*[F.col(c) for c in rows.columns if c not in known], *[c.alias(name) for name, c in known.items()])


def _sides(boxes: DataFrame, image: str, a: Column, b: Column) -> DataFrame:
    """Pairs (p, q) of boxes of one frame (image, id, cls, box) of the kinds ``a`` and ``b``: few of either are in a frame."""
    row = F.struct("id", "box")
    return boxes.where(a).select(image, row.alias("p")).join(boxes.where(b).select(image, row.alias("q")), image)


def ball_contexts(boxes: DataFrame, image: str) -> DataFrame:
    """image, person, distance, in_play: the person nearest a ball, in heights (or widths, if wider) of that person; of equals the least ids."""
    tall = F.greatest(F.col("p.box.y2") - F.col("p.box.y1"), F.col("p.box.x2") - F.col("p.box.x1"))
    met = _sides(boxes, image, F.col("cls") == PERSON_CLASS, F.col("cls") == BALL_CLASS).where(tall > 0)
    near = met.select(image, (box_gap(F.col("p.box"), F.col("q.box")) / tall).alias("distance"), F.col("p.id").alias("person"), F.col("q.id").alias("ball"))
    best = near.groupBy(image).agg(F.min(F.struct("distance", "person", "ball")).alias("m"))
    return best.select(image, F.col("m.person").alias("person"), F.col("m.distance").alias("distance"), (F.col("m.distance") <= BALL_REACH).alias("in_play"))


def riders(boxes: DataFrame, image: str) -> DataFrame:
    """image, person, animal, overlap, above, aspect, offset, buck, box: the best person on an animal in each frame that has one.

    The lower half of the person lies on the upper half of the animal, with the feet off the ground, large enough, and over the
    spine. A centre above the animal's comes first, then more contact, then the least ids. ``buck``: how much it looks like the peak of the ride.
    """
    p, q = F.col("p.box"), F.col("q.box")
    pw, ph, aw, ah = p["x2"] - p["x1"], p["y2"] - p["y1"], q["x2"] - q["x1"], q["y2"] - q["y1"]
    legs = F.struct(p["x1"].alias("x1"), (p["y1"] + ph / 2).alias("y1"), p["x2"].alias("x2"), p["y2"].alias("y2"))
    back = F.struct(q["x1"].alias("x1"), q["y1"].alias("y1"), q["x2"].alias("x2"), (q["y1"] + ah / 2).alias("y2"))
    mid = lambda b: ((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
    (px, py), (ax, ay) = mid(p), mid(q)
    met = _sides(boxes, image, F.col("cls") == PERSON_CLASS, F.col("cls").isin(*ANIMAL_CLASSES)).where((pw > 0) & (ph > 0) & (aw > 0) & (ah > 0))
    shaped = met.select(image, "p", "q", (shared(legs, back) / F.greatest(size_of(legs), F.lit(1e-9))).alias("overlap"), (py < ay).alias("above"), (ah / aw).alias("aspect"), ((px - ax) / aw).alias("offset"), ((p["y2"] - q["y1"]) / ah).alias("feet"), (ph / ah).alias("share"), ((py - q["y1"]) / ah).alias("seat"))
    good = shaped.where(f"overlap >= {CONTACT} and feet <= {FEET} and share >= {RIDER_SHARE} and abs(offset) <= {RIDER_REACH}")
    score = 0.40 * unit((F.col("aspect") - 0.60) / 0.45) + 0.30 * unit((0.45 - F.col("seat")) / 0.30) + 0.20 * unit((F.abs("offset") - 0.05) / 0.30) + 0.10 * unit(F.col("overlap"))
    joined = F.struct(F.least("p.box.x1", "q.box.x1").alias("x1"), F.least("p.box.y1", "q.box.y1").alias("y1"), F.greatest("p.box.x2", "q.box.x2").alias("x2"), F.greatest("p.box.y2", "q.box.y2").alias("y2"))
    rows = good.withColumns({"buck": F.when(F.col("above"), score).otherwise(score * 0.5), "box": joined})
    best = rows.groupBy(image).agg(F.max_by(F.struct(F.col("p.id").alias("person"), F.col("q.id").alias("animal"), "overlap", "above", "aspect", "offset", "buck", "box"), F.struct(F.col("above").cast("int"), "overlap", -F.col("p.id"), -F.col("q.id"))).alias("m"))
    return best.select(image, "m.*")


def decisive_subjects(boxes: DataFrame, image: str) -> DataFrame:
    """image, kind, box: the rider with the animal, else the largest animal, else the largest person (of equals the last)."""
    ridden = riders(boxes, image).select(image, F.lit("rider").alias("kind"), "box")
    kind = F.when(F.col("cls").isin(*ANIMAL_CLASSES), "animal").when(F.col("cls") == PERSON_CLASS, "person")
    alone = boxes.withColumn("kind", kind).where(F.col("kind").isNotNull() & (size_of(F.col("box")) > 0))
    largest = alone.groupBy(image).agg(F.max_by(F.struct("kind", "box"), F.struct((F.col("kind") == "animal").cast("int"), size_of(F.col("box")), F.col("id"))).alias("m")).select(image, "m.*")
    return ridden.unionByName(largest.join(ridden.select(image), image, "left_anti"))
