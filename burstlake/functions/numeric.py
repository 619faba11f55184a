"""Column functions on vectors, boxes, hashes and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and star bands by score.
SHARP, BLURRED, BANDS = 0.825, 0.606, ((0.958, 5), (0.825, 4), (0.728, 3), (0.606, 2))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes; 999 if one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def dot(a: Column, b: Column) -> Column:
    """In doubles, over the components both have."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def histogram_distance(a: Column, b: Column, whole: float = 255.0) -> Column:
    """One less the shared share of two histograms, within 0 and 1; null if one is missing."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(shared.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - shared / whole)))  # least and greatest would skip a null


def area(b: str) -> Column:
    """Of a struct column x1, y1, x2, y2."""
    return F.greatest(F.col(f"{b}.x2") - F.col(f"{b}.x1"), F.lit(0.0)) * F.greatest(F.col(f"{b}.y2") - F.col(f"{b}.y1"), F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    w = F.least(f"{a}.x2", f"{b}.x2") - F.greatest(f"{a}.x1", f"{b}.x1")
    h = F.least(f"{a}.y2", f"{b}.y2") - F.greatest(f"{a}.y1", f"{b}.y1")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def centre_inside(a: str, b: str) -> Column:
    """The middle of box a lies in box b."""
    x, y = (F.col(f"{a}.x1") + F.col(f"{a}.x2")) / 2, (F.col(f"{a}.y1") + F.col(f"{a}.y2")) / 2
    return x.between(F.col(f"{b}.x1"), F.col(f"{b}.x2")) & y.between(F.col(f"{b}.y1"), F.col(f"{b}.y2"))


def continuity(a: str, b: str) -> Column:
    """struct(scale, shift) of two boxes in fractions of the frame: ratio of areas, and the centres' distance over the diagonal."""
    big, small = F.greatest(area(a), area(b)), F.least(area(a), area(b))
    dx = (F.col(f"{a}.x1") + F.col(f"{a}.x2") - F.col(f"{b}.x1") - F.col(f"{b}.x2")) / 2
    dy = (F.col(f"{a}.y1") + F.col(f"{a}.y2") - F.col(f"{b}.y1") - F.col(f"{b}.y2")) / 2
    return F.struct(F.try_divide(big, small).alias("scale"), (F.hypot(dx, dy) / F.sqrt(F.lit(2.0))).alias("shift"))


def clipping(b: str, width: Column, height: Column, margin: float = 0.0) -> Column:
    """struct(sides, factor): how many edges of the frame the box touches, and 1 - 0.6 * sides / 4."""
    sides = sum(((F.col(f"{b}.{s}") <= margin).cast("int") for s in ("x1", "y1")), F.lit(0)) + (F.col(f"{b}.x2") >= width - margin).cast("int") + (F.col(f"{b}.y2") >= height - margin).cast("int")
    return F.struct(sides.alias("sides"), (1 - F.lit(0.6) * sides / 4).alias("factor"))


def clipping_text(sides: Column) -> Column:
    """What to say of a box that touches the frame's edges; nothing if it does not."""
    return F.when(sides == 0, "").when(sides == 1, "touches the frame edge").otherwise(F.concat(F.lit("cut off on "), sides.cast("string"), F.lit(" edges")))


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through ``knots`` (rising), constant beyond them."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(knots[-1][1]))))


def log_normal(x: Column, low: float, high: float) -> Column:
    """ln(x) between ln(low) and ln(high) as 0 to 1."""
    share = (F.ln(x) - F.ln(F.lit(low))) / (F.ln(F.lit(high)) - F.ln(F.lit(low)))
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def verdict(score: Column) -> Column:
    return F.when(score >= SHARP, "sharp").when(score < BLURRED, "blurred").when(score.isNotNull(), "soft")


def stars(score: Column) -> Column:
    return F.when(score.isNotNull(), reduce(lambda c, b: c.when(score >= b[0], b[1]), BANDS[1:], F.when(score >= BANDS[0][0], BANDS[0][1])).otherwise(1))


def bucket(v: Column, width: Column) -> Column:
    """floor(v / width); 0 if v is missing or not finite."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.floor(v / width)).otherwise(0).cast("long")


def exact(v: Column) -> Column:
    """v, but minus infinity if it is missing or not finite: Spark would sort NaN above all."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, v).otherwise(F.lit(float("-inf")))


def strict_greatest(a: Column, b: Column) -> Column:
    """The greater, null if either is null (Spark's own skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def brightness(seconds: Column, bias: Column) -> Column:
    """Exposure in stops: bias + log2(time)."""
    return F.coalesce(bias, F.lit(0.0)) + F.log2(seconds)


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Of an array, the greatest value taken off first."""
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp((v - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda v: v / total)


def embedding_of(text: Column) -> Column:
    """A vector from its text; null if any part is no number."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when(~F.exists(parts, lambda p: p.isNull()), parts)


def embedding_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda v: F.format_string("%.5f", v.cast("double"))), ",")


def bytes_of_hex(text: Column) -> Column:
    """The bytes of a hex text as numbers; null if it is none."""
    raw = F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), text)
    return F.transform(F.regexp_extract_all(raw, F.lit("[0-9A-Fa-f]{2}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def lenient_json(text: Column, path: str, kind: str) -> Column:
    """A value out of JSON text; null if the text is malformed."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)
