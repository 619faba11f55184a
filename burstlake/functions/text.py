"""Column functions on names, plates, numbers and paths (Catalyst expressions only, no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are read for each other on plates.
CONFUSABLE = ("047", "8B", "0OQD", "1IL", "5S", "2Z", "6G", "VY", "MN", "CG", "UV")
#: Colour labels.
COLOURS = ("red", "yellow", "green", "blue", "purple")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def tidy_plate(c: Column) -> Column:
    """Upper case, letters and digits of any script; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(c), r"[^\p{IsAlphabetic}\p{N}]", ""), F.lit(""))


def ascii_plate(c: Column) -> Column:
    """Upper case, A-Z and 0-9 only; may be empty."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def near_plate(a: Column, b: Column) -> Column:
    """Same length and exactly one differing character, whose two readings are confusable."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    differing = F.filter(pairs, lambda p: p["x"] != p["y"])
    first = F.get(differing, F.lit(0))
    alike = None
    for group in CONFUSABLE:
        both = F.lit(group).contains(first["x"]) & F.lit(group).contains(first["y"])
        alike = both if alike is None else alike | both
    return F.coalesce((F.length(a) == F.length(b)) & F.when(F.size(differing) == 1, alike).otherwise(False), F.lit(False))


def plate_verdict(a: Column, seen: Column) -> Column:
    """True if ``a`` is among ``seen``; null (no opinion) if either is missing or a near miss; else false."""
    return F.when(a.isNull() | (F.size(seen) == 0), F.lit(None).cast("boolean")).when(F.array_contains(seen, a), True).when(F.exists(seen, lambda s: near_plate(a, s)), None).otherwise(False)


def bounded_levenshtein(a: Column, b: Column, limit: int) -> Column:
    """The distance, or ``limit`` + 1 if it is more."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def plain_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]", "")


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def same_make(a: Column, b: Column) -> Column:
    """A missing or blank name is no mismatch."""
    x, y = plain_key(F.coalesce(a, F.lit(""))), plain_key(F.coalesce(b, F.lit("")))
    return (x == "") | (y == "") | (x == y)


def split_list(c: Column, separator: str = ",") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def slug(c: Column, longest: int = 60) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, none at the ends."""
    dashed = F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(longest)), "-+$", "")


def colour_label(c: Column) -> Column:
    """The first word that names a colour label."""
    return F.get(F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda w: w.isin(*COLOURS)), F.lit(0))


def word_or(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*allowed), word).otherwise(F.lit(default))


def corroborated(claim: Column, evidence: Column, generic: tuple[str, ...] = ()) -> Column:
    """Some distinctive word of ``claim`` (4 letters at least, not generic) is in some line of ``evidence``."""
    words = F.filter(F.split(F.lower(F.coalesce(claim, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*(generic or ("",))))
    lines = F.lower(F.array_join(evidence, "\n"))
    return F.coalesce(F.exists(words, lambda w: lines.contains(w)), F.lit(False))


def merge_number(ocr: Column, confidence: Column, other: Column, other_confidence: Column, accept: float) -> Column:
    """struct(number, source, confidence) of a scanned and a model's reading.

    Agreement lifts the better confidence (0.7 at least) by 0.2; else a sure scan wins, then the model, then a weak scan.
    """
    scan, model = F.nullif(ocr, F.lit("")), F.nullif(other, F.lit(""))
    sure = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(other_confidence, F.lit(0.0)))), F.lit(0.0))
    agreed = F.least(F.greatest(confidence, sure, F.lit(0.7)) + 0.2, F.lit(1.0))
    pick = lambda n, s, c: F.struct(n.alias("number"), F.lit(s).alias("source"), c.alias("confidence"))
    none = pick(F.lit(None).cast("string"), None, F.lit(0.0))
    return F.when(scan == model, pick(scan, "ocr+vlm", agreed)).when(scan.isNotNull() & (confidence >= accept), pick(scan, "ocr", confidence)).when(model.isNotNull(), pick(model, "vlm", sure)).when(scan.isNotNull(), pick(scan, "ocr", confidence)).otherwise(none)


def path_key(c: Column) -> Column:
    """Case-folded, one kind of separator, no repeats, no trailing one on paths longer than a drive's root."""
    p = F.regexp_replace(F.translate(F.lower(c), "/", "\\"), r"\\+", r"\\")
    return F.when(F.length(p) > 3, F.regexp_replace(p, r"\\$", "")).otherwise(p)


def normalised_path(c: Column) -> Column:
    """As path_key, blanks trimmed, but a leading network prefix keeps its two separators."""
    raw = F.translate(F.lower(F.trim(c)), "/", "\\")
    return F.concat(F.when(raw.startswith("\\\\"), F.lit("\\")).otherwise(F.lit("")), F.regexp_replace(raw, r"\\+", r"\\"))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)


def file_stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"\.[^.]*$", "")


def sidecar(c: Column) -> Column:
    return F.concat(F.regexp_replace(c, r"\.[^./\\]*$", ""), F.lit(".xmp"))


def natural_key(c: Column, width: int = 20) -> Column:
    """Runs of digits padded, so that names sort by number."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")
