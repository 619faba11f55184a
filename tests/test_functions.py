"""Scalar functions on rows whose results are known."""

import pytest
from pyspark.sql import functions as F

from burstlake import schemas
from burstlake.functions import numeric as N
from burstlake.functions import text as X
from burstlake.functions import times as D


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: X.tidy_plate(F.lit("ab-1é 2")), "AB1É2"),
        (lambda: X.tidy_plate(F.lit("- ")), None),
        (lambda: X.ascii_plate(F.lit("ab-1é 2")), "AB12"),
        (lambda: X.near_plate(F.lit("AB0"), F.lit("ABO")), True),
        (lambda: X.near_plate(F.lit("AB0"), F.lit("ABX")), False),
        (lambda: X.near_plate(F.lit("A80"), F.lit("ABO")), False),
        (lambda: X.near_plate(F.lit("AB"), F.lit("ABO")), False),
        (lambda: X.plate_verdict(F.lit("AB0"), F.array(F.lit("AB0"))), True),
        (lambda: X.plate_verdict(F.lit("AB0"), F.array(F.lit("ABO"))), None),
        (lambda: X.plate_verdict(F.lit("XYZ"), F.array(F.lit("ABO"))), False),
        (lambda: X.bounded_levenshtein(F.lit("kitten"), F.lit("sitting"), 2), 3),
        (lambda: X.bounded_levenshtein(F.lit("kitten"), F.lit("sitting"), 3), 3),
        (lambda: X.casefold(F.lit("Straße")), "strasse"),
        (lambda: X.slug(F.lit("  Été & Co. / 2024 ")), "été-co-2024"),
        (lambda: X.colour_label(F.lit("a RED one")), "red"),
        (lambda: X.path_key(F.lit("C://Dir//File/")), "c:\\dir\\file"),
        (lambda: X.path_key(F.lit("//host/a")), "\\host\\a"),
        (lambda: X.normalised_path(F.lit(" //host//a ")), "\\\\host\\a"),
        (lambda: X.sidecar(F.lit("/a.b/c.cr3")), "/a.b/c.xmp"),
        (lambda: X.file_stem(F.lit("C:\\x\\IMG_1.CR3")), "IMG_1"),
        (lambda: X.corroborated(F.lit("Red Racing Team"), F.array(F.lit("the RACING line"))), True),
        (lambda: X.corroborated(F.lit("Red Team"), F.array(F.lit("the team line")), ("team",)), False),
        (lambda: D.parse_stamp(F.lit("2024:02:31 10:00:00+02:00")), 1709373600.0),
        (lambda: D.parse_stamp(F.lit("0000:00:00 00:00:00")), None),
        (lambda: D.parse_stamp(F.lit("2024:13:01 10:00:00")), None),
        (lambda: D.with_subseconds(F.lit(5.0), F.lit("25")), 5.25),
        (lambda: D.with_subseconds(F.lit(5.0), F.lit("x")), 5.0),
        (lambda: D.from_foreign_epoch(F.lit("0")), 978307200.0),
        (lambda: N.hamming(F.lit(5), F.lit(6)), 2),
        (lambda: N.hamming(F.lit(None).cast("long"), F.lit(6)), 999),
        (lambda: N.strict_greatest(F.lit(1), F.lit(None).cast("int")), None),
        (lambda: N.exact(F.lit(float("nan"))), float("-inf")),
        (lambda: N.exact(F.lit(float("inf"))), float("-inf")),
        (lambda: N.bucket(F.lit(None).cast("double"), F.lit(0.1)), 0),
        (lambda: N.verdict(F.lit(0.7)), "soft"),
        (lambda: N.stars(F.lit(0.958)), 5),
        (lambda: N.stars(F.lit(0.1)), 1),
        (lambda: N.interpolate(F.lit(1.5), [(0, 0), (1, 1), (2, 3)]), 2.0),
        (lambda: N.interpolate(F.lit(9.0), [(0, 0), (1, 1)]), 1.0),
        (lambda: N.embedding_of(F.lit("1, 2.5,x")), None),
        (lambda: N.embedding_of(F.lit("1, 2.5")), [1.0, 2.5]),
        (lambda: N.bytes_of_hex(F.lit("00ff")), [0, 255]),
        (lambda: N.lenient_json(F.lit("{bad"), "$.k", "int"), None),
        (lambda: N.histogram_distance(F.array(F.lit(255), F.lit(0)), F.array(F.lit(0), F.lit(255))), 1.0),
    ],
)
def test_known_values(spark, column, want):
    assert one(spark, column()) == (pytest.approx(want) if isinstance(want, float) else want)


def test_merge_number(spark):
    merge = lambda a, c, b, d: tuple(one(spark, X.merge_number(F.lit(a), F.lit(c), F.lit(b), F.lit(d), 0.6)))
    assert merge("12", 0.5, "12", 0.9) == ("12", "ocr+vlm", 1.0)
    assert merge("12", 0.7, "13", 0.9) == ("12", "ocr", 0.7)
    assert merge("12", 0.5, "13", 0.9) == ("13", "vlm", 0.9)
    assert merge("12", 0.5, "", 0.9) == ("12", "ocr", 0.5)
    assert merge("", 0.5, None, float("nan")) == (None, None, 0.0)


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    row = spark.range(1).select(box(0, 0, 2, 2).alias("a"), box(1, 1, 3, 3).alias("b"))
    got = row.select(N.iou("a", "b").alias("iou"), N.centre_inside("a", "b").alias("inside"), N.clipping("a", F.lit(2.0), F.lit(9.0)).alias("clip"), N.continuity("a", "b").alias("c")).first()
    assert got["iou"] == pytest.approx(1 / 7) and got["inside"]
    assert got["clip"]["sides"] == 3 and got["clip"]["factor"] == pytest.approx(0.55)
    assert got["c"]["scale"] == 1.0 and got["c"]["shift"] == pytest.approx(1.0)


def test_needs_review(spark):
    ask = lambda *v: one(spark, schemas.needs_review(*[F.lit(x).cast("double") for x in v]))
    assert not ask(0.1, 1, 0, 0, None)
    assert ask(0.9, 0, 1, 1, None) and not ask(0.1, 0, 1, 0, None)
    assert ask(0.7, 0, 0, 0, 0) and not ask(None, 0, 0, 0, None) and not ask(0.7, 0, 0, 0, 0.6)


def test_softmax_and_natural_order(spark):
    assert one(spark, N.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    names = spark.createDataFrame([("img10",), ("img9",), ("img1b",)], "n string").orderBy(X.natural_key(F.col("n")))
    assert [r["n"] for r in names.collect()] == ["img1b", "img9", "img10"]
