"""Deterministic voting in groups: ties go to what was seen first, never to chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, casefold, plain_key
from .lineage import at_place

#: Share that settles a pair of fields, a make alone, and a reading.
PAIR_SHARE, MAKE_SHARE, SETTLE_SHARE = 0.5, 0.6, 0.7


def ranked_values(rows: DataFrame, group: str, value: Column, seq: str) -> DataFrame:
    """group, folded, value (as first written), n, first_seq, place: values of each group, commonest first, then first seen."""
    said = rows.select(group, seq, blank_to_null(value).alias("value")).where("value is not null").withColumn("folded", casefold(F.col("value")))
    counted = said.groupBy(group, "folded").agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"), F.min_by("value", seq).alias("value"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first_seq")))


def vote(rows: DataFrame, group: str, value: Column, seq: str) -> DataFrame:
    """group, winner, votes, share: the majority of what was said (blanks say nothing)."""
    ranked = ranked_values(rows, group, value, seq)
    total = F.sum("n").over(Window.partitionBy(group))
    return ranked.withColumn("total", total).where("place = 1").select(group, F.col("value").alias("winner"), F.col("n").alias("votes"), (F.col("n") / F.col("total")).alias("share"))


def mode(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value, of equals the least."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    pick = F.max_by(value, F.struct("n", (-F.col("_rank")).alias("r")))
    ranked = counted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "n").orderBy(value)))
    return ranked.groupBy(*group).agg(pick.alias("mode"), F.max("n").alias("n"))


def pair_vote(rows: DataFrame, group: str, make: str, model: str, seq: str) -> DataFrame:
    """group, make, model, agreement, disputed: the pair most said if it holds half, else the make alone if it holds 0.6, else neither.

    Rows that say neither do not count. disputed: all pairs that were said, sorted, where no pair holds half (else empty).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    named = rows.select(group, seq, blank(make).alias("_make"), blank(model).alias("_model")).where("_make <> '' or _model <> ''")
    pairs = ranked_values(named, group, F.concat("_make", F.lit("\x1f"), "_model"), seq)
    w = Window.partitionBy(group)
    best = pairs.withColumns({"total": F.sum("n").over(w), "said": F.array_sort(F.collect_set(F.trim(F.replace("value", F.lit("\x1f"), F.lit(" ")))).over(w))}).where("place = 1")
    makes = ranked_values(named, group, F.col("_make"), seq).where("place = 1").select(group, F.col("value").alias("make_alone"), F.col("n").alias("make_n"))
    whole, parts = F.col("n") / F.col("total") >= PAIR_SHARE, F.split("value", "\x1f")
    alone = ~whole & (F.col("make_n") / F.col("total") >= MAKE_SHARE)
    return best.join(makes, group, "left").select(
        group, F.when(whole, F.nullif(parts[0], F.lit(""))).when(alone, F.col("make_alone")).alias("make"), F.when(whole, F.nullif(parts[1], F.lit(""))).alias("model"),
        F.when(alone, F.col("make_n") / F.col("total")).otherwise(F.col("n") / F.col("total")).alias("agreement"), F.when(whole, F.array().cast("array<string>")).otherwise(F.col("said")).alias("disputed"),
    )


def best_by_confidence(rows: DataFrame, group: str, value: str, confidence: str, seq: str) -> DataFrame:
    """group, value of the greatest confidence over 0; of equals the first."""
    sure = rows.where((F.col(confidence) > 0) & F.col(value).isNotNull())
    return sure.groupBy(group).agg(F.max_by(value, F.struct(F.col(confidence), -F.col(seq))).alias(value), F.max(confidence).alias(confidence))


def median_colour(rows: DataFrame, group: str, colour: str) -> DataFrame:
    """group, colour: the channels' upper medians (element floor(n / 2), no interpolation) of ``#rrggbb``. A value that breaks off still counts for the channels before."""
    channel = lambda k: F.when(F.col(colour).rlike("^#([0-9A-Fa-f]{2}){" + str(k + 1) + "}"), F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int"))
    said = rows.select(group, F.posexplode(F.array(*[channel(k) for k in range(3)])).alias("k", "c"))
    middle = at_place(said, [group, "k"], "c", lambda n: F.floor(n / 2)).groupBy(group).agg(*[F.max(F.when(F.col("k") == k, F.col("c"))).alias(f"c{k}") for k in range(3)])
    return middle.select(group, F.when(F.expr("c0 is not null and c1 is not null and c2 is not null"), F.format_string("#%02x%02x%02x", "c0", "c1", "c2")).alias(colour))


def plurality(rows: DataFrame, group: str, value: Column, seq: str) -> DataFrame:
    """group, winner: the most said; none if two are said as often."""
    ranked = ranked_values(rows, group, value, seq)
    return ranked.groupBy(group).agg(F.max_by("value", F.struct("n", -F.col("first_seq"))).alias("value"), F.max("n").alias("n"), F.collect_list("n").alias("all")).select(group, F.when(F.size(F.filter("all", lambda x: x == F.col("n"))) == 1, F.col("value")).alias("winner"))


def facets(rows: DataFrame, key: Column, label: Column, owner: str, seq: str) -> DataFrame:
    """facet, n, label, owners: counts of each value, its first label that is not blank, and ``A +n`` for its owners."""
    said = rows.select(key.alias("facet"), blank_to_null(label).alias("label"), owner, seq).where("facet is not null")
    summed = said.groupBy("facet").agg(F.count("*").alias("n"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col(seq))).alias("label"), F.min_by(owner, seq).alias("first_owner"), F.count_distinct(owner).alias("k"))
    return summed.select("facet", "n", "label", F.when(F.col("k") > 1, F.concat(F.col("first_owner").cast("string"), F.lit(" +"), (F.col("k") - 1).cast("string"))).otherwise(F.col("first_owner").cast("string")).alias("owners"))
