"""Settling who a group of detections is: readings, variants, registry agreement and seeding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, plain_key
from ..functions.vehicles import own_readings, remembered
from .clusters import SAME_LOOK, vehicles
from .mutations import upsert
from .votes import SETTLE_SHARE, best_by_confidence, median_colour, pair_vote, ranked_values, vote


#: Edits, least letters, and how many times commoner the kept spelling must be.
VARIANTS = ((1, 4, 3), (2, 5, 10))


def accumulate(rows: DataFrame, group: str, values: str, seq: str, rules: tuple[tuple[int, int, int], ...] = VARIANTS) -> DataFrame:
    """group, values: list values commonest first, as first written; a rare misspelling of a much commoner one counts for that.

    Which spelling folds into which depends on the order and on what was folded before, so the ranked spellings of one group
    (not its rows) are scanned. Of equal counts the one that was kept first comes first.
    """
    said = rows.select(group, seq, F.posexplode(values).alias("_at", "v")).withColumn("_order", F.struct(seq, "_at"))
    ranked = ranked_values(said, group, F.col("v"), "_order").select(group, "value", "folded", "n", "place")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for v, folded, n in pdf.sort_values("place")[["value", "folded", "n"]].itertuples(index=False):
            into = next((k for k in kept if _is_variant(folded, n, k[1], k[2], rules)), None)
            if into is None:
                kept.append([v, folded, n])
            else:
                into[2] += n
        return pd.DataFrame({group: [pdf[group].iloc[0]], values: [[k[0] for k in sorted(kept, key=lambda k: -k[2])]]})

    kind = rows.schema[group].dataType.simpleString()
    return ranked.groupBy(group).applyInPandas(fold, f"{group} {kind}, {values} array<string>")


def _is_variant(text: str, n: int, kept: str, kept_n: int, rules) -> bool:
    return any(min(len(text), len(kept)) >= least and n * times <= kept_n and _edits(text, kept, most) <= most for most, least, times in rules)


def _edits(a: str, b: str, most: int) -> int:
    """The edit distance, or ``most`` + 1 if the lengths alone differ by more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def consensus(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """A record for each group: members, make and model by pair vote (with agreement and what is disputed), colour, body type, team, driver and country by
    vote, the measured colour by median, plate and race_number by confidence, sponsors and livery_text accumulated.

    Only what ``rows`` have of these is settled; plate_conf and number_conf are the confidences.
    """
    has = set(rows.columns)
    out = rows.groupBy(group).agg(F.count("*").alias("members"))
    voted = lambda c: vote(rows, group, F.col(c), seq).select(group, F.col("winner").alias(c), F.col("share").alias(f"{c}_share"))
    parts = [pair_vote(rows, group, "make", "model", seq)]
    parts += [voted(c) if c == "colour" else voted(c).drop(f"{c}_share") for c in ("colour", "body_type", "team", "driver", "country") if c in has]
    parts += [median_colour(rows, group, "colour_hex")] if "colour_hex" in has else []
    parts += [best_by_confidence(rows, group, v, c, seq) for v, c in (("plate", "plate_conf"), ("race_number", "number_conf")) if {v, c} <= has]
    parts += [accumulate(rows, group, c, seq) for c in ("sponsors", "livery_text") if c in has]
    for part in parts:
        out = out.join(part, group, "left")
    return out


def consolidate(subjects: DataFrame, album: str, same: float = SAME_LOOK) -> DataFrame:
    """``subjects`` (album, burst, frame, det, cls, embedding, plate, make, model, ...) sorted into vehicles, with what each vehicle agrees on.

    Adds group_key (dense within the album by first det), group_size, group_agreement (3 places), group_colour_hex, own_make, own_model and own_colour (what the
    frame's own reader said, which is what is voted on), and fills: make, model and colour from the group if it agrees, else as the frame said; blank
    plate, race_number, team, driver and country; sponsors and livery_text. Rows without embedding stay as they are, with null keys.
    """
    has = set(subjects.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    own = own_readings({k: col(k) for k in ("make", "model", "colour", "own_make", "own_model", "own_colour")})
    read = subjects.withColumns({**own, **remembered({**{f"own_{k}": col(f"own_{k}") for k in own}, **own})})
    cars = vehicles(read.select(album, "burst", "frame", "det", "cls", "embedding", "plate"), album, same)
    firsts = cars.select(album, "vehicle").distinct()
    keys = firsts.withColumn("group_key", F.row_number().over(Window.partitionBy(album).orderBy("vehicle")))
    member = read.join(cars.join(keys, [album, "vehicle"]).select(album, "det", "group_key"), [album, "det"], "left")
    unit = member.where("group_key is not null").withColumn("_group", F.struct(album, "group_key"))
    settled = consensus(unit, "_group", "det")
    names = [c for c in settled.columns if c != "_group"]
    joined = member.withColumn("_group", F.when(F.col("group_key").isNotNull(), F.struct(album, "group_key"))).join(settled.select("_group", *[F.col(c).alias(f"_g_{c}") for c in names]), "_group", "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_g_{c}")) for c in ("plate", "race_number", "team", "driver", "country") if c in has and c in names}
    lists = {c: F.when(F.size(f"_g_{c}") > 0, F.col(f"_g_{c}")).otherwise(F.col(c)) for c in ("sponsors", "livery_text") if c in has}
    better = {c: F.coalesce(F.nullif(F.col(f"_g_{c}"), F.lit("")), F.col(c)) for c in ("make", "model", "colour") if c in names}
    sums = {"group_size": F.col("_g_members"), "group_agreement": F.round("_g_agreement", 3), "group_colour_hex": F.col("_g_colour_hex") if "colour_hex" in names else F.lit(None).cast("string")}
    return joined.withColumns(filled | lists | better | sums).drop("_group", *[f"_g_{c}" for c in names])


def settle_reading(rows: DataFrame, group: str, value: str, seq: str, share: float = SETTLE_SHARE) -> DataFrame:
    """group, winner (null if no reading holds ``share``), forms: the commonest form of each reading by its bare letters."""
    keyed = rows.withColumn("_key", plain_key(F.col(value)))
    counts = keyed.where("_key <> ''").groupBy(group, "_key").agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    forms = ranked_values(keyed.where("_key <> ''").withColumn("_g", F.struct(group, "_key")), "_g", F.col(value), seq).where("place = 1").select(F.col(f"_g.{group}").alias(group), F.col("_g._key").alias("_key"), F.col("value").alias("form"))
    w = Window.partitionBy(group)
    placed = counts.join(forms, [group, "_key"]).withColumns({"_all": F.sum("n").over(w), "_place": F.row_number().over(w.orderBy(F.desc("n"), "first"))})
    return placed.groupBy(group).agg(F.max(F.when((F.col("_place") == 1) & (F.col("n") / F.col("_all") >= share), F.col("form"))).alias("winner"), F.count("*").alias("forms"))


def seed_registry(registry: DataFrame, found: DataFrame, key: str = "plate") -> DataFrame:
    """``registry`` with what was ``found``: only blanks of known plates are filled, new plates are added."""
    old = registry.select(key, *[F.col(c).alias(f"_o_{c}") for c in registry.columns if c != key])
    columns = [c for c in registry.columns if c != key]
    merged = found.where(blank_to_null(F.col(key)).isNotNull()).join(old, key, "left")
    delta = merged.select(key, *[F.coalesce(blank_to_null(F.col(f"_o_{c}")), F.col(c) if c in found.columns else F.lit(None)).alias(c) for c in columns])
    return upsert(registry, delta, key)


def aliases_of(a: Column, b: Column, self_name: Column) -> Column:
    """Both lists as one sorted set, without the name itself and blanks."""
    return F.sort_array(F.array_except(F.array_union(a, b), F.array(self_name, F.lit(""))))
