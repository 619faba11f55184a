"""The registry of known vehicles: near plates by masked keys, what a vehicle's frames agree on, and seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONFUSABLE, ascii_plate, blank_to_null
from ..functions.vehicles import truthy_variant, variant_text
from .lineage import tabled

#: What the registry holds of a plate, in order.
FIELDS = ("make", "model", "colour", "body_type", "team", "sponsors", "race_number")


def masked_keys(plate: Column) -> Column:
    """The plate with one place replaced by a class of characters that are read for each other, once for each place and class of its character.

    Two plates are near (one place differs, within a class) exactly if they are not equal and share such a key.
    """
    places = F.sequence(F.lit(1), F.length(plate))
    masked = lambda i: F.transform(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(CONFUSABLE)]), lambda x: x["c"].contains(F.substr(plate, i, F.lit(1)))), lambda x: F.concat(F.substr(plate, F.lit(1), i - 1), F.lit("<"), x["k"].cast("string"), F.lit(">"), F.substr(plate, i + 1)))
    return F.when(F.length(plate) > 0, F.flatten(F.transform(places, masked)))


def near_plates(left: DataFrame, right: DataFrame, plate: str = "plate", within: list[str] | None = None) -> DataFrame:
    """(within, ``plate``, near): each plate of ``left`` with the plates of ``right`` that are near it (of the same ``within``), each pair once.

    Plates meet by their masked keys, so that a registry of any size takes an equality join, and no plate is compared with all others.
    """
    by = within or []
    side = lambda df, name: df.select(*by, plate, F.explode(masked_keys(F.col(plate))).alias("_key")).distinct().withColumnRenamed(plate, name)
    met = side(left, plate).join(side(right, "near"), [*by, "_key"]).where(F.col(plate) != F.col("near"))
    return met.select(*by, plate, "near").distinct()


def attributes_of(text: Column) -> Column:
    """The JSON object of a text as a variant; an empty object where it is none."""
    v = F.try_parse_json(text)
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), v), F.parse_json(F.lit("{}")))


def field_values(attributes: Column, field: str) -> Column:
    """What an attribute says: its value, or those of its list, as trimmed texts; what is null, false, 0 or empty says nothing."""
    one = F.try_variant_get(attributes, f"$.{field}", "variant")
    many = F.try_variant_get(attributes, f"$.{field}", "array<variant>")
    # each value with its schema, so that neither is made anew for each question about it
    known = F.transform(F.coalesce(many, F.when(one.isNotNull(), F.array(one))), lambda v: F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")))
    said = F.filter(known, lambda x: truthy_variant(x["v"], x["kind"], F.to_json(x["v"])))
    return F.transform(said, lambda x: F.trim(variant_text(x["v"], x["kind"], F.to_json(x["v"]))))


def string_of(attributes: Column, field: str) -> Column:
    """An attribute that is a string, else null."""
    one = F.try_variant_get(attributes, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(attributes, f"$.{field}", "string"))


def _tally(said: DataFrame, group: list[str], value: str, order: Column) -> DataFrame:
    """group, value, n, place: commonest first, of equals the first said. Counts are made before they move."""
    counted = said.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "_first"))).drop("_first")


def agreed(rows: DataFrame, group: list[str], seq: str) -> DataFrame:
    """A reading for each ``group`` that has a plate: plate (most read), votes, aliases (near misses of it), and FIELDS, from ``rows`` (plate, attributes as JSON).

    make is the group's own verdict on its first row (group_make) or the majority; model is that verdict alone (group_model); sponsors are all that were named,
    commonest first; the others are majorities. A value in a list counts like one that stands alone.
    """
    return _agreed(_heard(rows, group, seq, {}), group)


def _heard(rows: DataFrame, group: list[str], seq: str, more: dict[str, Column]) -> DataFrame:
    """Group, _seq, plate, _said (what each of FIELDS but model is said to be) and _own of ``rows``, _object (attributes are an object), and ``more`` (columns over _a, the attributes), stored: JSON is read once, in many tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = rows.withColumn("_seq", F.col(seq)).repartition(n, "_seq").withColumn("_v", F.try_parse_json("attributes"))
    parsed = parsed.withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    parsed = parsed.withColumn("_a", F.when(F.col("_object"), F.col("_v")).otherwise(F.parse_json(F.lit("{}"))))
    said = F.array(*[F.struct(F.lit(f).alias("field"), field_values(F.col("_a"), f).alias("values")) for f in FIELDS if f != "model"])
    own = F.struct(string_of(F.col("_a"), "group_make").alias("make"), string_of(F.col("_a"), "group_model").alias("model"))
    return tabled(parsed.select(*group, "_seq", ascii_plate(F.col("plate")).alias("plate"), said.alias("_said"), own.alias("_own"), "_object", *[c.alias(k) for k, c in more.items()]), "heard")


def _agreed(read: DataFrame, group: list[str]) -> DataFrame:
    """``agreed`` of what was ``_heard``."""
    plates = _tally(read.where("plate <> ''"), group, "plate", F.col("_seq"))
    top = plates.where("place = 1").select(*group, "plate", F.col("n").alias("votes"))
    near = near_plates(top, plates.where("place > 1"), "plate", group).groupBy(*group).agg(F.sort_array(F.collect_set("near")).alias("aliases"))
    fields = [f for f in FIELDS if f != "model"]
    said = read.select(*group, "_seq", F.explode("_said").alias("x")).select(*group, "_seq", "x.field", F.posexplode("x.values").alias("_at", "value"))
    ranked = _tally(said, [*group, "field"], "value", F.struct("_seq", "_at"))
    winners = [F.max(F.when((F.col("place") == 1) & (F.col("field") == f), F.col("value"))).alias(f) for f in fields if f != "sponsors"]
    named = F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == "sponsors", F.struct("place", "value")))), lambda x: x["value"])
    votes = ranked.groupBy(*group).agg(*winners, F.when(F.size(named) > 0, named).alias("sponsors"))
    firsts = read.groupBy(*group).agg(F.min_by("_own", "_seq").alias("_own"), F.min("_seq").alias("first_seq"))
    out = _same(_same(_same(top, near, group), votes, group), firsts, group)
    own = {"make": F.coalesce(F.nullif(F.col("_own.make"), F.lit("")), F.col("make")), "model": F.col("_own.model"), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))}
    return out.withColumns(own).select(*group, "plate", "votes", "aliases", *FIELDS, "first_seq")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which a null key is a key."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(other, on, "left").drop(*[f"_k_{k}" for k in keys])


def readings(detections: DataFrame) -> DataFrame:
    """All readings of ``detections`` (id, job_id, group_key, plate, attributes, number), with ``rank``, their order: vehicles by their first detection, then loose ones by id."""
    a = F.col("_a")
    names = F.filter(F.transform(F.try_variant_get(a, "$.sponsors", "array<variant>"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull())
    alone = {f: string_of(a, f) for f in FIELDS} | {"sponsors": F.array_join(names, ", ")}
    alone["race_number"] = F.coalesce(blank_to_null(alone["race_number"]), F.col("number"))
    rows = _heard(detections.where("coalesce(plate, '') <> ''"), ["job_id", "group_key"], "id", alone).where("_object")
    grouped = _agreed(rows.where("group_key is not null").drop(*FIELDS), ["job_id", "group_key"])
    cars = grouped.select("plate", "aliases", *[F.array_join(c, ", ").alias(c) if c == "sponsors" else F.col(c) for c in FIELDS], F.struct(F.lit(0).alias("loose"), F.col("first_seq").alias("id")).alias("rank"))
    loose = rows.where("group_key is null").select("plate", F.array().cast("array<string>").alias("aliases"), *FIELDS, F.struct(F.lit(1).alias("loose"), F.col("_seq").alias("id")).alias("rank"))
    return cars.unionByName(loose).where("plate <> ''")


def seeded(registry: DataFrame, found: DataFrame) -> DataFrame:
    """``registry`` (plate, aliases as text, FIELDS) with the ``found`` readings: blanks are filled by the first reading that says something, new plates are added, aliases are united.

    Readings that say nothing of any field change nothing. A plate that is read in a third of all rows is one group that is folded on the map side.
    """
    known = registry.select("plate", F.col("aliases").alias("_aliases"), *[F.col(f).alias(f"_{f}") for f in FIELDS], F.lit(True).alias("_known"))
    says = F.greatest(*[blank_to_null(F.col(f)).isNotNull().cast("int") for f in FIELDS]) == 1
    useful = found.where(says)
    first = useful.groupBy("plate").agg(*[F.min_by(blank_to_null(F.col(f)), F.when(blank_to_null(F.col(f)).isNotNull(), F.col("rank"))).alias(f) for f in FIELDS])
    more = useful.select("plate", F.explode("aliases").alias("alias")).distinct()
    old = known.select("plate", F.explode(F.transform(F.split(F.coalesce("_aliases", F.lit("")), ","), ascii_plate)).alias("alias"))
    aliases = more.unionByName(old.join(useful.select("plate").distinct(), "plate", "left_semi")).where("alias <> '' and alias <> plate").groupBy("plate").agg(F.array_join(F.sort_array(F.collect_set("alias")), ", ").alias("_united"))
    new = first.join(aliases, "plate", "left").withColumn("_found", F.lit(True))
    met = known.join(new, "plate", "full")
    kept = F.when(F.col("_found").isNull(), F.col("_aliases")).otherwise(F.coalesce("_united", F.lit("")))
    return met.select("plate", kept.alias("aliases"), *[F.coalesce(blank_to_null(F.col(f"_{f}")), F.col(f)).alias(f) for f in FIELDS])
