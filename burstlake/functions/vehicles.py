"""Column functions on what is read of vehicles: brands, readings, plates, keywords, titles and file tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_plate, blank_to_null, casefold, plain_key, split_list

#: Nameplates and the one brand that sells each.
NAMEPLATES = {
    "falcon": "Ford", "fairmont": "Ford", "territory": "Ford", "commodore": "Holden", "monaro": "Holden", "maloo": "Holden", "torana": "Holden", "kingswood": "Holden", "calais": "Holden", "statesman": "Holden", "sandman": "Holden",
    "focus": "Ford", "fiesta": "Ford", "mustang": "Ford", "ranger": "Ford", "impreza": "Subaru", "liberty": "Subaru", "forester": "Subaru", "brz": "Subaru", "wrx": "Subaru", "lancer": "Mitsubishi", "evolution": "Mitsubishi", "pajero": "Mitsubishi",
    "skyline": "Nissan", "silvia": "Nissan", "patrol": "Nissan", "supra": "Toyota", "corolla": "Toyota", "hilux": "Toyota", "landcruiser": "Toyota", "celica": "Toyota", "aurion": "Toyota", "civic": "Honda", "integra": "Honda", "nsx": "Honda", "accord": "Honda",
    "golf": "Volkswagen", "polo": "Volkswagen", "passat": "Volkswagen", "rx-7": "Mazda", "rx-8": "Mazda", "mx-5": "Mazda", "cosmo": "Mazda", "cooper": "MINI", "clubman": "MINI", "ninja": "Kawasaki", "zx-10r": "Kawasaki", "zx-6r": "Kawasaki", "z1000": "Kawasaki", "h2": "Kawasaki",
    "yzf": "Yamaha", "r1": "Yamaha", "r6": "Yamaha", "mt-09": "Yamaha", "hayabusa": "Suzuki", "gsx-r": "Suzuki", "gsxr": "Suzuki", "panigale": "Ducati", "monster": "Ducati", "multistrada": "Ducati", "fireblade": "Honda", "cbr": "Honda",
}
#: Codes and names of states, text beside plates, and the issued formats of plates.
STATES = ("NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT")
STATE_NAMES = {"NEWSOUTHWALES": "NSW", "VICTORIA": "VIC", "QUEENSLAND": "QLD", "SOUTHAUSTRALIA": "SA", "WESTERNAUSTRALIA": "WA", "TASMANIA": "TAS", "NORTHERNTERRITORY": "NT", "AUSTRALIANCAPITALTERRITORY": "ACT"}
PLATE_NOISE = ("AUSTRALIA", "THEFIRSTSTATE", "SUNSHINESTATE", "GARDENSTATE", "THEPLACETOBE", "HOLIDAYISLE", "OUTBACKAUSTRALIA", "THEFESTIVALSTATE", "PREMIERSTATE", "THEHEARTOFAUSTRALIA")
PLATE_FORMATS = r"^([A-Z]{3}[0-9]{2}[A-Z]|[A-Z]{3}[0-9]{3}|[0-9]{3}[A-Z]{3}|[A-Z][0-9]{3}[A-Z]{2}|[A-Z]{2}[0-9]{2}[A-Z]{2}|[0-9]{1,3}[A-Z]{1,3}[0-9]{1,3}|[0-9]{4,6}[A-Z]|[A-Z][0-9]{4,6}|[A-Z]{6})$"
#: The bonus of a reading in an issued format, and its length.
FORMAT_BONUS, PLATE_LENGTH = 0.2, (4, 8)
#: Fixed value: the similarity from which two sponsor names are one.
SAME_SPONSOR = 0.85


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def correct_make(make: Column, model: Column, nameplates: dict[str, str] = NAMEPLATES) -> Column:
    """The brand that the first nameplate in the model belongs to; the make as it is if that says the same, or there is none."""
    names = _table(nameplates)
    words = F.regexp_extract_all(F.lower(F.coalesce(model, F.lit(""))), F.lit("[a-z0-9][a-z0-9-]*"), F.lit(0))
    owner = F.element_at(names, F.get(F.filter(words, lambda w: F.map_contains_key(names, w)), F.lit(0)))
    return F.when(owner.isNull() | (F.lower(F.trim(make)) == F.lower(owner)), make).otherwise(owner)


def reading_of(text: Column) -> Column:
    """struct(make, model, n, stated) of a bare text: split once at the first space."""
    parts = F.split(text, " ", 2)
    return F.struct(F.coalesce(parts[0], F.lit("")).alias("make"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("model"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("stated"))


def reading_text(r: Column) -> Column:
    return F.concat_ws(" ", F.nullif(r["make"], F.lit("")), F.nullif(r["model"], F.lit("")))


def observed(readings: Column) -> Column:
    """All that was read, in lower case."""
    return F.lower(F.array_join(F.transform(readings, reading_text), " | "))


def acceptable_make(make: Column, readings: Column) -> Column:
    """The make if it was read, or a nameplate that was read implies it; else null."""
    implied = F.exists(readings, lambda r: F.coalesce(F.lower(correct_make(F.lit(None).cast("string"), reading_text(r))) == F.lower(make), F.lit(False)))
    return F.when((F.coalesce(make, F.lit("")) != "") & (observed(readings).contains(F.lower(make)) | implied), make)


def acceptable_model(model: Column, readings: Column) -> Column:
    """The words of the model that were read, in the spelling of a reading that has the same letters; null if none was."""
    seen = observed(readings)
    words = F.filter(F.split(F.replace(F.coalesce(model, F.lit("")), F.lit("-"), F.lit(" ")), r"\s+"), lambda w: (w != "") & seen.contains(F.lower(w)))
    kept = F.array_join(words, " ")
    forms = F.flatten(F.transform(readings, lambda r: F.array(reading_text(r), r["model"])))
    same = F.filter(forms, lambda f: (f != "") & (plain_key(f) == plain_key(kept)))
    return F.when(F.size(words) > 0, F.coalesce(F.get(same, F.lit(0)), kept))


def plurality_make(readings: Column) -> Column:
    """The make that most stated readings (by their counts) name, by nameplate where it is missing; null if two are named as often.

    Of the spellings of one make the first counts. ``readings`` are in their order.
    """
    named = F.filter(F.transform(F.filter(readings, lambda r: r["stated"]), lambda r: F.struct(F.coalesce(blank_to_null(r["make"]), correct_make(F.lit(None).cast("string"), r["model"])).alias("make"), r["n"].alias("n"))), lambda x: blank_to_null(x["make"]).isNotNull())
    makes = F.array_distinct(F.transform(named, lambda x: F.lower(F.trim(x["make"]))))
    total = lambda m: F.aggregate(F.filter(named, lambda x: F.lower(F.trim(x["make"])) == m), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    counts = F.transform(makes, total)
    top = F.array_max(counts)
    lead = F.get(F.filter(named, lambda x: total(F.lower(F.trim(x["make"]))) == top), F.lit(0))["make"]
    return F.when(F.size(F.filter(counts, lambda c: c == top)) == 1, F.trim(lead))


def reconciled(make: Column, model: Column, readings: Column) -> Column:
    """struct(make, model, rejected): a model's answer checked against the readings (commonest first).

    A make that leads the readings overrules another; else only words that were read survive, and what was dropped or changed is rejected.
    """
    make, model = blank_to_null(make), blank_to_null(model)
    leader = plurality_make(readings)
    first = F.get(readings, F.lit(0))
    overruled = F.coalesce(plain_key(make) != plain_key(leader), F.lit(False))
    own_model = F.when(plain_key(first["make"]) == plain_key(leader), first["model"])
    kept_make, kept_model = acceptable_make(make, readings), acceptable_model(model, readings)
    gone = F.array_compact(F.array(F.when(make.isNotNull() & kept_make.isNull(), make), F.when(model.isNotNull() & ~kept_model.eqNullSafe(model), model)))
    said = F.trim(F.concat_ws(" ", make, F.coalesce(model, F.lit("None"))))
    return F.struct(F.when(overruled, leader).otherwise(kept_make).alias("make"), F.when(overruled, own_model).otherwise(kept_model).alias("model"), F.when(overruled, F.array(said)).otherwise(gone).alias("rejected"))


def cache_key(readings: Column) -> Column:
    """``3x Make Model`` a line."""
    return F.array_join(F.transform(readings, lambda r: F.concat(r["n"].cast("string"), F.lit("x "), reading_text(r))), "\n")


def looks_like_plate(token: Column) -> Column:
    """In one of the issued formats."""
    return F.coalesce(F.upper(token).rlike(PLATE_FORMATS), F.lit(False))


def trim_to_format(token: Column) -> Column:
    """Without a stray first or last character if that leaves five at least, in an issued format."""
    n = F.length(token)
    head, tail = F.substring(token, F.lit(2), n - 1), F.substring(token, F.lit(1), n - 1)
    fits = lambda c: (F.length(c) >= 5) & c.rlike(PLATE_FORMATS)
    return F.when(token.rlike(PLATE_FORMATS), token).when(fits(head), head).when(fits(tail), tail).otherwise(token)


def interpret_plate(lines: Column, least: int = PLATE_LENGTH[0], most: int = PLATE_LENGTH[1]) -> Column:
    """struct(text, state, confidence, candidates) of ``lines`` (structs text, score): the best token that may be a plate.

    The state is the last one named; mottoes are noise; all letters or all digits count in an issued format only. A reading in such a
    format gains 0.2, at most 1, and of equals the first wins.
    """
    names = _table(STATE_NAMES)
    tokens = F.filter(F.transform(lines, lambda x: F.struct(ascii_plate(x["text"]).alias("t"), x["score"].alias("s"))), lambda x: x["t"] != "")
    is_state = lambda x: x["t"].isin(*STATES) | F.map_contains_key(names, x["t"])
    named = F.transform(F.filter(tokens, is_state), lambda x: F.when(x["t"].isin(*STATES), x["t"]).otherwise(F.element_at(names, x["t"])))
    plain = lambda t: t.rlike("^([A-Z]+|[0-9]+)$") & ~t.rlike(PLATE_FORMATS)
    may = F.filter(tokens, lambda x: ~is_state(x) & ~x["t"].isin(*PLATE_NOISE) & F.length(x["t"]).between(least, most) & ~plain(x["t"]))
    cut = F.transform(may, lambda x: F.struct(trim_to_format(x["t"]).alias("t"), x["s"].alias("s")))
    weighed = F.transform(cut, lambda x: F.struct(x["t"].alias("t"), F.when(x["t"].rlike(PLATE_FORMATS), F.least(x["s"] + FORMAT_BONUS, F.lit(1.0))).otherwise(x["s"]).alias("w")))
    top = F.array_max(F.transform(F.filter(weighed, lambda x: x["w"] > 0), lambda x: x["w"]))
    best = F.get(F.filter(weighed, lambda x: x["w"] == top), F.lit(0))["t"]
    return F.struct(best.alias("text"), F.when(F.size(named) > 0, F.element_at(named, -1)).alias("state"), F.coalesce(top, F.lit(0.0)).alias("confidence"), F.transform(cut, lambda x: x["t"]).alias("candidates"))


def sponsor_key(name: Column) -> Column:
    return plain_key(name)


def same_sponsor(a: Column, b: Column) -> Column:
    """One name holds the other (of four letters at least), or they are alike by 0.85 of the longer."""
    x, y = sponsor_key(a), sponsor_key(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    alike = 1 - F.levenshtein(x, y) / F.length(long) >= SAME_SPONSOR
    return F.coalesce((x != "") & (y != "") & (((F.length(short) >= 4) & long.contains(short)) | alike), F.lit(False))


def canonical_sponsors(read: Column, known: Column) -> Column:
    """Each name as the first known one that matches it spells it, else as read; once."""
    return F.array_distinct(F.transform(read, lambda r: F.coalesce(F.get(F.filter(known, lambda k: same_sponsor(r, k)), F.lit(0)), r)))


def number_values(fields: Column) -> Column:
    """The parts of all values of an entry (array of values), split at ; and ,."""
    return F.flatten(F.transform(fields, lambda v: split_list(F.replace(v, F.lit(";"), F.lit(",")))))


def distinct_folded(values: Column) -> Column:
    """The first of each value, in order, letters in any case."""
    return F.transform(F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: F.array_position(F.transform(values, casefold), casefold(x["v"])) == x["i"] + 1), lambda x: x["v"])


def keywords(v: Column, entry: Column, prefix: str = "", with_plate: bool = True) -> Column:
    """Keywords of one vehicle, a struct of race_number, plate, plate_state, make, colour, body_type, model, model_suggested, team,
    team_corroborated, number_source, sponsors, is_competition and is_bike; ``entry``: values of the entry list for its number (null: none)."""
    given = lambda c: blank_to_null(c)
    number, plate, make = given(v["race_number"]), given(v["plate"]), given(v["make"])
    model = F.when(~F.coalesce(v["model_suggested"], F.lit(False)), given(v["model"]))
    of_number = F.when(number.isNotNull(), F.concat(F.array(number, F.concat(F.lit("#"), number), F.concat(F.lit("Car "), number)), F.coalesce(number_values(entry), F.array().cast("array<string>"))))
    of_plate = F.when(plate.isNotNull() & F.lit(with_plate), F.array(plate, given(v["plate_state"])))
    sure_team = F.when(F.coalesce(v["team_corroborated"], F.lit(False)) | F.coalesce(v["number_source"] == "manual", F.lit(False)), given(v["team"]))
    flags = F.array(F.when(v["is_competition"], "Motorsport"), F.when(v["is_bike"], "Motorcycle"))
    none = F.array().cast("array<string>")
    rest = F.array(make, given(v["colour"]), given(v["body_type"]), model, F.when(model.isNotNull() & make.isNotNull(), F.concat(make, F.lit(" "), model)), sure_team)
    parts = F.concat(F.coalesce(of_number, none), F.coalesce(of_plate, none), rest, F.coalesce(v["sponsors"], none), flags)
    told = F.transform(F.filter(F.transform(F.array_compact(parts), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    return distinct_folded(told)


def title(v: Column) -> Column:
    """``#7 Red Make Model`` of the same struct (and kind): the make is left out where the model begins with it."""
    model = F.when(~F.coalesce(v["model_suggested"], F.lit(False)), blank_to_null(v["model"]))
    make = F.when(~F.coalesce(F.lower(model).startswith(F.lower(blank_to_null(v["make"]))), F.lit(False)), blank_to_null(v["make"]))
    colour = blank_to_null(v["colour"])
    first_up = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.length(c)))
    named = F.nullif(F.concat_ws(" ", first_up(colour), make, model), F.lit(""))
    kind = first_up(F.lower(F.coalesce(v["kind"], F.lit(""))))
    known = blank_to_null(v["plate"]).isNotNull() | blank_to_null(v["race_number"]).isNotNull()
    label = F.coalesce(named, F.when(known, kind).otherwise(F.concat(kind, F.lit(", not identified"))))
    return F.when(blank_to_null(v["race_number"]).isNotNull(), F.concat(F.lit("#"), F.trim(v["race_number"]), F.lit(" "), label)).otherwise(label)


def caption(titles: Column) -> Column:
    return F.array_join(F.filter(titles, lambda t: t != ""), "; ")


def first_given(tags: Column, names: list[str]) -> Column:
    """The first of the tags (a map of text) that holds something other than nothing, blank text or a dash."""
    return F.coalesce(*[F.when(~F.coalesce(F.try_element_at(tags, F.lit(n)), F.lit("")).isin("", "-"), F.try_element_at(tags, F.lit(n))) for n in names])


def camera_of(tags: Column, fallback: Column) -> Column:
    """A stable name of the body: model and serial number, else model and lens, else either, else ``fallback``."""
    model, serial, lens = first_given(tags, ["Model"]), first_given(tags, ["SerialNumber", "InternalSerialNumber"]), first_given(tags, ["LensModel", "LensID"])
    return F.coalesce(F.when(serial.isNotNull(), F.trim(F.concat_ws(" ", model, serial))), F.when(lens.isNotNull() & model.isNotNull(), F.trim(F.concat(model, F.lit(" + "), lens))), model, fallback)


def cull_of(tags: Column) -> Column:
    """struct(rating, label, rejected) of a file's tags: Rating before XMP:Rating, cut to whole stars; under 0 is a rejection; what is no number is unrated."""
    text = F.coalesce(F.try_element_at(tags, F.lit("Rating")), F.try_element_at(tags, F.lit("XMP:Rating")))
    value = F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))
    whole = F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0).otherwise(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))).cast("int")
    return F.struct(F.greatest(whole, F.lit(0)).alias("rating"), F.coalesce(F.try_element_at(tags, F.lit("Label")), F.lit("")).alias("label"), (whole <= -1).alias("rejected"))


def described(rows: DataFrame, tags: str, fallback: Column, path: str = "SourceFile") -> DataFrame:
    """``rows`` with camera, taken (seconds) and path from their tags (a map): what sessions are made of."""
    from .times import taken_at

    return rows.withColumns({"path": F.try_element_at(F.col(tags), F.lit(path)), "camera": camera_of(F.col(tags), fallback), "taken": taken_at(F.col(tags))})


def truthy(text: Column) -> Column:
    """A JSON text that holds something: not null, false, 0, nor an empty text, list or object."""
    v = F.try_parse_json(text)
    return truthy_variant(v, F.schema_of_variant(v), text)


def truthy_variant(v: Column, kind: Column, text: Column) -> Column:
    """``truthy`` of a variant, its schema and its JSON."""
    number = F.try_variant_get(v, "$", "double")
    word = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(v.isNull() | F.is_variant_null(v) | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", word != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.trim(text).rlike(r"^(\[\s*\]|\{\s*\})$"))
        .otherwise(number != 0),
        F.lit(False),
    )


def json_text(text: Column) -> Column:
    """A JSON value as plain text: a string as itself, True, False and None, else as it is written."""
    v = F.try_parse_json(text)
    return variant_text(v, F.schema_of_variant(v), text)


def variant_text(v: Column, kind: Column, text: Column) -> Column:
    """``json_text`` of a variant, its schema and its JSON."""
    return F.when(v.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(v) | (kind == "VOID"), "None").when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False")).when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.trim(text))


def remembered(v: dict[str, Column]) -> dict[str, Column]:
    """own_make, own_model and own_colour: what a frame's own reader said first; a blank is no answer and nothing is overwritten."""
    return {f"own_{k}": F.coalesce(blank_to_null(v[f"own_{k}"]), blank_to_null(v[k])) for k in ("make", "model", "colour")}


def own_readings(v: dict[str, Column]) -> dict[str, Column]:
    """make, model and colour as the frame's own reader said, where it did."""
    return {k: F.coalesce(blank_to_null(v[f"own_{k}"]), v[k]) for k in ("make", "model", "colour")}


def probability_bars(text: Column) -> Column:
    """array of struct(option, p), in order of option, of a JSON map or list of probabilities; null if it is neither."""
    as_map = F.from_json(text, "map<string,double>")
    as_list = F.from_json(text, "array<double>")
    of_map = F.sort_array(F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("option"), e["value"].alias("p"))))
    of_list = F.transform(as_list, lambda p, i: F.struct(i.cast("string").alias("option"), p.alias("p")))
    return F.filter(F.when(F.ltrim(text).startswith("["), of_list).otherwise(of_map), lambda x: x["p"].isNotNull())


def signature_of(text: Column) -> Column:
    """struct(shape, colours) of ``hex:numbers``: a 64-bit hash and a histogram; null if either does not parse."""
    digits = F.regexp_extract(text, r"^\s*(?:0[xX])?([0-9A-Fa-f]{1,16})\s*(?::|$)", 1)
    shape = F.conv(F.nullif(digits, F.lit("")), 16, -10).cast("long")
    numbers = F.transform(F.split(F.element_at(F.split(text, ":", 2), -1), ","), lambda p: p.try_cast("float"))
    return F.when(shape.isNotNull() & text.contains(":") & ~F.exists(numbers, lambda x: x.isNull()), F.struct(shape.alias("shape"), numbers.alias("colours")))
