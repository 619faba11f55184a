"""Files: registries and entry lists in CSV, exchange packages in JSON, folders of images, catalogue extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_plate, blank_to_null
from ..functions.times import age_seconds, epoch_of_iso

REGISTRY = ("plate", "make", "model", "colour", "body_type", "team", "sponsors", "race_number")
NUMBER_NAMES = ("number", "no", "num", "race number", "car number", "start number", "#")
EXTENSIONS = ("cr3", "cr2", "jpg", "jpeg")
PACKAGE = "format string, version int, direction string, album struct<job_id:long,label:string,root:string>, created_at string, photos array<struct<path:string,rating:int,pick:int,label:string,keywords:array<string>,stars:int,verdict:string,burst:long,keeper:boolean>>, _bad string"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of strings with lower-cased, trimmed names; of equal names the last column counts. A byte order mark is dropped."""
    raw = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    head = [(c or "").lstrip("﻿").strip().lower() for c in raw.limit(1).collect()[0]] if not raw.isEmpty() else []
    named = spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"c{i} string" for i in range(len(head))) or "c0 string").csv(path)
    last = {name: i for i, name in enumerate(head) if name}
    return named.select(*[F.trim(f"c{i}").alias(n) for n, i in last.items()]) if last else named.limit(0)


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Known vehicles by ASCII plate, and how many rows had none."""
    rows = read_table(spark, path)
    full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in REGISTRY]).withColumn("plate", ascii_plate(F.coalesce("plate", F.lit(""))))
    return full.where("plate <> ''"), full.agg(F.count_if(F.col("plate") == "").alias("skipped"))


def write_registry(rows: DataFrame, path: str) -> None:
    """Sorted by plate; range partitions keep the order over part files."""
    rows.select(*REGISTRY).orderBy("plate").write.option("header", True).option("escape", '"').csv(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """number, fields (map of the other columns that are not blank); JSON or CSV by the first character."""
    first = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").limit(1).collect()
    if first and first[0]["v"].lstrip("﻿")[:1] in "[{":
        rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        rows = rows.select(*[F.col(c).cast("string").alias(c.lower()) for c in rows.columns])
    else:
        rows = read_table(spark, path)
    number = next((c for c in NUMBER_NAMES if c in rows.columns), None)
    if number is None:
        return spark.createDataFrame([], "number string, fields map<string,string>")
    others = [c for c in rows.columns if c != number]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in others])
    fields = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["v"], F.lit("")) != ""))
    return rows.select(canonical_number(number).alias("number"), fields.alias("fields")).where("number is not null")


def canonical_number(c: str):
    """Without a leading #, blanks or leading zeros (a lone zero stays)."""
    return blank_to_null(F.regexp_replace(F.regexp_replace(F.trim(c), r"^#\s*", ""), "^0+(?=[0-9])", ""))


def read_packages(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Good packages of format ``name``, and bad ones with the reason."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(PACKAGE).json(path).withColumn("file", F.col("_metadata.file_path"))
    reason = F.when(F.col("_bad").isNotNull(), "not JSON").when(~F.coalesce(F.col("format") == name, F.lit(False)), "another format").when(F.coalesce("version", F.lit(0)) < 1, "no version").when(F.col("photos").isNull(), "no photos")
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("_bad", "reason"), judged.where("reason is not null").select("file", "reason")


def photos(packages: DataFrame) -> DataFrame:
    return packages.select("file", "album.job_id", F.posexplode("photos").alias("seq", "photo")).select("file", "job_id", "seq", "photo.*")


def write_packages(rows: DataFrame, path: str) -> None:
    """A JSON line for each package; Spark commits a task's file only when it is whole."""
    rows.write.option("ignoreNullFields", True).json(path)


def scan_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, size, modified of image files; contents are not read."""
    glob = "*.{" + ",".join([*EXTENSIONS, *(e.upper() for e in EXTENSIONS)]) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def compact_json(columns: list[str]):
    """A row as JSON without null and empty fields."""
    return F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]), {"ignoreNullFields": "true"})


def catalogue(files: DataFrame, folders: DataFrame, roots: DataFrame, images: DataFrame) -> DataFrame:
    """Image rows of a foreign catalogue with their whole path."""
    place = folders.join(roots, folders["root"] == roots["root_id"])
    named = files.join(place, files["folder"] == place["folder_id"])
    return images.join(named, images["file"] == named["file_id"]).select("image_id", F.concat("root_path", "folder_path", "file_name").alias("path"), "rating", "pick", "label")


#: Names of the number column of a number map.
MAP_NAMES = ("number", "no", "no.", "num", "car", "race number", "racenumber")


def read_number_map(spark: SparkSession, path: str) -> DataFrame:
    """number (digits without leading zeros), fields (map, in column order) and described (the values, comma-joined) of a CSV with a number column.

    Column names are kept as they are written; of equal names the last value counts; blank cells are left out; of equal numbers the last row
    counts. A table with a header but no number column is an error.
    """
    raw = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    head = [(c or "").lstrip("\ufeff") for c in raw.limit(1).collect()[0]] if not raw.isEmpty() else []
    at = next((i for name in MAP_NAMES for i, c in enumerate(head) if c.strip().lower() == name), None)
    if at is None:
        if head:
            raise ValueError(f"no number column among {head}")
        return spark.createDataFrame([], "number string, fields map<string,string>, described string")
    rows = spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"c{i} string" for i in range(len(head)))).csv(path)
    digits = F.regexp_replace(F.col(f"c{at}"), "[^0-9]", "")
    number = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    last = {name.strip(): i for i, name in enumerate(head) if name.strip() and i != at}
    order = list(dict.fromkeys(name.strip() for i, name in enumerate(head) if name.strip() and i != at))
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.trim(f"c{last[n]}").alias("v")) for n in order]), lambda p: F.coalesce(p["v"], F.lit("")) != "") if order else F.array().cast("array<struct<k:string,v:string>>")
    named = rows.select(number.alias("number"), pairs.alias("pairs"), F.monotonically_increasing_id().alias("seq")).where("number <> ''")
    kept = named.groupBy("number").agg(F.max_by("pairs", "seq").alias("pairs"))
    return kept.select("number", F.map_from_entries("pairs").alias("fields"), F.array_join(F.transform("pairs", lambda p: p["v"]), ", ").alias("described"))


def pending_packages(spark: SparkSession, path: str, now: float) -> DataFrame:
    """name, album, photos (how many), age_s of the JSON packages in a folder, newest first; a file that is no JSON has its name and the age of the file."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").schema(PACKAGE).json(path)
    rows = rows.withColumns({"_file": F.col("_metadata.file_name"), "_modified": F.unix_micros("_metadata.file_modification_time") / 1e6})
    created = F.coalesce(epoch_of_iso(F.col("created_at")).cast("double"), F.col("_modified"))
    name = F.regexp_replace("_file", r"\.[^.]*$", "")
    out = rows.select(name.alias("name"), F.col("album.label").alias("album"), F.when(F.col("photos").isNotNull(), F.size("photos")).alias("photos"), age_seconds(F.lit(now), created).alias("age_s"))
    return out.orderBy("age_s", "name")
