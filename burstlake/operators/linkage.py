"""Joins: record linkage, band joins, nearest entities, as-of joins, and lookups that fill blanks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, normalised_path, path_key

SLOP_SECONDS = 2.0


def link_records(left: DataFrame, right: DataFrame, path: str = "path", name: str = "name", time: str = "time", slop: float = SLOP_SECONDS) -> DataFrame:
    """(left_id, right_id, how): by the one equal path, else by the one equal name within ``slop`` seconds.

    Both sides have id, path, name and time. A path that several rows share links none, and does not fall through.
    """
    a, b = left.select(*[F.col(c).alias(f"l_{c}") for c in ("id", path, name, time)]), right.select(*[F.col(c).alias(f"r_{c}") for c in ("id", path, name, time)])
    by_path = b.groupBy(f"r_{path}").agg(F.count("*").alias("n"), F.first("r_id").alias("r_id"))
    first = a.join(by_path, F.col(f"l_{path}") == F.col(f"r_{path}"), "left")
    exact = first.where("n = 1").select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), F.lit("path").alias("how"))
    rest = first.where("n is null").select(a.columns)
    # a band join on (name, time bucket): buckets as wide as the slop, each row also in the next one
    spread = b.select("*", F.explode(F.array(*[F.floor(F.col(f"r_{time}") / slop) + k for k in (-1, 0, 1)])).alias("bucket"))
    rest = rest.withColumn("l_bucket", F.floor(F.col(f"l_{time}") / slop))
    near = rest.join(spread, (F.col(f"l_{name}") == F.col(f"r_{name}")) & (F.col("l_bucket") == F.col("bucket")))
    near = near.where(F.abs(F.col(f"l_{time}") - F.col(f"r_{time}")) <= slop)
    only = near.groupBy("l_id").agg(F.count("*").alias("n"), F.first("r_id").alias("r_id")).where("n = 1")
    return exact.unionByName(only.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), F.lit("name").alias("how")))


def band_pairs(rows: DataFrame, key: str, at: str, width: float, pair: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Each pair of rows with keys a < b at most ``width`` apart in ``at``, once: an equi-join on buckets, not a nested loop.

    Columns of the two sides are structs named by ``pair``. Rows without ``at`` pair with none.
    """
    x, y = pair
    row = F.struct(*[F.col(c) for c in rows.columns])
    timed = rows.where(F.col(at).isNotNull())
    left = timed.select(row.alias(x), F.floor(F.col(at) / width).alias("bucket"))
    right = timed.select(row.alias(y), F.explode(F.array(*[F.floor(F.col(at) / width) + k for k in (-1, 0, 1)])).alias("bucket"))
    met = left.join(right, "bucket").where((F.col(f"{x}.{key}") < F.col(f"{y}.{key}")) & (F.abs(F.col(f"{x}.{at}") - F.col(f"{y}.{at}")) <= width))
    return met.select(x, y)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its time: a union and a window, one shuffle."""
    both = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(f"_{value}"), F.lit(1).alias("_side")).unionByName(right.select(key, at, F.col(value).alias(f"_{value}"), F.lit(0).alias("_side")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_as_of", F.last(f"_{value}", ignorenulls=True).over(order)).where("_side = 1").drop("_side", f"_{value}")


def nearest_known(rows: DataFrame, known: DataFrame, threshold: float, id_col: str, name: str, vector: str = "embedding", bound: int = 32 << 20) -> DataFrame:
    """(id, name, score) of the known entity with the greatest product of at least ``threshold``; of equals the last name.

    ``known`` is a registry: its bytes are counted first, and it travels in blocks of about ``bound`` bytes, each of which goes over the rows once; an Arrow
    batch of rows meets a block in one product of matrices, and no row is joined with all entities. Vectors of another length do not meet; a missing
    component counts as 0. The best of the blocks' best is kept.
    """
    weight = known.agg(F.sum(F.coalesce(F.size(vector), F.lit(0)) * 8 + 64).alias("b")).first()["b"] or 0
    blocks = max(1, -(-weight // bound))
    asked = rows.select(id_col, F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("_v")).where("size(_v) > 0")
    listed = known.select(F.col(name).alias("_name"), F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("_v")).where("size(_v) > 0")
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("_name", T.StringType()), T.StructField("_score", T.DoubleType())])
    out = None
    for b in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("_name", "_v"), F.lit(blocks)) == b)
        found = asked.mapInArrow(_nearest(part.toArrow(), threshold, id_col), schema)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy(id_col).agg(F.max(F.struct("_score", "_name")).alias("m"))
    return best.select(id_col, F.col("m._name").alias(name), F.round("m._score", 3).alias("score"))


def _nearest(block: pa.Table, threshold: float, id_col: str):
    """The best entity of one bounded ``block`` for each row; products are compared to 12 places, so that equal vectors are equals."""
    names = block.column("_name").to_pylist()
    lengths = np.array([len(v) for v in block.column("_v")])
    sides = {}
    for n in set(lengths.tolist()):
        at = np.flatnonzero(lengths == n)
        at = at[np.argsort(np.array([names[k] for k in at]), kind="stable")]
        sides[n] = [names[k] for k in at], np.array([block.column("_v")[int(k)].as_py() for k in at]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            rows, said, scores = [], [], []
            for n, (own, matrix) in sides.items():
                at = np.flatnonzero(sizes == n)
                if not len(at):
                    continue
                product = np.round(batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(-1, n) @ matrix, 12)
                best = product.shape[1] - 1 - np.argmax(product[:, ::-1], axis=1)  # of equals the last name
                top = product[np.arange(len(at)), best]
                good = top >= threshold
                rows += at[good].tolist()
                said += [own[k] for k in best[good]]
                scores += top[good].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "_name", "_score"])

    return run


def fill_blanks(rows: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank ``columns`` of ``rows`` filled from the row of ``known`` with the same key; of several such rows the first value by order."""
    side = known.groupBy(key).agg(*[F.min(F.nullif(F.col(c), F.lit(""))).alias(f"_known_{c}") for c in columns])
    joined = rows.join(side, key, "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_known_{c}")) for c in columns}).drop(*[f"_known_{c}" for c in columns])


def longest_prefix(rows: DataFrame, known: DataFrame, stem: str, known_stem: str, least: int) -> DataFrame:
    """``rows`` with ``matched``: the longest known stem that begins theirs, of ``least`` characters at least."""
    cuts = rows.select(stem).distinct().select(stem, F.explode(F.sequence(F.lit(least), F.greatest(F.length(stem), F.lit(least)))).alias("n")).where(F.col("n") <= F.length(stem))
    met = cuts.withColumn("_prefix", F.left(F.col(stem), F.col("n"))).join(known.select(F.col(known_stem).alias("_prefix")).distinct(), "_prefix")
    return rows.join(met.groupBy(stem).agg(F.max_by("_prefix", "n").alias("matched")), stem, "left")


def largest_of(rows: DataFrame, key: str, size: str, item: str) -> DataFrame:
    """key, item of the greatest size (of equals the least item)."""
    return rows.groupBy(key).agg(F.max(F.struct(F.col(size), (-F.col(item)).alias("i"))).alias("m")).select(key, (-F.col("m.i")).alias(item), F.col(f"m.{size}").alias(size))


def annotate(images: DataFrame, given: DataFrame, columns: list[str], path: str = "path", seq: str = "seq") -> DataFrame:
    """``images`` with ``columns`` taken over from the rows of ``given`` with the same path (in any case, any separators).

    Of several rows with one path the last by ``seq`` counts; rows of unknown paths say nothing; other images keep what they have.
    """
    last = given.groupBy(path_key(F.col(path)).alias("_key")).agg(F.max_by(F.struct(*columns), seq).alias("_new"))
    joined = images.withColumn("_key", path_key(F.col(path))).join(last, "_key", "left")
    return joined.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c) if c in images.columns else None) for c in columns}).drop("_key", "_new")


def file_marks(rating: Column, label: Column) -> tuple[Column, Column]:
    """A file's own stars (1 to 5: cameras write 0 for none) and label (null if blank)."""
    return F.when(rating.between(1, 5), rating), blank_to_null(label)


def without(rows: DataFrame, others: DataFrame, key: str, where: Column) -> DataFrame:
    """``rows`` that none of ``others`` that ``where`` holds for belongs to: people without a face, say."""
    return rows.join(others.where(where).select(key).distinct(), key, "left_anti")


def entry_of_number(rows: DataFrame, entries: DataFrame, number: str, seq: str) -> DataFrame:
    """``rows`` with ``entry`` (a struct) of the same number, whatever its leading zeros; of several entries the first by ``seq``."""
    key = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^0+(?=[0-9])", ""), F.lit(""))
    first = entries.withColumn("_key", key(F.col(number))).where("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*entries.columns), seq).alias("entry"))
    return rows.withColumn("_key", key(F.col(number))).join(first, "_key", "left").drop("_key")


def entry_of_evidence(evidence: DataFrame, entries: DataFrame, item: str, lines: str, entry: str, drivers: str) -> DataFrame:
    """item, entry, score of the one entry whose drivers the ``lines`` of an item name best; items where two are as good have none.

    A full name counts 3, else a surname of four letters 2. An entry list is small; its names meet texts by their words, not text by text:
    a name can only be in a text that holds its surname as a word.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    said = evidence.select(item, words(F.array_join(lines, " ")).alias("w")).select(item, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("text"), F.array_distinct("w").alias("w"))
    names = entries.select(F.col(entry).alias("entry"), F.explode(drivers).alias("d")).select("entry", words(F.col("d")).alias("parts")).where(F.size("parts") > 0)
    names = names.select("entry", F.element_at("parts", -1).alias("surname"), F.array_join("parts", " ").alias("full"), F.size("parts").alias("k"))
    held = lambda c: F.col("text").contains(F.concat(F.lit(" "), c, F.lit(" ")))
    met = said.select(item, "text", F.explode("w").alias("surname")).join(names, "surname")
    points = F.when((F.col("k") > 1) & held(F.col("full")), 3).when(F.length("surname") >= 4, 2).otherwise(0)
    score = met.groupBy(item, "entry").agg(F.sum(points).alias("score")).where("score > 0")
    w = Window.partitionBy(item)
    top = score.withColumn("_top", F.max("score").over(w)).where("score = _top").withColumn("_n", F.count("*").over(w)).where("_n = 1")
    return top.select(item, "entry", F.col("score").cast("long").alias("score"))


def classify_entries(entries: DataFrame, photos: DataFrame, seq: str = "seq") -> DataFrame:
    """``entries`` (path, rating, pick, ...) of a package with status matched, missing or skipped, reason, and photo, the id of the photo.

    Paths are compared in any case and with any separators; of photos with one path the first by id counts, and virtual copies are no photos.
    An entry without path, with a rating beyond -1 to 5 or a pick beyond -1 to 1 is skipped; of entries for one photo all but the first are.
    """
    masters = photos.where(~F.coalesce("virtual", F.lit(False))).groupBy(normalised_path(F.col("path")).alias("_key")).agg(F.min("id").alias("photo"))
    joined = entries.withColumn("_key", normalised_path(F.col("path"))).join(masters, "_key", "left")
    n = F.row_number().over(Window.partitionBy("_key").orderBy(seq))
    reason = (
        F.when(blank_to_null(F.col("path")).isNull(), "entry has no path")
        .when(~F.coalesce(F.col("rating").between(-1, 5), F.lit(True)), "rating out of range")
        .when(~F.coalesce(F.col("pick").between(-1, 1), F.lit(True)), "pick out of range")
        .when(F.col("photo").isNotNull() & (n > 1), "path comes twice")
    )
    judged = joined.withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "skipped").when(F.col("photo").isNull(), "missing").otherwise("matched")
    return judged.withColumn("status", status).drop("_key")


def common_parent(paths: DataFrame, group: list[str], path: str = "path") -> DataFrame:
    """group, parent: the folder that all paths of a group are in (as the first of them writes it), null if they are in several or one has none."""
    folder = F.nullif(F.regexp_extract(F.col(path), r"^(.*)[/\\\\][^/\\\\]*$", 1), F.lit(""))
    rows = paths.select(*group, folder.alias("_folder"), normalised_path(folder).alias("_key"))
    per = rows.groupBy(*group).agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.count("*").alias("n"), F.count("_key").alias("k"), F.min("_folder").alias("first"))
    return per.select(*group, F.when((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("k")), F.col("first")).alias("parent"))
