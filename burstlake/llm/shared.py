"""Helpers that every operator here uses: shared tables, blocks of rows, hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import work_dir
from ..session import ship

#: Bytes of text that are hashed at once; working memory is a small multiple of it.
SEGMENT = 1 << 18
_MASK = (1 << 64) - 1


#: Rows and bytes that go to a Python worker at once: texts and blocks are long, and a worker's memory follows the batch.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package known to the executors, and keep the session's batches for Python small: results are computed later, so this stays set."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/burstlake/{name}-{uuid.uuid4().hex}"


#: Rows of a small table that go to one file.
FILE_ROWS = 200_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts lineage, survives lost executors, and gives later joins a real size to plan with. Of a table with at most
    ``rows`` narrow rows no more files are written than they fill: a round over few rows is not to leave a file a partition.
    """
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with pos, the place from 0 among those of one ``group`` (never null) in ``order``, and size, the rows of the group.

    Rows are sorted by ranges and stored once; only one row a range and group meets others, so a group may be of any size.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = stored(ordered.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    parts = kept.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    earlier = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("part", group, (F.col("first") - earlier).alias("shift"), F.sum("n").over(whole).alias("size"))
    return kept.join(base, ["part", group]).withColumn("pos", F.col("at") - F.col("shift")).drop("part", "at", "shift")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins in them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer row is a block of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _powers = 0xD1342543DE82EF95, {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        for x in (up, down):
            x[0] = 1
            np.cumprod(x, out=x)
        _powers[size] = up, down
    return _powers[size]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes, and for each row (and the end) its first word."""
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, segment by segment, so that a very long text needs no more memory."""
    out, k = np.zeros(len(starts), np.uint64), 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT, "right")))
        low = starts[k]
        piece = data[low : ends[stop - 1]]
        up, down = _power_tables(len(piece))
        with np.errstate(over="ignore"):
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * up[: len(piece)], dtype=np.uint64, out=total[1:])
            out[k:stop] = mix64((total[ends[k:stop] - low] - total[starts[k:stop] - low]) * down[starts[k:stop] - low])
        k = stop
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; element i begins at word i. Shorter input: none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            total = total * np.uint64(0x9FB21C651E98DF25) + words[j : len(words) - n + 1 + j]
        return mix64(total)


def bit_set(df: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """A bit map of fixed size of a hash modulo ``bits``: built by aggregation, 4 KB a row, never larger than bits / 8 bytes."""
    at = F.pmod(hashed, F.lit(bits))
    rows = (
        df.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit(32767)).alias("at"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("map"))
    )
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in rows.collect():
        out[row["bucket"] * 4096 : row["bucket"] * 4096 + 4096] = np.frombuffer(bytes(row["map"]), np.uint8)
    return out


def in_bit_set(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = np.mod(hashes, bits)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: [^\x20\x09-\x0D]: what is no white space; letters A-Z fold to a-z.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits of ASCII, and every byte of other scripts.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
