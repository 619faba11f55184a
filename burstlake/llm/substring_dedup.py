"""Substring deduplication by content-defined chunks (operator 2).

A gear hash over the last 16 bytes cuts every text where its value is small, so a cut depends on nothing
further away and an insertion moves the cuts around it only. Neighbouring chunks are digested in pairs; a
pair that lies in two documents is repeated, and runs of repeated pairs are the repeated passages, broken where
the document that held them first is another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: The least, and (if no cut is found) the most bytes of a chunk; one byte in RATE is a cut.
LEAST, MOST, RATE = 12, 128, 20
#: Characters that a repeated run must cover. Its two ends lie a chunk or so inside the passage.
MIN_CHARS = 100
_GEAR = (S.mix64(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(40)).astype(np.uint16)
PAIRS = "doc_id long, text_id long, pair long, idx int, start int, end int"


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + GEAR[byte] modulo 2^16 after each byte, by doubling windows of 1, 2, 4, 8, 16 bytes."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint16(width)
        h = h + older
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """The ends of the chunks of one text; the last is its length. Cuts lie between whole characters."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    found = []
    for low in range(0, n, S.SEGMENT):  # each segment with the bytes that its hashes need
        back = max(0, low - 16)
        found.append(np.flatnonzero(gear(data[back : low + S.SEGMENT])[low - back :] < 65536 // RATE) + low + 1)
    at = np.concatenate(found)
    at = at[(at >= 16) & (at < n)]
    at = at[(data[at] & 0xC0) != 0x80]
    at = at[np.diff(at, prepend=-LEAST) >= LEAST]
    at = np.append(at, n)
    wide = np.flatnonzero(np.diff(at, prepend=0) > MOST)
    if len(wide):
        more = []
        for k in wide.tolist():
            p = (int(at[k - 1]) if k else 0) + MOST
            while p < at[k]:
                while p < at[k] and data[p] & 0xC0 == 0x80:
                    p += 1
                more.append(p)
                p += MOST
        at = np.unique(np.concatenate([at, more]))
    return at.astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = S.utf8(batch.column(1))
        ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, j in S.row_blocks(offsets):
            parts = []
            for row in range(i, j):
                text = data[offsets[row] : offsets[row + 1]]
                ends = cuts(text)
                if len(ends) < 2:
                    continue
                starts = np.concatenate([[0], ends[:-1]])
                digests = S.word_hashes(text, starts, ends)
                with np.errstate(over="ignore"):
                    pair = S.mix64(digests[:-1] * np.uint64(0x9FB21C651E98DF25) + digests[1:])
                chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80, dtype=np.int32)])
                parts.append((np.full(len(pair), ids[row]), np.full(len(pair), texts[row]), pair.view(np.int64), np.arange(len(pair)), chars[starts[:-1]], chars[ends[1:]]))
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if k < 3 else np.int32)) for k, c in enumerate(cols)], names=["doc_id", "text_id", "pair", "idx", "start", "end"])


def repeated_passages(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each passage of ``docs`` (doc_id, text) that lies in another document too.

    doc_id, start and end (characters, end exclusive), first_doc (the least doc_id that holds it), original (doc_id is
    first_doc: this one stays if repeats are cut), and text_id, a hash of the text that start and end count in. A run of passages that follow each other
    counts from ``min_chars`` on, however short its passages; but what an earlier document holds within an original
    passage is cut out of it from ``min_chars`` on only, and belongs to it otherwise. Passages that follow each other
    overlap by a chunk. Null or empty texts have none. Rows without doc_id take no part; rows with the same doc_id are one
    document: its texts do not repeat themselves or each other, each is reported on its own, and equal rows once. A very long
    text is hashed in segments. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = texts.withColumn("text_id", F.xxhash64("text")).mapInArrow(_pairs, PAIRS)
    held = pairs.groupBy("pair").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
    # stored, so that a pair which very many texts hold is met by shuffled rows on both sides, which Spark can split
    own = ["doc_id", "text_id"]
    order = Window.partitionBy(*own).orderBy("idx", "first_doc")
    repeated = pairs.join(S.stored(held, "held"), "pair")
    repeated = repeated.withColumn("again", F.lag("idx").over(order)).where("again is null or again <> idx").drop("again")  # equal rows
    apart = F.coalesce(F.col("idx") - F.lag("idx").over(order) > 1, F.lit(True))
    begins = repeated.withColumn("apart", apart).withColumn("begins", F.col("apart") | (F.col("first_doc") != F.lag("first_doc").over(order)))
    parts = begins.withColumn("part", F.sum(F.col("begins").cast("int")).over(order)).groupBy(*own, "part")
    parts = parts.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc").alias("first_doc"), F.bool_or("apart").alias("apart"))
    order = Window.partitionBy(*own).orderBy("part")
    chars = lambda c: F.max("end").over(Window.partitionBy(*own, c)) - F.min("start").over(Window.partitionBy(*own, c))
    changes = lambda c: (F.col("apart") | (F.col(c) != F.lag(c).over(order))).cast("int")
    parts = parts.withColumn("own", F.col("doc_id") == F.col("first_doc")).withColumn("turn", changes("own"))
    parts = parts.withColumns({"run": F.sum(F.col("apart").cast("int")).over(order), "stretch": F.sum("turn").over(order)})
    parts = parts.withColumns({"chars": chars("run"), "stays": F.col("own") | (chars("stretch") < min_chars)}).where(F.col("chars") >= min_chars)
    parts = parts.withColumn("turn", F.when(F.col("stays"), changes("stays")).otherwise(1)).withColumn("span", F.sum("turn").over(order))
    spans = parts.groupBy(*own, "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc").alias("first_doc"), F.bool_or("stays").alias("original"))
    return spans.select("doc_id", "start", "end", F.when(F.col("original"), F.col("doc_id")).otherwise(F.col("first_doc")).alias("first_doc"), "original", "text_id")


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the passages cut out that an earlier document holds; other columns and rows stay as they are."""
    cut, text_id = S.fresh(docs, "cut"), S.fresh(docs, "text_id")
    spans = repeated_passages(docs, min_chars).where("not original").groupBy("doc_id", F.col("text_id").alias(text_id)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    joined = docs.withColumn(text_id, F.xxhash64(F.col("text").cast("string"))).join(spans, ["doc_id", text_id], "left")
    kept = F.expr(
        f"aggregate({cut}, struct(0 as at, '' as out), (s, c) -> struct(greatest(s.at, c.end) as at, "
        "concat(s.out, substring(text, s.at + 1, greatest(c.start - s.at, 0))) as out), s -> concat(s.out, substring(text, s.at + 1)))"
    )
    return joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)).select(docs.columns)
