"""SimHash near-duplicate detection (operator 12): fingerprints that differ in two bits at most, by deletion-variant keys.

A fingerprint is cut into two segments. Of two that differ in two bits at most, one segment differs in at most one, so
they share a variant of it with that bit taken out. Variants are keys of an equality join, and what meets is verified; a
link is accepted at one of its keys only. Keys that very many different fingerprints share are not joined: their
fingerprints look up each other by the masks of one and two bits instead, so that work stays linear either way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import components
from . import shared as S

#: Words to a shingle, the seed of their hash, and bits of a segment.
SHINGLE, SEED, HALF = 3, 42, 32
#: Different fingerprints that may share a key, before they look up their neighbours by masks.
CROWDED = 512
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in order, cut at white space after about a segment each."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + S.SEGMENT)
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8; a long one is taken piece by piece, with two words carried on."""
    counts, n, before = np.zeros(64, np.int64), 0, []
    for piece in _pieces(text):
        words = before + piece.lower().split()  # folds A-Z only, splits at \x20 and \x09-\x0D
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = (ends - [len(w) + 1 for w in words]).tolist()
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=False)], "<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
        before = words[1 - SHINGLE :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = S.utf8(batch.column(1))
        prints = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def variants(prints: DataFrame) -> DataFrame:
    """(key, print): a row for each bit of each segment, with the segment that is left when the bit is taken out."""
    half = F.when(F.col("bit") < HALF, F.col("print")).otherwise(F.shiftrightunsigned("print", HALF)).bitwiseAND(F.lit((1 << HALF) - 1))
    rest = half.bitwiseAND(F.expr(f"~shiftleft(1L, bit % {HALF})"))
    rows = prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1))).alias("bit"))
    return rows.select(F.shiftleft(F.col("bit").cast("long"), HALF).bitwiseOR(rest).alias("key"), "print")


#: In SQL over a key and two prints: they link, and this is the one key at which the link is accepted.
_BIT, _X = f"(shiftright(key, {HALF}) % {HALF})", "(a ^ b)"
_OWN = f"(shiftright({_X}, cast({HALF} * shiftright(key, {HALF + 5}) as int)) & {(1 << HALF) - 1}L)"
_OTHER = f"(shiftright({_X}, cast({HALF} * (1 - shiftright(key, {HALF + 5})) as int)) & {(1 << HALF) - 1}L)"
ACCEPTED = f"""a < b and bit_count({_X}) <= 2 and case
  when {_OWN} = 0 then {_BIT} = 0 and bit_count({_OTHER}) = 2
  else {_OWN} = shiftleft(1L, cast({_BIT} as int)) and (shiftright(key, {HALF + 5}) = 0 or {_OTHER} = 0) end"""


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of distinct ``prints`` that differ in one or two bits."""
    keys = variants(prints)
    crowded = S.stored(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key"), "crowded")
    some = not crowded.isEmpty()
    rows = keys.join(crowded, "key", "left_anti") if some else keys
    found = rows.select("key", F.col("print").alias("a")).hint("merge").join(rows.select("key", F.col("print").alias("b")), "key").where(ACCEPTED).select("a", "b")
    if some:
        among = S.stored(keys.join(crowded, "key", "left_semi").select("print").distinct(), "crowded-prints")
        signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
        masks = [signed(1 << i) for i in range(64)] + [signed(1 << i | 1 << j) for i, j in combinations(range(64), 2)]
        near = F.explode(F.transform(F.lit(masks), lambda mask: F.col("print").bitwiseXOR(mask))).alias("b")
        asked = among.select(F.col("print").alias("a"), near).where("a < b")
        found = found.union(asked.join(among.select(F.col("print").alias("b")), "b").select("a", "b"))
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased; shingles of three words, repeats included (fewer
    words: the whole sequence). A bit is set if it is in over half of the shingles' hashes. Fingerprints that differ in two bits
    at most are linked, and component_id is the least doc_id reachable. Null or empty text, or no word: zero, linked like any
    other. Null doc_id: takes part, but is no component_id (null if the component has no other). Repeated rows and equal
    fingerprints are one class, whatever their number. A very long text is taken in pieces. Other columns are ignored.
    An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = S.stored(texts.mapInArrow(_fingerprinted, "doc_id long, print long"), "prints")
    classes = S.stored(found.groupBy("print").agg(F.min("doc_id").alias("least")), "classes", found.count())
    edges = S.stored(links(classes.select("print")), "links")
    joined = components(edges, lambda df: S.stored(df, "labels")).select(F.col("v").alias("print"), "component")
    labelled = S.stored(classes.join(joined, "print", "left").select("print", "least", F.coalesce("component", "print").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "label").select("print", "component_id")
    return found.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
