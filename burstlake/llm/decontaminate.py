"""Benchmark decontamination (operator 1): rare pairs of near words join passages to test items, Smith-Waterman alignment scores them.

Between two matches that follow each other, an alignment pays for every word it skips on the longer side, so one that
reaches the least score skips at most one word a side at most of them: it begins a pair of near words at ``need`` of an
item's places at least (a place: where a pair begins). Of any size - 1 - need + met places it therefore begins one at ``met``.
So only an item's rarest places in the documents, that many, are its seeds. Documents' seeds meet them in an equality join,
stretches of text with ``met`` places of an item are candidates, and only those are aligned, word by word. No alignment is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Alignment of words; a document holds an item from this share of the best possible score.
MATCH, MISMATCH, GAP, LEAST_SCORE = 2, -1, -1, 0.5
#: A pair of words is seen with this many steps from the first to the second, and as one pair whichever it is.
STEPS = (1, 2)
#: Seed places that a stretch must hold (fewer where an alignment need not have as many): each costs an item one more seed.
MET = 3
#: Words that are aligned at once; longer stretches are taken in overlapping pieces.
PIECE = 1 << 16
FOUND = "doc_id long, item_id long, score double, start int, end int"
ITEMS = "item long, item_id long, words binary, size int, need int, met int, span int, shift int"
STRETCH = "doc long, doc_id long, item long, low int, words binary, chars binary"
ALIGNED = "doc long, doc_id long, item long, item_id long, low int, score double, start int, end int"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = S.LOWER[data]
    starts, ends, first = S.word_spans(data, offsets, S.ALNUM)
    return S.word_hashes(data, starts, ends), starts, ends, first


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def pair_hashes(words: np.ndarray, step: int) -> np.ndarray:
    """A hash of each word and the one ``step`` words on (0: of the word alone)."""
    if not step:
        return S.gram_hashes(words, 1)
    with np.errstate(over="ignore"):
        return S.mix64(words[:-step] * np.uint64(0x9FB21C651E98DF25) + words[step:])


def demands(size: int, least: float) -> tuple[int, int, int]:
    """Of an item of ``size`` words: the places that an alignment of the least score has, the seed places asked for, and the words of text it spans."""
    # k matches score 2 k less at least the words skipped: with score 2 least size, under k - least size of the k - 1
    # steps skip two words or more, so least size - 1 skip fewer; and all lie in (3 - 2 least) size words of text
    need = max(int(np.ceil(least * size - 1 - 1e-9)), 1)
    return need, min(need, MET), max(int(np.ceil((3 - 2 * least) * size)), size) + 1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of two word sequences, and where it ends in ``text``.

    A row at a time; gaps along the row come from a running maximum.
    """
    best, end = 0, 0
    slope = -GAP * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    for word in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), 0)
        row = np.maximum(row, above + GAP)
        row = np.maximum.accumulate(row + slope) - slope
        above = row
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def _itemiser(least: float):
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data, offsets = S.utf8(batch.column(2))
            words, _, _, first = _words(data, offsets)
            for k, (item, item_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if size := int(first[k + 1] - first[k]):
                    need, met, span = demands(size, least)
                    out.append((item, item_id, words[first[k] : first[k + 1]].tobytes(), size, need, met, span, (span - 1).bit_length()))
            yield _batch(ITEMS, list(zip(*out, strict=True)) or [[]] * 8)

    return items


def _placer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, place, hash): the pairs that begin at each place of an item; an item of one word has that word."""
    for batch in batches:
        out = [[np.zeros(0, np.int64)] * 3]
        for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = np.frombuffer(raw, np.uint64)
            for step in STEPS if len(words) > 1 else (0,):
                pairs = pair_hashes(words, step).view(np.int64)
                out.append([np.full(len(pairs), item), np.arange(len(pairs)), pairs])
        yield _batch("item long, place int, hash long", [np.concatenate(c) for c in zip(*out, strict=True)])


def known_pairs(words: np.ndarray, first: np.ndarray, steps: tuple, known: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, hash) of the pairs of near words of each row that the bit map ``known`` may hold."""
    row_of, out = np.repeat(np.arange(len(first) - 1), np.diff(first)), []
    for step in steps:
        pairs = pair_hashes(words, step).view(np.int64)
        at = np.flatnonzero(S.in_bit_set(known, pairs, bits))
        at = at[row_of[at] == row_of[at + step]]
        out.append((row_of[at], at - first[row_of[at]], pairs[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _counter(steps: tuple, known: np.ndarray, bits: int):
    """(hash, n): known pairs of a batch of texts, counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.utf8(batch.column(0))
            for i, j in S.row_blocks(offsets):
                words, _, _, first = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes, n = np.unique(known_pairs(words, first, steps, known, bits)[2], return_counts=True)
                yield _batch("hash long, n long", [hashes, n])

    return count


def _seeker(steps: tuple, known: np.ndarray, bits: int, shift: int):
    """(doc, hash, cell): seeds of each text, each once a cell of 2 ** shift words."""

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            data, offsets = S.utf8(batch.column(1))
            for i, j in S.row_blocks(offsets):
                words, _, _, first = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row, at, hashes = known_pairs(words, first, steps, known, bits)
                cell = at >> shift
                order = np.lexsort((hashes, cell, row))
                row, cell, hashes = row[order], cell[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]) | (hashes[1:] != hashes[:-1])
                yield _batch("doc long, hash long, cell int", [docs[i:j][row[new]], hashes[new], cell[new]])

    return seek


def _fetcher(wanted: np.ndarray, bits: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(S.in_bit_set(wanted, batch.column(0).to_numpy(), bits)))

    return fetch


def stretches(cells: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of a text of ``size`` words, overlapping by a span, for (cell, shift, span) of one item: hits begin in that cell or the next."""
    merged: list[list[int]] = []
    for cell, shift, span in sorted(cells):
        low, high = max(0, (cell << shift) - span), min(size, ((cell + 2) << shift) + span)
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        elif low < high:
            merged.append([low, high])
    span = max((x[2] for x in cells), default=0)
    for low, high in merged:
        for a in range(low, max(low + 1, high - span), PIECE):
            yield a, min(high, a + PIECE + span)


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text that may hold an item: their words, and where those begin and end (characters of the text)."""
    for batch in batches:
        docs, ids, lists = (batch.column(k).to_pylist() for k in (0, 1, 3))
        data, offsets = S.utf8(batch.column(2))
        out, held = [], 0
        for k, cells in enumerate(lists):
            text = data[offsets[k] : offsets[k + 1]]
            words, starts, ends, _ = _words(text, np.array([0, len(text)]))
            chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)]).astype(np.int32)
            by_item: dict[int, list] = {}
            for c in cells:
                by_item.setdefault(c["item"], []).append((c["cell"], c["shift"], c["span"]))
            for item, own in by_item.items():
                for low, high in stretches(own, len(words)):
                    ranges = np.concatenate([chars[starts[low:high]], chars[ends[low:high]]])
                    out.append((docs[k], ids[k], item, low, words[low:high].tobytes(), ranges.tobytes()))
                    held += 16 * (high - low)
                    if held > S.BATCH_BYTES or len(out) >= S.BATCH_ROWS:
                        yield _batch(STRETCH, list(zip(*out, strict=True)))
                        out, held = [], 0
        if out:
            yield _batch(STRETCH, list(zip(*out, strict=True)))


def _aligner(least: float):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                item, text, chars = np.frombuffer(r["item_words"], np.uint64), np.frombuffer(r["words"], np.uint64), np.frombuffer(r["chars"], np.int32)
                if len(item) > 1:
                    here = np.concatenate([pair_hashes(text, step) for step in STEPS])
                    begun = np.isin(pair_hashes(item, 1), here)
                    begun[: len(item) - 2] |= np.isin(pair_hashes(item, 2), here)
                    if begun.sum() < r["need"]:
                        continue
                score, end = align(item, text)
                share = score / (MATCH * len(item))
                if share >= least:
                    back = align(item[::-1], text[:end][::-1])[1]
                    out.append((r["doc"], r["doc_id"], r["item"], r["item_id"], r["low"], share, int(chars[end - back]), int(chars[len(text) + end - 1])))
            yield _batch(ALIGNED, list(zip(*out, strict=True)) or [[]] * 8)

    return aligned


def _bits(n: int) -> int:
    """Bits of a map of n hashes: at most 16 MB, and at least 1."""
    return 1 << min(27, max(23, (64 * n).bit_length()))


def seeds(texts: DataFrame, items: DataFrame, steps: tuple) -> DataFrame:
    """(hash, item, place, met, span, shift): the pairs at each item's rarest places by the pairs' counts in all ``texts``; ties to earlier places."""
    places = S.stored(items.select("item", "words").mapInArrow(_placer, "item long, place int, hash long"), "places")
    bits = _bits(places.count())
    counts = texts.select("text").mapInArrow(_counter(steps, S.bit_set(places, F.col("hash"), bits), bits), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("item")
    seen = places.join(counts, "hash", "left").repartition("item").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("item", "place")))
    ranked = seen.withColumn("rank", F.dense_rank().over(own.orderBy("n", "place")))
    kept = F.greatest(F.col("size") - 1, F.lit(1)) - F.col("need") + F.col("met")
    return ranked.join(items.select("item", "size", "need", "met", "span", "shift"), "item").where(F.col("rank") <= kept).select("hash", "item", "place", "met", "span", "shift").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """A row for each document (doc_id, text) that holds a benchmark item (item_id, text), or an edited copy of it.

    doc_id, item_id, score (alignment score over the best possible, at least ``least``), start and end of the best alignment
    (characters of the document, end exclusive). Words are runs of letters and digits, A-Z lower-cased; null
    and empty texts hold nothing and are held by nothing. Repeated rows are reported each; equal items each
    by their own id. Other columns are ignored; with an empty table on either side the result is empty. No alignment is
    missed but those of a single word where ``least`` of an item is one word or less (items of two words: both are needed).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = S.stored(rows.mapInArrow(_itemiser(least), ITEMS), "items")
    known = items.agg(F.min("shift").alias("shift"), F.min("size").alias("size")).first()
    if known["size"] is None:
        return spark.createDataFrame([], FOUND)
    steps, shift = (*STEPS, *([0] if known["size"] == 1 else [])), known["shift"]
    wanted = S.stored(seeds(texts, items, steps), "seeds")
    bits = _bits(wanted.count())
    met = texts.select("doc", "text").mapInArrow(_seeker(steps, S.bit_set(wanted, F.col("hash"), bits), bits, shift), "doc long, hash long, cell int").join(wanted, "hash")
    # a cell of an item is as long as a stretch that one alignment spans, so its hits begin in one cell or in two that follow
    met = met.withColumn("cell", F.expr(f"shiftright(cell, shift - {shift})")).repartition("doc", "item")
    cells = met.groupBy("doc", "item", "cell", "met", "span", "shift").agg(F.collect_set("place").alias("places"))
    after = Window.partitionBy("doc", "item").orderBy("cell")
    both = F.when(F.lead("cell").over(after) == F.col("cell") + 1, F.array_union("places", F.lead("places").over(after))).otherwise(F.col("places"))
    enough = cells.withColumn("both", both).where(F.size("both") >= F.col("met"))
    candidates = S.stored(enough.groupBy("doc").agg(F.collect_list(F.struct("item", "cell", "shift", "span")).alias("cells")), "candidates")
    bits = _bits(candidates.count())
    # each step is stored: in one task three Python functions have three workers, and an executor keeps the idle ones of all its tasks
    fetched = S.stored(texts.mapInArrow(_fetcher(S.bit_set(candidates, F.col("doc"), bits), bits), "doc long, doc_id long, text string"), "fetched")
    cut = S.stored(fetched.join(candidates, "doc").select("doc", "doc_id", "text", "cells").mapInArrow(_cutter, STRETCH), "stretches")
    found = cut.join(items.select("item", "item_id", "need", F.col("words").alias("item_words")), "item").mapInArrow(_aligner(least), ALIGNED)
    # repeated rows have the same stretches: each is counted, and the best one is reported for each of them
    pair = ["doc", "doc_id", "item", "item_id"]
    once = found.groupBy(*pair, "low").agg(F.max(F.struct("score", (-F.col("end")).alias("end"), "start")).alias("best"), F.count("*").alias("n"))
    best = once.groupBy(*pair).agg(F.max("best").alias("best"), F.max("n").alias("n"))
    return best.select("doc_id", "item_id", F.col("best.score").alias("score"), F.col("best.start").alias("start"), (-F.col("best.end")).alias("end"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")
