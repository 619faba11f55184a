"""Language identification by prediction by partial matching (operator 9).

For every language a byte model of orders 3 to 0 with escapes (method C) is counted on a bounded sample and
frozen. A text's code length under each model is exact: for every byte the code of the longest context in
which it was seen, and the escapes that lead there. The shortest code names the language.

Bytes are folded into at most 62 symbols (A-Z as a-z; the most frequent bytes of the sample) and a rest, whose
bytes share one; what stands before a text's first byte is a symbol of its own. Four symbols then address a
table directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Documents of each language that the sample is to have (expected number, by the hash of their id).
ROWS = 1500
ORDER, BITS = 3, 6
#: Languages to a file of their counts.
FILE_LANGS = 10_000
#: Symbols of what stands before a text, and of rare bytes.
BEFORE, RARE = 0, 1
#: Sequences of the highest order that were seen less often are left to the shorter orders, which count all.
LEAST = 2
PREDICTED = "doc_id long, lang_pred string, score double, bits_per_byte double"


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    symbol: np.ndarray | None = None
    #: By order: sorted codes of (context, symbol) and their code lengths (codes x languages); escapes by context.
    codes: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    contexts: list = field(default_factory=list)
    escapes: list = field(default_factory=list)


def symbols(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, each row after ORDER symbols BEFORE, and where the rows begin (at those)."""
    at = offsets + ORDER * np.arange(len(offsets))
    out = np.zeros(int(at[-1]), np.uint32)
    where = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(offsets)), np.diff(offsets))
    out[where] = fold[S.LOWER[data]]
    return out, at


def _grams(sym: np.ndarray, order: int) -> np.ndarray:
    """For each symbol from ORDER on, the code of it with ``order`` symbols before it."""
    n = len(sym) - ORDER
    code = np.zeros(n, np.uint32)
    for back in range(order, -1, -1):
        code = (code << np.uint32(BITS)) | sym[ORDER - back : ORDER - back + n]
    return code


def _counter(fold: np.ndarray, langs: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(langs)}
        for batch in batches:
            which = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            data, offsets = S.utf8(batch.column("text"))
            for i, j in S.row_blocks(offsets):
                sym, at = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold)
                row = np.searchsorted(at, np.arange(ORDER, len(sym)), "right") - 1
                real = np.arange(ORDER, len(sym)) - at[row] >= ORDER
                key = (which[i:j][row[real]] << 32) | _grams(sym, ORDER)[real]
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return count


def freeze(langs: list[str], fold: np.ndarray, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """Code lengths of all seen (context, symbol) pairs and escapes of all contexts, from the counts (lang, gram, n) of each order from 0 on."""
    model = Model(langs, fold)
    count = len(langs)
    # order -1: every symbol alike
    below = np.full((1 << BITS, count), BITS, float)
    for order, (lang, gram, n) in enumerate(orders):
        codes, inverse = np.unique(gram, return_inverse=True)
        seen = np.zeros((len(codes), count))
        np.add.at(seen, (inverse, lang), n)
        contexts, of = np.unique(codes >> BITS, return_inverse=True)
        total, kinds = np.zeros((len(contexts), count)), np.zeros((len(contexts), count))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(seen / (total + kinds)[of])
        if order == 0:
            shorter = below[codes & ((1 << BITS) - 1)]
        else:
            low = np.searchsorted(model.codes[-1], codes & ((1 << (BITS * order)) - 1))
            shorter = model.lengths[-1][low]
        length = np.where(seen > 0, own, escape[of] + shorter)
        model.codes.append(codes.astype(np.uint32))
        model.lengths.append(length)
        model.contexts.append(contexts.astype(np.uint32))
        model.escapes.append(escape)
    return model


class _Tables:
    """The frozen model as tables that a code addresses directly (made once for a task)."""

    def __init__(self, model: Model):
        count = len(model.langs)
        self.model = model
        # orders 0 and 1 in full; order 2 and 3 by an index of what was seen
        zero = np.full((1 << BITS, count), BITS, float) + (model.escapes[0][0] if len(model.contexts[0]) else 0)
        zero[model.codes[0]] = model.lengths[0]
        one = np.tile(zero, (1 << BITS, 1))
        escape = np.zeros((1 << BITS, count))
        escape[model.contexts[1]] = model.escapes[1]
        one += np.repeat(escape, 1 << BITS, axis=0)
        one[model.codes[1]] = model.lengths[1]
        escape = np.zeros((1 << (2 * BITS), count))
        escape[model.contexts[2]] = model.escapes[2]
        two = np.tile(one, (1 << BITS, 1)) + np.repeat(escape, 1 << BITS, axis=0)
        two[model.codes[2]] = model.lengths[2]
        self.two = np.ascontiguousarray(two.astype(np.float32).T)
        self.escape = np.zeros((count, 1 << (3 * BITS)), np.float32)
        self.escape[:, model.contexts[3]] = model.escapes[3].T
        self.index = np.full(1 << (4 * BITS), -1, np.int32)
        self.index[model.codes[3]] = np.arange(len(model.codes[3]), dtype=np.int32)
        self.three = np.ascontiguousarray(model.lengths[3].astype(np.float32).T)

    def bits(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each row (rows x languages), a segment at a time."""
        out = np.zeros((len(at) - 1, len(self.model.langs)))
        for low in range(0, len(sym) - ORDER, S.SEGMENT):
            part = sym[low : low + S.SEGMENT + ORDER]
            code = _grams(part, ORDER)
            k = self.index[code]
            new = np.flatnonzero(k < 0)
            k[new] = 0
            place = np.arange(low + ORDER, low + ORDER + len(code))
            first = int(np.searchsorted(at, place[0], "right")) - 1
            last = int(np.searchsorted(at, place[-1], "right")) - 1
            heads = np.concatenate([[0], at[first + 1 : last + 1] - place[0]])
            pad = np.unique(np.clip((at[first : last + 1, None] + np.arange(ORDER)).ravel() - place[0], -1, len(code)))
            pad = pad[(pad >= 0) & (pad < len(code))]
            for g in range(out.shape[1]):
                cost = self.three[g][k] if self.three.shape[1] else np.zeros(len(code), np.float32)
                cost[new] = self.escape[g][code[new] >> np.uint32(BITS)] + self.two[g][code[new] & np.uint32((1 << (3 * BITS)) - 1)]
                cost[pad] = 0
                out[first : last + 1, g] += np.add.reduceat(cost, heads, dtype=np.float64)
        return out


def learned(docs: DataFrame, rows: int = ROWS) -> Model:
    """A model from ``docs`` (doc_id, text, lang) that crc32(doc_id) mod 3 does not hold out, about ``rows`` of each lang.

    Null and empty texts teach nothing. There is a model for each lang, and so its size follows their number; what reaches the driver are counts,
    at most 2^18 a language for the lower orders, and for the highest the sequences of four that the sample has twice.
    """
    may = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    there = S.stored(may.groupBy("lang").agg(F.count("*").alias("_n")), "langs", FILE_LANGS)
    langs = sorted(r["lang"] for r in there.select("lang").collect())
    if not langs:
        return Model()
    share = F.least(F.lit(1.0), rows / F.col("_n")) * (1 << 20)
    picked = may.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where("text is not null and text <> ''").join(there, "lang")
    picked = picked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("lang", "text")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            data, _ = S.utf8(batch.column("text"))
            total += np.bincount(data, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    often = np.zeros(256, np.int64)
    for r in picked.select("text").mapInArrow(histogram, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        often[S.LOWER[r["byte"]]] += r["n"]
    best = np.lexsort((np.arange(256), -often))[: (1 << BITS) - 2]
    fold = np.full(256, RARE, np.uint32)
    fold[best[often[best] > 0]] = np.arange(2, (often[best] > 0).sum() + 2)
    counted = S.stored(picked.mapInArrow(_counter(fold, langs), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    orders = []
    for order in range(ORDER + 1):
        short = counted.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        table = (short if order < ORDER else counted.where(F.col("n") >= LEAST)).toArrow()
        orders.append((table.column("lang").to_numpy().astype(np.int64), table.column("gram").to_numpy(), table.column("n").to_numpy()))
    return freeze(langs, fold, orders) if len(orders[0][0]) else Model()


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(model) if model.langs else None
        for batch in batches:
            data, offsets = S.utf8(batch.column(1))
            letters = batch.column(2).to_pylist()
            for i, j in S.row_blocks(offsets):
                size = np.diff(offsets[i : j + 1])
                pred, score, per = ["und"] * (j - i), np.zeros(j - i), np.zeros(j - i)
                if tables is not None:
                    sym, at = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.symbol)
                    bits = tables.bits(sym, at) if len(sym) > ORDER else np.zeros((j - i, len(model.langs)))
                    best = bits.argmin(1)
                    with np.errstate(over="ignore", under="ignore"):
                        p = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                    for r in range(j - i):
                        if letters[i + r]:
                            pred[r], score[r], per[r] = model.langs[best[r]], p[r], bits[r, best[r]] / max(1, size[r])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score), pa.array(per)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return predict


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score, bits_per_byte.

    score is the posterior of lang_pred with equal priors. Null text, a text without a letter, or a model
    without languages: ``und`` and 0. held_out (null for a null doc_id) is crc32(doc_id) mod 3 = 1. Ties go to
    the lesser name. Repeated rows are predicted each; other columns are ignored.
    """
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    found = asked.mapInArrow(_predictor(model), PREDICTED)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")
