"""Best-fit packing of tokenised documents by exact complements (operator 8).

Lengths have a small range, so the plan is made on their histogram: for each length, gaps are looked up among
the sums of one, two and three lengths that are still available; a combination that fills a gap exactly is
used as often as its counts allow, and what is left is packed by best fit. A piece finds its place from its
rank among the pieces of its length, which comes from counts by task: no length is gathered in one place.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Tokens of a sequence, the id that ends a document, words kept in a worker's table of ids.
SIZE, END, TABLE = 2048, 0, 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _merged(token: str, end: str, order: dict[tuple[str, str], int]) -> list[str]:
    """The symbols that ``token`` becomes, merging pairs by their order."""
    ended = token.endswith(end) and token != end
    parts = list(token[: -len(end)] if ended else token)
    if ended:
        parts[-1] += end
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: order.get((parts[k], parts[k + 1]), len(order)))
        if (parts[best], parts[best + 1]) not in order:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def ranks_of(path: str) -> tuple[dict[bytes, int] | None, dict[int, int]]:
    """The merges of a tokenizer as ranks, and the ids of the ranks; none if it is of a kind that ranks do not express.

    Made once, by the driver; tasks get it as a broadcast, which the vocabulary bounds.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    end = spec["model"].get("end_of_word_suffix")
    if spec["model"].get("type") != "BPE" or not end:
        return None, {}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec["added_tokens"]}
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    tokens = [t for t in spec["model"]["vocab"] if t not in special]
    if any(c not in of for t in tokens for c in t.removesuffix(end)):
        return None, {}

    def raw(token: str) -> bytes:
        ended = token.endswith(end) and token != end
        return bytes(of[c] for c in (token[: -len(end)] if ended else token)) + b"\xff" * ended

    ids = {raw(t): spec["model"]["vocab"][t] for t in tokens}
    ranks = {bytes([b]): b for b in range(256)}
    for b in range(255):
        if bytes([b, 255]) in ids:
            ranks[bytes([b, 255])] = len(ranks)
    for a, b in merges:
        if raw(a).endswith(b"\xff") or raw(a) + raw(b) in ranks:
            return None, {}
        ranks[raw(a) + raw(b)] = len(ranks)
    # BPE by merges and by ranks agree if each token, taken alone, becomes itself: then no other split of it can stand
    order = {m: k for k, m in enumerate(merges)}
    if any(_merged(t, end, order) != [t] for t in tokens):
        return None, {}
    return ranks, {r: ids.get(b, -1) for b, r in ranks.items()}


class Ids:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers, equal to those of ``tokenizers``.

    The tokenizer drops white space, so words are independent, and most come again. Texts in Latin-1 letters
    are split into words by the tokenizer's own pattern, and new words are merged by a fast engine that is
    given the merges as ranks; that engine is equal if every token of the vocabulary encodes to itself, which
    is checked when the ranks are made. All other texts, and all texts if the check fails, go to ``tokenizers``.
    """

    _LETTER, _DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
    _WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
    _OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]|<\|")

    def __init__(self, path: str, ranks: dict[bytes, int] | None, id_of: dict[int, int]):
        self.path, self.id_of = path, id_of
        self.table: dict[str, bytes] = {}
        self.engine = None
        if ranks:
            import tiktoken

            self.engine = tiktoken._tiktoken.CoreBPE(ranks, {}, r".+")

    @cached_property
    def full(self):
        """The tokenizer itself: most tasks never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing_word(self, word: str) -> bytes:
        ids = [self.id_of[r] for r in self.engine.encode_single_piece(word.encode() + b"\xff")]
        out = np.array(ids, "<u4").tobytes() if min(ids) >= 0 else np.array(self.full.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.table) >= TABLE:
            self.table.clear()
        self.table[word] = out
        return out

    def of(self, text: str) -> bytes:
        if self.engine is None or self._OTHER.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, new = self.table.get, self.__missing_word
        return b"".join([get(w) or new(w) for w in self._WORD.findall(text.lower())])


_made: dict[str, Ids] = {}


def _ids(path: str, made) -> Ids:
    if path not in _made:
        _made[path] = Ids(path, *made.value)
    return _made[path]


def _cutter(path: str, made, size: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _ids(path, made).of, TaskContext.get().partitionId()
        count = np.zeros(size + 1, np.int64)
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + stop
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    n = len(part) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(part), count[n]))
                    count[n] += 1
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
            arrays = [pa.array(list(map(int, c)) if k else list(c), t) for k, (c, t) in enumerate(zip(cols, kinds, strict=True))]
            arrays.insert(5, pa.array(np.full(len(out), task, np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return cut


def best_combination(left: np.ndarray, gap: int) -> tuple[int, ...]:
    """One to three available lengths with the greatest sum up to ``gap``; the longest of them first, () if none fits."""
    if gap < 1:
        return ()
    there = (left[: gap + 1] > 0).astype(float)
    there[0] = 0
    if not there.any():
        return ()
    size = 1 << int(4 * gap + 4).bit_length()
    f = np.fft.rfft(there, size)
    two = np.fft.irfft(f * f, size)[: gap + 1] > 0.5
    three = np.fft.irfft(np.fft.rfft(two.astype(float), size) * f, size)[: gap + 1] > 0.5
    lengths = np.flatnonzero(there)[::-1]
    for total in np.flatnonzero((there > 0) | two | three)[::-1].tolist():
        if there[total]:
            return (total,)
        if two[total]:
            for a in lengths[(lengths < total) & (2 * lengths >= total)].tolist():
                b = total - a
                if left[b] > (a == b):
                    return a, b
        if three[total]:
            for a in lengths[lengths < total].tolist():
                rest = total - a
                if two[rest]:
                    for b in lengths[(lengths < rest) & (2 * lengths >= rest) & (lengths <= a)].tolist():
                        c = rest - b
                        if left[b] > (a == b) and left[c] > (a == c) + (b == c):
                            return a, b, c
    return ()


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths go together, and how many times, for a histogram of lengths 1 to ``size``.

    First exact complements, from the longest length down; then best fit of what is left, longest first.
    """
    left, out = counts.astype(np.int64).copy(), []

    def use(lengths: tuple[int, ...]) -> None:
        times = min(int(left[n]) // k for n, k in Counter(lengths).items())
        for n in lengths:
            left[n] -= times
        out.append((lengths, times))

    if left[size]:
        use((size,))
    for longest in range(size - 1, 0, -1):
        while left[longest] > 0:
            left[longest] -= 1
            rest = best_combination(left, size - longest)
            left[longest] += 1
            if sum(rest) != size - longest:
                break
            use((longest, *rest))
    for longest in range(size - 1, 0, -1):
        while left[longest] > 0:
            lengths, used = (longest,), left.copy()
            used[longest] -= 1
            while more := best_combination(used, size - sum(lengths)):
                lengths += more
                for n in more:
                    used[n] -= 1
            use(lengths)
    return out


def _placer(length: np.ndarray, first: np.ndarray, sequence: np.ndarray, offset: np.ndarray):
    """Plan rows sorted by (length, first rank): a rank finds the last row that begins at or before it."""
    key = length << 42

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(key + first, (n << 42) + rank, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids, then ``end``; a null text counts as empty, so every row has at least one piece.
    Documents over ``size`` ids are cut into pieces of ``size``, and only they. Repeated rows are packed each; a null doc_id
    stays null; other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = tokenizer or default_tokenizer()
    made = spark.sparkContext.broadcast(ranks_of(path))
    pieces = S.stored(texts.mapInArrow(_cutter(path, made, size, end), PIECES), "pieces")
    by_task = pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = pieces.join(before.drop("n"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("task", "before", "nth")
    counts = np.zeros(size + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    rows, used, sequences = [], np.zeros(size + 1, np.int64), 0
    for lengths, times in plan(counts, size):
        at = 0
        for n in lengths:
            rows.append((n, used[n], sequences, at))
            used[n] += times
            at += n
        sequences += times
    if not rows:
        return spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    table = np.array(sorted(rows), np.int64).T
    return ranked.mapInArrow(_placer(*table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
