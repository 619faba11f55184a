"""Target-distribution importance resampling (operator 11) over bucket-partitioned inverted postings.

Runs of one to three words are hashed to buckets. Both corpora's counts of a bucket meet in one group, which gives the
bucket's gain. Documents are inverted block by block: postings (document of the block, count) of a range of buckets are one
packed row, shuffled by range, so that a range's postings meet its gains where they lie; each row gives the sums of its
documents, and those are reduced by document. A range is dealt to as many groups as its postings need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Buckets, words of the longest feature, buckets to a range (a row of postings holds one range).
BUCKETS, LONGEST, WIDTH = 10_000, 3, 313
#: Documents and bytes of text to a block; keys that are pending before they are summed; features to a shuffled group.
BLOCK_DOCS, BLOCK_BYTES, PENDING, GROUP = 4096, 4 << 20, 1 << 21, 1 << 22
#: Words of a document that may be drawn, the share that is drawn in percent, and the seed.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
_DOC = BLOCK_DOCS.bit_length() - 1
#: Of what is packed, values from here on stand apart.
_BIG = 255


class _Crc:
    """CRC-32 of many words at once: the CRC of two strings joined is that of the first, moved on by the second's length, xor that of the second."""

    def __init__(self) -> None:
        value = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
        self.byte = value
        basis = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        near = [basis]
        for _ in range(64):
            near.append(self.byte[near[-1] & 0xFF] ^ (near[-1] >> np.uint32(8)))
        self.near = np.stack(near[:64])  # moved on by 0 to 63 bytes
        self.far, step = [], near[64]
        for _ in range(26):  # moved on by 64, 128, ... bytes
            self.far.append(step)
            step = self._by(step, step)

    @staticmethod
    def _by(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]

    def moved(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each CRC, moved on by ``n`` bytes."""
        low = n & 63
        out = self.near[low, 0, crc & 0xFF] ^ self.near[low, 1, (crc >> 8) & 0xFF] ^ self.near[low, 2, (crc >> 16) & 0xFF] ^ self.near[low, 3, crc >> 24]
        for k, table in enumerate(self.far):
            if not (n >> (6 + k)).any():
                break
            on = np.flatnonzero((n >> (6 + k)) & 1)
            out[on] = self._by(table, out[on])
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The CRC of each span of ``data``."""
        state, size = np.full(len(starts), 0xFFFFFFFF, np.uint32), ends - starts
        short = np.flatnonzero(size <= 64)
        for j in range(int(size[short].max(initial=0))):
            short = short[size[short] > j]
            state[short] = self.byte[(state[short] ^ data[starts[short] + j]) & 0xFF] ^ (state[short] >> np.uint32(8))
        out = state ^ np.uint32(0xFFFFFFFF)
        for k in np.flatnonzero(size > 64).tolist():
            out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes())
        return out


_made: list[_Crc] = []
_SPACE = zlib.crc32(b" ")


def _crc() -> _Crc:
    if not _made:
        _made.append(_Crc())
    return _made[0]


def features(data: np.ndarray, offsets: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each feature of the rows, the words of each row, and where they begin. Of a single row, features that end in its first ``skip`` words are left out."""
    data = S.LOWER[data]
    starts, ends, first = S.word_spans(data, offsets, S.ALNUM)
    crc = _crc()
    words, row = crc.words(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    spaced = crc.moved(np.full(len(words), _SPACE, np.uint32), ends - starts) ^ words
    rows, found, last = [], [], words
    for n in range(LONGEST):
        if n:
            last = crc.moved(last[:-1], ends[n:] - starts[n:] + 1) ^ spaced[n:]
        same = row[n:] == row[: len(row) - n]
        same[: max(0, skip - n)] = False
        rows.append(row[n:][same])
        found.append(last[same] % np.uint32(BUCKETS))
        if len(last) < 2:
            break
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), np.diff(first), starts


def _long(text: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of a long text's features and its words, piece by piece; each piece begins two words early."""
    at, stop, skip = 0, 0, 0
    while stop < len(text):
        stop += S.SEGMENT
        while stop < len(text) and S.ALNUM[text[stop]]:
            stop += 1
        piece = text[at:stop]
        _, found, words, starts = features(piece, np.array([0, len(piece)]), skip)
        yield found, int(words[0]) - skip
        skip = min(LONGEST - 1, len(starts))
        at = at + int(starts[-skip]) if skip else stop


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = S.utf8(batch.column(0))
        for i, j in S.row_blocks(offsets):
            part = data[offsets[i] : offsets[j]]
            if len(part) > 2 * S.SEGMENT:
                for found, _ in _long(part):
                    total += np.bincount(found, minlength=BUCKETS)
            else:
                total += np.bincount(features(part, offsets[i : j + 1] - offsets[i])[1], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def counts(texts: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): features of all ``texts`` (one column) in each bucket; a task gives each bucket once."""
    return texts.mapInArrow(_counter, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def packed(values: np.ndarray) -> bytes:
    """Small values as bytes, larger ones apart."""
    big = values[values >= _BIG].astype(np.int64)
    return np.array([len(values), len(big)], np.int64).tobytes() + np.minimum(values, _BIG).astype(np.uint8).tobytes() + big.tobytes()


def unpacked(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, big = np.frombuffer(data, np.int64, 2, at).tolist()
    values = np.frombuffer(data, np.uint8, n, at + 16).astype(np.int64)
    at += 16 + n
    values[values == _BIG] = np.frombuffer(data, np.int64, big, at)
    return values, at + 8 * big


class _Inverter:
    """Gathers documents to a block, and gives its rows: range -1 holds the documents' ids and words, the others the postings of each range."""

    def __init__(self) -> None:
        self.base, self.made, self.squeeze = TaskContext.get().partitionId() << 33, 0, zstandard.ZstdCompressor(level=1)
        self._clear()

    def _clear(self) -> None:
        self.ids: list[pa.Array] = []
        self.words: list[np.ndarray] = []
        self.keys, self.sums, self.pending, self.docs, self.bytes = [], [], 0, 0, 0

    def add(self, rows: np.ndarray, buckets: np.ndarray) -> None:
        self.keys.append(buckets << _DOC | (rows + self.docs))
        self.sums.append(np.ones(len(rows), np.int64))
        self.pending += len(rows)
        if self.pending > PENDING:
            self._sum()

    def _sum(self) -> None:
        keys, where = np.unique(np.concatenate([*self.keys, np.zeros(0, np.int64)]), return_inverse=True)
        self.sums = [np.bincount(where, np.concatenate([*self.sums, np.zeros(0, np.int64)]), len(keys)).astype(np.int64)]
        self.keys, self.pending = [keys], 0

    def close(self, ids: pa.Array, words: np.ndarray, size: int) -> None:
        self.ids.append(ids)
        self.words.append(words)
        self.docs += len(ids)
        self.bytes += size

    def full(self, more: int, size: int) -> bool:
        return self.docs > 0 and (self.docs + more > BLOCK_DOCS or self.bytes + size > BLOCK_BYTES)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        self._sum()
        keys, sums = self.keys[0], self.sums[0]
        ids = pa.concat_arrays(self.ids)
        head = ids.fill_null(0).to_numpy().astype(np.int64).tobytes() + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() + np.concatenate(self.words).astype(np.int64).tobytes()
        ranges, data = [-1], [self.squeeze.compress(head)]
        for r in range(-(-BUCKETS // WIDTH)):
            low = r * WIDTH << _DOC
            i, j = np.searchsorted(keys, [low, low + (WIDTH << _DOC)])
            if i < j:
                ranges.append(r)
                data.append(self.squeeze.compress(packed(np.diff(keys[i:j], prepend=low)) + packed(sums[i:j])))
        block = self.base + self.made
        self.made += 1
        self._clear()
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([block] * len(ranges), pa.int64()), pa.array(data, pa.binary())], names=["range", "block", "data"])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Inverter()
    for batch in batches:
        data, offsets = S.utf8(batch.column(1))
        for i, j in S.row_blocks(offsets):
            for i, j in ((k, min(j, k + BLOCK_DOCS)) for k in range(i, j, BLOCK_DOCS)):  # noqa: B007, PLW2901
                part = data[offsets[i] : offsets[j]]
                if block.full(j - i, len(part)):
                    yield from block.rows()
                if len(part) > 2 * S.SEGMENT:
                    words = 0
                    for found, more in _long(part):
                        block.add(np.zeros(len(found), np.int64), found)
                        words += more
                    words = np.array([words])
                else:
                    rows, found, words, _ = features(part, offsets[i : j + 1] - offsets[i])
                    block.add(rows, found)
                block.close(batch.column(0).slice(i, j - i), words, len(part))
    yield from block.rows()


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, part, data): the ids and words of a block as they came (part 0), and sums of gains by document (part 1)."""
    squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for batch in batches:
        kinds, out = [], []
        for r, data, first, gains in zip(*(batch.column(c) for c in ("range", "data", "first", "gains")), strict=True):
            kinds.append(int(r.as_py() >= 0))
            if not kinds[-1]:
                out.append(data.as_py())
                continue
            raw = expand.decompress(data.as_py())
            steps, at = unpacked(raw, 0)
            sums, _ = unpacked(raw, at)
            keys = np.cumsum(steps)
            # first bucket of the gains is the range's own
            gain = gains.values.to_numpy()[(keys >> _DOC)]
            out.append(squeeze.compress(np.bincount(keys & (BLOCK_DOCS - 1), gain * sums).astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], names=["block", "part", "data"])


def _reduce(table: pa.Table) -> pa.Table:
    """The documents of one block: BLOCK_DOCS at most, with a row for each range of buckets at most."""
    expand = zstandard.ZstdDecompressor()
    parts = list(zip(table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True))
    head = expand.decompress(next(data for part, data in parts if not part))
    n = len(head) // 17
    ids, gone, words = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.uint8, n, 8 * n), np.frombuffer(head, np.int64, n, 9 * n)
    weight = np.zeros(n, np.int64)
    for part, data in parts:
        if part:
            sums = np.frombuffer(expand.decompress(data), np.int64)
            weight[: len(sums)] += sums
    found = sum(np.maximum(words - k, 0) for k in range(LONGEST))
    return pa.table([pa.array(ids, mask=gone.astype(bool)), pa.array(words), pa.array(found), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def gains(docs: DataFrame, target: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, gain) of each bucket that either corpus has, and the features of ``docs``; both corpora's counts of a bucket meet in its group."""
    none = F.lit(0).cast("long")
    both = counts(docs, "s").withColumn("t", none).unionByName(counts(target, "t").withColumn("s", none))
    met = S.stored(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    every = met.agg(F.coalesce(F.sum("s"), none).alias("s"), F.coalesce(F.sum("t"), none).alias("t")).first()
    d = lambda x: x.cast("double")
    ratio = (d(F.col("t") + 1) * F.lit(float(every["s"] + BUCKETS))) / (d(F.col("s") + 1) * F.lit(float(every["t"] + BUCKETS)))
    return met.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")), every["s"]


def weighed(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs`` (doc_id, text) against the texts of ``target``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain, size = gains(texts.select("text"), target.select(F.col("text").cast("string").alias("text")))
    salts = max(1, -(-size * WIDTH // (BUCKETS * GROUP)))
    whole = gain.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(gain, "bucket", "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("gain", F.lit(0)).alias("gain")))), lambda x: x["gain"])
    ranges = whole.groupBy(F.floor(F.col("bucket") / WIDTH).cast("int").alias("range")).agg(F.min("bucket").alias("first"), listed.alias("gains"))
    heads = gain.sparkSession.createDataFrame([(-1, -1, [])], "range int, first int, gains array<long>")
    ranges = ranges.unionByName(heads).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    postings = texts.mapInArrow(_invert, "range int, block long, data binary").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    met = postings.join(ranges.hint("shuffle_hash"), ["range", "salt"]).select("range", "block", "data", "first", "gains")
    parts = met.mapInArrow(_contribute, "block long, part int, data binary")
    return parts.groupBy("block").applyInArrow(_reduce, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, fixed by the seed and the id (null: an empty one)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), drawn towards the texts of ``target`` (text).

    Features are runs of one to three words (digits, letters, all beyond ASCII; A-Z lower-cased), repeats included. weight is
    the sum of the gains of their buckets, score adds the noise of the doc_id, and ``percent`` of the documents with LEAST_WORDS words or more
    have a rank: the highest scores, ties to smaller doc_id (null last). Null or empty text, or no word: weight 0, never drawn. Repeated rows
    count and are drawn each. A very long text is taken in pieces. Other columns are ignored. An empty table gives an empty result;
    without ``target`` texts the gains follow from the documents alone. ``docs`` is read twice, and must give the same rows each time.
    """
    scored = weighed(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    scored = scored.select(*scored.columns, F.when(F.col("n_words") >= LEAST_WORDS, 1).otherwise(0).alias("may"))
    ordered = S.placed(scored, "may", [F.desc("score"), F.asc_nulls_last("doc_id")], "scored")
    drawn = (F.col("may") == 1) & (F.col("pos") < F.floor(percent * F.col("size") / 100))
    return ordered.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("pos") + 1).alias("rank"))
