"""Toxicity by compression distance (operator 6).

Two zstandard dictionaries are trained apart on labelled rows: one on ordinary text, one on the passages of
toxic text around words that are far more frequent there. Every window of a text is compressed with the
ordinary dictionary alone, and with the toxic one before it, so that ordinary words cost the same both times;
the difference of the lengths is the window's evidence, and from a threshold on the window is a hit. A
logistic curve, fitted on labelled rows that neither dictionary saw, calibrates a text's windows to a score
and so the threshold of 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: At most so many labelled rows of each class are learned from, and so many bytes of them (those with the least hash of
#: their id; a text that does not fit any more is passed over): a bound on what reaches the driver.
TOXIC_ROWS, ORDINARY_ROWS, TOXIC_BYTES, ORDINARY_BYTES = 3000, 6000, 16 << 20, 32 << 20
#: Bytes of a window, level of compression, sizes of the two dictionaries, words or beginnings of words that the toxic one is trained on.
WINDOW, LEVEL, ORDINARY_SIZE, TOXIC_SIZE, WORDS = 96, 9, 8192, 1536, 300
#: Windows that the ordinary dictionary is trained on, spread evenly over those of all its texts: some hundred times its size in bytes.
TRAINED = 40_000
#: Bytes saved in a window from which it counts as a hit.
HIT = 4
_EDGES = b".,;:!?\"'()"
SCORES = "doc_id long, score double, windows int"


def windows(text: str) -> list[bytes]:
    """The lower-cased bytes in pieces of at most WINDOW, cut at a space where there is one in the second half."""
    raw, out, i = text.encode("utf-8", "replace").lower(), [], 0
    while i < len(raw):
        j = min(len(raw), i + WINDOW)
        if j < len(raw):
            k = raw.rfind(b" ", i + WINDOW // 2, j)
            j = k if k > 0 else j
        out.append(raw[i:j])
        i = j
    return out or [b""]


def _starts(word: bytes) -> list[bytes]:
    """The word and its beginnings of 4 to 9 bytes: inflected forms share one."""
    word = word.strip(_EDGES)
    return [word, *(word[:k] for k in range(4, min(10, len(word))))]


def _words(text: str) -> set[bytes]:
    return {s for w in set(text.encode("utf-8", "replace").lower().split()) for s in _starts(w)}


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple = ()
    bias: float = -20.0

    def compressors(self) -> list:
        flags = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **flags).compress)
        return out


def features(text: str, plain, toxic) -> tuple[list[float], int]:
    parts = windows(text)
    saved = np.sort([len(plain(w)) - len(toxic(w)) for w in parts])
    root = math.sqrt(len(parts))
    over = np.maximum(saved - 2, 0).sum()
    return [float(saved[-1]), float(saved[-2:].sum()), float((saved >= HIT).sum() / root), float(over / root)], len(parts)


def _trained(size: int, samples: list[bytes]) -> bytes:
    """The content of a trained dictionary, or the samples themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()[-int(size * 0.93) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _spread(items: list, most: int) -> list:
    """``items``, or ``most`` of them at even steps."""
    return items if len(items) <= most else [items[k * len(items) // most] for k in range(most)]


def fit(rows: list[tuple[str, int]], weight: dict[int, float]) -> Model:
    """``rows``: distinct (text, label). Two rows of three of a class train the dictionaries, the third the curve."""
    by = {k: [t for t, y in rows if y == k] for k in (0, 1)}
    if min(map(len, by.values())) < 3:
        return Model()
    toxic, ordinary = ([t for i, t in enumerate(by[k]) if i % 3] for k in (1, 0))
    often, else_ = Counter(), Counter()
    for t in toxic:
        often.update(_words(t))
    for t in ordinary:
        else_.update(_words(t))
    ratio = {w: k / len(toxic) / ((else_[w] + 0.5) / (len(ordinary) + 1)) for w, k in often.items() if k >= max(min(4, len(toxic)), 0.015 * len(toxic))}
    typical = {w for w in sorted((w for w, r in ratio.items() if r >= 10), key=lambda w: (-often[w] * math.log(ratio[w]), w))[:WORDS]}
    spoken = [b" " + w + b" " for t in toxic for w in t.encode("utf-8", "replace").lower().split() if any(s in typical for s in _starts(w))] or [b" "]
    model = Model(
        _trained(ORDINARY_SIZE, _spread([w for t in ordinary for w in windows(t)], TRAINED)),
        _trained(TOXIC_SIZE, [b"".join(spoken[i : i + 8]) for i in range(0, len(spoken), 8)]),
    )
    tools = model.compressors()
    held = [(t, k) for k in (0, 1) for t in by[k][::3]]
    x = np.array([features(t, *tools)[0] for t, _ in held])
    y = np.array([k for _, k in held], float)
    w = np.array([weight[k] for _, k in held])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps of a logistic regression with a slight ridge
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * len(z) * 1e-2 * np.eye(z.shape[1])
        beta += np.linalg.solve(hess, z.T @ (w * (y - p)) - 1e-4 * len(z) * beta)
    model.weights = tuple((beta[:-1] / spread).tolist())
    model.bias = float(beta[-1] - (beta[:-1] * mean / spread).sum())
    return model


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from at most TOXIC_ROWS and ORDINARY_ROWS rows of ``labels`` (doc_id, label) whose crc32(doc_id) mod 5 is not 0.

    A document with both labels counts as toxic; null texts and labels other than 0 and 1 are left out; equal texts count once. The rows
    are picked by id; their lengths are looked at before their texts, so that the driver gets TOXIC_BYTES and ORDINARY_BYTES at most.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    there = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    picked = S.stored(parts[0].union(parts[1]), "picked", TOXIC_ROWS + ORDINARY_ROWS)  # bounded by the two parameters, so it may be broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("y", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")).agg(F.min(F.struct("doc_id", "text")).alias("first"))
    texts = S.stored(texts.select("y", "size", F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text")), "labelled", TOXIC_ROWS + ORDINARY_ROWS)
    fits: list[tuple[int, int, int]] = []
    for y, most in ((1, TOXIC_BYTES), (0, ORDINARY_BYTES)):
        for r in texts.where(F.col("y") == y).select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id", "size").limit(TOXIC_ROWS if y else ORDINARY_ROWS).collect():
            if r["size"] <= most:
                most -= r["size"]
                fits.append((r["doc_id"], r["size"], y))
    if not fits:
        return Model()
    # as an Arrow table: from a list, Spark starts Python on the executors, in workers of their own
    kinds = {"doc_id": pa.int64(), "size": pa.int32(), "y": pa.int32()}
    wanted = docs.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*fits, strict=True), kinds.values(), strict=True)], names=list(kinds)))
    rows = texts.join(F.broadcast(wanted), ["doc_id", "size", "y"], "left_semi").select("doc_id", "text", "y").collect()
    seen: set[str] = set()
    distinct = [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])) if not (r["text"] in seen or seen.add(r["text"]))]
    got = Counter(y for _, y in distinct)
    return fit(distinct, {y: there.get(y, 0) / got[y] / max(1, sum(there.values())) * len(distinct) for y in got})


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors() if model.weights else None
        for batch in batches:
            scores, counts = [], []
            for text in batch.column(1):
                x, n = features(text.as_py() or "", *tools) if tools else ([], 1)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(a * b for a, b in zip(x, model.weights, strict=True)))))))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(counts, pa.int32())], names=["doc_id", "score", "windows"])

    return score


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, windows.

    Null and empty texts are scored as one empty window. held_out (null for a null doc_id) is crc32(doc_id) mod 5 = 0. A model without
    rows of both classes scores everything near 0. Repeated rows are scored each; other columns are ignored.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(model), SCORES)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows")


def rejected_out(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns and all other rows stay."""
    scorer = _scorer(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])
            scored = next(scorer(iter([pair])))
            yield batch.filter(pa.array(scored.column("score").to_numpy() < 0.5))

    return docs.mapInArrow(keep, docs.schema)
