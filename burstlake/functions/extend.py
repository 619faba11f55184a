"""What users can add and call in SQL: a scalar function, an aggregate, table functions over partitioned tables, and judges over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that go to a judge at once.
BATCH = 32


class Judge(Protocol):
    """Something that answers about pictures: a model in this process, or a service. It is made once a task, where the rows are."""

    name: str

    def judge(self, context: str, vocabulary: list[str], images: list[bytes]) -> list[dict]:
        """For each image {"moments": [...], "confidence": 0 to 1}; an exception is no answer."""


VERDICT = "moments array<string>, confidence double, judge string, error string"


def _answers(judge: Judge, context: str, vocabulary: list[str], images: list[bytes]) -> list[tuple]:
    """(moments, confidence, judge, error) for each image: a batch that fails is asked again row by row, so that only rows without an answer have an error."""
    try:
        said = judge.judge(context, vocabulary, images)
        if len(said) != len(images):
            raise ValueError(f"{len(said)} answers to {len(images)} images")
        return [_checked(judge, vocabulary, answer) for answer in said]
    except Exception as e:  # noqa: BLE001  whatever a judge fails with is an answer for its rows alone
        if len(images) == 1:
            return [(None, None, judge.name, f"{type(e).__name__}: {e}")]
        return [x for image in images for x in _answers(judge, context, vocabulary, [image])]


def _checked(judge: Judge, vocabulary: list[str], answer: dict) -> tuple:
    """Only words of the vocabulary count, each once, in its order; the confidence is cut to 0 to 1."""
    said = set(answer["moments"])
    return [m for m in vocabulary if m in said], float(min(1.0, max(0.0, answer["confidence"]))), judge.name, None


def judged(rows: DataFrame, make: Callable[[], Judge], key: str, image: str, context: str, vocabulary: list[str], batch: int = BATCH) -> DataFrame:
    """``key``, moments, confidence, judge and error of each of ``rows`` with an ``image`` (binary), in batches of ``batch`` at most.

    Arrow batches go to the judge where they are; nothing is shuffled, and a row without an image has no answer and no error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = None
        for rows_ in batches:
            for at in range(0, rows_.num_rows, batch):
                part = rows_.slice(at, batch)
                images = part.column(1).to_pylist()
                asked = [k for k, x in enumerate(images) if x is not None]
                judge = judge or make()
                said = dict(zip(asked, _answers(judge, context, vocabulary, [images[k] for k in asked]) if asked else [], strict=True))
                cells = list(zip(*[said.get(k, (None, None, judge.name, None)) for k in range(len(images))], strict=True))
                kinds = (pa.list_(pa.string()), pa.float64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), kind) for c, kind in zip(cells, kinds, strict=True)]], names=[key, "moments", "confidence", "judge", "error"])

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(VERDICT).fields])
    return rows.select(key, F.col(image).cast("binary").alias("_image")).mapInArrow(run, schema)


def _auc(score: pd.Series, truth: pd.Series) -> float:
    """The chance that a row that is true scores above one that is not, ties half; null without either. NaN scores do not count. An aggregate: a group's scores are in one task."""
    known = score.notna() & truth.notna()
    s, t = score[known].to_numpy(float), truth[known].to_numpy(bool)
    if t.all() or not t.any():
        return None
    ranks = pd.Series(s).rank().to_numpy()
    n = int(t.sum())
    return float((ranks[t].sum() - n * (n + 1) / 2) / (n * (len(t) - n)))


auc = F.pandas_udf(_auc, T.DoubleType())
_SPAN = T.StructType([T.StructField("key", T.StringType()), T.StructField("session", T.LongType()), T.StructField("started", T.DoubleType()), T.StructField("ended", T.DoubleType()), T.StructField("n", T.LongType())])


@F.arrow_udtf(returnType=_SPAN)
class BurstSpans:
    """burst_spans(gap, TABLE(... key, taken) PARTITION BY key ORDER BY taken): the runs of a key's rows whose steps are ``gap`` at most; rows without taken are none.

    A key's rows come in batches; the run that is open at the end of one goes on in the next.
    """

    def __init__(self) -> None:
        self.key, self.session, self.first, self.last, self.n = None, 0, None, None, 0

    def eval(self, gap: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        taken = rows.column("taken")
        taken = (taken.drop_null() if taken.null_count else taken).to_numpy(zero_copy_only=False)
        self.key = rows.column("key")[-1].as_py() if rows.num_rows else self.key
        if not len(taken):
            return
        first, goes_on = taken[0], self.n and not taken[0] - self.last > gap[0].as_py()
        begins = np.append(0, np.flatnonzero(np.diff(taken) > gap[0].as_py()) + 1)
        firsts, lasts, sizes = taken[begins], taken[np.append(begins[1:], len(taken)) - 1], np.diff(begins, append=len(taken))
        if goes_on:
            sizes[0] += self.n
            first = self.first
        elif self.n:
            yield self._spans([self.first], [self.last], [self.n])
        firsts[0] = first
        if len(begins) > 1:
            yield self._spans(firsts[:-1], lasts[:-1], sizes[:-1])
        self.first, self.last, self.n = firsts[-1], lasts[-1], int(sizes[-1])

    def _spans(self, first, last, n) -> pa.RecordBatch:
        """The next of the key's runs."""
        ends = [pa.array(np.asarray(x, float)) for x in (first, last)]
        numbers = pa.array(np.arange(self.session, self.session + len(n)))
        self.session += len(n)
        return pa.RecordBatch.from_arrays([pa.array([self.key] * len(n), pa.string()), numbers, *ends, pa.array(np.asarray(n, np.int64))], names=_SPAN.names)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield self._spans([self.first], [self.last], [self.n])


def needs_review_sql() -> str:
    """The review rule as a SQL function, which Catalyst writes into the plan: no Python at run time."""
    return """CREATE OR REPLACE TEMPORARY FUNCTION needs_review(conf DOUBLE, reviewed BIGINT, rejected BIGINT, uncertain BIGINT, threshold DOUBLE) RETURNS BOOLEAN RETURN
      CASE WHEN coalesce(reviewed, 0) <> 0 THEN false WHEN coalesce(rejected, 0) <> 0 THEN coalesce(uncertain, 0) <> 0 ELSE coalesce(conf, 1.0D) < coalesce(nullif(threshold, 0.0D), 0.8D) END"""


def register(spark: SparkSession) -> None:
    """Make ``needs_review``, ``auc`` and ``burst_spans`` known to SQL of this session."""
    spark.sql(needs_review_sql())
    spark.udf.register("auc", auc)
    spark.udtf.register("burst_spans", BurstSpans)


class ByteJudge:
    """A judge without a model, for trials: it says of a picture what its bytes say, and fails on pictures whose first byte is ``bad``."""

    def __init__(self, bad: int | None = None) -> None:
        self.name, self.bad = "bytes", bad

    def judge(self, context: str, vocabulary: list[str], images: list[bytes]) -> list[dict]:
        if self.bad is not None and any(i[:1] == bytes([self.bad]) for i in images):
            raise RuntimeError("no answer")
        return [{"moments": [v for v in vocabulary if v.encode() in i], "confidence": float(np.mean(np.frombuffer(i, np.uint8)) / 255) if i else 0.0} for i in images]
