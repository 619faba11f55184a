"""Exact top-k inner products by block-at-a-time pruning (operator 4).

Vectors are whole numbers, each component a term. Ranges of vec_id form blocks with a forward index of their
vectors and the greatest and least value of every term; these bound what any vector of the block can score, and
the extremes over a group of blocks bound what the group can. Queries travel in blocks, too. A block of queries
first meets the group with the best bounds, which gives every query a kth score to begin with; from then on it
goes only to groups that can still reach the kth score of one of its queries. Within a group each query visits
the blocks by falling bound until that lies below its kth score, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Vectors of a block, blocks of a group (which travels as one row), queries that meet a group at once.
BLOCK, BLOCKS, QUERIES = 128, 128, 2048
#: Groups whose extremes travel as one row.
EXTREMES = 512
FOUND = "part long, query_id long, vec_id long, score long"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(column: str = "embedding", levels: int = 256) -> F.Column:
    """floor(levels * x) of each component, x as double, within 64 bits; null unless all components are finite."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    # beyond 2^62 / levels a component is cut off, so that the product is finite and the cast is defined
    edge = float(1 << 62) / levels
    return F.when(good, F.transform(x, lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c)) * levels).cast("long")))


def _packed(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the least width that holds them: its name and the bytes."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, np.ascontiguousarray(values.astype(kind)).tobytes()


def _grouper(size: int):
    """Rows (vec_id, v) in their order into rows of ``size`` vectors of one width: width, kind, ids, vectors."""

    def emit(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        kind, raw = _packed(values)
        return pa.RecordBatch.from_arrays([pa.array([values.shape[1]], pa.int32()), pa.array([kind]), pa.array([ids.tobytes()], pa.binary()), pa.array([raw], pa.binary())], names=["width", "kind", "ids", "vectors"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = lists.value_lengths().to_numpy()
            for width in np.unique(lengths).tolist():
                mask = lengths == width
                flat = lists.filter(pa.array(mask)).flatten().to_numpy()
                held = rest.setdefault(width, [])
                held.append((ids[mask], flat.reshape(int(mask.sum()), width)))
                while sum(len(a) for a, _ in held) >= size:
                    all_ids, all_values = np.concatenate([a for a, _ in held]), np.concatenate([v for _, v in held])
                    yield emit(all_ids[:size], all_values[:size])
                    held[:] = [(all_ids[size:], all_values[size:])]
        for held in rest.values():
            if sum(len(a) for a, _ in held):
                yield emit(np.concatenate([a for a, _ in held]), np.concatenate([v for _, v in held]))

    return group


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            v = np.frombuffer(r["vectors"], r["kind"]).reshape(-1, r["width"]).astype(np.int64)
            rows.append((r["group"], r["width"], v.max(0).tobytes(), v.min(0).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["group", "width", "high", "low"])


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each query can score at most where each row of ``high`` and ``low`` holds, never less than the exact bound."""
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    total = up @ high.T.astype(float) + down @ low.T.astype(float)
    size = up @ np.abs(high).T.astype(float) - down @ np.abs(low).T.astype(float)
    # sums of doubles are exact under 2^53; beyond it they are a little less sure
    return np.where(size < 2.0**52, total, total + size * 1e-12)


def pruned_top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """The k best of the group for each query, ties to the lesser id, and how many pairs of query and block were scored.

    Vectors with the query's own id take no part, nor do those under ``kth``, what the query's kth score is at least.
    """
    starts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1] < 2**53
    kind = np.float64 if exact else object  # sums beyond doubles are taken as Python's whole numbers
    v, q = vectors.astype(kind), queries.astype(kind)
    bounds = _bounds(queries, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    found: list[list] = [[] for _ in query_ids]
    bar = np.full(len(query_ids), -np.inf) if kth is None else kth.astype(float)
    waiting, scored = np.arange(len(query_ids)), 0
    for turn in range(len(starts)):  # the turn-th best block of every query that still needs one
        waiting = waiting[bounds[waiting, order[waiting, turn]] >= bar[waiting]]
        if not len(waiting):
            break
        chosen = order[waiting, turn]
        scored += len(waiting)
        for block in np.unique(chosen).tolist():
            rows = waiting[chosen == block]
            at = slice(int(starts[block]), int(starts[block]) + BLOCK)
            scores, own = q[rows] @ v[at].T, ids[at]
            if not exact:
                scores = np.minimum(np.maximum(scores, _LEAST), _MOST)
            # a bar beyond 2^53 is rounded: what equals it in doubles is kept
            good = (scores.astype(float) >= bar[rows, None]) & (own[None, :] != query_ids[rows, None])
            for y in np.flatnonzero(good.any(1)).tolist():
                x, some = int(rows[y]), np.flatnonzero(good[y])
                best = sorted([*found[x], *((int(scores[y, z]), int(own[z])) for z in some)], key=lambda p: (-p[0], p[1]))[:k]
                found[x] = best
                if len(best) == k:
                    bar[x] = max(bar[x], float(best[-1][0]))
    return [(int(query_ids[x]), vec, score) for x, best in enumerate(found) for score, vec in best], scored


def _bars(row: dict, count: int) -> np.ndarray:
    """The kth score so far of each query of a row, minus infinity where it is not known."""
    known = {b["query_id"]: b["kth"] for b in row["bars"] or []}
    return np.array([known.get(i, -np.inf) for i in np.frombuffer(row["q_ids"], np.int64).tolist()], float) if known else np.full(count, -np.inf)


def _queries(row: dict) -> np.ndarray:
    return np.frombuffer(row["q_vectors"], row["q_kind"]).reshape(-1, row["width"]).astype(np.int64)


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                v, q = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["width"]).astype(np.int64), _queries(row)
                found, _ = pruned_top(np.frombuffer(row["ids"], np.int64), v, np.frombuffer(row["q_ids"], np.int64), q, k, _bars(row, len(q)))
                cols = [[row["part"]] * len(found), *([x[c] for x in found] for c in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["part", "query_id", "vec_id", "score"])

    return search


def _chooser(seed: bool):
    """(part, group, bound) for a block of queries and a row of extremes: the best group, or all groups that a query still needs."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                high, low = (np.stack([np.frombuffer(g[c], np.int64) for g in row["groups"]]) for c in ("high", "low"))
                q = _queries(row)
                bounds = _bounds(q, high, low)
                total = bounds.sum(0)
                some = np.array([int(total.argmax())]) if seed else np.flatnonzero((bounds >= _bars(row, len(q))[:, None]).any(0))
                groups = [row["groups"][g]["group"] for g in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(groups), pa.int64()), pa.array(groups, pa.int64()), pa.array(total[some])], names=["part", "group", "bound"])

    return choose


def top_inner_products(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k best other vectors of each query: query_id, rank (from 1), vec_id, score; ties to the lesser vec_id.

    Queries are the rows of ``embeddings`` (vec_id, embedding) whose vec_id is divisible by ``every``;
    candidates all rows with another vec_id. Vectors that are null, empty, or hold a null or non-finite component, and
    rows without vec_id, take no part; vectors meet those of their own length only. Equal rows (vec_id and
    vector) count once; different vectors of one vec_id are candidates each, and ask together as one query. Huge components
    count as 2^62, and scores end at the limits of 64 bits. With fewer than k candidates all are returned. Other columns are
    ignored. An empty table gives an empty result.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised().alias("v")).where("vec_id is not null and v is not null and size(v) > 0").distinct()
    shape = "width int, kind string, ids binary, vectors binary"
    in_order = lambda rows: rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    groups = S.stored(in_order(vectors).mapInArrow(_grouper(BLOCK * BLOCKS), shape).withColumn("group", F.monotonically_increasing_id()), "groups")
    asked = in_order(vectors.where(F.col("vec_id") % every == 0)).mapInArrow(_grouper(QUERIES), shape)
    asked = asked.select("width", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.monotonically_increasing_id().alias("part"))
    asked = S.stored(asked, "queries")
    slots = max(1, -(-groups.count() // EXTREMES))
    slot = F.pmod(F.xxhash64("group"), F.lit(slots)).cast("int").alias("slot")
    extremes = groups.mapInArrow(_extremes, "group long, width int, high binary, low binary").groupBy("width", slot).agg(F.collect_list(F.struct("group", "high", "low")).alias("groups"))
    extremes = S.stored(extremes, "extremes")

    def chosen(queries: DataFrame, seed: bool) -> DataFrame:
        # every block of queries meets the extremes of all groups, EXTREMES groups to a row
        met = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).join(extremes, ["width", "slot"])
        return met.mapInArrow(_chooser(seed), "part long, group long, bound double")

    def searched(pairs: DataFrame, queries: DataFrame) -> DataFrame:
        return pairs.join(queries.drop("width"), "part").join(groups, "group").mapInArrow(_searcher(k), FOUND)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    none = asked.withColumn("bars", F.expr("cast(null as array<struct<query_id:bigint,kth:bigint>>)"))
    seeds = S.stored(chosen(none, True).groupBy("part").agg(F.max_by("group", "bound").alias("group")), "seeds")
    first = S.stored(best(searched(seeds, none)), "first")
    bars = first.where(F.col("rank") == k).select("part", F.struct("query_id", F.col("score").alias("kth")).alias("bar")).groupBy("part").agg(F.collect_list("bar").alias("bars"))
    with_bars = S.stored(asked.join(bars, "part", "left"), "asked")
    needed = S.stored(chosen(with_bars, False).select("part", "group").join(seeds, ["part", "group"], "left_anti"), "needed")
    return best(first.drop("rank").union(searched(needed, with_bars))).select("query_id", "rank", "vec_id", "score")
