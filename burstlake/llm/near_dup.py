"""MinHash near-duplicate detection with b-bit signatures (operator 5).

Every text becomes the set of its distinct word shingles. Texts with equal sets form a class; a class is
handled once however many copies it has. Bands of full minima give candidates, whose packed low bits
estimate the similarity (corrected for chance agreement); what may reach the threshold is confirmed on the
full sets. In a round each class is paired with one lead of its buckets at most, what links is contracted, and
the next round takes the buckets that are still open. What some rounds leave apart is compared in full:
signatures in blocks, bucket by bucket, tell which classes may link, and the full sets of those meet in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import components
from . import shared as S

#: Signature: BANDS x ROWS minima, of which the LOW lowest bits are packed into longs.
BANDS, ROWS, LOW = 32, 4, 2
#: A pair is dropped before confirmation if its estimate lies this far under the threshold (six deviations).
MARGIN = 0.22
#: Rounds of pairs with leads, before what is left is compared block by block.
TURNS = 2
#: Signatures to a block; full sets, and their shingles in all, to a block (a set that is larger has one of its own).
SIGNATURES, BLOCK, BLOCK_SHINGLES = 512, 64, 1 << 19
#: Longs of a signature.
LONGS = [f"s{k}" for k in range(BANDS * ROWS * LOW // 64)]

SKETCH = "doc_id long, key binary, n_shingles long, sig array<long>, bands array<long>"
_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than n: the whole sequence as one."""
    data = S.LOWER[data]
    starts, ends, first = S.word_spans(data, offsets, S.NOT_SPACE)
    words = S.word_hashes(data, starts, ends)
    grams = S.gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(S.gram_hashes(words[a:b], b - a) if b > a else grams[:0])
    return out


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (rows x longs) and band hashes (rows x bands) of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(sets)
    low32 = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    minima = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            v = low32 * _A[k] + _B[k]
            v ^= v >> np.uint32(15)
            minima[k] = np.minimum.reduceat(v, at)
        bands = np.empty((len(sets), BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(sets), b + 1, np.uint64)
            for r in range(ROWS):
                h = S.mix64(h * np.uint64(0x9E3779B97F4A7C15) + minima[b * ROWS + r])
            bands[:, b] = h
        # minima of multiplicative hashes are not uniform in their low bits: mix before keeping them
        kept = S.mix64(minima.astype(np.uint64) + np.uint64(1)) & np.uint64((1 << LOW) - 1)
        per = 64 // LOW
        sig = np.zeros((len(sets), BANDS * ROWS // per), np.uint64)
        for k in range(BANDS * ROWS):
            sig[:, k // per] |= kept[k] << np.uint64(LOW * (k % per))
    return sig, bands


def _list_of_longs(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), flat)


def _sketcher(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.utf8(batch.column(1))
            for i, j in S.row_blocks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = np.zeros((len(sets), BANDS * ROWS * LOW // 64), np.uint64)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                if full:
                    sig[full], bands[full] = signatures([sets[k] for k in full])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _list_of_longs(sig),
                        _list_of_longs(bands),
                    ],
                    names=["doc_id", "key", "n_shingles", "sig", "bands"],
                )

    return sketch


def _set_fetcher(n: int, wanted: np.ndarray, bits: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = S.in_bit_set(wanted, batch.column(0).to_numpy(), bits)
            data, offsets = S.utf8(batch.column(1).filter(pa.array(mask)))
            for i, j in S.row_blocks(offsets):
                sets = [s for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "members"])

    return fetch


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def estimated(differing: float) -> float:
    """Similarity from the positions whose low bits differ: the share p that agrees, corrected for chance agreement 2^-LOW."""
    return (1 - differing / (BANDS * ROWS) - 0.5**LOW) / (1 - 0.5**LOW)


def most_differing(percent: int) -> int:
    """The most positions that may differ, for an estimate no more than MARGIN under the threshold."""
    return max(k for k in range(BANDS * ROWS + 1) if k == 0 or estimated(k) >= percent / 100 - MARGIN)


_FOLD = "" if LOW == 1 else " | shiftrightunsigned({0}, 1)) & 6148914691236517205L"


def _differing(p: str, q: str) -> str:
    """SQL for the positions whose low bits differ; ``p`` and ``q`` end in the prefixes of the signatures' columns."""
    return " + ".join(f"bit_count((({x}){_FOLD.format(x)})" for x in (f"({p}{c} ^ {q}{c})" for c in LONGS))


def _may_link(percent: int, p: str, q: str) -> str:
    """Exact bound on set sizes, and the estimate with its margin."""
    return f"100 * least({p}n, {q}n) >= {percent} * greatest({p}n, {q}n) and {_differing(p, q)} <= {most_differing(percent)}"


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased. Rows link when
    100 * intersection >= percent * union of their sets of distinct ``shingle``-word shingles (of the whole
    sequence, with fewer words); component_id is the least doc_id reachable; kept says doc_id is it.
    Null or empty text, or no word: n_shingles 0, linked with nothing. Null doc_id: takes part, but is never
    a component_id (null if the component has no other). Rows with one doc_id and one text count as one document, all kept
    or none. A very long text is one set like any other. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = S.stored(texts.mapInArrow(_sketcher(shingle), SKETCH), "sketches")
    n = sketches.count()
    firsts = [F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands"))]
    words = [F.col("sig")[k].alias(c) for k, c in enumerate(LONGS)]
    classes = sketches.where("key is not null").groupBy("key").agg(*firsts)
    classes = S.stored(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "rep", F.col("n_shingles").alias("n"), *words, "bands"), "classes", 4 * n)
    rows = classes.select("cid", "n", *LONGS, F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = S.stored(rows.join(shared, "bucket"), "members", BANDS * n)
    if members.isEmpty():
        return _result(sketches, classes, None)
    info = S.stored(members.groupBy("cid").agg(F.sum("size").alias("pop")).join(classes.drop("bands"), "cid"), "info", n)
    n, size = info.count(), members.count()
    members = members.drop("size").join(info.select("cid", "pop"), "cid")
    sets = S.stored(_fetch_sets(texts, info, n, shingle), "sets")
    labels, tested = info.select("cid", F.col("cid").alias("label")), None
    for turn in range(TURNS):
        members, pairs = _pairs_with_leads(members, info, labels, tested, percent, turn, n, size)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        labels = _relabelled(labels, S.stored(_confirmed(pairs, sets, percent), "links"), n)
    members = S.stored(_still_open(members, labels), "open", size)
    if not members.isEmpty():
        labels = _relabelled(labels, S.stored(_block_links(members, sets, percent), "links"), n)
    return _result(sketches, classes, labels)


def _fetch_sets(texts: DataFrame, info: DataFrame, n: int, shingle: int) -> DataFrame:
    """(cid, members): full sets of the classes in ``info``, made anew from their texts: only those are kept or moved."""
    bits = 1 << min(27, max(23, (8 * n).bit_length()))
    # by the id's hash: ids may follow a pattern that its remainder would repeat
    wanted = S.bit_set(info, F.xxhash64("rep"), bits)
    found = texts.select(F.xxhash64("doc_id").alias("hash"), "text").mapInArrow(_set_fetcher(shingle, wanted, bits), "key binary, members binary")
    return found.join(info.select("key", "cid"), "key").groupBy("cid").agg(F.first("members").alias("members"))


def _relabelled(labels: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """``labels`` (cid, label), where labels that ``links`` (a, b) connect have become the least of them."""
    if links.isEmpty():
        return labels
    ends = [labels.select(F.col("cid").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b")]
    between = links.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(between, lambda df: S.stored(df, "labels", n)).select(F.col("v").alias("label"), "component")
    return S.stored(labels.join(joined, "label", "left").select("cid", F.coalesce("component", "label").alias("label")), "labels", n)


def _still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets whose members have more than one label so far, with their labels."""
    now = members.drop("label").join(labels, "cid")
    mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return now.join(mixed.select("bucket"), "bucket", "left_semi")


def _pairs_with_leads(members: DataFrame, info: DataFrame, labels: DataFrame, tested: DataFrame | None, percent: int, turn: int, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows that are still open, and (a, b): for each class at most one pair, with the likeliest lead of its buckets.

    A bucket's lead is its best connected member at first, so that mostly the same few lead; later that of one label or another.
    """
    members = S.stored(_still_open(members, labels), "open", size)
    by = F.least("pop", F.lit(1 << 40))
    if turn:
        by = F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(1 << 20)) * F.lit(1 << 41) + by
    leads = members.groupBy("bucket").agg(F.max_by("cid", by).alias("lead"))
    told = info.join(labels, "cid").select(F.col("cid").alias("lead"), F.col("label").alias("lead_label"), *(F.col(c).alias(f"lead_{c}") for c in ("n", *LONGS)))
    offers = members.join(leads.join(told, "lead"), "bucket").where("label <> lead_label").where(_may_link(percent, "", "lead_"))
    offers = offers.select("cid", "lead", F.expr(_differing("", "lead_")).alias("differing"))
    if tested is not None:
        offers = offers.join(tested.select(F.col("a").alias("cid"), F.col("b").alias("lead")), ["cid", "lead"], "left_anti")
    best = offers.groupBy("cid").agg(F.min_by("lead", "differing").alias("lead"))
    return members, S.stored(best.select(F.col("cid").alias("a"), F.col("lead").alias("b")), "pairs", n)


def _in_blocks(rows: DataFrame, group: str, most: int, shingles: int, columns: list[str], name: str, sets: DataFrame | None = None) -> DataFrame:
    """Pairs of blocks of each ``group`` that hold different labels: left, right (lists of structs of ``columns``).

    Rows are dealt to blocks of about ``most`` rows and ``shingles`` shingles; a label that fills a block has blocks of its own, and
    those do not meet each other, so a label of m rows costs m / ``most`` meetings with each other block.
    """
    of_label = rows.groupBy(group, "label").agg(F.count("*").alias("k"), F.sum("n").alias("all_n"))
    full = F.greatest(F.ceil(F.col("k") / most), F.ceil(F.col("all_n") / shingles))
    of_label = of_label.withColumn("own", F.when(full > 1, F.col("label")))
    room = of_label.groupBy(group, "own").agg(F.greatest(F.ceil(F.sum("k") / most), F.ceil(F.sum("all_n") / shingles)).alias("parts"))
    same = F.expr(f"g.{group} = r.{group} and g.own <=> r.own")
    sized = of_label.alias("g").join(room.alias("r"), same).select(f"g.{group}", "g.label", "g.own", "r.parts")
    placed = rows.join(sized, [group, "label"]).withColumn("block", F.xxhash64("own", F.pmod(F.xxhash64("cid"), F.col("parts"))))
    placed = placed if sets is None else placed.join(sets, "cid")
    blocks = S.stored(placed.groupBy(group, "block", "own").agg(F.collect_list(F.struct(*columns)).alias("them")), name)
    i = blocks.select(group, F.col("block").alias("i"), F.col("own").alias("own_i"))
    j = blocks.select(group, F.col("block").alias("j"), F.col("own").alias("own_j"))
    meet = i.join(j, group).where("i <= j and not coalesce(own_i = own_j, false)").select(group, "i", "j")
    left = blocks.select(group, F.col("block").alias("i"), F.col("them").alias("left"))
    right = blocks.select(group, F.col("block").alias("j"), F.col("them").alias("right"))
    return meet.join(left, [group, "i"]).join(right, [group, "j"]).select("left", "right")


def _block_links(current: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links between different labels in open buckets.

    Signatures meet first, in blocks of each bucket: what may link by size and estimate is connected, and the full sets of
    each cluster of such classes meet in blocks, once. Either step returns fewer links than a block pair has rows, as
    it leaves out those that join what it has joined.
    """
    found = _in_blocks(current, "bucket", SIGNATURES, 1 << 62, ["cid", "label", "n", *LONGS], "signature-blocks")
    likely = S.stored(found.mapInArrow(_estimator(percent), "a long, b long"), "likely")
    found_n = likely.count()
    if not found_n:
        return likely
    clusters = components(likely, lambda df: S.stored(df, "clusters", found_n)).select(F.col("v").alias("cid"), F.col("component").alias("cluster"))
    docs = S.stored(clusters.join(current.select("cid", "label", "n").distinct(), "cid"), "clustered", 2 * found_n)
    return _in_blocks(docs, "cluster", BLOCK, BLOCK_SHINGLES, ["cid", "label", "members"], "set-blocks", sets).mapInArrow(_comparer(percent), "a long, b long")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of ``linked`` (true: an edge) that connect what it connects, without cycles."""
    out = []
    rows, columns = linked.any(1), linked.any(0)
    for first in np.flatnonzero(rows).tolist():
        if not rows[first]:
            continue
        rows[first], waiting = False, [(0, first)]
        while waiting:
            side, k = waiting.pop()
            line, free = (linked[:, k], rows) if side else (linked[k], columns)
            new = np.flatnonzero(line & free)
            free[new] = False
            out += [(x, k) if side else (k, x) for x in new.tolist()]
            waiting += [(1 - side, x) for x in new.tolist()]
    return out


def _side(batch: pa.RecordBatch, name: str, row: int) -> pa.StructArray:
    lists = batch.column(name)
    return lists.values.slice(lists.offsets[row].as_py(), len(lists[row]))


def _estimator(percent: int):
    most, low = most_differing(percent), np.uint64(0x5555555555555555)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = ({c: side.field(c).to_numpy(zero_copy_only=False) for c in ("cid", "label", "n", *LONGS)} for side in (_side(batch, "left", row), _side(batch, "right", row)))
                x, y = one["n"][:, None], two["n"][None, :]
                may = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (one["label"][:, None] != two["label"][None, :])
                differing = np.zeros(may.shape, np.int64)
                for c in LONGS:
                    bits = one[c].view(np.uint64)[:, None] ^ two[c].view(np.uint64)[None, :]
                    differing += np.bitwise_count(bits if LOW == 1 else (bits | (bits >> np.uint64(1))) & low)
                out = [(one["cid"][p], two["cid"][q]) for p, q in forest(may & (differing <= most))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return estimate


def _comparer(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = ({c: side.field(c) for c in ("cid", "label", "members")} for side in (_side(batch, "left", row), _side(batch, "right", row)))
                cids, labels = ([side[c].to_numpy() for side in (one, two)] for c in ("cid", "label"))
                sets = [[np.frombuffer(m.as_buffer(), np.uint64) for m in side["members"]] for side in (one, two)]
                sizes = [np.array([len(m) for m in side]) for side in sets]
                both = common_counts(*sets)
                linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
                out = [(cids[0][x], cids[1][y]) for x, y in forest(linked & (labels[0][:, None] != labels[1][None, :]))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return compare


def common_counts(one: list[np.ndarray], two: list[np.ndarray], slice_size: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` with each of ``two``, by products of incidence matrices."""
    flat = [np.concatenate(side) for side in (one, two)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(one), len(two)), np.int64)
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (one, two)]
    at = [np.searchsorted(shared, f) for f in flat]
    known = [(k < len(shared)) & (shared[np.minimum(k, max(0, len(shared) - 1))] == f) if len(shared) else np.zeros(len(f), bool) for k, f in zip(at, flat, strict=True)]
    for low in range(0, len(shared), slice_size):
        tables = []
        for side, k, ok, row in zip((one, two), at, known, rows, strict=True):
            here = ok & (k >= low) & (k < low + slice_size)
            t = np.zeros((len(side), min(slice_size, len(shared) - low)), np.float32)
            t[row[here], k[here] - low] = 1
            tables.append(t)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    full = pairs.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("sb")), "b").join(sets.select(F.col("cid").alias("a"), F.col("members").alias("sa")), "a")
    return full.mapInArrow(_confirmer(percent), "a long, b long")


def _result(sketches: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    reps = classes.select("cid", "key", "rep")
    if labels is not None:
        linked = reps.join(labels, "cid")
        least = linked.groupBy("label").agg(F.min("rep").alias("least"))
        reps = reps.join(linked.join(least, "label").select("cid", "least"), "cid", "left").select("key", F.coalesce("least", "rep").alias("rep"))
    found = sketches.select("doc_id", "key", "n_shingles")
    # rows without a word have no key: they meet nothing and need no place in the shuffle
    alone = found.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = found.where("key is not null").join(reps, "key").select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.expr("doc_id <=> component_id"))
