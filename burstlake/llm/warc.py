"""WARC archives: writing with revisit records, and reading by boundary chains (operator 10).

A record ends with two line ends and the next begins with ``WARC/`` and a version, so Spark's text writer and reader
do the byte work on any store, in splits, with those bytes as the line separator. What follows a separator is
a candidate record of any version: it may as well be magic inside a payload. Each task emits its candidates with the offset
of their successor; within a split successors are followed on the spot, and pointer jumping from the start of
every file over the splits keeps only the records that the chain reaches. Where a chain breaks off before the
end of its file, the record that it breaks at says so.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared as S

MAGIC, VERSION, END = "WARC/", "WARC/1.1\r\n", "\r\n\r\n"
SEPARATOR = END + MAGIC
#: What is said of a record that the chain breaks at.
BROKEN = {"header": "no version or no valid Content-Length", "next": "no record where its length says", "digest": "the response it refers to is missing or has another payload"}
#: Payloads under this many bytes are never replaced by a revisit.
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_VERSION = re.compile(rb"(WARC/)?[0-9]+\.[0-9]+[ \t]*\r\n")
_SCAN = "file string, block long, rel long, size long, head long, length long, exit_rel long, type string, id string, uri string, refers_to string, digest string, bytes long, complete boolean"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> None:
    """A record for each row of ``pages`` (page_id, url, html), in WARC files under ``path``.

    The payload is html in UTF-8 (null: empty). Of rows with equal payloads of at least ``least`` bytes those
    with the greatest page_id are responses, the others revisits of it (all are responses if no row has a
    page_id). A null url has no target URI. Repeated rows are written each; other columns are left out.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "").alias("url"), body.alias("body"))
    same = [F.octet_length("body").cast("long").alias("bytes"), F.sha1("body").alias("digest"), F.xxhash64("body").alias("check")]
    copies = rows.select("page_id", *same).where(F.col("bytes") >= least).groupBy("bytes", "digest", "check").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").drop("n")
    copies = S.stored(copies, "copies")  # its size is known now: it is broadcast only if small, else both sides are shuffled
    joined = rows.select("*", *same).join(copies, ["bytes", "digest", "check"], "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    block = F.concat(F.lit(HTTP), F.when(again, F.lit("")).otherwise(F.col("body")))
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit(f"WARC-Date: {date}"),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("kept")))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    joined.select(F.concat(F.lit(VERSION), head, F.lit(END), block).alias("value")).write.option("lineSep", END).text(path)


def _header(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _hex_digest(text: str | None) -> str | None:
    """The bare hex digest of a header value ``sha1:...`` in hex or base 32."""
    value = (text or "").rpartition(":")[2]
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return None
    return value.lower() or None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with their place relative to the split, and where the chain that starts at each leaves the split."""
    state: list = [None, 0, []]  # split, place in it, its candidates
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("head", pa.int64()), ("length", pa.int64()), ("exit_rel", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("complete", pa.bool_())])

    def flush() -> pa.RecordBatch:
        exits: dict[int, int | None] = {}
        for row in reversed(state[2]):
            after = None if row["length"] is None else row["rel"] + row["head"] + row["length"] + len(SEPARATOR)
            row["exit_rel"] = exits.get(after, after)
            exits[row["rel"]] = row["exit_rel"]
        out = pa.RecordBatch.from_pylist(state[2], schema)
        state[2] = []
        return out

    for batch in batches:
        for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state[0] != (file, block):
                if state[2]:
                    yield flush()
                state[:2] = [(file, block), 0]
            raw = value.as_buffer().to_pybytes()
            state[2].append({"file": file, "block": block, "rel": state[1], "size": len(raw)} | _candidate(raw))
            state[1] += len(raw) + len(SEPARATOR)
    if state[2]:
        yield flush()


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header if the block begins with one."""
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _candidate(raw: bytes) -> dict:
    end = raw.find(b"\r\n\r\n")
    header = _header(raw[:end]) if end >= 0 and _VERSION.match(raw) else {}
    number = header.get("content-length", "")
    if not number.isascii() or not number.isdigit():
        return {"head": 0, "length": None, "complete": False}
    head, length = end + 4, int(number)
    kind, told = header.get("warc-type"), header.get("x-payload-length", "")
    out = {"head": head, "length": length, "type": kind, "id": header.get("warc-record-id"), "uri": header.get("warc-target-uri"), "refers_to": header.get("warc-refers-to")}
    if kind == "revisit":  # has no payload of its own: what it stands for is in its header
        return out | {"digest": _hex_digest(header.get("warc-payload-digest")), "bytes": int(told) if told.isdigit() else None, "complete": True}
    if head + length > len(raw):
        return out | {"complete": False}
    payload = _payload(raw[head : head + length])
    return out | {"digest": hashlib.sha1(payload).hexdigest(), "bytes": len(payload), "complete": True}


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _reached(candidates: DataFrame) -> DataFrame:
    """(file, at): where the chain from each file's start first stands in a split, by pointer jumping.

    Places are those of the bytes after a separator; a successor's is the end of the record and a separator on.
    """
    jump = candidates.where("exit is not null").select("file", "at", "exit")
    reached = candidates.where("at = 0").select("file", "at")
    starts = candidates.select("file", "at")
    step = reached
    while True:
        step = S.stored(reached.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at")).join(starts, ["file", "at"], "left_semi").join(reached, ["file", "at"], "left_anti").distinct(), "reached")
        if step.isEmpty():
            return reached
        reached = S.stored(reached.union(step), "reached")
        onward = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
        jump = S.stored(jump.join(onward, ["file", "exit"]).select("file", "at", F.col("beyond").alias("exit")), "jump")


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the candidates of one split, those on the chain from its entry; ``owner``: the record that each lies in (-1: an earlier split's).

    ``leaves``: where the last of them says that the next record is.
    """
    pdf = pdf.sort_values("at", ignore_index=True)
    place = {at: k for k, at in enumerate(pdf["at"].tolist())}
    on, after = np.zeros(len(pdf), bool), pdf["after"].tolist()
    entry = pdf["entry"].iloc[0]
    k = None if pd.isna(entry) else place.get(int(entry))
    leaves = pd.array([None] * len(pdf), "Int64")
    while k is not None:
        on[k], last = True, k
        k = None if pd.isna(after[k]) else place.get(int(after[k]))
        if k is None and not pd.isna(after[last]):
            leaves[last] = int(after[last])
    owner = pd.Series(np.where(on, pdf["at"], np.nan)).ffill().fillna(-1).astype("int64")
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "at": pdf["at"], "owner": owner, "leaves": leaves})


def records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives under ``path`` that the chain from its file's start reaches.

    file, offset, type, id, uri, refers_to, digest (hex SHA-1 of the payload; for a revisit that of its header), bytes (of the payload; for
    a revisit from its header), damage, and payload if asked for (null for revisits). Magic inside a payload is not a record, however
    often it stands there. Records of all versions are read; files named ``.gz`` are unpacked (and not split), and offsets count
    unpacked bytes. A chain that breaks off before its file's end is reported: ``damage`` of the last record that it reaches is one of
    BROKEN (null for all other records), and what lies beyond is not read. A very long payload is held by one worker at a time. A folder
    of empty files has no records.
    """
    found = S.stored(_pieces(spark, path).mapInArrow(_scan, _SCAN), "candidates")
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(SEPARATOR)).alias("n"))
    base = sizes.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = found.join(base, ["file", "block"]).withColumns({"at": F.col("base") + F.col("rel"), "exit": F.col("base") + F.col("exit_rel"), "after": F.col("base") + F.col("rel") + F.col("head") + F.col("length") + len(SEPARATOR)})
    placed = S.stored(placed, "placed")
    entries = placed.select("file", "block", "at").join(_reached(placed), ["file", "at"], "left_semi").select("file", "block", F.col("at").alias("entry"))
    asked = placed.select("file", "block", "at", "after").join(entries, ["file", "block"], "left")
    marked = asked.groupBy("file", "block").applyInPandas(_follow, "file string, block long, at long, owner long, leaves long")
    marked = S.stored(marked, "marked")
    # what lies before a split's entry belongs to the last record of an earlier split
    last = marked.groupBy("file", "block").agg(F.max(F.when(F.col("owner") >= 0, F.col("owner"))).alias("last"))
    earlier = last.select("file", "block", F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    owned = marked.join(earlier, ["file", "block"]).select("file", "at", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("earlier")).alias("owner")).where("owner is not null")
    # a chain may leave a split for a record of another, or end with its file
    whole = sizes.groupBy("file").agg(F.sum("n").alias("n"))
    ended = whole.select("file", F.explode(F.array(F.col("n") - len(END), F.col("n"))).alias("next"))  # with the last line ends, or without
    lost = marked.where("leaves is not null").select("file", "at", F.col("leaves").alias("next"))
    lost = lost.join(placed.select("file", F.col("at").alias("next")), ["file", "next"], "left_anti").join(ended, ["file", "next"], "left_anti")
    damage = F.when(F.col("length").isNull(), BROKEN["header"]).when(F.col("lost"), BROKEN["next"])
    index = placed.drop("exit", "exit_rel", "after").join(owned, ["file", "at"]).join(lost.select("file", "at", F.lit(True).alias("lost")), ["file", "at"], "left")
    index = S.stored(index.withColumn("damage", damage).drop("lost"), "index")
    true = index.where("at = owner")
    fields = ["file", F.when(F.col("at") == 0, F.lit(0)).otherwise(F.col("at") - len(MAGIC)).alias("offset"), "type", "id", "uri", "refers_to", "damage"]
    apart = F.col("complete") if not with_payload else F.lit(False)
    out = true.where(apart).select(*fields, "digest", "bytes", *([F.lit(None).cast("binary").alias("payload")] if with_payload else []))
    rest = true.where(~apart)
    if with_payload or not rest.isEmpty():
        wanted = S.stored(index.join(rest.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi").select("file", "block", "rel", "at", "owner"), "wanted")
        whole = _assembled(spark, path, wanted).join(rest.drop("owner"), ["file", "at"])
        block = F.expr("substring(whole, head + 1, length)")
        payload = F.when(F.col("type") == "revisit", F.lit(None)).otherwise(_strip_http(block))
        whole = whole.withColumn("payload", payload)
        own = [F.coalesce(F.sha1("payload"), F.col("digest")).alias("digest"), F.coalesce(F.octet_length("payload").cast("long"), F.col("bytes")).alias("bytes")]
        out = out.unionByName(whole.select(*fields, *own, *(["payload"] if with_payload else [])))
    return out


def _strip_http(block: Column) -> Column:
    """The payload of a block: what follows the HTTP header if it begins with one."""
    text = block.cast("string")  # a view of the same bytes: nothing is decoded
    return F.when(text.startswith("HTTP/"), F.substring(block, F.octet_length(F.substring_index(text, END, 1)) + len(END) + 1, F.octet_length(block))).otherwise(block)


def _assembled(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file, at, whole): the bytes of records, put together from the pieces that magic in their payloads cut them into."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rel = None, 0
        for batch in batches:
            places = []
            for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if split != (file, block):
                    split, rel = (file, block), 0
                places.append(rel)
                rel += len(value.as_buffer()) + len(SEPARATOR)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["value", "file", "block", "rel"])

    pieces = _pieces(spark, path).mapInArrow(place, "value binary, file string, block long, rel long")
    met = pieces.join(wanted, ["file", "block", "rel"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    joined = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), lambda s, x: F.concat(s, F.lit(SEPARATOR.encode()), x))
    return met.groupBy("file", F.col("owner").alias("at")).agg(joined.alias("whole"))


def page_id_of(urn: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")


def checked(found: DataFrame) -> DataFrame:
    """``found`` (rows of ``records``), where a revisit whose response is missing or has another digest or length says so in ``damage``."""
    responses = found.where("type = 'response'").select(F.col("id").alias("refers_to"), F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes")).where("refers_to is not null")
    again = found.where("type = 'revisit'").join(responses.distinct(), "refers_to", "left")
    good = F.coalesce((F.col("_digest") == F.col("digest")) & (F.col("_bytes") == F.coalesce("bytes", "_bytes")), F.lit(False))
    again = again.groupBy(*found.columns).agg(F.bool_or(good).alias("_good")).withColumn("damage", F.coalesce("damage", F.when(~F.col("_good"), BROKEN["digest"])))
    return found.where("not coalesce(type = 'revisit', false)").unionByName(again.select(found.columns))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``pages`` written as archives under ``path`` (a new folder of the shared one) and read back: a row for each page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, damage; see write_archives for nulls, copies and repeated rows.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or S.new_path(spark, "warc")
    write_archives(pages, path)
    found = records(spark, path)
    return found.select(page_id_of("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page_id_of("refers_to").alias("refers_to"), "damage")
