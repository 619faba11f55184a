"""Secret scanning with corpus-wide ownership (operator 7), in DataFrame functions only.

Base kinds come from patterns. Positions are sums of the lengths of what lies between the matches and of the
matches. Values are hashed and counted by distinct repositories and owners: one that many owners hold, or many
repositories of one owner, is an example that was copied about; one that few hold looks live. Further
candidates (long mixed tokens that no base span overlaps) are added to the spans only where their ownership
says that they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Fixed patterns of the base kinds, and the least characters of a match or of its group 2.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are shorter are dropped anyway; a run is matched whole, so the count can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Candidates that the method adds: tokens with letters of both cases and digits.
MIXED = r"[A-Za-z0-9+/_-]{20,}"
#: A value looks live if at most so many owners hold it, in at most so many repositories.
OWNERS, REPOSITORIES = 1, 10
#: Matches whose places are summed at once: each sum copies its list, so one list of all would cost the square of their number.
RUN = 256
_SPAN = "struct<start:bigint,ord:int,kind:string,end:bigint,value:string>"


def _spans(text: Column, pattern: str, kind: str, order: int, least: int = 0) -> Column:
    """array<struct<start, ord, kind, end, value>> of the matches of ``pattern``, in code points.

    Places are summed in runs of RUN matches, and runs are then moved by the lengths of those before.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + m["gap"]
        end = start + F.length(m["match"])
        value = F.regexp_extract(m["match"], pattern, 2) if least else m["match"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.array_append(s["out"], span).alias("out"))

    def summed(run: Column) -> Column:
        return F.aggregate(run, F.expr(f"struct(0L as at, cast(array() as array<{_SPAN}>) as out)"), step)

    def moved(s: Column, run: Column) -> Column:
        spans = F.transform(run["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), (x["end"] + s["at"]).alias("end"), x["value"].alias("value")))
        return F.struct((s["at"] + run["at"]).alias("at"), F.array_append(s["out"], spans).alias("out"))

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(matches) - 1) / RUN), F.lit(0)).cast("int")), lambda k: summed(F.slice(joined, k * RUN + 1, RUN)))
    whole = F.flatten(F.aggregate(runs, F.expr(f"struct(0L as at, cast(array() as array<array<{_SPAN}>>) as out)"), moved, lambda s: s["out"]))
    return F.filter(whole, lambda x: F.length(x["value"]) >= least) if least else whole


def _digest(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("p"), F.xxhash64(F.lit("secret"), value).alias("q"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, owner, repository): counts, digest and spans of secrets.

    doc_id; n_assign, n_access, n_hex; base_sha256 over the base spans; spans with the added ones (kind
    ``mixed``) too; n_live: spans whose value at most ``owners`` owners hold in at most ``repositories`` repositories;
    n_copied: base spans of other values. Null text counts as empty; a null owner is an owner of its own, and so is a null
    repository. Repeated rows are scanned each and count once for ownership. A very long text is scanned whole, in time that follows
    its length. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    # a text without the fixed letters or signs that a pattern needs has no match of it
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    found = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository",
        F.when(F.col("text").rlike("[:=]"), _spans(F.col("text"), ASSIGN, "assign", 0, ASSIGN_LEAST)).otherwise(none).alias("assign"),
        F.when(F.col("text").contains("AKIA"), _spans(F.col("text"), ACCESS, "access", 1)).otherwise(none).alias("access"),
        F.when(F.col("text").rlike(HEX), _spans(F.col("text"), HEX, "hex", 2)).otherwise(none).alias("hex"),
        F.when(F.col("text").rlike(MIXED), _spans(F.col("text"), MIXED, "mixed", 3)).otherwise(none).alias("mixed"),
    )
    base = F.concat("assign", "access", "hex")
    mixed = F.filter("mixed", lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]"))
    found = S.stored(found.withColumn("mixed", mixed), "spans")  # row numbers are fixed from here on
    # a candidate that a base span overlaps is no addition; the two lists of a row meet by their places, not all with all
    placed = found.select("row", "owner", "repository", F.explode(F.concat(base, F.col("mixed"))).alias("s")).select("row", "owner", "repository", "s", _digest(F.col("s.value")).alias("hash"))
    is_base, upto = F.col("s.kind") != "mixed", (Window.unboundedPreceding, 0)
    before = F.max(F.when(is_base, F.col("s.end"))).over(Window.partitionBy("row").orderBy("s.start", "s.ord").rowsBetween(*upto))
    after = F.min(F.when(is_base, F.col("s.start"))).over(Window.partitionBy("row").orderBy(F.desc("s.start"), F.desc("s.ord")).rowsBetween(*upto))
    over = F.coalesce(before > F.col("s.start"), F.lit(False)) | F.coalesce(after < F.col("s.end"), F.lit(False))
    held = S.stored(placed.withColumn("over", over & ~is_base).where("not over").drop("over"), "held")
    by_repository = held.select("hash", "owner", "repository").distinct()
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    ownership = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    # a stored table has a real size, and neither side of the join is aggregated: Spark splits a value that very many rows hold
    copied = S.stored(ownership.where((F.col("owners") > owners) | (F.col("repositories") > repositories)).select("hash", F.lit(True).alias("copied")), "copied")
    judged = held.join(copied, "hash", "left").withColumn("live", F.col("copied").isNull())
    added = F.collect_list(F.when((F.col("s.kind") == "mixed") & F.col("live"), F.col("s")))
    summed = judged.groupBy("row").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live") & (F.col("s.kind") != "mixed")).alias("n_copied"), added.alias("added"))
    out = found.join(summed, "row", "left")
    spans = F.concat(base, F.coalesce("added", none))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
