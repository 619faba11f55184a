"""Merkle manifest of a table (operator 13): a node store on disk, a table a level, and proofs by merge-scans.

Leaves are sorted by (group, doc_id) in ranges and get their place from the ranges' counts. Runs of consecutive nodes are
written as one row of their level; the next level reads the one before it from front to back, and is a fraction of it.
Proofs go the other way: a run meets its own node in the level above by coordinate (group, place), as both are sorted by it.
Digests are lowercase hex text. No group, level or proof is ever in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Nodes to a run.
FAN = 8
#: Columns of a leaf, in the order in which they are hashed.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_NODE = "array<struct<left:string,right:string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the count of bytes in UTF-8, a colon and the value; integers in decimals."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's COLUMNS, with ``changed`` in place of those columns."""
    return F.sha2(F.concat(*[framed(changed.get(c, F.col(c))) for c in COLUMNS]), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its proof (siblings left and right of it, level by level)."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a proof."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


@dataclass
class Tree:
    """Runs of each level, (g, run, size, kids), where size counts the group's nodes in the level; tops (g, digest) hold each group's last node."""

    levels: list[DataFrame]
    lone: DataFrame
    tops: DataFrame


def grown(nodes: DataFrame, name: str, carried: list[str]) -> Tree:
    """The levels over ``nodes`` (g, pos from 0, size, digest, and ``carried`` columns that stay with the first level)."""
    most = nodes.agg(F.max("size").alias("n"), F.count("*").alias("rows")).first()
    size, rows = most["n"] or 0, most["rows"]
    lone, levels = nodes.where("size = 1"), []
    tops = lone.select("g", "digest")
    while size > 1:
        kid = F.struct("pos", "digest", *(carried if not levels else []))
        runs = nodes.where("size > 1").groupBy("g", F.floor(F.col("pos") / FAN).alias("run"), "size").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        runs = S.stored(runs, f"{name}-level-{len(levels)}", rows)
        levels.append(runs)
        digest = F.sha2(F.array_join(F.col("kids.digest"), ""), 256)
        nodes = runs.select("g", F.col("run").alias("pos"), F.ceil(F.col("size") / FAN).alias("size"), digest.alias("digest"))
        size, rows = -(-size // FAN), -(-rows // FAN) + 1
        tops = tops.union(nodes.where("size = 1").select("g", "digest"))
    return Tree(levels, lone, tops)


def proven(tree: Tree, tops: DataFrame, carried: list[str]) -> DataFrame:
    """(g, pos, digest, carried, path, and the other columns of ``tops``) for each node of the first level; ``tops`` has (g, path) of the last nodes.

    From the top down: the runs of a level meet the nodes of the level above, which hold the rest of the path.
    """
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = None
    for depth in range(len(tree.levels) - 1, -1, -1):
        runs = tree.levels[depth]
        met = runs.where(F.col("size") <= FAN).join(tops, "g")
        if above is not None:
            met = met.unionByName(runs.where(F.col("size") > FAN).hint("merge").join(above, ["g", "run"]))
        kids = met.select("g", "kids", "path", *more, F.posexplode("kids").alias("i", "kid"))
        digests = F.col("kids.digest")
        left = F.array_join(F.slice(digests, F.lit(1), F.col("i")), "")
        right = F.array_join(F.slice(digests, F.col("i") + 2, F.lit(FAN)), "")
        path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
        own = ["digest", *carried] if not depth else ["digest"]
        above = kids.select("g", F.col("kid.pos").alias("run"), *[F.col(f"kid.{c}").alias(c) for c in own], path.alias("path"), *more)
        if depth:
            above = above.drop("digest")
    alone = tree.lone.select("g", F.col("pos").alias("run"), "digest", *carried).join(tops, "g")
    return alone if above is None else alone.unionByName(above)


@dataclass
class Manifest:
    """The root (null of an empty table), and ``leaves``: doc_id, leaf, subroot, path, and what was carried along."""

    root: str | None
    leaves: DataFrame


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None) -> Manifest:
    """A tree over the rows of ``docs`` (doc_id, source, lang, n_chars, text): a subtree a lang, and a tree over their roots.

    A leaf is the digest of the five values. In a lang leaves ascend by doc_id (null first, ties by digest: equal rows have
    equal leaves, each with a place of its own); every FAN nodes in order become one, the last run of fewer too, until one
    is left. Langs ascend bytewise, null first. ``carried`` names columns that are made from each row in the same pass.
    Nulls in any column are hashed as ``-``; very long texts are hashed as they stream by; other columns are ignored;
    an empty table has no root and no leaves.
    """
    carried = carried or {}
    g = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # "-" comes before "="
    rows = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), *[c.alias(k) for k, c in carried.items()])
    placed = S.placed(rows, "g", [F.col("doc_id"), F.col("digest")], "leaves")
    tree = grown(placed, "nodes", ["doc_id", *carried])
    tops = S.stored(S.placed(tree.tops.select(F.lit("").alias("all"), "g", "digest"), "all", [F.col("g")], "tops").withColumnRenamed("g", "lang"), "subroots")
    upper = grown(tops.select(F.col("all").alias("g"), "pos", "size", "digest", "lang"), "upper", ["lang"])
    root = upper.tops.first()
    start = docs.sparkSession.createDataFrame([("", [])], f"g string, path {_NODE}")
    paths = S.stored(proven(upper, start, ["lang"]).select(F.col("lang").alias("g"), F.col("digest").alias("subroot"), "path"), "paths")
    leaves = proven(tree, paths, ["doc_id", *carried])
    return Manifest(root and root["digest"], leaves.select("doc_id", F.col("digest").alias("leaf"), "subroot", "path", *carried))


def verified(found: Manifest, leaf: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row; ``leaf`` is the digest to fold, else the row's own."""
    root = F.lit(found.root).cast("string")
    out = found.leaves.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("leaf") if leaf is None else leaf, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
