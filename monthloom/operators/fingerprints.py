"""Fingerprint trees: content hashes of key ranges that add up from leaves to one root.

A leaf covers ``width`` neighbouring keys and a node ``fanout`` nodes of the level below; the top
level is one root over all keys. A node holds its number of rows and two sums of row digests, which
do not depend on row order, partitions or task retries, and which any SQL engine with md5 repeats.
Two tables are compared from the root down, so that only ranges below a difference are looked at.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.staging import stage

MODULUS = 1 << 53
DEPTH = 3


def _sum(value: Column) -> Column:
    """Sum modulo 2**53; wide decimals hold the plain sum of more rows than a table can have."""
    total = F.coalesce(F.sum(value.cast("decimal(16,0)")), F.lit(0).cast("decimal(16,0)"))
    return F.pmod(total, F.lit(MODULUS).cast("decimal(16,0)")).cast("long")


def row_digest(columns: Sequence[str]) -> Column:
    """md5 over the columns in the order given, each as length and text, so that no two rows of
    different values meet in one text. Doubles should be cast to whole numbers or decimals first."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *[
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]))


def fingerprint_tree(
    df: DataFrame, key: str, columns: Sequence[str], width: int = 16, fanout: int = 8,
    depth: int = DEPTH,
) -> DataFrame:
    """Staged ``level, node, first_key, last_key, n_rows, low, high``; ``depth`` is the root.

    ``key`` is a whole number. Rows without a key share the node NULL of each level below the root.
    Rows are read once: a leaf is combined before the shuffle, so a key in a third of the rows is
    one row per task, and higher levels add up staged leaves. An empty table has a root of no rows.
    """
    if width < 1 or fanout < 2 or depth < 1:
        raise ValueError("width, fanout and depth must be positive, fanout at least 2.")
    digest = row_digest(columns)

    def number(begin: int) -> Column:
        return F.conv(F.substring(F.col("__digest"), begin, 12), 16, 10).cast("long")

    leaves = stage(
        df.select(
            F.expr(f"(`{key}` - pmod(`{key}`, {width}L)) div {width}L").alias("leaf"),
            digest.alias("__digest"),
        ).groupBy("leaf").agg(
            F.count(F.lit(1)).alias("n_rows"), _sum(number(1)).alias("low"),
            _sum(number(13)).alias("high"),
        ),
        "fingerprint-leaves",
    )
    out = None
    for level in range(depth + 1):
        step = fanout ** level
        node = (F.lit(0).cast("long") if level == depth
                else F.expr(f"(leaf - pmod(leaf, {step}L)) div {step}L"))
        known = leaves.withColumn("node", node)
        keys = [] if level == depth else ["node"]
        part = known.groupBy(*keys).agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), _sum(F.col("low")).alias("low"),
            _sum(F.col("high")).alias("high"),
            (F.min("leaf") * width if level == depth else F.first("node") * (step * width))
            .alias("first_key"),
            ((F.max("leaf") + 1) * width - 1 if level == depth
             else (F.first("node") + 1) * (step * width) - 1).alias("last_key"),
        )
        if level == depth:
            part = part.withColumn("node", F.lit(0).cast("long"))
        part = part.select(F.lit(level).alias("level"), "node", "first_key", "last_key", "n_rows",
                           "low", "high")
        out = part if out is None else out.unionByName(part)
    return stage(out, "fingerprint-tree")


def changed_ranges(left: DataFrame, right: DataFrame, fanout: int = 8, depth: int = DEPTH
                   ) -> DataFrame:
    """Nodes of two trees (of the same width, fanout and depth) that differ:
    ``level, node, first_key, last_key, n_left, n_right``; a node that one side lacks has no rows.

    One small job per level; a level keeps only children of nodes that differ above it, and equal
    roots end the search at once. A root's bounds are those of its own tree, so they may differ.
    """
    sums = ("n_rows", "low", "high")
    found, parents = None, None
    for level in range(depth, -1, -1):
        sides = []
        for tree, tag in ((left, "left"), (right, "right")):
            nodes = tree.where(F.col("level") == level)
            if parents is not None and level < depth - 1:
                up = F.expr(f"(node - pmod(node, {fanout}L)) div {fanout}L")
                nodes = nodes.join(parents, up.eqNullSafe(F.col("parent")), "left_semi")
            sides.append(nodes.select(
                F.col("node").isNull().alias("none"), F.coalesce("node", F.lit(0)).alias("place"),
                *[F.col(c).alias(f"{c}_{tag}") for c in ("first_key", "last_key", *sums)]))
        same = F.lit(True)
        for c in sums:
            same = same & F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right"))
        differing = stage(
            sides[0].join(sides[1], ["none", "place"], "full").where(~same).select(
                F.lit(level).alias("level"), F.when(~F.col("none"), F.col("place")).alias("node"),
                F.least("first_key_left", "first_key_right").alias("first_key"),
                F.greatest("last_key_left", "last_key_right").alias("last_key"),
                F.coalesce("n_rows_left", F.lit(0)).alias("n_left"),
                F.coalesce("n_rows_right", F.lit(0)).alias("n_right")),
            "fingerprint-changes")
        found = differing if found is None else found.unionByName(differing)
        if differing.isEmpty():
            break
        parents = differing.select(F.col("node").alias("parent"))
    return found
