"""What changed between consecutive full snapshots, by Merkle trees over hash ranges of the keys.

Each snapshot's keys fall into ``fanout ** depth`` leaves by a hash of the key. A leaf's digest covers its rows in any
order; a node's digest covers those of the leaves below it. Digests are combined by exclusive or of two 64-bit hashes,
so all levels of a tree come from one aggregate over the node prefixes, which merges before the shuffle. Two snapshots
are compared from the root down, and only rows of leaves whose digests differ are compared themselves.

Defined results: NULL and NaN are one missing value, equal to itself; a value that moves to another column is a change.
Of repeated rows of a key in a snapshot the latest delivery counts. Snapshots with no rows at all count as empty; the
first has no differences. Rows with a NULL snapshot or key part take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Stored, latest, store

FANOUT = 64
ROWS_PER_LEAF = 16


def tree_depth(rows_per_snapshot: int, fanout: int = FANOUT, per_leaf: int = ROWS_PER_LEAF) -> int:
    return max(1, math.ceil(math.log(max(1, rows_per_snapshot / per_leaf), fanout)))


def _marked(values: list[str]) -> list:
    """Each value beside a mark of whether it is missing, as hashing skips NULLs and would lose their place."""
    return [e for v in values for e in (F.col(v).isNull(), F.col(v))]


def snapshot_trees(rows: DataFrame, snap: str, keys: list[str], values: list[str], depth: int, fanout: int = FANOUT) -> Stored:
    """(``snap``, ``level``, ``node``, ``d1``, ``d2``) of every node, the root at level 0; one row per key in ``rows``.

    The table may be kept: trees of earlier deliveries with the same depth and fanout are compared as they are.
    """
    leaf = F.pmod(F.xxhash64(*keys), F.lit(fanout**depth))
    hashed = rows.select(snap, leaf.alias("leaf"), F.xxhash64(*keys, *_marked(values)).alias("h1"), F.xxhash64(F.lit(7), *keys, *_marked(values)).alias("h2"))
    leaves = hashed.groupBy(snap, "leaf").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count("*").alias("n"))
    leaves = leaves.select(snap, "leaf", F.xxhash64("leaf", "x1", "x2", "n").alias("d1"), F.xxhash64(F.lit(7), "leaf", "x1", "x2", "n").alias("d2"))
    over = F.array(*[F.struct(F.lit(k).alias("level"), F.expr(f"leaf div {fanout ** (depth - k)}").alias("node")) for k in range(depth + 1)])
    nodes = leaves.select(snap, "d1", "d2", F.explode(over).alias("x")).select(snap, "x.*", "d1", "d2")
    return store(nodes.groupBy(snap, "level", "node").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")), "trees")


def _sides(df: DataFrame, snap: str, pairs: DataFrame) -> DataFrame:
    """Each row once as the later (``is_cur``) and once as the earlier side of a pair of deliveries."""
    both = pairs.select(F.col("cur").alias("_snap"), F.lit(True).alias("is_cur"), F.col("cur").alias("pair")).unionByName(pairs.select(F.col("prev").alias("_snap"), F.lit(False).alias("is_cur"), F.col("cur").alias("pair")))
    return df.join(F.broadcast(both), df[snap] == F.col("_snap")).drop("_snap")  # two rows per delivery


def differing_leaves(trees: DataFrame, snap: str, pairs: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """(``pair``, ``leaf``) whose digests differ, found from the root down: of each level only children of differing nodes."""
    found = None
    for k in range(depth + 1):
        x = _sides(trees.filter(F.col("level") == k), snap, pairs).withColumn("up", F.expr(f"node div {fanout}"))
        if found is not None:
            x = x.join(found, ["pair", "up"], "left_semi")
        side = lambda c, d: F.max(F.when(F.col("is_cur") == c, F.struct("d1", "d2"))).alias(d)
        x = x.groupBy("pair", "up", "node").agg(side(True, "c"), side(False, "p")).filter(~F.col("c").eqNullSafe(F.col("p")))
        found = x.select("pair", F.col("node").alias("up"))
    return found.withColumnRenamed("up", "leaf")


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, snap: str, keys: list[str], values: list[str], loaded: str, fanout: int = FANOUT) -> DataFrame:
    """One row for each key added, removed or changed: ``snap`` (the later one), keys, ``change``.

    ``snapshots`` lists the deliveries in a column ``snap``. Their number is that of delivery days, which bounds the
    windows without a partition and the pair table; leaves are sized so that a leaf has about ROWS_PER_LEAF keys.
    """
    days = snapshots.select(snap).dropna().distinct()
    pairs = days.select(F.col(snap).alias("cur"), F.lag(snap).over(W.orderBy(snap)).alias("prev")).dropna()
    pairs = store(pairs, "pairs").df

    kinds = dict(rows.dtypes)
    narrow = rows.select(snap, *keys, *[F.when(~F.isnan(v), F.col(v)).alias(v) if kinds[v] in ("double", "float") else v for v in values], loaded).dropna(subset=[snap, *keys])
    kept = store(latest(narrow, [snap, *keys], loaded).drop(loaded), "snapshot-rows").df
    most = kept.groupBy(snap).count().agg(F.max("count")).first()[0] or 0
    depth = tree_depth(most, fanout)
    trees = snapshot_trees(kept, snap, keys, values, depth, fanout).df
    differing = store(differing_leaves(trees, snap, pairs, depth, fanout), "leaves")

    leaf = F.pmod(F.xxhash64(*keys), F.lit(fanout**depth))
    sides = _sides(kept.select(snap, *keys, leaf.alias("leaf"), F.struct(*values).alias("_val")), snap, pairs)
    sides = sides.join(differing.hinted(), ["pair", "leaf"], "left_semi")
    side = lambda c, d: F.max(F.when(F.col("is_cur") == c, F.struct("_val"))).alias(d)
    both = sides.groupBy("pair", "leaf", *keys).agg(side(True, "c"), side(False, "p"))
    change = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").when(~F.col("c").eqNullSafe(F.col("p")), "changed")
    return both.select(F.col("pair").alias(snap), *keys, change.alias("change")).filter("change is not null")
