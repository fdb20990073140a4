"""Comparing the members of large groups in bounded tiles.

A group of n members is dealt into blocks of at most ``block`` members; each pair of blocks is a tile, and a task sees
one tile at a time. Pairs are looked at inside tiles only: what comes out is links that span the group, or counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(members: DataFrame, blocks: Column, spread: Column) -> DataFrame:
    """Adds tile columns i <= j: a member of block b is in the tiles (min(b, x), max(b, x)) for each block x."""
    out = members.withColumn("n_blocks", blocks.cast("int")).withColumn("block", F.pmod(spread, F.col("n_blocks")).cast("int"))
    return out.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("*", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j")).drop("x", "n_blocks")


def forest(pairs) -> list[tuple[int, int]]:
    """The pairs that join two parts not joined before."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs:
        p, q = top(a), top(b)
        if p != q:
            parent[p] = q
            out.append((a, b))
    return out
