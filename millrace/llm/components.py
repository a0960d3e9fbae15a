"""Connected components by contraction; every step is a join or an aggregate over all links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage


#: So few links, whatever their number was at first, are settled by one task instead of further rounds.
FEW = 1 << 16


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each node of at most ``FEW`` links goes: to the first node of its component."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = [x for x in up if top(x) != x]
    yield pd.DataFrame({"node": nodes, "goes": [top(x) for x in nodes]}, dtype="int64")


def _follow(links: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """Replace a node by where it goes; a node that goes nowhere stays."""
    there = to.select(F.col("node").alias(column), F.col("goes").alias("__goes"))
    kept = [c for c in links.columns if c != column]
    return links.join(there, column, "left").select(F.coalesce("__goes", column).alias(column), *kept)


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (a, b: numbers); equal roots mean connected.

    A round ranks the nodes by a hash of its own, sends each node to the first of its neighbours if that is
    before itself, and rewrites the links. A node then stays with a chance that does not depend on how ids
    lie along the links, so that the rounds grow with the logarithm of the nodes, on a chain of rising ids
    as elsewhere. Rounds end when no more than ``few`` links are left, which one task settles. Links between a
    node and itself are ignored. A table without links gives one without rows. The small tables are staged
    before they are joined, so that adaptive execution can split the links of a node that has very many.
    """
    links = links.select("a", "b").where("a <> b")
    nodes = stage(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), "members")
    rounds = []
    while True:
        number = F.lit(len(rounds))

        def placed(node: str) -> Column:
            return F.struct(F.xxhash64(node, number).alias("h"), F.col(node).alias("node"))

        ordered = links.select(F.greatest(placed("a"), placed("b"))["node"].alias("a"), F.least(placed("a"), placed("b"))["node"].alias("b"))
        links = stage(ordered.distinct(), "contracted")
        left = links.count()
        if left <= few:
            if left:
                rounds.append(stage(links.coalesce(1).mapInPandas(_settled, "node long, goes long"), "goes"))
            break
        goes = stage(links.groupBy(F.col("a").alias("node")).agg(F.min(placed("b"))["node"].alias("goes")), "goes")
        rounds.append(goes)
        links = _follow(_follow(links, "a", goes), "b", goes).where("a <> b")
    found = nodes.withColumn("root", F.col("node"))
    for goes in rounds:
        found = stage(_follow(found, "root", goes), "roots")
    return found.select("node", "root")
