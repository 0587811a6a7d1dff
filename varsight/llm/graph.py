"""Connected components by alternating star contractions of an edge table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class GraphConfig:
    """hub_rows: neighbours beyond which a node's edges are dealt to several tasks;
    the bound is at least the edges divided by ``hubs``, so that no more nodes
    than that are beyond it.  hub_parts: tasks of such a node.  max_rounds: limit.
    """

    hub_rows: int = 256
    hubs: int = 1024
    hub_parts: int = 64
    max_rounds: int = 60


DEFAULT = GraphConfig()


def _hubs(both: DataFrame, cfg: GraphConfig) -> tuple[bool, list[tuple[int, int]], list[tuple[int, int]]]:
    """Of edges in both directions: whether all is stars around smallest nodes, and the hubs with their smallest neighbour.

    Hubs are the nodes of too many neighbours, then those of too many smaller
    ones.  A node's edges are counted before they are shuffled.
    """
    low = F.when(F.col("b") < F.col("a"), F.col("b"))
    nodes = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count(low).alias("n_low"), F.min("b").alias("least"), F.max(low).alias("low"), F.max("b").alias("high"))
    # an end of a star has one smaller neighbour and no larger one
    astray = F.col("low").isNotNull() & ((F.col("low") != F.col("least")) | (F.col("high") > F.col("a")))
    total, most, unsettled = nodes.agg(F.sum("n"), F.max("n"), F.count(F.when(astray, 1))).first()
    bound = max(cfg.hub_rows, (total or 0) // cfg.hubs)
    if not unsettled or most <= bound:
        return not unsettled, [], []
    rows = nodes.where(F.col("n") > bound).select("a", "least", "n_low").collect()
    return False, [(r["a"], r["least"]) for r in rows], [(r["a"], r["least"]) for r in rows if r["n_low"] > bound]


def _stars(edges: DataFrame, large: bool, hubs: list[tuple[int, int]], cfg: GraphConfig) -> DataFrame:
    """Edges towards the smallest neighbour of each ``a``.

    Large stars move the neighbours above ``a`` to the smallest of it and its
    neighbours.  Small stars, whose neighbours all lie below ``a``, move ``a``
    and the other neighbours to the smallest.  A node's rows stream through a
    running frame.  The edges of hubs go to several tasks, each of which also
    gets the hub's smallest neighbour.
    """
    edges, of = edges.select("a", "b"), ["a"]
    if hubs:
        spark = edges.sparkSession
        known = F.broadcast(spark.createDataFrame(hubs, "hub long, least long"))
        part = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(cfg.hub_parts)).cast("int")).otherwise(F.lit(0))
        dealt = edges.join(known, F.col("a") == F.col("hub"), "left").select("a", "b", part.alias("part"))
        heads = spark.createDataFrame([(a, b, k) for a, b in hubs for k in range(cfg.hub_parts)], "a long, b long, part int")
        edges, of = dealt.unionByName(heads), ["a", "part"]
    mine = Window.partitionBy(*of).orderBy("b")
    least = F.first("b").over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = edges.select("a", "b", least.alias("least"), F.lag("b").over(mine).alias("last"))
    if large:
        return rows.where("b > a and (last is null or last != b) and b != least(least, a)").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
    # the first row, that of the smallest, stands for the node itself
    return rows.where("last is null or last != b").select(F.when(F.col("last").isNull(), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))


def connected_components(edges: DataFrame, cfg: GraphConfig = DEFAULT) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, component)``; component is its smallest node.

    Nodes that no edge between two different nodes names are absent.  A round
    is two shuffles of the edges and at least halves path lengths; its edges go
    to the shared folder.  Rounds end when every node is the end of one edge or
    smaller than all its neighbours.  Null ends are ignored; an empty edge table
    gives an empty result.

    A node with very many neighbours is no hot spot: its edges are dealt to
    ``hub_parts`` tasks.  After large stars a node has one edge for each smaller
    neighbour it had, so small stars need that only in the first step.
    """
    down = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialize(down, "edges")
    for step in range(cfg.max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        settled, hubs, lower = _hubs(both, cfg)
        if settled:
            break
        stars = _stars(_stars(both, True, hubs, cfg), False, [], cfg) if step else _stars(current, False, lower, cfg)
        current = materialize(stars, "edges")
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
