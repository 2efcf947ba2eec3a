"""What a part needs: the closure of relationships, as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.operators.vectors import work_table

#: Starts times edges up to which pairs of start and node are walked at once.
FEW = 1 << 24


def reach(starts: DataFrame, edges: DataFrame, kinds: Iterable[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """start, node, hops: every node that a start reaches (itself at 0 hops) and the fewest hops to it.

    starts has ``start`` and edges ``source``, ``target`` and, if kinds are named, ``kind``; keep: columns of both that
    must agree (a deck's parts relate within the deck). Each round joins the nodes met last with the edges and drops
    what is known, so cycles end and no path is walked twice; rounds are as many as the longest shortest path.
    """
    keep = keep or []
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(list(kinds)))
    edges = work_table(edges.select(*keep, "source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    cols = [*keep, "start", "node", "hops"]
    last = work_table(starts.where("start IS NOT NULL").select(*keep, "start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct(), "reached")
    known = last
    while not last.isEmpty():
        step = last.join(edges.withColumnRenamed("source", "node"), [*keep, "node"]).select(*keep, "start", F.col("target").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        last = work_table(step.join(known.select(*keep, "start", "node"), [*keep, "start", "node"], "left_anti").select(cols), "reached")
        known = known.unionByName(last)
    return known


def _met(edges: DataFrame, first: DataFrame) -> DataFrame:
    """node: all that lies ahead of the rows of first (node), those among it, as written tables."""
    last = work_table(first, "met")
    known = last
    while not last.isEmpty():
        step = edges.join(last.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        last = work_table(step.join(known, "node", "left_anti"), "met")
        known = known.unionByName(last)
    return known


def sums(starts: DataFrame, edges: DataFrame, kinds: Iterable[str] | None = None, few: int = FEW) -> DataFrame:
    """start, n, nodes: how many nodes each start reaches (itself among them) and their sum.

    What many starts share is walked once. Of a well connected node, the nodes ahead and those behind are found. A start behind
    it reaches all that is ahead, and beside that only what it reaches without going there; a start that is not behind it never
    meets a node that is. So both kinds go on in a smaller graph, until starts times edges are few or a node parts too little:
    then pairs are walked as ``reach`` does.
    """
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(list(kinds)))
    graph = work_table(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    none = F.lit(0).cast("long")
    first = work_table(starts.where("start IS NOT NULL").select("start").distinct().select("start", none.alias("n"), none.alias("nodes")), "starts")
    done, open_ = [first.limit(0)], [(first, graph, first.count() * graph.count())]
    while open_:
        mine, graph, cost = open_.pop()
        parted = _parted(mine, graph) if cost > few else None
        if parted is not None:
            over, left = parted
            costs = [m.count() * g.count() for m, g in left]
            if sum(costs) <= 0.9 * cost:
                done.append(over)
                open_ += [(m, g, c) for (m, g), c in zip(left, costs, strict=True)]
                continue
        if cost:
            met = reach(mine.select("start"), graph).groupBy("start").agg(F.count(F.lit(1)).alias("more"), F.sum("node").alias("sum"))
            done.append(mine.join(met, "start").select("start", (F.col("n") + F.col("more")).alias("n"), (F.col("nodes") + F.col("sum")).alias("nodes")))
        else:  # no start, or no edge: each meets itself
            done.append(mine.select("start", (F.col("n") + 1).alias("n"), (F.col("nodes") + F.col("start")).alias("nodes")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _parted(mine: DataFrame, graph: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]] | None:
    """Starts that are settled by one node, and the others with the graphs they go on in; None if no node has edges both ways."""
    ways = graph.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out")).join(graph.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("in")), "node")
    pivot = ways.orderBy(F.desc(F.least("out", "in")), "node").select("node").limit(1)
    pivot = work_table(pivot, "pivot")
    if pivot.isEmpty():
        return None
    ahead, behind = _met(graph, pivot), _met(graph.select(F.col("target").alias("source"), F.col("source").alias("target")), pivot)
    total = ahead.agg(F.count(F.lit(1)).alias("n_ahead"), F.sum("node").alias("sum_ahead"))  # one row
    on = lambda nodes, name: nodes.withColumnRenamed("node", name)
    through = mine.join(on(behind, "start"), "start", "left_semi").crossJoin(F.broadcast(total)).select("start", (F.col("n") + F.col("n_ahead")).alias("n"), (F.col("nodes") + F.col("sum_ahead")).alias("nodes"))
    through = work_table(through, "through")
    beside = work_table(mine.join(on(behind, "start"), "start", "left_anti"), "beside")
    # What is ahead has edges to what is ahead only, and what is not behind to what is not behind only.
    apart = work_table(graph.join(on(ahead, "target"), "target", "left_anti").select("source", "target"), "apart")
    off = work_table(graph.join(on(behind, "source"), "source", "left_anti").select("source", "target"), "off")
    over, more = (work_table(through.join(on(ahead, "start"), "start", how), "through") for how in ("left_semi", "left_anti"))
    return over, [(more, apart), (beside, off)]
