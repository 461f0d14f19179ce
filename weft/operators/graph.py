"""Graphs as frames of edges: components, reachability, cliques."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import cut


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 200) -> DataFrame:
    """node, component (the smallest node of the component).

    edges: a, b of one orderable type.  Large-star and small-star rounds in
    turn: every node links its larger neighbours, then its smaller ones, to the
    smallest, until the edges no longer change.  The rounds grow with the
    logarithm of the nodes; every round is written.  nodes adds nodes without
    edges; nulls and loops are left out.  When the guard rounds is reached, an
    error says so.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    if nodes is not None:
        n = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct()
        found = n.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return found


def strong_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) of a directed graph: the nodes that reach one another.

    Each round colours every open node by the largest node that reaches it,
    then takes the nodes of a colour that reach its root.  For small graphs.
    """
    open_ = cut(edges.where("a is not null and b is not null").select("a", "b").distinct())
    nodes = cut(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    done = None
    for _ in range(rounds):
        if nodes.isEmpty():
            break
        colour = _spread(open_, nodes.select("node", F.col("node").alias("c")), True)
        # Backwards inside a colour, from its root.
        inside = open_.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b")
        reach = _spread(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.where("node = c"), False)
        found = cut(reach.select("node", "c"))
        done = found if done is None else done.unionByName(found)
        taken = found.select("node")
        nodes = cut(nodes.join(taken, "node", "left_anti"))
        open_ = cut(open_.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi"))
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = done.groupBy("c").agg(F.min("node").alias("component"))
    return done.join(least, "c").select("node", "component")


def _spread(edges: DataFrame, state: DataFrame, largest: bool, rounds: int = 1000) -> DataFrame:
    """Carries c along the edges until nothing changes: the largest c that reaches a node, or plain reachability."""
    state = cut(state)
    before = None
    for _ in range(rounds):
        moved = edges.join(state.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "c")
        state = cut(state.unionByName(moved).groupBy("node").agg(F.max("c").alias("c")))
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "c").cast("decimal(38,0)"))).first()
        if now == before:
            return state
        before = now
    raise RuntimeError(f"no end after {rounds} rounds")


def cliques(edges: DataFrame) -> DataFrame:
    """component, clique (sorted array) of all maximal cliques: Bron-Kerbosch with a pivot, one component at a time.

    A component is held by one task; for graphs of small components, such as
    columns of files.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    c = components(e)
    e = e.join(c.select(F.col("node").alias("a"), "component"), "a")
    kind = dict(e.dtypes)["a"]

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(rows["a"], rows["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        out: list = []
        stack = [(set(), set(near), set())]
        while stack:
            r, p, x = stack.pop()
            if not p and not x:
                out.append(sorted(r))
                continue
            pivot = max(p | x, key=lambda v: (len(near[v] & p), str(v)))
            for v in sorted(p - near[pivot]):
                stack.append((r | {v}, p & near[v], x & near[v]))
                p, x = p - {v}, x | {v}
        return pd.DataFrame({"component": [rows["component"].iloc[0]] * len(out), "clique": out})

    return e.groupBy("component").applyInPandas(find, f"component {kind}, clique array<{kind}>")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """The graph with every edge turned round."""
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def overlap_graph(sets: DataFrame, least) -> DataFrame:
    """a < b, sim of the sets (set_id, element) whose Jaccard passes least (a function of a column): an inverted index, no all-pairs comparison."""
    from weft.functions.metrics import jaccard

    s = sets.select("set_id", "element").distinct()
    n = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    s = s.join(n, "set_id")
    o = s.selectExpr("set_id a", "n na", "element").join(s.selectExpr("set_id b", "n nb", "element"), "element").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("o"))
    o = o.withColumn("sim", jaccard(F.col("na"), F.col("nb"), F.col("o")))
    return o.where(least(F.col("sim"))).select("a", "b", F.round("sim", 6).alias("sim"))


