"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import cut, free


def _to_roots(up: DataFrame) -> DataFrame:
    """Follow (label, up) until every label points to a root; each turn makes chains a quarter as long."""
    held, n = up, up.count()
    while True:
        nxt = up.withColumn("before", F.col("up"))
        for _ in range(2):
            above = up.where("label <> up").select(F.col("label").alias("up"), F.col("up").alias("top"))
            nxt = nxt.join(above, "up", "left").select("label", F.coalesce("top", "up").alias("up"), "before")
        nxt = cut(nxt, "roots", n)
        moved = nxt.where("up <> before").limit(1).count()
        free(held)
        held, up = nxt, nxt.select("label", "up")
        if not moved:
            return up


def hooking_rounds(edges: DataFrame) -> list[DataFrame]:
    """One table (label, up) a round, from vertices to their component's label in that round.

    Every label hooks under its smallest neighbour, chains of hooks are followed to their roots, and the edges are
    contracted to roots. A label with a smaller neighbour is gone after one round; one without loses that rank to the
    root that its neighbours hooked under, so in two rounds every label with an edge merges with another one: the labels
    at least halve, whatever the shape, and the tables shrink alike.
    """
    e, rounds = edges, []
    while n := e.count():
        near = e.groupBy("x").agg(F.min("y").alias("y"))
        hooks = cut(near.select(F.col("x").alias("label"), F.least("x", "y").alias("up")), "hooks", n)
        up = _to_roots(hooks)
        rounds.append(up)
        left, right = up.select(F.col("label").alias("x"), F.col("up").alias("a")), up.select(F.col("label").alias("y"), F.col("up").alias("b"))
        nxt = e.join(left, "x").join(right, "y").where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
        nxt = cut(nxt, "edges", n)
        free(e)
        e = nxt
    return rounds


def connected_components(edges: DataFrame, a: str | Column = "a", b: str | Column = "b") -> DataFrame:
    """Label each vertex of the undirected edges with the smallest vertex it can reach.

    Returns (vertex, component). Rounds and the joins of a round are logarithmic in the vertices, for a path too; nothing
    is collected but whether edges are left. Self loops give single components; null ends are ignored.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    e = cut(edges.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null"), "ends")
    n = e.count()
    one = cut(e.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs", n)
    rounds = hooking_rounds(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    free(one)
    alone = e.where("x = y").select(F.col("x").alias("vertex"))
    if not rounds:
        return alone.select("vertex", F.col("vertex").alias("component")).distinct()
    found = rounds[-1].select("label", F.col("up").alias("component"))
    for up in reversed(rounds[:-1]):
        found = up.join(found.withColumnRenamed("label", "_root"), F.col("up") == F.col("_root"), "left").select("label", F.coalesce("component", "up").alias("component"))
    found = found.select(F.col("label").alias("vertex"), "component")
    rest = alone.join(found.select("vertex"), "vertex", "left_anti").distinct()
    return found.unionByName(rest.select("vertex", F.col("vertex").alias("component")))
