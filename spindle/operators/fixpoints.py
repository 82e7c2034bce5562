"""Operators that iterate to a fixpoint: components, breadth-first levels, spanning forests.

Each round is a DataFrame job over the whole table, written to the shared folder; the driver
sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import written
from .joins import Spokes, join_dealt, join_heavy, ranked


def component_labels(graph: Graph) -> DataFrame:
    """(id, label): the smallest id of each node's weak component.

    Every node goes to the smallest of itself and its neighbours, and the edges are contracted by
    that map, until none is left; each round at least halves the nodes that have edges.  Hubs are
    joined apart from the other nodes.
    """
    if graph.half is not None:
        edges = graph.half.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    else:
        e = graph.edges.where("src <> dst")
        edges = written(e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "cc-edges")
    maps = []
    while n := edges.count():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to"), F.count("*").alias("n")), "cc-map")
        maps.append(step)
        left = join_heavy(edges, step.withColumnRenamed("to", "a"), "u", "n", n).select("a", "v")
        pairs = join_heavy(left, step.select(F.col("u").alias("v"), F.col("to").alias("b"), "n"), "v", "n", n).where("a <> b")
        edges = written(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges")
    labels = graph.ids.withColumn("label", F.col("id"))
    for k, step in enumerate(maps):
        if k == 0:  # each node is a label of its own yet
            labels = written(labels.join(step.select(F.col("u").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "cc-labels")
            continue
        held = labels.groupBy("label").agg(F.count("*").alias("held"))
        to = held.join(step.select(F.col("u").alias("label"), "to"), "label")
        labels = written(join_heavy(labels, to, "label", "held", labels.count(), "left").select("id", F.coalesce("to", "label").alias("label")), "cc-labels")
    return labels


def _labels_of_spokes(graph: Graph, near: Spokes) -> DataFrame:
    """``component_labels`` of a graph whose ``near`` edges hold both directions.

    The least neighbour of each node and one more make up few edges that join nearly all of a component; then all edges
    are asked once whether their ends' labels differ, and only those that do are contracted.
    """
    two = near.light.groupBy("src").agg(F.min("dst").alias("a"), F.min_by("dst", F.xxhash64("src", "dst")).alias("b"))
    labels = component_labels(Graph.from_edges(two.select("src", F.explode(F.array("a", "b")).alias("dst")), graph.ids))
    said = near.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a"))).where("src < dst").select("dst", "a").distinct()
    apart = join_dealt(said, labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a <> b")
    apart = written(apart.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "cc-apart")
    if not apart.limit(1).count():
        return labels
    to = component_labels(Graph.from_edges(apart)).select(F.col("id").alias("label"), F.col("label").alias("to"))
    held = join_dealt(labels.groupBy("label").agg(F.count("*").alias("held")), to, "label")
    return written(join_heavy(labels, held, "label", "held", labels.count(), "left").select("id", F.coalesce("to", "label").alias("label")), "cc-labels")


def components(graph: Graph) -> DataFrame:
    """(id, component): components numbered by size, 0 the largest, ties by smallest id."""
    labels = component_labels(graph)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    rank = ranked(sizes, "component", F.desc("n"), F.asc("label"))
    return join_heavy(labels, rank, "label", "n", labels.count()).select("id", "component")


def largest_component(graph: Graph, relabel: bool = True) -> Graph:
    return graph.subgraph(components(graph).where("component = 0").select("id"), relabel)


def is_connected(graph: Graph) -> DataFrame:
    return component_labels(graph).agg((F.count_distinct("label") <= 1).alias("connected"), F.count_distinct("label").alias("n_components"))


def bfs(graph: Graph, start: int = 0, restart: bool = True) -> DataFrame:
    """(id, root, level, parent): levels by breadth; of several discoverers the smallest is the parent.

    With ``restart`` the search goes on from the smallest node of every component not reached yet.
    """
    roots = graph.ids.where(F.col("id") == start)
    edges = graph.edges.select("src", "dst") if graph.half is not None else written(graph.edges.select("src", "dst"), "bfs-edges")
    near = Spokes.of(edges, edges.count())
    if restart:
        labels = component_labels(graph) if graph.half is None else written(_labels_of_spokes(graph, near), "bfs-labels")
        taken = labels.join(roots, "id", "left_semi").select("label")
        roots = roots.unionAll(labels.where("id = label").join(taken, "label", "left_anti").select("id"))
    first = written(roots.select("id", F.col("id").alias("root"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent")), "bfs")

    def step(front: DataFrame, seen: DataFrame, level: int) -> DataFrame:
        found = _unseen(near.join(front.select(F.col("id").alias("src"))).select("dst", "src"), seen, "parent")
        named = join_dealt(found, front.select(F.col("id").alias("parent"), "root"), "parent")
        return written(named.select("id", "root", F.lit(level).alias("level"), "parent"), "bfs-front")

    return reduce(DataFrame.unionAll, _fronts(graph, first, step, restart))


def _fronts(graph: Graph, first: DataFrame, step: Callable, whole: bool) -> list[DataFrame]:
    """Fronts, level by level, each a table of its own: ``step(front, seen, level)`` writes the next one, without ids ``seen``.

    Where edges are known to go both ways a neighbour lies one level off at most, so that only the last two fronts are asked;
    and a search that reaches the ``whole`` graph ends with its last node.
    """
    fronts, both = [first], graph.half is not None
    left = graph.nodes.count() - first.count() if both and whole else None
    while left is None or left > 0:
        seen = reduce(DataFrame.unionAll, [f.select("id") for f in (fronts[-2:] if both else fronts)])
        front = step(fronts[-1], seen, len(fronts))
        n = front.count()
        if not n:
            break
        fronts.append(front)
        left = left if left is None else left - n
    return fronts


def _unseen(said: DataFrame, seen: DataFrame, name: str) -> DataFrame:
    """(id, name): the least that is ``said`` (id, a long) of each id that isn't ``seen``, by one sum: a join would move all edges."""
    rows = said.toDF("id", name).withColumn("old", F.lit(False)).unionAll(seen.select("id", F.lit(None).cast("long"), F.lit(True)))
    return rows.groupBy("id").agg(F.min(name).alias(name), F.bool_or("old").alias("old")).where("not old").drop("old")


def first_reachers(graph: Graph, start: int | None = None) -> DataFrame:
    """(id, root): the first of the nodes from which a path leads to ``id`` (itself included); ``start`` is before all others, then ids ascend.

    Where every edge has its reverse these are the components. Else roots spread along edges: only nodes whose root got
    smaller in a round speak in the next one.
    """
    if graph.half is not None:
        return _first_of(component_labels(graph), start)
    e = written(graph.edges.where("src <> dst").select("src", "dst").distinct(), "reach-edges")
    one_way = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").limit(1).count()
    if not one_way:
        return _first_of(component_labels(Graph.from_edges(e, graph.ids)), start)
    place = F.struct((F.col("id") != F.lit(start)).alias("later") if start is not None else F.lit(True).alias("later"), F.col("id").alias("id"))
    best = written(graph.ids.select("id", place.alias("best"), F.lit(True).alias("changed")), "reach")
    degree = written(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "reach-degree")
    n_edges = e.count()
    while best.where("changed").limit(1).count():
        said = best.where("changed").join(degree, "id").select(F.col("id").alias("src"), "best", "n")
        heard = join_heavy(e, said, "src", "n", n_edges).groupBy(F.col("dst").alias("id")).agg(F.min("best").alias("heard"))
        less = F.col("heard").isNotNull() & (F.col("heard") < F.col("best"))
        best = written(best.join(heard, "id", "left").select("id", F.when(less, F.col("heard")).otherwise(F.col("best")).alias("best"), less.alias("changed")), "reach")
    return best.select("id", F.col("best.id").alias("root"))


def _first_of(labels: DataFrame, start: int | None) -> DataFrame:
    """(id, root) of components (id, label): ``start`` or else the label."""
    if start is None:
        return labels.withColumnRenamed("label", "root")
    mine = labels.where(F.col("id") == start).select("label", F.lit(start).cast("long").alias("root"))
    return labels.join(F.broadcast(mine), "label", "left").select("id", F.coalesce("root", "label").alias("root"))


def bfs_order(graph: Graph, start: int = 0, restart: bool = True) -> DataFrame:
    """(id, visit, root, level, parent): the order in which a queue visits the nodes, from 0.

    A visited node adds its unseen neighbours by ascending id; an empty queue goes on from the smallest unseen node if
    ``restart`` is set.  All searches run at once: a node belongs to the first root that reaches it, and within
    a level the queue's order is that of (place of the parent, id), numbered by ranges.  Without
    ``start`` among the nodes the search begins at the smallest one; without ``restart`` only what ``start`` reaches is returned.
    Parallel edges and loops change nothing; edges whose ends are no nodes are ignored.
    """
    if both := graph.half is not None:
        edges, total = graph.edges.select("src", "dst"), 2 * graph.half.count()
        near = Spokes.of(edges, total)
    else:
        edges = graph.edges.where("src <> dst").select("src", "dst").distinct()
    if both and restart:
        owner = _first_of(_labels_of_spokes(graph, near), start)
        roots = written(owner.where("id = root").select("id"), "order-roots")
    elif restart:
        owner = written(first_reachers(graph, start), "order-owner")
        edges = edges.join(owner.select(F.col("id").alias("src"), F.col("root").alias("ra")), "src").join(owner.select(F.col("id").alias("dst"), F.col("root").alias("rb")), "dst").where("ra = rb").select("src", "dst")
        roots = owner.where("id = root").select("id")
    else:
        edges = edges.join(graph.ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        roots = graph.ids.where(F.col("id") == start)
    if not both:
        edges = written(edges, "order-edges")
        near = Spokes.of(edges, edges.count())
    first = written(ranked(roots.select("id", F.col("id").alias("root"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent")), "at", F.col("id") != start, "id"), "order")

    def step(front: DataFrame, seen: DataFrame, level: int) -> DataFrame:
        # A place names the parent, so that only (id, place) is sent along edges.
        found = _unseen(near.join(front.select(F.col("id").alias("src"), "at")).select("dst", "at"), seen, "before")
        named = join_dealt(found, front.select(F.col("at").alias("before"), F.col("id").alias("parent"), "root"), "before")
        fresh = written(named.select("id", "root", F.lit(level).alias("level"), "parent", "before"), "order-found")
        return written(ranked(fresh, "at", "before", "id").select("id", "root", "level", "parent", "at"), "order")

    seen = reduce(DataFrame.unionAll, _fronts(graph, first, step, restart))
    return ranked(seen, "visit", F.col("root") != start, "root", "level", "at").select("id", "visit", "root", "level", "parent")


def spanning_forest(graph: Graph, maximise: bool = False) -> DataFrame:
    """(src, dst, weight) with src < dst: Boruvka's minimum (maximum) spanning forest; equal weights by (src, dst)."""
    w = -F.col("weight") if maximise else F.col("weight")
    edges = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", w.alias("cost"))
    edges = written(edges.groupBy("src", "dst").agg(F.min("cost").alias("cost"), F.min_by("weight", "cost").alias("weight")).withColumns({"a": F.col("src"), "b": F.col("dst")}), "mst")
    chosen = None
    while edges.limit(1).count():
        pick = F.min(F.struct("cost", "src", "dst", "weight", "a", "b"))
        ends = edges.select(F.col("a").alias("c"), "*").unionByName(edges.select(F.col("b").alias("c"), "*"))
        best = written(ends.groupBy("c").agg(pick.alias("e")).select("e.*").distinct(), "mst-pick")
        chosen = best.select("src", "dst", "weight") if chosen is None else written(chosen.unionAll(best.select("src", "dst", "weight")), "mst-tree")
        merged = Graph.from_edges(best.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        label = component_labels(merged)
        edges = written(
            edges.join(label.select(F.col("id").alias("a"), F.col("label").alias("na")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("label").alias("nb")), "b", "left")
            .select("src", "dst", "cost", "weight", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")).where("a <> b"),
            "mst",
        )
    return chosen if chosen is not None else graph.edges.limit(0).select("src", "dst", "weight")


def bottlenecks(graph: Graph, maximise: bool = False) -> DataFrame:
    """(src, dst, weight, cost, bottleneck) for every edge, src < dst: the largest cost on its path in the minimum (maximum) spanning forest.

    In each of Boruvka's rounds a component picks its cheapest edge.  In the tree of these merges, where the way up
    from a component costs what it picked, the largest cost between two leaves is that between the nodes in
    the spanning forest; so every edge climbs from both ends, a round at a time, until these meet.  Costs are weights, negative for a maximum forest.
    """
    w = -F.col("weight") if maximise else F.col("weight")
    edges = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", w.alias("cost"))
    edges = edges.groupBy("src", "dst").agg(F.min("cost").alias("cost"), F.min_by("weight", "cost").alias("weight"))
    open_ = written(edges.withColumns({"a": F.col("src"), "b": F.col("dst"), "worst": F.lit(float("-inf"))}), "bottleneck")
    done = None
    while n := open_.count():
        ends = open_.select(F.col("a").alias("c"), "*").unionByName(open_.select(F.col("b").alias("c"), "*"))
        pick = ends.groupBy("c").agg(F.min(F.struct("cost", "src", "dst", "a", "b")).alias("e"), F.count("*").alias("n"))
        pick = written(pick.select("c", "n", "e.cost", "e.a", "e.b"), "bottleneck-pick")
        label = component_labels(Graph.from_edges(pick.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        up = written(pick.select("c", "n", "cost").join(label.select(F.col("id").alias("c"), "label"), "c"), "bottleneck-up")
        step = open_
        for end in ("a", "b"):
            side = up.select(F.col("c").alias(end), "n", F.col("cost").alias(f"{end}_cost"), F.col("label").alias(f"{end}_up"))
            step = join_heavy(step, side, end, "n", n)
        step = step.select("src", "dst", "weight", "cost", F.col("a_up").alias("a"), F.col("b_up").alias("b"), F.greatest("worst", "a_cost", "b_cost").alias("worst"))
        step = written(step, "bottleneck")
        met = step.where("a = b").select("src", "dst", "weight", "cost", F.col("worst").alias("bottleneck"))
        done = met if done is None else done.unionAll(met)
        open_ = written(step.where("a <> b"), "bottleneck-open")
    return done if done is not None else open_.select("src", "dst", "weight", "cost", F.col("worst").alias("bottleneck"))
