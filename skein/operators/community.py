"""Community cut of the document graph: best parent, weak-link cut, components of the forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.articles import Settings
from skein.session import cut_lineage


def best_parents(edges: DataFrame) -> DataFrame:
    """The lightest in-edge of every target, ties to the earlier source: ``node, parent, weight``. Zero weights are no edges."""
    best = edges.where("weight <> 0").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("weight", "src_pos", "src")).alias("b"))
    return best.select("node", F.col("b.src").alias("parent"), F.col("b.weight").alias("weight"))


def first_seen(edges: DataFrame) -> DataFrame:
    """``node, seen``: where a node first appears in the order in which edges are emitted."""
    src = edges.select(F.col("src").alias("node"), F.struct(F.col("src_pos").alias("s"), F.col("dst_pos").alias("o"), F.lit(0).alias("e")).alias("seen"))
    dst = edges.select(F.col("dst").alias("node"), F.struct(F.col("src_pos").alias("s"), F.col("dst_pos").alias("o"), F.lit(1).alias("e")).alias("seen"))
    return src.unionByName(dst).groupBy("node").agg(F.min("seen").alias("seen"))


def forest_roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``node, root`` by pointer jumping: as many rounds as the logarithm of the deepest path."""
    up = cut_lineage(nodes.select("node").join(parents.select("node", "parent"), "node", "left").select("node", F.coalesce("parent", "node").alias("root")))
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        up = cut_lineage(up.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
        moved = not up.where("moved").isEmpty()
        up = up.select("node", "root")
        if not moved:
            return up


def weak_link_cut(parents: DataFrame, roots: DataFrame, seen: DataFrame, p: Settings) -> DataFrame:
    """The forest without edges heavier than their component's cut whose target has more than ``p.outdegree`` children.

    The cut is a percentile of the component's weights. With th "auto" its rank is 1.5 (p75 - p25) p75, of the component seen
    first or of each; weights are compared at 12 decimals.
    """
    rows = parents.join(roots, "node").withColumn("weight", F.round("weight", 12))
    if p.th == "auto":
        quarter = rows.groupBy("root").agg(F.percentile("weight", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
        th = F.lit(1.5) * (F.col("q")[1] - F.col("q")[0]) * F.col("q")[1]
        if p.auto_scope == "first":
            order = roots.join(seen, "node").groupBy("root").agg(F.min("seen").alias("seen"))
            first = quarter.join(order, "root").orderBy("seen").limit(1).select(th.alias("th"))
            ranks = quarter.select("root").crossJoin(F.broadcast(first))  # one row
        else:
            ranks = quarter.select("root", th.alias("th"))
        rank = F.least(F.greatest(F.col("th"), F.lit(0.0)), F.lit(100.0)) / 100
        w = Window.partitionBy("root").orderBy("weight")
        placed = rows.join(ranks, "root").withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("root")))
        k = rank * (F.col("n") - 1)
        low = F.max(F.when(F.col("i") == F.floor(k), F.col("weight"))).alias("low")
        high = F.max(F.when(F.col("i") == F.ceil(k), F.col("weight"))).alias("high")
        cut = placed.groupBy("root").agg(low, high, F.max(k - F.floor(k)).alias("f")).select("root", F.round(F.col("low") + F.col("f") * (F.col("high") - F.col("low")), 12).alias("cut"))
    else:
        cut = rows.groupBy("root").agg(F.round(F.percentile("weight", float(p.th) / 100), 12).alias("cut"))
    degree = parents.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    heavy = (F.col("weight") > F.col("cut")) & (F.coalesce("children", F.lit(0)) > p.outdegree)
    return rows.join(cut, "root").join(degree, "node", "left").where(~heavy).select("node", "parent", "weight")


def prune(edges: DataFrame, p: Settings, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``node, seen`` and the cut forest ``node, parent, weight``; nodes of ``before`` keep the place they were seen at."""
    edges = cut_lineage(edges)
    seen = first_seen(edges)
    if before is not None:
        seen = cut_lineage(before.select("node", "seen").unionByName(seen.join(before, "node", "left_anti").select("node", "seen")))
    parents = cut_lineage(best_parents(edges))
    return seen, weak_link_cut(parents, forest_roots(seen, parents), seen, p)


def communities(edges: DataFrame, p: Settings) -> DataFrame:
    """``node, thread_id`` of every document that has an edge; a thread is named by its root."""
    seen, forest = prune(edges, p)
    return forest_roots(seen, forest).withColumnRenamed("root", "thread_id")


def compose(graphs: list[DataFrame]) -> DataFrame:
    """Edges ``src, dst`` of all graphs; one that several have takes the last one's attributes."""
    rows = graphs[0].withColumn("_v", F.lit(0))
    for v, g in enumerate(graphs[1:], 1):
        rows = rows.unionByName(g.withColumn("_v", F.lit(v)))
    others = [c for c in graphs[0].columns if c not in ("src", "dst")]
    last = rows.groupBy("src", "dst").agg(F.max_by(F.struct(*others), "_v").alias("a")) if others else rows.select("src", "dst").distinct()
    return last.select("src", "dst", *[F.col(f"a.{c}") for c in others])


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in ``nodes(node)``."""
    ids = nodes.select("node").distinct()
    at = lambda c: ids.withColumnRenamed("node", c)
    return edges.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi").select(*edges.columns)
