"""Consolidating pairwise matches into groups by deterministic Boruvka hooking.

``components(edges)`` labels every vertex of an undirected graph with the
smallest vertex it can reach. In each round every component selects its smallest
outgoing edge (the one to its smallest neighbour), the selected edges form trees,
trees collapse to their roots by pointer doubling, and the edges are relabelled
to roots and deduplicated. The rounds end when no edge is left; as every
component with an outgoing edge merges, their number at least halves.

``tied_groups(records)`` builds the graph of records tied by identifiers. Its
vertices are identifier values, not records: rows with the same value are
pre-aggregated to one vertex, and only rows holding two identifiers make an edge.
A value shared by a third of all rows is therefore one vertex and never a star
or clique of rows.

Defined results: null identifiers tie nothing; self loops, repeated and reversed
edges are harmless; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions.identifiers import with_usable_ids
from kinspark.session import materialize, release

#: Rounds of hooking or doubling beyond which something is wrong: each at least halves what is left.
MAX_ROUNDS = 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex in ``edges``; component is the smallest vertex.

    Null ends are dropped with their edge. Vertices are of any one orderable type.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    live = materialize(
        pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    labels = None
    for _ in range(MAX_ROUNDS):
        open_edges = live.filter("hi <> lo")
        if open_edges.isEmpty():
            break
        roots = _hook(open_edges)
        relabelled = (
            open_edges.join(roots.select(F.col("node").alias("hi"), F.col("root").alias("rh")), "hi", "left")
            .join(roots.select(F.col("node").alias("lo"), F.col("root").alias("rl")), "lo", "left")
            .select(F.coalesce("rh", "hi").alias("x"), F.coalesce("rl", "lo").alias("y"))
            .filter("x <> y")
            .select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
            .distinct()
        )
        new_live = materialize(relabelled, "edges")
        if labels is None:
            labels = _first_labels(live, roots)
        else:
            new = labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("vertex", F.coalesce("root", "component").alias("component"))
            new = materialize(new, "labels")
            release(labels)
            release(roots)
            labels = new
        release(live)
        live = new_live
    else:
        raise RuntimeError("components did not converge")
    if labels is None:
        labels = materialize(live.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")), "labels")
    release(live)
    return labels


def _first_labels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(vertex, component) after the first round: every vertex of an open edge has its root, one that has only a loop is its own."""
    labels = roots.select(F.col("node").alias("vertex"), F.col("root").alias("component"))
    labels._kinspark_path = roots._kinspark_path
    loops = edges.filter("hi = lo").select(F.col("hi").alias("vertex"), F.col("hi").alias("component"))
    if loops.isEmpty():
        return labels
    return materialize(labels.unionByName(loops.join(labels, "vertex", "left_anti")), "labels")


def _hook(open_edges: DataFrame) -> DataFrame:
    """(node, root) after hooking every node along its smallest edge and collapsing the trees.

    Each node's smallest outgoing edge leads to its smallest neighbour; both ends
    see a common smallest edge alike, so the only cycles have two nodes, and the
    smaller of the two becomes the root. Roots are then replaced by the smallest
    node of their tree.
    """
    both = open_edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        open_edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    # edges are ordered by (smaller end, larger end), so the smallest edge leads to the smallest neighbour;
    # the order is total: no longer cycles can arise
    hooked = both.groupBy("node").agg(F.min("other").alias("parent"))
    back = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    mutual = F.col("grand") == F.col("node")
    tree = hooked.join(back, "parent").select("node", F.when(mutual & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent"), mutual.alias("done"))
    tree = materialize(tree, "tree")
    for _ in range(MAX_ROUNDS):
        if tree.filter("NOT done").isEmpty():
            break
        # done: the parent is a root, which its own row tells
        up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("grand"), F.col("done").alias("above"))
        step = materialize(tree.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("done") | F.col("above") | (F.col("grand") == F.col("parent"))).alias("done")), "tree")
        release(tree)
        tree = step
    else:
        raise RuntimeError("trees did not collapse")
    smallest = tree.groupBy("parent").agg(F.min("node").alias("root"))
    out = materialize(tree.join(smallest, "parent").select("node", "root"), "roots")
    release(tree)
    return out


def tied_groups(records: DataFrame, id_col: str = "rec_id", lei_col: str = "lei", qid_col: str = "wikidata_qid") -> DataFrame:
    """(id, group_id) of every record in a group of two or more tied by a usable LEI or QID.

    group_id is the smallest id of the group. Records without a usable identifier
    are in no group.
    """
    read = with_usable_ids(records.select(id_col, lei_col, qid_col), lei_col, qid_col)
    read = read.select(F.col(id_col).alias("id"), F.col("usable_lei").alias("lei"), F.col("usable_qid").alias("qid")).filter("lei IS NOT NULL OR qid IS NOT NULL")
    read = materialize(read, "identifiers")
    # one row per distinct pair of identifiers, with the smallest record: partial sums absorb hot values
    cells = materialize(read.groupBy("lei", "qid").agg(F.min("id").alias("first"), F.count("*").alias("n")), "cells")
    # vertices carry a kind, as an LEI and a QID of the same letters are different things
    edges = cells.filter("lei IS NOT NULL AND qid IS NOT NULL").select(
        F.concat(F.lit("L"), "lei").alias("a"), F.concat(F.lit("Q"), "qid").alias("b")
    )
    labels = components(edges)
    key = F.coalesce(F.concat(F.lit("L"), "lei"), F.concat(F.lit("Q"), "qid"))
    keyed = cells.withColumn("vertex", key).join(labels, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    groups = keyed.groupBy("component").agg(F.min("first").alias("group_id"), F.sum("n").alias("size")).filter("size > 1")
    cell_group = materialize(keyed.join(groups, "component").select("lei", "qid", "group_id"), "cellgroups")
    joined = read.join(cell_group, read.lei.eqNullSafe(cell_group.lei) & read.qid.eqNullSafe(cell_group.qid))
    return joined.select(F.col("id").alias(id_col), "group_id")
