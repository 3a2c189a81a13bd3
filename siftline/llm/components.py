"""Connected components of an edge table by alternating large and small stars,
and components of nodes that share keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import BROADCAST_ROWS, broadcast_if_small, drop_scratch, releasing, scratch_table

#: Nodes of a key with up to so many are compared pair by pair at once.
PAIR_OUT = 8
#: Crowded keys are paired out in the end when that makes at most so many pairs for each of their rows.
PAIRS_A_ROW = 8


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i-j: the least member of each component."""
    while True:
        least = np.minimum(label[i], label[j])
        differ = (label[i] != least) | (label[j] != least)
        if not differ.any():
            return label
        i, j, least = i[differ], j[differ], least[differ]
        for k in (label[i], label[j]):  # roots alone: a member must not leave its root before that is united
            np.minimum.at(label, k, least)
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = unite(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def connected_components(edges: DataFrame, at_once: int = BROADCAST_ROWS) -> DataFrame:
    """``(node, component)`` for every node of an edge table ``(a, b)`` of
    longs; a component is named by its smallest node.

    Edges no more than a broadcast may have are united in one task. Beyond that:

    A round joins every node's least neighbour to the node's edges and so hooks
    neighbours together; rounds grow with the logarithm of the number of nodes.
    Least neighbours come from partial aggregation. They are a table of their
    own, broadcast when small, so that a hub's edges are split and not gathered.
    """
    stars = scratch_table(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    mark = _mark(stars)
    if mark[0] <= at_once:
        return stars.coalesce(1).mapInArrow(releasing(_in_one_task), "node long, component long")
    while mark[0]:
        both = stars.unionByName(stars.selectExpr("b a", "a b"))
        large = _hook(both, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "b > a", with_self=False)
        small = _hook(large, large.groupBy("a").agg(F.min("b").alias("m")), "true", with_self=True)
        drop_scratch(stars)
        drop_scratch(large)
        stars, was = small, mark
        mark = _mark(stars)
        if mark == was:
            break
    return stars.selectExpr("a node", "b component").unionByName(stars.selectExpr("b node", "b component").distinct())


def _hook(edges: DataFrame, least: DataFrame, which: str, with_self: bool) -> DataFrame:
    """Hang the neighbours ``b`` of each ``a`` below the least of them."""
    least = scratch_table(least, "least")
    table = broadcast_if_small(least)
    out = edges.filter(which).join(table, "a").selectExpr("b a", "m b").filter("a <> b")
    if with_self:
        out = out.unionByName(least.selectExpr("a", "m b"))
    out = scratch_table(out.selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    drop_scratch(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum that changes when they do."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def link_by_keys(
    keyed: DataFrame, confirm: Callable[[DataFrame], DataFrame], links: DataFrame | None = None, fits: Callable[[Column, Column], Column] | None = None,
    batch_rows: int | None = None, more: DataFrame | None = None, closer: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``(node, component)`` of the nodes that confirmed links connect.

    ``keyed``: key, node and a struct ``at``, read the same each time. Nodes
    that share a key are candidates if ``fits`` holds for their structs;
    ``confirm`` takes candidate pairs ``(a, b)``, a < b, and returns those that
    are links, ``batch_rows`` at a time; ``links`` are confirmed already.

    Keys with few nodes are paired out at once. A crowded key is not: its nodes
    are first compared with one of them, another one each round, and nodes
    that links connect are not compared again. When few pairs are left apart,
    or a round links hardly anything more, what is left is compared pair by
    pair, so that no link between components is missed. What crowded keys
    have left then is met with ``more``, ``(node, more)``, and pairs become rows
    only if ``closer`` holds for these too.
    """
    links = keyed.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if links is None else links
    groups, turn, last = scratch_table(connected_components(links), "link-groups"), 0, False
    saved = _merged(groups)
    while True:
        named = broadcast_if_small(groups).select("node", F.col("component").alias("comp"))
        open_ = keyed.join(named, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # Keys whose nodes are not connected yet, with a hub from the largest part.
        hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "at")).alias("hub")
        parts = open_.groupBy("key", "comp").agg(F.count("*").alias("c"), hub)
        mixed = parts.groupBy("key").agg(
            F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("k"), F.max_by("hub", F.struct("c", "hub")).alias("hub")
        )
        mixed = scratch_table(mixed.filter("k > 1"), "link-keys")
        crowded = mixed.filter(F.col("n") > PAIR_OUT)
        n, crossing = crowded.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        last = last or not n or crossing <= PAIRS_A_ROW * n
        open_ = scratch_table(open_.join(broadcast_if_small(mixed).select("key", "n", "hub"), "key"), "link-open")
        left = open_.select("key", "n", F.col("node").alias("x"), F.col("at").alias("p"), F.col("comp").alias("cx"), "hub")
        right = open_.select("key", F.col("node").alias("y"), F.col("at").alias("q"), F.col("comp").alias("cy"))
        apart = lambda x, y: x.join(y, "key").filter("x < y AND cx <> cy")
        whole = last and more is None
        met = apart(left if whole else left.filter(F.col("n") <= PAIR_OUT), right).select("x", "p", "y", "q")
        if not last:
            star = left.filter(F.col("n") > PAIR_OUT).select("x", "p", F.col("hub.node").alias("y"), F.col("hub.at").alias("q"))
            met = met.unionByName(star.filter("x <> y"))
        elif not whole:
            known = _known(open_.filter(F.col("n") > PAIR_OUT), more)
            side = lambda node: broadcast_if_small(known).select(F.col("node").alias(node), F.col("more").alias(f"{node}_more"))
            x, y = left.filter(F.col("n") > PAIR_OUT).join(side("x"), "x"), right.join(side("y"), "y")
            met = met.unionByName(apart(x, y).filter(closer(F.col("x_more"), F.col("y_more"))).select("x", "p", "y", "q"))
        met = met.filter(fits(F.col("p"), F.col("q"))) if fits else met
        pairs = scratch_table(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "link-pairs")
        links = links.unionByName(scratch_table(confirm(pairs), "links", batch_rows))
        groups = scratch_table(connected_components(links), "link-groups")
        drop_scratch(mixed, pairs)
        if last:
            drop_scratch(open_, *() if whole else (known,))
            return groups
        # What was paired out is done.
        keyed = open_.filter(F.col("n") > PAIR_OUT).select("key", "node", "at")
        was, saved = saved, _merged(groups)
        last, turn = saved - was <= saved // 100, turn + 1


def _known(rows: DataFrame, more: DataFrame) -> DataFrame:
    """What ``more`` knows of the nodes of ``rows``, written."""
    wanted = scratch_table(rows.select("node").distinct(), "link-wanted")
    known = scratch_table(more.join(broadcast_if_small(wanted), "node", "left_semi"), "link-known")
    drop_scratch(wanted)
    return known


def _merged(groups: DataFrame) -> int:
    """Nodes that are no longer apart: all but one of each component."""
    return groups.filter("node <> component").count()
