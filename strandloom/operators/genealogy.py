"""Counts below nodes of changing trees, kept up along the sequence by edges that come and go."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 20


class Forest:
    """Parents of nodes, and how many of each set of samples are below each node or at it.

    A node's counts are the fields of one integer, each wide enough for all of
    its set, so that one addition changes them all.
    """

    def __init__(self, nodes: int, weights: np.ndarray):
        widths = [int(x).bit_length() for x in weights.sum(axis=0)]
        self.shifts = [sum(widths[:i]) for i in range(len(widths))]
        self.parent, self.below = [-1] * nodes, [0] * nodes
        for node, column in zip(*(x.tolist() for x in np.nonzero(weights)), strict=True):
            self.below[node] += int(weights[node, column]) << self.shifts[column]

    def insert(self, parent: int, child: int) -> None:
        self.move([parent], [child], [True])

    def remove(self, parent: int, child: int) -> None:
        self.move([parent], [child], [False])

    def move(self, parents: Sequence[int], children: Sequence[int], coming: Sequence[bool]) -> None:
        """Edges that come or go, one after another."""
        below, parent_of = self.below, self.parent
        for parent, child, comes in zip(parents, children, coming, strict=True):
            if comes:
                parent_of[child], change = parent, below[child]
            elif parent_of[child] != parent:
                raise ValueError("an edge ends that is not there: a child has two parents at one place")
            else:
                parent_of[child], change = -1, -below[child]
            if change:
                while parent >= 0:
                    below[parent] += change
                    parent = parent_of[parent]

    def alleles(self, mutations: Sequence[tuple[int, str]], ancestral: str) -> dict[str, int]:
        """How many of each set, in fields, have each state that a site's mutations (node, state) made, the later on a node winning.

        A mutation counts for the samples below it but for those below the next
        mutations beneath, whose own it is then to count.
        """
        own = dict(mutations)
        if len(own) == 1:
            ((node, state),) = own.items()
            return {} if state == ancestral else {state: self.below[node]}
        out: dict[str, int] = {}

        def count(state: str, change: int) -> None:
            if state != ancestral:
                out[state] = out.get(state, 0) + change

        for node, state in own.items():
            count(state, self.below[node])
            above = self.parent[node]
            while above >= 0 and above not in own:
                above = self.parent[above]
            if above >= 0:
                count(own[above], -self.below[node])
        return out


def sweep(edges: pa.Table, mutations: pa.Table, pairs: Sequence[tuple[int, int]]) -> list[tuple[float, list[int], list[int]]]:
    """(pos, counts of the derived alleles, numbers of the pairs that differ) for each site of a span."""
    left, right, parent, child = (edges.column(x).to_numpy() for x in ("left", "right", "parent", "child"))
    samples = sorted({x for p in pairs for x in p})
    pos, node = mutations.column("pos").to_numpy(), mutations.column("node").to_numpy()
    names = np.unique(np.concatenate([parent, child, node, np.array(samples, np.int64)]))
    place = lambda values: np.searchsorted(names, values)
    weights = np.zeros((len(names), 1 + len(pairs)), np.int64)
    weights[place(samples), 0] = 1
    for i, (a, b) in enumerate(pairs):
        for x in (a, b):
            weights[place(x), 1 + i] += 1
    forest, at = Forest(len(names), weights), place(node)
    bits = [1 << x for x in forest.shifts[1:]]  # a pair's field has two bits, for it has two samples
    whole, ones = (1 << forest.shifts[1]) - 1, sum(bits)
    # edges in the order of the sequence, those that end at a place before those that begin there
    moved, comes = np.concatenate([right, left]), np.repeat([False, True], len(left))
    line = np.lexsort((comes, moved))
    up, down, coming = (x[line].tolist() for x in (np.tile(place(parent), 2), np.tile(place(child), 2), comes))
    order = np.lexsort((mutations.column("id").to_numpy(), pos))
    sites, first = np.unique(pos[order], return_index=True)
    made = list(zip(at[order].tolist(), mutations.column("state").take(pa.array(order)).to_pylist(), strict=True))
    ends, olds = [*first[1:].tolist(), len(order)], mutations.column("ancestral").take(pa.array(order)).to_pylist()
    out, m, i = [], 0, 0
    for here, end, upto in zip(sites.tolist(), ends, np.searchsorted(moved[line], sites, side="right").tolist(), strict=True):
        if i < upto:
            forest.move(up[i:upto], down[i:upto], coming[i:upto])
        mine, old, m, i = made[m:end], olds[end - 1], end, upto
        found, differ = list(forest.alleles(mine, old).values()), 0
        for counts in found:
            differ |= counts & ~(counts >> 1) & ones  # one of the two has the allele and the other has not
        out.append((here, [c & whole for c in found if c & whole], [n for n, bit in enumerate(bits) if differ & bit] if differ else []))
    return out


def in_spans(edges: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """Edges cut at the spans' bounds: those of a span with its left end are its first tree."""
    first, last = F.floor(F.col("left") / span), F.ceil(F.col("right") / span) - 1
    cut = edges.filter("left < right").withColumn("span", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    low, high = (F.col("span") * span).cast("double"), ((F.col("span") + 1) * span).cast("double")
    return cut.select(key, "span", F.greatest("left", low).alias("left"), F.least("right", high).alias("right"), "parent", "child")


def site_counts(edges: DataFrame, mutations: DataFrame, pairs: Sequence[tuple[int, int]], key: str, span: int = SPAN) -> DataFrame:
    """(key, pos, counts, pairs) of each site: its derived alleles' counts among the pairs' nodes, and the pairs that differ, by number.

    edges is (key, left, right, parent, child) and mutations (key, pos, id, node,
    state, ancestral). A task takes a span of `span` positions of one sequence:
    the edges in it, cut at its ends, and its mutations. It goes along it once,
    changes the counts above an edge as the edge comes or goes, and reads them
    off at mutations; no site is held against all nodes.
    """
    if not pairs:
        raise ValueError("pairs must not be empty")
    kind = edges.schema[key].dataType.simpleString()
    own = mutations.select(F.col(key).alias("_key"), F.floor(F.col("pos") / span).alias("_span"), F.col("pos").cast("double").alias("pos"), "id", F.col("node").cast("long").alias("node"), "state", "ancestral")
    there = in_spans(edges.select(key, F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"), F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child")), key, span)

    def count(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = sweep(left, right, pairs) if right.num_rows else []
        pos, counts, differ = zip(*found, strict=True) if found else ([], [], [])
        return pa.table({key: pa.array([keys[0].as_py()] * len(found), right.schema.field("_key").type), "pos": pa.array(pos, pa.float64()), "counts": pa.array(counts, pa.list_(pa.int64())), "pairs": pa.array(differ, pa.list_(pa.int64()))})

    schema = f"{key} {kind}, pos double, counts array<long>, pairs array<long>"
    # as many tasks as are asked for: by their bytes, which say little of a span's work, they would be joined to fewer
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there, own = there.repartition(parts, key, "span"), own.repartition(parts, "_key", "_span")
    return there.groupBy(key, "span").cogroup(own.groupBy("_key", "_span")).applyInArrow(count, schema)


def spectrum(counts: DataFrame, nodes: int, key: str) -> DataFrame:
    """(key, k, n_sites) for 0 < k < nodes; every derived allele of a site counts."""
    k = counts.select(key, F.explode("counts").alias("k")).filter((F.col("k") > 0) & (F.col("k") < nodes))
    return k.groupBy(key, "k").agg(F.count(F.lit(1)).alias("n_sites"))


def pair_differences(counts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, pair, win, n_het): the sites at which a pair's nodes differ, for windows that have any."""
    rows = counts.select(key, F.floor(F.col("pos") / size).cast("long").alias("win"), F.explode("pairs").alias("pair"))
    return rows.groupBy(key, "pair", "win").agg(F.count(F.lit(1)).alias("n_het"))
