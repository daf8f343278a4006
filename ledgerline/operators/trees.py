"""Decision trees and layers as tables: prediction by joins, arrays and aggregates, without Python workers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_NODES = 2_000_000  # that are broadcast, of about 60 bytes
TREE_BITS = 32
FEATURE_BITS = 16


def node_table(nodes: DataFrame, *values: str) -> DataFrame:
    """``nodes`` (tree, node, feature, threshold, left, right and ``values``) by place: one number for tree and node.

    The root is node 0; a leaf points to itself on both sides.
    """

    def place(node: str) -> Column:
        return F.shiftleft(F.col("tree").cast("long"), TREE_BITS) + F.col(node)

    return nodes.select(
        place("node").alias("place"), F.greatest(F.col("feature"), F.lit(0)).alias("feature"), "threshold",
        place("left").alias("left"), place("right").alias("right"), *values,
    )


def tree_arrays(nodes: DataFrame, trees: int) -> DataFrame:
    """The ``trees`` of a node table, a row each, with arrays by node: ``_steps``, ``_limits`` and the table's values.

    Nodes are numbered anew, level by level and with the children of a node side by side, so that a step can hold both the
    left child, in its upper bits, and the feature. A leaf's limit is NaN, which nothing exceeds, and its step leads to itself.
    """
    values = [f for f in nodes.schema if f.name not in ("place", "feature", "threshold", "left", "right")]
    found = nodes.orderBy("place").toArrow()
    place, feature, limit = (found[name].to_numpy() for name in ("place", "feature", "threshold"))
    if len(feature) and int(feature.max()) >> FEATURE_BITS:
        raise ValueError(f"feature {feature.max()} is beyond {FEATURE_BITS} bits")
    left, right = (np.searchsorted(place, found[name].to_numpy()) for name in ("left", "right"))
    order, ends, number = [], [0], np.zeros(len(place), dtype=np.int64)
    for root in np.flatnonzero(place & ((1 << TREE_BITS) - 1) == 0):
        level, levels = np.array([root]), []
        while len(level):
            levels.append(level)
            inner = level[left[level] != level]
            level = np.column_stack([left[inner], right[inner]]).ravel()
        order.append(np.concatenate(levels))
        number[order[-1]] = np.arange(len(order[-1]))
        ends.append(ends[-1] + len(order[-1]))
    if len(order) != trees:
        raise ValueError(f"{len(order)} trees have a root, not {trees}")
    order = np.concatenate([np.empty(0, dtype=np.int64), *order])
    leaf = left[order] == order
    step = number[left[order]] << FEATURE_BITS | np.where(leaf, 0, feature[order])
    ordered = [pa.array(step), pa.array(np.where(leaf, np.nan, limit[order])), *(found[f.name].combine_chunks().take(pa.array(order)) for f in values)]
    names = ["_steps", "_limits", *(f.name for f in values)]
    ends = pa.array(ends, pa.int32())
    table = pa.table([pa.ListArray.from_arrays(ends, c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in ordered], names=names)
    kinds = [T.LongType(), T.DoubleType(), *(f.dataType for f in values)]
    schema = T.StructType([T.StructField(name, T.ArrayType(kind, False), False) for name, kind in zip(names, kinds)])
    return nodes.sparkSession.createDataFrame(table, schema)


def leaves(rows: DataFrame, nodes: DataFrame, trees: int, depth: int, x: str = "x") -> DataFrame:
    """``rows`` without ``x`` once for each of the ``trees``, with the values of the leaf that they come to.

    A row goes left when its feature, an entry of the array ``x``, is at most the threshold. Each row is joined with all
    trees, a row each, and looks its way up in their arrays; trees are small whatever the number of rows, which stay in their
    tasks. A NULL entry goes left.
    """
    n_nodes = nodes.count()
    if n_nodes > MOST_NODES:
        raise ValueError(f"{n_nodes} nodes are too many to send to every task, {MOST_NODES} are allowed")
    arrays = tree_arrays(nodes, trees)
    kept = [c for c in rows.columns if c != x]
    values = [c for c in arrays.columns if c not in ("_steps", "_limits")]
    held = [*kept, x, *arrays.columns]
    at = rows.crossJoin(F.broadcast(arrays)).withColumn("_at", F.lit(0).cast("long"))
    for _ in range(depth):
        at = at.select(*held, "_at", F.get("_steps", "_at").alias("_step"))
        exceeds = F.get(x, F.col("_step").bitwiseAND((1 << FEATURE_BITS) - 1)) > F.get("_limits", "_at")
        child = F.when(exceeds, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        at = at.select(*held, (F.shiftright("_step", FEATURE_BITS) + child).alias("_at"))
    return at.select(*kept, *(F.get(c, "_at").alias(c) for c in values))


def layer_scores(rows: DataFrame, layers: list[tuple[list[list[float]], list[float]]], key: str, x: str = "x") -> DataFrame:
    """(``key``, scores): inputs of the last layer's outputs, with a sigmoid after each earlier layer, for the array ``x``.

    ``layers`` holds the weights of each output by input, and the biases. A hidden layer is a table of its units, which each
    row is joined with: a unit's output is computed once, and its weights times it are summed by ``key``, which is unique and
    not NULL. Sums are written out, as functions over arrays are not compiled.
    """

    def unit_sum(weight: Callable[[int], Column]) -> Column:
        return reduce(add, (F.get(x, F.lit(k)) * weight(k) for k in range(len(layers[0][0][0]))), F.lit(0.0))

    at = rows.select(key, x)
    if len(layers) == 1:
        weights, bias = layers[0]
        return at.select(key, F.array(*(F.lit(b) + unit_sum(lambda k, w=w: F.lit(w[k])) for w, b in zip(weights, bias))).alias("scores"))
    for depth, ((weights, bias), (after, after_bias)) in enumerate(zip(layers, layers[1:])):
        units = [(k, w, b, list(v)) for k, (w, b, v) in enumerate(zip(weights, bias, zip(*after)))]
        units = F.broadcast(rows.sparkSession.createDataFrame(units, "_unit int, _w array<double>, _b double, _v array<double>"))
        z = F.get(x, "_unit") if depth else F.col("_b") + unit_sum(lambda k: F.get("_w", F.lit(k)))
        outputs = at.crossJoin(units).select(key, (1 / (1 + F.exp(-z))).alias("_h"), "_v")
        sums = [F.lit(b) + F.sum(F.col("_h") * F.get("_v", F.lit(k))) for k, b in enumerate(after_bias)]
        at = outputs.groupBy(key).agg(F.array(*sums).alias(x))
    return at.select(key, F.col(x).alias("scores"))


def first_highest(scores: Column) -> Column:
    """Place of the highest entry, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1
