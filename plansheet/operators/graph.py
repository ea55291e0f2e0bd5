"""Connected components inside each drawing; no step holds a large component in one task.

A drawing with SMALL edges at most is labelled in one array kernel, so a table of many small drawings costs one pass.
Larger ones go through alternating large and small stars, whose rounds are tables in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansheet.operators.tables import stored

SMALL = 4096


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v) and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _kernel(edges: pa.Table) -> pa.Table:
    node, root = labels(edges.column("u").to_numpy(), edges.column("v").to_numpy())
    moved = node != root
    key = edges.column_names[0]
    return pa.table([edges.column(key).take(pa.array(np.zeros(int(moved.sum()), np.int64))), pa.array(node[moved]), pa.array(root[moved])], names=[key, "node", "root"])


def components(edges: DataFrame, key: str = "drawing_id", small: int = SMALL) -> DataFrame:
    """(key, node, root) for each node with an edge (key, u, v) other than roots; the root is the component's smallest node."""
    edges = stored(edges.where("u <> v").select(key, F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")).distinct(), "edges")
    large = stored(edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select(key), "large-drawings")
    schema = f"{key} {edges.schema[key].dataType.simpleString()}, node bigint, root bigint"
    if large.isEmpty():
        return edges.groupBy(key).applyInArrow(_kernel, schema)
    few = edges.join(large, key, "left_anti").groupBy(key).applyInArrow(_kernel, schema)
    return few.unionByName(stars(edges.join(large, key, "left_semi"), key))


def stars(edges: DataFrame, key: str = "drawing_id") -> DataFrame:
    """components() of edges with v < u by alternating large and small stars."""
    edges, last = stored(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(key, "u").agg(F.min("v").alias("m")).select(key, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(key, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.unionByName(low.select(key, "u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.expr(f"bit_xor(xxhash64({key}, u, v))").alias("x")).first()
        if now == last:
            return edges.select(key, F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
