"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Edges, of 16 bytes, up to which the driver finds the components; beyond it the stars do.
DRIVER_EDGES = 500_000


def _least(edges: DataFrame) -> DataFrame:
    """(u, m) of *edges* (u, v): the least of u and its neighbours, summed up before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id of the component of each) of edges in arrays."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], least)
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in *edges* (a, b): label is the smallest id of its component.

    Each round joins every node's neighbours to the smallest of them, first
    the larger ones (large star), then the smaller ones and the node itself
    (small star); the rounds grow with the logarithm of the longest path. A
    hub's neighbours are never gathered: the least of them is aggregated, and
    joined to the edges, which adaptive execution splits where one node has
    many. Each round is written to the shared folder, and the stars end when no
    edge changed. Up to DRIVER_EDGES edges the driver does the same in arrays.
    Loops, nulls and repeated edges don't matter; an empty table gives none.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    got = edges.limit(DRIVER_EDGES + 1).toArrow()
    if got.num_rows <= DRIVER_EDGES:
        ids, label = labels(got.column("u").to_numpy(), got.column("v").to_numpy())
        kind = got.schema.field("u").type
        found = pa.table({"id": pa.array(ids.tolist(), kind), "label": pa.array(label.tolist(), kind)})
        return edges.sparkSession.createDataFrame(found, schema=edges.select(F.col("u").alias("id"), F.col("v").alias("label")).schema)
    now = written(edges.distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, written(small, "stars")
        discard(before)
        discard(large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    labelled = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label")
    return written(labelled.unionByName(labelled.select(F.col("label").alias("id"), "label").distinct()), "labels")
