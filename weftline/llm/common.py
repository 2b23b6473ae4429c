"""Shared pieces: scratch tables in the cluster's shared folder, text columns, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir, ship  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_made: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this process's operators left in the shared folder. Their results must be written by then."""
    while _made:
        _delete(spark, _made.pop())


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    ``drop`` deletes tables that later steps no longer read; what a returned DataFrame reads stays until ``clean``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0, {}
        _made.append(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        _, path = self.paths.pop(id(df))
        _delete(self.spark, path)


#: Links of a task that are cut to a spanning forest; links of one node that are joined apart from the others.
TASK_LINKS, HUB = 1_000_000, 200_000


def _forest(batches):
    """Of all links (u, v) of a task, u with the smallest node that u reaches through them: a link a node at most.

    Links are gathered in blocks and replaced by the forest so far, so memory follows the nodes; a forest that outgrows
    TASK_LINKS is given out and a new one begun.
    """
    held, n = [], 0

    def reduce():
        used, back = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        back = back.reshape(2, -1)
        root = local_components(len(used), (back[0], back[1]))
        own = root != np.arange(len(used))
        return np.stack([used[own], used[root[own]]])

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += batch.num_rows
        if n >= TASK_LINKS:
            tree = reduce()
            if tree.shape[1] > TASK_LINKS // 2:
                yield out(tree)
                tree = tree[:, :0]
            held, n = [tree], tree.shape[1]
    if n:
        yield out(reduce())


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable. Nulls link nothing.

    First every task cuts its links to a spanning forest, so several links of a node become one. Links that fit one task
    are settled by that. Others alternate large-star and small-star steps, each a min aggregation (combined before the
    shuffle) and an equi-join, until no edge changes. Neighbour lists are never collected. A node with more than HUB links
    costs its lesser neighbours no shuffle: such nodes are at most 1 in HUB of the links and are broadcast.
    """
    e = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")))
    tasks = -(-e.count() // TASK_LINKS)
    forest = scratch.save(e.coalesce(max(1, tasks)).mapInArrow(_forest, "u long, v long"))
    scratch.drop(e)
    e, last = forest, None
    for _ in range(max_rounds if tasks > 1 else 0):
        # large star: each node's greater neighbours go to the least of its neighbours and itself
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        hubs = e.groupBy("v").count().where(F.col("count") > HUB).select(F.col("v").alias("x"))
        moved = scratch.save(least.join(F.broadcast(hubs), "x"))
        hot = e.join(F.broadcast(hubs), F.col("v") == F.col("x"), "left_semi").join(F.broadcast(moved), F.col("v") == F.col("x"), "left")
        cold = e.join(F.broadcast(hubs), F.col("v") == F.col("x"), "left_anti").join(least, F.col("v") == F.col("x"), "left")
        large = hot.unionByName(cold).select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: each node's lesser neighbours and itself go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.save(small)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        scratch.drop(moved)
        e = new
        if mark == last:
            break
        last = mark
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())


def local_components(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over ``pairs``, within a task."""
    root = np.arange(n)
    a, b = pairs
    while len(a):
        lo = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], lo)
        np.minimum.at(root, root[b], lo)
        while (root[root] != root).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root
