"""Embedding near-duplicates by Euclidean p-stable hashing with an exact cosine check.

Vectors are normalised in double precision; a cosine of 0.9 is then a distance of 0.447. Each table has ``k``
random projections, quantised with width WIDTH, whose cells are the bucket. ``k`` and the number of tables follow from the number
of different vectors by a rule: k makes a bucket hold a few unrelated vectors, the tables make a pair at exactly
the threshold be found with probability 1 - MISS (pairs at 0.95 are missed less than once in 1,000).

Equal vectors become one with a multiplicity. Buckets of more than BUCKET vectors are cut into blocks, and a task gets
two blocks. A task compares its vectors by one matrix product, counts a pair only in the first table that holds it
(earlier tables' cells are computed again for linked vectors), and returns sums for each vector and the local
components of what it linked: pairs are never emitted. Components are then settled over all tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links, are their own
component and are kept; vectors of different lengths are never linked; rows with the same id are one vector's copies; a
null id has a null component and is kept; vectors of any length are compared whole; no rows give no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, local_components, read, ship
from .hashing import mix

THRESHOLD = 0.9
WIDTH = 1.2
MISS = 0.03
BUCKET = 2048
SMALL = 48
SEED = 20240607


def collide(c: float, w: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for two vectors at distance c."""
    u = w / c
    return 1 - math.erfc(u / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


def shape(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections of a table, tables) for n different vectors."""
    far, near = collide(math.sqrt(2.0)), collide(math.sqrt(2 - 2 * threshold))
    k = max(6, math.ceil(math.log(max(1, n) / 8) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


@functools.lru_cache(maxsize=8)
def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The random projections of all tables side by side and their offsets, drawn once in a worker."""
    drawn = [np.random.default_rng([SEED, dim, t]) for t in range(tables)]
    made = [(r.standard_normal((dim, k)), r.uniform(0, WIDTH, k)) for r in drawn]
    return np.concatenate([a for a, _ in made], axis=1), np.concatenate([b for _, b in made])


def cells(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket hashes of normalised rows in ``tables`` tables."""
    dim = x.shape[1]
    a, b = projections(dim, k, tables)
    out = np.empty((len(x), tables), np.uint64)
    for s in range(0, len(x), max(1, 2_000_000 // (k * tables))):
        q = np.floor((x[s : s + max(1, 2_000_000 // (k * tables))] @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, k)
        h = mix(np.broadcast_to((np.uint64(dim) << np.uint64(32)) + np.arange(1, tables + 1, dtype=np.uint64), q.shape[:2]))
        for j in range(k):
            h = mix(h + q[:, :, j])
        out[s : s + len(h)] = h
    return out


def unit(raws: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), dtype).reshape(len(raws), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(dtype):
    def run(batches):
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            raws = []
            for v in col:
                raw = None
                if v.is_valid and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(dtype)
                    if np.isfinite(x).all() and x.any():
                        raw = (x + 0.0).astype(dtype).tobytes()
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([ids, pa.array(raws, pa.binary())], names=["id", "x"])

    return run


def _deal(dtype, k, tables, whole):
    """(key, tab, cid, m, x) for each table, or only the keys."""

    def run(batches):
        for batch in batches:
            for off in range(0, batch.num_rows, 256):
                part = batch.slice(off, 256)
                raws = part.column(2).to_pylist()
                sizes = np.array([len(r) for r in raws])
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    keys = cells(unit([raws[i] for i in rows], dtype), k, tables).reshape(-1).view(np.int64)
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])
                        continue
                    take = pa.array(np.repeat(rows, tables))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), *(part.column(c).take(take) for c in (0, 1, 2))],
                        names=["key", "tab", "cid", "m", "x"],
                    )

    return run


def _hits(x: np.ndarray, side: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float):
    """Pairs of rows within groups whose cosine reaches the threshold. Small groups of a size are one stacked product."""
    small = (size <= SMALL) & (i == j)
    for n in np.unique(size[small]).tolist():
        if n < 2:
            continue
        first = start[small & (size == n)]
        above = np.triu(np.ones((n, n), bool), 1)
        for s in range(0, len(first), max(1, 65536 // (n * n))):
            rows = first[s : s + max(1, 65536 // (n * n)), None] + np.arange(n)
            v = x[rows]
            g, a, b = np.nonzero((v @ v.transpose(0, 2, 1) >= threshold) & above)
            yield rows[g, a], rows[g, b]
    for k in np.flatnonzero(~small).tolist():
        rows = np.arange(start[k], start[k] + size[k])
        left = rows[side[rows] == i[k]]
        right = left if i[k] == j[k] else rows[side[rows] == j[k]]
        for s in range(0, len(left), 512):
            a, b = np.nonzero(x[left[s : s + 512]] @ x[right].T >= threshold)
            a, b = left[s : s + 512][a], right[b]
            keep = a < b if i[k] == j[k] else a >= 0
            yield a[keep], b[keep]


def _link(dtype, k, tables, threshold):
    """Sorted rows to (a, n, b): n more linked rows of a, and b, linked with a over pairs of the batch."""

    def solve(c):
        new = np.ones(len(c["key"]), bool)
        new[1:] = (np.diff(c["key"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(new)))
        got = list(_hits(c["x"], c["side"], start, size, c["i"][start], c["j"][start], threshold))
        p, q = np.concatenate([g[0] for g in got] or [start[:0]]), np.concatenate([g[1] for g in got] or [start[:0]])
        if not len(p):
            return None
        used, back = np.unique(np.concatenate([p, q]), return_inverse=True)
        codes = cells(c["x"][used], k, tables)
        first = np.empty(len(p), bool)
        for s in range(0, len(p), 65536):  # counted in the first table that holds the pair
            a, b = back[: len(p)][s : s + 65536], back[len(p) :][s : s + 65536]
            first[s : s + 65536] = (codes[a] == codes[b]).argmax(axis=1) == c["tab"][p[s : s + 65536]]
        ids, who = np.unique(c["cid"][used], return_inverse=True)
        a, b = who[back[: len(p)]], who[back[len(p) :]]
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a[first], c["m"][q[first]])
        np.add.at(n, b[first], c["m"][p[first]])
        return ids, n, ids[local_components(len(ids), (a, b))]

    def run(batches):
        held: dict[int, dict] = {}
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "i", "j", "tab", "cid", "m", "side")}
            raws = batch.column("x").to_pylist()
            sizes = np.fromiter(map(len, raws), np.int64, len(raws))
            for width in np.unique(sizes).tolist():  # vectors of one length; a group holds no other
                rows = np.flatnonzero(sizes == width)
                c = {n: v[rows] for n, v in cols.items()} | {"x": unit([raws[r] for r in rows.tolist()], dtype)}
                if width in held:
                    c = {n: np.concatenate([held[width][n], v]) for n, v in c.items()}
                same = (c["key"] == c["key"][-1]) & (c["i"] == c["i"][-1]) & (c["j"] == c["j"][-1])
                cut = int(np.flatnonzero(same)[0])  # the last group may go on
                held[width] = {n: v[cut:] for n, v in c.items()}
                if cut and (got := solve({n: v[:cut] for n, v in c.items()})):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got], names=["a", "n", "b"])
        for c in held.values():
            if got := solve(c):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got], names=["a", "n", "b"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    ship(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "vectors")
    dtype = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    packed = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).mapInArrow(_pack(dtype), "id long, x binary")
    packed = scratch.save(packed.withColumn("h", F.md5("x")))
    classes = scratch.save(packed.where("x is not null and id is not null").groupBy("h").agg(F.min("id").alias("cid"), F.count("*").alias("m"), F.first("x").alias("x")))
    k, tables = shape(classes.count(), threshold)
    slim = classes.select("cid", "m", "x")
    big = slim.mapInArrow(_deal(dtype, k, tables, False), "key long").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET)
    big = scratch.save(big.select(F.col("key").alias("big"), F.ceil(F.col("size") / BUCKET).cast("int").alias("blocks")))
    rows = slim.mapInArrow(_deal(dtype, k, tables, True), "key long, tab int, cid long, m long, x binary")
    if big.limit(1).count():
        rows = rows.join(big, rows["key"] == big["big"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        rows = rows.withColumn("side", F.lit(0)).withColumn("other", F.lit(0))
    rows = rows.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "tab", "cid", "m", "x", "side")
    linked = scratch.save(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_link(dtype, k, tables, threshold), "a long, n long, b long"))
    comp = components(scratch, linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
    counts = linked.groupBy("a").agg(F.sum("n").alias("n"))
    per = classes.select("h", "cid", "m").join(counts, F.col("cid") == F.col("a"), "left").join(comp, F.col("cid") == F.col("node"), "left")
    per = per.select("h", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "cid").alias("c"))
    out = packed.drop("x").join(per, "h", "left")
    alone = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    n = F.when(F.col("id").isNotNull(), F.col("n"))
    return out.select(F.col("id").alias(id_col), F.coalesce(n, F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(F.col("id") == alone, F.lit(True)).alias("kept"))


def op7_near_vectors(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))
