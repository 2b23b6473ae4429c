"""MinHash near-duplicates by a multi-index Hamming join.

A text's set is its distinct five-word shingles. A signature holds SYMBOLS minima, each kept as 16 bits; the distance of
two signatures is the number of places that differ. Places are split into chunks of CHUNK; a key is a chunk with one
place left out, so all signatures whose chunks differ in at most one place meet under a key (the allowed chunk error
is enumerated). By the pigeonhole, any two signatures that differ in fewer than 2 * CHUNKS places, which is the threshold
in use, meet under a key. Sets of similarity 0.75 differ in a quarter of the places, 30 of 120; a pair of exactly that
similarity has a distance beyond the threshold with a chance below one in 10^4, and less the more alike it is.

1. Equal sets become one representative, the smallest id (aggregation by a 128-bit fingerprint of the set).
2. Each key gets two heads, its first and last members by id; members meet heads, never each other, so a hot key costs
   two rows a member.
3. Pairs within the signature distance are confirmed on the full sets, read again from the texts of candidates only.
4. Confirmed links give components. A key whose members lie in several components may hide a link that its heads do
   not show. The texts under such keys fall into clusters (linked by sharing one); a cluster is cut into blocks, and a task
   compares two blocks: members of different components within the signature distance are confirmed on their full sets
   there, and the links of a spanning forest come out. Then components are settled again. A link inside a component
   changes nothing and is not looked for.

Defined results: a null text, or one without words, has the empty set, links with nothing and is kept; texts of fewer
than five words have their whole sequence as one shingle; rows with the same id are one document; a null id links with
nothing, its component is null and it is kept; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, local_components, read, ship
from .hashing import mix, runs, words

SHINGLE = 5
PERCENT = 75
CHUNK, CHUNKS = 5, 24
SYMBOLS = CHUNK * CHUNKS
#: Signature distance up to which a pair is confirmed on the full sets: all that the keys guarantee. At similarity 0.75,
#: 30 places are expected to differ, with a deviation of 4.7.
DISTANCE = 2 * CHUNKS - 1
#: Candidates' ids are broadcast (8 bytes each) up to this count; beyond it texts meet them by a shuffle.
BROADCAST_IDS = 2_000_000
_ODD = mix(np.arange(1, SYMBOLS + 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
#: Shingles of a block of texts that are compared within a task.
BLOCK = 200_000


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for lo, hi in runs(texts):
        h, n = words(texts[lo:hi])
        stop = np.cumsum(n)
        joined = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            joined += h[j : len(h) - SHINGLE + 1 + j] * _ODD[SYMBOLS + j]
        joined = mix(joined)
        for a, k in zip((stop - n).tolist(), n.tolist(), strict=True):
            if k >= SHINGLE:
                out.append(np.unique(joined[a : a + k - SHINGLE + 1]))
            elif k:
                whole = (h[a : a + k] * _ODD[SYMBOLS + 8 : SYMBOLS + 8 + k]).sum(keepdims=True)
                out.append(mix(whole + np.uint64(k)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of the set, 16 bits of each."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(least, (s[i : i + 4096][None, :] * _ODD[:SYMBOLS, None]).min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _sign(batches):
    for batch in batches:
        for off in range(0, batch.num_rows, 512):
            part = batch.slice(off, 512)
            sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
            n = [len(s) for s in sets]
            spread = [mix(s) for s in sets]
            fa = np.array([np.add.reduce(s) for s in spread], np.uint64).view(np.int64)
            fb = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(7))) for s in spread], np.uint64).view(np.int64)
            sig = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(fa), pa.array(fb), pa.array(sig, pa.binary())], names=["id", "n", "fa", "fb", "sig"])


def _keys(batches):
    place = np.arange(SYMBOLS, dtype=np.uint64)
    for batch in batches:
        for off in range(0, batch.num_rows, 2048):
            part = batch.slice(off, 2048)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            t = mix(sig.astype(np.uint64) + (place << np.uint64(16)) + np.uint64(1)).reshape(-1, CHUNKS, CHUNK)
            keys = mix(t.sum(axis=2, keepdims=True) - t + place.reshape(CHUNKS, CHUNK)).reshape(-1)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids, pa.int64())], names=["key", "rep"])


def _block_links(batches):
    """Rows (k, i, j, side, rep, c, sig, s), sorted by (k, i, j), to links between different components of two blocks.
    Of all links found between the blocks, those of a spanning forest are given out."""

    def group(i, j, rows):
        left = [r for r in rows if r[0] == i]
        right = left if i == j else [r for r in rows if r[0] == j]
        if not left or not right:
            return None
        ids = np.array([r[1] for r in right], np.int64)
        comp = np.array([r[2] for r in right], np.int64)
        sig = np.frombuffer(b"".join(r[3] for r in right), np.uint16).reshape(-1, SYMBOLS)
        sets = [np.frombuffer(r[4], np.uint64) for r in right]
        size = np.array([len(x) for x in sets])
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(size) - size
        p, q = [], []
        for rep, c, g, raw in ((r[1], r[2], r[3], r[4]) for r in left):
            x = np.frombuffer(raw, np.uint64)
            ok = (comp != c) & (np.minimum(size, len(x)) * 100 >= PERCENT * np.maximum(size, len(x)))
            if i == j:
                ok &= ids > rep
            ok[ok] = (sig[ok] != np.frombuffer(g, np.uint16)).sum(axis=1) <= DISTANCE
            if not ok.any():
                continue
            at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
            mark = np.zeros(len(vocabulary), np.int64)
            mark[at[vocabulary[at] == x]] = 1
            common = np.add.reduceat(mark[flat], begin)
            hit = ids[ok & (100 * common >= PERCENT * (size + len(x) - common))]
            p.append(np.full(len(hit), rep))
            q.append(hit)
        if not p or not sum(map(len, p)):
            return None
        p, q = np.concatenate(p), np.concatenate(q)
        used, back = np.unique(np.concatenate([p, q]), return_inverse=True)
        root = local_components(len(used), (back[: len(p)], back[len(p) :]))
        return used, used[root]

    held, now = [], None
    for batch in batches:
        for k, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k, i, j) != now:
                if held and (got := group(now[1], now[2], held)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["u", "v"])
                held, now = [], (k, i, j)
            held.append(row)
    if held and (got := group(now[1], now[2], held)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["u", "v"])


def _raw_sets(batches):
    for batch in batches:
        for off in range(0, batch.num_rows, 256):
            part = batch.slice(off, 256)
            sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "s"])


def _sets(batches):
    for batch in batches:
        for off in range(0, batch.num_rows, 256):
            part = batch.slice(off, 256)
            sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
            n = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(n), values)], names=["id", "s"])


def _confirm(scratch: Scratch, docs: DataFrame, pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    far = F.expr("size(filter(sequence(0, %d), i -> substring(sa, 2 * i + 1, 2) <> substring(sb, 2 * i + 1, 2)))" % (SYMBOLS - 1))
    near = pairs.join(signs.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(signs.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    near = near.where((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (far <= DISTANCE)).select("a", "b")
    near = scratch.save(near)
    ids = scratch.save(near.select(F.col("a").alias("i")).unionByName(near.select(F.col("b").alias("i"))).distinct())
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = docs.join(side, docs["id"] == F.col("i"), "left_semi").select("id", "text").mapInArrow(_sets, "id long, s array<bigint>").dropDuplicates(["id"])
    sets = scratch.save(sets)
    both = near.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = scratch.save(both.where(100 * common >= PERCENT * (F.size("x") + F.size("y") - common)).select(F.col("a").alias("u"), F.col("b").alias("v")))
    for df in (near, ids, sets):
        scratch.drop(df)
    return out


def _across(scratch: Scratch, docs: DataFrame, members: DataFrame, comp: DataFrame, signs: DataFrame) -> DataFrame:
    """Links (u, v) between members of a key that lie in different components so far."""
    placed = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("rep").alias("head")).where("lo < hi").select("key", "head")
    open_ = scratch.save(placed.join(split, "key").select("rep", "c", "head").distinct())
    cluster = components(scratch, open_.select(F.col("rep").alias("u"), F.col("head").alias("v")))
    rest = open_.select("rep", "c").distinct().join(cluster.select(F.col("node").alias("rep"), F.col("component").alias("k")), "rep").join(signs.withColumnRenamed("id", "rep"), "rep")
    rest = scratch.save(rest)
    blocks = rest.groupBy("k").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    rest = rest.join(blocks, "k").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    ids = rest.select(F.col("rep").alias("i")).distinct()
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = docs.join(side, docs["id"] == F.col("i"), "left_semi").select("id", "text").mapInArrow(_raw_sets, "id long, s binary").dropDuplicates(["id"]).withColumnRenamed("id", "rep")
    rows = rest.join(sets, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("k", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "c", "sig", "s")
    return scratch.save(rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(_block_links, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.save(docs.mapInArrow(_sign, "id long, n long, fa long, fb long, sig binary"))
    real = signed.where("n > 0 and id is not null")
    classes = scratch.save(real.groupBy("fa", "fb", "n").agg(F.min("id").alias("rep")))
    signs = real.join(classes.select(F.col("rep").alias("id"), "fa", "fb", "n"), ["fa", "fb", "n", "id"], "left_semi").dropDuplicates(["id"]).select("id", "n", "sig")
    signs = scratch.save(signs)

    keys = signs.select("id", "sig").mapInArrow(_keys, "key long, rep long")
    heads = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    members = scratch.save(keys.join(heads, "key"))
    pairs = members.select("rep", F.explode(F.array("lo", "hi")).alias("head")).where("rep <> head").select(F.greatest("rep", "head").alias("a"), F.least("rep", "head").alias("b")).distinct()
    links = _confirm(scratch, docs, pairs, signs)
    comp = components(scratch, links)

    more = _across(scratch, docs, members, comp, signs)
    if more.limit(1).count():
        comp = components(scratch, links.unionByName(more))
    scratch.drop(members)

    rep = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fa", "fb", "n", F.coalesce("component", "rep").alias("c"))
    out = signed.drop("sig").join(rep, ["fa", "fb", "n"], "left")
    alone = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("c")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"), F.coalesce(F.col("id") == alone, F.lit(True)).alias("kept"))


def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, all columns as they came."""
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
