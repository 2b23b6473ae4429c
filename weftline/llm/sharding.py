"""Contiguous shards of nearly equal bytes, by global prefix sums over per-partition totals.

Rows are ordered by (md5 of the text, id), so equal texts are neighbours. The order is dealt into sorted range
partitions and written once; a row's place is then its partition and its number there, and each partition's totals give
the bytes and rows before it. Shard k starts where the global offset passes k/n of all bytes: the partitions that
hold such a cut, at most n, get a running sum, which yields the cut as a row number. All other rows learn shard and slot by
comparing their own row number with the cuts, so texts are shuffled once and never windowed. A cut that falls inside a
group of equal texts moves to the group's nearer edge while the group is small (``tolerance`` of a shard); larger groups
are cut at the nearer row edge, so no group can unbalance the shards.

Defined results: a null text has size 1 and CRC 0; equal rows get neighbouring slots; no rows give no rows; input
columns that have the name of an output column are replaced, any other name is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Bytes of text in a range partition, about.
PART_BYTES = 64 << 20
#: Of monotonically_increasing_id: a row's number in its partition; above it the partition's.
IN_PART = (1 << 33) - 1


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, tolerance: float = 0.01) -> DataFrame:
    """``keep`` (all columns unless given) plus size, text_crc32, law, shard, slot and grown_shard (null: law ``bytes``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    base = docs.select(
        F.struct(*keep).alias("kept"), F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("__g"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    # the only step that moves texts: afterwards a row's place is its partition and its number there
    dealt = scratch.save(base.repartitionByRange(parts, "__g", "id").sortWithinPartitions("__g", "id").withColumn("place", F.monotonically_increasing_id()))
    slim = dealt.select("place", F.shiftright("place", 33).alias("p"), "__g", "size")
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    offsets = slim.groupBy("p").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    offsets = scratch.save(offsets.select("p", before("n").alias("b0"), "n", before("k").alias("r0"), "k"))

    def run(which: Column) -> DataFrame:
        """The rows of some partitions with the bytes and the rows before each of them."""
        inside = Window.partitionBy("p").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        some = slim.join(F.broadcast(offsets.where(which).select("p", "b0", "r0")), "p")
        return some.select("p", "__g", (F.col("b0") + F.sum("size").over(inside) - F.col("size")).alias("__at"), "size", (F.col("r0") + F.col("place").bitwiseAND(F.lit(IN_PART))).alias("row"))

    cuts, rows = [], offsets.agg(F.sum("k")).first()[0]
    if total:
        holds = _part("b0", total, n_shards) != _part("(b0 + n)", total, n_shards)  # at most n_shards partitions
        near = run(holds).select("__g", "__at", "size")
        rest = slim.join(F.broadcast(offsets.where(holds).select("p")), "p", "left_anti").select("__g", F.lit(None).cast("long").alias("__at"), "size")
        at = _cuts(scratch, near.unionByName(rest), total, n_shards, tolerance)
        found = run(F.exists(F.array(*map(F.lit, at or [-1])), lambda c: (F.col("b0") <= c) & (c < F.col("b0") + F.col("n")))).where(F.col("__at").isin(at))
        first = {r["__at"]: r.row for r in found.collect()} | {total: rows}  # a row for each cut
        cuts = [first[c] for c in at]
    row, shard, start = F.col("r0") + F.col("place").bitwiseAND(F.lit(IN_PART)), F.lit(0), F.lit(0)
    for c in cuts:
        shard = shard + F.when(row >= c, 1).otherwise(0)
        start = F.when(row >= c, F.lit(c)).otherwise(start)
    out = dealt.withColumn("p", F.shiftright("place", 33)).join(F.broadcast(offsets.select("p", "r0")), "p")
    return out.select(
        "kept.*", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), shard.cast("int").alias("shard"), (row - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _part(x: str, total: int, n: int) -> Column:
    """Which of ``n`` equal parts the byte offset ``x`` lies in, exactly (/ on decimals rounds)."""
    return F.expr(f"(cast({x} as decimal(38,0)) * {n}) div cast({total} as decimal(38,0))")


def _cuts(scratch: Scratch, rows: DataFrame, total: int, n: int, tolerance: float) -> list[int]:
    """The byte offsets where shards 1 to n-1 start: n-1 numbers. Rows that can't hold a cut need no offset."""
    over = rows.where(_part("__at", total, n) != _part("(__at + size)", total, n)).collect()  # at most n rows: each holds a cut or the end
    groups = sorted({r["__g"] for r in over})
    sums = [F.sum(F.when(held, F.col("size"))) for g in groups for held in (F.col("__g") < g, F.col("__g") <= g)]
    got = [v or 0 for v in rows.agg(*sums).first()] if groups else []
    bounds = {g: (got[2 * i], got[2 * i + 1]) for i, g in enumerate(groups)}
    cuts = []
    for k in range(1, n):
        held = next((r for r in over if r["__at"] * n < k * total <= (r["__at"] + r["size"]) * n), None)
        if held is None:
            raise RuntimeError(f"no row holds cut {k} of {n} over {total} bytes")
        a, b = bounds[held["__g"]]
        if (b - a) * n > tolerance * total:
            a, b = held["__at"], held["__at"] + held["size"]
        cuts.append(a if k * total - a * n <= b * n - k * total else b)
    return cuts


def op3_sharding(spark, sf_dir):
    return shard_by_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


#: CRC-32 by half bytes (reflected polynomial EDB88320).
_NIBBLES = []
for _i in range(16):
    for _ in range(4):
        _i = (_i >> 1) ^ (0xEDB88320 if _i & 1 else 0)
    _NIBBLES.append(_i)

ORACLE = f"""
WITH RECURSIVE b AS (
  SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS g, (strlen(coalesce(text, '')) + 1)::BIGINT AS size FROM documents),
hx AS (SELECT DISTINCT g, hex(encode(t)) AS h FROM b),
nib AS (SELECT g, list_transform(range(0, len(h)), lambda i: strpos('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1) AS ns FROM hx),
crc AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, ns::BIGINT[]),
  lambda a, x: xor(a >> 4, ([{", ".join(map(str, _NIBBLES))}]::BIGINT[])[(xor(a, x) & 15) + 1])), 4294967295::BIGINT) AS c FROM nib),
o AS (SELECT *, (sum(size) OVER (ORDER BY g, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS o_at, row_number() OVER (ORDER BY g, doc_id) - 1 AS rn,
  (sum(size) OVER ())::BIGINT AS total FROM b),
gr AS (SELECT g, min(o_at) AS lo, max(o_at + size) AS hi FROM o GROUP BY g),
k AS (SELECT unnest(range(1, 8)) AS k),
cut AS (SELECT k, CASE WHEN k * total - a * 8 <= e * 8 - k * total THEN a ELSE e END AS c FROM (
  SELECT k, total, CASE WHEN (hi - lo) * 8 <= 0.01 * total THEN lo ELSE o_at END AS a, CASE WHEN (hi - lo) * 8 <= 0.01 * total THEN hi ELSE o_at + size END AS e
  FROM k JOIN o ON o_at * 8 < k * total AND k * total <= (o_at + size) * 8 JOIN gr USING (g))),
s AS (SELECT o.*, (SELECT count(*) FROM cut WHERE c <= o.o_at)::INT AS shard FROM o)
SELECT doc_id, size, c AS text_crc32, 'bytes' AS law, shard, (rn - min(rn) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM s JOIN crc USING (g)
"""
