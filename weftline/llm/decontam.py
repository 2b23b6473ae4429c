"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows, scanned by every training window.

Each document's words are read once into an array and exploded. A window of the benchmark can only lie where its longest
word stands, so words meet the benchmark's longest words in a hash join; the window around each such place is hashed and
meets the set of window hashes, and a hit counts only when the words themselves are equal. What is shuffled is the hits
and, for the report, a row of figures for each document: no text. The benchmark is broadcast when the counted bytes of its
windows stay under ``BROADCAST_BYTES``; beyond that words (id, place, word) meet the benchmark's longest words by a shuffle, and
only documents with such a place are read again for the window around it.

Defined results: a null text has no words and no hits; a null benchmark text is no item; the windows of an item whose id is
null hit like any other's, but the item is not counted or named; equal rows get equal figures; an empty benchmark
contaminates nothing; input columns that have the name of an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, read

WINDOW = 10
#: Bytes of the benchmark's windows, as rows in memory, up to which they are broadcast.
BROADCAST_BYTES = 128 << 20
BROADCAST_KEYS = 500_000
OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def benchmark_windows(bench: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(b_hash, b_words, b_len, item): every window of every item, once."""
    w = bench.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(size))
    w = w.select("item", "w", n.alias("b_len"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    w = w.select("item", "b_len", F.slice("w", F.col("i"), F.col("b_len")).alias("b_words")).distinct()
    return w.withColumn("b_hash", F.xxhash64("b_words"))


def hits(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, bench_text: str, size: int, scratch: Scratch) -> DataFrame:
    """(__id, __t, pos, b_len, item): the verified windows of each different (id, text)."""
    grams = benchmark_windows(bench, item_col, bench_text, size)
    # a window is looked for where its longest word stands
    longest = F.array_max(F.transform("b_words", lambda w, i: F.struct(F.length(w).alias("n"), w.alias("w"), (-i).alias("i"))))
    grams = scratch.save(grams.withColumn("a_word", longest["w"]).withColumn("a_off", -longest["i"]))
    # a word takes 8 bytes for its place, 8 for its length and itself in whole 8 bytes; a row some 100 more
    held = F.aggregate("b_words", F.lit(100), lambda n, w: n + 24 + F.octet_length(w))
    small = grams.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0] <= BROADCAST_BYTES
    near = F.broadcast if small else (lambda x: x)
    places = grams.select("a_word", "a_off", F.col("b_len").alias("a_len")).distinct()
    base = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__t"), words(F.col(text_col)).alias("__w"))
    pos = F.col("p") - F.col("a_off")
    fits = (F.col("pos") >= 0) & (F.col("pos") + F.col("a_len") <= F.size("__w"))
    if small:
        each = base.select("__id", "__t", "__w", F.posexplode("__w").alias("p", "x")).join(near(places), F.col("x") == F.col("a_word"))
        each = each.withColumn("pos", pos).where(fits)
    else:
        found = base.select(F.col("__id").alias("i"), F.col("__t").alias("t"), F.posexplode("__w").alias("p", "x")).join(places, F.col("x") == F.col("a_word"))
        found = scratch.save(found.select("i", "t", pos.alias("pos"), "a_len").where("pos >= 0").distinct())
        each = base.dropDuplicates(["__id", "__t"]).join(found, F.col("__id").eqNullSafe(F.col("i")) & F.col("__t").eqNullSafe(F.col("t"))).where(fits)
    window = F.slice("__w", F.col("pos") + 1, F.col("a_len"))
    each = each.withColumn("h", F.xxhash64(window)).join(near(grams.drop("a_word", "a_off")), (F.col("h") == F.col("b_hash")) & (F.col("a_len") == F.col("b_len")))
    return scratch.save(each.where(window == F.col("b_words")).select("__id", "__t", "pos", "b_len", "item"))


def spans(found: DataFrame) -> DataFrame:
    """(__id, __t, start, stop): maximal runs of hit words, stop excluded."""
    w = Window.partitionBy("__id", "__t").orderBy("pos", "b_len")
    stop = F.col("pos") + F.col("b_len")
    x = found.select("__id", "__t", "pos", "b_len").distinct()
    x = x.withColumn("seen", F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("run", F.sum(F.when(F.col("seen").isNull() | (F.col("pos") > F.col("seen")), 1).otherwise(0)).over(w))
    return x.groupBy("__id", "__t", "run").agg(F.min("pos").alias("start"), F.max(stop).alias("stop")).drop("run")


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", size: int = WINDOW) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch = Scratch(docs.sparkSession, "decontam")
    found = hits(docs, bench, id_col, text_col, item_col, bench_text, size, scratch)
    covered = spans(found).groupBy("__id", "__t").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"))
    items = found.groupBy("__id", "__t").agg(F.sort_array(F.collect_set("item")).alias("items"))  # no more than the benchmark's items
    per = covered.join(items.withColumnsRenamed({"__id": "i2", "__t": "t2"}), F.col("__id").eqNullSafe(F.col("i2")) & F.col("__t").eqNullSafe(F.col("t2")))
    per = per.select(F.col("__id").alias("i"), F.col("__t").alias("t"), "n_hit", "items")
    base = docs.select(F.col(id_col), F.xxhash64(text_col).alias("__t"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = base.join(per, base[id_col].eqNullSafe(F.col("i")) & (F.col("__t") == F.col("t")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(id_col, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents without a hit, all their columns as they came."""
    scratch = Scratch(docs.sparkSession, "decontam")
    found = hits(docs, bench, id_col, text_col, item_col, bench_text, size, scratch)
    keys = scratch.save(found.select(F.col("__id").alias("__i"), F.col("__t").alias("__t2")).distinct())
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(side, docs[id_col].eqNullSafe(side["__i"]) & (F.xxhash64(docs[text_col]) == side["__t2"]), "left_anti")


def op4_decontamination(spark, sf_dir):
    return report(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.i, x.n, g.item FROM x JOIN g ON x.n = g.n AND x.g = g.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
