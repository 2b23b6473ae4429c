"""From raw documents to shards: quality, near-duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
``documents``; mixing repeats a document as often as the mix takes it. The last adds size, text_crc32, law, shard, slot.

Defined results, for every stage: a null or empty text scores the share of good labels in the first stage, is nobody's
near-duplicate, holds no benchmark window, counts one copy of size 0 in the mix and has size 1 in its shard; a null id is no
near-duplicate of anything and keeps its row; of rows with the same id none is dropped for the other; equal scores, sizes and
texts are settled by id; an empty table, or one of which a stage keeps nothing, gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, minhash, mixing, quality, sharding
from weftline.llm.common import Scratch, read
from weftline.llm.learn import remainder, sample


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score for good quality is below the classifier's threshold."""
    model = quality.fit(*sample(docs, read(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 5) != 0))
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, model, into=name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    out = mixing.mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("document")), keep=["document"])
    return out.where("copies > 0").select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn")).select("document.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.shard_by_bytes(docs)


STAGES = [("quality classifier", quality_filter), ("near-duplicates", one_of_each), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: The classifier and the signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
