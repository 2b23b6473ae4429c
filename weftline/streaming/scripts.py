"""A folder of SQL files as a stream: each new batch of files is merged into the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import Glossary
from ..operators.kb import Store, build_from_scan
from ..sources.files import scan_texts


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, glossary: Glossary | None = None) -> StreamingQuery:
    """Upserts the statements of new files. The checkpoint makes each file count once; a batch that is run again writes the
    same rows, as rows of a file replace that file's old ones."""
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    place = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))  # as scan() names it: relative to the folder
    named = stream.select(F.substring_index(place, full, -1).alias("path"), F.col("value").alias("text"))

    def take(batch: DataFrame, _: int) -> None:
        got = scan_texts(spark, ((r.path, r.text) for r in batch.orderBy("path").toLocalIterator()))
        if got.texts:
            store.upsert(build_from_scan(got, glossary), list(got.texts))

    return named.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
