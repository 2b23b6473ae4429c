"""SQL and script files as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bridge import ParseError
from ..plans.lineage import columns_frame, parse_texts, statements_frame

#: Folders that are not looked into.
IGNORED = (
    "__pycache__ .venv venv env .git .hg .svn .idea .vscode .pytest_cache .mypy_cache .ruff_cache .tox node_modules target build dist site-packages .ipynb_checkpoints"
).split()


def read_files(spark: SparkSession, root: str, suffix: str = ".sql", ignore: list[str] | None = None) -> DataFrame:
    """(path relative to root, text) of files below ``root``, but for ignored and hidden folders. Bad bytes are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    base = raw.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    path = F.substring("path", F.lit(len(full) + 1), F.length("path"))
    folders = F.slice(F.split(F.lower("rel"), "/"), 1, F.size(F.split("rel", "/")) - 1)
    skip = F.exists(folders, lambda f: f.isin(*(ignore or IGNORED)) | f.startswith("."))
    return raw.select(path.alias("rel"), F.col("content").cast("string").alias("text")).where(~skip).select(F.col("rel").alias("path"), "text")


@dataclass
class Scan:
    """What a scan found."""

    spark: SparkSession
    files: int = 0
    records: list[dict] = field(default_factory=list)
    failures: list[dict] = field(default_factory=list)
    empty: list[str] = field(default_factory=list)
    several: list[str] = field(default_factory=list)
    texts: dict[str, str] = field(default_factory=dict)

    def statements(self) -> DataFrame:
        return statements_frame(self.spark, self.records)

    def columns(self) -> DataFrame:
        return columns_frame(self.spark, self.records)

    def graph(self):
        from ..operators.graph import build

        return build(self.statements(), self.columns())

    def summary(self) -> dict:
        from ..operators.graph import stats

        kinds: dict[str, int] = {}
        for r in self.records:
            kinds[r["task_type"]] = kinds.get(r["task_type"], 0) + 1
        return {"files": self.files, "failed_files": len(self.failures), "empty_files": len(self.empty), "multi_statement_files": len(self.several), "statements": len(self.records), "task_types": kinds} | stats(self.graph())


#: Files whose statements go to the parser together.
TOGETHER = 64


def scan_texts(spark: SparkSession, files, extended: bool = False) -> Scan:
    """Parses (path, text) pairs; a file that fails is noted and the scan goes on."""
    out, rest = Scan(spark), iter(files)
    while some := list(islice(rest, TOGETHER)):
        out.files += len(some)
        out.texts |= dict(some)
        for (path, _), got in zip(some, parse_texts(spark, some, extended), strict=True):
            if isinstance(got, ParseError):
                out.failures.append({"file": path, "error": str(got)})
                continue
            if not got:
                out.empty.append(path)
            if len(got) > 1:
                out.several.append(path)
            out.records += got
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, max_files: int | None = None, extended: bool = False) -> Scan:
    """Parses every SQL file below a folder, in the order of paths."""
    files = read_files(spark, root, ".sql", ignore).orderBy("path")
    files = files.limit(max_files) if max_files else files
    return scan_texts(spark, ((r.path, r.text) for r in files.toLocalIterator()), extended)
