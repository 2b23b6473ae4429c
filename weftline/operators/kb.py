"""The knowledge base: fields, metrics, rules, terms, tables and scripts distilled from lineage records and comments.

Everything after parsing is DataFrame work. "First" always means the smallest (file, statement, position), so results do
not depend on how rows are dealt out.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import aggregate_of, classify_expression, describe_filter, detect_functions, normalize_expression, table_layer
from ..functions.names import CONFIDENCE, Glossary, localize, split_comment_unit, strip_aggregates
from ..plans.lineage import CONSTANT, local_frame
from ..plans.text import comments
from ..runtime import ship
from .graph import Graph

#: Kinds of rules, and what makes a comment a rule.
RULE_TYPES = ("过滤规则", "分区规则", "关联规则", "业务规则（注释）")
RULE_WORDS = re.compile("仅统计|只统计|仅计|剔除|排除|不计入|不含|过滤|口径|规则|注意|必须|按.*统计|视为|算作|以.*为准")

TABLES = ("scripts", "tables", "fields", "metrics", "rules", "terms", "table_lineage")
KEYS = {"scripts": ["source_file"], "tables": ["table_name"], "fields": ["table_name", "column_name"], "metrics": ["metric_name", "table_name", "source_file"], "rules": ["rule_key"], "terms": ["term"], "table_lineage": ["source_table", "target_table"]}


def rule_key(*parts):
    return F.substring(F.sha1(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), 1, 16)


def _named(df: DataFrame, glossary: Glossary, column: str, comment: str) -> DataFrame:
    """Adds chinese_name, chinese_source, confidence and unit for a column name and its comment."""

    @F.pandas_udf("chinese_name string, chinese_source string, confidence double, unit string")
    def names(col: pd.Series, note: pd.Series) -> pd.DataFrame:
        rows = []
        for c, n in zip(col, note, strict=True):
            name, source = glossary.resolve(c or "", n)
            rows.append((name, source, CONFIDENCE[source], split_comment_unit(n)[1]))
        return pd.DataFrame(rows, columns=["chinese_name", "chinese_source", "confidence", "unit"])

    return df.withColumn("__n", names(F.col(column), F.col(comment))).select("*", "__n.*").drop("__n")


def comment_frames(files: DataFrame) -> DataFrame:
    """(file, kind, key, note) of all comments, from (path, text); on the executors."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                c = comments(text or "")
                rows += [(path, "header", "", c.header)] if c.header else []
                for kind, pairs in (("column", c.columns.items()), ("where", c.where), ("note", c.notes), ("table", c.tables.items())):
                    rows += [(path, kind, k, n) for k, n in pairs]
            yield pd.DataFrame(rows, columns=["file", "kind", "key", "note"])

    ship(files.sparkSession)
    return files.select("path", "text").mapInPandas(run, "file string, kind string, key string, note string")


def build(statements: DataFrame, columns: DataFrame, files: DataFrame, graph: Graph, glossary: Glossary | None = None) -> dict[str, DataFrame]:
    """The seven tables of the knowledge base."""
    glossary = glossary or Glossary()
    notes = comment_frames(files)
    col_note = notes.where("kind = 'column'").select("file", F.col("key").alias("low"), "note")

    # fields
    made = columns.where("target_column <> '*'").select(F.col("target_table").alias("table_name"), F.col("target_column").alias("column_name"), F.lit("target").alias("role"), "expression", "file", "statement_index", "pos")
    read = columns.where(F.col("source_table").isNotNull() & F.col("resolved") & ~F.col("source_column").isin("*", CONSTANT)).select(F.col("source_table").alias("table_name"), F.col("source_column").alias("column_name"), F.lit("source").alias("role"), F.lit(None).cast("string").alias("expression"), "file", "statement_index", "pos")
    seen = made.unionByName(read).where("table_name <> '(query_result)'")
    seen = seen.withColumn("low", F.lower("column_name")).join(col_note, ["file", "low"], "left").withColumn("note", F.when(F.col("role") == "target", F.col("note")))
    named = _named(seen, glossary, "column_name", "note")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("file", "statement_index", "pos", F.col(c).alias("v"))))["v"]
    fields = named.groupBy("table_name", "column_name").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), "file", "statement_index", "pos", "chinese_name", "chinese_source", "confidence")).alias("b"),
        first("unit").alias("unit"), first("note").alias("business_desc"), first("expression").alias("sample_expression"),
        F.when(F.count_distinct("role") > 1, "both").otherwise(F.first("role")).alias("role"), F.array_sort(F.collect_set("file")).alias("source_files"),
    )
    fields = fields.select("table_name", "column_name", "b.chinese_name", "b.chinese_source", "b.confidence", "unit", table_layer(F.col("table_name")).alias("layer"), "role", "business_desc", "sample_expression", "source_files")
    fields = fields.cache()

    # metrics
    target = columns.where("target_table <> '(query_result)' and target_column <> '*'")
    per = target.groupBy("file", "statement_index", "target_table", "target_column").agg(
        F.min(F.struct("pos", "expression"))["expression"].alias("expression"), F.collect_list(F.struct("pos", F.col("source_table").alias("t"), F.col("source_column").alias("c"), "resolved")).alias("deps"),
    )
    per = per.withColumn("metric_type", classify_expression(F.col("expression"))).where("metric_type <> '直取'")
    per = per.withColumn("rank", F.row_number().over(_window("file", "target_table", "target_column").orderBy("statement_index"))).where("rank = 1").drop("rank")
    dep = per.select("file", "statement_index", "target_table", "target_column", F.explode("deps").alias("d")).where(f"d.c not in ('*', '{CONSTANT}')").select("file", "statement_index", "target_table", "target_column", "d.*").distinct()
    dep = dep.join(fields.select(F.col("table_name").alias("t"), F.col("column_name").alias("c"), F.col("chinese_name").alias("n")), ["t", "c"], "left")
    dep = dep.groupBy("file", "statement_index", "target_table", "target_column").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("t").alias("table"), F.col("c").alias("column"), F.col("n").alias("chinese_name")))).alias("dl"),
        F.count_if(F.col("n").isNull() | F.col("t").isNull() | ~F.col("resolved")).alias("unresolved"),
    )
    m = per.drop("deps").join(dep, ["file", "statement_index", "target_table", "target_column"], "left")
    m = m.join(fields.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"), "chinese_name", "chinese_source", "unit"), ["target_table", "target_column"], "left")
    m = m.join(statements.select(F.col("source").alias("file"), "statement_index", F.col("task_type").alias("source_task_type"), F.col("input_table_names").alias("input_tables")), ["file", "statement_index"], "left")
    dep_type = "array<struct<table:string,column:string,chinese_name:string>>"
    m = m.withColumn("depends_on", F.coalesce(F.transform("dl", lambda x: F.struct(x["table"].alias("table"), x["column"].alias("column"), x["chinese_name"].alias("chinese_name"))), F.array().cast(dep_type))).withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))

    @F.pandas_udf("formula string, formula_full string")
    def formulas(normalized: pd.Series, label: pd.Series, deps: pd.Series) -> pd.DataFrame:
        rows = []
        for n, lab, ds in zip(normalized, label, deps, strict=True):
            names = {d["column"].lower(): d["chinese_name"] for d in ds if d["chinese_name"]}
            body = strip_aggregates(n)
            if not re.search(r"[+\-*/<>]", body):
                body = n
            rows.append((f"{lab} = {localize(body, names)}", f"{lab} = {localize(n, names)}"))
        return pd.DataFrame(rows, columns=["formula", "formula_full"])

    agg = aggregate_of(F.col("expression"))
    sure = F.lit(0.9) - F.when(F.coalesce("chinese_source", F.lit("pending")) == "pending", 0.15).otherwise(0.0) - F.least(F.lit(0.2), F.col("unresolved") * 0.1) - F.when(F.col("metric_type").isin("窗口函数", "条件分支"), 0.05).otherwise(0.0)
    metrics = m.withColumn("expression_normalized", normalize_expression(F.col("expression"))).withColumn("f", formulas("expression_normalized", F.coalesce("chinese_name", "target_column"), "depends_on")).select(
        F.col("target_column").alias("metric_name"), F.col("target_table").alias("table_name"), F.col("file").alias("source_file"), "chinese_name", "chinese_source", table_layer(F.col("target_table")).alias("layer"), "metric_type",
        F.when(F.col("metric_type").isin("窗口函数", "条件分支", "比率", "聚合"), agg).alias("aggregate_func"), detect_functions(F.col("expression")).alias("functions"), F.col("expression").alias("expression_raw"), "expression_normalized",
        "f.formula", "f.formula_full", "depends_on", F.col("statement_index").alias("source_stmt"), "source_task_type", "input_tables", F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.97), sure)), 2).alias("confidence"), "unit",
        F.when(F.col("unresolved") > 0, F.concat(F.col("unresolved").cast("string"), F.lit(" 个依赖字段未能确定中文名/来源表"))).otherwise("").alias("notes"),
    )

    # rules
    head = F.try_element_at("output_table_names", F.lit(1))
    s = statements.select(F.col("source").alias("source_file"), F.col("statement_index").alias("source_stmt"), head.alias("table_name"), "filters", "partition_filters", "joins")
    base = ["source_file", "source_stmt", "table_name"]
    r1 = s.select(*base, F.explode("filters").alias("expression")).withColumn("rule_type", F.lit(RULE_TYPES[0])).withColumn("description", describe_filter(F.col("expression")))
    p = s.select(*base, F.explode("partition_filters").alias("k", "v")).select(*base, F.explode("v").alias("v"), "k")
    r2 = p.select(*base, F.concat("k", F.lit(" = '"), "v", F.lit("'")).alias("expression"), F.lit(RULE_TYPES[1]).alias("rule_type"), F.concat(F.lit("分区/时点条件："), "k", F.lit(" = "), "v").alias("description"))
    j = s.select(*base, F.explode("joins").alias("j")).where("j.on is not null")
    r3 = j.select(*base, F.col("j.on").alias("expression"), F.lit(RULE_TYPES[2]).alias("rule_type"), F.concat_ws(" ", "j.left", "j.type", "j.right", F.lit("ON"), "j.on").alias("description"))
    r4 = notes.where(F.col("kind").isin("where", "note", "column") & F.col("note").rlike(RULE_WORDS.pattern)).select(F.col("file").alias("source_file"), F.lit(0).alias("source_stmt"), F.lit(None).cast("string").alias("table_name"), F.col("key").alias("expression"), F.lit(RULE_TYPES[3]).alias("rule_type"), F.col("note").alias("description"))
    rules = r1.unionByName(r2).unionByName(r3).unionByName(r4).withColumn("rule_key", rule_key(F.col("rule_type"), F.col("table_name"), F.col("expression"), F.col("source_file")))
    rules = rules.withColumn("n", F.row_number().over(_window("rule_key").orderBy("source_file", "source_stmt", "description"))).where("n = 1").drop("n").withColumn("layer", table_layer(F.col("table_name")))

    # tables, scripts, lineage, terms
    n_cols = fields.groupBy("table_name").agg(F.count("*").alias("column_count"))
    where = statements.select(F.col("source").alias("f"), F.explode(F.concat("input_table_names", "output_table_names")).alias("table_name")).groupBy("table_name").agg(F.array_sort(F.collect_set("f")).alias("source_files"))
    t_note = notes.where("kind = 'table'").groupBy(F.col("key").alias("table_name")).agg(F.min("note").alias("business_desc"))
    known = statements.sparkSession.createDataFrame([*glossary.tables.items()] or [("", "")], "low string, g string")
    tables = where.join(n_cols, "table_name", "left").join(t_note, "table_name", "left").withColumn("low", F.lower("table_name")).join(F.broadcast(known), "low", "left")
    ends = lambda c: graph.edges.select(F.col(c).alias("table_name")).distinct().withColumn(c, F.lit(True))
    tables = tables.join(ends("target"), "table_name", "left").join(ends("source"), "table_name", "left").select(
        "table_name", F.element_at(F.split("table_name", r"\."), -1).alias("short_name"), table_layer(F.col("table_name")).alias("layer"), F.coalesce("g", "business_desc").alias("chinese_name"),
        F.when(F.col("g").isNotNull(), "exact_glossary").when(F.col("business_desc").isNotNull(), "comment").otherwise("pending").alias("chinese_source"), "business_desc",
        F.coalesce("column_count", F.lit(0)).alias("column_count"), F.col("target").isNull().alias("is_root"), F.col("source").isNull().alias("is_leaf"), "source_files",
    )
    headers = notes.where("kind = 'header'").select(F.col("file").alias("source_file"), F.col("note").alias("header_comment"))
    scripts = statements.groupBy(F.col("source").alias("source_file")).agg(
        F.count("*").alias("statement_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("output_table_names")))).alias("output_tables"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("input_table_names")))).alias("input_tables"), F.array_sort(F.collect_set("task_type")).alias("task_types"),
    ).join(headers, "source_file", "left")
    lineage = graph.edges.select(F.col("source").alias("source_table"), F.col("target").alias("target_table"), F.col("files").alias("source_files"), "column_mappings")
    gl = statements.sparkSession.createDataFrame([(k, v, c) for c, d in (("field", glossary.columns), ("table", glossary.tables)) for k, v in d.items()] or [("", "", "")], "term string, chinese_name string, category string").where("term <> ''")
    raw = gl.select("term", "chinese_name", "category", F.lit("builtin").alias("source"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("tables"), F.lit(0).alias("occurrences"))
    raw = raw.unionByName(fields.select(F.lower("column_name").alias("term"), "chinese_name", F.lit("field").alias("category"), F.col("chinese_source").alias("source"), "confidence", F.array("table_name").alias("tables"), F.lit(1).alias("occurrences")))
    raw = raw.unionByName(tables.where("chinese_name is not null").select(F.lower("table_name").alias("term"), "chinese_name", F.lit("table").alias("category"), F.col("chinese_source").alias("source"), F.lit(0.9).alias("confidence"), F.array("table_name").alias("tables"), F.lit(1).alias("occurrences")))
    terms = merge_terms(raw)
    return {"scripts": scripts, "tables": tables, "fields": fields, "metrics": metrics, "rules": rules, "terms": terms, "table_lineage": lineage}


def merge_terms(raw: DataFrame) -> DataFrame:
    x = raw.groupBy("term").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), (F.col("chinese_name").isNull()).alias("n"), "chinese_name", "category", "source", "confidence")).alias("b"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tables")))).alias("tables"), F.sum("occurrences").cast("int").alias("occurrences"),
    )
    return x.select("term", "b.chinese_name", "b.category", "b.source", "b.confidence", "tables", "occurrences")


def _window(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def build_from_scan(scan, glossary: Glossary | None = None) -> dict[str, DataFrame]:
    files = local_frame(scan.spark, [*scan.texts.items()] or [("", "")], "path string, text string")
    return build(scan.statements(), scan.columns(), files, scan.graph(), glossary)


# ---- store


class Store:
    """Parquet tables under one folder. Each write makes a new version; a small pointer file is swapped last, so readers see
    the old version or the new one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        root = self.hadoop.Path(self.path)
        if not self.fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(root)]
        return sorted(int(n[1:-3]) for n in names if re.fullmatch(r"v\d+\.ok", n))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self._versions()[-1]}/{name}")

    def _write(self, tables: dict[str, DataFrame]) -> None:
        have = self._versions()
        v = (have[-1] if have else 0) + 1
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.path}/v{v}/{name}")
        self.fs.create(self.hadoop.Path(f"{self.path}/v{v}.ok"), True).close()
        for old in have[:-1]:
            self.fs.delete(self.hadoop.Path(f"{self.path}/v{old}.ok"), False)
            self.fs.delete(self.hadoop.Path(f"{self.path}/v{old}"), True)

    def rebuild(self, tables: dict[str, DataFrame]) -> None:
        self._write(tables)

    def upsert(self, tables: dict[str, DataFrame], scanned: list[str]) -> None:
        """Merges what some files gave: rows of these files are replaced, rows that only they supported go, built-in terms stay."""
        if not self._versions():
            return self._write(tables)
        out = {}
        files = self.spark.createDataFrame([(f,) for f in scanned] or [("",)], "source_file string")
        for name in TABLES:
            old, new = self.table(name), tables[name]
            if "source_file" in old.columns:
                keep = old.join(F.broadcast(files), "source_file", "left_anti")
            elif name == "terms":
                keep = old.where("source = 'builtin'")
            else:
                gone = F.array(*[F.lit(f) for f in scanned]).cast("array<string>")
                keep = old.withColumn("source_files", F.array_except("source_files", gone)).where(F.size("source_files") > 0)
            out[name] = self._merge(name, keep, new)
        if len(out):
            out["terms"] = self._terms(out)
        return self._write(out)

    def _terms(self, out):
        own = out["fields"].select(F.lower("column_name").alias("term"), "chinese_name", F.lit("field").alias("category"), F.col("chinese_source").alias("source"), "confidence", F.array("table_name").alias("tables"), F.lit(1).alias("occurrences"))
        tabs = out["tables"].where("chinese_name is not null").select(F.lower("table_name").alias("term"), "chinese_name", F.lit("table").alias("category"), F.col("chinese_source").alias("source"), F.lit(0.9).alias("confidence"), F.array("table_name").alias("tables"), F.lit(1).alias("occurrences"))
        builtin = out["terms"].where("source = 'builtin'").withColumn("tables", F.array().cast("array<string>")).withColumn("occurrences", F.lit(0))
        return merge_terms(builtin.unionByName(own).unionByName(tabs))

    def _merge(self, name: str, keep: DataFrame, new: DataFrame) -> DataFrame:
        both = keep.select(*new.columns).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        if name in ("scripts", "metrics", "rules", "terms"):
            w = _window(*KEYS[name]).orderBy(F.desc("__new"))
            return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*new.columns)
        rank = [F.desc("__new")] if name != "fields" else [F.desc("confidence"), F.desc("__new")]
        top = both.withColumn("__n", F.row_number().over(_window(*KEYS[name]).orderBy(*rank))).where("__n = 1").drop("source_files", "__n", "__new")
        files = both.groupBy(*KEYS[name]).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_files")))).alias("source_files"))
        return top.join(files, KEYS[name]).select(*new.columns)

    def fingerprint(self) -> str:
        """The same for the same contents, in whatever order rows lie: of each table the count of its rows and the sums of four
        parts of their hashes, so rows are never gathered."""
        parts = []
        for name in TABLES:
            t = self.table(name)
            h = t.select(F.sha2(F.to_json(F.struct(*sorted(t.columns))).cast("binary"), 256).alias("h"))
            part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
            parts.append(f"{name}:{':'.join(map(str, h.agg(F.count('*'), *map(part, range(4))).first()))}")
        import hashlib

        return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]

    # -- lookups

    def get_metric(self, key: str) -> DataFrame:
        """By name or business name; failing that, names that hold the key, at most 50."""
        m, k = self.table("metrics"), key.strip().lower()
        exact = m.where((F.lower("metric_name") == k) | (F.lower("chinese_name") == k))
        return exact if exact.limit(1).count() else m.where(F.lower("metric_name").contains(k) | F.lower("chinese_name").contains(k)).orderBy("metric_name", "table_name").limit(50)

    def get_table(self, key: str) -> DataFrame:
        """Exact name, else its ending, else any part of it; the shortest name wins."""
        t, k, n = self.table("tables"), key.strip().lower(), F.lower("table_name")
        rank = F.when(n == k, 0).when(n.endswith("." + k), 1).when(n.contains(k), 2)
        return t.withColumn("__r", rank).where("__r is not null").orderBy("__r", F.length("table_name"), "table_name").limit(1).drop("__r")

    def counts(self) -> dict[str, int]:
        return {n: self.table(n).count() for n in TABLES}

    def summary(self, top: int = 10) -> dict:
        t, m = self.table("tables"), self.table("metrics")
        busy = t.join(m.groupBy("table_name").agg(F.count("*").alias("n")), "table_name", "left").select("table_name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "table_name").limit(top)
        group = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().orderBy(c).collect()}
        return {"counts": self.counts(), "tables_by_layer": group(t, "layer"), "metrics_by_type": group(m, "metric_type"), "metrics_by_layer": group(m, "layer"), "rules_by_type": group(self.table("rules"), "rule_type"), "top_tables": [(r.table_name, r.n) for r in busy.collect()]}

    def graph(self) -> Graph:
        return Graph.of_pairs(self.table("table_lineage").select(F.col("source_table").alias("source"), F.col("target_table").alias("target")))

    def export_json(self) -> dict:
        import json

        return {n: [json.loads(x) for x in self.table(n).orderBy(*KEYS[n]).toJSON().toLocalIterator()] for n in TABLES} | {"counts": self.counts(), "fingerprint": self.fingerprint()}
