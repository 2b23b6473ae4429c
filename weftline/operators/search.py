"""Keyword search, questions and matching over a knowledge base."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import weighted_score
from .graph import levels, resolve
from .kb import Store

KINDS = ("metrics", "fields", "tables", "terms", "rules")
#: How much a hit in each column counts.
WEIGHTS = {
    "metrics": {"chinese_name": 1.3, "metric_name": 1.2, "formula": 1.0, "formula_full": 0.9, "table_name": 0.8, "expression_normalized": 0.6, "depends_text": 0.5, "notes": 0.4},
    "fields": {"chinese_name": 1.3, "column_name": 1.2, "table_name": 0.7, "business_desc": 0.5, "sample_expression": 0.4},
    "tables": {"chinese_name": 1.3, "table_name": 1.2, "business_desc": 0.6},
    "terms": {"chinese_name": 1.3, "term": 1.2},
    "rules": {"description": 1.1, "expression": 0.9, "table_name": 0.7, "source_file": 0.6},
}
_NAMES = {"metrics": "metric_name", "fields": "column_name", "tables": "table_name", "terms": "term", "rules": "description"}


def search_one(df: DataFrame, kind: str, query: str) -> DataFrame:
    """(kind, name, title, table_name, score, richness) of the rows that match at all."""
    if kind == "metrics":
        df = df.withColumn("depends_text", F.concat_ws(" ", F.transform("depends_on", lambda d: F.concat_ws(" ", d["table"], d["column"], d["chinese_name"]))))
    rich = F.lit(0.0)
    if kind == "metrics":
        rich = F.size(F.regexp_extract_all(F.coalesce("formula", F.lit("")), F.lit(r"[+\-*/]"), 0)) + F.size("depends_on") * 0.1
    title = F.col("chinese_name") if "chinese_name" in df.columns else F.lit(None).cast("string")
    table = F.col("table_name") if "table_name" in df.columns else F.lit(None).cast("string")
    out = df.select(F.lit(kind).alias("kind"), F.col(_NAMES[kind]).alias("name"), title.alias("title"), table.alias("table_name"), weighted_score([(F.col(c), w) for c, w in WEIGHTS[kind].items()], query).alias("score"), rich.cast("double").alias("richness"))
    return out.where("score > 0")


def search(store: Store, query: str, kinds: tuple[str, ...] = KINDS, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """The best ``limit`` rows of each kind."""
    found = None
    for k in kinds:
        x = search_one(store.table(k), k, query)
        found = x if found is None else found.unionByName(x)
    w = Window.partitionBy("kind").orderBy(F.desc("score"), F.desc("richness"), F.coalesce("title", "table_name", "name"), "name", "table_name")
    return found.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# Kinds of questions, in the order they are tried.
INTENTS = (
    ("list_metrics", r"有哪些指标|指标清单|口径清单|所有口径|统计了哪些|有哪些口径|指标有哪些"),
    ("metric_formula", r"怎么算|如何算|怎么计算|如何计算|计算公式|公式是|口径是|的口径|怎么得出来|怎么来的|定义是什么|是什么意思的指标"),
    ("table_fields", r"[\w.]+(表|table)?\s*(有哪些字段|的字段|字段清单|表结构)"),
    ("metric_usage", r"(哪些表|哪张表|谁|哪里|何处)[^,，。?？]{0,12}(用到|使用|引用|消费|读取|包含|依赖)|\w+\s*(用在哪些表|被哪些表|出现在哪些表|被谁用|用在哪儿|用在哪些地方)"),
    ("upstream", r"\w+\s*(从哪来|来自哪里|上游|来源是|数据来源|是从哪)"),
    ("downstream", r"\w+\s*(下游|影响哪些|影响什么|改了会怎样|变更影响)"),
    ("term_meaning", r"\w+\s*(是什么意思|的含义|代表什么|是什么指标|指什么)"),
)
#: Words of politeness and of asking, endings and beginnings that belong to no name, signs that part pieces.
SPARE = ("请问", "问一下", "帮我", "帮忙", "我想知道", "我想问", "麻烦", "是什么", "是多少", "有哪些", "哪些", "哪张", "哪个", "什么")
PARTICLES = "的了吗呢啊呀吧被在 "
SIGNS = "，。,?？!！\t\n"


def intent_of(question: str) -> str:
    if not question or not question.strip():
        return "empty"
    return next((name for name, p in INTENTS if re.search(p, question)), "search")


def entity_of(question: str) -> str:
    """What a question is about: the longest piece left beside the words that gave the question its intent."""
    pattern = dict(INTENTS).get(intent_of(question))
    if pattern:
        said = re.search(pattern, question)
        groups = [said.span(i) for i in range(1, said.re.groups + 1) if said.group(i)] or [said.span()]
        question = question[: groups[0][0]] + "\n" + question[groups[-1][1] :]
    for word in SPARE:
        question = question.replace(word, "\n")
    pieces = question.translate(str.maketrans(dict.fromkeys(SIGNS, "\n"))).split("\n")
    return max((x.strip(PARTICLES) for x in pieces), key=len)


def answer(store: Store, question: str, limit: int = 20) -> dict:
    """A rule-made answer: intent, entity, text and the rows behind it."""
    intent, about = intent_of(question), entity_of(question)
    rows: list[dict] = []
    text = "没有找到相关知识"

    def lines(df: DataFrame, f) -> str:
        nonlocal rows
        rows = [r.asDict(True) for r in df.limit(limit).collect()]
        return "\n".join(map(f, rows))

    if intent == "empty":
        text = "请输入问题"
    elif intent == "list_metrics":
        text = lines(store.table("metrics").orderBy("layer", "table_name", "metric_name"), lambda r: f"{r['table_name']}.{r['metric_name']}: {r['formula']}") or text
    elif intent in ("metric_formula", "term_meaning"):
        text = lines(store.get_metric(about).orderBy(F.desc(F.size("depends_on")), "table_name"), lambda r: f"{r['formula']}（{r['table_name']}，{r['metric_type']}）")
        if not text:
            text = lines(store.table("terms").where((F.lower("term") == about.lower()) | (F.col("chinese_name") == about)), lambda r: f"{r['term']}：{r['chinese_name'] or '待确认'}")
        text = text or "没有找到相关知识"
    elif intent == "table_fields":
        t = store.get_table(about).first()
        if t:
            text = lines(store.table("fields").where(F.col("table_name") == t.table_name).orderBy("column_name"), lambda r: f"{r['column_name']}：{r['chinese_name'] or '待确认'}") or text
    elif intent == "metric_usage":
        f = store.table("fields").where((F.lower("column_name") == about.lower()) | (F.col("chinese_name") == about)).select("table_name").distinct().orderBy("table_name")
        text = lines(f, lambda r: r["table_name"]) or text
    elif intent in ("upstream", "downstream"):
        g = store.graph()
        t = resolve(g, about) or (lambda r: r.table_name if r else None)(store.get_table(about).first())
        if t:
            text = lines(levels(g, t, intent == "upstream").orderBy("level", "name"), lambda r: f"{r['level']}: {r['name']}") or "没有上下游"
    if intent == "search" or not rows and intent != "empty":
        text = lines(search(store, about or question, limit=limit).orderBy(F.desc("score")), lambda r: f"[{r['kind']}] {r['name']} {r['title'] or ''}") or text
    return {"intent": intent, "entity": about, "answer": text, "rows": rows}


def match(store: Store, records: list[dict], most: int = 12) -> dict[str, DataFrame]:
    """What a knowledge base knows of some statements: metrics of the columns they write, then others of their tables;
    terms of the columns they read; rules of their tables."""
    spark = store.spark
    out_cols = [(c["target_table"].lower(), c["target_column"].lower()) for r in records for c in r["columns"]]
    in_cols = [(c["source_column"] or "").lower() for r in records for c in r["columns"]]
    out_tabs = [t.lower() for r in records for t in r["output_table_names"]]
    cols = spark.createDataFrame(sorted(set(out_cols)) or [("", "")], "t string, c string")
    tabs = spark.createDataFrame([(t,) for t in sorted(set(out_tabs))] or [("",)], "t string")
    m = store.table("metrics").withColumn("t", F.lower("table_name")).withColumn("c", F.lower("metric_name"))
    direct = m.join(F.broadcast(cols), ["t", "c"], "left_semi").withColumn("direct", F.lit(True))
    beside = m.join(F.broadcast(tabs), "t", "left_semi").join(F.broadcast(cols), ["t", "c"], "left_anti").withColumn("direct", F.lit(False))
    metrics = direct.unionByName(beside).orderBy(F.desc("direct"), F.desc(F.size("depends_on")), "table_name", "metric_name").limit(most).drop("t", "c")
    words = spark.createDataFrame([(w,) for w in sorted(set(in_cols) | {c for _, c in out_cols}) if w] or [("",)], "term string")
    terms = store.table("terms").join(F.broadcast(words), "term", "left_semi").where("chinese_name is not null").orderBy(F.desc("confidence"), "term").limit(30)
    rules = store.table("rules").withColumn("t", F.lower("table_name")).join(F.broadcast(tabs), "t", "left_semi").orderBy("rule_type", "expression").limit(5).drop("t")
    return {"metrics": metrics, "terms": terms, "rules": rules}
