"""SQL and pipelines out of a knowledge base, and their validation.

Generation reads knowledge rows, never invents: a column whose expression is not known becomes a warning. Validation is a
union of DataFrames, an issue a row.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import LAYER_INDEX, layer_step_ok, score_text, table_layer
from ..functions.names import KEYWORDS
from ..plans.lineage import ParseError, parse_sql
from ..plans.text import split_statements
from .graph import Graph, cycles
from .kb import Store

#: Endings of columns that join tables, best first.
KEY_ENDINGS = ("_code", "_id", "_no", "_key")
START_LAYERS, END_LAYERS = ("src", "stg", "ods"), ("ads", "app")
_WORD = re.compile(r"'[^']*'|[^\W\d]\w*(?:\.[^\W\d]\w*)?")


@dataclass
class Column:
    name: str
    expression: str
    evidence: str
    comment: str = ""


@dataclass
class Generated:
    sql: str
    target: str
    sources: list[str]
    columns: list[Column] = field(default_factory=list)
    joins: list[tuple[str, str, str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def join_keys(left: list[str], right: list[str]) -> list[str]:
    """Common columns, those with the endings of keys first."""
    common = set(left) & set(right)
    return sorted(common, key=lambda c: (next((i for i, e in enumerate(KEY_ENDINGS) if c.endswith(e)), len(KEY_ENDINGS)), c))


#: Prefix of a side table's name, before what its key column begins with.
SIDE_PREFIX = re.compile(r"^(?:dim|维表)[_\-]?", re.I)


def side_key(left: list[str], side_table: str) -> str | None:
    """The column by whose name a table points at a side table: dim.dim_plant is meant by plant_code, plant_id and so on."""
    what = SIDE_PREFIX.sub("", side_table.split(".")[-1]).lower()
    have = {c.lower(): c for c in left}
    return next((have[what + e] for e in KEY_ENDINGS if what and what + e in have), None)


def aliases(tables: list[str]) -> dict[str, str]:
    return {t: f"t{i}" for i, t in enumerate(tables, 1)}


def qualify(expr: str, owner: dict[str, str]) -> str:
    """Columns of an expression with their table's alias; words followed by a bracket and keywords stay."""

    def one(m):
        w = m.group()
        if w[0] == "'" or w.upper() in KEYWORDS or expr[m.end() :].lstrip().startswith("("):
            return w
        bare = w.split(".")[-1]
        return f"{owner[bare]}.{bare}" if bare in owner else w

    return _WORD.sub(one, expr)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def generate_sql(
    store: Store, target: str, sources: list[str], metrics: list[str] = (), group_by: list[str] = (), partition: dict[str, str] | None = None, where: list[str] = (),
    joins: list[dict] = (), all_columns: bool = False, graph: Graph | None = None,
) -> Generated:
    """INSERT OVERWRITE of ``metrics`` by ``group_by`` from ``sources``. The knowledge of these tables alone is read.

    ``joins``, dicts of table, on and kind, go before what would be inferred; ``all_columns`` takes every column that the
    knowledge base has of the target. Warnings say which of the target's known columns are left out, and whether the
    partition's column is the one that statements in ``graph`` write the target by. What comes out is parsed once.
    """
    if all_columns and target:
        own = store.table("fields").where((F.col("table_name") == target) & F.col("role").isin("target", "both"))
        metrics = list(dict.fromkeys([*metrics, *(r["column_name"] for r in _rows(own.select("column_name").orderBy("column_name")) if r["column_name"] not in group_by)]))
    if not target or not sources or not (metrics or group_by):
        raise ValueError("a target, sources, and metrics or group_by are needed")
    fields = _rows(store.table("fields").where(F.col("table_name").isin(sources)).select("table_name", "column_name"))
    have = {s: sorted(r["column_name"] for r in fields if r["table_name"] == s) for s in sources}
    names = aliases(sources)
    owner: dict[str, str] = {}
    for s in sources:
        for c in have[s]:
            owner.setdefault(c, names[s])
    out = Generated("", target, list(sources))
    for g in group_by:
        if g in owner:
            out.columns.append(Column(g, f"{owner[g]}.{g}", "grouping column of a source"))
        else:
            out.warnings.append(f"{g}: no source has this column")
    low = [m.lower() for m in metrics]
    known = _rows(store.table("metrics").where(F.lower("metric_name").isin(low) | F.lower("chinese_name").isin(low)))
    for m in metrics:
        hits = [k for k in known if m.lower() in ((k["metric_name"] or "").lower(), (k["chinese_name"] or "").lower())]
        # the target's own metric, then one of a source, then a plain column of a source, then any other
        hits.sort(key=lambda k: (k["table_name"] != target, k["table_name"] not in sources, -k["confidence"], k["table_name"]))
        usable = [k for k in hits if all(d["column"] in owner for d in k["depends_on"])]
        if usable and usable[0]["table_name"] not in sources:
            k = usable[0]
            out.columns.append(Column(k["metric_name"], qualify(k["expression_normalized"], owner), f"expression of {k['table_name']}.{k['metric_name']} in {k['source_file']}", k["chinese_name"] or ""))
        elif (name := (hits[0]["metric_name"] if hits else m)) in owner:
            expr = f"{owner[name]}.{name}"
            out.columns.append(Column(name, f"SUM({expr})" if group_by else expr, "column of a source", (hits[0]["chinese_name"] or "") if hits else ""))
        else:
            out.warnings.append(f"{m}: no expression whose columns the sources have")
    given = {j["table"]: j for j in joins}
    for s in sources[1:]:
        keys = join_keys(have[sources[0]], have[s])
        if s in given:
            out.joins.append((s, names[s], given[s]["on"], given[s].get("kind", "LEFT").upper()))
        elif keys or (by_name := side_key(have[sources[0]], s)):
            key = keys[0] if keys else by_name
            out.joins.append((s, names[s], f"{names[sources[0]]}.{key} = {names[s]}.{key}", "LEFT"))
            if not keys:
                out.warnings.append(f"{s}: joined by the name of {key}, which the knowledge base does not know there")
        else:
            out.warnings.append(f"{s}: no common column to join by")
    known_columns = {r["column_name"] for r in _rows(store.table("fields").where((F.col("table_name") == target) & F.col("role").isin("target", "both")).select("column_name"))}
    left_out = sorted(known_columns - {c.name for c in out.columns})
    if left_out:
        out.warnings.append(f"{target}: {len(known_columns) - len(left_out)} of {len(known_columns)} known columns; without {', '.join(left_out)}")
    if partition and graph is not None:
        known = partition_field(graph, target)
        out.warnings += [f"{k}: {target} is written by {known}" if known else f"{k}: no statement shows that {target} is partitioned by it" for k in partition if k != known]
    if not out.columns:
        raise ValueError("; ".join(out.warnings))
    out.sql = render(out, [f"{owner[g]}.{g}" for g in group_by if g in owner], partition or {}, list(where))
    try:
        parse_sql(store.spark, out.sql, target)
    except ParseError as e:
        out.warnings.append(f"what was generated does not parse: {e}")
    return out


def render(g: Generated, group_by: list[str], partition: dict[str, str], where: list[str]) -> str:
    spec = f" PARTITION ({', '.join(f"{k}='{v}'" for k, v in partition.items())})" if partition else ""
    lines = [f"INSERT OVERWRITE TABLE {g.target}{spec}", "SELECT"]
    for i, c in enumerate(g.columns):
        comma = "," if i < len(g.columns) - 1 else ""
        lines.append(f"    {c.expression} AS {c.name}{comma}" + (f"  -- {c.comment}" if c.comment else ""))
    lines.append(f"FROM {g.sources[0]} t1")
    lines += [f"{kind} JOIN {t} {a} ON {on}" for t, a, on, kind in g.joins]
    if where:
        lines.append("WHERE " + "\n  AND ".join(where))
    if group_by and any(re.search(r"\b(SUM|COUNT|AVG|MAX|MIN)\s*\(", c.expression, re.I) for c in g.columns):
        lines.append("GROUP BY " + ", ".join(group_by))
    return "\n".join(lines)


# ---- what the graph says of a table


def edges_into(g: Graph, table: str) -> DataFrame:
    return g.edges.where(F.col("target") == table).orderBy(F.desc("column_mappings"), "source")


def expressions_into(g: Graph, table: str) -> DataFrame:
    """(source, target_column, source_column, expression) of everything that fills a table."""
    return g.edges.where(F.col("target") == table).select("source", F.explode("columns").alias("c")).select("source", "c.target_column", "c.source_column", "c.expression")


def main_upstream(g: Graph, table: str) -> str | None:
    """The source with most column mappings, dimension tables last."""
    e = g.edges.where((F.col("target") == table) & (F.col("source") != table))
    got = e.orderBy(table_layer(F.col("source")) == "dim", F.desc("column_mappings"), "source").select("source").first()
    return got.source if got else None


def partition_field(g: Graph, table: str) -> str | None:
    """The partition column that statements writing a table name most often."""
    e = g.edges.where((F.col("target") == table) & (F.size("partition_filters") > 0)).select(F.explode("partition_filters").alias("k", "v"))
    got = e.groupBy("k").count().orderBy(F.desc("count"), "k").first()
    return got.k if got else None


def detect_aliases(expr: str) -> list[str]:
    """Prefixes of columns in an expression, in order."""
    return list(dict.fromkeys(m.group(1) for m in re.finditer(r"(?<![\w.'])([^\W\d]\w*)\s*\.\s*[^\W\d]", re.sub(r"'[^']*'", "''", expr))))


def rewrite_aliases(expr: str, new: dict[str, str]) -> str:
    """An expression with its column prefixes replaced."""
    return re.sub(r"'[^']*'|(?<![\w.])([^\W\d]\w*)(?=\s*\.\s*[^\W\d])", lambda m: m.group() if m.group()[0] == "'" else new.get(m.group(1), m.group(1)), expr)


# ---- pipelines


def find_target(store: Store, text: str, least: float = 5.0) -> str | None:
    """The written table that a request names best."""
    t = store.table("tables").where("not is_root")
    s = F.greatest(score_text(F.col("table_name"), text) * 1.2, score_text(F.col("chinese_name"), text) * 1.3, score_text(F.col("short_name"), text))
    got = t.select("table_name", s.alias("s")).where(F.col("s") >= least).orderBy(F.desc("s"), F.length("table_name"), "table_name").first()
    return got.table_name if got else None


DATE = "${bizdate}"


def new_table(store: Store, request: str, layer: str) -> tuple[str, str] | None:
    """(name, main source) of a table that does not exist yet: the known table of a lower layer that the request names best,
    or, where none is named, the lower table with most columns."""
    index = F.when(F.col("layer") == "dim", -1)
    for k, v in LAYER_INDEX.items():
        index = index.when(F.col("layer") == k, v)
    t = store.table("tables").withColumn("i", F.coalesce(index, F.lit(-1))).where((F.col("i") >= 0) & (F.col("i") < LAYER_INDEX.get(layer, 4)))
    s = F.greatest(score_text(F.coalesce("chinese_name", F.lit("")), request), score_text(F.col("short_name"), request))
    got = t.select("table_name", s.alias("s"), "i", "column_count").orderBy(F.desc("s"), F.desc("i"), F.desc("column_count"), "table_name").first()
    slug = re.sub(r"\W+", "_", request.strip().lower()).strip("_")[:40] or "new"
    return (f"{layer}.{layer}_{slug}", got.table_name) if got else None


def pipeline(store: Store, request: str = "", max_stages: int = 6, target: str | None = None, target_layer: str | None = None, partition: str | None = "dt") -> dict:
    """Stages from a source layer to the table a request names, or to ``target``: each step takes the lower-layer source with
    most mappings. With ``target_layer``, a request that names no table leads to a new table of that layer over the table
    that fits best. Stages write the partition ``partition`` of the day DATE."""
    if not request and not target:
        raise ValueError("a request or a target is needed")
    warnings: list[str] = []
    made_up = None
    target = target or find_target(store, request)
    if target is None and target_layer and (made_up := new_table(store, request, target_layer)):
        target = made_up[0]
        warnings.append(f"{target} is new; its columns are derived from {made_up[1]} and need a look")
    if target is None:
        return {"found": False, "stages": []}
    e = store.table("table_lineage").withColumn("layer", table_layer(F.col("source_table"))).withColumn("target_layer", table_layer(F.col("target_table")))
    stages, at, seen = [], target, set()
    if made_up:
        stages.append({"name": f"to_{target.split('.')[-1]}", "target_table": target, "layer": target_layer, "sources": [made_up[1]]})
        at = made_up[1]
    while at and at not in seen and len(stages) < max_stages:
        seen.add(at)
        into = _rows(e.where(F.col("target_table") == at).orderBy(F.desc("column_mappings"), "source_table"))
        if not into:
            break
        lower = [r for r in into if LAYER_INDEX.get(r["layer"], 2) < LAYER_INDEX.get(r["target_layer"], 2) and r["layer"] != "dim"]
        main = (lower or [r for r in into if r["layer"] != "dim"] or into)[0]
        sources = [main["source_table"], *[r["source_table"] for r in into if r["source_table"] != main["source_table"]]]
        stages.append({"name": f"to_{at.split('.')[-1]}", "target_table": at, "layer": into[0]["target_layer"], "sources": sources})
        if main["layer"] in ("src", "stg"):
            break
        at = main["source_table"]
        if len(stages) == max_stages and e.where(F.col("target_table") == at).limit(1).count():
            warnings.append(f"max_stages {max_stages}: {at} is made by statements that are left out")
    stages.reverse()
    made = {s["target_table"] for s in stages}
    for s in stages:
        s["depends_on"] = [x["name"] for x in stages if x["target_table"] in s["sources"]]
        s["external_inputs"] = [t for t in s["sources"] if t not in made]
        known = made_up[1] if made_up and s["target_table"] == target else s["target_table"]
        roles = ("target", "both") if known == s["target_table"] else ("target", "both", "source")
        cols = [r["column_name"] for r in _rows(store.table("fields").where((F.col("table_name") == known) & F.col("role").isin(*roles)).orderBy("column_name"))]
        day = {partition: DATE} if partition else None
        try:
            g = generate_sql(store, s["target_table"], s["sources"], [c for c in cols if c != partition], partition=day)
            s["sql"], s["warnings"], s["columns"] = g.sql, g.warnings, [(c.name, c.expression) for c in g.columns]
        except ValueError as x:
            s["sql"], s["warnings"], s["columns"] = None, [str(x)], []
    edges = [{"source": d, "target": s["target_table"], "kind": "external" if d in s["external_inputs"] else "chain"} for s in stages for d in s["sources"]]
    nodes = sorted({n for x in edges for n in (x["source"], x["target"])})
    return {"found": True, "target": target, "table_mode": "new" if made_up else "reuse", "date_placeholder": DATE, "stages": stages, "nodes": nodes, "edges": edges, "warnings": warnings}


def apply_plan(stages: list[dict], workflow: str, send=None, client=None, project: int | None = None) -> dict:
    """The scheduler's definition of a pipeline. Without ``send`` or ``client`` nothing leaves: a dry run. With a client the
    project's workflow of the same name is deleted, the new one created and read back."""
    codes = {s["name"]: i for i, s in enumerate(stages, 1)}
    notes: list[str] = []
    if client is not None:
        for old in client.workflows(project):
            if old["name"] == workflow:
                client.delete_workflow(project, old["code"])
                notes.append(f"deleted the old workflow {workflow} ({old['code']})")
        codes = dict(zip(codes, client.task_codes(project, len(stages)), strict=True))
    tasks = [{"code": codes[s["name"]], "name": s["name"], "taskType": "SQL", "taskParams": {"type": "HIVE", "sql": s["sql"] or ""}} for s in stages]
    rel = [{"preTaskCode": codes[d], "postTaskCode": codes[s["name"]]} for s in stages for d in s["depends_on"]] + [{"preTaskCode": 0, "postTaskCode": codes[s["name"]]} for s in stages if not s["depends_on"]]
    body = {"name": workflow, "taskDefinitionJson": json.dumps(tasks, ensure_ascii=False), "taskRelationJson": json.dumps(rel)}
    out = {"dry_run": send is None and client is None, "definition": body, "response": send(body) if send else None, "notes": notes}
    if client is not None:
        made = client.create_workflow(project, body)
        back = client.workflow(project, made["code"]) or {}
        out |= {"response": made, "workflow_code": made["code"], "readback": {"tasks": len(back.get("taskDefinitionList") or []), "relations": len(back.get("processTaskRelationList") or [])}}
    return out


# ---- validation


ISSUES = "type string, level string, subject string, message string"


def validate(spark: SparkSession, stages: list[dict], store: Store | None = None) -> tuple[bool, DataFrame]:
    """(passed, issues) of stages (name, sql, target_table, external_inputs); passed means no error."""
    records, issues = [], []
    for s in stages:
        try:
            got = parse_sql(spark, s.get("sql") or "", s["name"])
            if not got:
                issues.append(("parse", "error", s["name"], "no statement"))
            records += got
        except ParseError as e:
            issues.append(("parse", "error", s["name"], str(e)))
    if not stages:
        issues.append(("parse", "error", "", "no stages"))
    pairs = spark.createDataFrame([(a, t, r["source"]) for r in records for t in r["output_table_names"] for a in r["input_table_names"]], "source string, target string, stage string")
    outside = spark.createDataFrame([(t,) for s in stages for t in s.get("external_inputs", [])], "name string").distinct()
    out = spark.createDataFrame(issues, ISSUES)
    for other in (layer_issues(pairs), cycle_issues(pairs), end_issues(pairs, outside)):
        out = out.unionByName(other)
    if store is not None:
        out = out.unionByName(metric_issues(spark, records, store)).unionByName(diff_issues(pairs, store))
    out = out.cache()
    return out.where("level = 'error'").limit(1).count() == 0, out


def stages_of(sql: str, name: str = "sql") -> list[dict]:
    """A stage for each statement of a text, for validation; a line ``-- external: a, b`` names tables that come from outside."""
    outside = [t.strip() for line in re.findall(r"(?im)^--\s*external\s*:(.*)$", sql) for t in line.split(",") if t.strip()]
    return [{"name": f"{name}:{i}", "sql": text, "external_inputs": outside} for i, (_, text) in enumerate(split_statements(sql), 1)]


def issues_markdown(passed: bool, issues: DataFrame, title: str = "Validation") -> str:
    """A report of a validation: how many of each kind, then every issue."""
    rows = [r.asDict() for r in issues.orderBy("level", "type", "subject").collect()]  # of the stages of one pipeline
    counts: dict[tuple, int] = {}
    for r in rows:
        counts[r["level"], r["type"]] = counts.get((r["level"], r["type"]), 0) + 1
    cell = lambda x: str(x or "").replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "passed" if passed else "not passed", "| level | kind | issues |\n|-|-|-|", *[f"| {a} | {b} | {n} |" for (a, b), n in sorted(counts.items())]]
    lines += ["| level | kind | subject | message |\n|-|-|-|-|", *["| " + " | ".join(cell(r[c]) for c in ("level", "type", "subject", "message")) + " |" for r in rows]]
    return "\n\n".join(lines[:3]) + "\n" + "\n".join(lines[3 : 3 + len(counts)]) + "\n\n" + "\n".join(lines[3 + len(counts) :])


def layer_issues(pairs: DataFrame) -> DataFrame:
    a, b = table_layer(F.col("source")), table_layer(F.col("target"))
    bad = pairs.where(~layer_step_ok(a, b)).select("source", "target").distinct()
    return bad.select(F.lit("layer_rule").alias("type"), F.lit("error").alias("level"), F.concat("source", F.lit(" -> "), "target").alias("subject"), F.concat(a, F.lit(" may not feed "), b).alias("message"))


def cycle_issues(pairs: DataFrame) -> DataFrame:
    c = cycles(Graph.of_pairs(pairs.select("source", "target")))
    return c.select(F.lit("cycle").alias("type"), F.lit("error").alias("level"), F.col("component").alias("subject"), F.array_join("nodes", " -> ").alias("message"))


def end_issues(pairs: DataFrame, outside: DataFrame) -> DataFrame:
    """Tables nobody reads, and inputs nobody writes."""
    made, read = pairs.select(F.col("target").alias("name")).distinct(), pairs.select(F.col("source").alias("name")).distinct()
    layer = table_layer(F.col("name"))
    dangling = made.join(read, "name", "left_anti").where(~layer.isin(*END_LAYERS))
    alone = read.join(made, "name", "left_anti").join(outside, "name", "left_anti").where(~layer.isin(*START_LAYERS, "dim"))
    outer = read.join(made, "name", "left_anti").join(outside, "name", "left_semi")
    row = lambda df, kind, level, text: df.select(F.lit(kind).alias("type"), F.lit(level).alias("level"), F.col("name").alias("subject"), F.lit(text).alias("message"))
    return row(dangling, "dangling", "warning", "written, but nothing reads it").unionByName(row(alone, "orphan", "warning", "read, but nothing writes it")).unionByName(row(outer, "external", "info", "comes from outside"))


def metric_issues(spark: SparkSession, records: list[dict], store: Store) -> DataFrame:
    """Computed columns whose expression differs from the knowledge base's for the same table and name."""
    from ..functions.names import normalize

    rows = [(c["target_table"], c["target_column"], normalize(c["expression"])) for r in records for c in r["columns"]]
    x = spark.createDataFrame(rows, "table_name string, metric_name string, own string").distinct()
    m = store.table("metrics").select("table_name", "metric_name", "expression_normalized")
    squeeze = lambda c: F.regexp_replace(F.upper(c), r"\bT\d+\.|\s+", "")
    bad = x.join(m, ["table_name", "metric_name"]).where(squeeze("own") != squeeze("expression_normalized"))
    return bad.select(F.lit("kb_metric").alias("type"), F.lit("warning").alias("level"), F.concat_ws(".", "table_name", "metric_name").alias("subject"), F.concat(F.lit("knowledge base has "), "expression_normalized").alias("message"))


def diff_issues(pairs: DataFrame, store: Store) -> DataFrame:
    """Edges of the stages that the graph lacks, and edges of the graph into these targets that the stages lack."""
    own = pairs.select("source", "target").distinct()
    known = store.table("table_lineage").select(F.col("source_table").alias("source"), F.col("target_table").alias("target")).join(own.select("target").distinct(), "target", "left_semi").select("source", "target")
    row = lambda df, text: df.select(F.lit("graph_diff").alias("type"), F.lit("info").alias("level"), F.concat("source", F.lit(" -> "), "target").alias("subject"), F.lit(text).alias("message"))
    return row(own.exceptAll(known), "not in the graph").unionByName(row(known.exceptAll(own), "only in the graph"))
