"""Scheduler snapshots: projects, workflows, tasks and the tables they read and write.

A snapshot is four DataFrames, ``projects(code, name)``, ``workflows(project_code, code, name)``, ``tasks(workflow_code, code,
name, task_type, task_params)`` and ``relations(workflow_code, pre_task_code, post_task_code)``; names are never keys, so
equal names in two projects stay apart.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import local_frame
from .graph import Graph, _kept, cycles, depths, paths
from .scripts import parse_scripts

#: Task parameters that hold scripts, schemas whose tables may lie open at an end.
SCRIPT_KEYS = frozenset("sql rawscript script hivesql statement statements query".split())
LIST_KEYS = frozenset(("prestatements", "poststatements"))
OPEN_ENDS = ("ads", "app", "rpt", "report")
OPEN_STARTS = ("src", "ods", "dim", "ext", "stage")
MAX_VIA = 12
MAX_CHAIN = 40


@dataclass
class Snapshot:
    projects: DataFrame
    workflows: DataFrame
    tasks: DataFrame
    relations: DataFrame


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot saved as JSON lines, a folder for each table."""
    return Snapshot(*[spark.read.json(f"{path}/{n}") for n in ("projects", "workflows", "tasks", "relations")])


def scripts_of(params: str | dict, depth: int = 6) -> list[tuple[str, str]]:
    """(key, text) of the scripts in a task's parameters, however deep, each once."""
    found: dict[tuple[str, str], None] = {}

    def walk(x, left):
        if left < 0:
            return
        if isinstance(x, dict):
            for k, v in x.items():
                low = k.lower()
                if isinstance(v, str) and low in SCRIPT_KEYS and v.strip():
                    found.setdefault((low, v))
                elif low in LIST_KEYS and isinstance(v, list):
                    for s in v:
                        if isinstance(s, str) and s.strip():
                            found.setdefault((low, s))
                else:
                    walk(v, left - 1)
        elif isinstance(x, list):
            for v in x:
                walk(v, left - 1)

    walk(json.loads(params) if isinstance(params, str) and params.strip() else params or {}, depth)
    return list(found)


def references(params: str | dict) -> list[tuple[int, str]]:
    """(workflow code, kind) that a task names: sub-workflows and dependencies."""
    out: dict[tuple[int, str], None] = {}

    def walk(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if k == "processDefinitionCode" and str(v).isdigit():
                    out.setdefault((int(v), "sub_process"))
                elif k == "definitionCode" and str(v).isdigit():
                    out.setdefault((int(v), "dependent"))
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(json.loads(params) if isinstance(params, str) and params.strip() else params or {})
    return list(out)


def normalize_script(text: str) -> str:
    """Plain SQL out of a one-command script: shebang, comment lines and the client's quotes taken off."""
    s = "\n".join(x for x in (text or "").splitlines() if not x.lstrip().startswith("#")).strip()
    m = re.fullmatch(r"\s*(?:hive|beeline|spark-sql|impala-shell|mysql|psql)\b[^'\"]*?-{1,2}(?:e|q|c|execute|query|command)\s*(['\"])(.*)\1\s*;?\s*", s, re.S)
    if m:
        s = m.group(2).strip()
    elif len(s) > 1 and s[0] == s[-1] and s[0] in "'\"" and s.count(s[0]) == 2:
        s = s[1:-1].strip()
    return s


#: Scripts whose statements go to the parser together.
TOGETHER = 128


def task_tables(spark: SparkSession, tasks: DataFrame, task_types: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """((workflow_code, task_code, table, direction), errors, statement records) of the scripts of all tasks, or of tasks of
    some types (in any case).

    Parsing is the driver's; what is read are the tasks' parameters, one partition at a time.
    """
    if task_types is not None:
        tasks = tasks.where(F.upper("task_type").isin([x.upper() for x in task_types]))
    rows, errors, records = [], [], []
    own = (
        ((t.workflow_code, t.code), text, f"{t.workflow_code}/{t.code}/{key}", t.task_type)
        for t in tasks.select("workflow_code", "code", "task_type", "task_params").toLocalIterator() for key, text in scripts_of(t.task_params)
    )
    while some := list(islice(own, TOGETHER)):
        for (task, *_), got in zip(some, parse_scripts(spark, [x[1:] for x in some]), strict=True):
            errors += [(*task, e["error"]) for e in got["errors"]]
            records += got["statements"]
            rows += [(*task, x, "read") for x in got["input_tables"]] + [(*task, x, "write") for x in got["output_tables"]]
    return local_frame(spark, sorted(set(rows)), "workflow_code long, task_code long, table string, direction string"), local_frame(spark, errors, "workflow_code long, task_code long, error string"), records


def table_index(tt: DataFrame) -> DataFrame:
    """(table, producers, consumers, in_degree, out_degree) by task."""
    who = F.struct("workflow_code", "task_code")
    side = lambda d: F.array_sort(F.collect_set(F.when(F.col("direction") == d, who)))
    return tt.groupBy("table").agg(side("write").alias("producers"), side("read").alias("consumers")).withColumn("in_degree", F.size("producers")).withColumn("out_degree", F.size("consumers"))


def task_edges(tt: DataFrame) -> DataFrame:
    """(workflow_code, producer, consumer, via_tables) inside a workflow."""
    w = tt.where("direction = 'write'").select("workflow_code", F.col("task_code").alias("producer"), "table")
    r = tt.where("direction = 'read'").select("workflow_code", F.col("task_code").alias("consumer"), "table")
    return w.join(r, ["workflow_code", "table"]).where("producer <> consumer").groupBy("workflow_code", "producer", "consumer").agg(F.array_sort(F.collect_set("table")).alias("via_tables"))


def workflow_dependencies(tt: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """(source, target, kind, via_tables, n_tables): A writes what B reads and does not write itself; and what tasks name."""
    w = tt.where("direction = 'write'").select(F.col("workflow_code").alias("source"), "table").distinct()
    r = tt.where("direction = 'read'").select(F.col("workflow_code").alias("target"), "table").distinct()
    r = r.join(w.withColumnRenamed("source", "target"), ["target", "table"], "left_anti")
    by = w.join(r, "table").where("source <> target").groupBy("source", "target").agg(F.array_sort(F.collect_set("table")).alias("t"))
    out = by.select("source", "target", F.lit("table").alias("kind"), F.slice("t", 1, MAX_VIA).alias("via_tables"), F.size("t").alias("n_tables"))
    if native is not None:
        out = out.unionByName(native.select("source", "target", "kind", F.array().cast("array<string>").alias("via_tables"), F.lit(0).alias("n_tables")))
    return out


def native_dependencies(spark: SparkSession, tasks: DataFrame) -> DataFrame:
    """(source, target, kind): workflows named by tasks."""
    rows = {(code, t.workflow_code, kind) for t in tasks.select("workflow_code", "task_params").toLocalIterator() for code, kind in references(t.task_params) if code != t.workflow_code}
    return local_frame(spark, sorted(rows), "source long, target long, kind string")


def workflow_levels(workflows: DataFrame, deps: DataFrame) -> DataFrame:
    """(code, level): the longest chain of workflows before each."""
    g = Graph(workflows.select(F.col("code").cast("string").alias("name")), deps.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).distinct())
    return depths(g).select(F.col("name").cast("long").alias("code"), F.col("depth").alias("level"))


def quality(tt: DataFrame, known_metrics: DataFrame | None = None, g: Graph | None = None) -> DataFrame:
    """(issue, table, detail): dangling (written, never read), orphan (read, never written), cross_workflow (read in other
    workflows than those that write it; detail names both), written tables without a metric, and cycles (detail is the
    way around) of the graph ``g``."""
    w = tt.where("direction = 'write'").select("table").distinct()
    r = tt.where("direction = 'read'").select("table").distinct()
    schema = F.when(F.instr("table", ".") > 0, F.lower(F.regexp_extract("table", r"^([^.]*)\.", 1))).otherwise("")
    issue = lambda df, name, detail=None: df.select(F.lit(name).alias("issue"), "table", F.lit(detail).cast("string").alias("detail") if detail is None else detail.alias("detail"))
    out = issue(w.join(r, "table", "left_anti").where(~schema.isin(*OPEN_ENDS)), "dangling").unionByName(issue(r.join(w, "table", "left_anti").where(~schema.isin(*OPEN_STARTS)), "orphan"))
    if known_metrics is not None:
        out = out.unionByName(issue(w.join(known_metrics.select(F.col("table_name").alias("table")).distinct(), "table", "left_anti"), "missing_knowledge"))
    if g is not None:
        out = out.unionByName(issue(cycles(g).select(F.col("component").alias("table"), F.array_join("nodes", " -> ").alias("d")), "cycle", F.col("d")))
    return out


def cross_workflow(tt: DataFrame) -> DataFrame:
    """(table, writers, readers): tables that a workflow writes and another one, which does not write them, reads."""
    w = tt.where("direction = 'write'").select("table", F.col("workflow_code").alias("w")).distinct()
    r = tt.where("direction = 'read'").select("table", F.col("workflow_code").alias("r")).distinct()
    r = r.join(w.withColumnRenamed("w", "r"), ["table", "r"], "left_anti")
    side = lambda c: F.array_sort(F.collect_set(c))
    return w.groupBy("table").agg(side("w").alias("writers")).join(r.groupBy("table").agg(side("r").alias("readers")), "table")


def longest_chain(g: Graph, limit: int = MAX_CHAIN) -> list[str]:
    """The longest way through an acyclic graph; of equal ones the one that starts in a source layer, then by name."""
    if (pairs := g.pairs()) is not None:
        return _longest_small(g, [(a, b) for a, b in pairs if a != b], limit)
    e = _kept(g.edges.select("source", "target").where("source <> target").distinct())
    best = _kept(g.nodes.select("name", F.array("name").alias("path"), _start().alias("r")))
    for _ in range(limit - 1):
        new = best.join(e, best["name"] == e["source"]).where(~F.array_contains("path", F.col("target"))).select(F.col("target").alias("name"), F.concat("path", F.array("target")).alias("path"), "r")
        order = F.struct((-F.size("path")).alias("n"), "r", "path")
        nxt = _kept(best.unionByName(new).groupBy("name").agg(F.min(order).alias("b")).select("name", "b.path", "b.r"))
        if not nxt.join(best.select("name", F.col("path").alias("old")), "name").where("path <> old").limit(1).count():
            break
        best = nxt
    got = best.orderBy(F.desc(F.size("path")), "r", "path").first()
    return got.path if got else []


def _start():
    return F.when(F.col("layer").isin("src", "ods"), 0).when(F.col("layer") == "dim", 2).otherwise(1)


def _longest_small(g: Graph, pairs: list[tuple[str, str]], limit: int) -> list[str]:
    """The same for a small graph: rounds in which only nodes whose best way has just changed are followed."""
    near: dict[str, list[str]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    best = {r.name: (-1, r.r, (r.name,)) for r in g.nodes.select("name", _start().alias("r")).collect()}
    changed = set(best)
    for _ in range(limit - 1):
        found: dict[str, tuple] = {}
        for a in changed:
            n, r, path = best[a]
            for b in near.get(a, ()):
                if b not in path:
                    way = (n - 1, r, (*path, b))
                    if way < found.get(b, best[b]):
                        found[b] = way
        best |= found
        changed = set(found)
        if not changed:
            break
    return list(min(best.values())[2]) if best else []


def stitch(g: Graph, table: str, chain: list[str], most: int = 12) -> list[str]:
    """A chain with the longest way above its first table, dimension tables left out."""
    from ..functions.columns import table_layer

    up = paths(g, table, up=True).withColumn("layers", F.transform("path", table_layer))
    got = up.orderBy(F.desc(F.array_contains("layers", "src")), F.desc("hops"), "path").first()
    above = [t for t, lay in zip(got.path, got.layers, strict=True) if lay != "dim" and t != table][::-1] if got else []
    return [*above, *chain][-most:] if len(above) + len(chain) > most else [*above, *chain]


def scoped(snap: Snapshot, project: str | None = None, workflow: str | int | None = None) -> Snapshot:
    """The part of a snapshot in one project (by name) and of one workflow (by name or code)."""
    flows, projects = snap.workflows, snap.projects
    if project is not None:
        projects = projects.where(F.lower("name") == project.strip().lower())
        flows = flows.join(projects.select(F.col("code").alias("project_code")), "project_code", "left_semi").select(*flows.columns)
    if workflow is not None:
        flows = flows.where((F.col("code").cast("string") == str(workflow)) | (F.lower("name") == str(workflow).strip().lower()))
    own = flows.select(F.col("code").alias("workflow_code"))
    keep = lambda df: df.join(own, "workflow_code", "left_semi").select(*df.columns)
    return Snapshot(projects, flows, keep(snap.tasks), keep(snap.relations))


def analyze(spark: SparkSession, snap: Snapshot, metrics: DataFrame | None = None, project: str | None = None, workflow: str | int | None = None, task_types: list[str] | None = None) -> dict:
    """Tasks, merged edges, dependencies, longest chain, quality and counts of a snapshot or of the part of it that a
    project, a workflow and the tasks' types name. A name that fits no workflow raises ValueError with those there are."""
    from ..plans.lineage import edges_frame, statements_frame

    whole = snap
    if project is not None or workflow is not None:
        snap = scoped(snap, project, workflow)
        if not snap.workflows.limit(1).count():
            names = [r.name for r in whole.workflows.select("name").distinct().orderBy("name").limit(20).collect()]
            raise ValueError(f"no workflow {workflow or ''} in {project or 'any project'}; there are {', '.join(names)}")
    tt, errors, records = task_tables(spark, snap.tasks, task_types)
    g = Graph.of_pairs(edges_frame(statements_frame(spark, records)).select("source", "target"))
    deps = workflow_dependencies(tt, native_dependencies(spark, snap.tasks))
    n = tt.agg(F.count_distinct("table").alias("tables"), F.count_if(F.col("direction") == "read").alias("reads"), F.count_if(F.col("direction") == "write").alias("writes")).first()
    pairs = g.pairs()
    return {
        "task_tables": tt, "errors": errors, "records": records, "graph": g, "task_edges": task_edges(tt), "dependencies": deps, "levels": workflow_levels(snap.workflows, deps), "index": table_index(tt), "chain": longest_chain(g),
        "quality": quality(tt, metrics, g), "cross_workflow": cross_workflow(tt), "cycles": cycles(g).limit(5),
        "stats": {"projects": snap.projects.count(), "workflows": snap.workflows.count(), "tasks": snap.tasks.count(), "relations": snap.relations.count(), "tables": n.tables, "reads": n.reads, "writes": n.writes, "parse_errors": errors.count(), "edges": len(pairs) if pairs is not None else g.edges.count()},
    }


# ---- questions to a snapshot


def matching(names: DataFrame, name: str) -> DataFrame:
    """Rows of (code, name, ...) by code, by name in any case, else by the only name that holds the text."""
    low, key = F.lower("name"), name.strip().lower()
    rank = F.when(F.col("code").cast("string") == key, 0).when(low == key, 1).when(low.contains(key), 2)
    found = names.withColumn("rank", rank).where("rank is not null")
    best = found.agg(F.min("rank").alias("r"), F.count_if(F.col("rank") == 2).alias("n")).first()
    return found.where((F.col("rank") == F.lit(best.r)) & (F.lit(best.r) < 2) | F.lit(best.r == 2 and best.n == 1)).drop("rank")


def workflow_list(spark: SparkSession, snap: Snapshot) -> DataFrame:
    """(level, project, workflow, code, tasks, reads, writes, upstream, downstream) of all workflows; those in a cycle, and those
    behind it, come on the levels after it."""
    tt, _, _ = task_tables(spark, snap.tasks)
    deps = workflow_dependencies(tt, native_dependencies(spark, snap.tasks))
    level = workflow_levels(snap.workflows, deps)
    side = lambda d: tt.where(F.col("direction") == d).groupBy(F.col("workflow_code").alias("code")).agg(F.count_distinct("table").alias(f"{d}s"))
    ends = lambda a, b, n: deps.select(F.col(a).alias("code"), F.col(b).alias("o")).groupBy("code").agg(F.array_sort(F.collect_set("o")).alias(n))
    x = snap.workflows.select("code", F.col("name").alias("workflow"), "project_code").join(snap.projects.select(F.col("code").alias("project_code"), F.col("name").alias("project")), "project_code", "left")
    n = snap.tasks.groupBy(F.col("workflow_code").alias("code")).agg(F.count("*").alias("tasks"))
    for other in (level, n, side("read"), side("write"), ends("target", "source", "upstream"), ends("source", "target", "downstream")):
        x = x.join(other, "code", "left")
    none = F.array().cast("array<bigint>")
    return x.select("level", "project", "workflow", "code", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tasks", "reads", "writes")], *[F.coalesce(c, none).alias(c) for c in ("upstream", "downstream")]).orderBy("level", "project", "workflow", "code")


def workflow_detail(spark: SparkSession, snap: Snapshot, name: str, limit: int = 30) -> dict:
    """What each task of a workflow reads and writes, and the workflows before and behind it; candidates where no single
    workflow is meant."""
    one = matching(snap.workflows, name).collect()
    if len(one) != 1:
        return {"found": False, "candidates": [r.name for r in snap.workflows.where(F.lower("name").contains(name.strip().lower()) | F.lit(not one)).select("name").distinct().orderBy("name").limit(20).collect()]}
    code = one[0].code
    tt, errors, _ = task_tables(spark, snap.tasks)
    deps = workflow_dependencies(tt, native_dependencies(spark, snap.tasks))
    side = lambda d: F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("table")))).alias(f"{d}s")
    per = tt.where(F.col("workflow_code") == code).groupBy(F.col("task_code").alias("code")).agg(side("read"), side("write"))
    none = F.array().cast("array<string>")
    tasks = snap.tasks.where(F.col("workflow_code") == code).select("code", "name", "task_type").join(per, "code", "left").select("code", "name", "task_type", F.coalesce("reads", none).alias("reads"), F.coalesce("writes", none).alias("writes")).orderBy("code")
    near = lambda a, b: [r.asDict() for r in deps.where(F.col(a) == code).select(F.col(b).alias("workflow"), "kind", "via_tables").orderBy("workflow", "kind").collect()]
    return {
        "found": True, "workflow": one[0].name, "code": code, "tasks": [r.asDict() for r in tasks.limit(limit).collect()], "task_count": tasks.count(),
        "upstream": near("target", "source"), "downstream": near("source", "target"), "errors": [r.error for r in errors.where(F.col("workflow_code") == code).collect()],
    }


def table_tasks(spark: SparkSession, snap: Snapshot, table: str, limit: int = 20) -> dict:
    """The tasks that read and write a table, and the ways of tables that lead to it and away from it."""
    from ..plans.lineage import edges_frame, statements_frame
    from .graph import candidates, resolve

    tt, _, records = task_tables(spark, snap.tasks)
    g = Graph.of_pairs(edges_frame(statements_frame(spark, records)))
    name = resolve(g, table)
    if name is None:
        return {"found": False, "candidates": sorted(r.name for r in candidates(g, table).collect())}
    hits = [r.asDict() for r in tasks_of_table(snap, tt, name).orderBy("direction", "project", "workflow", "task").limit(limit).collect()]
    way = lambda up: [r.path for r in paths(g, name, up=up, max_paths=limit).collect()]
    return {"found": True, "table": name, "tasks": hits, "upstream_paths": way(True), "downstream_paths": way(False)}


def table_upstream(spark: SparkSession, snap: Snapshot, table: str, depth: int | None = None) -> dict:
    """All tables above one, by level, with the tasks that write each."""
    from ..plans.lineage import edges_frame, statements_frame
    from .graph import candidates, resolve

    tt, _, records = task_tables(spark, snap.tasks)
    g = Graph.of_pairs(edges_frame(statements_frame(spark, records)))
    name = resolve(g, table)
    if name is None:
        return {"found": False, "candidates": sorted(r.name for r in candidates(g, table).collect())}
    return {"found": True, "table": name, "upstream": [r.asDict() for r in annotated(g, tt, name, True, depth).orderBy("level", "name").collect()]}


def tasks_of_table(snap: Snapshot, tt: DataFrame, table: str) -> DataFrame:
    """(project, workflow, task, direction) of the tasks that read or write a table; the name may lack its schema."""
    low, key = F.lower("table"), table.strip().lower()
    hit = tt.where((low == key) | (low.endswith("." + key) if "." not in key else F.lit(False)))
    names = snap.tasks.select(F.col("workflow_code"), F.col("code").alias("task_code"), F.col("name").alias("task"), "task_type")
    flows = snap.workflows.select(F.col("code").alias("workflow_code"), F.col("name").alias("workflow"), F.col("project_code"))
    return hit.join(names, ["workflow_code", "task_code"]).join(flows, "workflow_code").join(snap.projects.select(F.col("code").alias("project_code"), F.col("name").alias("project")), "project_code").select("project", "workflow", "task", "task_type", "table", "direction")


def annotated(g: Graph, tt: DataFrame, table: str, up: bool = True, depth: int | None = None) -> DataFrame:
    """(name, level, tasks) of what lies up- or downstream, with the tasks that write each table."""
    made = tt.where("direction = 'write'").groupBy(F.col("table").alias("name")).agg(F.array_sort(F.collect_set("task_code")).alias("tasks"))
    from .graph import levels

    return levels(g, table, up, depth).join(made, "name", "left").withColumn("tasks", F.coalesce("tasks", F.array().cast("array<bigint>")))


def project_detail(snap: Snapshot, tt: DataFrame, project: str) -> DataFrame:
    """(workflow, tasks, written) of a project's workflows."""
    own = snap.projects.where(F.lower("name") == project.strip().lower()).select(F.col("code").alias("project_code"))
    flows = snap.workflows.join(own, "project_code", "left_semi").select(F.col("code").alias("workflow_code"), F.col("name").alias("workflow"))
    n = snap.tasks.groupBy("workflow_code").agg(F.count("*").alias("tasks"))
    w = tt.where("direction = 'write'").groupBy("workflow_code").agg(F.array_sort(F.collect_set("table")).alias("written"))
    out = flows.join(n, "workflow_code", "left").join(w, "workflow_code", "left")
    return out.select("workflow", F.coalesce("tasks", F.lit(0)).alias("tasks"), F.coalesce("written", F.array().cast("array<string>")).alias("written"))


def expand(spark: SparkSession, snap: Snapshot, workflow_code: int, depth: int = 3) -> list[tuple[int, int]]:
    """(workflow, level) of a workflow and the sub-workflows its tasks start, each once."""
    found, front = {workflow_code: 0}, [workflow_code]
    for level in range(1, depth + 1):
        rows = snap.tasks.where(F.col("workflow_code").isin(front)).select("task_params").collect()  # one workflow's tasks
        front = sorted({code for r in rows for code, kind in references(r.task_params) if kind == "sub_process" and code not in found})
        if not front:
            break
        found |= dict.fromkeys(front, level)
    return sorted(found.items(), key=lambda x: (x[1], x[0]))


def attribute_metrics(tt: DataFrame, metrics: DataFrame) -> DataFrame:
    """(workflow_code, task_code, n_metrics): metrics known of the tables a task writes."""
    m = metrics.groupBy(F.lower("table_name").alias("t")).agg(F.count("*").alias("n"))
    x = tt.where("direction = 'write'").withColumn("t", F.lower("table")).join(m, "t", "left")
    return x.groupBy("workflow_code", "task_code").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_metrics"))


def table_dependencies(tt: DataFrame) -> DataFrame:
    """(workflow_code, table): tables a workflow both writes and reads."""
    w = tt.where("direction = 'write'").select("workflow_code", "table").distinct()
    return w.join(tt.where("direction = 'read'").select("workflow_code", "table").distinct(), ["workflow_code", "table"])
