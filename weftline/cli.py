"""python -m weftline.cli COMMAND ...; exit 0: done, 1: found problems, 2: wrong use."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args, **kw):
        s = sub.add_parser(name, **kw)
        for a in args:
            s.add_argument(*a[0], **a[1])
        return s

    arg = lambda *n, **k: (n, k)
    add("parse", arg("files", nargs="+"), arg("--json", action="store_true"), arg("--extended", action="store_true"))
    add("scan", arg("root"), arg("--ignore-dir", action="append"), arg("--max-files", type=int), arg("--graph-out"))
    for n in ("upstream", "impact"):
        add(n, arg("graph"), arg("table"), arg("--depth", type=int), arg("--max-paths", type=int, default=50))
    add("path", arg("graph"), arg("source"), arg("target"), arg("--max-paths", type=int, default=10), arg("--max-length", type=int, default=12))
    add("cycle", arg("graph"))
    add("stats", arg("graph"))
    add("viz", arg("graph"), arg("--highlight"), arg("--direction", default="LR"), arg("--depth", type=int), arg("--group-layers", action="store_true"), arg("--html", action="store_true"))
    add("parse-script", arg("file"), arg("--kind"), arg("--task-type"), arg("--resolve-files", action="store_true"))
    add("kb-build", arg("store"), arg("roots", nargs="+"), arg("--glossary"), arg("--incremental", action="store_true"))
    add("kb-summary", arg("store"))
    add("kb-search", arg("store"), arg("query"), arg("--kind", action="append"), arg("--limit", type=int, default=10))
    add("kb-ask", arg("store"), arg("question"))
    add("kb-show", arg("store"), arg("metric"))
    for n in ("kb-terms", "kb-fields"):
        add(n, arg("store"), arg("--table"), arg("--limit", type=int, default=50))
    add("kb-export", arg("store"), arg("--markdown", action="store_true"))
    add("ds-sync", arg("base"), arg("out"), arg("--user", default=""), arg("--password", default=""), arg("--project", action="append"))
    add("ds-analyze", arg("snapshot"), arg("--project"), arg("--workflow"), arg("--task-type", action="append"))
    add("ds-workflows", arg("snapshot"))
    add("ds-tables", arg("snapshot"), arg("table"), arg("--limit", type=int, default=20))
    add("ds-task", arg("snapshot"), arg("workflow"), arg("--limit", type=int, default=30))
    add("ds-upstream", arg("snapshot"), arg("table"), arg("--depth", type=int))
    add("generate-sql", arg("store"), arg("target"), arg("--source", action="append", required=True), arg("--metric", action="append", default=[]), arg("--group-by", action="append", default=[]),
        arg("--join", action="append", default=[], help="table:condition"), arg("--all-columns", action="store_true"))
    add("generate-pipeline", arg("store"), arg("request"), arg("--max-stages", type=int, default=6), arg("--validate", action="store_true"), arg("--target"), arg("--target-layer"), arg("--out"))
    add("generate-apply", arg("plan"), arg("workflow"), arg("--base"), arg("--user", default=""), arg("--password", default=""), arg("--project", type=int))
    add("generate-validate", arg("files", nargs="+"), arg("--store"), arg("--report"))
    add("serve", arg("--kb"), arg("--graph"), arg("--port", type=int, default=8080))
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("weftline").getOrCreate()
    from .operators import generate, graph, search, workflow
    from .operators.kb import Store, build_from_scan
    from .operators.scripts import parse_script
    from .plans.lineage import ParseError, parse_sql, summary_text
    from .sources import files, render, scheduler

    def show(x):
        print(json.dumps(x, ensure_ascii=False, indent=2, default=str))

    rows = lambda df: [r.asDict(True) for r in df.collect()]
    c = a.command
    try:
        if c == "parse":
            for f in a.files:
                text = sys.stdin.read() if f == "-" else open(f, encoding="utf-8", errors="replace").read()
                got = parse_sql(spark, text, f, a.extended)
                show(got) if a.json else print(summary_text(got))
        elif c == "scan":
            s = files.scan(spark, a.root, a.ignore_dir, a.max_files)
            if a.graph_out:
                graph.save(s.graph(), a.graph_out)
            show(s.summary() | {"failures": s.failures})
            return int(bool(s.failures))
        elif c in ("upstream", "impact"):
            got = graph.impact(graph.load(spark, a.graph), a.table, c == "upstream", a.depth, a.max_paths)
            show(got)
            return int(not got["found"])
        elif c == "path":
            show(rows(graph.paths_between(graph.load(spark, a.graph), a.source, a.target, a.max_paths, a.max_length)))
        elif c == "cycle":
            got = rows(graph.cycles(graph.load(spark, a.graph)))
            show(got)
            return int(bool(got))
        elif c == "stats":
            show(graph.stats(graph.load(spark, a.graph)))
        elif c == "viz":
            g = graph.load(spark, a.graph)
            print(render.graph_page([(r.source, r.target) for r in g.edges.select("source", "target").collect()]) if a.html else graph.mermaid(g, a.highlight, a.direction, a.depth, a.group_layers))
        elif c == "parse-script":
            import os

            def beside(name):
                path = os.path.join(os.path.dirname(os.path.abspath(a.file)), name)
                return open(path, encoding="utf-8").read() if os.path.isfile(path) else None

            got = parse_script(spark, open(a.file, encoding="utf-8", errors="replace").read(), a.file, a.kind, a.task_type, beside if a.resolve_files else None)
            show({k: v for k, v in got.items() if k != "statements"} | {"sqls": [e.__dict__ for e in got["sqls"]]})
            return int(bool(got["errors"]))
        elif c == "kb-build":
            from .functions.names import Glossary

            gloss = Glossary.load(open(a.glossary, encoding="utf-8").read()) if a.glossary else None
            store = Store(spark, a.store)
            for i, root in enumerate(a.roots):
                s = files.scan(spark, root)
                tables = build_from_scan(s, gloss)
                store.upsert(tables, list(s.texts)) if a.incremental or i else store.rebuild(tables)
            show(store.counts())
        elif c == "kb-summary":
            show(Store(spark, a.store).summary())
        elif c == "kb-search":
            show(rows(search.search(Store(spark, a.store), a.query, tuple(a.kind or search.KINDS), a.limit).orderBy("kind", "rank")))
        elif c == "kb-ask":
            print(search.answer(Store(spark, a.store), a.question)["answer"])
        elif c == "kb-show":
            show(rows(Store(spark, a.store).get_metric(a.metric)))
        elif c in ("kb-terms", "kb-fields"):
            df = Store(spark, a.store).table(c[3:])
            if a.table:
                from pyspark.sql import functions as F

                df = df.where(F.array_contains("tables", a.table) if c == "kb-terms" else F.col("table_name") == a.table)
            show(rows(df.orderBy(*(["term"] if c == "kb-terms" else ["table_name", "column_name"])).limit(a.limit)))
        elif c == "kb-export":
            store = Store(spark, a.store)
            print(render.kb_markdown(store)) if a.markdown else show(store.export_json())
        elif c == "ds-sync":
            snap = scheduler.Client(a.base, a.user, a.password).snapshot(spark, a.project)
            for n in ("projects", "workflows", "tasks", "relations"):
                getattr(snap, n).write.mode("overwrite").json(f"{a.out}/{n}")
        elif c == "ds-analyze":
            got = workflow.analyze(spark, workflow.read_snapshot(spark, a.snapshot), project=a.project, workflow=a.workflow, task_types=a.task_type)
            show({"stats": got["stats"], "chain": got["chain"], "quality": rows(got["quality"]), "cross_workflow": rows(got["cross_workflow"])})
        elif c == "ds-workflows":
            got = rows(workflow.workflow_list(spark, workflow.read_snapshot(spark, a.snapshot)))
            show(got)
            return int(not got)
        elif c == "ds-tables":
            got = workflow.table_tasks(spark, workflow.read_snapshot(spark, a.snapshot), a.table, a.limit)
            show(got)
            return int(not got["found"])
        elif c == "ds-task":
            got = workflow.workflow_detail(spark, workflow.read_snapshot(spark, a.snapshot), a.workflow, a.limit)
            show(got)
            return int(not got["found"])
        elif c == "ds-upstream":
            got = workflow.table_upstream(spark, workflow.read_snapshot(spark, a.snapshot), a.table, a.depth)
            show(got)
            return int(not got["found"])
        elif c == "generate-sql":
            joins = [dict(zip(("table", "on"), j.split(":", 1), strict=True)) for j in a.join]
            g = generate.generate_sql(Store(spark, a.store), a.target, a.source, a.metric, a.group_by, joins=joins, all_columns=a.all_columns)
            print(g.sql)
            for w in g.warnings:
                print("warning:", w, file=sys.stderr)
        elif c == "generate-pipeline":
            store = Store(spark, a.store)
            got = generate.pipeline(store, a.request, a.max_stages, a.target, a.target_layer)
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    json.dump(got, f, ensure_ascii=False)
            show(got)
            if a.validate:
                ok, issues = generate.validate(spark, got["stages"], store)
                show(rows(issues))
                return int(not ok)
            return int(not got["found"])
        elif c == "generate-apply":
            with open(a.plan, encoding="utf-8") as f:
                stages = json.load(f)["stages"]
            client = scheduler.Client(a.base, a.user, a.password) if a.base else None
            show(generate.apply_plan(stages, a.workflow, client=client, project=a.project))
        elif c == "generate-validate":
            stages = [x for f in a.files for x in generate.stages_of(open(f, encoding="utf-8", errors="replace").read(), f)]
            ok, issues = generate.validate(spark, stages, Store(spark, a.store) if a.store else None)
            page = generate.issues_markdown(ok, issues)
            if a.report:
                with open(a.report, "w", encoding="utf-8") as f:
                    f.write(page)
            print(page)
            return int(not ok)
        elif c == "serve":
            from .service import Service, serve

            serve(Service(spark, a.kb, a.graph), port=a.port).serve_forever()
    except (ParseError, ValueError, OSError, scheduler.SchedulerError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
