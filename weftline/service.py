"""HTTP service: the operators behind POST routes, one Spark session for all requests."""

from __future__ import annotations

import json
import traceback
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from .operators import generate, graph, search, workflow
from .operators.kb import Store
from .plans.lineage import ParseError, aggregate, parse_sql
from .sources import render

MAX_COLUMNS = 200
#: A page that sends a route and its JSON and shows the answer.
APP = """<!doctype html><meta charset="utf-8"><title>weftline</title><style>body{font-family:sans-serif;max-width:60em;margin:2em auto}textarea{width:100%;height:10em}pre{background:#f4f4f4;padding:1em;overflow:auto}</style>
<h1>weftline</h1><select id="r"><option>parse<option>analyze<option>impact<option>upstream<option>kb/search<option>kb/ask<option>generate/sql<option>generate/pipeline</select>
<textarea id="t">{"sql": "INSERT INTO dws.a SELECT x FROM dwd.b"}</textarea><button id="b">send</button><pre id="o"></pre>
<script>document.getElementById("b").onclick=async()=>{const a=await fetch("/"+document.getElementById("r").value,{method:"POST",body:document.getElementById("t").value});
document.getElementById("o").textContent=JSON.stringify(await a.json(),null,2)}</script>"""


class Service:
    """``handle(route, payload)`` is the whole service; HTTP only carries it. A failure has success false and an error."""

    def __init__(self, spark: SparkSession, kb: str | None = None, graph_path: str | None = None, reports: str = "reports"):
        self.spark, self.store, self.graph_path, self.reports = spark, Store(spark, kb) if kb else None, graph_path, reports
        self.routes = {
            "parse": self.parse, "analyze": self.analyze, "analyze-workflow": self.analyze_workflow, "report": self.report, "impact": lambda p: self.reach(p, False), "upstream": lambda p: self.reach(p, True),
            "kb/summary": lambda p: {"summary": self._kb().summary()}, "kb/metric": lambda p: {"rows": self._rows(self._kb().get_metric(p["name"]))}, "kb/search": self.kb_search, "kb/ask": lambda p: search.answer(self._kb(), p.get("question", "")),
            "generate/sql": self.gen_sql, "generate/pipeline": lambda p: generate.pipeline(self._kb(), p.get("request", ""), int(p.get("max_stages", 6)), p.get("target"), p.get("target_layer")), "generate/apply": lambda p: generate.apply_plan(p["stages"], p.get("name", "pipeline")), "generate/validate": self.gen_validate,
            "health": lambda p: {"status": "ok"}, "reports": lambda p: {"reports": render.list_reports(self.reports)},
        }

    def handle(self, route: str, payload: dict) -> tuple[int, dict]:
        f = self.routes.get(route.strip("/"))
        if f is None:
            return 404, {"success": False, "error": f"no such route: {route}"}
        try:
            return 200, {"success": True} | f(payload)
        except (ParseError, ValueError, KeyError, LookupError) as e:
            return 200, {"success": False, "error": str(e)}
        except Exception as e:
            return 500, {"success": False, "error": str(e), "trace": traceback.format_exc()}

    def _kb(self) -> Store:
        if self.store is None:
            raise ValueError("no knowledge base")
        return self.store

    @staticmethod
    def _rows(df) -> list[dict]:
        return [r.asDict(True) for r in df.collect()]

    def parse(self, p: dict) -> dict:
        records = parse_sql(self.spark, p["sql"], p.get("source", "<http>"), bool(p.get("extended")))
        a = aggregate(records)
        return {"statements": [{k: v for k, v in r.items() if k != "columns"} for r in records], "input_tables": a["input_tables"], "output_tables": a["output_tables"], "table_lineage": [{"source": s, "target": t} for s, t in a["table_lineage"]], "column_lineage": a["column_lineage"][:MAX_COLUMNS], "columns_truncated": len(a["column_lineage"]) > MAX_COLUMNS}

    def analyze(self, p: dict) -> dict:
        records = parse_sql(self.spark, p["sql"], p.get("source", "<http>"))
        out = self.parse(p)
        if self.store is not None:
            out["knowledge"] = {k: self._rows(v) for k, v in search.match(self.store, records).items()}
        if p.get("report", True):
            out["report"] = render.save_report(render.report(records, p.get("title", "SQL"), out.get("knowledge", {}).get("metrics", [])), self.reports)
        return out

    def report(self, p: dict) -> dict:
        if p.get("id"):
            return {"html": render.load_report(p["id"], self.reports)}
        return {"report": self.analyze(p | {"report": True})["report"]}

    def analyze_workflow(self, p: dict) -> dict:
        got = workflow.analyze(self.spark, workflow.read_snapshot(self.spark, p["snapshot"]), self.store.table("metrics") if self.store else None, p.get("project"), p.get("workflow"), p.get("task_types"))
        page = {"report": render.save_report(render.workflow_report(got, p.get("title", "Workflows")), self.reports)} if p.get("report") else {}
        return page | {"cross_workflow": self._rows(got["cross_workflow"]), "stats": got["stats"], "chain": got["chain"], "quality": self._rows(got["quality"]), "dependencies": self._rows(got["dependencies"]), "task_edges": self._rows(got["task_edges"])}

    def reach(self, p: dict, up: bool) -> dict:
        path = p.get("graph") or self.graph_path
        g = graph.load(self.spark, path) if path else self._kb().graph()
        return graph.impact(g, p["table"], up, p.get("depth"))

    def kb_search(self, p: dict) -> dict:
        kinds = tuple(p.get("kinds") or search.KINDS)
        return {"rows": self._rows(search.search(self._kb(), p["query"], kinds, int(p.get("limit", 10))).orderBy("kind", "rank"))}

    def gen_sql(self, p: dict) -> dict:
        g = generate.generate_sql(self._kb(), p["target"], p["sources"], p.get("metrics", []), p.get("group_by", []), p.get("partition"), p.get("where", []), p.get("joins", []), bool(p.get("all_columns")))
        return {"sql": g.sql, "warnings": g.warnings, "columns": [c.__dict__ for c in g.columns]}

    def gen_validate(self, p: dict) -> dict:
        ok, issues = generate.validate(self.spark, p["stages"], self.store)
        return {"passed": ok, "issues": self._rows(issues.orderBy("level", "type", "subject"))}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _page(self, text: str) -> None:
            raw = text.encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            u = urlparse(self.path)
            if u.path.rstrip("/") == "/app":
                return self._page(APP)
            payload = {k: v[0] for k, v in parse_qs(u.query).items()}
            if u.path.startswith("/report/"):
                return self._send(*service.handle("report", payload | {"id": u.path.split("/")[-1]}))
            return self._send(*service.handle(u.path, payload))

        def do_POST(self):
            try:
                payload = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self._send(400, {"success": False, "error": "the body is not JSON"})
            return self._send(*service.handle(urlparse(self.path).path, payload))

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
