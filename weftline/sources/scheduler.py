"""A scheduler's REST interface: reading projects, workflows and tasks into a snapshot, and writing definitions."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql import SparkSession

from ..operators.workflow import Snapshot


class SchedulerError(RuntimeError):
    """The scheduler answered with a code other than 0, or not at all."""


class Client:
    """Speaks to the scheduler's API below ``base``; ``opener`` is there for tests."""

    def __init__(self, base: str, user: str = "", password: str = "", token: str = "", page: int = 100, opener=None):
        self.base, self.page, self.session, self.token = base.rstrip("/"), page, None, token
        self.open = opener or (lambda req: urllib.request.urlopen(req, timeout=30).read())
        if user:
            self.login(user, password)

    def call(self, method: str, path: str, **params):
        data = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
        url = f"{self.base}/{path.lstrip('/')}" + (f"?{data}" if method == "GET" and data else "")
        req = urllib.request.Request(url, data.encode() if method != "GET" else None, method=method)
        if self.session:
            req.add_header("sessionId", self.session)
        if self.token:
            req.add_header("token", self.token)
        try:
            got = json.loads(self.open(req))
        except OSError as e:
            raise SchedulerError(str(e)) from e
        if got.get("code", 0) != 0:
            raise SchedulerError(f"{path}: {got.get('msg') or got['code']}")
        return got.get("data")

    def login(self, user: str, password: str) -> None:
        self.session = (self.call("POST", "login", userName=user, userPassword=password) or {}).get("sessionId")

    def paged(self, path: str, **params):
        n = 1
        while True:
            got = self.call("GET", path, pageNo=n, pageSize=self.page, **params) or {}
            rows = got.get("totalList") or []
            yield from rows
            if len(rows) < self.page or n * self.page >= int(got.get("total") or 0):
                return
            n += 1

    def projects(self) -> list[dict]:
        return list(self.paged("projects"))

    def workflows(self, project: int) -> list[dict]:
        return list(self.paged(f"projects/{project}/process-definition"))

    def workflow(self, project: int, code: int) -> dict:
        return self.call("GET", f"projects/{project}/process-definition/{code}")

    def create_workflow(self, project: int, definition: dict) -> dict:
        return self.call("POST", f"projects/{project}/process-definition", **definition)

    def delete_workflow(self, project: int, code: int):
        return self.call("DELETE", f"projects/{project}/process-definition/{code}")

    def create_project(self, name: str, description: str = "") -> dict:
        return self.call("POST", "projects", projectName=name, description=description)

    def delete_project(self, project: int):
        return self.call("DELETE", f"projects/{project}")

    def datasources(self) -> list[dict]:
        return list(self.paged("datasources"))

    def create_datasource(self, definition: dict) -> dict:
        """``definition`` as the scheduler asks for it: name, type, host, port, database, userName, password."""
        return self.call("POST", "datasources", **definition)

    def delete_datasource(self, datasource: int):
        return self.call("DELETE", f"datasources/{datasource}")

    def save_single_task(self, project: int, workflow: int, task: dict, upstream: list[int] = ()) -> dict:
        """Adds one task to a workflow, behind the tasks ``upstream``."""
        return self.call(
            "POST", f"projects/{project}/task-definition/save-single", processDefinitionCode=workflow,
            taskDefinitionJsonObj=json.dumps(task, ensure_ascii=False), upstreamCodes=",".join(map(str, upstream)) or None,
        )

    def task_codes(self, project: int, n: int) -> list[int]:
        return self.call("GET", f"projects/{project}/task-definition/gen-task-codes", genNum=n)

    def snapshot(self, spark: SparkSession, only: list[str] | None = None) -> Snapshot:
        ps, ws, ts, rs = [], [], [], []
        for p in self.projects():
            if only and p["name"] not in only:
                continue
            ps.append((p["code"], p["name"]))
            for w in self.workflows(p["code"]):
                ws.append((p["code"], w["code"], w["name"]))
                d = self.workflow(p["code"], w["code"]) or {}
                for t in d.get("taskDefinitionList") or []:
                    params = t.get("taskParams")
                    ts.append((w["code"], t["code"], t["name"], t.get("taskType"), params if isinstance(params, str) else json.dumps(params, ensure_ascii=False)))
                rs += [(w["code"], r["preTaskCode"], r["postTaskCode"]) for r in d.get("processTaskRelationList") or []]
        make = spark.createDataFrame
        return Snapshot(
            make(ps, "code long, name string"), make(ws, "project_code long, code long, name string"),
            make(ts, "workflow_code long, code long, name string, task_type string, task_params string"), make(rs, "workflow_code long, pre_task_code long, post_task_code long"),
        )
