import json
import threading
import urllib.request

import pytest

from weftline import cli
from weftline.functions.names import Glossary, localize, normalize, split_comment_unit, strip_aggregates
from weftline.operators import generate, graph, scripts, search, workflow
from weftline.operators.kb import Store, build_from_scan
from weftline.queries import GLOSSARY, ROOT, fixture_files, fixture_scan, snapshot
from weftline.service import Service, serve
from weftline.sources import files, render, scheduler


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("kb") / "kb"))
    s.rebuild(build_from_scan(fixture_scan(spark), GLOSSARY))
    return s


def test_both_normalisers_agree(spark):
    from pyspark.sql import functions as F

    from weftline.functions.columns import normalize_expression

    some = ["a.b.c + d . e AS total", "SUM( t.x )/COUNT(t.y);", "`表`.`列` * 2", "产.量*(1-税.率)", "x<>'a.b' AND y>=3", "f(a,b ,c)", "", "a.`b c`", "1.5*t1.q", "CASE WHEN t.a>1 THEN 'x.y' END as `n`", "$x.y"]
    got = spark.createDataFrame([(x,) for x in some], "e string").select(normalize_expression(F.col("e")).alias("n")).collect()
    assert [r.n for r in got] == [normalize(x) for x in some]


# ---- scripts


def sqls(text, **kw):
    return [(e.sql, e.resolved) for e in scripts.extract(text, **kw).entries]


def test_kinds_of_scripts():
    d = scripts.detect_kind
    assert d("hive -e 'select 1 from t'") == "shell" and d("import os\nspark.sql('x')") == "python" and d("SELECT a FROM t") == "sql" and d("", "PYSPARK") == "python" and d("hello") == "unknown"
    assert d("SELECT a FROM t", "SHELL") == "sql"


def test_shell():
    assert sqls('hive -e "SELECT a FROM t; SELECT b FROM u"') == [("SELECT a FROM t; SELECT b FROM u", True)]
    assert sqls("spark-sql --conf x=y -e 'INSERT INTO a SELECT 1'") == [("INSERT INTO a SELECT 1", True)]
    assert sqls("Q='SELECT a FROM t'\nhive -e \"${Q}\"") == [("SELECT a FROM t", True)]
    assert sqls("hive <<-EOF\n\tSELECT a FROM t\n\tEOF\n") == [("SELECT a FROM t", True)]
    assert scripts.extract("hive <<EOF\nSELECT a").hints and not sqls("# hive -e 'SELECT a FROM t'\necho 'SELECT a FROM t'")
    assert scripts.extract('hive -e "$NOPE"').hints and sqls("beeline -f a.sql") == [(None, False)]
    assert [e.sql for e in scripts.extract_shell("beeline -f a.sql", lambda n: "SELECT 1 FROM t").entries] == ["SELECT 1 FROM t"]
    assert sqls("export S='INSERT INTO a SELECT x FROM b'\nexport Y=2\necho done") == [("INSERT INTO a SELECT x FROM b", True)]


def test_python():
    t = 'import x\n"""SELECT doc FROM nowhere"""\nq = """INSERT INTO a SELECT x FROM b"""\nspark.sql(q)\nspark.sql(f"SELECT {c} FROM t WHERE d = \'{{x}}\'")\npd.read_sql_query("SELECT r FROM s", con)\n# spark.sql("SELECT no FROM no")\nspark.sql(what)\nz = "SELECT w FROM v"\n'
    got = scripts.extract(t)
    assert sorted(e.sql for e in got.entries) == ["INSERT INTO a SELECT x FROM b", "SELECT 0 FROM t WHERE d = '{x}'", "SELECT r FROM s", "SELECT w FROM v"]
    assert [e.placeholders for e in got.entries if e.placeholders] == [["c"]] and len(got.hints) == 1


def test_parse_script(spark):
    r = scripts.parse_script(spark, dict(fixture_files("scripts"))["load.sh"])
    assert [(x["source"], x["target"]) for x in r["table_lineage"]] == [("dwd.dwd_a", "dws.dws_a"), ("ods.a", "dwd.dwd_a"), ("src.a", "ods.a")] and r["unresolved_hints"]
    r = scripts.parse_script(spark, "hive -e 'SELECT (a FROM'\nhive -e 'INSERT INTO a SELECT x FROM b'")
    assert len(r["errors"]) == 1 and r["output_tables"] == ["a"]


def test_table_function(spark):
    from weftline.functions.udtf import register

    register(spark)
    assert [r.sql for r in spark.sql("SELECT * FROM extract_sqls('hive -e \"SELECT a FROM t\"', 'SHELL')").collect()] == ["SELECT a FROM t"]


# ---- files


def test_scan(spark, tmp_path):
    for name, text in fixture_files():
        p = tmp_path / "w" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    for skip in ("build", ".hidden", "Node_Modules"):
        (tmp_path / "w" / skip).mkdir()
        (tmp_path / "w" / skip / "x.sql").write_text("SELECT 1")
    (tmp_path / "w" / "zz_empty.sql").write_text("-- nothing")
    (tmp_path / "w" / "zz_bytes.sql").write_bytes(b"SELECT '\xff' AS a FROM t")
    s = files.scan(spark, str(tmp_path / "w"))
    assert (s.files, len(s.failures), s.empty, len(s.several)) == (12, 1, ["zz_empty.sql"], 2)
    assert s.failures[0]["file"] == "issues/02_broken.sql" and s.summary()["tables_in_cycles"] == 2
    assert files.scan(spark, str(tmp_path / "w"), max_files=2).files == 2


# ---- names and knowledge


def test_names():
    assert split_comment_unit("产量（箱）") == ("产量", "箱") and split_comment_unit("折条（箱转条）") == ("折条（箱转条）", None) and split_comment_unit("待确认") == (None, None)
    assert normalize("SUM(t.a) +SUM( b.c ) AS x;") == "SUM(a) + SUM(c)"
    assert strip_aggregates("SUM(a) + SUM(b) - SUM(c)") == "a + b - c" and strip_aggregates("SUM(a) / COUNT(1)") == "SUM(a) / COUNT(1)"
    assert localize("SUM(a) + 'a' + nvl(b, 0)", {"a": "甲", "b": "乙"}) == "SUM(甲) + 'a' + nvl(乙, 0)"
    g = Glossary(columns={"qty": "数量"}, tokens={"cust": "客户", "amt": "金额"})
    assert [g.resolve(*x) for x in (("qty", None), ("cust_amt", None), ("cust_zz", None), ("zz", None), ("qty", "总数量"), ("qty", "别的"))] == [("数量", "exact_glossary"), ("客户金额", "rule"), ("客户", "rule_partial"), (None, "pending"), ("总数量", "comment"), ("数量", "exact_glossary")]


def test_golden_formula(spark, tmp_path):
    sql = """INSERT INTO cdw.dwd_code SELECT batch_no, -- 批次
 SUM(dama_qty) + SUM(tiaoma_qty) - SUM(chongma_qty) AS chanliang_qty -- 产量（箱）
 FROM ods.ods_flow GROUP BY batch_no"""
    g = Glossary(columns={"dama_qty": "打码量", "tiaoma_qty": "跳码量", "chongma_qty": "重码量"})
    m = build_from_scan(files.scan_texts(spark, [("demo.sql", sql)]), g)["metrics"].collect()
    assert len(m) == 1 and m[0].formula == "产量 = 打码量 + 跳码量 - 重码量" and m[0].formula_full == "产量 = SUM(打码量) + SUM(跳码量) - SUM(重码量)"
    assert (m[0].metric_type, m[0].aggregate_func, m[0].layer, m[0].unit) == ("聚合", "SUM", "dwd", "箱") and [d.column for d in m[0].depends_on] == ["dama_qty", "tiaoma_qty", "chongma_qty"]


def test_store(spark, store, tmp_path):
    before = store.fingerprint()
    tables = build_from_scan(fixture_scan(spark), GLOSSARY)
    store.rebuild(tables)
    assert store.fingerprint() == before
    other = Store(spark, str(tmp_path / "inc"))
    texts = fixture_files()
    half = files.scan_texts(spark, texts[:4])
    other.upsert(build_from_scan(half, GLOSSARY), list(half.texts))
    whole = fixture_scan(spark)
    other.upsert(build_from_scan(whole, GLOSSARY), list(whole.texts))
    assert other.fingerprint() == before
    gone = files.scan_texts(spark, [("06_dws_cust.sql", "SELECT 1 AS a FROM ods.customer")])
    other.upsert(build_from_scan(gone, GLOSSARY), ["06_dws_cust.sql"])
    assert other.table("metrics").where("table_name = 'dws.dws_cust'").count() == 0 and other.table("table_lineage").where("target_table = 'dws.dws_cust'").count() == 0


def test_lookups(store):
    assert [r.metric_name for r in store.get_metric("净额").collect()] == ["net_amt"] and store.get_metric("amt").count() == 3
    assert store.get_table("order_line").first().table_name == "dwd.dwd_order_line"
    assert store.summary()["top_tables"][0] == ("dws.dws_nation_day", 4) and set(store.export_json()) >= {"metrics", "fingerprint"}
    assert "## 9 Limits" in render.kb_markdown(store)


def test_search_and_questions(spark, store):
    top = search.search(store, "净额").where("rank = 1 and kind = 'metrics'").first()
    assert (top.name, top.score) == ("net_amt", 130.0)
    assert search.search(store, "净额", min_score=200).count() == 0
    ask = lambda q: search.answer(store, q)
    assert ask("净额怎么算")["intent"] == "metric_formula" and "原价 * " in ask("净额怎么算")["answer"]
    assert ask("有哪些指标")["intent"] == "list_metrics" and ask("")["intent"] == "empty"
    assert "ads.ads_board" in ask("dws_cust 下游")["answer"] and "ods.customer" in ask("dws_cust 上游")["answer"]
    assert "数量" in ask("dwd_order_line 有哪些字段")["answer"]
    assert ask("哪些表用到净额")["answer"].count("dwd.dwd_order_line") == 1
    got = search.match(store, [r for r in fixture_scan(spark).records if r["source"].startswith("05")])
    assert got["metrics"].first().table_name == "dws.dws_nation_day" and got["rules"].count() > 0


# ---- workflows


def test_task_scripts():
    assert workflow.scripts_of({"rawScript": "a", "x": {"preStatements": ["b", "b"], "sql": "c"}}) == [("rawscript", "a"), ("prestatements", "b"), ("sql", "c")]
    assert workflow.references({"a": [{"definitionCode": 3}], "processDefinitionCode": "4"}) == [(3, "dependent"), (4, "sub_process")]
    assert workflow.normalize_script("#!/bin/bash\nhive -e \"SELECT 1\"") == "SELECT 1" == workflow.normalize_script("SELECT 1")


def test_analysis(spark):
    x = workflow.analyze(spark, snapshot(spark))
    assert x["chain"] == ["src.a", "ods.a", "dwd.b", "dws.d", "ads.e"] and x["stats"]["parse_errors"] == 0 and x["stats"]["tasks"] == 5
    assert workflow.stitch(x["graph"], "dwd.b", ["dwd.b", "dws.d"]) == ["src.a", "ods.a", "dwd.b", "dws.d"]


def test_sub_workflows(spark):
    import dataclasses

    rows = [(1, 1, "a", "SUB_PROCESS", '{"processDefinitionCode": 2}'), (2, 2, "b", "SUB_PROCESS", '{"processDefinitionCode": 3}'), (3, 3, "c", "SUB_PROCESS", '{"processDefinitionCode": 1}')]
    snap = dataclasses.replace(snapshot(spark), tasks=spark.createDataFrame(rows, "workflow_code long, code long, name string, task_type string, task_params string"))
    assert workflow.expand(spark, snap, 1) == [(1, 0), (2, 1), (3, 2)] and workflow.expand(spark, snap, 1, 1) == [(1, 0), (2, 1)]


def test_texts(spark):
    g = graph.Graph.of_pairs(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source string, target string"))
    assert "a: 2 tables in 2 levels" in graph.impact_text(graph.impact(g, "a")) and graph.impact_text(graph.impact(g, "q")) == "no such table"
    assert graph.cycles_text(graph.cycles(g).collect()) == "a -> b -> a" and "tables: 3" in graph.stats_text(graph.stats(g))


def test_chain_starts_at_sources(spark):
    g = graph.Graph.of_pairs(spark.createDataFrame([("dim.dim_brand", "dwd_b"), ("ods.ods_a", "dwd_b"), ("dwd_b", "dws_c")], "source string, target string"))
    assert workflow.longest_chain(g) == ["ods.ods_a", "dwd_b", "dws_c"]


def test_scheduler_client(spark):
    seen = []

    def opener(req):
        path = req.full_url.split("/api")[1]
        seen.append((req.get_method(), path, req.get_header("Sessionid")))
        if "login" in path:
            return json.dumps({"code": 0, "data": {"sessionId": "s1"}})
        if path.startswith("/projects?"):
            n = int(path.split("pageNo=")[1].split("&")[0])
            return json.dumps({"code": 0, "data": {"totalList": [{"code": n, "name": f"p{n}"}], "total": 2}})
        if "process-definition?" in path:
            return json.dumps({"code": 0, "data": {"totalList": [{"code": 7, "name": "w"}], "total": 1}})
        if "process-definition/7" in path:
            return json.dumps({"code": 0, "data": {"taskDefinitionList": [{"code": 1, "name": "t", "taskType": "SQL", "taskParams": {"sql": "INSERT INTO a SELECT x FROM b"}}], "processTaskRelationList": [{"preTaskCode": 0, "postTaskCode": 1}]}})
        return json.dumps({"code": 10, "msg": "no"})

    c = scheduler.Client("http://x/api", "u", "p", page=1, opener=opener)
    snap = c.snapshot(spark, ["p2"])
    assert snap.projects.count() == 1 and snap.tasks.count() == 1 and seen[1][2] == "s1"
    assert workflow.task_tables(spark, snap.tasks)[0].count() == 2
    with pytest.raises(scheduler.SchedulerError):
        c.task_codes(1, 2)


def test_parts_of_a_snapshot(spark):
    snap = snapshot(spark)
    whole = workflow.analyze(spark, snap)
    assert {(r.table, tuple(r.writers), tuple(r.readers)) for r in whole["cross_workflow"].collect()} == {("dwd.b", (1,), (2,))}
    one = workflow.analyze(spark, snap, project="P", workflow="collect")
    assert one["stats"]["workflows"] == 1 and one["stats"]["tasks"] == 2 and one["chain"] == ["src.a", "ods.a", "dwd.b", "tmp.c"]
    assert workflow.analyze(spark, snap, task_types=["shell"])["task_tables"].select("task_code").distinct().count() == 1
    with pytest.raises(ValueError, match="collect, sum"):
        workflow.analyze(spark, snap, workflow="nothing")


def test_cycles_among_the_issues(spark):
    from pyspark.sql.types import Row

    tt = spark.createDataFrame([Row(workflow_code=1, task_code=1, table="dws.a", direction="write")])
    g = graph.Graph.of_pairs(spark.createDataFrame([("dws.a", "dws.b"), ("dws.b", "dws.a")], "source string, target string"))
    assert [(r.issue, r.table, r.detail) for r in workflow.quality(tt, g=g).where("issue = 'cycle'").collect()] == [("cycle", "dws.a", "dws.a -> dws.b")]


def test_questions_to_a_snapshot(spark, tmp_path):
    snap = snapshot(spark)
    got = [(r.level, r.workflow, r.tasks, r.upstream, r.downstream) for r in workflow.workflow_list(spark, snap).collect()]
    assert got == [(0, "collect", 2, [], [2]), (1, "sum", 3, [1], [])]
    d = workflow.workflow_detail(spark, snap, "coll")
    assert d["found"] and d["tasks"][1]["writes"] == ["dwd.b", "tmp.c"] and {x["kind"] for x in d["downstream"]} == {"table", "dependent"}
    assert workflow.workflow_detail(spark, snap, "zzz") == {"found": False, "candidates": ["collect", "sum"]}
    t = workflow.table_tasks(spark, snap, "b")
    assert t["table"] == "dwd.b" and ["dwd.b", "ods.a", "src.a"] in t["upstream_paths"] and ["dwd.b", "dws.d", "ads.e"] in t["downstream_paths"] and len(t["tasks"]) == 3
    up = workflow.table_upstream(spark, snap, "ads.e")
    assert [x["name"] for x in up["upstream"]][0] == "dws.d" and up["upstream"][0]["tasks"] == [21]
    for n in ("projects", "workflows", "tasks", "relations"):
        getattr(snap, n).write.json(str(tmp_path / "s" / n))
    path = str(tmp_path / "s")
    assert [cli.main(x, spark) for x in (["ds-workflows", path], ["ds-tables", path, "b"], ["ds-task", path, "sum"], ["ds-upstream", path, "ads.e"], ["ds-tables", path, "nope"])] == [0, 0, 0, 0, 1]
    (tmp_path / "a.sql").write_text("INSERT INTO dws.x SELECT k FROM dwd.y")
    assert cli.main(["generate-validate", str(tmp_path / "a.sql"), "--report", str(tmp_path / "r.md")], spark) == 0 and "orphan" in (tmp_path / "r.md").read_text()
    assert "<svg" in render.workflow_report(workflow.analyze(spark, snap), "w")


# ---- generation


def test_generate(spark, store):
    g = generate.generate_sql(store, "dws.dws_new", ["dwd.dwd_order_line"], ["total_qty", "net_amt", "nothing"], ["order_date"], {"dt": "1"}, ["t1.qty > 0"])
    assert "INSERT OVERWRITE TABLE dws.dws_new PARTITION (dt='1')" in g.sql and "SUM(t1.qty) AS total_qty" in g.sql and "GROUP BY t1.order_date" in g.sql and len(g.warnings) == 1
    from weftline.plans.lineage import parse_sql

    assert parse_sql(spark, g.sql)[0]["input_table_names"] == ["dwd.dwd_order_line"]
    spark.sql("SELECT 1L order_key, DATE'2026-01-01' order_date, 2.0D qty, 3.0D net_amt").createOrReplaceTempView("gen_line")
    ran = spark.sql(g.sql.split("\n", 1)[1].replace("dwd.dwd_order_line", "gen_line")).collect()
    assert (ran[0].total_qty, ran[0].net_amt) == (2.0, 3.0)
    with pytest.raises(ValueError):
        generate.generate_sql(store, "a", [], ["b"])
    assert generate.join_keys(["a", "x_id", "x_code"], ["x_id", "x_code", "a"]) == ["x_code", "x_id", "a"]


def test_generate_options(spark, store):
    made = lambda **kw: generate.generate_sql(store, "dwd.dwd_order_line", ["ods.lineitem", "ods.orders"], ["net_amt"], **kw)
    one = made()
    assert any("1 of 6 known columns" in w for w in one.warnings) and any("no common column" in w for w in one.warnings)
    own = made(joins=[{"table": "ods.orders", "on": "t1.l_orderkey = t2.o_orderkey", "kind": "inner"}])
    assert "INNER JOIN ods.orders t2 ON t1.l_orderkey = t2.o_orderkey" in own.sql
    assert len(made(all_columns=True).columns) > len(one.columns)
    g = fixture_scan(spark).graph()
    said = generate.generate_sql(store, "ods.lineitem", ["src.lineitem"], ["l_quantity"], partition={"day": "1"}, graph=g).warnings
    assert "day: ods.lineitem is written by dt" in said
    assert generate.side_key(["qty", "plant_code"], "dim.dim_plant") == "plant_code" and generate.side_key(["qty"], "dim.dim_plant") is None


def test_pipeline_options(store):
    p = generate.pipeline(store, target="dws.dws_nation_day", max_stages=1)
    assert p["target"] == "dws.dws_nation_day" and len(p["stages"]) == 1 and any("max_stages" in w for w in p["warnings"]) and "${bizdate}" in p["stages"][0]["sql"]
    assert {"source": "dwd.dwd_order_line", "target": "dws.dws_nation_day", "kind": "external"} in p["edges"]
    new = generate.pipeline(store, "生成一张新的月报", target_layer="ads", max_stages=2)
    assert new["table_mode"] == "new" and new["stages"][-1]["target_table"].startswith("ads.ads_") and any("is new" in w for w in new["warnings"])
    with pytest.raises(ValueError):
        generate.pipeline(store)


def test_apply_recreates_the_workflow_of_the_same_name():
    class Fake:
        def __init__(self):
            self.made, self.gone, self.n = [], [], 50

        def workflows(self, project):
            return [{"name": w["name"], "code": c} for c, w in self.made if c not in self.gone]

        def delete_workflow(self, project, code):
            self.gone.append(code)

        def task_codes(self, project, n):
            return [self.n + i for i in range(n)]

        def create_workflow(self, project, body):
            self.n += 100
            self.made.append((self.n, body))
            return {"code": self.n}

        def workflow(self, project, code):
            body = dict(self.made)[code]
            return {"taskDefinitionList": json.loads(body["taskDefinitionJson"]), "processTaskRelationList": json.loads(body["taskRelationJson"])}

    client = Fake()
    stages = [{"name": "a", "sql": "SELECT 1", "depends_on": []}, {"name": "b", "sql": "SELECT 2", "depends_on": ["a"]}]
    first = generate.apply_plan(stages, "w", client=client, project=1)
    again = generate.apply_plan(stages, "w", client=client, project=1)
    assert first["workflow_code"] != again["workflow_code"] and client.gone == [first["workflow_code"]] and "deleted the old workflow" in again["notes"][0]
    assert again["readback"] == {"tasks": 2, "relations": 2} and json.loads(again["definition"]["taskRelationJson"])[0] == {"preTaskCode": 150, "postTaskCode": 151}


def test_validation_of_sql_files(spark):
    stages = generate.stages_of("-- external: ods.y\nINSERT INTO dwd.x SELECT k FROM ods.y; INSERT INTO ads.z SELECT k FROM dwd.x", "f.sql")
    ok, issues = generate.validate(spark, stages)
    page = generate.issues_markdown(ok, issues)
    assert [s["name"] for s in stages] == ["f.sql:1", "f.sql:2"] and not ok and "| error | layer_rule | 1 |" in page and "dwd.x -> ads.z" in page


def test_what_the_graph_says(spark):
    g = fixture_scan(spark).graph()
    assert generate.main_upstream(g, "dws.dws_nation_day") == "dwd.dwd_order_line" and generate.partition_field(g, "ods.lineitem") == "dt" and generate.main_upstream(g, "src.lineitem") is None
    assert {r.expression for r in generate.expressions_into(g, "dwd.dwd_order_line").where("target_column = 'net_amt'").collect()} == {"l.l_extendedprice * (1 - l.l_discount)"}
    assert generate.edges_into(g, "ads.ads_board").count() == 2
    assert generate.detect_aliases("a.x + b.y - 'c.z'") == ["a", "b"] and generate.rewrite_aliases("a.x + b.y - 'a.z'", {"a": "t1"}) == "t1.x + b.y - 'a.z'"


def test_pipeline_and_validation(spark, store):
    p = generate.pipeline(store, "经营看板")
    assert p["target"] == "ads.ads_board" and [s["target_table"] for s in p["stages"]][-1] == "ads.ads_board" and p["stages"][-1]["depends_on"]
    assert not generate.pipeline(store, "qqqq")["found"]
    plan = generate.apply_plan(p["stages"], "w")
    assert plan["dry_run"] and json.loads(plan["definition"]["taskRelationJson"])
    ok, issues = generate.validate(spark, [{"name": "a", "sql": "INSERT INTO ads.x SELECT k FROM ods.y"}, {"name": "b", "sql": "SELECT (k"}], store)
    kinds = {(r.type, r.level) for r in issues.collect()}
    assert not ok and {("layer_rule", "error"), ("parse", "error"), ("graph_diff", "info")} <= kinds
    ok, issues = generate.validate(spark, [{"name": "a", "sql": "INSERT INTO dws.x SELECT k FROM dwd.y"}, {"name": "b", "sql": "INSERT INTO ads.z SELECT k FROM dws.x"}])
    assert ok and {r.type for r in issues.collect()} == {"orphan"}
    assert generate.validate(spark, [])[0] is False


# ---- surfaces


def test_service(spark, store, tmp_path):
    s = Service(spark, store.path, reports=str(tmp_path / "r"))
    assert s.handle("/nope", {})[0] == 404 and s.handle("parse", {"sql": "SELECT (a"})[1]["success"] is False
    got = s.handle("analyze", {"sql": "INSERT INTO dws.dws_cust SELECT cust_key FROM dwd.dwd_order_line"})[1]
    assert got["success"] and got["table_lineage"] == [{"source": "dwd.dwd_order_line", "target": "dws.dws_cust"}] and got["knowledge"]["metrics"]
    assert "<svg" in render.load_report(got["report"], s.reports) and render.load_report("../x", s.reports) is None
    assert s.handle("impact", {"table": "src.lineitem"})[1]["found"] and s.handle("kb/search", {"query": "净额", "limit": 1})[1]["rows"]
    server = serve(s, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    assert json.load(urllib.request.urlopen(f"{url}/health"))["status"] == "ok"
    req = urllib.request.Request(f"{url}/parse", json.dumps({"sql": "SELECT a FROM t"}).encode())
    assert json.load(urllib.request.urlopen(req))["input_tables"] == ["t"]
    server.shutdown()


def test_cli(spark, tmp_path, capsys):
    root = f"{ROOT}/fixtures/warehouse"
    assert cli.main(["scan", root, "--graph-out", str(tmp_path / "g")], spark) == 1  # one broken file
    assert json.loads(capsys.readouterr().out)["statements"] == 11
    g = str(tmp_path / "g")
    assert cli.main(["impact", g, "src.lineitem"], spark) == 0 and cli.main(["impact", g, "zz.zz"], spark) == 1
    assert cli.main(["cycle", g], spark) == 1 and cli.main(["path", g, "src.lineitem", "ads.ads_board"], spark) == 0
    assert cli.main(["kb-build", str(tmp_path / "kb"), root], spark) == 0 and cli.main(["kb-ask", str(tmp_path / "kb"), "有哪些指标"], spark) == 0
    assert cli.main(["kb-show", str(tmp_path / "kb"), "net_amt"], spark) == 0 and cli.main(["kb-fields", str(tmp_path / "kb"), "--table", "ods.orders"], spark) == 0
    assert cli.main(["parse", f"{root}/08_adhoc.sql"], spark) == 0 and cli.main(["wrong"], spark) == 2
    assert cli.main(["parse-script", f"{ROOT}/fixtures/scripts/load.sh"], spark) == 0


def test_stream(spark, tmp_path):
    from weftline.streaming.scripts import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("INSERT INTO a SELECT x + y AS k FROM b")
    s = Store(spark, str(tmp_path / "kb"))
    watch(spark, str(tmp_path / "in"), s, str(tmp_path / "ck")).awaitTermination(120)
    assert s.table("table_lineage").count() == 1
    (tmp_path / "in" / "c.sql").write_text("INSERT INTO c SELECT k FROM a")
    watch(spark, str(tmp_path / "in"), s, str(tmp_path / "ck")).awaitTermination(120)
    assert s.table("table_lineage").count() == 2 and s.table("metrics").count() == 1
