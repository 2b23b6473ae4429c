"""Scripts and scheduler tasks made out of the tables' rows, so that lineage queries read ``sf_dir``: three statements for each
nation, and a workflow of tasks for each region."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.names import Glossary
from .operators import kb, workflow
from .plans.forms import t
from .sources.files import Scan, scan_texts

#: The nations as SQL sees them: number, region, name in lower case, customers, their first market segment and its day.
NATIONS = """n AS (SELECT n_nationkey AS k, n_regionkey AS r, lower(n_name) AS nat, count(c_custkey) AS c, coalesce(min(c_mktsegment), 'NONE') AS seg,
  '2026-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS dt FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"""


def nations(s: SparkSession, d: str) -> list[Row]:
    """A row for each nation (a dimension of some dozens)."""
    x = t(s, d, "nation").join(t(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    x = x.groupBy(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"), F.lower("n_name").alias("nat")).agg(F.count("c_custkey").alias("c"), F.coalesce(F.min("c_mktsegment"), F.lit("NONE")).alias("seg"))
    return x.orderBy("k").collect()


def script(n: Row) -> str:
    return f"""-- 订单 {n.nat}
INSERT OVERWRITE TABLE dwd.dwd_{n.nat}
SELECT
    a.ord_{n.k} AS ord_{n.k},                                   -- 订单{n.k}（单）
    a.price_{n.k} * (1 - a.disc_{n.k}) AS net_{n.k},            -- 净额{n.k}（元）
    CASE WHEN a.qty_{n.k} > {n.c} THEN 1 ELSE 0 END AS big_{n.k}
FROM ods.r{n.r}_line a
JOIN ods.r{n.r}_order b ON a.ord_{n.k} = b.ord_{n.k}
WHERE b.status = '{n.seg}'    -- 仅统计{n.nat}
  AND a.dt = '2026-01-{n.k + 1:02}';

INSERT OVERWRITE TABLE dws.dws_r{n.r}
SELECT t.ord_{n.k} AS ord_key, SUM(t.net_{n.k}) AS total_net, SUM(t.net_{n.k}) / COUNT(t.ord_{n.k}) AS avg_net
FROM dwd.dwd_{n.nat} t
LEFT JOIN dim.cust c ON t.ord_{n.k} = c.ord_id
GROUP BY t.ord_{n.k}
HAVING SUM(t.net_{n.k}) > {n.c};

CREATE TABLE ads.ads_{n.nat} AS SELECT x.total_net AS total_{n.k} FROM dws.dws_r{n.r} x;
"""


def warehouse(s: SparkSession, d: str) -> Scan:
    return scan_texts(s, [(f"r{n.r}/{n.nat}.sql", script(n)) for n in nations(s, d)])


EDGES = """e AS (SELECT DISTINCT * FROM (
  SELECT 'ods.r' || r || '_line' AS source, 'dwd.dwd_' || nat AS target FROM n UNION ALL SELECT 'ods.r' || r || '_order', 'dwd.dwd_' || nat FROM n
  UNION ALL SELECT 'dwd.dwd_' || nat, 'dws.dws_r' || r FROM n UNION ALL SELECT 'dim.cust', 'dws.dws_r' || r FROM n UNION ALL SELECT 'dws.dws_r' || r, 'ads.ads_' || nat FROM n))"""
FILE = "'r' || r || '/' || nat || '.sql'"
#: (source, statement_index, target_table, target_column, source_table, source_column, expression, comment and kind of each column.)
COLUMNS = f"""c AS (
  SELECT k, r, {FILE} AS source, 1 AS statement_index, 'dwd.dwd_' || nat AS tt, 'ord_' || k AS tc, 'ods.r' || r || '_line' AS st, 'ord_' || k AS sc, 'a.ord_' || k AS ex FROM n
  UNION ALL SELECT k, r, {FILE}, 1, 'dwd.dwd_' || nat, 'net_' || k, 'ods.r' || r || '_line', unnest(['price_' || k, 'disc_' || k]), 'a.price_' || k || ' * (1 - a.disc_' || k || ')' FROM n
  UNION ALL SELECT k, r, {FILE}, 1, 'dwd.dwd_' || nat, 'big_' || k, 'ods.r' || r || '_line', 'qty_' || k, 'CASE WHEN a.qty_' || k || ' > ' || c || ' THEN 1 ELSE 0 END' FROM n
  UNION ALL SELECT k, r, {FILE}, 2, 'dws.dws_r' || r, 'ord_key', 'dwd.dwd_' || nat, 'ord_' || k, 't.ord_' || k FROM n
  UNION ALL SELECT k, r, {FILE}, 2, 'dws.dws_r' || r, 'total_net', 'dwd.dwd_' || nat, 'net_' || k, 'SUM(t.net_' || k || ')' FROM n
  UNION ALL SELECT k, r, {FILE}, 2, 'dws.dws_r' || r, 'avg_net', 'dwd.dwd_' || nat, unnest(['net_' || k, 'ord_' || k]), 'SUM(t.net_' || k || ') / COUNT(t.ord_' || k || ')' FROM n
  UNION ALL SELECT k, r, {FILE}, 3, 'ads.ads_' || nat, 'total_' || k, 'dws.dws_r' || r, 'total_net', 'x.total_net' FROM n)"""
FILTERS = f"""f AS (SELECT {FILE} AS source, 1 AS i, 'dwd.dwd_' || nat AS tt, 'b.status = ''' || seg || ''' AND a.dt = ''' || dt || '''' AS condition FROM n
  UNION ALL SELECT {FILE}, 2, 'dws.dws_r' || r, 'SUM(t.net_' || k || ') > ' || c FROM n)"""
JOINS = f"""j AS (SELECT {FILE} AS source, 'dwd.dwd_' || nat AS tt, 'INNER JOIN' AS kind, 'ods.r' || r || '_line' AS a, 'ods.r' || r || '_order' AS b, 'a.ord_' || k || ' = b.ord_' || k AS cond FROM n
  UNION ALL SELECT {FILE}, 'dws.dws_r' || r, 'LEFT JOIN', 'dwd.dwd_' || nat, 'dim.cust', 't.ord_' || k || ' = c.ord_id' FROM n)"""

# ---- a knowledge base of these scripts

GLOSSARY = Glossary(columns={"total_net": "净额合计"}, tables={"dim.cust": "客户"}, tokens={"ord": "订单", "net": "净额", "avg": "平均", "price": "单价", "disc": "折扣"})
#: (table_name, column_name, chinese_name, chinese_source, percent, unit): comments where there are some, else the glossary, else its words.
FIELDS = """d AS (SELECT DISTINCT * FROM (
  SELECT 'dwd.dwd_' || nat AS table_name, 'ord_' || k AS column_name, '订单' || k AS chinese_name, 'comment' AS chinese_source, 90 AS percent, '单' AS unit FROM n
  UNION ALL SELECT 'dwd.dwd_' || nat, 'net_' || k, '净额' || k, 'comment', 90, '元' FROM n UNION ALL SELECT 'dwd.dwd_' || nat, 'big_' || k, NULL, 'pending', 0, NULL FROM n
  UNION ALL SELECT 'ods.r' || r || '_line', 'ord_' || k, '订单', 'rule', 70, NULL FROM n UNION ALL SELECT 'ods.r' || r || '_line', 'price_' || k, '单价', 'rule', 70, NULL FROM n
  UNION ALL SELECT 'ods.r' || r || '_line', 'disc_' || k, '折扣', 'rule', 70, NULL FROM n UNION ALL SELECT 'ods.r' || r || '_line', 'qty_' || k, NULL, 'pending', 0, NULL FROM n
  UNION ALL SELECT 'dws.dws_r' || r, 'ord_key', '订单', 'rule_partial', 45, NULL FROM n UNION ALL SELECT 'dws.dws_r' || r, 'total_net', '净额合计', 'exact_glossary', 100, NULL FROM n
  UNION ALL SELECT 'dws.dws_r' || r, 'avg_net', '平均净额', 'rule', 70, NULL FROM n UNION ALL SELECT 'ads.ads_' || nat, 'total_' || k, NULL, 'pending', 0, NULL FROM n))"""
METRICS = f"""m AS (
  SELECT 'net_' || k AS metric_name, 'dwd.dwd_' || nat AS table_name, {FILE} AS source_file, '算术计算' AS metric_type, '净额' || k AS label, '净额' || k || ' = 单价 * (1 - 折扣)' AS formula FROM n
  UNION ALL SELECT 'big_' || k, 'dwd.dwd_' || nat, {FILE}, '条件分支', NULL, 'big_' || k || ' = CASE WHEN qty_' || k || ' > ' || c || ' THEN 1 ELSE 0 END' FROM n
  UNION ALL SELECT 'total_net', 'dws.dws_r' || r, {FILE}, '聚合', '净额合计', '净额合计 = SUM(净额' || k || ')' FROM n
  UNION ALL SELECT 'avg_net', 'dws.dws_r' || r, {FILE}, '比率', '平均净额', '平均净额 = SUM(净额' || k || ') / COUNT(订单' || k || ')' FROM n)"""


def knowledge(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return kb.build_from_scan(warehouse(s, d), GLOSSARY)


# ---- scripts around the SQL


def scripts_of(s: SparkSession, d: str) -> DataFrame:
    """A shell and a Python script for each nation: (path, text, task_type)."""
    rows = []
    for n in nations(s, d):
        shell = f"""#!/bin/bash
# hive -e "SELECT 1 FROM nowhere"
DAY=2026-01-{n.k + 1:02}
SQL="INSERT INTO ods.{n.nat} SELECT c FROM src.{n.nat} WHERE c > {n.c}"
hive -e "$SQL"
spark-sql -e "INSERT INTO dwd.{n.nat} SELECT c FROM ods.{n.nat} WHERE dt = '${{DAY}}'"
beeline -f {n.nat}.sql
hive <<EOF
INSERT INTO dws.{n.nat} SELECT c FROM dwd.{n.nat};
EOF
"""
        python = f'''"""SELECT a docstring FROM {n.nat}"""
q = """INSERT INTO ads.{n.nat} SELECT c FROM dws.{n.nat}"""
spark.sql(q)
spark.sql(f"SELECT c FROM ods.{n.nat} WHERE c = {{limit}} AND s = {{x['{{}}']}}")
spark.sql(unknown)
'''
        rows += [(f"{n.nat}.sh", shell, None), (f"{n.nat}.py", python, None)]
    return s.createDataFrame(rows, "path string, text string, task_type string")


SCRIPTS = """SELECT nat || '.sh' AS path, 'shell' AS kind, 0 AS seq, 'INSERT INTO ods.' || nat || ' SELECT c FROM src.' || nat || ' WHERE c > ' || c AS "sql", 4 AS line, true AS resolved FROM n
  UNION ALL SELECT nat || '.sh', 'shell', 1, 'INSERT INTO dwd.' || nat || ' SELECT c FROM ods.' || nat || ' WHERE dt = ''${DAY}''', 6, true FROM n
  UNION ALL SELECT nat || '.sh', 'shell', 2, NULL, 7, false FROM n UNION ALL SELECT nat || '.sh', 'shell', 3, 'INSERT INTO dws.' || nat || ' SELECT c FROM dwd.' || nat || ';', 9, true FROM n
  UNION ALL SELECT nat || '.py', 'python', 0, 'INSERT INTO ads.' || nat || ' SELECT c FROM dws.' || nat, 2, true FROM n
  UNION ALL SELECT nat || '.py', 'python', 1, 'SELECT c FROM ods.' || nat || ' WHERE c = 0 AND s = 0', 4, true FROM n"""

# ---- workflows: each region's tasks read what the region before gathered, and one task gathers the region


def snapshot(s: SparkSession, d: str) -> workflow.Snapshot:
    rows = nations(s, d)
    regions = sorted({n.r for n in rows})
    tasks, relations = [], []
    for i, r in enumerate(regions):
        own = [n for n in rows if n.r == r]
        before = f"dws.reg{regions[i - 1]}" if i else f"src.reg{r}"
        for n in own:
            shell = n.k % 2 == 0
            sql = f"INSERT INTO dws.n{n.k} SELECT x FROM {before} JOIN zz.q{n.k} USING (x)"
            params = {"rawScript": f'hive -e "{sql}"'} if shell else {"sql": sql}
            tasks.append((r + 1, 1000 + n.k, f"t{n.k}", "SHELL" if shell else "SQL", json.dumps(params)))
            relations += [(r + 1, 0, 1000 + n.k), (r + 1, 1000 + n.k, 2000 + r)]
        gather = " UNION ALL ".join(f"SELECT x FROM dws.n{n.k}" for n in own)
        tasks.append((r + 1, 2000 + r, f"gather{r}", "SQL", json.dumps({"sql": f"INSERT INTO dws.reg{r} {gather}; INSERT INTO tmp.log{r} SELECT x FROM dws.reg{r}"})))
        if i:
            tasks.append((r + 1, 3000 + r, "wait", "DEPENDENT", json.dumps({"dependence": {"dependTaskList": [{"dependItemList": [{"definitionCode": regions[i - 1] + 1}]}]}})))
    make = s.createDataFrame
    return workflow.Snapshot(
        make([(9, "p")], "code long, name string"), make([(9, r + 1, f"region{r}") for r in regions], "project_code long, code long, name string"),
        make(tasks, "workflow_code long, code long, name string, task_type string, task_params string"), make(relations, "workflow_code long, pre_task_code long, post_task_code long"),
    )


#: (w, k, tab, dir) of the tasks above; p is the region before.
TASK_TABLES = """n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), p AS (SELECT r, lag(r) OVER (ORDER BY r) AS b FROM (SELECT DISTINCT r FROM n)),
tt AS (SELECT DISTINCT * FROM (SELECT r + 1 AS w, 1000 + k AS k, 'dws.n' || k AS tab, 'write' AS dir FROM n UNION ALL SELECT r + 1, 1000 + k, 'zz.q' || k, 'read' FROM n
  UNION ALL SELECT n.r + 1, 1000 + k, coalesce('dws.reg' || b, 'src.reg' || n.r), 'read' FROM n JOIN p ON n.r = p.r
  UNION ALL SELECT r + 1, 2000 + r, 'dws.n' || k, 'read' FROM n UNION ALL SELECT r + 1, 2000 + r, unnest(['dws.reg' || r, 'tmp.log' || r]), 'write' FROM p UNION ALL SELECT r + 1, 2000 + r, 'dws.reg' || r, 'read' FROM p))"""
