"""Queries for the operators, each with SQL that says the same where SQL can."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import samples
from .functions import columns as C
from .functions.names import Glossary
from .operators import generate, graph, scripts, search, workflow
from .operators.graph import Graph
from .plans.forms import FORMS, t
from .plans.lineage import edges_frame, statements_frame
from .sources.files import Scan, scan_texts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# ---- a graph out of the tables: a supplier's nation to the two nations that buy most from it

EDGES = """e AS (SELECT s AS source, t AS target FROM (SELECT a.n_name AS s, b.n_name AS t, row_number() OVER (PARTITION BY a.n_name ORDER BY count(*) DESC, b.n_name) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name GROUP BY a.n_name, b.n_name) WHERE r <= 2),
nodes AS (SELECT n_name AS name FROM nation)"""
START = "(SELECT min(source) FROM e)"
TREE = """e AS (SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON n_regionkey = r_regionkey UNION
  SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
REACH = "c AS (SELECT source AS a, target AS b FROM e UNION SELECT c.a, e.target FROM c JOIN e ON c.b = e.source)"


def nation_graph(s: SparkSession, d: str) -> Graph:
    n = t(s, d, "nation")
    x = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n")).where("s_nationkey <> c_nationkey")
    x = x.join(F.broadcast(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source"))), "s_nationkey").join(F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target"))), "c_nationkey")
    e = x.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "target"))).where("r <= 2").select("source", "target")
    return Graph(n.select(F.col("n_name").alias("name"), F.lit("other").alias("layer")), graph._kept(e))


def tree_graph(s: SparkSession, d: str) -> Graph:
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t(s, d, "region").join(t(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(k("r", "r_regionkey").alias("source"), k("n", "n_nationkey").alias("target"))
    e = e.unionByName(t(s, d, "customer").select(k("n", "c_nationkey").alias("source"), k("c", "c_custkey").alias("target"))).unionByName(t(s, d, "orders").select(k("c", "o_custkey").alias("source"), k("o", "o_orderkey").alias("target"))).distinct()
    g = Graph.of_pairs(e)
    return Graph(g.nodes, graph._kept(g.edges))


def first_source(g: Graph) -> str:
    return g.edges.agg(F.min("source")).first()[0]


def last_node(g: Graph, start: str) -> str:
    return graph.levels(g, start).agg(F.max(F.struct("level", "name"))).first()[0].name


Q: dict[str, tuple] = dict(FORMS)


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query(f"WITH {EDGES} SELECT name, (SELECT count(*) FROM e WHERE target = name) AS in_degree, (SELECT count(*) FROM e WHERE source = name) AS out_degree FROM nodes")
def g_degrees(s, d):
    return graph.degrees(nation_graph(s, d))


@query(f"WITH {EDGES} SELECT name FROM nodes WHERE name NOT IN (SELECT target FROM e)")
def g_roots(s, d):
    return graph.roots(nation_graph(s, d))


@query(f"WITH {TREE} SELECT target AS name FROM e WHERE target NOT IN (SELECT source FROM e) UNION SELECT source FROM e WHERE false")
def g_leaves(s, d):
    return graph.leaves(tree_graph(s, d))


@query(f"WITH {EDGES} SELECT name FROM nodes WHERE name NOT IN (SELECT target FROM e) AND name NOT IN (SELECT source FROM e)")
def g_isolated(s, d):
    return graph.isolated(nation_graph(s, d))


_LEVELS = "l AS (SELECT {start} AS name, 0 AS level UNION SELECT {to}, level + 1 FROM l JOIN e ON l.name = {at} WHERE level < 30) SELECT name, min(level)::INT AS level FROM l GROUP BY name HAVING min(level) > 0"


@query(f"WITH RECURSIVE {EDGES}, " + _LEVELS.format(start=START, to="target", at="source"))
def g_bfs_down(s, d):
    g = nation_graph(s, d)
    return graph.levels(g, first_source(g))


@query(f"WITH RECURSIVE {EDGES}, " + _LEVELS.format(start="(SELECT min(target) FROM e)", to="source", at="target"))
def g_bfs_up(s, d):
    g = nation_graph(s, d)
    return graph.levels(g, g.edges.agg(F.min("target")).first()[0], up=True)


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT a, b FROM c")
def g_closure(s, d):
    return graph.closure(nation_graph(s, d))


_PATHS = "p AS (SELECT [{a}] AS path, {a} AS last UNION ALL SELECT list_append(path, target), target FROM p JOIN e ON last = source WHERE NOT list_contains(path, target) AND len(path) <= {n})"
_LAST = "(SELECT name FROM (SELECT name, min(level) AS level FROM l GROUP BY name) ORDER BY level DESC, name DESC LIMIT 1)"


@query(f"WITH RECURSIVE {EDGES}, l AS (SELECT {START} AS name, 0 AS level UNION SELECT target, level + 1 FROM l JOIN e ON l.name = source WHERE level < 30), " + _PATHS.format(a=START, n=graph.MAX_LENGTH)
       + f" SELECT array_to_string(path, ' > ') AS path, len(path)::INT AS n_nodes FROM p WHERE last = {_LAST} AND len(path) > 1 ORDER BY len(path), path LIMIT 20")
def g_paths_between(s, d):
    g = nation_graph(s, d)
    a = first_source(g)
    return graph.paths_between(g, a, last_node(g, a)).select(F.array_join("path", " > ").alias("path"), "n_nodes")


@query(f"WITH RECURSIVE {EDGES}, " + _PATHS.format(a=START, n=4) + """ SELECT array_to_string(path, ' > ') AS path, (len(path) - 1)::INT AS hops FROM p WHERE len(path) > 1
  AND (len(path) = 5 OR NOT EXISTS (SELECT 1 FROM e WHERE source = last AND NOT list_contains(path, target))) ORDER BY len(path), path LIMIT 100""")  # fmt: skip
def g_paths_down(s, d):
    g = nation_graph(s, d)
    return graph.paths(g, first_source(g), depth=4).select(F.array_join("path", " > ").alias("path"), "hops")


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT name, comp AS component, count(*) OVER (PARTITION BY comp) AS size FROM (SELECT name, least(name, coalesce((SELECT min(x.b) FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a = name), name)) AS comp FROM nodes)")
def g_scc(s, d):
    return graph.scc(nation_graph(s, d))


@query(f"""WITH RECURSIVE {EDGES}, {REACH}, k AS (SELECT x.a AS name, least(min(x.b), x.a) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
 SELECT component, string_agg(name, ',' ORDER BY name) AS nodes, count(*) AS length FROM k GROUP BY component""")
def g_cycles(s, d):
    return graph.cycles(nation_graph(s, d)).withColumn("nodes", F.array_join("nodes", ","))


@query(f"WITH RECURSIVE {TREE}, l AS (SELECT DISTINCT source AS name, 0 AS level FROM e WHERE source NOT IN (SELECT target FROM e) UNION ALL SELECT target, level + 1 FROM l JOIN e ON l.name = source) SELECT name, max(level)::INT AS depth FROM l GROUP BY name")
def g_depths(s, d):
    return graph.depths(tree_graph(s, d))


@query(f"WITH RECURSIVE {TREE}, l AS (SELECT DISTINCT source AS name, 0 AS level FROM e WHERE source NOT IN (SELECT target FROM e) UNION ALL SELECT target, level + 1 FROM l JOIN e ON l.name = source) SELECT name, max(level)::INT AS level FROM l GROUP BY name")
def g_topological_levels(s, d):
    return graph.topological_levels(tree_graph(s, d))


@query(f"WITH RECURSIVE {EDGES}, " + f"l AS (SELECT {START} AS name, 0 AS level UNION SELECT target, level + 1 FROM l JOIN e ON l.name = source WHERE level < 2) SELECT source, target FROM e WHERE source IN (SELECT name FROM l) AND target IN (SELECT name FROM l)")
def g_subgraph(s, d):
    g = nation_graph(s, d)
    a = first_source(g)
    near = graph.levels(g, a, depth=2).select("name").union(s.createDataFrame([(a,)], "name string"))
    return graph.subgraph(g, near).edges


@query(f"WITH {EDGES}, g AS (SELECT name, (SELECT count(*) FROM e WHERE target = name) AS i, (SELECT count(*) FROM e WHERE source = name) AS o FROM nodes) SELECT count(*) AS tables, (SELECT count(*) FROM e) AS edges, count(*) FILTER (i = 0) AS roots, count(*) FILTER (o = 0) AS leaves, max(i) AS max_in, max(o) AS max_out, round(avg(o), 3) AS avg_out FROM g")
def g_stats(s, d):
    x = graph.stats(nation_graph(s, d))
    return s.createDataFrame([(x["tables"], x["edges"], x["roots"], x["leaves"], x["max_in_degree"], x["max_out_degree"], float(x["avg_out_degree"]))], "tables long, edges long, roots long, leaves long, max_in long, max_out long, avg_out double")


# ---- column functions over the tables

_NAMES = "(SELECT p_partkey, ['src', 'source', 'stg', 'ods', 'dim', 'cdw', 'ads', 'app', 'x'][p_size % 9 + 1] || '.' || CASE p_size % 4 WHEN 0 THEN 'dwd_' WHEN 1 THEN 'ods_' WHEN 2 THEN 'a_dws' ELSE '' END || replace(p_name, ' ', '_') AS n FROM part)"


def _part_names(s, d) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("src", "source", "stg", "ods", "dim", "cdw", "ads", "app", "x")])
    z = F.col("p_size") % 4
    own = F.when(z == 0, "dwd_").when(z == 1, "ods_").when(z == 2, "a_dws").otherwise("")
    return t(s, d, "part").select("p_partkey", F.concat(F.get(kinds, F.col("p_size") % 9), F.lit("."), own, F.replace("p_name", F.lit(" "), F.lit("_"))).alias("n"))


_LAYER_SQL = """CASE WHEN contains(split_part(lower({n}), '.', 2), 'dwd') THEN 'dwd' WHEN contains(split_part(lower({n}), '.', 2), 'dws') THEN 'dws'
 WHEN split_part({n}, '.', 1) IN ('src', 'source') THEN 'src' WHEN split_part({n}, '.', 1) IN ('stg', 'stage') THEN 'stg' WHEN split_part({n}, '.', 1) = 'cdw' THEN 'dwd'
 WHEN split_part({n}, '.', 1) IN ('ods', 'dim', 'dwd', 'dws', 'ads', 'app') THEN split_part({n}, '.', 1)
 WHEN regexp_matches(split_part({n}, '.', 2), '^(ods|dim|ads)(_|$)') THEN regexp_extract(split_part({n}, '.', 2), '^(ods|dim|ads)', 1) ELSE 'other' END"""


@query(f"SELECT p_partkey, {_LAYER_SQL.format(n='n')} AS layer FROM {_NAMES}")
def f_table_layer(s, d):
    return _part_names(s, d).select("p_partkey", C.table_layer(F.col("n")).alias("layer"))


@query(f"""WITH x AS (SELECT {_LAYER_SQL.format(n='n')} AS l FROM {_NAMES}), i AS (SELECT DISTINCT l, CASE l WHEN 'src' THEN 0 WHEN 'stg' THEN 0 WHEN 'ods' THEN 1 WHEN 'dim' THEN 1 WHEN 'dwd' THEN 2 WHEN 'dws' THEN 3 WHEN 'ads' THEN 4 WHEN 'app' THEN 5 ELSE 2 END AS k FROM x)
 SELECT a.l AS source, b.l AS target, (a.l IN ('dim', 'other') OR b.l IN ('dim', 'other') OR b.k - a.k BETWEEN 0 AND 1) AS ok FROM i a, i b""")
def f_layer_steps(s, d):
    lay = _part_names(s, d).select(C.table_layer(F.col("n")).alias("l")).distinct()  # at most nine rows
    return lay.select(F.col("l").alias("source")).crossJoin(F.broadcast(lay.select(F.col("l").alias("target")))).withColumn("ok", C.layer_step_ok(F.col("source"), F.col("target")))


@query("""WITH x AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'SUM(a) / SUM(b)' WHEN 1 THEN 'ROW_NUMBER() OVER (ORDER BY ' || p_brand || ')' WHEN 2 THEN 'CASE WHEN a > 1 THEN b END' WHEN 3 THEN 'COUNT(DISTINCT a)'
 WHEN 4 THEN 'qty * price' WHEN 5 THEN 'UPPER(' || p_brand || ')' WHEN 6 THEN 'col_' || p_size ELSE '' END AS e FROM part)
 SELECT p_partkey, CASE WHEN e = '' THEN '直取' WHEN contains(e, 'OVER (') THEN '窗口函数' WHEN contains(e, 'CASE') THEN '条件分支' WHEN contains(e, '/') THEN '比率' WHEN regexp_matches(e, '^(SUM|COUNT)') THEN '聚合' WHEN contains(e, '*') THEN '算术计算' WHEN contains(e, '(') THEN '函数转换' ELSE '直取' END AS class,
 CASE WHEN regexp_matches(e, '^(SUM|COUNT)') THEN regexp_extract(e, '^(SUM|COUNT)', 1) END AS agg FROM x""")
def f_classify_expression(s, d):
    z = F.col("p_size") % 8
    e = F.when(z == 0, "SUM(a) / SUM(b)").when(z == 1, F.concat(F.lit("ROW_NUMBER() OVER (ORDER BY "), "p_brand", F.lit(")"))).when(z == 2, "CASE WHEN a > 1 THEN b END").when(z == 3, "COUNT(DISTINCT a)")
    e = e.when(z == 4, "qty * price").when(z == 5, F.concat(F.lit("UPPER("), "p_brand", F.lit(")"))).when(z == 6, F.concat(F.lit("col_"), F.col("p_size").cast("string"))).otherwise("")
    return t(s, d, "part").select("p_partkey", C.classify_expression(e).alias("class"), C.aggregate_of(e).alias("agg"))


@query("""SELECT doc_id, CASE WHEN lower(coalesce(text, '')) = '' THEN 0.0 WHEN lower(text) = 'the and' THEN 100.0 WHEN starts_with(lower(text), 'the and') THEN 82.0 WHEN contains(lower(text), 'the and') THEN 65.0
 ELSE 45.0 * ((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'and') THEN 1 ELSE 0 END)) / 2 END AS score FROM documents""")
def f_score_text(s, d):
    return t(s, d, "documents").select("doc_id", C.score_text(F.col("text"), "the and").alias("score"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'a IS NOT NULL' WHEN 1 THEN 'dt = ''1''' WHEN 2 THEN 'date >= 3' WHEN 3 THEN 'k IN (1, 2)' WHEN 4 THEN 'a <> ' || o_custkey WHEN 5 THEN 'o_status = ''F''' ELSE 'a > 1' END AS e FROM orders)
 SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '空值过滤：' || e || '（该字段为空视为脏数据）' WHEN 1 THEN '时点/分区过滤：' || e WHEN 2 THEN '时间范围过滤：' || e WHEN 3 THEN '枚举过滤：' || e WHEN 4 THEN '取值排除：' || e WHEN 5 THEN '状态过滤：' || e ELSE '过滤条件：' || e END AS said FROM x""")
def f_describe_filter(s, d):
    z = F.col("o_orderkey") % 7
    e = F.when(z == 0, "a IS NOT NULL").when(z == 1, "dt = '1'").when(z == 2, "date >= 3").when(z == 3, "k IN (1, 2)").when(z == 4, F.concat(F.lit("a <> "), F.col("o_custkey").cast("string"))).when(z == 5, "o_status = 'F'").otherwise("a > 1")
    return t(s, d, "orders").select("o_orderkey", C.describe_filter(e).alias("said"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(lower(replace(p_name, ' ', '_') || '_' || p_size), '_'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$')), ' ') AS parts FROM part")
def f_split_identifier(s, d):
    return t(s, d, "part").select("p_partkey", F.array_join(C.split_identifier(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string"))), " ").alias("parts"))


# ---- the small warehouse of files that comes with the repository


def fixture_files(folder: str = "warehouse") -> list[tuple[str, str]]:
    base, out = os.path.join(ROOT, "fixtures", folder), []
    for at, _, names in os.walk(base):
        for n in names:
            path = os.path.join(at, n)
            with open(path, encoding="utf-8") as f:
                out.append((os.path.relpath(path, base).replace(os.sep, "/"), f.read()))
    return sorted(out)


def fixture_scan(s: SparkSession) -> Scan:
    return scan_texts(s, fixture_files())


def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


@query(values([(9, 1, 11, 2)], "ok_files, failed, statements, several"))
def l_scan_summary(s, d):
    x = fixture_scan(s)
    return s.createDataFrame([(x.files - len(x.failures), len(x.failures), len(x.records), len(x.several))], "ok_files int, failed int, statements int, several int")


@query(values([("cust_key", "dwd.dwd_order_line", "cust_key"), ("cust_key", "ods.customer", "c_custkey"), ("cust_amt", "dwd.dwd_order_line", "net_amt"), ("cust_amt", None, "(常量)"), ("rn", "dwd.dwd_order_line", "is_big"), ("rn", "dwd.dwd_order_line", "net_amt"), ("rn", None, "(常量)")], "target_column, source_table, source_column"))
def l_columns_union(s, d):
    return fixture_scan(s).columns().where("target_table = 'dws.dws_cust'").select("target_column", "source_table", "source_column").distinct()


GLOSSARY = Glossary(columns={"total_qty": "总数量", "qty": "数量", "net_amt": "净额"}, tables={"ads.ads_board": "经营看板"}, tokens={"cust": "客户", "amt": "金额", "order": "订单", "date": "日期", "key": "键"})


# ---- lineage of scripts that are made out of the tables; the SQL puts the expected rows together from the same tables

_N = f"WITH {samples.NATIONS}"


@query(f"{_N}, {samples.EDGES} SELECT source, target FROM e")
def l_table_edges(s, d):
    return edges_frame(samples.warehouse(s, d).statements()).select("source", "target").distinct()


@query(f"{_N} SELECT {samples.FILE} AS source, unnest([1, 2, 3]) AS statement_index, unnest(['INSERT_SELECT', 'INSERT_SELECT', 'CTAS']) AS task_type FROM n")
def l_statements(s, d):
    return samples.warehouse(s, d).statements().select("source", "statement_index", "task_type")


@query(f"{_N}, {samples.COLUMNS} SELECT source AS file, statement_index, tt AS target_table, tc AS target_column, st AS source_table, sc AS source_column, ex AS expression, true AS resolved FROM c")
def l_columns(s, d):
    return samples.warehouse(s, d).columns().select("file", "statement_index", "target_table", "target_column", "source_table", "source_column", "expression", "resolved")


@query(f"{_N}, {samples.FILTERS} SELECT source, i AS statement_index, condition FROM f")
def l_filters(s, d):
    return samples.warehouse(s, d).statements().select("source", "statement_index", F.explode("filters").alias("condition"))


@query(f"{_N} SELECT {samples.FILE} AS source, 'dt' AS k, dt AS v FROM n")
def l_partition_filters(s, d):
    x = samples.warehouse(s, d).statements().select("source", F.explode("partition_filters").alias("k", "v"))
    return x.select("source", "k", F.array_join("v", ",").alias("v"))


@query(f"{_N}, {samples.JOINS} SELECT source, kind, a, b, cond FROM j")
def l_joins(s, d):
    j = samples.warehouse(s, d).statements().select("source", F.explode("joins").alias("j"))
    return j.select("source", F.col("j.type").alias("kind"), F.col("j.left").alias("a"), F.col("j.right").alias("b"), F.col("j.on").alias("cond"))


@query(f"WITH RECURSIVE {samples.NATIONS}, {samples.EDGES}, l AS (SELECT 'ods.r1_line' AS name, 0 AS level UNION SELECT target, level + 1 FROM l JOIN e ON name = source WHERE level < 20) SELECT name, min(level)::INT AS level FROM l GROUP BY name HAVING min(level) > 0")
def l_impact(s, d):
    return graph.levels(samples.warehouse(s, d).graph(), "ods.r1_line")


@query(f"{_N}, {samples.EDGES}, x AS (SELECT source AS name FROM e UNION SELECT target FROM e) SELECT {_LAYER_SQL.format(n='name')} AS layer, string_agg(name, ',' ORDER BY name) AS tables FROM x GROUP BY 1")
def l_tables_by_layer(s, d):
    return graph.tables_by_layer(samples.warehouse(s, d).graph()).withColumn("tables", F.array_join("tables", ","))


@query(f"""{_N}, u AS (SELECT unnest(['ods.r' || r || '_line', 'ods.r' || r || '_order', 'dwd.dwd_' || nat, 'dim.cust', 'dws.dws_r' || r]) AS name FROM n)
 SELECT name, count(*) AS ref_count FROM u GROUP BY name UNION ALL SELECT 'ads.ads_' || nat, 0 FROM n""")
def l_ref_counts(s, d):
    return samples.warehouse(s, d).graph().nodes.select("name", "ref_count")


@query(f"""{_N}, {samples.COLUMNS} SELECT st AS source, tt AS target, count(*) AS column_mappings, string_agg(DISTINCT statement_index || ':' || source, ',' ORDER BY statement_index || ':' || source) AS made_by FROM c GROUP BY st, tt
 UNION ALL SELECT 'ods.r' || r || '_order', 'dwd.dwd_' || nat, 0, '1:' || {samples.FILE} FROM n UNION ALL SELECT 'dim.cust', 'dws.dws_r' || r, 0, string_agg('2:' || {samples.FILE}, ',' ORDER BY '2:' || {samples.FILE}) FROM n GROUP BY r""")
def l_edge_details(s, d):
    made = F.array_join(F.array_sort(F.transform("statements", lambda x: F.concat_ws(":", x["statement_index"].cast("string"), x["file"]))), ",")
    return samples.warehouse(s, d).graph().edges.select("source", "target", F.col("column_mappings").cast("long").alias("column_mappings"), made.alias("made_by"))


@query(f"{_N} {samples.SCRIPTS}")
def s_extract_scripts(s, d):
    return scripts.extract_frame(samples.scripts_of(s, d)).select("path", "kind", "seq", "sql", "line", "resolved")


# ---- knowledge base


@query(f"{_N}, {samples.METRICS} SELECT metric_name, table_name, source_file, metric_type, label, formula FROM m")
def k_metrics(s, d):
    return samples.knowledge(s, d)["metrics"].select("metric_name", "table_name", "source_file", "metric_type", F.col("chinese_name").alias("label"), "formula")


@query(f"""{_N}, {samples.FILTERS}, {samples.JOINS}
 SELECT '过滤规则' AS rule_type, tt AS table_name, condition AS expression, CASE WHEN contains(condition, 'dt =') THEN '时点/分区过滤：' ELSE '过滤条件：' END || condition AS description, source AS source_file FROM f
 UNION ALL SELECT '分区规则', 'dwd.dwd_' || nat, 'dt = ''' || dt || '''', '分区/时点条件：dt = ' || dt, {samples.FILE} FROM n
 UNION ALL SELECT '关联规则', tt, cond, a || ' ' || kind || ' ' || b || ' ON ' || cond, source FROM j
 UNION ALL SELECT '业务规则（注释）', NULL, 'WHERE b.status = ''' || seg || '''', '仅统计' || nat, {samples.FILE} FROM n""")
def k_rules(s, d):
    return samples.knowledge(s, d)["rules"].select("rule_type", "table_name", "expression", "description", "source_file")


@query(f"{_N}, {samples.FIELDS} SELECT * FROM d")
def k_fields(s, d):
    return samples.knowledge(s, d)["fields"].select("table_name", "column_name", "chinese_name", "chinese_source", F.round(F.col("confidence") * 100).cast("int").alias("percent"), "unit")


@query(f"""{_N}, {samples.FIELDS}, x AS (SELECT column_name AS term, chinese_name, 'field' AS category, chinese_source AS source, percent, table_name AS tab, 1 AS n FROM d
  UNION ALL SELECT 'total_net', '净额合计', 'field', 'builtin', 100, NULL, 0 UNION ALL SELECT 'dim.cust', '客户', 'table', 'builtin', 100, NULL, 0 UNION ALL SELECT 'dim.cust', '客户', 'table', 'exact_glossary', 90, 'dim.cust', 1)
 SELECT term, first(chinese_name ORDER BY percent DESC, chinese_name IS NULL, chinese_name, category, source) AS chinese_name, first(source ORDER BY percent DESC, chinese_name IS NULL, chinese_name, category, source) AS source,
 max(percent) AS percent, coalesce(string_agg(DISTINCT tab, ',' ORDER BY tab), '') AS tables, sum(n)::INT AS occurrences FROM x GROUP BY term""")
def k_terms(s, d):
    return samples.knowledge(s, d)["terms"].select("term", "chinese_name", "source", F.round(F.col("confidence") * 100).cast("int").alias("percent"), F.array_join("tables", ",").alias("tables"), "occurrences")


_SCORE = "CASE WHEN {x} = '净额' THEN 100.0 WHEN starts_with({x}, '净额') THEN 82.0 WHEN contains({x}, '净额') THEN 65.0 ELSE 0.0 END"


@query(f"""{_N}, {samples.FIELDS}, {samples.METRICS}
 SELECT 'fields' AS kind, column_name AS name, table_name, round(greatest({_SCORE.format(x='chinese_name')} * 1.3, 0.0), 1)::DOUBLE AS score FROM d WHERE contains(chinese_name, '净额')
 UNION ALL SELECT 'metrics', metric_name, table_name, round(greatest({_SCORE.format(x='label')} * 1.3, {_SCORE.format(x='formula')}), 1)::DOUBLE FROM m WHERE contains(formula, '净额')""")
def k_search(s, d):
    known = samples.knowledge(s, d)
    found = search.search_one(known["fields"], "fields", "净额").unionByName(search.search_one(known["metrics"], "metrics", "净额"))
    return found.select("kind", "name", "table_name", "score")


# ---- workflows (the SQL computes from the tasks' tables, which it puts together from the nations)

TASKS = [(1, 11, "SQL", "INSERT INTO ods.a SELECT x FROM src.a"), (1, 12, "SHELL", 'hive -e "INSERT INTO dwd.b SELECT x FROM ods.a; INSERT INTO tmp.c SELECT x FROM dwd.b"'), (2, 21, "SQL", "INSERT INTO dws.d SELECT x FROM dwd.b JOIN zz.q USING (x)"), (2, 22, "SQL", "INSERT INTO ads.e SELECT x FROM dws.d")]
_T = samples.TASK_TABLES


def snapshot(s: SparkSession) -> workflow.Snapshot:
    """A fixed snapshot of two workflows."""
    make = s.createDataFrame
    ts = [(w, k, f"t{k}", kind, json.dumps({"rawScript" if kind == "SHELL" else "sql": text})) for w, k, kind, text in TASKS]
    ts.append((2, 23, "wait", "DEPENDENT", json.dumps({"dependence": {"dependTaskList": [{"dependItemList": [{"definitionCode": 1}]}]}})))
    return workflow.Snapshot(make([(9, "p")], "code long, name string"), make([(9, 1, "collect"), (9, 2, "sum")], "project_code long, code long, name string"), make(ts, "workflow_code long, code long, name string, task_type string, task_params string"), make([(1, 0, 11), (1, 11, 12), (2, 0, 21), (2, 21, 22)], "workflow_code long, pre_task_code long, post_task_code long"))


def task_tables(s, d):
    return workflow.task_tables(s, samples.snapshot(s, d).tasks)[0]


@query(f"WITH {_T} SELECT w::BIGINT AS workflow_code, k::BIGINT AS task_code, tab AS \"table\", dir AS direction FROM tt")
def w_task_tables(s, d):
    return task_tables(s, d)


@query(f"WITH {_T} SELECT a.w::BIGINT AS workflow_code, a.k::BIGINT AS producer, b.k::BIGINT AS consumer, string_agg(DISTINCT a.tab, ',' ORDER BY a.tab) AS via FROM tt a JOIN tt b ON a.w = b.w AND a.tab = b.tab AND a.dir = 'write' AND b.dir = 'read' AND a.k <> b.k GROUP BY ALL")
def w_task_edges(s, d):
    return workflow.task_edges(task_tables(s, d)).select("workflow_code", "producer", "consumer", F.array_join("via_tables", ",").alias("via"))


@query(f"""WITH {_T} SELECT a.w::BIGINT AS source, b.w::BIGINT AS target, 'table' AS kind, string_agg(DISTINCT a.tab, ',' ORDER BY a.tab) AS via FROM tt a JOIN tt b ON a.tab = b.tab AND a.dir = 'write' AND b.dir = 'read' AND a.w <> b.w
 WHERE NOT EXISTS (SELECT 1 FROM tt c WHERE c.w = b.w AND c.tab = a.tab AND c.dir = 'write') GROUP BY ALL UNION ALL SELECT b + 1, r + 1, 'dependent', '' FROM p WHERE b IS NOT NULL""")
def w_dependencies(s, d):
    tasks = samples.snapshot(s, d).tasks
    deps = workflow.workflow_dependencies(workflow.task_tables(s, tasks)[0], workflow.native_dependencies(s, tasks))
    return deps.select("source", "target", "kind", F.array_join("via_tables", ",").alias("via"))


@query(f"""WITH {_T} SELECT 'dangling' AS issue, tab AS "table" FROM (SELECT DISTINCT tab FROM tt WHERE dir = 'write' EXCEPT SELECT tab FROM tt WHERE dir = 'read') WHERE split_part(tab, '.', 1) NOT IN ('ads', 'app', 'rpt', 'report')
 UNION ALL SELECT 'orphan', tab FROM (SELECT DISTINCT tab FROM tt WHERE dir = 'read' EXCEPT SELECT tab FROM tt WHERE dir = 'write') WHERE split_part(tab, '.', 1) NOT IN ('src', 'ods', 'dim', 'ext', 'stage')""")
def w_quality(s, d):
    return workflow.quality(task_tables(s, d)).select("issue", "table")


@query(f"WITH {_T} SELECT (r + 1)::BIGINT AS code, (row_number() OVER (ORDER BY r) - 1)::INT AS level FROM p")
def w_levels(s, d):
    x = samples.snapshot(s, d)
    return workflow.workflow_levels(x.workflows, workflow.workflow_dependencies(workflow.task_tables(s, x.tasks)[0]))


@query(f"WITH {_T} SELECT tab AS \"table\", count(DISTINCT k) FILTER (dir = 'write')::INT AS in_degree, count(DISTINCT k) FILTER (dir = 'read')::INT AS out_degree FROM tt GROUP BY tab")
def w_table_index(s, d):
    return workflow.table_index(task_tables(s, d)).select("table", "in_degree", "out_degree")


@query(f"""WITH {_T}, x AS (SELECT r, min('dws.n' || k) AS a FROM n GROUP BY r), y AS (SELECT r, unnest([a, 'dws.reg' || r]) AS name, unnest([0, 1]) AS o FROM x UNION ALL SELECT min(r), 'src.reg' || min(r), -1 FROM x UNION ALL SELECT max(r), 'tmp.log' || max(r), 2 FROM x)
 SELECT row_number() OVER (ORDER BY r, o)::INT AS pos, name FROM y""")
def w_longest_chain(s, d):
    return s.createDataFrame([(i, n) for i, n in enumerate(workflow.analyze(s, samples.snapshot(s, d))["chain"], 1)], "pos int, name string")


@query(f"WITH {_T} SELECT 'p' AS project, 'region' || (w - 1) AS workflow, CASE WHEN k < 2000 THEN 't' || (k - 1000) ELSE 'gather' || (k - 2000) END AS task, dir AS direction FROM tt WHERE tab = 'dws.reg1'")
def w_tasks_of_table(s, d):
    x = samples.snapshot(s, d)
    return workflow.tasks_of_table(x, workflow.task_tables(s, x.tasks)[0], "reg1").select("project", "workflow", "task", "direction")


@query(f"WITH {_T}, x AS (SELECT n.r, count(*) + 1 + (any_value(b) IS NOT NULL)::INT AS tasks FROM n JOIN p ON n.r = p.r GROUP BY n.r) SELECT 'region' || r AS workflow, tasks::BIGINT AS tasks, string_agg(DISTINCT tab, ',' ORDER BY tab) AS written FROM x JOIN tt ON w = r + 1 WHERE dir = 'write' GROUP BY r, tasks")
def w_project_detail(s, d):
    x = samples.snapshot(s, d)
    return workflow.project_detail(x, workflow.task_tables(s, x.tasks)[0], "P").withColumn("written", F.array_join("written", ","))


@query(f"WITH {_T} SELECT a.w::BIGINT AS workflow_code, a.tab AS \"table\" FROM tt a JOIN tt b ON a.w = b.w AND a.tab = b.tab AND a.dir = 'write' AND b.dir = 'read' GROUP BY ALL")
def w_internal_tables(s, d):
    return workflow.table_dependencies(task_tables(s, d))


@query(f"""WITH RECURSIVE {_T}, e AS (SELECT DISTINCT a.tab AS source, b.tab AS target FROM tt a JOIN tt b ON a.k = b.k AND a.dir = 'read' AND b.dir = 'write' WHERE a.tab <> b.tab AND NOT (b.tab LIKE 'tmp.%' AND a.tab NOT LIKE 'dws.reg%')),
 top AS (SELECT 'dws.reg' || max(r) AS name FROM p), l AS (SELECT name, 0 AS level FROM top UNION SELECT source, level + 1 FROM l JOIN e ON name = target WHERE level < 20)
 SELECT x.name, x.level, coalesce(string_agg(DISTINCT tt.k::VARCHAR, ',' ORDER BY tt.k::VARCHAR), '') AS tasks FROM (SELECT name, min(level)::INT AS level FROM l GROUP BY name HAVING min(level) > 0) x LEFT JOIN tt ON tt.tab = x.name AND tt.dir = 'write' GROUP BY ALL""")
def w_annotated_upstream(s, d):
    tt, _, records = workflow.task_tables(s, samples.snapshot(s, d).tasks)
    g = Graph.of_pairs(edges_frame(statements_frame(s, records)))
    top = t(s, d, "nation").agg(F.max("n_regionkey")).first()[0]
    return workflow.annotated(g, tt, f"dws.reg{top}").withColumn("tasks", F.array_join(F.transform("tasks", lambda x: x.cast("string")), ","))


@query(f"WITH {_T}, m AS (SELECT lower(s_name) AS x, 'dws.n' || s_nationkey AS tab FROM supplier) SELECT w::BIGINT AS workflow_code, k::BIGINT AS task_code, count(x)::BIGINT AS n_metrics FROM tt LEFT JOIN m ON m.tab = tt.tab WHERE dir = 'write' GROUP BY ALL")
def w_attributed_metrics(s, d):
    known = t(s, d, "supplier").select(F.concat(F.lit("DWS.N"), F.col("s_nationkey").cast("string")).alias("table_name"), F.col("s_name").alias("metric_name"))
    return workflow.attribute_metrics(task_tables(s, d), known)


# ---- validation

PAIRS = [("src.a", "dws.b", "s1"), ("dws.b", "ads.c", "s2"), ("ads.c", "dws.b", "s3"), ("zz.q", "ads.c", "s2"), ("ods.x", "dwd.y", "s4")]
_P = f"p AS ({values(PAIRS, 'source, target, stage')})"


def _pairs(s):
    return s.createDataFrame(PAIRS, "source string, target string, stage string")


@query(values([("src.a -> dws.b",), ("ads.c -> dws.b",)], "subject"))
def v_layer_rule(s, d):
    return generate.layer_issues(_pairs(s)).select("subject")


@query(f"WITH {_P} SELECT 'dangling' AS type, name AS subject FROM (SELECT target AS name FROM p EXCEPT SELECT source FROM p) WHERE split_part(name, '.', 1) NOT IN ('ads', 'app') UNION ALL SELECT 'orphan', name FROM (SELECT source AS name FROM p EXCEPT SELECT target FROM p) WHERE split_part(name, '.', 1) NOT IN ('src', 'ods', 'dim')")
def v_ends(s, d):
    return generate.end_issues(_pairs(s), s.createDataFrame([], "name string")).select("type", "subject")


@query(values([("ads.c", "ads.c -> dws.b")], "subject, message"))
def v_cycles(s, d):
    return generate.cycle_issues(_pairs(s)).select("subject", "message")


def queries() -> dict:
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in Q.items() if sql}
