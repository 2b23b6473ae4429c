"""The SQL forms of a warehouse, executed on the driver's tables with the DataFrame API, and the same in SQL.

``FORMS[name] = (query, sql)``; query takes (spark, sf_dir). Sums of doubles are rounded, counts are 64-bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


FORMS: dict[str, tuple] = {}


def form(sql: str):
    def add(f):
        FORMS[f.__name__] = (f, sql)
        return f

    return add


@form("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
 round(avg(l_discount), 6) AS avg_disc, count(*) AS n, max(l_quantity) AS max_qty, min(l_quantity) AS min_qty FROM lineitem GROUP BY ALL""")
def q_group_by(s, d):
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(rev), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"), F.max("l_quantity").alias("max_qty"), F.min("l_quantity").alias("min_qty"),
    )


@form("SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS va, median(l_quantity) AS med FROM lineitem GROUP BY ALL")
def q_stats_aggregates(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev("l_quantity"), 4).alias("sd"), F.round(F.variance("l_quantity"), 4).alias("va"), F.median("l_quantity").alias("med"))


@form("""SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk,
 dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def q_window_rank(s, d):
    w, v = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"))


@form("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run FROM orders")
def q_running_sum(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("run"))


@form("""SELECT o_orderkey, round(o_totalprice - lag(o_totalprice, 1, 0.0) OVER w, 2) AS diff, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS f, ntile(4) OVER w AS q
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def q_lag_lead(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(s, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice", 1, 0.0).over(w), 2).alias("diff"), F.lead("o_orderkey").over(w).alias("nxt"), F.first("o_orderkey").over(w).alias("f"), F.ntile(4).over(w).alias("q"))


@form("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g, count(*) AS n, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def q_grouping_sets(s, d):
    t(s, d, "lineitem").createOrReplaceTempView("wf_lineitem")
    return s.sql("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n, count(DISTINCT l_suppkey) AS supps FROM wf_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")


@form("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def q_rollup(s, d):
    return t(s, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@form("SELECT l_returnflag, l_linestatus, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def q_cube(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_tax"), 4).alias("tax"))


@form("""SELECT n_name, r_name, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def q_four_table_join(s, d):
    x = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name", "c_mktsegment").agg(F.count("*").alias("n"))


@form("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def q_left_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@form("SELECT s_name, o_orderkey, o_totalprice FROM supplier FULL JOIN orders ON s_suppkey = o_custkey AND s_acctbal > o_totalprice / 10")
def q_full_join(s, d):
    on = (F.col("s_suppkey") == F.col("o_custkey")) & (F.col("s_acctbal") > F.col("o_totalprice") / 10)
    return t(s, d, "supplier").join(t(s, d, "orders"), on, "full").select("s_name", "o_orderkey", "o_totalprice")


@form("SELECT s_name, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def q_right_join(s, d):
    return t(s, d, "supplier").join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_name", "n_name")


@form("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def q_cross_join_small(s, d):
    r = t(s, d, "region")
    return r.select(F.col("r_name").alias("a")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("b"))))


@form("SELECT p_partkey, count(*) AS n FROM part JOIN (SELECT DISTINCT p_size AS z FROM part) ON p_size >= z AND p_size < z + 2 GROUP BY p_partkey")
def q_range_join(s, d):
    p = t(s, d, "part")
    z = p.select(F.col("p_size").alias("z")).distinct()
    keyed = z.withColumn("k", F.explode(F.sequence(F.col("z"), F.col("z") + 1)))  # a row for each whole size the range holds: an equi-join
    return p.join(keyed, F.col("p_size") == F.col("k")).groupBy("p_partkey").agg(F.count("*").alias("n"))


@form("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def q_semi_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@form("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_anti_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@form("SELECT p_partkey, p_brand FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
def q_correlated_scalar(s, d):
    t(s, d, "part").createOrReplaceTempView("wf_part")
    return s.sql("SELECT p_partkey, p_brand FROM wf_part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM wf_part q WHERE q.p_brand = p.p_brand)")


@form("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def q_in_subquery(s, d):
    o = t(s, d, "orders").join(t(s, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return o.join(t(s, d, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@form("""WITH rev AS (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS r FROM lineitem GROUP BY l_suppkey), big AS (SELECT * FROM rev WHERE r > (SELECT avg(r) FROM rev))
 SELECT n_name, count(*) AS n, round(sum(r), 2) AS r FROM big JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def q_multi_cte(s, d):
    rev = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("r"))
    big = rev.join(F.broadcast(rev.agg(F.avg("r").alias("a"))), F.col("r") > F.col("a"))
    x = big.join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("r"), 2).alias("r"))


@form("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def q_union_all(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).groupBy("k").agg(F.count("*").alias("n"))


@form("""SELECT 'u' AS op, c_nationkey AS k FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL
 SELECT 'i', c_nationkey FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
 SELECT 'e', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def q_set_operations(s, d):
    a, b = t(s, d, "customer").select(F.col("c_nationkey").alias("k")), t(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda x, n: x.select(F.lit(n).alias("op"), "k")
    return tag(a.union(b).distinct(), "u").union(tag(a.intersect(b), "i")).union(tag(a.subtract(b), "e"))


@form("SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def q_explode_split(s, d):
    return t(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@form("SELECT p_partkey, i - 1 AS pos, string_split(p_name, ' ')[i] AS w FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def q_posexplode(s, d):
    return t(s, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "w")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "w")


@form("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segs, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey")
def q_collect_set(s, d):
    return t(s, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segs"), F.size(F.collect_set("c_mktsegment")).cast("long").alias("n"))


@form("""SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / nullif(sum(o_totalprice), 0), 6) AS ratio,
 sum(CASE WHEN o_totalprice > 100000 AND o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END)::BIGINT AS big FROM orders GROUP BY o_orderpriority""")
def q_case_ratio(s, d):
    f = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0)) / F.nullif(F.sum("o_totalprice"), F.lit(0))
    big = F.sum(F.when((F.col("o_totalprice") > 100000) & F.col("o_orderstatus").isin("O", "P"), 1).otherwise(0))
    return t(s, d, "orders").groupBy("o_orderpriority").agg(F.round(f, 6).alias("ratio"), big.alias("big"))


@form("""SELECT s_suppkey, upper(trim(s_name)) AS u, coalesce(nullif(substr(s_name, 1, 3), 'Sup'), 'none') AS c, concat_ws('-', s_name, s_nationkey::VARCHAR) AS w, round(s_acctbal::DECIMAL(12,2), 1)::DOUBLE AS b,
 greatest(s_acctbal, 0) AS g, length(s_name) AS n, replace(s_name, '0', '') AS r, md5(s_name) AS m FROM supplier""")
def q_scalar_functions(s, d):
    c = F.col
    return t(s, d, "supplier").select(
        "s_suppkey", F.upper(F.trim("s_name")).alias("u"), F.coalesce(F.nullif(F.substring("s_name", 1, 3), F.lit("Sup")), F.lit("none")).alias("c"), F.concat_ws("-", "s_name", c("s_nationkey").cast("string")).alias("w"),
        F.round(c("s_acctbal").cast("decimal(12,2)"), 1).cast("double").alias("b"), F.greatest("s_acctbal", F.lit(0.0)).alias("g"), F.length("s_name").cast("long").alias("n"), F.replace("s_name", F.lit("0"), F.lit("")).alias("r"), F.md5(c("s_name").cast("binary")).alias("m"),
    )


@form("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM orders""")
def q_date_functions(s, d):
    o = F.to_date("o_orderdate")
    return t(s, d, "orders").select("o_orderkey", F.year(o).cast("long").alias("y"), F.month(o).cast("long").alias("m"), F.day(o).cast("long").alias("d"), F.datediff(o, F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.date_format(o, "yyyy-MM").alias("ym"))


@form("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def q_count_distinct(s, d):
    return t(s, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps"), F.countDistinct("l_orderkey").alias("orders"))


@form("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def q_top_k(s, d):
    return t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@form("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def q_qualify_first(s, d):
    # the latest row of each key as an aggregate: combined before the shuffle, no sort
    last = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", -F.col("o_orderkey")))
    return t(s, d, "orders").groupBy("o_custkey").agg(last.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@form("SELECT event_type, count(*) AS n, round(sum(value), 3) AS v, count(DISTINCT user_id) AS users FROM events GROUP BY event_type HAVING count(*) > 5")
def q_having(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("v"), F.countDistinct("user_id").alias("users")).where("n > 5")


@form("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@form("SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_tumbling_window(s, d):
    return t(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("h"), "event_type", "n")


@form("SELECT n_regionkey AS k, {'n': count(*), 'first': min(n_name)}.first AS first, map([min(n_name)], [count(*)])[min(n_name)] AS n FROM nation GROUP BY n_regionkey")
def q_struct_map(s, d):
    x = t(s, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.struct(F.count("*").alias("n"), F.min("n_name").alias("first")).alias("s"))
    return x.select("k", F.col("s.first").alias("first"), F.create_map(F.col("s.first"), F.col("s.n"))[F.col("s.first")].alias("n"))


@form("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def q_percentile(s, d):
    t(s, d, "lineitem").createOrReplaceTempView("wf_lineitem2")
    return s.sql("SELECT l_returnflag, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM wf_lineitem2 GROUP BY l_returnflag")


# ---- forms that write: into a table of the session's warehouse, read back


_made: list[str] = []


def clean(s: SparkSession) -> None:
    """Drops the tables that this process's queries made. Their results must be read by then."""
    while _made:
        s.sql(f"DROP TABLE IF EXISTS {_made.pop()}")


def _into(s: SparkSession, name: str, ddl: str, *statements: str) -> DataFrame:
    """A new table, filled by statements that call it {t}; the rows are read into the result's plan from its files."""
    import uuid

    table = f"wf_{name}_{uuid.uuid4().hex[:10]}"
    _made.append(table)
    s.sql(f"CREATE TABLE {table} {ddl}")
    for x in statements:
        s.sql(x.format(t=table))
    return s.table(table)


@form("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def q_insert_static_partition(s, d):
    t(s, d, "nation").createOrReplaceTempView("wf_nation")
    ddl = "(n_nationkey INT, n_name STRING, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey)"
    return _into(s, "static", ddl, "INSERT OVERWRITE TABLE {t} PARTITION (n_regionkey = 1) SELECT n_nationkey, n_name FROM wf_nation", "INSERT OVERWRITE TABLE {t} PARTITION (n_regionkey = 1) SELECT n_nationkey, n_name FROM wf_nation WHERE n_regionkey = 1")


@form("SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 3) THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
def q_insert_dynamic_partition(s, d):
    """All partitions by INSERT, then two of them anew by a dynamic overwrite, which leaves the others as they are."""
    t(s, d, "nation").createOrReplaceTempView("wf_nation")
    ddl = "(n_nationkey INT, n_name STRING, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey)"
    mode, key = s.conf.get("spark.sql.sources.partitionOverwriteMode"), "spark.sql.sources.partitionOverwriteMode"
    s.conf.set(key, "dynamic")
    try:
        return _into(
            s, "dynamic", ddl, "INSERT INTO {t} PARTITION (n_regionkey) SELECT n_nationkey, n_name, n_regionkey FROM wf_nation",
            "INSERT OVERWRITE TABLE {t} PARTITION (n_regionkey) SELECT n_nationkey, lower(n_name), n_regionkey FROM wf_nation WHERE n_regionkey IN (1, 3)",
        )
    finally:
        s.conf.set(key, mode)


@form("""SELECT doc_id, nullif(unnest(CASE WHEN coalesce(source, '') = 'src1' THEN [''] ELSE string_split(coalesce(source, ''), 'r') END), '') AS part FROM documents""")
def q_explode_outer(s, d):
    """LATERAL VIEW OUTER keeps the rows whose array has no element."""
    t(s, d, "documents").createOrReplaceTempView("wf_documents")
    return s.sql("""SELECT doc_id, nullif(part, '') AS part FROM wf_documents
      LATERAL VIEW OUTER explode(CASE WHEN source = 'src1' THEN array() ELSE split(coalesce(source, ''), 'r') END) x AS part""")


@form("SELECT r_regionkey, upper(r_name) AS u FROM region")
def q_create_as_select(s, d):
    t(s, d, "region").createOrReplaceTempView("wf_region")
    return _into(s, "ctas", "USING parquet COMMENT 'regions' TBLPROPERTIES ('a' = 'b') AS SELECT r_regionkey, upper(r_name) AS u FROM wf_region")


@form("SELECT * FROM (VALUES (1::INT, 'a'), (2, 'b')) v(k, v)")
def q_insert_values(s, d):
    return _into(s, "vals", "(k INT, v STRING) USING parquet", "INSERT INTO {t} VALUES (1, 'a'), (2, 'b')")


@form("""SELECT 'big' AS kind, o_orderkey FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'open', o_orderkey FROM orders WHERE o_orderstatus = 'O'""")
def q_multi_insert(s, d):
    t(s, d, "orders").createOrReplaceTempView("wf_orders")
    text = "FROM wf_orders INSERT INTO {t} SELECT 'big', o_orderkey WHERE o_totalprice > 300000 INSERT INTO {t} SELECT 'open', o_orderkey WHERE o_orderstatus = 'O'"
    return _into(s, "multi", "(kind STRING, o_orderkey BIGINT) USING parquet", text)


@form("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS bal FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT -s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 7 = 0""")
def q_merge(s, d):
    """MERGE without a table format that knows it: update, delete and insert as one full join."""
    old = t(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"))
    up = old.where("s_suppkey % 3 = 0 and s_suppkey % 5 <> 0").select("s_suppkey", (F.col("bal") + 1).alias("new"), F.lit("update").alias("act"))
    gone = old.where("s_suppkey % 5 = 0").select("s_suppkey", F.lit(None).cast("double").alias("new"), F.lit("delete").alias("act"))
    add = old.where("s_suppkey % 7 = 0").select((-F.col("s_suppkey")).alias("s_suppkey"), F.col("bal").alias("new"), F.lit("insert").alias("act"))
    x = old.join(up.unionByName(gone).unionByName(add), "s_suppkey", "full").where("act is null or act <> 'delete'")
    return x.select("s_suppkey", F.when(F.col("act").isNull(), F.col("bal")).otherwise(F.col("new")).alias("bal"))


@form("""SELECT d.doc_id, d.w, w.n FROM (SELECT doc_id, string_split(text, ' ')[1] AS w FROM documents) d JOIN (SELECT string_split(text, ' ')[1] AS w, count(*) AS n FROM documents GROUP BY 1) w ON d.w = w.w WHERE w.n > 1""")
def q_nested_window(s, d):
    first = t(s, d, "documents").select("doc_id", F.element_at(F.split("text", " "), 1).alias("w"))
    return first.withColumn("n", F.count("*").over(Window.partitionBy("w"))).where("n > 1")
