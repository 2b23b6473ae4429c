INSERT OVERWRITE TABLE dwd.dwd_order_line
WITH valid AS (
    SELECT o_orderkey, o_custkey, o_orderdate FROM ods.orders WHERE o_orderstatus <> 'P'
)
SELECT
    l.l_orderkey AS order_key,
    v.o_custkey AS cust_key,
    v.o_orderdate AS order_date,
    l.l_quantity AS qty,                                        -- 数量（件）
    l.l_extendedprice * (1 - l.l_discount) AS net_amt,          -- 净额（元）
    CASE WHEN l.l_quantity > 25 THEN 1 ELSE 0 END AS is_big     -- 大单标志
FROM ods.lineitem l
JOIN valid v ON l.l_orderkey = v.o_orderkey
WHERE l.dt = '2026-01-01';
