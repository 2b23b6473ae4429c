INSERT OVERWRITE TABLE dws.dws_nation_day
SELECT
    d.n_name AS nation_name,
    t.order_date,
    SUM(t.qty) AS total_qty,                        -- 总数量
    SUM(t.net_amt) AS total_amt,                    -- 总净额
    SUM(t.net_amt) / SUM(t.qty) AS unit_price,      -- 均价
    COUNT(DISTINCT t.cust_key) AS cust_cnt
FROM dwd.dwd_order_line t
LEFT JOIN ods.customer c ON t.cust_key = c.c_custkey
LEFT JOIN dim.nation d ON c.c_nationkey = d.n_nationkey
GROUP BY d.n_name, t.order_date
HAVING SUM(t.qty) > 0;
