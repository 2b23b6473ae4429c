INSERT OVERWRITE TABLE dws.dws_cust
SELECT cust_key, SUM(net_amt - 0) AS cust_amt,
       ROW_NUMBER() OVER (PARTITION BY is_big ORDER BY net_amt DESC) AS rn
FROM (SELECT cust_key, net_amt, is_big FROM dwd.dwd_order_line UNION ALL SELECT c_custkey, 0, 0 FROM ods.customer) u
GROUP BY cust_key, is_big, net_amt;
