INSERT OVERWRITE TABLE ads.ads_board
SELECT n.nation_name, n.total_amt, x.cust_amt, '看板' AS 来源
FROM dws.dws_nation_day n
JOIN dws.dws_cust x ON n.cust_cnt = x.rn;
