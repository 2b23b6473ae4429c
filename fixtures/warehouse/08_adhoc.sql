SELECT b.nation_name FROM ads.ads_board b WHERE b.total_amt > 10 ORDER BY b.nation_name LIMIT 5;
