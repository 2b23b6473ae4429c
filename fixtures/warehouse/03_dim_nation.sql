CREATE TABLE IF NOT EXISTS dim.nation COMMENT '国家维表' AS
SELECT n.n_nationkey, n.n_name, r.r_name AS region_name
FROM src.nation n JOIN src.region r ON n.n_regionkey = r.r_regionkey;
