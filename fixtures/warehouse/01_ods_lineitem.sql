-- daily copy of order lines
-- owner: warehouse
INSERT OVERWRITE TABLE ods.lineitem PARTITION (dt='2026-01-01')
SELECT
    l_orderkey,        -- 订单号
    l_partkey,         -- 零件号
    l_quantity,        -- 数量（件）
    l_extendedprice,   -- 原价（元）
    l_discount         -- 折扣率
FROM src.lineitem
WHERE l_quantity IS NOT NULL;  -- 剔除空数量
