INSERT OVERWRITE TABLE ods.orders
SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM src.orders;

INSERT OVERWRITE TABLE ods.customer
SELECT c_custkey, c_nationkey, c_mktsegment FROM src.customer;
