"""SELECT a docstring FROM nowhere"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.getOrCreate()
q = """INSERT INTO ads.ads_a SELECT x FROM dws.dws_a"""
day = "2026-01-01"
spark.sql(q)
spark.sql(f"SELECT * FROM ods.a WHERE dt = '{day}'")
spark.sql(unknown)
