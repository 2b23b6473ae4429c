"""weftline: warehouse lineage and corpus analytics on PySpark."""
