"""Table function for SQL: statements found in a script's text."""

from __future__ import annotations

from pyspark.sql.functions import udtf


@udtf(returnType="seq int, sql string, source_hint string, line int, note string, resolved boolean")
class ExtractSqls:
    """extract_sqls(text, task_type)"""

    def eval(self, text: str, task_type: str):
        from weftline.operators.scripts import extract

        for i, e in enumerate(extract(text or "", task_type=task_type).entries):
            yield i, e.sql, e.hint, e.line, e.note, e.resolved


def register(spark) -> None:
    from weftline.runtime import ship

    ship(spark)
    spark.udtf.register("extract_sqls", ExtractSqls)
