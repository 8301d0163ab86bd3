"""Facts of Python sources for SQL: ``SELECT * FROM files, LATERAL ast_defs(content)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from repolens.operators.facts import file_facts


class AstDefs:
    """The functions defined in a source, with their lines; none if it does not parse."""

    def eval(self, content: str):
        for d in file_facts(content or "").get("defs", []):
            yield d["name"], d["line"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("ast_defs", udtf(AstDefs, returnType="name string, line int"))
