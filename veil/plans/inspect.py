"""Plan inspection helpers: what a DataFrame will do before it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def python_nodes(df: DataFrame) -> list[str]:
    """Python-evaluated operators in the plan (the slow path); empty for native plans."""
    plan = physical_plan(df)
    return [n for n in PYTHON_NODES if n in plan]


def exchanges(df: DataFrame) -> list[str]:
    return [line.strip() for line in physical_plan(df).splitlines() if "Exchange" in line]
