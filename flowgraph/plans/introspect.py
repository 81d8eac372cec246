"""A look at plans."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What explain() prints."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def operators(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan of df (of un-cached inputs)."""
    lines = (line.lstrip(" :+-*") for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
    return Counter(line.split("(")[-1].split(") ")[-1].split(" ")[0] if line.startswith("(") else line.split(" ")[0].split("(")[0] for line in lines if line)
