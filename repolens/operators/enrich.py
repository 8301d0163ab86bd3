"""Root causes, fix plans and fix requests of issues.

The texts are few and fixed, so they are literal columns: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions import jsontext as J
from repolens.functions.prompts import build_fix_prompt


def _by_category(category: Column, texts: dict) -> Column:
    """A literal struct per category, with a default for other ones."""
    choice = None
    for name, value in texts.items():
        choice = F.when(category == name, value) if choice is None else choice.when(category == name, value)
    return choice.otherwise(texts[K.DEFAULT_CATEGORY])


def root_cause(category: Column, file_path: Column) -> Column:
    """``struct(root_cause, affected_lines, fix_strategy)``; ``affected_lines`` holds the file path."""
    text = _by_category(
        category,
        {c: F.struct(F.lit(cause).alias("cause"), F.lit(fix).alias("fix")) for c, (cause, fix) in K.ROOT_CAUSES.items()},
    )
    return F.struct(
        text.cause.alias("root_cause"), F.array(file_path).alias("affected_lines"), text.fix.alias("fix_strategy")
    )


def fix_plan(category: Column, file_path: Column) -> Column:
    """``struct(steps, files_to_change, risk_level)``."""
    plan = _by_category(
        category,
        {c: F.struct(F.array(*map(F.lit, steps)).alias("steps"), F.lit(risk).alias("risk"))
         for c, (steps, risk) in K.FIX_PLANS.items()},
    )
    return F.struct(
        plan.steps.alias("steps"), F.array(F.coalesce(file_path, F.lit(""))).alias("files_to_change"), plan.risk.alias("risk_level")
    )


def with_root_cause(issues: DataFrame) -> DataFrame:
    return issues.withColumn("root_cause", root_cause(F.col("category"), F.col("file_path")))


def with_fix_plan(issues: DataFrame) -> DataFrame:
    return issues.withColumn("fix_plan", fix_plan(F.col("category"), F.col("file_path")))


def with_stored_plan(issues: DataFrame) -> DataFrame:
    """The plan kept on the issue: ``fix_plan`` as JSON text, which :func:`with_fix_prompt` reads back."""
    return issues.withColumn("fix_plan", F.to_json(fix_plan(F.col("category"), F.col("file_path"))))


def with_fix_prompt(issues: DataFrame) -> DataFrame:
    """Adds ``prompt``; ``fix_plan`` is the JSON text of a plan, or null."""
    return issues.withColumn(
        "prompt",
        build_fix_prompt(
            F.col("file_path"), F.col("line_number"), F.col("title"), F.col("description"), F.col("evidence"),
            F.col("suggested_fix"), J.plan_steps(F.col("fix_plan")),
        ),
    )
