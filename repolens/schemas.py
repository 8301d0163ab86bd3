"""Schemas of the workflow tables, and conforming older tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
BOOLEAN, TIMESTAMP, BINARY = T.BooleanType(), T.TimestampType(), T.BinaryType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, type_) for name, type_ in fields.items()])


FILES = struct(repo_id=STRING, path=STRING, size=LONG, content=BINARY)

FINDINGS = struct(
    repo_id=STRING, file_path=STRING, line_number=INT, category=STRING, severity=STRING, title=STRING,
    description=STRING, evidence=STRING, suggested_fix=STRING, confidence=DOUBLE,
    seq=struct(stage=INT, path=STRING, a=LONG, b=LONG, c=LONG),
)

REPOSITORIES = struct(
    repo_id=STRING, name=STRING, source_url=STRING, local_path=STRING, tech_stack=STRING, test_framework=STRING,
    status=STRING, created_at=TIMESTAMP, health_score_before=INT, health_score_after=INT, scan_metadata=STRING,
)

ISSUES = struct(
    issue_id=STRING, repo_id=STRING, severity=STRING, category=STRING, title=STRING, description=STRING,
    file_path=STRING, line_number=INT, evidence=STRING, suggested_fix=STRING, confidence=DOUBLE, root_cause=STRING,
    affected_files=STRING, fix_plan=STRING, status=STRING, detected_at=TIMESTAMP,
)

FIX_JOBS = struct(
    job_id=STRING, issue_id=STRING, repo_id=STRING, prompt=STRING, output=STRING, diff=STRING, status=STRING,
    attempt_number=INT, started_at=TIMESTAMP, completed_at=TIMESTAMP,
)

TEST_RUNS = struct(
    run_id=STRING, repo_id=STRING, job_id=STRING, output=STRING, passed=BOOLEAN, tests_total=INT, tests_passed=INT,
    tests_failed=INT, ran_at=TIMESTAMP,
)

EVENTS = struct(
    event=STRING, job_id=STRING, repo_id=STRING, seq=LONG, ts=TIMESTAMP, step=STRING, pct=INT, message=STRING,
    line=STRING, diff=STRING, output=STRING, fix_job_id=STRING, run_id=STRING, passed=BOOLEAN, tests_total=INT,
    tests_passed=INT, tests_failed=INT, total_issues=INT,
    issue=struct(id=STRING, severity=STRING, category=STRING, title=STRING, file_path=STRING, line_number=INT),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns ``schema`` declares and ``df`` lacks, as nulls of the declared type.

    Columns already there keep their values and type, unknown ones stay at the end; doing it twice
    changes nothing.
    """
    declared = [
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*declared, *[c for c in df.columns if c not in schema.names])
