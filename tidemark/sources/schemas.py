"""Fixed schemas of the library's own tables, checked instead of inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def struct(columns: str, required: str = "") -> T.StructType:
    """A schema from "name kind, ..." without a session; columns not named in ``required`` are nullable."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(n, _KINDS[k], n not in required.split()) for n, k in pairs])


HOLDS = struct("hold_id string, entity_id string, record_id string, tenant_id string, reason string, created_at timestamp, expires_at timestamp, removed_at timestamp", "hold_id entity_id record_id reason created_at")
RUNS = struct("run_id string, started_at timestamp, status int, settled_at timestamp, duration_seconds long, trigger int, dry_run boolean, tenant_id string, total_affected long, error string", "run_id started_at status trigger dry_run tenant_id")
SUMMARIES = struct("run_id string, entity_id string, category string, tenant_id string, strategy int, at timestamp, entity string, period_seconds long, affected long, held long, skipped long, null_anchor long, rule_source string, rule_reason string", "run_id entity_id category tenant_id strategy at entity period_seconds affected held skipped null_anchor")
DETAILS = struct("id long, run_id string, at timestamp, entity string, entity_id string, record_id string, category string, strategy int, tenant_id string, payload string", "id run_id at entity entity_id record_id category strategy tenant_id")
QUEUE = struct("id long, detail_id long, handler string, phase int, state int, attempt int, queued_at timestamp, next_attempt_at timestamp, claimed_at timestamp, claim_token string, completed_at timestamp, last_error string", "id detail_id handler phase state attempt queued_at next_attempt_at")
ROLES = {"holds": HOLDS, "runs": RUNS, "summaries": SUMMARIES, "details": DETAILS, "queue": QUEUE}


class SchemaError(ValueError):
    """A table doesn't have the schema that the library relies on."""


def check(df: DataFrame, want: T.StructType, name: str = "table") -> DataFrame:
    """``df`` if every wanted column is there with its type; extra columns are allowed, naive timestamps are not."""
    have, wrong = {f.name: f.dataType for f in df.schema}, []
    for f in want:
        if f.name not in have:
            wrong.append(f"{name}: no column {f.name}")
        elif have[f.name] != f.dataType:
            wrong.append(f"{name}.{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}")
    if wrong:
        raise SchemaError("; ".join(dict.fromkeys(wrong)))
    return df


def read(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The five tables by role; all roles must be mapped or none."""
    if set(paths) != set(ROLES):
        raise SchemaError(f"map all of {', '.join(ROLES)}")
    return {role: spark.read.schema(schema).parquet(paths[role]) for role, schema in ROLES.items()}
