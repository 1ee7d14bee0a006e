"""Plan order, tenant lists and start-up checks; all of them over a handful of declarations on the driver."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import ConfigurationError, Entity, Strategy, Tenant


def execution_order(entities: list[Entity]) -> list[Entity]:
    """Entities that refer to others come before those; names break ties; a cycle is a configuration error."""
    by_name = {e.name: e for e in entities}
    waits = {n: 0 for n in by_name}
    for e in entities:
        for p in set(e.parents) - {e.name}:
            if p in waits:
                waits[p] += 1
    ready = [n for n, k in waits.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        e = by_name[heapq.heappop(ready)]
        out.append(e)
        for p in set(e.parents) - {e.name}:
            if p in waits:
                waits[p] -= 1
                if not waits[p]:
                    heapq.heappush(ready, p)
    if len(out) < len(by_name):
        raise ConfigurationError([f"foreign keys form a cycle: {', '.join(sorted(set(by_name) - {e.name for e in out}))}"])
    return out


def first_of_each(tenants: list[Tenant]) -> tuple[list[Tenant], list[str]]:
    """The first context of each tenant id in order of arrival, and ids whose later contexts differ from it."""
    first: dict[str, Tenant] = {}
    conflicts = [t.id for t in tenants if first.setdefault(t.id, t) != t]
    return list(first.values()), list(dict.fromkeys(conflicts))


def validate(entities: list[Entity], frames: dict[str, DataFrame], capabilities: dict[str, frozenset[Strategy]]) -> None:
    """All problems of a configuration at once: names and ids, capabilities, columns and types, cascades, cycles."""
    problems = [f"{n}: registered {k} times" for n, k in Counter(e.name for e in entities).items() if k > 1]
    problems += [f"entity id {i} is used {k} times" for i, k in Counter(e.entity_id.lower() for e in entities).items() if k > 1]
    retained = {e.name for e in entities if not e.exempt}
    for e in entities:
        if e.exempt:
            continue
        able = capabilities.get(e.category, frozenset())
        if not able:
            problems.append(f"{e.name}: category {e.category} has no strategy")
        types = {f.name: f for f in frames[e.name].schema}
        for role in (e.record_id, e.anchor, *([e.tenant] if e.tenant else []), *e.subjects):
            if role not in types:
                problems.append(f"{e.name}: no column {role}")
        if e.anchor in types and not isinstance(types[e.anchor].dataType, T.TimestampType):
            problems.append(f"{e.name}: {e.anchor} must be a timestamp with time zone")
        if len({types[s].dataType.simpleString() for s in e.subjects if s in types}) > 1:
            problems.append(f"{e.name}: subject columns differ in type")
        if Strategy.SOFT_DELETE in able and not isinstance(getattr(types.get(e.is_deleted), "dataType", None), T.BooleanType):
            problems.append(f"{e.name}: soft deletion needs a boolean {e.is_deleted}")
        if Strategy.ANONYMISE in able:
            if not e.fields:
                problems.append(f"{e.name}: nothing to anonymise")
            if not isinstance(getattr(types.get(e.anonymised_at), "dataType", None), T.TimestampType):
                problems.append(f"{e.name}: anonymisation needs a timestamp {e.anonymised_at}")
            for f in e.fields:
                if f.column not in types:
                    problems.append(f"{e.name}: no column {f.column}")
                elif isinstance(f.literal, str) and not isinstance(types[f.column].dataType, T.StringType):
                    problems.append(f"{e.name}: {f.column} isn't text")
    parents_of = {e.name: set(e.cascades) for e in entities}
    for e in entities:
        seen, front = set(), set(parents_of.get(e.name, ()))
        while front:
            seen |= front
            front = set().union(*(parents_of.get(p, set()) for p in front)) - seen
        if e.name in retained and seen:
            problems.append(f"{e.name}: deleting {', '.join(sorted(seen))} would cascade into it")
    try:
        execution_order([e for e in entities if not e.exempt])
    except ConfigurationError as error:
        problems += error.problems
    if problems:
        raise ConfigurationError(problems)


def repeated_ids(df: DataFrame, entity: Entity) -> DataFrame:
    """Record ids that aren't unique or are null: (record_id, rows)."""
    return df.groupBy(F.col(entity.record_id).cast("string").alias("record_id")).agg(F.count("*").alias("rows")).where("rows > 1 or record_id is null")
