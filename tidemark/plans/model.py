"""What a host declares: entities, rules, tenants, options; and the values of runs.  Every object checks itself."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from enum import IntEnum

from tidemark.functions.periods import ZERO

TENANTLESS = "00000000-0000-0000-0000-000000000000"


#: Handlers of an entity at most; their queue ids follow from the row's.
MOST_HANDLERS = 64


class ConfigurationError(ValueError):
    """All that is wrong with a configuration, each message once."""

    def __init__(self, problems: Iterable[str]):
        self.problems = list(dict.fromkeys(problems))
        super().__init__("\n".join(self.problems))


class AliasCycleError(ValueError):
    """Raised by rule providers whose category aliases form a cycle."""


class Strategy(IntEnum):
    PURGE = 0
    SOFT_DELETE = 1
    ANONYMISE = 2
    EXEMPT = 3


class Detail(IntEnum):
    SUMMARY_ONLY = 0
    PER_ROW = 1
    INHERIT = 2


class RunStatus(IntEnum):
    STARTED = 0
    SUCCEEDED = 1
    PARTIALLY_FAILED = 2
    FAILED = 3
    CANCELLED = 4


class Trigger(IntEnum):
    SCHEDULED = 0
    ERASURE = 1
    MANUAL = 2


class State(IntEnum):
    PENDING = 0
    IN_FLIGHT = 1
    SUCCEEDED = 2
    DEAD_LETTERED = 3


class Phase(IntEnum):
    IMMEDIATE = 0
    AFTER_RUN_SETTLED = 1


class Mode(IntEnum):
    """How often a factory is called: once per pass, once per row, or once per row with the row's value."""

    STATIC = 0
    PER_ROW = 1
    PER_ROW_WITH_ORIGINAL = 2


@dataclass(frozen=True)
class Anonymised:
    """A column and what replaces it: a literal (None: null), or a factory's value."""

    column: str
    literal: object = None
    factory: Callable | None = None
    mode: Mode = Mode.STATIC


@dataclass(frozen=True)
class FactoryContext:
    """What a factory of two arguments is called for; the original value is its first argument."""

    entity: str
    column: str
    now: datetime
    tenant_id: str | None


@dataclass(frozen=True)
class Handler:
    """A row handler: ``before(row, context)`` gives a snapshot of a row about to change, or fails, which leaves the
    row as it is; ``after(context, snapshot)`` runs from the queue once the change is committed.  ``name`` is its
    identity in the queue and must stay the same."""

    name: str
    before: Callable[[dict, dict], dict | None] | None = None
    after: Callable[[dict, dict], None] | None = None
    phase: Phase = Phase.IMMEDIATE
    priority: int | None = None


def in_order(handlers: Iterable[Handler]) -> list[Handler]:
    """By priority, those without one last, then by name.  A name registered twice in the same way counts once, in
    different ways is a configuration error."""
    known: dict[str, Handler] = {}
    clashes = [h.name for h in handlers if known.setdefault(h.name, h) != h]
    if clashes:
        raise ConfigurationError([f"handler {n} is registered in different ways" for n in clashes])
    if len(known) > MOST_HANDLERS:
        raise ConfigurationError([f"an entity can have {MOST_HANDLERS} handlers"])
    return sorted(known.values(), key=lambda h: (h.priority is None, h.priority or 0, h.name))


@dataclass(frozen=True)
class Entity:
    name: str
    entity_id: str
    category: str | None
    anchor: str
    record_id: str = "id"
    record_id_type: str = "string"
    tenant: str | None = "tenant_id"
    is_deleted: str = "is_deleted"
    deleted_at: str | None = "deleted_at"
    anonymised_at: str = "anonymised_at"
    fields: tuple[Anonymised, ...] = ()
    subjects: tuple[str, ...] = ()
    detail: Detail = Detail.INHERIT
    parents: tuple[str, ...] = ()
    cascades: tuple[str, ...] = ()
    exempt: bool = False

    def __post_init__(self):
        problems = []
        try:
            uuid.UUID(self.entity_id)
        except ValueError:
            problems.append(f"{self.name}: the entity id must be a UUID")
        if self.exempt == (self.category is not None):
            problems.append(f"{self.name}: declare either a category or an exemption")
        fixed = {self.record_id, self.tenant, self.anchor, self.is_deleted, self.deleted_at, self.anonymised_at, *self.subjects}
        for f in self.fields:
            if f.column in fixed - {None, *self.subjects}:
                problems.append(f"{self.name}: {f.column} has another role and can't be anonymised")
        if len({f.column for f in self.fields}) < len(self.fields):
            problems.append(f"{self.name}: a column is anonymised twice")
        if problems:
            raise ConfigurationError(problems)


@dataclass(frozen=True)
class Rule:
    period: timedelta
    strategy: Strategy
    legal_minimum: timedelta | None = None
    detail: Detail = Detail.SUMMARY_ONLY
    source: str | None = None
    reason: str | None = None

    def __post_init__(self):
        if self.period < ZERO or (self.legal_minimum or ZERO) < ZERO:
            raise ConfigurationError(["periods can't be negative"])
        if self.detail == Detail.INHERIT:
            raise ConfigurationError(["only an entity's detail can be inherited"])
        Strategy(self.strategy)


@dataclass(frozen=True)
class Tenant:
    id: str
    jurisdiction: str | None = None
    tags: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.id or self.id == TENANTLESS:
            raise ConfigurationError(["a tenant needs an id"])
        object.__setattr__(self, "tags", dict(self.tags))


@dataclass(frozen=True)
class Options:
    batch: int = 5000
    dry_run: bool = False
    enabled: bool = True
    dispatch_batch: int | None = None
    dispatch_parallelism: int | None = None
    max_attempts: int = 10
    base_backoff: timedelta = timedelta(seconds=1)
    lease: timedelta = timedelta(minutes=5)
    payload_retention: timedelta = timedelta(days=7)
    observer_timeout: timedelta = timedelta(seconds=5)
    run_timeout: timedelta = timedelta(hours=24)

    def __post_init__(self):
        bounds = {"batch": (1, None), "dispatch_batch": (1, 10_000), "dispatch_parallelism": (1, 256), "max_attempts": (1, 1000), "lease": (timedelta(seconds=30), None), "payload_retention": (timedelta(hours=1), None), "run_timeout": (timedelta(minutes=1), None), "base_backoff": (ZERO, None), "observer_timeout": (timedelta(microseconds=1), None)}
        problems = [f"{k} must lie in {a}..{b or ''}" for k, (a, b) in bounds.items() if getattr(self, k) is not None and (getattr(self, k) < a or (b is not None and getattr(self, k) > b))]
        if problems:
            raise ConfigurationError(problems)


@dataclass(frozen=True)
class Count:
    """What a pass found or did for one entity and tenant."""

    entity: str
    category: str
    tenant_id: str
    strategy: Strategy
    affected: int = 0
    held: int = 0
    skipped: int = 0
    null_anchor: int = 0

    def __post_init__(self):
        if min(self.affected, self.held, self.skipped, self.null_anchor) < 0:
            raise ValueError("counts can't be negative")


class RuleBook:
    """The usual rule provider: a rule per category, or per category and tenant, and what a category may do."""

    def __init__(self, rules: dict, capabilities: dict[str, set[Strategy]] | None = None):
        self.rules = dict(rules)
        names = {k if isinstance(k, str) else k[0] for k in rules}
        own = {n: {r.strategy for k, r in rules.items() if (k if isinstance(k, str) else k[0]) == n} for n in names}
        self.capabilities = {n: frozenset(s) for n, s in (capabilities or own).items()}
        if any(not s for s in self.capabilities.values()):
            raise ConfigurationError(["a category needs a strategy"])

    def resolve(self, category: str, tenant: Tenant | None, now: datetime) -> Rule:
        rule = self.rules.get((category, tenant.id if tenant else None)) or self.rules.get(category)
        if rule is None:
            raise ConfigurationError([f"no rule for category {category}"])
        if rule.strategy not in self.capabilities.get(category, ()):
            raise ConfigurationError([f"category {category} doesn't declare {rule.strategy.name}"])
        return rule


def utc(text: str) -> datetime:
    return datetime.fromisoformat(re.sub("Z$", "+00:00", text)).replace(tzinfo=UTC)
