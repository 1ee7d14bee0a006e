"""Preview, dry run, sweep and erasure over entities, from one labelling.

Counts come from a scan that the cutoff, the tenant and the state prune.  A live pass finds the files that hold eligible
rows, labels these files' rows once, writes the labels, and derives the files that take their place, the counts and the
audit events from what was written; other files are neither read again nor rewritten.  Events and handler work are
staged and become visible with the commit, so a change and its audit come together.  What was replaced is then removed
from the disk.  Holds are read again just before the commit; newly held rows make the pass of that entity start over.
One entity's failure doesn't stop the others.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.periods import ZERO, effective_period
from tidemark.functions.text import diagnostic, encode_snapshot, record_id, shorten
from tidemark.operators import ledger
from tidemark.operators.eligibility import LABEL, countable, disposition, held_flag
from tidemark.operators.mutate import apply
from tidemark.plans.model import MOST_HANDLERS, TENANTLESS, ConfigurationError, Count, Detail, Entity, Handler, Options, Rule, RuleBook, RunStatus, State, Strategy, Tenant, Trigger, in_order
from tidemark.plans.order import execution_order, repeated_ids, validate
from tidemark.sources.schemas import DETAILS, QUEUE
from tidemark.sources.snapshots import FILE, Conflict, Lease, Snapshots, Staged

log = logging.getLogger(__name__)
HOOKED = "record_id string, handler string, error string, payload string"


@dataclass
class Result:
    run_id: str
    status: RunStatus
    counts: list[Count] = field(default_factory=list)
    failures: dict[str, str] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(c.affected for c in self.counts)


class Notifier:
    """Tells observers of committed events, in order; one that is late is left out for the rest of the run."""

    def __init__(self, observers: Iterable[Callable[[dict], None]], timeout: float):
        self.observers, self.timeout = list(observers), timeout

    def tell(self, event: dict) -> None:
        for o in list(self.observers):
            pool = ThreadPoolExecutor(1)
            try:
                pool.submit(o, dict(event)).result(self.timeout)
            except TimeoutError:
                self.observers.remove(o)
            except Exception as error:  # observers are told on a best-effort basis
                log.warning("an observer failed: %s", diagnostic(error))
            finally:
                pool.shutdown(wait=False)


def run_before(rows: DataFrame, entity: Entity, handlers: list[Handler], context: dict) -> DataFrame:
    """(record_id, handler, error, payload) for each row: the snapshots that the handlers took, by name, or the first
    handler that failed and a diagnostic.  Rows are given as dicts of all their columns."""
    columns = sorted(c for c in rows.columns if c != LABEL)

    def batch(frames):
        for f in frames:
            out = []
            for rid, row in zip(f["_rid"], f[columns].to_dict("records"), strict=True):
                own, name = {}, None
                try:
                    for h in handlers:
                        name = h.name
                        own[name] = (h.before(row, context | {"record_id": rid}) if h.before else None) or {}
                        encode_snapshot(own[name])
                    out.append((rid, None, None, encode_snapshot(own)))
                except Exception as error:
                    out.append((rid, name, shorten(diagnostic(error)), None))
            yield pd.DataFrame(out, columns=["record_id", "handler", "error", "payload"], dtype="object")

    given = rows.select(record_id(F.col(entity.record_id), entity.record_id_type).alias("_rid"), *columns)
    return given.mapInPandas(batch, HOOKED)


class Engine:
    """``handlers``: an entity's row handlers by its name; with any, ``queue`` is the folder of their details and rows."""

    def __init__(self, spark: SparkSession, entities: list[Entity], rules: RuleBook, tables: dict[str, Snapshots], holds: Callable[[], DataFrame], events: str, *, options: Options | None = None, observers: Iterable[Callable] = (), clock: Callable[[], datetime] = lambda: datetime.now(UTC), handlers: dict[str, list[Handler]] | None = None, queue: str | None = None):
        self.spark, self.rules, self.tables, self.holds = spark, rules, tables, holds
        self.entities = execution_order([e for e in entities if not e.exempt])
        self.options, self.observers, self.clock = options or Options(), list(observers), clock
        self.log = Staged(spark, events)
        self.handlers = {name: in_order(own) for name, own in (handlers or {}).items()}
        if unknown := set(self.handlers) - {e.name for e in self.entities}:
            raise ConfigurationError([f"handlers for {n}, which isn't retained" for n in sorted(unknown)])
        if any(self.handlers.values()) and queue is None:
            raise ConfigurationError(["row handlers need a queue"])
        self.row_details, self.row_queue = (Staged(spark, f"{queue}/{n}") for n in ("details", "rows")) if queue else (None, None)
        self._ready = False

    # -- reading

    def events(self) -> DataFrame:
        for t in self.tables.values():
            t.publish()
        return self.log.rows(ledger.EVENTS)

    def after_handlers(self) -> dict[str, Callable]:
        """By name, for the dispatcher; a handler without ``after`` has nothing in the queue."""
        return {h.name: h.after for own in self.handlers.values() for h in own if h.after}

    def ready(self, *, ids: bool = False) -> None:
        """Raise what is wrong with entities and tables, once per engine; with ``ids`` also null and repeated record
        ids, which takes a pass over the tables."""
        if not self._ready:
            able = {e.category: self.rules.capabilities.get(e.category) or frozenset({Strategy.PURGE}) for e in self.entities}
            validate(self.entities, {e.name: self.tables[e.name].current() for e in self.entities}, able)
            self._ready = True
        wrong = [e.name for e in self.entities if ids and not repeated_ids(self.tables[e.name].current(), e).limit(1).isEmpty()]
        if wrong:
            raise ConfigurationError([f"{n}: record ids are null or repeated" for n in wrong])

    def _scope(self, tenant: Tenant | None) -> list[Entity]:
        return [e for e in self.entities if (e.tenant is not None) == (tenant is not None)]

    def _label(self, df: DataFrame, e: Entity, rule: Rule, tenant: Tenant | None, now: datetime, subject: object, at: datetime, holds: DataFrame) -> DataFrame:
        return disposition(df, e, rule, now, holds, hold_at=at, tenant=tenant.id if tenant else None, subject=subject)

    def _found(self, e: Entity, rule: Rule, tenant: Tenant | None, now: datetime, subject: object, at: datetime, holds: DataFrame, with_file: bool) -> list:
        """(label, file or null, rows) of what a pass counts; with files a row for each file at most."""
        rows = countable(self.tables[e.name].current(with_file=with_file), e, rule, now, tenant=tenant.id if tenant else None, subject=subject)
        file = F.col(FILE) if with_file else F.lit(None).cast("string").alias(FILE)
        return self._label(rows, e, rule, tenant, now, subject, at, holds).groupBy(LABEL, file).count().collect()

    def _count(self, e: Entity, rule: Rule, tenant: Tenant | None, found: list, affected: int | None = None, skipped: int = 0) -> Count:
        of = lambda label: sum(r["count"] for r in found if r[LABEL] == label)
        return Count(e.name, e.category, tenant.id if tenant else TENANTLESS, rule.strategy, of("eligible") if affected is None else affected, of("held"), skipped, of("null_anchor"))

    def preview(self, tenant: Tenant | None, now: datetime) -> list[Count]:
        """Counts by entity name; nothing is written."""
        self.ready()
        out = []
        for e in sorted(self._scope(tenant), key=lambda e: e.name):
            rule = self.rules.resolve(e.category, tenant, now)
            if rule.strategy == Strategy.EXEMPT:
                out.append(Count(e.name, e.category, tenant.id if tenant else TENANTLESS, rule.strategy))
            else:
                out.append(self._count(e, rule, tenant, self._found(e, rule, tenant, now, None, self.clock(), self.holds(), False)))
        return out

    # -- writing

    def sweep(self, tenant: Tenant | None, now: datetime, trigger: Trigger = Trigger.MANUAL) -> Result:
        if self.options.dry_run:
            raise ConfigurationError(["the engine is configured for dry runs"])
        return self._run(tenant, now, trigger, dry=False)

    def dry_run(self, tenant: Tenant | None, now: datetime, trigger: Trigger = Trigger.MANUAL) -> Result:
        """The same ledger entries as a sweep's, without a change."""
        return self._run(tenant, now, trigger, dry=True)

    def erase(self, tenant: Tenant, subject: object, now: datetime, *, dry: bool = False, allow_soft_delete: bool = False) -> Result:
        """Erase one subject from tenanted entities with subject columns.  A soft deletion is no erasure unless
        allowed, and is refused before anything is written."""
        chosen = [e for e in self._scope(tenant) if e.subjects]
        if not allow_soft_delete and any(self.rules.resolve(e.category, tenant, now).strategy == Strategy.SOFT_DELETE for e in chosen):
            raise ConfigurationError(["soft deletion isn't erasure; allow it explicitly"])
        return self._run(tenant, now, Trigger.ERASURE, dry=dry or self.options.dry_run, entities=chosen, subject=subject)

    def _run(self, tenant: Tenant | None, now: datetime, trigger: Trigger, *, dry: bool, entities: list[Entity] | None = None, subject: object = None) -> Result:
        self.ready()
        name = f"run-{uuid.uuid5(uuid.NAMESPACE_OID, tenant.id if tenant else TENANTLESS).hex}"
        with Lease(self.spark, self.log.folder.root, name, self.options.run_timeout.total_seconds()):
            return self._leased(tenant, now, trigger, dry, entities, subject)

    def _leased(self, tenant: Tenant | None, now: datetime, trigger: Trigger, dry: bool, entities: list[Entity] | None, subject: object) -> Result:
        run, notify, seq = str(uuid.uuid4()), Notifier(self.observers, self.options.observer_timeout.total_seconds()), iter(range(1 << 60))
        base = {"run_id": run, "tenant_id": tenant.id if tenant else TENANTLESS, "trigger": int(trigger), "dry_run": dry}

        def event(kind: str, rows: DataFrame | None = None, **values) -> tuple[dict, DataFrame]:
            """An event of the run and its ledger rows, one or one for each of ``rows``."""
            told = base | {"kind": kind, "at": self.clock(), "seq": next(seq)} | values
            frame = rows if rows is not None else self.spark.range(1)
            have = set(frame.columns) if rows is not None else set()
            return told, frame.select(*[(F.col(f.name) if f.name in have and f.name not in told else F.lit(told.get(f.name))).cast(f.dataType).alias(f.name) for f in ledger.EVENTS])

        def append(kind: str, **values) -> None:
            told, rows = event(kind, **values)
            self.log.append(rows)
            notify.tell(told)

        append(ledger.STARTED)
        result = Result(run, RunStatus.STARTED)
        try:
            for e in self._scope(tenant) if entities is None else entities:
                try:
                    count, told = self._entity(e, tenant, now, dry, subject, event)
                    result.counts.append(count)
                    for t in told:
                        notify.tell(t)
                except Exception as error:
                    result.failures[e.name] = diagnostic(error)
            result.status = RunStatus.PARTIALLY_FAILED if result.failures else RunStatus.SUCCEEDED
        except KeyboardInterrupt:
            result.status = RunStatus.CANCELLED
            raise
        except BaseException:
            result.status = RunStatus.FAILED
            raise
        finally:
            append(ledger.SETTLED, status=int(result.status), error=shorten("\n".join(f"{k}: {v}" for k, v in result.failures.items())) or None)
        return result

    def _entity(self, e: Entity, tenant: Tenant | None, now: datetime, dry: bool, subject: object, event: Callable) -> tuple[Count, list[dict]]:
        rule = self.rules.resolve(e.category, tenant, now)
        span = (rule.legal_minimum or ZERO) if subject is not None else effective_period(rule.period, rule.legal_minimum)
        about = {"entity_id": e.entity_id, "entity": e.name, "category": e.category, "strategy": int(rule.strategy), "period_seconds": int(span.total_seconds()), "rule_source": rule.source, "rule_reason": rule.reason}

        def closing(count: Count, affected: int, skipped: int) -> tuple[dict, DataFrame]:
            return event(ledger.SUMMARY, **about, affected=affected, held=count.held, skipped=skipped, null_anchor=count.null_anchor)

        table = self.tables[e.name]
        table.publish()
        if dry or rule.strategy == Strategy.EXEMPT:
            found = [] if rule.strategy == Strategy.EXEMPT else self._found(e, rule, tenant, now, subject, self.clock(), self.holds(), False)
            count = self._count(e, rule, tenant, found)
            told, rows = closing(count, count.affected, 0)
            self.log.append(rows)
            return count, [told]
        for attempt in range(5):
            try:
                out = self._change(e, rule, tenant, now, subject, event, about, closing)
                break
            except Conflict:
                if attempt == 4:
                    raise
        table.vacuum()
        return out

    def _change(self, e: Entity, rule: Rule, tenant: Tenant | None, now: datetime, subject: object, event: Callable, about: dict, closing: Callable) -> tuple[Count, list[dict]]:
        """One attempt at a live pass: touched files, labels, hooks, new files, staged events, commit."""
        table, at, holds = self.tables[e.name], self.clock(), self.holds()
        version = table.version()
        found = self._found(e, rule, tenant, now, subject, at, holds, True)
        touched = [r[FILE] for r in found if r[LABEL] == "eligible"]
        marks = f"labels-{uuid.uuid4().hex}"
        try:
            if not touched:
                count = self._count(e, rule, tenant, found, 0)
                told = [event(ledger.PROGRESS, **about, affected=0, skipped=0), closing(count, 0, 0)]
                self.log.append(told[0][1].unionByName(told[1][1]))
                return count, [t for t, _ in told]
            self._label(table.current(files=touched), e, rule, tenant, now, subject, at, holds).write.parquet(f"{table.root}/{marks}/rows")
            rows = self.spark.read.parquet(f"{table.root}/{marks}/rows")
            hooked = None
            own = self.handlers.get(e.name, [])
            rid = record_id(F.col(e.record_id), e.record_id_type)
            if own:
                context = {"entity": e.name, "entity_id": e.entity_id, "category": e.category, "strategy": rule.strategy.name, "tenant_id": tenant.id if tenant else TENANTLESS, "at": now, "run_id": event(ledger.DETAIL)[0]["run_id"]}
                run_before(rows.where(F.col(LABEL) == "eligible"), e, own, context).write.parquet(f"{table.root}/{marks}/hooked")
                hooked = self.spark.read.schema(HOOKED).parquet(f"{table.root}/{marks}/hooked")
                failed = hooked.where("error is not null").select(F.col("record_id").alias("_failed")).distinct()
                rows = rows.join(failed, (F.col(LABEL) == "eligible") & (rid == F.col("_failed")), "left")
                rows = rows.withColumn(LABEL, F.when(F.col("_failed").isNotNull(), "failed").otherwise(F.col(LABEL))).drop("_failed")
            sums = dict(rows.groupBy(LABEL).count().collect())
            affected, skipped = sums.get("eligible", 0), sums.get("failed", 0)
            count = self._count(e, rule, tenant, found, affected, skipped)
            late = held_flag(rows.where(F.col(LABEL) == "eligible"), e, self.holds(), self.clock()).where("_held")
            if not late.limit(1).isEmpty():
                raise Conflict("held meanwhile")
            told, batches = [], []
            detail = e.detail if e.detail != Detail.INHERIT else rule.detail
            if hooked is not None:
                told.append(event(ledger.DETAIL, hooked.select("record_id", "payload"), **about))
                batches += self._queued(e, hooked, own, told[0][0])
            elif detail == Detail.PER_ROW:
                told.append(event(ledger.DETAIL, rows.where(F.col(LABEL) == "eligible").select(rid.alias("record_id")), **about))
            told += [event(ledger.PROGRESS, **about, affected=affected, skipped=skipped), closing(count, 0, 0)]
            batches.append(self.log.stage(reduce(DataFrame.unionByName, [r for _, r in told])))
            table.commit(table.write(apply(rows, e, rule, now, tenant.id if tenant else None)), version, instead_of=touched, batches=batches)
            return count, [t for t, _ in told]
        finally:
            table.folder.delete(marks)

    def _queued(self, e: Entity, hooked: DataFrame, handlers: list[Handler], told: dict) -> list[str]:
        """Staged row details and queue rows: a pending row for each handler with an ``after``, in order, or a dead
        letter for the one that failed before the change."""
        last = self.row_details.rows(DETAILS).agg(F.max("id")).first()[0]
        rows = hooked.withColumn("id", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
        same = {c: F.lit(told[c]) for c in ("run_id", "at", "entity", "entity_id", "category", "strategy", "tenant_id")}
        details = rows.select(*[F.col(f.name) if f.name in ("id", "record_id", "payload") else same[f.name].cast(f.dataType).alias(f.name) for f in DETAILS])
        each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h.name).alias("handler"), F.lit(int(h.phase)).alias("phase"), F.lit(h.after is not None).alias("later")) for k, h in enumerate(handlers)])
        work = rows.select("id", "error", F.col("handler").alias("failed"), F.explode(each).alias("h")).where((F.col("error").isNull() & F.col("h.later")) | (F.col("h.handler") == F.col("failed")))
        lost, when = F.col("error").isNotNull(), F.lit(told["at"])
        work = work.select(
            (F.col("id") * MOST_HANDLERS + F.col("h.k")).alias("id"), F.col("id").alias("detail_id"), F.col("h.handler").alias("handler"), F.col("h.phase").alias("phase"),
            F.when(lost, int(State.DEAD_LETTERED)).otherwise(int(State.PENDING)).alias("state"), F.lit(0).alias("attempt"), when.alias("queued_at"), when.alias("next_attempt_at"),
            F.lit(None).cast("timestamp").alias("claimed_at"), F.lit(None).cast("string").alias("claim_token"), F.when(lost, when).alias("completed_at"), F.col("error").alias("last_error"),
        )
        return [self.row_details.stage(details), self.row_queue.stage(work)]
