"""The engine's operators over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.periods import backoff_seconds
from tidemark.functions.text import plain_type_name, record_id
from tidemark.operators import batching, holds, ledger, mutate, queue
from tidemark.operators import measure as m
from tidemark.operators.eligibility import LABEL, disposition, disposition_by_tenant
from tidemark.plans.model import Anonymised, Entity, Handler, Mode, Options, Phase, Rule, RuleBook, Strategy, Tenant, utc
from tidemark.plans.order import execution_order, first_of_each, repeated_ids
from tidemark.session import work_folder
from tidemark.sources.schemas import DETAILS, QUEUE
from tidemark.sources.snapshots import Snapshots
from tidemark.streaming import dispatcher

_ID = "00000000-0000-4000-8000-00000000000{}".format
DAY = timedelta(days=1)
EVENT_AT, ORDER_AT, PART_AT = utc("2024-01-31"), utc("2001-08-01"), utc("2024-01-01")
EVENTS = Entity("event_log", _ID(1), "events", "occurred_at", record_id="record_id", subjects=("subject_id",))
ORDERS = Entity("order_record", _ID(2), "orders", "ordered_at", record_id="record_id", subjects=("subject_id",), parents=("customer_profile",))
CUSTOMERS = Entity("customer_profile", _ID(3), "customers", "last_order_at", record_id="record_id", fields=(Anonymised("name", "[redacted]"), Anonymised("balance", None), Anonymised("note", "")))
PARTS = Entity("price_list", _ID(4), "prices", "listed_at", record_id="record_id", tenant=None)
TURNS = Entity("turn", _ID(5), "talk", "said_at", record_id="record_id", subjects=("subject_id", "other_id"))
DOCUMENTS = Entity("document", _ID(6), "texts", "written_at", record_id="record_id")
LINES = Entity("line", _ID(7), "lines", "shipped_at", parents=("order_record", "price_list"))
PURGE_14 = Rule(14 * DAY, Strategy.PURGE)
SOFT_365 = Rule(365 * DAY, Strategy.SOFT_DELETE)
ANON_30, ANON_30_90 = Rule(30 * DAY, Strategy.ANONYMISE), Rule(30 * DAY, Strategy.ANONYMISE, 90 * DAY)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ts(c) :
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("record_id"), F.col("event_type").alias("tenant_id"), F.when(F.col("event_id") % 50 != 0, _ts("ts")).alias("occurred_at"), F.col("user_id").alias("subject_id"), "value", "event_id")


def event_holds(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("event_id", F.col("event_type").alias("tenant_id"))
    kind = F.floor(F.col("event_id") / 97) % 3

    def rows(step: int, tag: str, created: str, expires, removed) -> DataFrame:
        return e.where(F.col("event_id") % step == 0).select(
            F.concat(F.lit(tag), F.col("event_id")).alias("hold_id"), F.lit(EVENTS.entity_id).alias("entity_id"), F.col("event_id").cast("string").alias("record_id"), "tenant_id", F.lit("case").alias("reason"),
            F.lit(utc(created)).alias("created_at"), expires.cast("timestamp").alias("expires_at"), removed.cast("timestamp").alias("removed_at"),
        )

    none = F.lit(None)
    first = rows(97, "a", "2024-01-01", F.when(kind == 1, F.lit(utc("2024-01-20"))), F.when(kind == 2, F.lit(utc("2024-01-25"))))
    return first.union(rows(291, "b", "2024-01-02", none, none))


def no_holds(spark: SparkSession, d: str) -> DataFrame:
    return event_holds(spark, d).where("1 = 0")


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders")
    gone = F.col("o_orderkey") % 10 == 0
    return o.select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderpriority").alias("tenant_id"), _ts("o_orderdate").alias("ordered_at"), gone.alias("is_deleted"), F.when(gone, F.lit(utc("2000-01-01"))).alias("deleted_at"), F.col("o_custkey").alias("subject_id"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    last = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(_ts("o_orderdate")).alias("last_order_at"))
    c = _table(spark, d, "customer").join(last, "c_custkey", "left")
    done = F.when(F.col("c_custkey") % 10 == 0, F.lit(utc("2000-01-01")))
    return c.select(F.col("c_custkey").cast("string").alias("record_id"), F.col("c_mktsegment").alias("tenant_id"), "last_order_at", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("note"), done.alias("anonymised_at"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("record_id"), _days_before(PART_AT, F.col("p_partkey") % 400).alias("listed_at"))


def part_holds(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").where("p_partkey % 25 = 0")
    none = F.lit(None).cast("timestamp")
    return p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("hold_id"), F.lit(PARTS.entity_id).alias("entity_id"), F.col("p_partkey").cast("string").alias("record_id"), F.lit(None).cast("string").alias("tenant_id"), F.lit("case").alias("reason"), F.lit(utc("2023-01-01")).alias("created_at"), none.alias("expires_at"), none.alias("removed_at"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations")
    said = F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, _days_before(PART_AT, F.col("turn") * 30))
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("record_id"), F.col("role").alias("tenant_id"), said.alias("said_at"), (F.col("conv_id") % 20).alias("subject_id"), (F.col("turn") % 20).alias("other_id"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("record_id"), F.col("lang").alias("tenant_id"), _days_before(PART_AT, F.col("doc_id")).alias("written_at"), "text", F.lit(None).cast("timestamp").alias("anonymised_at"))


def _days_before(now, days) :
    return F.timestamp_seconds(F.unix_timestamp(F.lit(now)) - days * 86_400)


def labelled_events(spark: SparkSession, d: str) -> DataFrame:
    return disposition(events(spark, d), EVENTS, PURGE_14, EVENT_AT, event_holds(spark, d))


def labelled_turns(spark: SparkSession, d: str, rule: Rule, subject: int = 3, both: bool = False) -> DataFrame:
    e = TURNS if both else Entity("turn", _ID(5), "talk", "said_at", record_id="record_id", subjects=("subject_id",))
    return disposition(turns(spark, d), e, rule, PART_AT, no_holds(spark, d), subject=subject)


def _eligible(df: DataFrame) -> DataFrame:
    return df.where(F.col(LABEL) == "eligible")


def _seconds(c: str) :
    return F.unix_timestamp(c)


def _queue(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A queue with all states: three handlers per detail, forty runs."""
    e = _table(spark, d, "events")
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, (0, 2, 0, 1, 2, 3, 0))), (i % 7 + 1).cast("int"))
    q = e.select(
        i.alias("id"), F.floor(i / 3).alias("detail_id"), F.concat(F.lit("handler"), i % 3).alias("handler"), (i % 2).cast("int").alias("phase"), state.alias("state"), (i % 11).cast("int").alias("attempt"),
        _ts("ts").alias("queued_at"), _ts("ts").alias("next_attempt_at"), F.when(state == 1, _ts("ts")).alias("claimed_at"), F.when(state == 1, F.concat(F.lit("t"), i)).alias("claim_token"),
        F.when(state > 1, _ts("ts")).alias("completed_at"), F.lit(None).cast("string").alias("last_error"),
    )
    details = e.groupBy(F.floor(i / 3).alias("id")).agg(F.min(_ts("ts")).alias("at"), F.min(i).cast("string").alias("record_id"))
    details = details.withColumn("run_id", F.concat(F.lit("r"), F.col("id") % 40)).withColumn("payload", F.concat(F.lit("p"), F.col("id")))
    n = F.col("id")
    runs = spark.range(40).select(F.concat(F.lit("r"), n).alias("run_id"), (n % 5).cast("int").alias("status"), _days_before(EVENT_AT, n).alias("started_at"), F.when(n % 5 != 0, F.lit(EVENT_AT)).alias("settled_at"))
    return {"queue": q, "details": details, "runs": runs}


def _events_log(spark: SparkSession, d: str) -> DataFrame:
    """A ledger made from batches of a sweep: progress per batch, then two summaries, per tenant."""
    b = batching.batches(_eligible(labelled_events(spark, d)), EVENTS, 100)
    progress = b.groupBy("tenant_id", "batch_no").agg(F.count("*").alias("affected"), F.count_if(F.col("event_id") % 13 == 0).alias("skipped"))
    progress = progress.select("tenant_id", (F.col("batch_no") + 1).alias("seq"), F.lit("progress").alias("kind"), "affected", "skipped", F.lit(None).cast("long").alias("held"), F.lit(None).cast("long").alias("null_anchor"))
    counts = m.measure(labelled_events(spark, d), EVENTS)
    last = lambda seq, f: counts.select("tenant_id", F.lit(seq).cast("long").alias("seq"), F.lit("summary").alias("kind"), F.lit(0).cast("long").alias("affected"), F.lit(0).cast("long").alias("skipped"), (F.col("held") * f).alias("held"), (F.col("null_anchor") * f).alias("null_anchor"))
    log = progress.union(last(1_000_000, 2)).union(last(1_000_001, 1))
    at = _days_before(EVENT_AT, F.lit(0))
    fixed = {"run_id": F.concat(F.lit("run-"), F.col("tenant_id")), "entity_id": F.lit(EVENTS.entity_id), "category": F.lit("events"), "strategy": F.lit(0), "dry_run": F.lit(False), "at": at, "entity": F.lit("event_log"), "period_seconds": F.lit(14 * 86_400).cast("long"), "rule_source": F.lit(None).cast("string"), "rule_reason": F.lit(None).cast("string"), "status": F.lit(None).cast("int"), "trigger": F.lit(2), "error": F.lit(None).cast("string")}
    log = log.withColumns(fixed)
    ends = log.where("seq = 1000001")
    started = ends.withColumns({"seq": F.lit(-1).cast("long"), "kind": F.lit("started"), "at": _days_before(EVENT_AT, F.lit(1))})
    settled = ends.withColumns({"seq": F.lit(2_000_000).cast("long"), "kind": F.lit("settled"), "status": F.lit(1)})
    return log.unionByName(started).unionByName(settled)


LEASE, ATTEMPTS = timedelta(minutes=5), 10
Q: dict = {}


def _query(f):
    Q[f.__name__] = f
    return f


@_query
def preview_purge(s, d):
    return m.measure(labelled_events(s, d), EVENTS)


@_query
def preview_soft_delete(s, d):
    return m.measure(disposition(orders(s, d), ORDERS, SOFT_365, ORDER_AT, no_holds(s, d)), ORDERS, "done", "retained")


@_query
def preview_anonymise(s, d):
    return m.measure(disposition(customers(s, d), CUSTOMERS, ANON_30, ORDER_AT, no_holds(s, d)), CUSTOMERS, "done", "retained")


@_query
def legal_min_preview(s, d):
    return m.measure(disposition(customers(s, d), CUSTOMERS, ANON_30_90, ORDER_AT, no_holds(s, d)), CUSTOMERS, "done", "retained")


@_query
def held_count(s, d):
    return preview_purge(s, d).select("tenant_id", "held")


@_query
def null_anchor_count(s, d):
    return preview_purge(s, d).select("tenant_id", "null_anchor")


@_query
def exempt_preview(s, d):
    return m.exempt(events(s, d), EVENTS)


@_query
def tenantless_preview(s, d):
    rows = disposition(parts(s, d), PARTS, Rule(180 * DAY, Strategy.PURGE), PART_AT, part_holds(s, d))
    return m.measure(rows, PARTS, "retained").drop("tenant_id")


@_query
def holds_list_active(s, d):
    return holds.list_active(event_holds(s, d), EVENT_AT).select("entity_id", "record_id", "hold_id", "tenant_id", _seconds("created_at").alias("created"))


@_query
def holds_has_active(s, d):
    t = events(s, d).select(F.lit(EVENTS.entity_id).alias("entity_id"), "record_id", "tenant_id")
    return holds.held_targets(t, event_holds(s, d), EVENT_AT).select("record_id", "tenant_id")


@_query
def holds_lifted(s, d):
    h = holds.lift(event_holds(s, d), "a0", EVENT_AT)
    return h.select("hold_id", _seconds("removed_at").alias("removed"))


@_query
def guarded_deletion(s, d):
    t = events(s, d).select(F.floor(F.col("event_id") / 40).alias("request_id"), F.lit(EVENTS.entity_id).alias("entity_id"), "record_id", "tenant_id")
    return holds.deletion_outcomes(t.union(t), event_holds(s, d), EVENT_AT)


@_query
def purge_survivors(s, d):
    return mutate.purge(labelled_events(s, d)).select("record_id", "tenant_id")


@_query
def purge_affected_ids(s, d):
    return _eligible(labelled_events(s, d)).select("record_id", "tenant_id")


@_query
def soft_delete_result(s, d):
    rows = disposition(orders(s, d), ORDERS, SOFT_365, ORDER_AT, no_holds(s, d))
    return mutate.soft_delete(rows, ORDERS, ORDER_AT).select("record_id", "is_deleted", _seconds("deleted_at").alias("deleted"))


@_query
def anonymise_result(s, d):
    rows = disposition(customers(s, d), CUSTOMERS, ANON_30, ORDER_AT, no_holds(s, d))
    return mutate.anonymise(rows, CUSTOMERS, ORDER_AT).select("record_id", "name", "balance", "note", _seconds("anonymised_at").alias("anonymised"))


def _with_factory(s, d, field: Anonymised) -> DataFrame:
    e = Entity("document", _ID(6), "texts", "written_at", record_id="record_id", fields=(field,))
    rows = disposition(documents(s, d), e, Rule(30 * DAY, Strategy.ANONYMISE), PART_AT, no_holds(s, d))
    return mutate.anonymise(rows, e, PART_AT).select("record_id", F.md5("text").alias("text"), _seconds("anonymised_at").alias("anonymised"))


@_query
def anonymise_factory_static(s, d):
    return _with_factory(s, d, Anonymised("text", factory=lambda _: "tombstone", mode=Mode.STATIC))


@_query
def anonymise_factory_original(s, d):
    return _with_factory(s, d, Anonymised("text", factory=lambda c: F.sha2(c, 256), mode=Mode.PER_ROW_WITH_ORIGINAL))


@_query
def oldest_first_candidates(s, d):
    rows = batching.oldest_first(_eligible(labelled_events(s, d)), EVENTS, 100)
    return rows.select("record_id", "tenant_id", F.unix_micros("occurred_at").alias("occurred"))


@_query
def batch_progress(s, d):
    rows = batching.batches(_eligible(labelled_events(s, d)), EVENTS, 100)
    return rows.groupBy("tenant_id", "batch_no").agg(F.count("*").alias("affected"), F.sum(F.col("event_id")).alias("id_sum"))


@_query
def batch_progress_tenantless(s, d):
    rows = _eligible(disposition(parts(s, d), PARTS, Rule(180 * DAY, Strategy.PURGE), PART_AT, part_holds(s, d)))
    return batching.batches(rows, PARTS, 50).groupBy("batch_no").agg(F.count("*").alias("affected"), F.min(F.col("record_id").cast("long")).alias("least"), F.max(F.col("record_id").cast("long")).alias("most"))


@_query
def erase_preview(s, d):
    return m.measure(labelled_turns(s, d, Rule(365 * DAY, Strategy.PURGE)), TURNS, "out_of_scope")


@_query
def erase_legal_min(s, d):
    return m.measure(labelled_turns(s, d, Rule(365 * DAY, Strategy.PURGE, 45 * DAY)), TURNS, "retained")


@_query
def erase_multi_subject(s, d):
    return m.measure(labelled_turns(s, d, Rule(365 * DAY, Strategy.PURGE), both=True), TURNS)


@_query
def erase_survivors(s, d):
    return mutate.purge(labelled_turns(s, d, Rule(365 * DAY, Strategy.PURGE, 45 * DAY))).select("record_id", "tenant_id")


@_query
def ledger_entity_summary(s, d):
    return ledger.summaries(_events_log(s, d)).select("run_id", "tenant_id", "strategy", "affected", "skipped", "held", "null_anchor", "period_seconds")


@_query
def ledger_run(s, d):
    r = ledger.runs(_events_log(s, d))
    return r.select("run_id", "status", "trigger", "duration_seconds", "total_affected")


@_query
def row_detail(s, d):
    rows = _eligible(labelled_events(s, d)).select("record_id", "tenant_id", "event_id")
    key = {"run_id": F.lit("run"), "entity_id": F.lit(EVENTS.entity_id), "category": F.lit("events"), "strategy": F.lit(0), "entity": F.lit("event_log"), "at": F.lit(EVENT_AT), "kind": F.lit("detail")}
    log = rows.withColumns(key | {"payload": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("p"), "record_id"))})
    return ledger.details(log.union(log)).select("run_id", "tenant_id", "record_id", "payload")


@_query
def failed_row_exclusion(s, d):
    key = {"run_id": F.lit("run"), "entity_id": F.lit(EVENTS.entity_id), "category": F.lit("events"), "strategy": F.lit(0)}
    rows = _eligible(labelled_events(s, d)).select("record_id", "tenant_id", "event_id").withColumns(key)
    return ledger.without_committed(rows, rows.where("event_id % 4 = 0")).select("record_id", "tenant_id")


@_query
def multi_tenant_sweep(s, d):
    """Rules differ by tenant: joined as a table, the cutoff is a column."""
    rules = s.createDataFrame([(t, n * 86_400) for t, n in (("click", 7), ("view", 14), ("error", 21))], "tenant_id string, period_seconds long")
    return m.measure(disposition_by_tenant(events(s, d), EVENTS, rules, Rule(28 * DAY, Strategy.PURGE), EVENT_AT, event_holds(s, d)), EVENTS)


@_query
def tenant_dedup(s, d):
    listed = [Tenant("a", "de"), Tenant("b", "fr"), Tenant("a", "us"), Tenant("c", None), Tenant("b", "fr")]
    first, conflicts = first_of_each(listed)
    return s.createDataFrame([(t.id, t.jurisdiction, t.id in conflicts) for t in first], "tenant_id string, jurisdiction string, conflict boolean")


@_query
def fk_child_first(s, d):
    return s.createDataFrame([(i, e.name) for i, e in enumerate(execution_order([PARTS, ORDERS, CUSTOMERS, LINES]))], "position int, entity string")


@_query
def record_id_uniqueness(s, d):
    e = Entity("line", _ID(7), "lines", "at", record_id="rid")
    return repeated_ids(_table(s, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("rid")), e)


@_query
def canonical_record_ids(s, d):
    raw = _table(s, d, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("padded"), F.concat(F.lit("AB-"), F.upper(F.hex("c_custkey"))).alias("code"))
    return raw.select("c_custkey", record_id(F.col("padded"), "bigint").alias("number_id"), record_id(F.col("code"), "uuid").alias("uuid_id"))


@_query
def type_names(s, d):
    names = _table(s, d, "nation").select("n_nationkey", F.concat(F.lit("My.Row"), F.col("n_nationkey"), F.lit(", My, Version=1."), F.col("n_nationkey"), F.lit(", Culture=neutral, PublicKeyToken=null")).alias("n"))
    return names.select("n_nationkey", plain_type_name(F.col("n")).alias("type_name"))


@_query
def queue_due(s, d):
    t = _queue(s, d)
    rows = queue.due(t["queue"], t["details"], t["runs"], now=EVENT_AT, lease=LEASE, max_attempts=ATTEMPTS, due_at=utc("2024-01-20"), limit=200)
    return queue.claim(rows, EVENT_AT, "t").select("id", "attempt", "state")


@_query
def queue_blocked_siblings(s, d):
    t = _queue(s, d)["queue"]
    return t.where(queue.open_state()).join(queue.unblocked(t).select("id"), "id", "left_anti").select("id", "detail_id")


@_query
def queue_settled(s, d):
    t = _queue(s, d)["queue"]
    said = t.where("state = 1 and id % 5 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.lit("stale")).otherwise(F.col("claim_token")).alias("claim_token"), F.when(F.col("id") % 2 == 0, F.lit("bad")).alias("error"))
    out = queue.settle(t, said, now=EVENT_AT, base_seconds=2, max_attempts=ATTEMPTS)
    return out.select("id", "state", F.unix_timestamp("next_attempt_at").alias("next_at"), F.col("claim_token").isNull().alias("free"))


@_query
def queue_dead_letter_cascade(s, d):
    out = queue.dead_letter_exhausted(_queue(s, d)["queue"], now=EVENT_AT, lease=LEASE, max_attempts=8)
    return out.groupBy("state").agg(F.count("*").alias("rows"), F.sum("id").alias("id_sum"))


@_query
def queue_backoff(s, d):
    return _queue(s, d)["queue"].select("id", backoff_seconds(F.col("attempt"), 3, 900).alias("wait"))


@_query
def queue_flush_remainder(s, d):
    return queue.remainder(_queue(s, d)["queue"])


@_query
def stale_runs(s, d):
    return queue.stale_runs(_queue(s, d)["runs"], now=EVENT_AT, timeout=10 * DAY).select("run_id", _seconds("started_at").alias("started"))


@_query
def stale_runs_failed(s, d):
    r = queue.fail_stale(_queue(s, d)["runs"].withColumns({"duration_seconds": F.lit(None).cast("long"), "error": F.lit(None).cast("string")}), now=EVENT_AT, timeout=10 * DAY)
    return r.select("run_id", "status", "duration_seconds", "error")


@_query
def payload_scrub(s, d):
    t = _queue(s, d)
    return queue.scrub(t["details"], t["queue"], now=EVENT_AT, retention=20 * DAY).select("id", "payload")


@_query
def dead_letter_union(s, d):
    """Exhausted rows and those that depend on them, each once."""
    t = _queue(s, d)["queue"]
    hit = t.where((F.col("state") == 1) & queue.expired(EVENT_AT, LEASE) & (F.col("attempt") >= 8))
    first = hit.groupBy("detail_id").agg(F.min("id").alias("_f"))
    after = t.where(queue.open_state()).join(first, "detail_id").where("id > _f")
    return hit.select("id").union(after.select("id")).distinct()


@_query
def newest_per_tenant(s, d):
    rows = _eligible(labelled_events(s, d))
    w = Window.partitionBy("tenant_id").orderBy(F.desc("occurred_at"), "record_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("tenant_id", "rank", "record_id")


# -- whole passes of the engine, over tables of their own in the shared folder


def _engine(s: SparkSession, e: Entity, df: DataFrame, rule: Rule, hold: DataFrame, now, handlers=()) -> tuple[Engine, Snapshots]:
    root = f"{work_folder(s)}/engine-{uuid.uuid4().hex}"
    table = Snapshots(s, f"{root}/table")
    table.commit(table.write(df), 0)
    return Engine(s, [e], RuleBook({e.category: rule}), {e.name: table}, lambda: hold, f"{root}/events", clock=lambda: now, handlers={e.name: list(handlers)}, queue=f"{root}/work"), table


TYPES = ("click", "error")


@_query
def engine_sweep(s, d):
    """What two tenants' sweeps leave of the table."""
    engine, table = _engine(s, EVENTS, events(s, d), PURGE_14, event_holds(s, d), EVENT_AT)
    for t in TYPES:
        engine.sweep(Tenant(t), EVENT_AT)
    return table.current().select("record_id", "tenant_id")


@_query
def engine_ledger(s, d):
    """The audit summaries of dry runs and of the sweeps after them."""
    engine, _ = _engine(s, EVENTS, events(s, d), PURGE_14, event_holds(s, d), EVENT_AT)
    for t in TYPES:
        engine.dry_run(Tenant(t), EVENT_AT)
        engine.sweep(Tenant(t), EVENT_AT)
    rows = ledger.summaries(engine.events()).join(ledger.runs(engine.events()).select("run_id", "dry_run", "status", "total_affected"), "run_id")
    return rows.select("tenant_id", "dry_run", "status", "total_affected", "affected", "skipped", "held", "null_anchor", "period_seconds")


@_query
def engine_erase(s, d):
    """What the erasure of one subject with a legal minimum leaves of a tenant's and all others' rows."""
    engine, table = _engine(s, Entity("turn", _ID(5), "talk", "said_at", record_id="record_id", subjects=("subject_id",)), turns(s, d), Rule(365 * DAY, Strategy.PURGE, 45 * DAY), no_holds(s, d), PART_AT)
    engine.erase(Tenant("user"), 3, PART_AT)
    return table.current().select("record_id", "tenant_id")


def _hook(row: dict, _: dict) -> dict:
    if int(row["event_id"]) % 10 == 3:
        raise ValueError("refused")
    return {"value": int(row["event_id"])}


def _told(row: dict, snapshot: dict) -> None:
    assert row["record_id"] == str(snapshot["value"])


def _handled(s: SparkSession, d: str) -> tuple[Engine, Snapshots]:
    handlers = [Handler("store", _hook, _told), Handler("notify", _hook, _told, Phase.AFTER_RUN_SETTLED, 1), Handler("count", _hook)]
    engine, table = _engine(s, EVENTS, events(s, d), PURGE_14, event_holds(s, d), EVENT_AT, handlers)
    engine.sweep(Tenant(TYPES[0]), EVENT_AT)
    return engine, table


@_query
def handler_sweep(s, d):
    """Survivors where a hook refuses some rows."""
    return _handled(s, d)[1].current().select("record_id", "tenant_id")


@_query
def handler_failures(s, d):
    """The refused rows, dead letters of the first handler."""
    engine = _handled(s, d)[0]
    lost = engine.row_queue.rows(QUEUE).where("state = 3").select("detail_id", "handler")
    return lost.join(engine.row_details.rows(DETAILS).where("payload is null").select(F.col("id").alias("detail_id"), "record_id"), "detail_id").select("record_id", "handler")


@_query
def queue_enqueued(s, d):
    """What the sweep puts into the queue, in the order of a row's handlers."""
    engine = _handled(s, d)[0]
    rows = engine.row_queue.rows(QUEUE).join(engine.row_details.rows(DETAILS).select(F.col("id").alias("detail_id"), "record_id", "payload"), "detail_id")
    nth = F.row_number().over(Window.partitionBy("detail_id").orderBy("id"))
    return rows.where("state = 0").select("record_id", "handler", "phase", nth.alias("nth"), F.get_json_object("payload", "$.store.value").cast("long").alias("value"))


@_query
def queue_drained(s, d):
    """The queue after a flush of what the sweep put into it, and whether a payload is left."""
    engine = _handled(s, d)[0]
    root = f"{work_folder(s)}/drain-{uuid.uuid4().hex}"
    work, details = Snapshots(s, f"{root}/rows"), Snapshots(s, f"{root}/details")
    work.commit(work.write(engine.row_queue.rows(QUEUE)), 0)
    details.commit(details.write(engine.row_details.rows(DETAILS)), 0)
    dispatcher.flush(work, details, ledger.runs(engine.events()), engine.after_handlers(), Options(), EVENT_AT)
    rows = work.current().join(details.current().select(F.col("id").alias("detail_id"), "payload"), "detail_id")
    return rows.groupBy("handler", "state").agg(F.count("*").alias("rows"), F.max("attempt").alias("attempts"), F.count("payload").alias("payloads"))


@_query
def anonymise_factory_per_row(s, d):
    """A factory called for each row anew, and told what for."""
    own = Anonymised("text", factory=lambda _, c: f"{c.entity}:{uuid.uuid4().hex}", mode=Mode.PER_ROW)
    e = Entity("document", _ID(6), "texts", "written_at", record_id="record_id", fields=(own,))
    rows = mutate.anonymise(disposition(documents(s, d), e, Rule(30 * DAY, Strategy.ANONYMISE), PART_AT, no_holds(s, d)), e, PART_AT)
    new = rows.where("anonymised_at is not null")
    return new.agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts"), F.min(F.length("text")).alias("least"), F.count_if(F.col("text").startswith("document:")).alias("named"))


QUERIES = dict(Q)
