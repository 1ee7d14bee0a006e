from __future__ import annotations

import sys
import uuid
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.text import encode_snapshot
from tidemark.operators import batching, ledger
from tidemark.operators import holds as h
from tidemark.operators.eligibility import countable
from tidemark.plans.model import Anonymised, ConfigurationError, Detail, Entity, Handler, Mode, Phase, Options, Rule, RuleBook, RunStatus, State, Strategy, Tenant, Trigger, in_order, utc
from tidemark.plans.order import execution_order, first_of_each, validate
from tidemark.sources import snapshots
from tidemark.sources.schemas import DETAILS, HOLDS, QUEUE, RUNS, SchemaError, check
from tidemark.sources.snapshots import FILE, Conflict, Snapshots
from tidemark.streaming import dispatcher, worker

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NOW, DAY = utc("2026-04-12T12:00:00"), timedelta(days=1)
A = Tenant("a")
UUID = "10000000-0000-4000-8000-00000000000{}".format
NOTE = Entity("note", UUID(1), "short", "at", subjects=("subject", "other"))
SOFT = Entity("soft", UUID(2), "soft", "at", detail=Detail.PER_ROW, subjects=("subject",))
CONTACT = Entity("contact", UUID(3), "anon", "at", fields=(Anonymised("name", "[redacted]"), Anonymised("mail", None), Anonymised("nick", "")))
LOG = Entity("log", UUID(4), "logs", "at", tenant=None)
RULES = RuleBook({"short": Rule(30 * DAY, Strategy.PURGE), "soft": Rule(30 * DAY, Strategy.SOFT_DELETE), "anon": Rule(30 * DAY, Strategy.ANONYMISE), "logs": Rule(30 * DAY, Strategy.PURGE)})
COLUMNS = "id string, tenant_id string, at timestamp, subject string, other string, is_deleted boolean, deleted_at timestamp, anonymised_at timestamp, name string, mail string, nick string"


def rows(*given):
    return [(i, t, None if d is None else NOW - d * DAY, s, o, False, None, None, "n", "m", "k") for i, t, d, s, o in given]


BOUNDARY = rows(("young", "a", 29, "x", None), ("edge", "a", 30, "x", "y"), ("old", "a", 31, "x", None), ("held", "a", 120, None, "x"), ("null", "a", None, "x", None), ("else", "b", 120, "x", None))
HOLD = ("h1", None, "held", "a", "case", NOW - DAY, None, None)


@pytest.fixture
def make(spark, tmp_path):
    def build(entity, data=BOUNDARY, holds=(HOLD,), **more):
        table = Snapshots(spark, str(tmp_path / entity.name))
        df = spark.createDataFrame(data, COLUMNS)
        table.commit(table.write(df), table.version())
        held = spark.createDataFrame([(x[0], x[1] or entity.entity_id, *x[2:]) for x in holds], HOLDS)
        rules = more.pop("rules", RULES)
        return Engine(spark, [entity], rules, {entity.name: table}, more.pop("hold_source", lambda: held), str(tmp_path / "events"), clock=lambda: NOW, **more), table

    return build


def ids(table):
    return {r[0] for r in table.current().select("id").collect()}


def test_preview_dry_run_and_sweep_agree(make):
    engine, table = make(NOTE)
    found = engine.preview(A, NOW)
    dry = engine.dry_run(A, NOW)
    assert found == dry.counts and (found[0].affected, found[0].held, found[0].null_anchor) == (1, 1, 1)
    assert len(ids(table)) == 6
    live = engine.sweep(A, NOW)
    assert live.counts == found and live.status == RunStatus.SUCCEEDED
    assert ids(table) == {"young", "edge", "held", "null", "else"}
    assert engine.sweep(A, NOW).total == 0
    runs = {r.run_id: r for r in ledger.runs(engine.events()).collect()}
    assert runs[live.run_id].total_affected == runs[dry.run_id].total_affected == 1 and runs[live.run_id].status == 1
    summary = ledger.summaries(engine.events()).where(F.col("run_id") == live.run_id).first()
    assert (summary.affected, summary.held, summary.null_anchor, summary.period_seconds) == (1, 1, 1, 30 * 86_400)


def test_soft_delete_and_row_detail(make):
    engine, table = make(SOFT)
    assert engine.sweep(A, NOW).total == 1
    gone = table.current().where("is_deleted").select("id", "deleted_at").collect()
    assert [r.id for r in gone] == ["old"]
    assert [r.record_id for r in ledger.details(engine.events()).collect()] == ["old"]
    assert engine.sweep(A, NOW).total == 0


def test_anonymise_with_literals_and_factories(make):
    engine, table = make(CONTACT)
    assert engine.sweep(A, NOW).total == 1
    r = table.current().where("id = 'old'").first()
    assert (r["name"], r["mail"], r["nick"]) == ("[redacted]", None, "") and r["anonymised_at"] is not None
    assert engine.sweep(A, NOW).total == 0


def test_factories(make):
    from tidemark.operators.mutate import per_value

    fields = (Anonymised("name", factory=lambda _: "t", mode=Mode.STATIC), Anonymised("mail", factory=per_value(lambda v: f"<{v}>"), mode=Mode.PER_ROW_WITH_ORIGINAL), Anonymised("nick", factory=lambda _: "fresh", mode=Mode.PER_ROW))
    engine, table = make(Entity("contact", UUID(3), "anon", "at", fields=fields))
    engine.sweep(A, NOW)
    assert tuple(table.current().where("id = 'old'").select("name", "mail", "nick").first()) == ("t", "<m>", "fresh")


def test_tenantless_and_null_tenant_holds(make):
    engine, table = make(LOG, holds=(("h1", None, "held", None, "case", NOW - DAY, None, None), ("h2", None, "old", "a", "case", NOW - DAY, None, None)))
    assert engine.sweep(None, NOW).total == 2
    assert ids(table) == {"young", "edge", "held", "null"}
    assert engine.sweep(A, NOW).counts == []


@pytest.mark.parametrize(("created", "expires", "removed", "active"), [(0, None, None, True), (1, 0, None, False), (1, None, 0, False), (-1, None, None, False), (1, -1, -1, True)])
def test_hold_boundaries(spark, created, expires, removed, active):
    t = lambda d: None if d is None else NOW - d * DAY
    holds = spark.createDataFrame([("h", UUID(1), "r", "a", "case", t(created), t(expires), t(removed))], HOLDS)
    assert h.has_active(holds, UUID(1), "r", "a", NOW) is active


def test_hold_changes(spark):
    empty, targets = spark.createDataFrame([], HOLDS), spark.createDataFrame([("r", "a")], "record_id string, tenant_id string")
    about = {"entity_id": UUID(1), "record_id": "r", "tenant_id": "a", "reason": "case", "now": NOW}
    placed = h.place(empty, targets, **about)
    hold = placed.first().hold_id
    assert h.lift(placed, hold, NOW).first().removed_at is not None
    with pytest.raises(LookupError):
        h.lift(h.lift(placed, hold, NOW), hold, NOW)
    with pytest.raises(LookupError):
        h.place(empty, targets, **about | {"tenant_id": "b"})
    called = []
    target = spark.createDataFrame([(UUID(1), "r", "a"), (UUID(1), "s", "a")], "entity_id string, record_id string, tenant_id string")
    assert h.guarded_deletion(target, placed, NOW, lambda: called.append(1)) == "Protected" and not called
    assert h.guarded_deletion(target, empty, NOW, lambda: called.append(1)) == "Executed" and called


def test_hold_placed_during_a_pass_protects(make, spark):
    late = spark.createDataFrame([("h", NOTE.entity_id, "old", "a", "case", NOW - DAY, None, None)], HOLDS)
    calls = []

    def source():
        calls.append(1)
        return late if len(calls) > 1 else late.where("1 = 0")

    engine, table = make(NOTE, hold_source=source)
    engine.sweep(A, NOW)
    assert "old" in ids(table)


def test_erasure(make):
    engine, table = make(NOTE)
    dry = engine.erase(A, "x", NOW, dry=True)
    assert (dry.counts[0].affected, dry.counts[0].held, dry.counts[0].null_anchor) == (4, 1, 0)
    assert engine.erase(A, "x", NOW).total == 4
    assert ids(table) == {"held", "else"}
    assert ledger.runs(engine.events()).where("trigger = 1").count() == 2


def test_erasure_with_legal_minimum(make):
    engine, table = make(NOTE, rules=RuleBook({"short": Rule(365 * DAY, Strategy.PURGE, 30 * DAY)}))
    c = engine.erase(A, "x", NOW).counts[0]
    assert (c.affected, c.held, c.null_anchor) == (1, 1, 1)


def test_soft_delete_is_no_erasure(make):
    engine, _ = make(SOFT)
    with pytest.raises(ConfigurationError):
        engine.erase(A, "x", NOW)
    assert engine.erase(A, "x", NOW, allow_soft_delete=True).total == 4


def test_failures_stay_with_their_entity(make):
    engine, _ = make(NOTE, rules=RuleBook({"other": Rule(DAY, Strategy.PURGE)}))
    out = engine.sweep(A, NOW)
    assert out.status == RunStatus.PARTIALLY_FAILED and "no rule" not in out.failures["note"]
    with pytest.raises(ConfigurationError):
        make(NOTE, options=Options(dry_run=True))[0].sweep(A, NOW)


def test_observers_and_worker(make):
    seen = []

    def broken(_):
        raise RuntimeError

    engine, _ = make(NOTE, observers=[broken, seen.append])
    out = worker.tick(engine, [A, Tenant("a", "de"), Tenant("b")], NOW)
    assert [r.total for r in out] == [1, 1, 0]
    assert [e["kind"] for e in seen][:4] == ["started", "progress", "summary", "settled"] and seen[0]["trigger"] == int(Trigger.SCHEDULED)
    assert worker.tick(make(NOTE, options=Options(enabled=False))[0], [A], NOW) == []


def test_snapshots_refuse_lost_updates(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    first = s.write(spark.range(3))
    s.commit(first, 0)
    with pytest.raises(Conflict):
        s.commit(s.write(spark.range(4)), 0)
    assert s.current().count() == 3


def test_plan_order_and_validation(spark):
    child = Entity("child", UUID(5), "short", "at", parents=("note",))
    assert [e.name for e in execution_order([NOTE, child])] == ["child", "note"]
    with pytest.raises(ConfigurationError):
        execution_order([Entity("a", UUID(6), "short", "at", parents=("b",)), Entity("b", UUID(7), "short", "at", parents=("a",))])
    assert first_of_each([Tenant("a"), Tenant("a", "de")])[1] == ["a"]
    df = spark.createDataFrame(BOUNDARY, COLUMNS)
    validate([NOTE, SOFT, CONTACT], dict.fromkeys(("note", "soft", "contact"), df), RULES.capabilities)
    with pytest.raises(ConfigurationError) as wrong:
        validate([NOTE, Entity("c", NOTE.entity_id, "short", "at", cascades=("note",))], {"note": df, "c": df.drop("tenant_id").withColumn("at", F.col("at").cast("timestamp_ntz"))}, RULES.capabilities)
    assert len(wrong.value.problems) == 4
    with pytest.raises(SchemaError):
        check(df, HOLDS)


def stored_ids(spark, root):
    """The ids in every Parquet file that lies anywhere under a folder."""
    found = set()
    for f in Path(root).rglob("*.parquet"):
        names = spark.read.parquet(str(f)).columns
        found |= {r[0] for r in spark.read.parquet(str(f)).select("id" if "id" in names else names[0]).collect()}
    return found


def test_purged_rows_leave_the_disk(make, spark):
    engine, table = make(NOTE)
    assert "old" in stored_ids(spark, table.root)
    engine.sweep(A, NOW)
    assert "old" not in stored_ids(spark, table.root) and not list(Path(table.root).glob("labels-*"))


def test_only_touched_files_are_rewritten(make, spark):
    engine, table = make(NOTE)
    more = spark.createDataFrame(rows(("x1", "a", 1, "x", None), ("x2", "b", 900, "x", None)), COLUMNS)
    base = table.version()
    table.commit(table.write(more), base, instead_of=[])
    kept = set(table.files(table.manifest()["files"][-1].partition("/")[0])) | {f for f in table.manifest()["files"]}
    assert engine.sweep(A, NOW).total == 1
    after = set(table.manifest()["files"])
    assert len(kept & after) >= 1 and ids(table) == {"young", "edge", "held", "null", "else", "x1", "x2"}


def test_counting_prunes_the_scan(make):
    engine, table = make(NOTE)
    plan = countable(table.current(), NOTE, RULES.rules["short"], NOW, tenant="a")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.partition("PushedFilters: ")[2].partition("]")[0]
    assert "LessThan(at" in pushed and "EqualTo(tenant_id,a)" in pushed


def test_change_and_ledger_come_together(make, monkeypatch):
    """A writer that dies between the commit and the publication of its events loses neither; one that dies before the
    commit leaves neither."""
    engine, table = make(SOFT)

    def die(_, batches):
        if batches:
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", die)
        m.setattr(engine.log, "append", lambda rows: None)
        with pytest.raises(KeyboardInterrupt):
            engine.sweep(A, NOW)
    assert [r.id for r in table.current().where("is_deleted").collect()] == ["old"]
    assert [r.record_id for r in ledger.details(engine.events()).collect()] == ["old"]
    engine, table = make(NOTE)
    with monkeypatch.context() as m:
        m.setattr(table, "commit", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("lost")))
        assert engine.sweep(A, NOW).status == RunStatus.PARTIALLY_FAILED
    assert "old" in ids(table) and engine.events().where("kind = 'progress' and entity = 'note'").isEmpty()
    assert engine.sweep(A, NOW).total == 1


def test_one_run_of_a_tenant_at_a_time(make, spark):
    engine, _ = make(NOTE)
    with snapshots.Lease(spark, engine.log.folder.root, f"run-{uuid.uuid5(uuid.NAMESPACE_OID, 'a').hex}", 60), pytest.raises(Conflict):
        engine.sweep(A, NOW)
    assert engine.sweep(A, NOW).total == 1


def test_readiness(make):
    engine, table = make(Entity("note", UUID(1), "short", "nowhere"))
    with pytest.raises(ConfigurationError):
        engine.preview(A, NOW)
    engine, table = make(NOTE, data=BOUNDARY + BOUNDARY[:1])
    engine.ready()
    with pytest.raises(ConfigurationError):
        engine.ready(ids=True)


def seen_before(row, context):
    if row["subject"] == "bad":
        raise ValueError("secret")
    return {"id": row["id"], "at": row["at"], "why": context["strategy"]}


def after_seen(row, snapshot):
    assert snapshot["id"] == row["record_id"] and snapshot["why"] == "PURGE" and row["entity"] == "note"


@pytest.mark.parametrize("entity", [NOTE, Entity("note", UUID(1), "anon", "at", fields=(Anonymised("name", "gone"),))])
def test_handlers(make, spark, tmp_path, entity):
    """Rows whose hook fails stay and are counted as skipped; others change, and their handlers run from the queue in
    order, with the snapshot taken before."""
    data = rows(("one", "a", 40, "x", None), ("two", "a", 50, "bad", None), ("three", "a", 60, "y", None), ("young", "a", 1, "bad", None))
    purge = entity is NOTE
    handlers = [Handler("late", after=after_seen if purge else good, priority=None), Handler("first", seen_before, after_seen if purge else good, priority=1), Handler("capture", seen_before, phase=Phase.AFTER_RUN_SETTLED, priority=2)]
    engine, table = make(entity, data=data, holds=(), handlers={"note": handlers}, queue=str(tmp_path / "work"))
    out = engine.sweep(A, NOW)
    assert (out.counts[0].affected, out.counts[0].skipped) == (2, 1)
    changed = {"one", "three"}
    assert ids(table) == {"two", "young"} if purge else {r.id for r in table.current().where("name = 'gone'").collect()} == changed
    work = {(r.detail_id, r.handler): r for r in engine.row_queue.rows(QUEUE).collect()}
    record = {r.id: r for r in engine.row_details.rows(DETAILS).collect()}
    got = sorted((record[d].record_id, h, r.state, r.phase) for (d, h), r in work.items())
    assert got == [("one", "first", 0, 0), ("one", "late", 0, 0), ("three", "first", 0, 0), ("three", "late", 0, 0), ("two", "first", 3, 0)]
    assert all((record[d].payload is None) == (record[d].record_id == "two") for d, _ in work)
    assert all(work[d, "first"].id < work[d, "late"].id for d, r in record.items() if r.record_id != "two")
    assert "secret" not in next(r.last_error for r in work.values() if r.state == 3)
    summary = ledger.summaries(engine.events()).where("entity = 'note'").first()
    assert (summary.affected, summary.skipped) == (2, 1)
    again = engine.sweep(A, NOW)
    assert (again.counts[0].affected, again.counts[0].skipped) == (0, 1) and len({r.id for r in engine.row_details.rows(DETAILS).collect()}) == 4
    if purge:
        queue, kept = Snapshots(spark, str(tmp_path / "queue")), Snapshots(spark, str(tmp_path / "kept"))
        queue.commit(queue.write(engine.row_queue.rows(QUEUE)), 0)
        kept.commit(kept.write(engine.row_details.rows(DETAILS)), 0)
        late = {"late": lambda row, _: None, "first": after_seen}
        dispatcher.flush(queue, kept, ledger.runs(engine.events()), late, Options(dispatch_batch=3), NOW)
        assert {r.state for r in queue.current().where("state <> 3").collect()} == {2}
        assert kept.current().where("payload is not null").isEmpty()


def test_handler_registration(make, tmp_path):
    assert [h.name for h in in_order([Handler("b"), Handler("a"), Handler("z", priority=5), Handler("y", priority=2), Handler("b")])] == ["y", "z", "a", "b"]
    with pytest.raises(ConfigurationError):
        in_order([Handler("b"), Handler("b", phase=Phase.AFTER_RUN_SETTLED)])
    with pytest.raises(ConfigurationError):
        make(NOTE, handlers={"note": [Handler("a")]})
    with pytest.raises(ConfigurationError):
        make(NOTE, handlers={"other": [Handler("a")]}, queue=str(tmp_path / "q"))


def test_factories_are_told_what_for(make):
    fields = (Anonymised("name", factory=lambda _, c: f"{c.entity}.{c.column} of {c.tenant_id}"), Anonymised("mail", factory=lambda v, c: F.concat(v, F.lit(c.now.year)), mode=Mode.PER_ROW_WITH_ORIGINAL), Anonymised("nick", factory=lambda _, c: c.column, mode=Mode.PER_ROW))
    engine, table = make(Entity("contact", UUID(3), "anon", "at", fields=fields))
    engine.sweep(A, NOW)
    assert tuple(table.current().where("id = 'old'").select("name", "mail", "nick").first()) == ("contact.name of a", "m2026", "nick")


def test_final_errors_are_not_tried_again(spark, tmp_path):
    """A handler that isn't registered and a payload past its retention are dead letters after one attempt, and an
    abandoned run is failed."""
    q, details, runs = queue_tables(spark, tmp_path, [(1, 1, "none", 0), (2, 2, "good", 0), (3, 3, "good", 0)])
    old = details.withColumn("at", F.when(F.col("id") == 2, F.col("at") - F.expr("interval 30 days")).otherwise(F.col("at")))
    abandoned = Snapshots(spark, str(tmp_path / "runs"))
    abandoned.commit(abandoned.write(runs.withColumns({"status": F.lit(0), "settled_at": F.lit(None).cast("timestamp"), "started_at": F.lit(NOW - 5 * DAY)})), 0)
    dispatcher.flush(q, old, abandoned, {"good": good}, Options(max_attempts=7), NOW)
    assert {r.id: (r.state, r.attempt) for r in q.current().collect()} == {1: (3, 1), 2: (3, 1), 3: (2, 1)}
    assert [r.status for r in abandoned.current().collect()] == [RunStatus.FAILED]


def test_batches_of_a_large_tenant(spark):
    """A tenant over many partitions is numbered like one sorted as a whole."""
    data = rows(*[(f"r{i:04d}", "a" if i % 9 else "b", 31 + i * 7 % 400, "x", None) for i in range(900)], ("n", "a", None, "x", None))
    df = spark.createDataFrame(data, COLUMNS).repartition(5)
    want = {}
    for t in "ab":
        own = sorted((x for x in data if x[1] == t), key=lambda x: (x[2] is None, x[2], x[0]))
        want |= {x[0]: k // 50 for k, x in enumerate(own)}
    got = batching.batches(df, NOTE, 50)
    assert {r.id: r.batch_no for r in got.collect()} == want


def queue_tables(spark, tmp_path, statuses):
    q = Snapshots(spark, str(tmp_path / "queue"))
    base = [(i, d, hd, 0, s, 0, NOW, NOW, None, None, None, None) for i, d, hd, s in statuses]
    q.commit(q.write(spark.createDataFrame(base, QUEUE)), 0)
    details = spark.createDataFrame([(d, "r", NOW, "note", UUID(1), str(d), "short", 0, "a", encode_snapshot({"d": d})) for d in {x[1] for x in statuses}], DETAILS)
    runs = spark.createDataFrame([("r", NOW, 1, NOW, 0, 2, False, "a", 1, None)], RUNS)
    return q, details, runs


def good(row, snapshot):
    assert str(snapshot["d"]) == row["record_id"]


def bad(row, snapshot):
    raise ValueError("secret")


def test_dispatcher(spark, tmp_path):
    q, details, runs = queue_tables(spark, tmp_path, [(1, 1, "good", 0), (2, 1, "good", 0), (3, 2, "bad", 0), (4, 2, "good", 0), (5, 3, "none", 0)])
    left = dispatcher.flush(q, details, runs, {"good": good, "bad": bad}, Options(max_attempts=2), NOW)
    assert tuple(left.first()) == (0, 0)
    got = {r.id: r for r in q.current().collect()}
    assert [got[i].state for i in range(1, 6)] == [State.SUCCEEDED, State.SUCCEEDED, State.DEAD_LETTERED, State.DEAD_LETTERED, State.DEAD_LETTERED]
    assert got[3].attempt == 2 and "secret" not in got[3].last_error and got[4].attempt == 0


def test_stream(spark, tmp_path):
    q, details, runs = queue_tables(spark, tmp_path, [(1, 1, "good", 0)])
    arrivals = str(tmp_path / "arrivals")
    spark.createDataFrame([(7, 1, "other", 0, 0, 0, NOW, NOW, None, None, None, None), (1, 1, "good", 0, 0, 0, NOW, NOW, None, None, None, None)], QUEUE).write.parquet(arrivals)
    s = dispatcher.stream(spark, arrivals, q, lambda: details, lambda: runs, {"good": good, "other": good}, Options(), str(tmp_path / "cp"), lambda: NOW)
    s.awaitTermination(120)
    assert {r.id: r.state for r in q.current().collect()} == {1: 2, 7: 2}


def test_flush_leaves_settled_files_alone(spark, tmp_path):
    """Files without open work stay as they are, those of a detail with open work take part, and what a flush settles
    lies in files of its own."""
    q, details, runs = queue_tables(spark, tmp_path, [(1, 1, "good", 2), (2, 2, "bad", 3), (3, 3, "good", 2)])
    later = [(i, d, "good", 0, s, 0, NOW, NOW, None, None, None, None) for i, d, s in [(5, 2, 0), (6, 3, 0), (7, 4, 0)]]
    for row in later:
        q.commit(q.write(spark.createDataFrame([row], QUEUE).coalesce(1)), q.version(), instead_of=[])
    settled = {r[FILE] for r in q.current(with_file=True).where("id = 1").collect()} - {r[FILE] for r in q.current(with_file=True).where("id > 1").collect()}
    details = details.unionByName(details.limit(1).withColumns({"id": F.lit(4).cast("long"), "record_id": F.lit("4"), "payload": F.lit(encode_snapshot({"d": 4}))}))
    dispatcher.flush(q, details, runs, {"good": good}, Options(), NOW)
    assert {r.id: r.state for r in q.current().collect()} == {1: 2, 2: 3, 3: 2, 5: 3, 6: 2, 7: 2}
    kept = set(q.manifest()["files"])
    assert settled and settled <= kept
    version = q.version()
    dispatcher.flush(q, details, runs, {"good": good}, Options(), NOW)
    assert q.version() == version and set(q.manifest()["files"]) == kept
