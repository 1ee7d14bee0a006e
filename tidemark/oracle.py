"""DuckDB SQL that says what the engine's queries say, from the same tables."""

from __future__ import annotations

EVENTS = """events_ AS (
    SELECT CAST(event_id AS VARCHAR) AS record_id, event_type AS tenant_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS anchor, event_id FROM events
), holds_ AS (
    SELECT 'a' || event_id AS hold_id, CAST(event_id AS VARCHAR) AS record_id, event_type AS tenant_id, TIMESTAMP '2024-01-01' AS created_at,
        CASE WHEN (event_id // 97) % 3 = 1 THEN TIMESTAMP '2024-01-20' END AS expires_at, CASE WHEN (event_id // 97) % 3 = 2 THEN TIMESTAMP '2024-01-25' END AS removed_at
    FROM events WHERE event_id % 97 = 0
    UNION ALL
    SELECT 'b' || event_id, CAST(event_id AS VARCHAR), event_type, TIMESTAMP '2024-01-02', NULL, NULL FROM events WHERE event_id % 291 = 0
), active AS (
    SELECT * FROM holds_ WHERE created_at <= TIMESTAMP '2024-01-31' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31') AND (removed_at IS NULL OR removed_at > TIMESTAMP '2024-01-31')
), labelled AS (
    SELECT *, CASE WHEN anchor IS NULL THEN 'null_anchor' WHEN anchor >= TIMESTAMP '2024-01-17' THEN 'retained'
        WHEN EXISTS (SELECT 1 FROM active a WHERE a.record_id = e.record_id AND a.tenant_id = e.tenant_id) THEN 'held' ELSE 'eligible' END AS label FROM events_ e
)"""
ORDERS = """labelled AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderpriority AS tenant_id, o_orderkey % 10 = 0 AS is_deleted,
        CASE WHEN o_orderkey % 10 = 0 THEN 'done' WHEN o_orderdate IS NULL THEN 'null_anchor' WHEN o_orderdate >= TIMESTAMP '2000-08-01' THEN 'retained' ELSE 'eligible' END AS label FROM orders
)"""
CUSTOMERS = """last_orders AS (SELECT o_custkey, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey
), labelled AS (
    SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_mktsegment AS tenant_id, c_name, c_acctbal, 'n' || c_nationkey AS note, c_custkey,
        CASE WHEN c_custkey % 10 = 0 THEN 'done' WHEN last_at IS NULL THEN 'null_anchor' WHEN last_at >= TIMESTAMP '{cut}' THEN 'retained' ELSE 'eligible' END AS label
    FROM customer LEFT JOIN last_orders ON o_custkey = c_custkey
)"""
PARTS = """labelled AS (
    SELECT p_partkey, CASE WHEN p_partkey % 400 <= 180 THEN 'retained' WHEN p_partkey % 25 = 0 THEN 'held' ELSE 'eligible' END AS label, p_partkey % 400 AS age FROM part
)"""
TURNS = """turns AS (
    SELECT conv_id || ':' || turn AS record_id, role AS tenant_id, CASE WHEN (conv_id + turn) % 7 <> 0 THEN turn * 30 END AS age, conv_id % 20 AS s, turn % 20 AS o FROM conversations
)"""
QUEUE = """queue AS (
    SELECT event_id AS id, event_id // 3 AS detail_id, event_id % 2 AS phase, [0, 2, 0, 1, 2, 3, 0][event_id % 7 + 1] AS state, event_id % 11 AS attempt, ts AS next_at FROM events
), details AS (SELECT event_id // 3 AS id, min(ts) AS first_at FROM events GROUP BY ALL
), runs AS (
    SELECT range AS n, 'r' || range AS run_id, range % 5 AS status, TIMESTAMP '2024-01-31' - to_days(range::INT) AS started_at FROM range(40)
)"""
COUNTS = "count(*) FILTER (WHERE label = 'eligible') AS affected, count(*) FILTER (WHERE label = 'held') AS held, count(*) FILTER (WHERE label = 'null_anchor') AS null_anchor"
OTHER = "count(*) FILTER (WHERE label = '{0}') AS {0}".format
BATCHES = "batches AS (SELECT *, (row_number() OVER (PARTITION BY tenant_id ORDER BY anchor NULLS LAST, record_id) - 1) // 100 AS batch_no FROM labelled WHERE label = 'eligible')"
EXHAUSTED = "hit AS (SELECT * FROM queue WHERE state = 1 AND next_at <= TIMESTAMP '2024-01-30 23:55:00' AND attempt >= 8)"


def _erase(label: str, more: str) -> str:
    return f"WITH {TURNS}, labelled AS (SELECT *, {label} AS label FROM turns) SELECT tenant_id, {COUNTS}{more} FROM labelled GROUP BY tenant_id"


def _customers(cut: str) -> str:
    return f"WITH {CUSTOMERS.format(cut=cut)} SELECT tenant_id, {COUNTS}, {OTHER('done')}, {OTHER('retained')} FROM labelled GROUP BY tenant_id"


def _document(value: str) -> str:
    return f"SELECT CAST(doc_id AS VARCHAR) AS record_id, md5(CASE WHEN doc_id > 30 THEN {value} ELSE text END) AS text, CASE WHEN doc_id > 30 THEN epoch(TIMESTAMP '2024-01-01')::BIGINT END AS anonymised FROM documents"


LEGAL = "CASE WHEN s IS DISTINCT FROM 3 THEN 'out_of_scope' WHEN age IS NULL THEN 'null_anchor' WHEN age <= 45 THEN 'retained' ELSE 'eligible' END"


def oracle_sql() -> dict[str, str]:
    e = f"WITH {EVENTS}"
    purge = f"{e} SELECT tenant_id, {COUNTS} FROM labelled GROUP BY tenant_id"
    return {
        "preview_purge": purge,
        "preview_soft_delete": f"WITH {ORDERS} SELECT tenant_id, {COUNTS}, {OTHER('done')}, {OTHER('retained')} FROM labelled GROUP BY tenant_id",
        "preview_anonymise": _customers("2001-07-02"),
        "legal_min_preview": _customers("2001-05-03"),
        "held_count": f"SELECT tenant_id, held FROM ({purge})",
        "null_anchor_count": f"SELECT tenant_id, null_anchor FROM ({purge})",
        "exempt_preview": "SELECT DISTINCT event_type AS tenant_id, 0::BIGINT AS affected, 0::BIGINT AS held, 0::BIGINT AS null_anchor FROM events",
        "tenantless_preview": f"WITH {PARTS} SELECT {COUNTS}, {OTHER('retained')} FROM labelled",
        "holds_list_active": f"{e} SELECT '00000000-0000-4000-8000-000000000001' AS entity_id, record_id, hold_id, tenant_id, epoch(created_at)::BIGINT AS created FROM active ORDER BY record_id, hold_id",
        "holds_has_active": f"{e} SELECT record_id, tenant_id FROM events_ v WHERE EXISTS (SELECT 1 FROM active a WHERE a.record_id = v.record_id AND a.tenant_id = v.tenant_id)",
        "holds_lifted": f"{e} SELECT hold_id, epoch(CASE WHEN hold_id = 'a0' THEN TIMESTAMP '2024-01-31' ELSE removed_at END)::BIGINT AS removed FROM holds_",
        "guarded_deletion": f"{e}, t AS (SELECT event_id // 40 AS request_id, EXISTS (SELECT 1 FROM active a WHERE a.record_id = v.record_id AND a.tenant_id = v.tenant_id) AS h FROM events_ v) SELECT request_id, count(*) AS targets, count(*) FILTER (WHERE h) AS held, CASE WHEN bool_or(h) THEN 'Protected' ELSE 'Executed' END AS outcome FROM t GROUP BY request_id",
        "purge_survivors": f"{e} SELECT record_id, tenant_id FROM labelled WHERE label <> 'eligible'",
        "purge_affected_ids": f"{e} SELECT record_id, tenant_id FROM labelled WHERE label = 'eligible'",
        "soft_delete_result": f"WITH {ORDERS} SELECT record_id, is_deleted OR label = 'eligible' AS is_deleted, CASE WHEN is_deleted THEN epoch(TIMESTAMP '2000-01-01')::BIGINT WHEN label = 'eligible' THEN epoch(TIMESTAMP '2001-08-01')::BIGINT END AS deleted FROM labelled",
        "anonymise_result": f"WITH {CUSTOMERS.format(cut='2001-07-02')} SELECT record_id, CASE WHEN label = 'eligible' THEN '[redacted]' ELSE c_name END AS name, CASE WHEN label <> 'eligible' THEN c_acctbal END AS balance, CASE WHEN label = 'eligible' THEN '' ELSE note END AS note, CASE WHEN label = 'done' THEN epoch(TIMESTAMP '2000-01-01')::BIGINT WHEN label = 'eligible' THEN epoch(TIMESTAMP '2001-08-01')::BIGINT END AS anonymised FROM labelled",
        "anonymise_factory_static": _document("'tombstone'"),
        "anonymise_factory_original": _document("sha256(text)"),
        "oldest_first_candidates": f"{e} SELECT record_id, tenant_id, epoch_us(anchor) AS occurred FROM labelled WHERE label = 'eligible' ORDER BY anchor NULLS LAST, record_id LIMIT 100",
        "batch_progress": f"{e}, {BATCHES} SELECT tenant_id, batch_no, count(*) AS affected, sum(event_id)::BIGINT AS id_sum FROM batches GROUP BY tenant_id, batch_no",
        "batch_progress_tenantless": f"WITH {PARTS}, b AS (SELECT *, (row_number() OVER (ORDER BY age DESC, CAST(p_partkey AS VARCHAR)) - 1) // 50 AS batch_no FROM labelled WHERE label = 'eligible') SELECT batch_no, count(*) AS affected, min(p_partkey)::BIGINT AS least, max(p_partkey)::BIGINT AS most FROM b GROUP BY batch_no",
        "erase_preview": _erase("CASE WHEN s IS DISTINCT FROM 3 THEN 'out_of_scope' ELSE 'eligible' END", f", {OTHER('out_of_scope')}"),
        "erase_legal_min": _erase(LEGAL, f", {OTHER('retained')}"),
        "erase_multi_subject": _erase("CASE WHEN s = 3 OR o = 3 THEN 'eligible' ELSE 'out_of_scope' END", ""),
        "erase_survivors": f"WITH {TURNS} SELECT record_id, tenant_id FROM turns WHERE {LEGAL} <> 'eligible'",
        "ledger_entity_summary": f"{e}, c AS ({purge.removeprefix(e)}) SELECT 'run-' || l.tenant_id AS run_id, l.tenant_id, 0 AS strategy, count(*) FILTER (WHERE label = 'eligible') AS affected, count(*) FILTER (WHERE label = 'eligible' AND event_id % 13 = 0) AS skipped, count(*) FILTER (WHERE label = 'held') AS held, count(*) FILTER (WHERE label = 'null_anchor') AS null_anchor, 1209600::BIGINT AS period_seconds FROM labelled l GROUP BY l.tenant_id",
        "ledger_run": f"{e} SELECT 'run-' || tenant_id AS run_id, 1 AS status, 2 AS trigger, 86400::BIGINT AS duration_seconds, count(*) FILTER (WHERE label = 'eligible') AS total_affected FROM labelled GROUP BY tenant_id",
        "row_detail": f"{e} SELECT 'run' AS run_id, tenant_id, record_id, CASE WHEN event_id % 2 = 0 THEN 'p' || record_id END AS payload FROM labelled WHERE label = 'eligible'",
        "failed_row_exclusion": f"{e} SELECT record_id, tenant_id FROM labelled WHERE label = 'eligible' AND event_id % 4 <> 0",
        "multi_tenant_sweep": f"{e}, own AS (SELECT *, CASE WHEN anchor IS NULL THEN 'null_anchor' WHEN anchor >= TIMESTAMP '2024-01-31' - to_days(CASE tenant_id WHEN 'click' THEN 7 WHEN 'view' THEN 14 WHEN 'error' THEN 21 ELSE 28 END) THEN 'retained' WHEN EXISTS (SELECT 1 FROM active a WHERE a.record_id = v.record_id AND a.tenant_id = v.tenant_id) THEN 'held' ELSE 'eligible' END AS label FROM events_ v) SELECT tenant_id, {COUNTS} FROM own GROUP BY tenant_id",
        "engine_sweep": f"{e} SELECT record_id, tenant_id FROM labelled WHERE label <> 'eligible' OR tenant_id NOT IN ('click', 'error')",
        "engine_ledger": f"{e}, c AS ({purge.removeprefix(e)}) SELECT c.tenant_id, dry_run, 1 AS status, affected AS total_affected, affected, 0::BIGINT AS skipped, held, null_anchor, 1209600::BIGINT AS period_seconds FROM c, (VALUES (true), (false)) AS t(dry_run) WHERE tenant_id IN ('click', 'error')",
        "engine_erase": f"WITH {TURNS} SELECT record_id, tenant_id FROM turns WHERE tenant_id IS DISTINCT FROM 'user' OR {LEGAL} <> 'eligible'",
        "handler_sweep": f"{e} SELECT record_id, tenant_id FROM labelled WHERE label <> 'eligible' OR tenant_id <> 'click' OR event_id % 10 = 3",
        "handler_failures": f"{e} SELECT record_id, 'notify' AS handler FROM labelled WHERE label = 'eligible' AND tenant_id = 'click' AND event_id % 10 = 3",
        "queue_enqueued": f"{e} SELECT record_id, handler, phase, nth, event_id AS value FROM labelled, (VALUES ('notify', 1, 1), ('store', 0, 2)) AS t(handler, phase, nth) WHERE label = 'eligible' AND tenant_id = 'click' AND event_id % 10 <> 3",
        "queue_drained": f"{e}, c AS (SELECT event_id % 10 = 3 AS lost FROM labelled WHERE label = 'eligible' AND tenant_id = 'click') SELECT handler, CASE WHEN lost THEN 3 ELSE 2 END AS state, count(*) AS rows, CASE WHEN lost THEN 0 ELSE 1 END AS attempts, 0::BIGINT AS payloads FROM c, (VALUES ('notify'), ('store')) AS t(handler) WHERE NOT lost OR handler = 'notify' GROUP BY ALL",
        "anonymise_factory_per_row": "SELECT count(*) AS rows, count(*) AS texts, 41 AS least, count(*) AS named FROM documents WHERE doc_id > 30",
        "tenant_dedup": "SELECT * FROM (VALUES ('a', 'de', true), ('b', 'fr', false), ('c', NULL, false)) AS t(tenant_id, jurisdiction, conflict)",
        "fk_child_first": "SELECT * FROM (VALUES (0, 'line'), (1, 'order_record'), (2, 'customer_profile'), (3, 'price_list')) AS t(position, entity)",
        "record_id_uniqueness": "SELECT l_orderkey || ':' || l_linenumber AS record_id, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1",
        "canonical_record_ids": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS number_id, lower('AB-' || hex(c_custkey)) AS uuid_id FROM customer",
        "type_names": "SELECT n_nationkey, 'My.Row' || n_nationkey || ', My' AS type_name FROM nation",
        "queue_due": f"WITH {QUEUE}, firsts AS (SELECT *, min(CASE WHEN state IN (0, 1) THEN id END) OVER (PARTITION BY detail_id) AS f FROM queue), d AS (SELECT q.* FROM firsts q JOIN details USING (detail_id) JOIN runs r ON r.n = q.detail_id % 40 WHERE (q.state = 0 AND next_at <= TIMESTAMP '2024-01-20' OR q.state = 1 AND next_at <= TIMESTAMP '2024-01-30 23:55:00' AND attempt < 10) AND f >= q.id AND (phase = 0 OR r.status <> 0) ORDER BY next_at, q.id LIMIT 200) SELECT id, (attempt + 1)::INT AS attempt, 1 AS state FROM d".replace("JOIN details USING (detail_id)", "JOIN details dt ON dt.id = q.detail_id"),
        "queue_blocked_siblings": f"WITH {QUEUE} SELECT q.id, q.detail_id FROM queue q WHERE state IN (0, 1) AND EXISTS (SELECT 1 FROM queue b WHERE b.detail_id = q.detail_id AND b.id < q.id AND b.state IN (0, 1))",
        "queue_settled": f"WITH {QUEUE}, s AS (SELECT *, state = 1 AND id % 5 <> 0 AND id % 3 <> 0 AS own FROM queue), a AS (SELECT *, CASE WHEN own AND id % 2 = 1 THEN 2 WHEN own AND attempt >= 10 THEN 3 WHEN own THEN 0 ELSE state END AS st FROM s), c AS (SELECT *, st IN (0, 1) AND EXISTS (SELECT 1 FROM a b WHERE b.detail_id = a.detail_id AND b.st = 3 AND b.id < a.id) AS dep FROM a) SELECT id, (CASE WHEN dep THEN 3 ELSE st END)::INT AS state, CASE WHEN own AND id % 2 = 0 AND attempt < 10 THEN epoch(TIMESTAMP '2024-01-31')::BIGINT + CASE WHEN attempt <= 0 THEN 0 ELSE (2 * pow(2, attempt - 1))::BIGINT END ELSE floor(epoch(next_at))::BIGINT END AS next_at, state <> 1 OR own OR dep AS free FROM c",
        "queue_dead_letter_cascade": f"WITH {QUEUE}, {EXHAUSTED}, a AS (SELECT id, detail_id, CASE WHEN id IN (SELECT id FROM hit) THEN 3 ELSE state END AS st FROM queue), b AS (SELECT id, CASE WHEN st IN (0, 1) AND EXISTS (SELECT 1 FROM a x WHERE x.detail_id = a.detail_id AND x.st = 3 AND x.id < a.id) THEN 3 ELSE st END AS state FROM a) SELECT state::INT AS state, count(*) AS rows, sum(id)::BIGINT AS id_sum FROM b GROUP BY 1",
        "queue_backoff": f"WITH {QUEUE} SELECT id, (CASE WHEN attempt <= 0 THEN 0 ELSE least(3 * pow(2, attempt - 1), 900) END)::BIGINT AS wait FROM queue",
        "queue_flush_remainder": f"WITH {QUEUE} SELECT count(*) FILTER (WHERE state = 0) AS pending, count(*) FILTER (WHERE state = 1) AS in_flight FROM queue",
        "stale_runs": f"WITH {QUEUE} SELECT run_id, epoch(started_at)::BIGINT AS started FROM runs WHERE status = 0 AND n >= 10 ORDER BY started_at, run_id",
        "stale_runs_failed": f"WITH {QUEUE} SELECT run_id, (CASE WHEN status = 0 AND n >= 10 THEN 3 ELSE status END)::INT AS status, CASE WHEN status = 0 AND n >= 10 THEN n * 86400 END::BIGINT AS duration_seconds, CASE WHEN status = 0 AND n >= 10 THEN 'the run was abandoned' END AS error FROM runs",
        "payload_scrub": f"WITH {QUEUE} SELECT id, CASE WHEN first_at >= TIMESTAMP '2024-01-11' AND EXISTS (SELECT 1 FROM queue q WHERE q.detail_id = d.id AND q.state IN (0, 1)) THEN 'p' || id END AS payload FROM details d",
        "dead_letter_union": f"WITH {QUEUE}, {EXHAUSTED} SELECT id FROM hit UNION SELECT q.id FROM queue q JOIN hit h ON q.detail_id = h.detail_id AND q.id > h.id WHERE q.state IN (0, 1)",
        "newest_per_tenant": f"{e}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY anchor DESC, record_id) AS rank FROM labelled WHERE label = 'eligible') SELECT tenant_id, rank::INT AS rank, record_id FROM r WHERE rank <= 3",
    }
