"""The row-handler queue as a stream: at least once, in order within a row, retried with backoff, dead-lettered.

New queue rows are a stream of Parquet files; each micro-batch joins them to the stored queue, runs handlers on what
is due in parallel over the executors, and stores the queue's next snapshot.  Spark's own task retry takes the place of
leases and heartbeats inside a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import decode_snapshot, diagnostic, shorten
from tidemark.operators import queue as q
from tidemark.plans.model import Options
from tidemark.sources.schemas import QUEUE
from tidemark.sources.snapshots import FILE, Snapshots

Handler = Callable[[dict, dict], None]


def run_handlers(claimed: DataFrame, details: DataFrame, handlers: dict[str, Handler], parallelism: int | None = None) -> DataFrame:
    """(id, claim_token, error, final) of each claimed row; a handler gets the row's context and its own part of the
    decoded snapshot, or all of it where it isn't parted by handlers.  A scrubbed payload and a handler that isn't
    registered are final errors."""
    known = frozenset(handlers)

    def batch(frames):
        for f in frames:
            errors, final = [], []
            for row in f.to_dict("records"):
                lost = row["payload"] is None or row["handler"] not in known
                try:
                    if lost:
                        raise LookupError("the payload was scrubbed, or no such handler is registered")
                    taken = decode_snapshot(row["payload"])
                    handlers[row["handler"]](row, taken[row["handler"]] if isinstance(taken.get(row["handler"]), dict) else taken)
                    errors.append(None)
                except Exception as error:
                    errors.append(shorten(diagnostic(error)))
                final.append(lost)
            yield pd.DataFrame({"id": f["id"], "claim_token": f["claim_token"], "error": pd.array(errors, dtype="object"), "final": final})

    rows = claimed.join(details.select(F.col("id").alias("detail_id"), "record_id", "run_id", "tenant_id", "entity", "entity_id", "category", "strategy", "at", "payload"), "detail_id")
    rows = rows.select("id", "claim_token", "handler", "attempt", "record_id", "run_id", "tenant_id", "entity", "entity_id", "category", "strategy", "at", "payload")
    rows = rows.coalesce(parallelism) if parallelism else rows
    return rows.mapInPandas(batch, "id long, claim_token string, error string, final boolean")


def flush(queue: Snapshots, details: DataFrame | Snapshots, runs: DataFrame | Snapshots, handlers: dict[str, Handler], options: Options, now: datetime, *, ignore_backoff: bool = True, rounds: int = 1_000) -> DataFrame:
    """Work off the queue until nothing is due; (pending, in_flight) that is left.  Runs abandoned meanwhile count as
    failed, and payloads that nothing waits for, or that are past their retention, are gone afterwards: stored tables
    are changed, frames are read so.  Each round claims ``dispatch_batch`` rows, or all that are due without it, and
    rewrites only files that hold rows of a detail with open work; settled rows are written to files of their own."""
    far = datetime(9999, 1, 1, tzinfo=now.tzinfo) if ignore_backoff else now
    runs = _changed(runs, lambda df: q.fail_stale(df, now=now, timeout=options.run_timeout))
    stored_details = details
    details = _changed(details, lambda df: q.expire(df, now=now, retention=options.payload_retention))
    for _ in range(rounds):
        base, token = queue.version(), str(uuid.uuid4())
        touched = _open_files(queue)
        if not touched:
            break
        rows = q.dead_letter_exhausted(queue.current(files=touched), now=now, lease=options.lease, max_attempts=options.max_attempts)
        ready = q.due(rows, details, runs, now=now, lease=options.lease, max_attempts=options.max_attempts, due_at=far, limit=options.dispatch_batch)
        ids = ready.select("id", F.lit(True).alias("_claim"))
        marked = rows.join(ids, "id", "left")
        claimed = q.claim(marked.where("_claim").drop("_claim"), now, token)
        name = queue.write(marked.where("_claim is null").drop("_claim").unionByName(claimed).select(*QUEUE.fieldNames()), apart=~q.open_state())
        base = queue.commit(name, base, instead_of=touched)
        stored = queue.current(files=queue.files(name))
        own = stored.where(F.col("claim_token") == token)
        if own.limit(1).isEmpty():
            queue.vacuum()
            break
        told = queue.spark.read.parquet(f"{queue.root}/{(outcomes := queue.write(run_handlers(own, details, handlers, options.dispatch_parallelism)))}")
        after = q.settle(stored, told, now=now, base_seconds=int(options.base_backoff.total_seconds()), max_attempts=options.max_attempts)
        queue.commit(queue.write(after, apart=~q.open_state()), base, instead_of=queue.files(name))
        queue.folder.delete(outcomes)
        queue.vacuum()
    if isinstance(stored_details, Snapshots):
        _changed(stored_details, lambda df: q.scrub(df, queue.current(), now=now, retention=options.payload_retention))
    return q.remainder(queue.current())


def _open_files(queue: Snapshots) -> list[str]:
    """Files with a row of any detail that has open work: earlier rows of a detail decide about its open ones."""
    rows = queue.current(with_file=True).select("detail_id", "state", FILE)
    waiting = rows.where(q.open_state()).select("detail_id").distinct()
    return [r[FILE] for r in rows.join(waiting, "detail_id", "left_semi").select(FILE).distinct().collect()]


def _changed(table: DataFrame | Snapshots, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    if isinstance(table, DataFrame):
        return change(table)
    base = table.version()
    table.commit(table.write(change(table.current())), base)
    table.vacuum()
    return table.current()


def stream(spark: SparkSession, arrivals: str, queue: Snapshots, details: Callable[[], DataFrame | Snapshots], runs: Callable[[], DataFrame | Snapshots], handlers: dict[str, Handler], options: Options, checkpoint: str, clock: Callable[[], datetime], *, every: str | None = None) -> StreamingQuery:
    """Poll ``arrivals`` (queue rows) and work them off; without ``every`` the stream ends when it has seen all."""

    def work(rows: DataFrame, _: int) -> None:
        base = queue.version()
        known = queue.current() if base else spark.createDataFrame([], QUEUE)
        fresh = rows.join(known.select("id"), "id", "left_anti").dropDuplicates(["detail_id", "handler"])
        queue.commit(queue.write(fresh.select(*QUEUE.fieldNames())), base, instead_of=[] if base else None)
        flush(queue, details(), runs(), handlers, options, clock(), ignore_backoff=False)

    writer = spark.readStream.schema(QUEUE).parquet(arrivals).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
