"""The scheduled worker: on each tick one pass per tenant, then one for tenantless entities; missed ticks are skipped."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from tidemark.engine import Engine, Result
from tidemark.functions.periods import Cron
from tidemark.functions.text import diagnostic
from tidemark.plans.model import Tenant, Trigger
from tidemark.plans.order import first_of_each

log = logging.getLogger(__name__)


def tick(engine: Engine, tenants: list[Tenant], now: datetime) -> list[Result]:
    if not engine.options.enabled:
        return []
    chosen, conflicts = first_of_each(tenants)
    for i in conflicts:
        log.warning("tenant %s has several contexts; the first counts", i)
    run = engine.dry_run if engine.options.dry_run else engine.sweep
    out = []
    for t in [*chosen, None]:
        try:
            out.append(run(t, now, Trigger.SCHEDULED))
        except Exception as error:
            log.error("a pass failed: %s", diagnostic(error))
    return out


def work(engine: Engine, cron: Cron, tenants: Callable[[], list[Tenant]], clock: Callable[[], datetime], wait: Callable[[datetime], bool]) -> None:
    """Run until ``wait(until)`` says to stop; the next tick is always after the present, so late ones are skipped."""
    while (at := cron.after(clock())) is not None and wait(at):
        tick(engine, tenants(), at)
