"""Retention arithmetic on the driver: cutoffs, retries, schedules.  Spark's own arithmetic doesn't saturate."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST = datetime.min.replace(tzinfo=UTC)
#: Retries are never scheduled later than a year before the end of time.
LATEST_RETRY = datetime.max.replace(tzinfo=UTC) - timedelta(days=365)
ZERO = timedelta(0)


def effective_period(period: timedelta, legal_minimum: timedelta | None = None) -> timedelta:
    """The longer of a rule's period and its legal minimum."""
    return max(period, legal_minimum or ZERO)


def minus(now: datetime, span: timedelta) -> datetime:
    """``now - span``, but no earlier than the first representable time."""
    return EARLIEST if span > now - EARLIEST else now - span


def cutoff(now: datetime, period: timedelta, legal_minimum: timedelta | None = None) -> datetime:
    """Rows strictly older than this are due; a zero period makes it ``now``."""
    span = effective_period(period, legal_minimum)
    if span < ZERO:
        raise ValueError("a retention period can't be negative")
    return minus(now, span)


def erasure_cutoff(now: datetime, legal_minimum: timedelta | None) -> datetime | None:
    """An erasure ignores the period: without a positive legal minimum there is no cutoff at all."""
    return minus(now, legal_minimum) if legal_minimum and legal_minimum > ZERO else None


def next_attempt(now: datetime, base: timedelta, attempt: int) -> datetime:
    """``now`` plus ``base`` doubled for each attempt after the first, saturating."""
    if now >= LATEST_RETRY:
        return LATEST_RETRY
    if attempt <= 0 or base <= ZERO:
        return now
    room = LATEST_RETRY - now
    return LATEST_RETRY if attempt > 62 or base > room / 2 ** (attempt - 1) else now + base * 2 ** (attempt - 1)


def backoff_seconds(attempt: Column, base_seconds: int, most_seconds: int) -> Column:
    """The same as a column of seconds, at most ``most_seconds``."""
    doubled = F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(62))) * F.lit(float(base_seconds))
    return F.when((attempt <= 0) | F.lit(base_seconds <= 0), F.lit(0)).otherwise(F.least(doubled, F.lit(float(most_seconds)))).cast("long")


def chunks(delay: timedelta, most: timedelta = timedelta(minutes=1)) -> list[timedelta]:
    """A long delay as waits of at most ``most``, so a stop request is seen in time."""
    whole, rest = divmod(max(delay, ZERO), most)
    return [most] * whole + ([rest] if rest else [])


class Cron:
    """Five fields (minute hour day month weekday) or six with seconds first, in UTC; day and weekday both given are
    alternatives, as in cron."""

    _RANGES = {"second": (0, 59), "minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
    _NAMES = {n: i + 1 for i, n in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())} | {n: i for i, n in enumerate("SUN MON TUE WED THU FRI SAT".split())}

    def __init__(self, text: str):
        fields = text.split()
        if len(fields) not in (5, 6):
            raise ValueError(f"a schedule has 5 or 6 fields: {text!r}")
        given = fields if len(fields) == 6 else ["0", *fields]
        self.any = {k: v in ("*", "?") for k, v in zip(self._RANGES, given, strict=True)}
        self.of = {k: self._values(k, v) for k, v in zip(self._RANGES, given, strict=True)}
        if 7 in self.of["weekday"]:
            self.of["weekday"] = self.of["weekday"] - {7} | {0}

    def _values(self, kind: str, text: str) -> set[int]:
        low, high = self._RANGES[kind]
        out: set[int] = set()
        for part in text.upper().split(","):
            span, _, step = part.partition("/")
            first, _, last = span.partition("-")
            number = lambda x: self._NAMES[x] if x in self._NAMES else int(x)
            a, b = (low, high) if span in ("*", "?") else (number(first), number(last) if last else high if step else number(first))
            if not (low <= a <= b <= high) or (step and int(step) < 1):
                raise ValueError(f"{part!r} is no {kind}")
            out |= set(range(a, b + 1, int(step) if step else 1))
        return out

    def _day(self, t: datetime) -> bool:
        day, week = t.day in self.of["day"], t.isoweekday() % 7 in self.of["weekday"]
        return t.month in self.of["month"] and (day and week if self.any["day"] or self.any["weekday"] else day or week)

    def after(self, now: datetime) -> datetime | None:
        """The first tick strictly after ``now``; None if there is none in eight years."""
        t = now.astimezone(UTC).replace(microsecond=0) + timedelta(seconds=1)
        end = t + timedelta(days=8 * 366)
        while t < end:
            if not self._day(t):
                t = t.replace(hour=0, minute=0, second=0) + timedelta(days=1)
            elif t.hour not in self.of["hour"]:
                t = t.replace(minute=0, second=0) + timedelta(hours=1)
            elif t.minute not in self.of["minute"]:
                t = t.replace(second=0) + timedelta(minutes=1)
            elif t.second not in self.of["second"]:
                t += timedelta(seconds=1)
            else:
                return t
        return None
