from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import periods as p
from tidemark.functions import text
from tidemark.plans.model import Options, Rule, Strategy, ConfigurationError, utc

NOW = utc("2026-04-12T12:00:00")
DAY = timedelta(days=1)


def test_cutoffs():
    assert p.cutoff(NOW, 30 * DAY) == NOW - 30 * DAY
    assert p.cutoff(NOW, 30 * DAY, 90 * DAY) == NOW - 90 * DAY
    assert p.cutoff(NOW, timedelta(0)) == NOW
    assert p.cutoff(NOW, timedelta.max) == p.EARLIEST
    assert p.erasure_cutoff(NOW, None) is None
    assert p.erasure_cutoff(NOW, 90 * DAY) == NOW - 90 * DAY
    with pytest.raises(ValueError):
        p.cutoff(NOW, -DAY, -DAY)


@pytest.mark.parametrize(("attempt", "seconds"), [(0, 0), (1, 1), (2, 2), (4, 8)])
def test_backoff(attempt, seconds):
    assert p.next_attempt(NOW, timedelta(seconds=1), attempt) == NOW + timedelta(seconds=seconds)


@given(st.integers(0, 1000), st.integers(0, 10**9))
def test_backoff_saturates(attempt, seconds):
    assert NOW <= p.next_attempt(NOW, timedelta(seconds=seconds), attempt) <= p.LATEST_RETRY


def test_cron():
    assert p.Cron("0 3 * * *").after(NOW) == datetime(2026, 4, 13, 3, tzinfo=UTC)
    assert p.Cron("*/15 * * * * *").after(NOW) == NOW + timedelta(seconds=15)
    assert p.Cron("0 0 1 JAN *").after(NOW) == datetime(2027, 1, 1, tzinfo=UTC)
    assert p.Cron("30 6 * * MON-FRI").after(NOW).isoweekday() == 1
    assert p.Cron("0 0 30 2 *").after(NOW) is None
    for bad in ("* * *", "61 * * * *", "0 0 0 * *"):
        with pytest.raises(ValueError):
            p.Cron(bad)


def test_chunks():
    assert p.chunks(timedelta(seconds=150)) == [timedelta(minutes=1)] * 2 + [timedelta(seconds=30)]


def test_texts():
    try:
        raise ValueError("secret name")
    except ValueError as error:
        assert "secret" not in text.diagnostic(error) and text.diagnostic(error).startswith("type=builtins.ValueError;code=")
    assert text.shorten("a\n" + "b" * 5000) == "a"
    assert text.quoted("a.b`c") == "`a`.`b``c`"
    values = {"a": 1, "b": [uuid.UUID(int=3), Decimal("1.50"), None], "c": {"d": NOW, "e": DAY, "f": b"\x00\xff"}}
    assert text.decode_snapshot(text.encode_snapshot(values)) == values
    with pytest.raises(TypeError):
        text.encode_snapshot({"a": object()})
    with pytest.raises(TypeError):
        text.decode_snapshot('{"a": {"$type": "os", "$value": 1}}')


def test_invariants():
    for bad in ({"batch": 0}, {"max_attempts": 1001}, {"dispatch_batch": 10_001}, {"dispatch_parallelism": 257}, {"lease": timedelta(seconds=29)}):
        with pytest.raises(ConfigurationError):
            Options(**bad)
    with pytest.raises(ConfigurationError):
        Rule(-DAY, Strategy.PURGE)
