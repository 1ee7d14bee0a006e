"""Text of the ledger: diagnostics without messages, type names, identifiers, snapshots."""

from __future__ import annotations

import base64
import json
import re
import uuid
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ERROR = 4000


def diagnostic(error: BaseException) -> str:
    """What may be stored of an error: its root's type, a machine code and an id, never its message."""
    while error.__cause__ is not None:
        error = error.__cause__
    name = re.sub(r"[^a-zA-Z0-9._+`]", "_", f"{type(error).__module__}.{type(error).__qualname__}"[:256]) or "Exception"
    state = getattr(error, "getSqlState", lambda: None)()
    code = f"sqlstate:{state}" if state and re.fullmatch(r"[0-9A-Z]{5}", state) else f"errno:{getattr(error, 'errno', None) or 0}"
    return f"type={name};code={code};diagnosticId={uuid.uuid4()}"


def shorten(text: str, most: int = MOST_ERROR) -> str:
    """At most ``most`` characters, ended at a whole line where there is one."""
    if len(text) <= most:
        return text
    whole = text.rfind("\n", 0, most)
    return text[:whole] if whole > 0 else text[:most]


def plain_type_name(name: Column) -> Column:
    """A stored type name without version, culture and key token."""
    return F.regexp_replace(name, r", (Version|Culture|PublicKeyToken)=[^,\]]+", "")


def quoted(name: str) -> str:
    """An identifier, each part in backticks."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def record_id(column: Column, kind: str = "string") -> Column:
    """A row's canonical id: cast to the id's own type, then to text; UUIDs in lower case."""
    return F.lower(column.cast("string")) if kind == "uuid" else column.cast(kind).cast("string")


_TYPE, _VALUE = "$type", "$value"
#: The scalar types that a snapshot may hold beside JSON's own, and how they are written and read.
_SCALARS = {
    "uuid": (uuid.UUID, str, uuid.UUID),
    "datetime": (datetime, datetime.isoformat, datetime.fromisoformat),
    "date": (date, date.isoformat, date.fromisoformat),
    "timedelta": (timedelta, lambda v: [v.days, v.seconds, v.microseconds], lambda v: timedelta(*v)),
    "decimal": (Decimal, str, Decimal),
    "bytes": (bytes, lambda v: base64.b64encode(v).decode(), base64.b64decode),
}


def encode_snapshot(values: dict) -> str:
    """A captured snapshot as JSON; values of listed types are tagged, others are refused."""

    def enc(v):
        if v is None or isinstance(v, (bool, int, float, str)):
            return v
        if isinstance(v, dict):
            return {str(k): enc(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [enc(x) for x in v]
        for tag, (kind, write, _) in _SCALARS.items():
            if isinstance(v, kind):
                return {_TYPE: tag, _VALUE: write(v)}
        raise TypeError(f"a snapshot can't hold {type(v).__name__}")

    return json.dumps(enc(values), sort_keys=True)


def decode_snapshot(text: str) -> dict:
    def dec(v):
        if isinstance(v, dict):
            if set(v) == {_TYPE, _VALUE}:
                if v[_TYPE] not in _SCALARS:
                    raise TypeError(f"a snapshot can't hold {v[_TYPE]}")
                return _SCALARS[v[_TYPE]][2](v[_VALUE])
            return {k: dec(x) for k, x in v.items()}
        return [dec(x) for x in v] if isinstance(v, list) else v

    return dec(json.loads(text))
