"""Small helpers of the tests; a module of its own, as every test folder has a conftest."""

from __future__ import annotations

import datetime as dt


def day(n: int, start: str = "2024-01-01") -> dt.datetime:
    return dt.datetime.fromisoformat(start) + dt.timedelta(days=n)


def dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
