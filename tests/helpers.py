"""Small frames shared by the tests."""

from datetime import date, timedelta

DAY = 86_400_000_000_000


def ns(text: str) -> int:
    return (date.fromisoformat(text) - date(1970, 1, 1)).days * DAY


def day(i: int, start: str = "2025-10-06") -> int:
    return ns(start) + i * DAY


def rows(df):
    return [tuple(r) for r in df.collect()]


def as_date(value: int) -> date:
    return date(1970, 1, 1) + timedelta(days=value // DAY)
