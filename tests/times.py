"""Times as the tests write and read them."""

from datetime import datetime, timezone


def at(text: str) -> datetime:
    """A UTC time as Spark takes it from Python."""
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def utc(value):
    """A collected timestamp as naive UTC."""
    return None if value is None else value.astimezone(timezone.utc).replace(tzinfo=None)
