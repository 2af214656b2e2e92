"""Valid time [from, to), redaction and liveness as Column predicates: one place for each rule, used before and after top-k alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_at(at: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def as_of(at: Column | None, now: Column, include_superseded: bool = False) -> Column:
    """The interval rule of a request: an explicit instant, else none if superseded rows are wanted, else now."""
    return valid_at(at) if at is not None else F.lit(True) if include_superseded else valid_at(now)


def visible(deleted: str = "deleted_at") -> Column:
    return F.col(deleted).isNull()


def overlaps(start: Column, end: Column) -> Column:
    """Of a window: what ended by its start or began after its end is out; what begins at its end is in."""
    return (F.col("valid_to").isNull() | (F.col("valid_to") > start)) & (F.col("valid_from") <= end)


def live(now: Column, expires: str = "expires_at") -> Column:
    return F.col(expires).isNull() | (F.col(expires) > now)


def well_formed() -> Column:
    return F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("valid_from"))


def closes_at(old_from: Column, new_from: Column) -> Column:
    return F.greatest(old_from, new_from)


def days_since(then: Column, now: Column) -> Column:
    """Fractional days, 0 at least."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000.0))
