"""Four-axis scope (project, user, agent, session) under the modes boost, filter, strict and none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("project_id", "user_id", "agent_id", "session_id")


def axis_allows(axis: Column, value: str | None, mode: str) -> Column:
    if value is None or mode not in ("filter", "strict"):
        return F.lit(True)
    return axis.eqNullSafe(F.lit(value)) | axis.isNull() if mode == "filter" else axis.eqNullSafe(F.lit(value))


def allows(scope: dict[str, str], mode: str, axes: tuple[str, ...] = AXES) -> Column:
    """scope: the query's values by axis. A table without an axis leaves it out of axes."""
    return reduce(lambda a, b: a & b, (axis_allows(F.col(a), scope.get(a), mode) for a in axes), F.lit(True))


def hard(scope: dict[str, str]) -> Column:
    """Introspection's scope: equal, and rows without a value stay out."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(a) == v, F.lit(False)) for a, v in scope.items()), F.lit(True))


def guard(scope: dict[str, str], axes: tuple[str, ...] = AXES) -> Column:
    """Of a row asked for by its id: another scope's is as if it weren't there; rows without a value are shared."""
    return allows(scope, "filter", axes)


def same_bucket(project: str | None, user: str | None, unscoped_too: bool = False) -> Column:
    """The deduplication bucket: the project's rows (and unscoped ones if asked), or only unscoped rows without a project; the user null-safe."""
    own = F.col("project_id").eqNullSafe(F.lit(project))
    in_project = F.col("project_id").isNull() if project is None else own | F.col("project_id").isNull() if unscoped_too else own
    return in_project & F.col("user_id").eqNullSafe(F.lit(user))


def boost(scope: dict[str, str], mode: str | None, project: float = 1.2, user: float = 1.1) -> Column:
    """A multiplier for matching project and user, under an explicit boost mode alone."""
    factor = F.lit(1.0)
    for axis, by in (("project_id", project), ("user_id", user)):
        if mode == "boost" and scope.get(axis) is not None:
            factor = factor * F.when(F.col(axis) == scope[axis], by).otherwise(1.0)
    return factor
