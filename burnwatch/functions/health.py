"""Health ranking.  UNHEALTHY beats AT_RISK beats everything else, including NULL and unknown text."""

from __future__ import annotations

from burnwatch.schema import AT_RISK, HEALTHY, UNHEALTHY


def health_rank(health: str) -> str:
    return f"CASE WHEN {health} = '{UNHEALTHY}' THEN 2 WHEN {health} = '{AT_RISK}' THEN 1 ELSE 0 END"


def health_name(rank: str) -> str:
    """Inverse of ``health_rank``; a NULL rank (no rows on that side) reads as HEALTHY."""
    return f"CASE WHEN {rank} = 2 THEN '{UNHEALTHY}' WHEN {rank} = 1 THEN '{AT_RISK}' ELSE '{HEALTHY}' END"


def worst_health(health: str, where: str | None = None) -> str:
    """Aggregate: the worst health over the rows where ``where`` holds (all rows when not given)."""
    rank = health_rank(health)
    return health_name(f"max({rank})" if where is None else f"max(CASE WHEN {where} THEN {rank} END)")


def healthy_count(healths: list[str]) -> str:
    return " + ".join(f"CASE WHEN {health} = '{HEALTHY}' THEN 1L ELSE 0L END" for health in healths)


def colour_count(colour: str, severities: list[str]) -> str:
    """How many of the severity columns show this colour."""
    return " + ".join(f"CASE WHEN {severity} = '{colour}' THEN 1L ELSE 0L END" for severity in severities)
