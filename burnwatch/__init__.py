"""Service-level-objective analytics as lazy Spark DataFrame operators."""

from burnwatch.plans.tables import SloTables

__all__ = ["SloTables"]
