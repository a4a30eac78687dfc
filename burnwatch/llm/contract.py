"""What the entry module takes from this subpackage: queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from burnwatch.llm.oracle import ORACLE
from burnwatch.llm.queries import QUERIES as OPERATORS

QUERIES = {**OPERATORS, "pipeline": corpus_pipeline.run}

__all__ = ["ORACLE", "QUERIES"]
