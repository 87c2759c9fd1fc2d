"""All registered queries."""

from tarmac.plans import ingestion, scoring, serving, telemetry  # noqa: F401  they register themselves
from tarmac.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
