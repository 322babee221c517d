"""Every operator as a runnable query over the test tables, with the SQL of the same result."""

from inclina.catalog.base import ORACLE, QUERIES
from inclina.catalog import aggregation, modelling, preparation  # noqa: E402,F401  (they register)

__all__ = ["ORACLE", "QUERIES"]
