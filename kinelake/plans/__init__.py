"""Query plans over the given tables. Importing the package registers all of them."""

from kinelake.plans import basics, evaluation, exchange, live, ordered, smoothing  # noqa: F401
from kinelake.plans.registry import QUERIES, oracle

ORACLE = oracle()

__all__ = ["ORACLE", "QUERIES"]
