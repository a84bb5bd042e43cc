"""All queries of the reference's operators and their SQL."""

from hexlore.plans import learning, run, series, space  # noqa: F401
from hexlore.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
