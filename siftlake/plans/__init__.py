"""The queries over the reference tables; importing this registers all of them."""

from siftlake.plans import chunks, misc, search, values, web  # noqa: F401
from siftlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
