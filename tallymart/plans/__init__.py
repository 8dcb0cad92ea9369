"""All queries of the engine and their SQL."""

from tallymart.plans import extraction, links, matching, operations, relational, scalars  # noqa: F401  registers
from tallymart.plans.registry import ORACLES, queries


def oracles() -> dict[str, str]:
    return ORACLES
