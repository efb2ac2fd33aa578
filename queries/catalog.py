"""All queries."""

import queries.copies  # noqa: F401
import queries.listing  # noqa: F401
import queries.placing  # noqa: F401
import queries.planning  # noqa: F401
import queries.running  # noqa: F401
import queries.scanning  # noqa: F401
import queries.streams  # noqa: F401
from queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
