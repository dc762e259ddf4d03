"""All registered queries and their SQL."""

from . import more_oracle, text_oracle  # noqa: F401  (they register their queries)
from .catalog import QUERIES
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]
