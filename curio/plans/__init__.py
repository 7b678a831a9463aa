"""Named queries over the driver tables (``queries()`` / ``oracle_sql()``)."""

from curio.plans.registry import ORACLE, QUERIES  # noqa: F401
from curio.plans import catalog  # noqa: F401  (registers everything)
