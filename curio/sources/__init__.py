from curio.sources.tables import TABLES, table  # noqa: F401
