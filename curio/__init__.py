"""curio: corpus curriculum analytics as Spark DataFrame operators."""

from curio.session import get_session, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_session", "ensure_checkpoint_dir"]
