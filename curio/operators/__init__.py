"""curio.operators."""
