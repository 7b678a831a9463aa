"""curio.functions."""
