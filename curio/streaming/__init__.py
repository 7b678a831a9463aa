"""curio.streaming."""
