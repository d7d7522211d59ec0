"""Jobs, the query registry, plan inspection and sizing helpers."""
