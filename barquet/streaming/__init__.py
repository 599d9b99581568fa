"""Incremental batch steps; the engine has no unbounded streams."""
