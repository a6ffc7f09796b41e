"""Pluggable judgment.  A judge turns rows into rows; the deterministic ones here need no service."""
