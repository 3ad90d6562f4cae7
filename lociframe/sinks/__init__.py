"""Nested result documents and the writers."""
