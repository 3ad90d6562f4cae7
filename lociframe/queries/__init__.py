"""Queries on the shared test tables, each with the SQL that gives the same rows."""

from importlib import import_module

from lociframe.queries.base import ORACLES, QUERIES

for _name in ("coverage", "regions", "reads", "alignments", "calls", "annotation", "inbreeding", "scores", "loci", "taxa", "sources"):
    import_module(f"lociframe.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]
