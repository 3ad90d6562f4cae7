"""Operators by subject; each module names the tables it reads and writes."""
