"""Readers. Each has a parse step on a DataFrame of lines, so it also works on lines Spark has built itself."""
