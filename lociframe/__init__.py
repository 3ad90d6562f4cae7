"""Cohort analytics for low-pass genomes, written as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by sample, so a whole cohort is one job. Operators name
their columns by parameter, so they also run on tables that have nothing to do with genomes.
"""

__version__ = "0.1.0"
