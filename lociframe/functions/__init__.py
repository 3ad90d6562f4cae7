"""Column expressions: genotype, text and scoring rules. Nothing here is a Python UDF."""
