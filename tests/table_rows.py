"""Comparison helper of the tests; a module of its own, as a conftest cannot be imported by name."""


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
