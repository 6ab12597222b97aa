"""Comparisons shared by the tests; a module of its own, as two folders hold a ``conftest``."""


def cell(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return v


def rows(df):
    """Rows as sorted tuples, columns by name."""
    cols = sorted(df.columns)
    return sorted((tuple(cell(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
