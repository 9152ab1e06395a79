"""Comparison of results as multisets of rows."""


import pandas as pd


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or value is pd.NA or value != value:
        return "NULL"
    if isinstance(value, bool) or not isinstance(value, (int, float)) or abs(value) >= 2**53:
        return str(value)
    return repr(round(float(value), 6))  # a column with NULLs may come as floats


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))
