"""Comparing results of Spark and DuckDB."""

import math
from decimal import Decimal

import pandas as pd


def cell(value):
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value) or value is pd.NA:
        return "null"
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.9g}"
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "item"):
        return cell(value.item())
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def assert_same(left, right):
    (columns, a), (others, b) = rows(left), rows(right)
    assert columns == others
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:3]
