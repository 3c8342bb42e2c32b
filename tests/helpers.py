"""Order-free comparison of a Spark result with a DuckDB result."""

import math

import numpy as np
import pandas as pd


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(round(float(v), 7) + 0.0)
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted("|".join(map(shown, r)) for r in frame[cols].itertuples(index=False))


def same(df, con, sql):
    assert rows(df.toPandas()) == rows(con.execute(sql).fetch_df())
