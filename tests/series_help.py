"""What tests of frames share."""

import math
from datetime import datetime

START = datetime(2024, 1, 1)


def values(df, column, symbol="a"):
    """One column of one symbol in order of time; NaN as None."""
    out = [r[column] for r in df.where(f"symbol = '{symbol}'").orderBy("ts").collect()]
    return [None if isinstance(v, float) and math.isnan(v) else v for v in out]


def alike(got, wanted):
    return len(got) == len(wanted) and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 * (1 + abs(b))) for a, b in zip(got, wanted))
