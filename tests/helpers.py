"""Small frames for literal-row tests."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def at(h):
    return START + timedelta(hours=h)


def series(spark, values, region="A", start=0, name="demand_mw"):
    """Dense hourly rows of one region; None is an absent reading."""
    rows = [(region, at(start + i), start + i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"region string, ts timestamp, h long, {name} double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("region", "ts"))).collect()]


def close(a, b, tol=1e-9):
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        if x is None or y is None:
            assert x is None and y is None, (x, y)
        else:
            assert abs(x - y) <= tol * max(1.0, abs(y)), (x, y)
