"""Bars for tests."""

import datetime as dt

import numpy as np

BAR = "contract string, datetime timestamp, open double, high double, low double, close double, volume long, poc double, delta long, open_interest long"


def small_bars(spark, n=320):
    rows = []
    for contract, seed in (("A", 0), ("B", 1)):
        r = np.random.default_rng(seed)
        close = (1000 + np.cumsum(r.normal(0.1, 3, n)).round(1)).tolist()
        for i in range(n):
            o = close[i - 1] if i else close[0]
            h, low, v = max(o, close[i]) + float(r.integers(0, 4)), min(o, close[i]) - float(r.integers(0, 4)), int(r.integers(1, 100))
            rows.append((contract, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), o, h, low, close[i], v, float(round((h + low) / 2)), int(r.integers(-v, v + 1)), 100000 + int(r.integers(-500, 500))))
    return spark.createDataFrame(rows, BAR)
