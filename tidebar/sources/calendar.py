"""Instruments and their trading sessions as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_D3 = ("09:00:00-10:15:00", "10:30:00-11:30:00", "13:30:00-15:00:00")
_STOCK, _BOND = ("09:30:00-11:30:00", "13:00:00-15:00:00"), ("09:30:00-11:30:00", "13:00:00-15:15:00")
_23, _01, _0230 = ("21:00:00-23:00:00",), ("21:00:00-01:00:00",), ("21:00:00-02:30:00",)

#: Symbol, exchange, multiplier, tick size, day and night sessions.
INSTRUMENTS = [
    ("IH", "CFFEX", 300.0, 0.2, _STOCK, ()), ("IF", "CFFEX", 300.0, 0.2, _STOCK, ()), ("IC", "CFFEX", 200.0, 0.2, _STOCK, ()), ("IM", "CFFEX", 200.0, 0.2, _STOCK, ()),
    ("TS", "CFFEX", 20000.0, 0.002, _BOND, ()), ("TF", "CFFEX", 10000.0, 0.005, _BOND, ()), ("T", "CFFEX", 10000.0, 0.005, _BOND, ()), ("TL", "CFFEX", 10000.0, 0.01, _BOND, ()),
    ("au", "SHFE", 1000.0, 0.02, _D3, _0230), ("ag", "SHFE", 15.0, 1.0, _D3, _0230), ("cu", "SHFE", 5.0, 10.0, _D3, _01), ("al", "SHFE", 5.0, 5.0, _D3, _01), ("rb", "SHFE", 10.0, 1.0, _D3, _23), ("hc", "SHFE", 10.0, 1.0, _D3, _23),
    ("ru", "SHFE", 10.0, 5.0, _D3, _23), ("zn", "SHFE", 5.0, 5.0, _D3, _01), ("ni", "SHFE", 1.0, 10.0, _D3, _01), ("sn", "SHFE", 1.0, 10.0, _D3, _01), ("sp", "SHFE", 10.0, 2.0, _D3, _23), ("fu", "SHFE", 10.0, 1.0, _D3, _23),
    ("sc", "INE", 1000.0, 0.1, _D3, _0230), ("nr", "INE", 10.0, 5.0, _D3, _23), ("lu", "INE", 10.0, 1.0, _D3, _23), ("bc", "INE", 5.0, 10.0, _D3, _01), ("ec", "INE", 50.0, 0.1, _D3, ()),
    ("v", "DCE", 5.0, 1.0, _D3, _23), ("jd", "DCE", 10.0, 1.0, _D3, ()), ("i", "DCE", 100.0, 0.5, _D3, _23), ("m", "DCE", 10.0, 1.0, _D3, _23), ("y", "DCE", 10.0, 2.0, _D3, _23), ("p", "DCE", 10.0, 2.0, _D3, _23), ("c", "DCE", 10.0, 1.0, _D3, _23),
    ("a", "DCE", 10.0, 1.0, _D3, _23), ("jm", "DCE", 60.0, 0.5, _D3, _23), ("l", "DCE", 5.0, 1.0, _D3, _23), ("RM", "CZCE", 10.0, 1.0, _D3, _23), ("MA", "CZCE", 10.0, 1.0, _D3, _23), ("SR", "CZCE", 10.0, 1.0, _D3, _23), ("CF", "CZCE", 5.0, 5.0, _D3, _23),
    ("FG", "CZCE", 20.0, 1.0, _D3, _23), ("TA", "CZCE", 5.0, 2.0, _D3, _23), ("SA", "CZCE", 20.0, 1.0, _D3, _23), ("si", "GFEX", 5.0, 5.0, _D3, ()), ("lc", "GFEX", 1.0, 50.0, _D3, ()),
]
DEFAULT_SESSIONS = (*_D3, *_23)


def _seconds(text: str) -> int:
    h, m, s = map(int, text.split(":"))
    return h * 3600 + m * 60 + s


def session_rows(symbol: str, sessions: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(symbol, begin, end) in seconds of a trading day; an end at or before its begin is on the next day."""
    out = []
    for s in sessions:
        begin, end = map(_seconds, s.split("-"))
        out.append((symbol.lower(), begin, end + (86400 if end <= begin else 0)))
    return out


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, e, m, t) for s, e, m, t, _, _ in INSTRUMENTS], "symbol string, exchange string, multiplier double, tick double")


def sessions(spark: SparkSession) -> DataFrame:
    """(symbol in lower case, begin_s, end_s), one row per session; '' holds the sessions of symbols that are not listed."""
    rows = [r for s, _, _, _, day, night in INSTRUMENTS for r in session_rows(s, (*day, *night))]
    return spark.createDataFrame(rows + session_rows("", DEFAULT_SESSIONS), "symbol string, begin_s int, end_s int")


def tick_size(symbol: str, default: float = 1.0) -> float:
    return next((t for s, _, _, t, _, _ in INSTRUMENTS if s.lower() == symbol.lower()), default)
