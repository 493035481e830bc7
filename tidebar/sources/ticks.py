"""Level-1 tick files, bar files, and tables between the stages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.sources import calendar
from tidebar.sources.shared import first_line, listed

#: The columns of tick and bar files.
NUMERIC = ["datetime_nano", "last_price", "highest", "lowest", "average", "volume", "amount", "open_interest", "bid_price1", "bid_volume1", "ask_price1", "ask_volume1"]
BAR_COLUMNS = ["datetime", "open", "high", "low", "close", "volume", "poc", "delta", "open_interest"]
BAR_TIME = "yyyy.MM.dd HH:mm"
TICKS = "contract string, chunk string, seq long, datetime string, " + ", ".join(f"{c} double" for c in NUMERIC)


def contract_of(path: Column) -> Column:
    """EXCHANGE.symbol from a tick or bar file's name, such as SHFE.cu2401_tick.csv or period_of_5_..._SHFE.cu2401_300.csv."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"([A-Z]+\.[A-Za-z]+\d+)", 1)


def symbol_of(contract: Column) -> Column:
    return F.lower(F.regexp_extract(contract, r"\.([A-Za-z]+)\d", 1))


def normalise_contract(c: Column, exchange: str = "SHFE") -> Column:
    c = F.trim(c)
    return F.when(c.startswith(f"{exchange}."), c).otherwise(F.concat(F.lit(f"{exchange}."), c))


def number(c: str) -> Column:
    """A text as a double; what is no number, NaN too, is missing."""
    return F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double"))


def stripped(header: str) -> tuple[str, ...]:
    """The column names of a header line without a leading contract and dot, quotes and blanks."""
    return tuple(re.sub(r"^[A-Z]+\.[A-Za-z]+\d+\.", "", c.strip().strip('"')) for c in header.split(","))


def tick_index(spark: SparkSession, folder: str, pattern: str = "*_tick.csv") -> DataFrame:
    """(contract, path, bytes) of the tick files of a folder, the last path of each contract; files whose names hold no contract are left out."""
    return _index(spark, f"{folder.rstrip('/')}/{pattern}", F.max_by)


def golden_index(spark: SparkSession, folder: str, minutes: int = 5) -> DataFrame:
    """(contract, path, bytes) of the golden bar files of a folder for a bar width, the first path of each contract."""
    return _index(spark, f"{folder.rstrip('/')}/period_of_{minutes}_*.csv", F.min_by)


def _index(spark: SparkSession, paths: str, choose) -> DataFrame:
    files = spark.createDataFrame(listed(spark, paths), "path string, bytes long, modified long").withColumn("contract", contract_of(F.col("path")))
    return files.where("contract <> ''").groupBy("contract").agg(choose("path", "path").alias("path"), choose("bytes", "path").alias("bytes"))


def read_tick_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tick files, folders or globs as one table: contract, chunk and seq (rows of a contract are in order of both), datetime, and NUMERIC columns; bad numbers are missing.

    Headers carry their contract, so names are read from first lines, without it, and files with the same names in the same order are one scan, however many they are. A chunk
    is a file's split, in order of paths and places, and seq is the order within it. Empty files have no rows; a column that a file lacks is missing.
    """
    kinds: dict[tuple[str, ...], list[str]] = {}
    for path, size, _ in listed(spark, paths):
        if size and (header := first_line(spark, path)):
            kinds.setdefault(stripped(header), []).append(path)
    scans = []
    for names, files in sorted(kinds.items()):
        raw = spark.read.schema(", ".join(f"`{c}` string" for c in names)).option("header", True).option("enforceSchema", True).csv(files)
        at = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
        have = {c: number(c) if c in names else F.lit(None).cast("double") for c in NUMERIC}
        time = F.col("datetime") if "datetime" in names else F.lit(None).cast("string")
        t = raw.select(contract_of(F.col("_metadata.file_path")).alias("contract"), at.alias("chunk"), F.monotonically_increasing_id().alias("seq"), time.alias("datetime"), *[x.alias(c) for c, x in have.items()])
        scans.append(t)
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], TICKS)


def chunk_of(ticks: DataFrame) -> Column:
    """The chunk of a row: its column `chunk`, or what a file split's numbering of seq gives."""
    return F.col("chunk") if "chunk" in ticks.columns else F.shiftright("seq", 33)


def carried_numbers(ticks: DataFrame) -> DataFrame:
    """(contract, _chunk, _before_...): the last known numbers before each chunk, a row a chunk."""
    ends = ticks.groupBy("contract", chunk_of(ticks).alias("_chunk")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in NUMERIC])
    before = Window.partitionBy("contract").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("contract", "_chunk", *[F.last(c, ignorenulls=True).over(before).alias(f"_before_{c}") for c in NUMERIC])


def filled_forward(ticks: DataFrame, keep_chunk: bool = False) -> DataFrame:
    """Missing numbers take the last known one of the contract, else 0.

    Rows are filled within chunks, and each chunk's last known numbers are carried to the next ones, so no task sorts all ticks of a contract. With
    keep_chunk, the rows come dealt and sorted by (contract, _chunk, seq).
    """
    w = Window.partitionBy("contract", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = ticks.withColumn("_chunk", chunk_of(ticks)).join(carried_numbers(ticks), ["contract", "_chunk"])
    filled = t.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_before_{c}"), F.lit(0.0)) for c in NUMERIC})
    return filled.select(*ticks.columns, *(["_chunk"] if keep_chunk else []))


def valid_price(strict: bool = True) -> Column:
    keys = ["last_price", "highest", "lowest", *(["bid_price1", "ask_price1"] if strict else [])]
    ok = F.col("highest") >= F.col("lowest")
    for k in keys:
        ok = ok & F.col(k).isNotNull() & ~F.isnan(k) & (F.col(k) != 0)
    return F.coalesce(ok, F.lit(False))


def in_session(ticks: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """Valid ticks inside a session of their symbol, with wall_ms (wall time as milliseconds), session_begin_ms and trading_day.

    A tick before 08:00 belongs to the day before. The session is found by an equality on the symbol and a range on seconds of the day.
    """
    spark = ticks.sparkSession
    wall = F.from_utc_timestamp(F.timestamp_micros(F.round(F.col("datetime_nano") / 1000).cast("long")), zone)
    t = ticks.where(valid_price() & (F.col("datetime_nano") > 0) & (F.col("volume") >= 0)).withColumn("_wall", wall).withColumn("wall_ms", F.unix_millis("_wall"))
    base = F.when(F.hour("_wall") < 8, F.date_sub(F.to_date("_wall"), 1)).otherwise(F.to_date("_wall"))
    t = t.withColumn("trading_day", base).withColumn("_base_ms", F.unix_millis(F.col("trading_day").cast("timestamp")))
    known = calendar.sessions(spark)
    symbols = [s.lower() for s, *_ in calendar.INSTRUMENTS]
    t = t.withColumn("_symbol", F.when(symbol_of(F.col("contract")).isin(*symbols), symbol_of(F.col("contract"))).otherwise(""))
    inside = (F.col("_symbol") == F.col("symbol")) & (F.col("wall_ms") - F.col("_base_ms")).between(F.col("begin_s") * 1000, F.col("end_s") * 1000)
    j = t.join(F.broadcast(known), inside)  # the calendar has some hundred rows
    return j.withColumn("session_begin_ms", F.col("_base_ms") + F.col("begin_s") * 1000).drop("_wall", "_base_ms", "_symbol", "symbol", "begin_s", "end_s")


def session_neighbours(ticks: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """Ticks with in_session, next_begin_ms (of the first session of their trading day that begins after them, or missing) and last_end_ms (of the day's last session), as wall time.

    A trading day's sessions are an array of its symbol, from a calendar of some hundred rows.
    """
    wall = F.from_utc_timestamp(F.timestamp_micros(F.round(F.col("datetime_nano") / 1000).cast("long")), zone)
    t = ticks.withColumn("_wall", wall)
    base = F.when(F.hour("_wall") < 8, F.date_sub(F.to_date("_wall"), 1)).otherwise(F.to_date("_wall"))
    t = t.withColumn("wall_ms", F.unix_millis("_wall")).withColumn("_base", F.unix_millis(base.cast("timestamp")))
    listed_symbols = [s.lower() for s, *_ in calendar.INSTRUMENTS]
    symbol = symbol_of(F.col("contract"))
    days = calendar.sessions(ticks.sparkSession).groupBy("symbol").agg(F.collect_list(F.struct("begin_s", "end_s")).alias("_sessions"))
    j = t.withColumn("_symbol", F.when(symbol.isin(*listed_symbols), symbol).otherwise("")).join(F.broadcast(days.withColumnRenamed("symbol", "_of")), F.col("_symbol") == F.col("_of"))
    ms = F.col("wall_ms") - F.col("_base")
    inside = F.exists("_sessions", lambda s: ms.between(s["begin_s"] * 1000, s["end_s"] * 1000))
    ahead = F.array_min(F.filter(F.transform("_sessions", lambda s: s["begin_s"].cast("long") * 1000), lambda b: b > ms))
    end = F.array_max(F.transform("_sessions", lambda s: s["end_s"].cast("long") * 1000))
    return j.select(*ticks.columns, "wall_ms", inside.alias("in_session"), (F.col("_base") + ahead).alias("next_begin_ms"), (F.col("_base") + end).alias("last_end_ms"))


def read_table_csv(spark: SparkSession, path: str, time: str | None = "datetime") -> DataFrame | None:
    """A CSV file with a header, numbers and times by their looks, without a byte-order mark; `time` is a timestamp, missing where it cannot be read. An empty file is None."""
    if not any(size for _, size, _ in listed(spark, path)):
        return None
    raw = spark.read.option("header", True).option("inferSchema", True).option("encoding", "UTF-8").csv(path)
    t = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
    return t.withColumn(time, F.try_to_timestamp(F.col(time).cast("string"))) if time in t.columns else t


def read_folder(spark: SparkSession, folder: str, expected: list[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """({name without suffix: table} of the CSV files expected in a folder, names of those that are not there or empty)."""
    there = {p.rsplit("/", 1)[-1]: p for p, size, _ in listed(spark, folder) if size}
    tables = {n.removesuffix(".csv"): read_table_csv(spark, there[n]) for n in expected if n in there and n.endswith(".csv")}
    return tables, [n for n in expected if n not in there]


#: The tables of a first-stage run.
STAGE1_FILES = [
    "features.csv", "labels.csv", "feature_summary.csv", "feature_quintiles.csv", "monthly_ic.csv", "selected_features.csv", "trades_mvp.csv", "strategy_summary.csv", "equity_curve.csv", "trade_overlap_check.csv",
    "stage1_mvp_report.md", "stage1_mvp_report_zh.md",
]


def read_bar_csv(spark: SparkSession, paths: str | list[str], contracts: list[str] | None = None, start: str | None = None) -> DataFrame:
    """Bar files as one table: contract from the file name, time parsed, numbers coerced; rows without a time are left out."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(paths)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    numbers = [c for c in BAR_COLUMNS[1:] if c in raw.columns]
    t = raw.select(contract_of(F.input_file_name()).alias("contract"), F.try_to_timestamp("datetime", F.lit(BAR_TIME)).alias("datetime"), *[number(c).alias(c) for c in numbers]).where("datetime is not null")
    if contracts:
        t = t.where(F.col("contract").isin(*contracts))
    return t.where(F.col("datetime") >= F.lit(start).cast("timestamp")) if start else t


def write_table(df: DataFrame, path: str, by_contract: bool = True) -> None:
    """Parquet, one folder per contract where asked, so that later reads of some contracts read only theirs."""
    w = df.write.mode("overwrite")
    (w.partitionBy("contract") if by_contract else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV for people: one file with a header; meant for reports and other small tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_pack(spark: SparkSession, features: str, labels: str) -> DataFrame:
    """Features with their labels, one to one on contract and time; a key that repeats in labels is an error."""
    f, y = spark.read.parquet(features), spark.read.parquet(labels)
    again = y.groupBy("contract", "datetime").count().where("count > 1").limit(1).count()
    if again:
        raise ValueError("labels repeat a key")
    only = [c for c in y.columns if c not in f.columns]
    return f.join(y.select("contract", "datetime", *only), ["contract", "datetime"], "left")
