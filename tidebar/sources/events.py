"""Ticks and bars out of the supplied tables, so that every operator has data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUYS, SELLS = ("click", "purchase"), ("error",)


def event_ticks(spark: SparkSession, sf_dir: str, contracts: int = 4) -> DataFrame:
    """One trade per event: contract, ts, event_id, price (one decimal), level (whole), qty, side (1, -1, 0), oi (change of open interest)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    qty = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("C"), (F.col("user_id") % contracts).cast("string")).alias("contract"), "ts", "event_id",
        (F.floor(F.col("value") * 10).cast("double") / 10).alias("price"), F.floor("value").cast("double").alias("level"), qty.alias("qty"),
        F.when(kind.isin(*BUYS), 1).when(kind.isin(*SELLS), -1).otherwise(0).alias("side"),
        F.when(kind == "signup", qty).when(kind == "purchase", -qty).otherwise(F.lit(0)).cast("long").alias("oi"),
    )


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades as level-1 ticks of copper contracts, as `ticks.read_tick_csv` gives them: times are exchange wall times, volume adds up within a day, some
    numbers are missing, and the order in file is by day."""
    t = event_ticks(spark, sf_dir).withColumns({"contract": F.concat(F.lit("SHFE.cu240"), F.substring("contract", 2, 1)), "day": F.to_date("ts")})
    day = Window.partitionBy("contract", "day").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    # the days before are added up a row a day, so no task sorts all ticks of a contract
    days = t.groupBy("contract", "day").agg(F.sum("oi").alias("_oi"))
    before = Window.partitionBy("contract").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(days.select("contract", "day", F.coalesce(F.sum("_oi").over(before), F.lit(0)).alias("_before")), ["contract", "day"])
    nano = ((F.unix_micros(F.col("ts").cast("timestamp")) - 8 * 3_600_000_000) * 1000).cast("double")
    some = lambda c, n: F.when(F.col("event_id") % n != 0, c)
    level, one = F.col("level"), F.lit(1.0)
    numbers = {
        "datetime_nano": nano, "last_price": some(F.col("price"), 13), "highest": level + 5, "lowest": some(level, 7), "average": level, "volume": F.sum("qty").over(day).cast("double"), "amount": one,
        "open_interest": (F.sum("oi").over(day) + F.col("_before") + 100_000).cast("double"), "bid_price1": some(level - 1, 11), "bid_volume1": one, "ask_price1": level + 1, "ask_volume1": one,
    }
    seq = F.shiftleft(F.datediff("day", F.lit("2000-01-01")).cast("long"), 33) + F.col("event_id")
    return t.select("contract", seq.alias("seq"), F.col("ts").cast("string").alias("datetime"), *[x.alias(n) for n, x in numbers.items()])


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event_ticks."""
    from tidebar.operators.bars import bars_of, ladder_of

    ticks = event_ticks(spark, sf_dir).withColumn("datetime", F.date_trunc("hour", "ts"))
    return bars_of(ladder_of(ticks, order=("ts", "event_id")))


def lineitem_bars(spark: SparkSession, sf_dir: str, contracts: int = 16) -> DataFrame:
    """Daily bars of order lines: a feed with more volume for measuring."""
    from tidebar.operators.bars import bars_of, ladder_of

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    price = F.floor(F.try_divide("l_extendedprice", "l_quantity") * 10) / 10
    ticks = rows.select(
        F.concat(F.lit("P"), (F.col("l_partkey") % contracts).cast("string")).alias("contract"), F.date_trunc("day", "l_shipdate").alias("datetime"), "l_orderkey", "l_linenumber",
        price.alias("price"), (F.floor(price / 100) * 100).cast("double").alias("level"), F.col("l_quantity").cast("long").alias("qty"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0).alias("side"), F.lit(0).cast("long").alias("oi"),
    )
    return bars_of(ladder_of(ticks, order=("l_orderkey", "l_linenumber")))
