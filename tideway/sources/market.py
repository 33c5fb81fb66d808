"""Price panels in long form: (universe_id, date, ticker, ord, side, cyc, open, close)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAD, LAG = "lead", "lag"
#: Instruments numbered up to this lead, the others lag.
LAST_LEAD = 11


def order_panel(spark: SparkSession, sf_dir: str, grain: str = "month", by: str | None = None) -> DataFrame:
    """A panel from order lines: a ticker is a brand, a period a month, week or day; open and close are the mean prices of
    the first and the second half of the period, in a day of the orders' first two lines and of the others.  Three columns of lineitem (and ``by``) and two of part are read, and the
    mean is summed before the shuffle, which carries one row per task, brand, period and half.  With ``by``, a column of
    lineitem, each of its values is a universe of its own."""
    universe = F.lit("all") if by is None else F.col(by)
    halves = {"month": F.dayofmonth("l_shipdate") <= 15, "week": F.weekday("l_shipdate") < 3, "day": F.col("l_linenumber") <= 2}
    date = F.col("l_shipdate").cast("date") if grain == "day" else F.trunc(F.col("l_shipdate").cast("date"), grain)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", date.alias("date"), halves[grain].alias("first"), F.col("l_extendedprice").cast("double").alias("price"), universe.alias("universe_id"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    first = F.col("first")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy("universe_id", "date", F.col("p_brand").alias("ticker")).agg(F.avg(F.when(first, F.col("price"))).alias("open"), F.avg(F.when(~first, F.col("price"))).alias("close"))
    n = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    return rows.select(
        "universe_id", "date", "ticker", n.alias("ord"), F.when(n <= LAST_LEAD, LEAD).otherwise(LAG).alias("side"), (n % 3 - 1).cast("int").alias("cyc"), "open", "close",
    )


def dense(panel: DataFrame) -> DataFrame:
    """Every ticker of a side on every date of that side, with null prices where it did not trade."""
    dates = panel.select("universe_id", "side", "date").distinct()
    names = panel.select("universe_id", "side", "ticker", "ord", "cyc").distinct()
    grid = dates.join(names, ["universe_id", "side"])
    return grid.join(panel.select("universe_id", "date", "ticker", "open", "close"), ["universe_id", "date", "ticker"], "left")
