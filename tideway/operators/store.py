"""The price store: upsert, range scan, tail, fetch plan, missing tickers, calendars, factor files, corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
PRICES = "ticker string, date date, price_mode string, open double, close double"
#: What a store is partitioned by; a month is ``yyyy-MM``.
PARTITIONS = ("price_mode", "month")


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store, with their month."""
    return spark.read.schema(f"{PRICES}, month string").parquet(path)


def scan(spark: SparkSession, path: str, tickers: list[str], start: str, end: str, mode: str) -> DataFrame:
    """Half-open date range of a store: only the folders of its mode and months are read, the other predicates reach the
    files."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    rows = stored(spark, path).where((c("price_mode") == mode) & (c("month") >= month(first)) & (c("month") <= month(F.date_sub(last, 1))))
    return rows.where(c("ticker").isin(tickers) & (c("date") >= first) & (c("date") < last)).drop("month").orderBy("ticker", "date")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the largest ``by``: one partial aggregate before the shuffle, no sort."""
    rest = [x for x in rows.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, *[c(f"r.{x}").alias(x) for x in rest])


def upsert(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Store rows replaced or joined by fresh ones; a fresh row without any price is left out."""
    both = store.withColumn("_gen", F.lit(0)).unionByName(fresh.where("open is not null or close is not null").withColumn("_gen", F.lit(1)))
    return latest(both, ["ticker", "date", "price_mode"], "_gen").drop("_gen")


def write_store(rows: DataFrame, path: str) -> None:
    """Replaces the folders (price modes and months) that ``rows`` has; no other file is touched.

    Rows are dealt by folder, large ones to several tasks, so that a folder has few files.
    """
    rows = rows.select("ticker", "date", "price_mode", "open", "close", month(c("date")).alias("month")).hint("rebalance", *PARTITIONS)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def touched(spark: SparkSession, path: str, fresh: DataFrame) -> DataFrame | None:
    """The rows of the store's folders that ``fresh`` has rows for; None if there is no store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    folders = fresh.select("price_mode", month(c("date")).alias("month")).distinct().groupBy("price_mode").agg(F.sort_array(F.collect_set("month")).alias("months")).collect()  # a few months a mode
    rows = stored(spark, path)
    wanted = F.lit(False)
    for f in folders:
        wanted = wanted | ((c("price_mode") == f.price_mode) & c("month").isin(f.months))
    return rows.where(wanted).drop("month")


def date_range(panel: DataFrame) -> DataFrame:
    return panel.where("close is not null").groupBy("universe_id", "ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def fetch_plan(ranges: DataFrame, wanted: DataFrame, start: str, overlap_days: int = 7) -> DataFrame:
    """From when each group of ``wanted(group, ticker)`` is to be read: if every ticker has prices and the earliest of them
    reaches back to the start, from the least last date less an overlap, but not before the start; else from the start."""
    begin = F.lit(start).cast("date")
    rows = wanted.join(ranges, "ticker", "left").groupBy("group").agg(F.count("*").alias("tickers"), F.count("last_date").alias("known"), F.min("first_date").alias("first"), F.min("last_date").alias("last"))
    full = (c("known") == c("tickers")) & (c("first") <= begin)
    return rows.select("group", "tickers", F.when(full, F.greatest(F.date_sub("last", overlap_days), begin)).otherwise(begin).alias("from_date"))


def tail(rows: DataFrame, tickers: list[str], since: str) -> DataFrame:
    """Prices from a date on, by ticker and date; no tickers give no rows."""
    return rows.where(c("ticker").isin(tickers or [""]) & (c("date") >= F.lit(since).cast("date"))).select("ticker", "date", "open", "close").orderBy("ticker", "date")


def migrated(rows: DataFrame) -> DataFrame:
    """A store as it is now kept; one of before price modes is begun anew."""
    return rows if "price_mode" in rows.columns else rows.sparkSession.createDataFrame([], PRICES)


def freshness(panel: DataFrame, required: Column) -> DataFrame:
    """Last date of each ticker with a price and whether it is stale against the required date."""
    return date_range(panel).select("universe_id", "ticker", "last_date", (c("last_date") < required).alias("stale"))


def missing(wanted: DataFrame, panel: DataFrame) -> DataFrame:
    return wanted.join(panel.where("close is not null"), "ticker", "left_anti").select("ticker")


def side_summary(panel: DataFrame) -> DataFrame:
    """Oldest and newest last date of each side, and whether the side's tickers end together."""
    last = panel.where("close is not null").groupBy("universe_id", "side", "ticker").agg(F.max("date").alias("last"))
    return last.groupBy("universe_id", "side").agg(F.count("*").alias("tickers"), F.min("last").alias("oldest_last"), F.max("last").alias("newest_last")).withColumn("aligned", c("oldest_last") == c("newest_last"))


def next_session(days: DataFrame) -> DataFrame:
    """Each date of a side with the next one of the other side's calendar: a merge of both calendars and one ordered
    window, instead of a range join."""
    d = days.select("universe_id", "side", "date").distinct()
    w = Window.partitionBy("universe_id").orderBy(F.desc("date"), F.when(c("side") == "lag", 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    # in descending order every lag date seen so far lies after or on the current date; the same date sorts behind
    return d.withColumn("next_lag_date", F.min(F.when(c("side") == "lag", c("date"))).over(w)).where("side = 'lead'").drop("side")


def factor_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first block of daily rows (yyyymmdd and percentages) of a factor file: date, then the columns as fractions.

    A missing value is -99.99.  Header text and later blocks are passed over; the header is the line before the block.
    The block's bounds are two minima over the numbered lines; no line is sorted or sent to one task.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    data = F.col("value").rlike(r"^\s*\d{8}\s*,")
    first = lines.where(data).agg(F.min("at").alias("first"))
    bounds = lines.join(F.broadcast(first)).agg(F.max(F.when(c("at") < c("first"), F.struct("at", "value"))).alias("head"), F.min("first").alias("first"), F.min(F.when((c("at") > c("first")) & ~data, c("at"))).alias("end")).first()
    if bounds["first"] is None:
        return spark.createDataFrame([], "date date")
    header = bounds["head"]["value"] if bounds["head"] else ""
    names = [x.strip().lower().replace("-", "_").replace(" ", "_") for x in header.split(",")[1:]]
    cells = F.split("value", r"\s*,\s*")
    value = lambda i: F.when(F.trim(cells[i]).cast("double") > -99.0, F.trim(cells[i]).cast("double") / 100)
    block = (c("at") >= bounds["first"]) & (F.lit(True) if bounds["end"] is None else c("at") < bounds["end"])
    return lines.where(data & block).select(F.to_date(F.trim(cells[0]), "yyyyMMdd").alias("date"), *[value(i + 1).alias({"wml": "mom"}.get(n, n)) for i, n in enumerate(names)])


def carhart(ff3: DataFrame, momentum: DataFrame) -> DataFrame:
    """Three factors and momentum, on the dates that both have."""
    name = next(x for x in momentum.columns if x != "date")
    return ff3.join(momentum.select("date", c(name).alias("mom")), "date")


def load_factors(spark: SparkSession, folder: str, names: tuple[str, ...] = ("carhart4.csv", "ff3.csv")) -> DataFrame | None:
    """The first of the stored factor files (CSV with a header) that there is; None if there is none."""
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = spark.read.option("header", True).csv(f"{folder}/{name}")
            first = "date" if "date" in rows.columns else rows.columns[0]
            day = F.to_date(F.substring(F.trim(first), 1, 10))  # a zone behind the date is left out, not applied
            return rows.select(day.alias("date"), *[c(x).cast("double").alias({"wml": "mom"}.get(x.strip().lower(), x.strip().lower())) for x in rows.columns if x != first])
    return None


def write_factors(rows: DataFrame, folder: str, name: str) -> None:
    """Factor columns (fractions) by date as CSV with a header, under one of the names that ``load_factors`` looks for."""
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def factor_status(factors: DataFrame | None, spark: SparkSession) -> DataFrame:
    """One row: is there a stored factor file with rows, its model, number of rows, first and last date."""
    if factors is None:
        return spark.range(1).select(F.lit(False).alias("factor_data_ready"), F.lit(None).cast("string").alias("factor_model"), F.lit(0).cast("long").alias("factor_rows"), F.lit(None).cast("date").alias("factor_start"), F.lit(None).cast("date").alias("factor_end"))
    model = F.lit("Carhart4" if "mom" in factors.columns else "FF3")
    found = factors.agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    return found.select((c("n") > 0).alias("factor_data_ready"), F.when(c("n") > 0, model).alias("factor_model"), c("n").alias("factor_rows"), c("first").alias("factor_start"), c("last").alias("factor_end"))


def corporate_actions(wide: DataFrame, source: str) -> DataFrame:
    """(ticker, date, dividend, split) as rows of positive values."""
    keys = [x for x in wide.columns if x not in ("dividend", "split")]
    return wide.unpivot(keys, ["dividend", "split"], "action_type", "value").where("value > 0").withColumn("source", F.lit(source))


def action_tables(*sources: DataFrame) -> DataFrame:
    """The actions of all sources as one table, each with the table it goes to (dividends or splits) and its place there by
    ticker and date; rows that several sources have alike count once, other types are left out."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    rows = rows.dropDuplicates(["universe_id", "ticker", "date", "action_type", "value"])
    table = F.when(c("action_type") == "dividend", "dividends").when(c("action_type") == "split", "splits")
    return rows.withColumn("table", table).where("table is not null").select("universe_id", "table", "ticker", "date", "value")


def write_actions(rows: DataFrame, folder: str) -> None:
    """The tables of ``action_tables`` as CSV, a folder for each, sorted by ticker and date within their files."""
    rows.hint("rebalance", "table").sortWithinPartitions("table", "ticker", "date").write.mode("overwrite").partitionBy("table").option("header", True).csv(folder)


def weekday_calendar(spark: SparkSession, start: str, end: str, holidays: list[str] = ()) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.where((F.weekday("date") < 5) & ~c("date").cast("string").isin(list(holidays) or [""]))
