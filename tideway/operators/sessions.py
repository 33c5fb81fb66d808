"""What a run knows on each signal date: its execution date, the gaps and the prices up to it.

Each table here is one window over a series that two kinds of rows were merged into: what becomes known, and when it is
asked for.  No range join, and a row for each date and ticker at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import sure

c = F.col
KEY = ["universe_id", "date"]
#: Days within which the calendar is asked for the next session, and the names of where a date comes from.
HORIZONS = (14, 60, 366)
CALENDAR, NOT_THERE, WEEKDAY = "jpx_calendar", "jpx_calendar_unavailable", "weekday_fallback"


def _seen(value: Column, order: list[Column], partition: list[str]) -> Column:
    """The last non-null value up to a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def next_weekday(date: Column) -> Column:
    later = F.weekday(F.date_add(date, 1))  # 0 is Monday
    return F.date_add(date, F.when(later >= 5, 8 - later).otherwise(1))


def execution_dates(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """universe_id, date, execution_date, source and horizon of ``dates(universe_id, date)``.

    The execution date is the next session of ``calendar(universe_id, date)`` within the last horizon; ``horizon`` is the
    first that holds it.  A calendar that goes on, but not within a year, gives none; where it does not go on, or there is
    none, the next weekday is taken.
    """
    rows = dates.select(*KEY, F.lit(0).alias("kind")).distinct().unionByName(calendar.select(*KEY, F.lit(1).alias("kind")).distinct())
    back = Window.partitionBy("universe_id").orderBy(F.desc("date"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.min(F.when(c("kind") == 1, c("date"))).over(back)).where("kind = 0")
    days = F.datediff("next", "date")
    horizon = F.coalesce(*[F.when(days <= h, h) for h in HORIZONS])
    rows = rows.withColumn("horizon", horizon)
    source = F.when(c("next").isNull(), WEEKDAY).when(c("horizon").isNull(), NOT_THERE).otherwise(CALENDAR)
    return rows.select(*KEY, F.when(c("next").isNull(), next_weekday(c("date"))).when(c("horizon").isNotNull(), c("next")).alias("execution_date"), source.alias("source"), "horizon")


def gaps_as_of(gaps: DataFrame, runs: DataFrame) -> DataFrame:
    """universe_id, date (of the signal), gap_date, ticker, gap: the gaps of each run's execution date.

    Where that date has none, those of the last date before it; without an execution date those of the last date there is.
    """
    days = gaps.select("universe_id", c("date").alias("at"), F.lit(0).alias("kind"), c("date").alias("day"), F.lit(None).cast("date").alias("date")).distinct()
    asked = runs.select("universe_id", F.coalesce("execution_date", F.lit("9999-12-31").cast("date")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("day"), "date")
    rows = days.unionByName(asked)
    rows = rows.withColumn("gap_date", _seen(c("day"), [c("at"), c("kind"), c("date")], ["universe_id"])).where("kind = 1").select("universe_id", "date", "gap_date")
    return rows.join(gaps.select("universe_id", c("date").alias("gap_date"), "ticker", "gap"), ["universe_id", "gap_date"]).select(*KEY, "gap_date", "ticker", "gap")


def known_prices(panel: DataFrame, wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """universe_id, date, side, ticker, rows, last: how many prices of each of ``wanted(universe_id, side, ticker)`` a run
    knows, and the last one's date.

    A run knows the lead side up to its signal date, and the lag side up to the morning of its execution date.
    """
    keys = ["universe_id", "ticker"]
    priced = panel.where("open is not null or close is not null").select(*keys, c("date").alias("at"), F.lit(0).alias("kind"), c("date").alias("day"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("side"))
    at = F.when(c("side") == "lag", F.coalesce("execution_date", "date")).otherwise(c("date"))
    asked = wanted.select("universe_id", "side", "ticker").distinct().join(runs.select(*KEY, "execution_date"), "universe_id")
    rows = priced.unionByName(asked.select(*keys, at.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("day"), "date", "side"))
    order = [c("at"), c("kind"), c("date")]
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"last": _seen(c("day"), order, keys), "rows": F.count("day").over(so_far)})
    return rows.where("kind = 1").select(*KEY, "side", "ticker", "rows", "last")


def freshness_as_of(known: DataFrame) -> DataFrame:
    """One row for each run: last dates of both sides, missing and stale tickers (sorted), whether each side's tickers end
    together, and whether the data are fresh; a ticker is stale if its last price is before the signal date."""
    side = lambda s, f: f(F.when(c("side") == s, c("last")))
    named = lambda when: F.array_sort(F.collect_list(F.when(when, c("ticker"))))
    out = known.groupBy(*KEY).agg(
        F.sum("rows").alias("rows"), side("lead", F.min).alias("lead_min"), side("lead", F.max).alias("lead_max"), side("lag", F.min).alias("lag_min"), side("lag", F.max).alias("lag_max"),
        named(c("last").isNull()).alias("missing"), named(c("last") < c("date")).alias("stale"),
    )
    aligned = sure(c("lead_min") == c("lead_max")) & sure(c("lag_min") == c("lag_max"))
    whole = (F.size("missing") == 0) & (F.size("stale") == 0)
    return out.withColumns({"dates_aligned": aligned, "signal_ready": whole & aligned, "freshness_ok": whole & c("lead_max").isNotNull() & c("lag_max").isNotNull()})


def usable_as_of(covered: DataFrame, runs: DataFrame) -> DataFrame:
    """universe_id, date, usable_lead, usable_lag: tickers with a return on a covered date up to each run's signal date."""
    first = covered.where("ret is not null").groupBy("universe_id", "side", "ticker").agg(F.min("date").alias("date"))
    one = lambda s: F.count_if(c("side") == s)
    first = first.groupBy(*KEY).agg(one("lead").alias("lead"), one("lag").alias("lag")).withColumn("kind", F.lit(0))
    zero = F.lit(0).cast("long")
    rows = first.unionByName(runs.select(*KEY, zero.alias("lead"), zero.alias("lag"), F.lit(1).alias("kind")))
    w = Window.partitionBy("universe_id").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*KEY, "kind", F.sum("lead").over(w).alias("usable_lead"), F.sum("lag").over(w).alias("usable_lag")).where("kind = 1").drop("kind")
