"""Freshness, cache summary, verification of adjusted series and the roll-up of what is ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import sure

c = F.col
LEAST_COVERAGE, LEAST_EVENTS = 0.6, 10


def summary(panel: DataFrame, wanted: DataFrame, required: Column) -> DataFrame:
    """One row per universe: rows, oldest and newest last date of each side, missing and stale tickers (sorted), whether each
    side ends together, and whether a daily signal can be made.

    ``wanted(universe_id, side, ticker)`` are the tickers that are tracked; without any price nothing is aligned or ready.
    """
    have = panel.where("open is not null or close is not null").groupBy("universe_id", "ticker").agg(F.count("*").alias("rows"), F.max("date").alias("last"))
    rows = wanted.select("universe_id", "side", "ticker").distinct().join(have, ["universe_id", "ticker"], "left")
    side = lambda s, f: f(F.when(c("side") == s, c("last")))
    named = lambda when: F.array_sort(F.collect_list(F.when(when, c("ticker"))))
    out = rows.groupBy("universe_id").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), side("lead", F.min).alias("lead_min"), side("lead", F.max).alias("lead_max"), side("lag", F.min).alias("lag_min"), side("lag", F.max).alias("lag_max"),
        named(c("last").isNull()).alias("missing"), named(c("last") < required).alias("stale"),
    )
    aligned = sure(c("lead_min") == c("lead_max")) & sure(c("lag_min") == c("lag_max"))
    return out.withColumn("aligned", aligned).withColumn("signal_ready", (F.size("missing") == 0) & (F.size("stale") == 0) & c("aligned"))


def is_fresh() -> Column:
    """Over a summary: no ticker is missing or stale and each side has one."""
    return (F.size("missing") == 0) & (F.size("stale") == 0) & c("lead_max").isNotNull() & c("lag_max").isNotNull()


def freshness(summary_: DataFrame) -> DataFrame:
    """Both sides together, with their last dates and the tickers that are stale or missing."""
    return summary_.select("universe_id", is_fresh().alias("freshness_ok"), c("lead_max").alias("latest_lead"), c("lag_max").alias("latest_lag"), "stale", "missing")


def verification(actions: DataFrame, expected: DataFrame, start: Column, end: Column) -> DataFrame:
    """Whether the corporate actions of a universe can confirm adjusted prices, and the first reason why not.

    ``actions(universe_id, ticker, date, action_type)``; ``expected(universe_id, tickers)``.  At least 0.6 of the tickers
    must be covered, with 10 events or a fifth of the tickers, over the range from ``start`` to ``end`` (null: any).
    """
    found = actions.groupBy("universe_id").agg(
        F.countDistinct("ticker").alias("covered"), F.count("*").alias("total"), F.count_if(c("action_type") == "dividend").alias("dividends"), F.count_if(c("action_type") == "split").alias("splits"), F.min("date").alias("actions_start"), F.max("date").alias("actions_end"),
    )
    rows = expected.join(found, "universe_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    coverage = F.when(c("tickers") > 0, zero("covered") / c("tickers")).otherwise(0.0)
    least = F.greatest(F.lit(LEAST_EVENTS), F.floor(c("tickers") * 0.2))
    outside = start.isNotNull() & end.isNotNull() & ~sure((c("actions_start") <= start) & (c("actions_end") >= end))
    reason = (
        F.when(zero("total") == 0, "actions_data_unavailable").when(c("actions_start").isNull() | c("actions_end").isNull(), "missing_date_range").when(outside, "required_range_not_covered").when(coverage < LEAST_COVERAGE, "coverage_ratio_below_threshold")
        .when(c("total") < least, "insufficient_actions_events").when((zero("dividends") == 0) & (zero("splits") == 0), "no_dividends_or_splits").otherwise("ok")
    )
    return rows.select("universe_id", coverage.alias("coverage_ratio"), zero("covered").alias("covered"), zero("total").alias("total"), "actions_start", "actions_end", least.cast("long").alias("least_events"), reason.alias("reason_code"), (reason == "ok").alias("verified"))


CONDITIONS = ("factor_data_ready", "factor_regression_ready", "adjusted_verification_ready", "report_available")


def roll_up(rows: DataFrame) -> DataFrame:
    """Adds paper_reproduction_ready and its reason, which names the conditions that are not met; a missing flag is not met."""
    unmet = F.array_compact(F.array(*[F.when(~sure(c(x)), F.lit(x)) for x in CONDITIONS]))
    reason = F.when(F.size(unmet) == 0, "ok").otherwise(F.concat(F.lit("missing_requirements:"), F.array_join(unmet, ",")))
    return rows.withColumn("paper_reproduction_ready", F.size(unmet) == 0).withColumn("paper_reproduction_reason", reason)
