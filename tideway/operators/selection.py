"""Cross-sectional selection: quantile candidates, thresholds, positions, trade classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import sure
from ..functions.rules import FLIP, GAP, LONG_GAP, SHORT_ONLY, SKIP

c = F.col
#: Thresholds by volatility regime.
ADAPTIVE_LONG = {"low_vol": 0.12, "mid_vol": 0.10, "high_vol": 0.06}
ADAPTIVE_SHORT = {"low_vol": -0.12, "mid_vol": -0.10, "high_vol": -0.06}
NEAR = 0.03
KEY = ["universe_id", "date"]


def quantile_masks(rows: DataFrame, q: float = 0.3, least: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds n, lo, hi and the candidate masks of each date (and ``keys``) with at least ``least`` signals.

    Quantiles are exact and interpolated; all come from one window over the rows of a date, without a join.
    """
    w = Window.partitionBy(*KEY, *keys)
    out = rows.where(c("signal").isNotNull()).withColumns({"n": F.count("*").over(w), "p": F.percentile("signal", F.array(F.lit(q), F.lit(1.0 - q))).over(w)})
    out = out.where(c("n") >= least).withColumns({"lo": c("p")[0], "hi": c("p")[1]}).drop("p")
    return out.withColumns({"cand_long": c("signal") >= c("hi"), "cand_short": c("signal") <= c("lo")})


def shortable(mask: Column, allow_short: bool = True, unshortable: tuple[str, ...] = ()) -> Column:
    if not allow_short:
        return F.lit(False)
    return mask & ~c("ticker").isin(*unshortable) if unshortable else mask


def thresholds(vol_regime: Column | None, long: float, short: float, adaptive: bool = False) -> tuple[Column, Column]:
    if not adaptive or vol_regime is None:
        return F.lit(long), F.lit(short)

    def chain(table: dict[str, float], base: float) -> Column:
        out = None
        for name, value in table.items():
            out = F.when(vol_regime == name, value) if out is None else out.when(vol_regime == name, value)
        return out.otherwise(base)

    return chain(ADAPTIVE_LONG, long), chain(ADAPTIVE_SHORT, short)


def positions(masks: DataFrame, long: Column | float = 0.0, short: Column | float = 0.0) -> DataFrame:
    """LONG, SHORT or neutral; where both hold, SHORT."""
    long, short = (x if isinstance(x, Column) else F.lit(x) for x in (long, short))
    position = F.when(c("cand_short") & (c("signal") <= short), "SHORT").when(c("cand_long") & (c("signal") >= long), "LONG").otherwise("neutral")
    return masks.withColumns({"long_threshold": long, "short_threshold": short, "position": position})


def candidate_stats(pos: DataFrame) -> DataFrame:
    """Per date: the distribution of the signals, counts, gaps to the thresholds, strengths and the five best of a side."""
    long, short = F.when(c("cand_long"), c("signal")), F.when(c("cand_short"), c("signal"))
    top = lambda mask, key: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(mask, F.struct(key.alias("k"), "ticker")))), 1, 5), lambda s: s["ticker"]), "|")
    p = F.percentile("signal", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    out = pos.groupBy(*KEY).agg(
        F.max("signal").alias("signal_max"), F.min("signal").alias("signal_min"), p.alias("p"), F.max("long_threshold").alias("lt"), F.max("short_threshold").alias("st"), F.max(long).alias("lmax"), F.min(short).alias("smin"), F.avg(long).alias("lavg"), F.avg(short).alias("savg"),
        F.count_if("cand_long").alias("candidate_long"), F.count_if("cand_short").alias("candidate_short"), F.count_if(c("position") == "LONG").alias("adopted_long"), F.count_if(c("position") == "SHORT").alias("adopted_short"),
        F.avg(F.when(c("position") == "LONG", c("signal"))).alias("al"), F.avg(F.when(c("position") == "SHORT", c("signal"))).alias("as_"), top(c("cand_long"), -c("signal")).alias("top_long"), top(c("cand_short"), c("signal")).alias("top_short"),
    )
    return out.select(
        *KEY, "signal_max", "signal_min", c("p")[0].alias("signal_p25"), c("p")[1].alias("signal_p50"), c("p")[2].alias("signal_p75"), "candidate_long", "candidate_short", "adopted_long", "adopted_short", "top_long", "top_short",
        F.round(c("lmax") - c("lt"), 6).alias("long_gap_max"), F.round(c("st") - c("smin"), 6).alias("short_gap_max"),
        (F.coalesce("lavg", F.lit(0.0)) - F.coalesce("savg", F.lit(0.0))).alias("candidate_strength"), F.coalesce(c("al") - c("as_"), F.lit(0.0)).alias("trade_strength"),
    )


def no_trade_class(adopted_long: Column, adopted_short: Column, long_gap: Column, short_gap: Column, warning: Column) -> Column:
    near_l, near_s = sure(long_gap > -NEAR), sure(short_gap > -NEAR)
    return (
        F.when((adopted_long >= 1) & (adopted_short >= 1), F.lit(None).cast("string")).when((adopted_long >= 1) | (adopted_short >= 1), "one_side_only")
        .when(warning & near_l & near_s, "regime_blocked").when(near_l | near_s, "near_miss_threshold").otherwise("hard_no_signal")
    )


def tradeability(stats: DataFrame, freshness_ok: Column, aligned: Column, usable_lead: Column, usable_lag: Column, execution_date: Column, calendar: Column, mode: str = "production", least_spread: float = 0.0, least_long: int = 1, least_short: int = 1) -> DataFrame:
    """Adds block_reason (the first that applies), tradeable and calendar_warning."""
    reason = (
        F.when(~sure(freshness_ok), "freshness_not_ok").when(~F.coalesce(aligned, F.lit(True)), "cache_dates_not_aligned")
        .when((F.coalesce(usable_lead, F.lit(0)) < 1) | (F.coalesce(usable_lag, F.lit(0)) < 1), "too_few_usable_tickers").when(execution_date.isNull(), "no_execution_target_date")
        .when((F.lit(mode) == "production") & ~sure(calendar == "jpx_calendar"), "calendar_source_untrusted")
        .when((c("candidate_long") > 0) & (c("adopted_long") == 0), "no_long_candidates_after_threshold").when((c("candidate_short") > 0) & (c("adopted_short") == 0), "no_short_candidates_after_threshold")
        .when((c("adopted_long") == 0) | (c("adopted_short") == 0), "too_few_usable_tickers")
        .when((c("adopted_long") < least_long) | (c("adopted_short") < least_short), "insufficient_positions_after_threshold").when(c("trade_strength") < least_spread, "signal_spread_too_small")
    )
    return stats.withColumns({"block_reason": reason, "calendar_warning": sure((F.lit(mode) == "development") & (calendar == "weekday_fallback"))}).withColumn("tradeable", c("block_reason").isNull())


def apply_decision(position: Column, strategy: Column, gap: Column, limit: float = 0.005) -> Column:
    """The position after a rule's decision; a missing gap keeps it, an unknown strategy changes nothing."""
    up, down = sure(gap > limit), sure(gap < -limit)
    return (
        F.when(strategy == SKIP, "neutral").when((strategy == FLIP) & (position == "LONG"), "SHORT").when((strategy == SHORT_ONLY) & (position == "LONG"), "neutral")
        .when(strategy.isin(GAP, LONG_GAP) & (position == "LONG") & up, "neutral").when((strategy == GAP) & (position == "SHORT") & down, "neutral").otherwise(position)
    )
