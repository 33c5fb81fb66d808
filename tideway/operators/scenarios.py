"""Scenario returns over trailing periods, and their monthly, yearly and period aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .performance import after_tax, equity, longest_runs
from .selection import KEY, quantile_masks

c = F.col
#: Fixed values: (id, direction, return column, gap filter).
SCENARIOS = (
    ("S01_CurrOC", "orig", "next_oc", "none"), ("S02_FlipL_OC", "flip_l", "next_oc", "none"), ("S03_CurrCC", "orig", "next_cc", "none"), ("S04_FlipL_CC", "flip_l", "next_cc", "none"), ("S05_CurrOO", "orig", "ret_oo", "none"),
    ("S06_Curr1D", "orig", "ret_hold", "none"), ("S08_GapOvht05", "orig", "next_oc", "both"), ("S09_LGapFlt05", "orig", "next_oc", "long"), ("S10_ShortOnly", "short_only", "next_oc", "none"),
)
BASELINE = "S01_CurrOC"
#: The scenarios of the recovery study, with the days that they are limited to.
RECOVERY = tuple((*s, "all") for s in SCENARIOS) + (
    ("S07_GapFlt05", "orig", "next_oc", "abs", "all"), ("S11_FlipLGapFlt", "flip_l", "next_oc", "both", "all"), ("S12_HighVol", "orig", "next_oc", "none", "high_vol"), ("S13_NoMidVol", "orig", "next_oc", "none", "not_mid_vol"),
    ("S14_FlipL_HiVol", "flip_l", "next_oc", "none", "high_vol"), ("S15_HighSig", "orig", "next_oc", "none", "high_sig"),
)
ROUND_TRIP = 0.001


def scenario_returns(signals: DataFrame, rets: DataFrame, q: float = 0.3, min_long: float = 0.1, max_short: float = -0.1, gap_limit: float = 0.005, scenarios=SCENARIOS) -> DataFrame:
    """(universe_id, date, scenario_id): gross, contributions, counts, tradeable and the reason why not.

    A scenario is an element of an array that each signal row is multiplied by, so all scenarios share one scan and one
    shuffle; dates with fewer than three signals are reported, not dropped.
    """
    facts = signals.where("signal is not null").join(rets.select(*KEY, "ticker", "next_oc", "next_cc", "ret_oo", "ret_hold", "next_gap"), [*KEY, "ticker"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("scenario_id"), F.lit(d).alias("direction"), c(r).alias("ret"), F.lit(g).alias("filter")) for i, d, r, g, *_ in scenarios]))
    rows = facts.select(*KEY, "ticker", "signal", "next_gap", each.alias("s")).select(*KEY, "ticker", "signal", "next_gap", "s.*")
    keys = [*KEY, "scenario_id"]
    heads = rows.groupBy(*keys, "direction").agg(F.count("*").alias("n_signal"), F.count("ret").alias("n_ret"))
    p = F.percentile("signal", F.array(F.lit(q), F.lit(1.0 - q))).over(Window.partitionBy(*keys))
    common = rows.where("ret is not null").withColumn("p", p)
    gap = F.coalesce("next_gap", F.lit(0.0))
    common = common.withColumns({"cl": (c("signal") >= c("p")[1]) & (c("signal") >= min_long), "cs": (c("signal") <= c("p")[0]) & (c("signal") <= max_short)})
    long_ok = F.when(c("filter") == "abs", F.abs(gap) <= gap_limit).otherwise((c("filter") == "none") | (gap <= gap_limit))
    short_ok = F.when(c("filter") == "abs", F.abs(gap) <= gap_limit).otherwise((c("filter") != "both") | (gap >= -gap_limit))
    common = common.withColumns({"l": c("cl") & long_ok, "s": c("cs") & short_ok})
    legs = common.groupBy(*keys).agg(
        F.count_if("cl").alias("cl"), F.count_if("cs").alias("cs"), F.count_if("l").alias("nl"), F.count_if("s").alias("ns"), F.avg(F.when(c("l"), c("ret"))).alias("lr"), F.avg(F.when(c("s"), c("ret"))).alias("sr"),
    )
    d = heads.join(legs, keys, "left")
    zero = F.lit(0)
    reason = (
        F.when(c("n_signal") < 3, "insufficient_signal").when(c("n_ret") == 0, "no_jp_return_data").when(c("n_ret") < 2, "too_few_common_tickers")
        .when((c("nl") + c("ns") == 0) & (c("cl") + c("cs") == 0), "no_threshold_candidates").when(c("nl") + c("ns") == 0, "gap_filter_removed_all")
    )
    d = d.withColumn("skip_reason", reason).withColumn("tradeable", c("skip_reason").isNull())
    long = F.when(c("tradeable"), F.when(c("direction") == "orig", F.coalesce("lr", F.lit(0.0))).when(c("direction") == "flip_l", -F.coalesce("lr", F.lit(0.0))).otherwise(0.0)).otherwise(0.0)
    short = F.when(c("tradeable"), -F.coalesce("sr", F.lit(0.0))).otherwise(0.0)
    early = c("n_signal") < 3
    n = lambda x: F.when(early | (c("n_ret") < 2), zero).otherwise(F.coalesce(x, zero))
    d = d.withColumns({"long_contrib": long, "short_contrib": short})
    gross = F.when((c("nl") > 0) & (c("ns") > 0), 0.5 * c("long_contrib") + 0.5 * c("short_contrib")).when(c("nl") > 0, c("long_contrib")).otherwise(c("short_contrib"))
    return d.select(
        *keys, F.when(c("tradeable"), gross).otherwise(0.0).alias("gross"), "long_contrib", "short_contrib", "tradeable", "skip_reason",
        n("cl").alias("cand_long"), n("cs").alias("cand_short"), F.when(c("tradeable"), c("nl")).otherwise(0).alias("adopt_long"), F.when(c("tradeable"), c("ns")).otherwise(0).alias("adopt_short"),
    )


def period_bounds(signals: DataFrame, periods: dict[str, int | None]) -> DataFrame:
    """First and last signal date of each trailing period, given in rows (None: all)."""
    order = Window.partitionBy("universe_id").orderBy(F.desc("date"))
    days = signals.select(*KEY).distinct().withColumn("back", F.row_number().over(order))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("period_label"), F.lit(n).cast("int").alias("rows")) for k, n in periods.items()]))
    days = days.select(*KEY, "back", each.alias("p")).where(c("p.rows").isNull() | (c("back") <= c("p.rows")))
    return days.groupBy("universe_id", c("p.period_label").alias("period_label")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def period_days(scenarios: DataFrame, bounds: DataFrame) -> DataFrame:
    """Facts in per cent of each date, scenario and period; taxes are those of the slice."""
    rows = scenarios.join(bounds, "universe_id").where(c("date").between(c("start_date"), c("end_date")))  # a few rows a universe
    keys = ["universe_id", "period_label", "scenario_id"]
    rows = rows.withColumn("ret", c("gross") - F.when(c("tradeable"), ROUND_TRIP).otherwise(0.0))
    rows = after_tax(rows, keys)
    pct = lambda x: F.round(c(x) * 100, 6)
    return rows.select(
        *keys, "date", "tradeable", "skip_reason", pct("gross").alias("gross_pct"), pct("ret").alias("net_pre_tax_pct"), pct("net_after_tax").alias("net_after_tax_pct"), pct("long_contrib").alias("long_pct"), pct("short_contrib").alias("short_pct"),
        "cand_long", "cand_short", "adopt_long", "adopt_short",
    )


#: Names of the scenarios.
NAMES = {"S01_CurrOC": "current, open to close", "S02_FlipL_OC": "longs turned, open to close", "S03_CurrCC": "current, close to close", "S04_FlipL_CC": "longs turned, close to close", "S05_CurrOO": "current, open to open", "S06_Curr1D": "current, held a day", "S08_GapOvht05": "gap filter on both sides", "S09_LGapFlt05": "gap filter on the longs", "S10_ShortOnly": "shorts only"}
#: The 27 columns of the period table.
PERIOD_COLUMNS = (
    "date", "period_label", "strategy_id", "strategy_name", "gross_return_pct", "net_pre_tax_return_pct", "net_after_tax_return_pct", "long_contribution_pct", "short_contribution_pct", "tradeable", "skip_reason",
    "candidate_long_count", "candidate_short_count", "adopted_long_count", "adopted_short_count", "trade_signal_strength", "candidate_signal_strength", "adopted_signal_strength",
    "jp_next_open_gap_mean", "jp_oc_mean", "jp_cc_mean", "jp_gap_to_oc_reversal", "jp_long_gap_mean", "jp_short_gap_mean", "trend_regime", "vol_regime", "rotation_regime",
)


def period_table(days: DataFrame, strength: DataFrame, features: DataFrame, regime: DataFrame) -> DataFrame:
    """The period table: facts of each date, scenario and period with the date's signal and lag features and its regimes.

    ``days``: ``period_days``; the others have a row a date at most, and a date that one lacks has nulls there.
    """
    rows = days.join(strength.select(*KEY, "candidate_strength", "adopted_strength"), KEY, "left").join(features, KEY, "left").join(regime.select(*KEY, "trend_regime", "vol_regime", "rotation_regime"), KEY, "left")
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[c("scenario_id")]
    renamed = {
        "strategy_id": c("scenario_id"), "strategy_name": name, "gross_return_pct": c("gross_pct"), "net_pre_tax_return_pct": c("net_pre_tax_pct"), "net_after_tax_return_pct": c("net_after_tax_pct"), "long_contribution_pct": c("long_pct"), "short_contribution_pct": c("short_pct"),
        "candidate_long_count": c("cand_long"), "candidate_short_count": c("cand_short"), "adopted_long_count": c("adopt_long"), "adopted_short_count": c("adopt_short"), "trade_signal_strength": c("adopted_strength"), "candidate_signal_strength": c("candidate_strength"), "adopted_signal_strength": c("adopted_strength"),
        "jp_next_open_gap_mean": c("gap_mean"), "jp_oc_mean": c("oc_mean"), "jp_cc_mean": c("cc_mean"), "jp_gap_to_oc_reversal": c("gap_to_oc_reversal"), "jp_long_gap_mean": c("long_gap_mean"), "jp_short_gap_mean": c("short_gap_mean"),
    }
    return rows.select("universe_id", *[renamed.get(x, c(x)).alias(x) for x in PERIOD_COLUMNS])


def _compound(x: str) -> Column:
    return (F.product(1 + c(x) / 100) - 1) * 100


def aggregates(days: DataFrame, by: Column, name: str) -> DataFrame:
    """Means, compounds, win rate, contributions and drawdown by period, scenario and ``by`` (a month, a year)."""
    rows = days.withColumn(name, by)
    keys = ["universe_id", "period_label", "scenario_id", name]
    dd = equity(rows.select(*keys, "date", (c("gross_pct") / 100).alias("ret")), keys).groupBy(*keys).agg((F.min("drawdown") * 100).alias("mdd_pct"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.avg("gross_pct").alias("gross_avg_pct"), _compound("gross_pct").alias("gross_cumulative_pct"), F.avg("net_after_tax_pct").alias("net_avg_pct"), _compound("net_after_tax_pct").alias("net_cumulative_pct"),
        F.avg((c("gross_pct") > 0).cast("double")).alias("win_rate"), F.sum("long_pct").alias("long_sum_pct"), F.sum("short_pct").alias("short_sum_pct"),
    )
    return out.join(dd, keys)


def summaries(days: DataFrame, bounds: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """One row for each period and scenario; one without days says so."""
    keys = ["universe_id", "period_label", "scenario_id"]
    gross = days.select(*keys, "date", (c("gross_pct") / 100).alias("ret"))
    dd = equity(gross, keys).groupBy(*keys).agg((F.min("drawdown") * 100).alias("mdd_pct"))
    out = days.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.avg("gross_pct").alias("gross_avg_pct"), _compound("gross_pct").alias("gross_cumulative_pct"), F.avg("net_pre_tax_pct").alias("net_pre_tax_avg_pct"), _compound("net_pre_tax_pct").alias("net_pre_tax_cumulative_pct"),
        F.avg("net_after_tax_pct").alias("net_avg_pct"), _compound("net_after_tax_pct").alias("net_cumulative_pct"), F.percentile("gross_pct", F.lit(0.5)).alias("median_pct"), F.avg((c("gross_pct") > 0).cast("double")).alias("win_rate"),
        F.avg("long_pct").alias("long_avg_pct"), F.avg("short_pct").alias("short_avg_pct"),
    )
    out = out.join(dd, keys).join(longest_runs(gross, keys), keys)
    domain = bounds.select("universe_id", "period_label", "start_date", "end_date", F.explode(F.array(*[F.lit(s[0]) for s in scenarios])).alias("scenario_id"))
    out = domain.join(out, keys, "left").withColumn("notes", F.when(c("n_days").isNull(), "no_data"))
    return out.withColumn("n_days", F.coalesce("n_days", F.lit(0)))


def baseline_deltas(summary: DataFrame) -> DataFrame:
    names = ["gross_avg_pct", "gross_cumulative_pct", "net_avg_pct", "net_cumulative_pct", "win_rate", "mdd_pct", "long_avg_pct", "short_avg_pct"]
    base = summary.where(c("scenario_id") == BASELINE).select("universe_id", "period_label", *[c(n).alias(f"b_{n}") for n in names])
    return summary.join(base, ["universe_id", "period_label"]).select("universe_id", "period_label", "scenario_id", *[(c(n) - c(f"b_{n}")).alias(f"delta_{n}") for n in names])


def signal_features(signals: DataFrame, q: float = 0.3, min_long: float = 0.1, max_short: float = -0.1) -> DataFrame:
    """Strength (mean long less mean short) of the candidates and of the adopted of each date."""
    rows = quantile_masks(signals, q)
    mean = lambda m: F.avg(F.when(m, c("signal")))
    out = rows.groupBy(*KEY).agg(
        mean(c("cand_long")).alias("cl"), mean(c("cand_short")).alias("cs"), mean(c("cand_long") & (c("signal") >= min_long)).alias("al"), mean(c("cand_short") & (c("signal") <= max_short)).alias("as_"),
    )
    return out.select(*KEY, (c("cl") - c("cs")).alias("candidate_strength"), (c("al") - c("as_")).alias("adopted_strength"))


def lag_features(signals: DataFrame, rets: DataFrame, q: float = 0.3) -> DataFrame:
    rows = quantile_masks(signals, q).join(rets.select(*KEY, "ticker", "next_gap", "next_oc", "next_cc"), [*KEY, "ticker"], "left")
    out = rows.groupBy(*KEY).agg(
        F.avg("next_gap").alias("gap_mean"), F.avg("next_oc").alias("oc_mean"), F.avg("next_cc").alias("cc_mean"), F.avg(F.when(c("cand_long"), c("next_gap"))).alias("long_gap_mean"), F.avg(F.when(c("cand_short"), c("next_gap"))).alias("short_gap_mean"),
    )
    return out.withColumn("gap_to_oc_reversal", c("oc_mean") - c("gap_mean"))


def limited(returns: DataFrame, regime: DataFrame, strength: DataFrame, scenarios=RECOVERY, high: float = 0.3) -> DataFrame:
    """Scenario returns on the days that each scenario is limited to: all, those of high or not of middle volatility, or
    those whose candidates' strength is at least ``high``."""
    days = F.create_map(*[F.lit(x) for s in scenarios for x in (s[0], s[4])])[c("scenario_id")]
    rows = returns.join(regime.select(*KEY, "vol_regime"), KEY, "left").join(strength.select(*KEY, "candidate_strength"), KEY, "left")
    ok = F.when(days == "high_vol", c("vol_regime") == "high_vol").when(days == "not_mid_vol", c("vol_regime") != "mid_vol").when(days == "high_sig", c("candidate_strength") >= high).otherwise(True)
    return rows.where(ok).drop("vol_regime", "candidate_strength")


def ranking(days: DataFrame, weights: dict[str, float], per_year: int = 252) -> DataFrame:
    """Scenarios by the weighted mean of their annual net returns over several periods, with the shares of months and years
    that end above zero over the longest one (that named first) and a judgement.

    ``days``: facts in per cent of each date, scenario and period.  Go: the returns of the first three periods and half of
    the months are above zero; Hold: three of these four are; else No-Go.
    """
    keys = ["universe_id", "scenario_id"]
    first, *_ = weights
    top3 = list(weights)[:3]
    annual = days.groupBy(*keys, "period_label").agg((F.avg("net_after_tax_pct") * per_year).alias("ar"))
    value = lambda p: F.max(F.when(c("period_label") == p, c("ar")))
    score = annual.groupBy(*keys).agg(*[value(p).alias(f"ar_{p}") for p in weights])
    total = sum(weights.values())
    score = score.withColumn("score", sum((F.coalesce(f"ar_{p}", F.lit(0.0)) * w for p, w in weights.items()), F.lit(0.0)) / total)
    for name, by in (("month", F.date_format("date", "yyyy-MM")), ("year", F.year("date"))):
        sums = days.where(c("period_label") == first).groupBy(*keys, by.alias("by")).agg(F.sum("net_after_tax_pct").alias("s"))
        score = score.join(sums.groupBy(*keys).agg(F.avg((c("s") > 0).cast("double")).alias(f"{name}_rate")), keys, "left")
    good = sum((F.coalesce((c(f"ar_{p}") > 0).cast("int"), F.lit(0)) for p in top3), F.coalesce((c("month_rate") >= 0.5).cast("int"), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("universe_id").orderBy(F.desc("score"), "scenario_id"))
    return score.withColumns({"judge": F.when(good == 4, "Go").when(good == 3, "Hold").otherwise("No-Go"), "rank": rank})
