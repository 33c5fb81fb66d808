"""The daily report: one nested record for each signal date, from the tables of the run, the backtest and its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import KEY

c = F.col
PLACES = "decimal(20,6)"  # numbers of a document, so that every reader sees the same digits
MIN_LOT = 10


def number(x: Column | str) -> Column:
    return (c(x) if isinstance(x, str) else x).cast(PLACES)


def backtest(performance: DataFrame, costs: DataFrame, verdict: DataFrame, params: dict) -> DataFrame:
    """universe_id and backtest: settings, verdict, the performance of each set, and what was paid.

    ``performance(universe_id, set_name, ar, risk, rr, mdd, n_days)``, ``costs(universe_id, eval_start, ...)``, ``verdict``:
    scores, overall_decision and reasons joined by ``|``.
    """
    one = F.struct(number("ar").alias("AR"), number("risk").alias("Risk"), number("rr").alias("RR"), number("mdd").alias("MDD"), c("n_days").alias("N_days"))
    named = ("gross", "net_pre_tax", "net_after_tax")
    sets = performance.groupBy("universe_id").agg(*[F.max(F.when(c("set_name") == n, one)).alias(n) for n in named]).select("universe_id", F.struct(*named).alias("performance_sets"))
    scores = ("profitability", "stability", "cost_resilience", "executability", "data_reliability")
    reasons = F.filter(F.split("reasons", "[|]"), lambda x: x != "")
    judge = verdict.select("universe_id", F.struct("overall_score", "overall_decision", *scores, reasons.alias("reasons")).alias("judge"))
    paid = [x for x in costs.columns if x not in ("universe_id", "eval_start")]
    costs = costs.select("universe_id", F.struct(*[number(x).alias(x) for x in paid]).alias("cost_breakdown"), c("eval_start").cast("string").alias("eval_start"))
    given = F.struct(*[F.lit(v).alias(k) for k, v in params.items()])
    rows = judge.join(sets, "universe_id", "left").join(costs, "universe_id", "left")
    return rows.select("universe_id", F.struct(F.lit("production").alias("settings_name"), given.alias("params"), "judge", "performance_sets", "cost_breakdown", "eval_start").alias("backtest"))


def plan_rows(plan: DataFrame) -> DataFrame:
    """universe_id, date, long, short: the planned positions of each side by falling signal and ticker."""
    entry = F.struct(
        "ticker", "sector", number("signal").alias("signal"), number("weight_pct").alias("weight"), c("latest_price").alias("latest_price_jpy"), F.lit(MIN_LOT).alias("min_lot"), c("min_purchase").alias("min_purchase_jpy"), c("lots").alias("normalized_lots"), c("purchase").alias("normalized_purchase_jpy"),
    )
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(c("position") == s, F.struct((-c("signal")).alias("s"), c("ticker").alias("t"), entry.alias("e"))))), lambda x: x["e"])
    return plan.groupBy(*KEY).agg(side("LONG").alias("long"), side("SHORT").alias("short"))


def daily_report(days: DataFrame, plan: DataFrame, context: DataFrame, shadow: DataFrame, tested: DataFrame, entries: DataFrame, generated_at: Column, rule_id: str, mode: str = "production") -> DataFrame:
    """universe_id, date and the parts of each date's report document, in their order.

    ``days``: the gate's rows after the rule; ``context``: the rule's context; ``shadow``: what all other rules say;
    ``tested``: ``backtest``; ``entries``: history entries with their keys.  A date without a plan has empty lists.
    """
    rows = days.join(plan_rows(plan), KEY, "left").join(context, KEY, "left").join(shadow.select(*KEY, "shadow"), KEY, "left").join(entries.select(*KEY, "dedupe_key"), KEY, "left").join(F.broadcast(tested), "universe_id", "left")  # a row a universe
    listed = lambda x: F.coalesce(c(x), F.array().cast(dict(rows.dtypes)[x]))
    warning = (c("trend_regime") == "downtrend") | (c("vol_regime") == "high_vol")
    text = lambda x: c(x).cast("string")
    action = F.when(c("strategy") == "skip", "skip").when(c("strategy").isin("long_flip_oc", "short_only_oc", "lgap_oc"), "override").otherwise("execute")
    signal = F.struct(
        text("date").alias("signal_reference_us_date"), text("execution_date").alias("execution_target_jp_date"), c("source").alias("execution_target_jp_date_source"), F.lit(mode).alias("operation_mode"), "tradeable", c("block_reason").alias("trade_block_reason"), "calendar_warning",
        number("trade_strength").alias("trade_signal_strength"), c("candidate_long").alias("candidate_long_count"), c("candidate_short").alias("candidate_short_count"), c("n_long").alias("adopted_long_count"), c("n_short").alias("adopted_short_count"),
        c("adopted_long").alias("pre_rule_adopted_long_count"), c("adopted_short").alias("pre_rule_adopted_short_count"), c("no_trade").alias("no_trade_classification"), "trend_regime", "vol_regime", "rotation_regime", warning.alias("regime_warning"),
        F.struct("n_long", "n_short", listed("long").alias("long"), listed("short").alias("short")).alias("execution_plan"), F.struct(c("usable_lead").alias("usable_us_tickers"), c("usable_lag").alias("usable_jp_tickers")).alias("data_quality"),
        F.struct("freshness_ok", c("dates_aligned").alias("latest_dates_aligned"), text("lead_max").alias("latest_us_date"), text("lag_max").alias("latest_jp_date"), c("stale").alias("stale_tickers"), c("missing").alias("missing_tickers")).alias("freshness"),
        F.struct(F.lit(rule_id).alias("rule_id"), c("strategy").alias("selected_strategy"), action.alias("action")).alias("strategy_decision"),
        F.struct(*[number(x).alias(x) for x in ("open_gap", "long_gap", "short_gap", "candidate_signal_strength")]).alias("strategy_context"), c("shadow").alias("shadow_decisions"),
    )
    gaps = F.concat("missing", "stale")
    step = lambda s: F.struct(F.when(c(f"{s}_max").isNull(), "missing").when(c(f"{s}_min") == c(f"{s}_max"), "ok").otherwise("uneven").alias("status"), text(f"{s}_max").alias("latest"))
    fetch = F.struct(F.when(c("freshness_ok"), "ok").otherwise("partial").alias("status"), F.when(F.size(gaps) > 0, F.array_join(gaps, ",")).alias("error_summary"), F.struct(step("lead").alias("lead"), step("lag").alias("lag")).alias("steps"))
    entry = F.struct("dedupe_key", text("date").alias("signal_date"), text("execution_date").alias("exec_jp_date"), "tradeable", "n_long", "n_short", c("strategy").alias("selected_strategy"))
    line = F.concat(text("date"), F.lit(": "), c("strategy"), F.lit(" / long "), text("n_long"), F.lit(" / short "), text("n_short"), F.when(c("tradeable"), "").otherwise(F.concat(F.lit(" / "), "block_reason")))
    return rows.select(*KEY, generated_at.alias("generated_at_utc"), "backtest", signal.alias("daily_signal"), fetch.alias("fetch"), entry.alias("history_entry"), line.alias("slack_fallback_text"))
