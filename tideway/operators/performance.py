"""Equity, drawdown, performance, taxes and the backtest verdict.  A series is (keys..., date, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import COST_STEPS, DRAWDOWN_STEPS, RETURN_STEPS, TAX_STEPS, grade, steps

c = F.col
YEAR = 252


def equity(series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds equity and drawdown; the running maximum begins with the first row, so a first loss is no drawdown."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = series.where("ret is not null").withColumn("equity", F.product(1 + c("ret")).over(w))
    return out.withColumn("drawdown", c("equity") / F.max("equity").over(w) - 1)


def performance(series: DataFrame, keys: list[str], per_year: int = YEAR) -> DataFrame:
    """Annual return, risk, their ratio and the deepest drawdown in per cent, and the number of rows."""
    out = equity(series, keys).groupBy(*keys).agg((F.avg("ret") * per_year).alias("m"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(per_year)))).alias("s"), F.min("drawdown").alias("d"), F.count("*").alias("n_days"))
    return out.select(*keys, (c("m") * 100).alias("ar"), (c("s") * 100).alias("risk"), F.when(c("s") > 0, c("m") / c("s")).alias("rr"), (c("d") * 100).alias("mdd"), "n_days")


def longest_runs(series: DataFrame, keys: list[str]) -> DataFrame:
    """Longest runs of wins and of the rest; a zero return is no win."""
    w, v = Window.partitionBy(*keys).orderBy("date"), Window.partitionBy(*keys, "win").orderBy("date")
    rows = series.withColumn("win", c("ret") > 0)
    rows = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    runs = rows.groupBy(*keys, "win", "island").count()
    best = lambda win: F.coalesce(F.max(F.when(c("win") == win, c("count"))), F.lit(0))
    return runs.groupBy(*keys).agg(best(True).alias("max_wins"), best(False).alias("max_losses"))


def daily_tax(ret: Column, rate: float = 0.20315) -> Column:
    return F.greatest(ret, F.lit(0.0)) * rate


def yearly_tax(series: DataFrame, keys: list[str], rate: float = 0.20315, carry_years: int = 3) -> DataFrame:
    """Tax of each year on its profit less the losses carried forward, oldest first; losses lapse after ``carry_years``.

    The years of a series are folded in order in one expression, without a Python function.
    """
    years = series.groupBy(*keys, F.year("date").alias("year")).agg(F.sum(F.coalesce("ret", F.lit(0.0))).alias("pnl"), F.max("date").alias("last"))
    folded = years.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("year", "pnl", "last"))).alias("ys"))
    start = F.expr("named_struct('losses', cast(array() as array<struct<year:int,amount:double>>), 'out', cast(array() as array<struct<year:int,pnl:double,last:date,tax:double>>))")
    fold = f"""aggregate(ys, start, (s, y) -> transform(array(filter(s.losses, l -> y.year - l.year <= {carry_years} and l.amount > 0)), open ->
      named_struct(
        'losses', concat(
          filter(transform(open, (l, i) -> named_struct('year', l.year, 'amount', l.amount - least(l.amount, greatest(0D,
            greatest(0D, y.pnl) - aggregate(slice(open, 1, i), 0D, (a, b) -> a + b.amount))))), l -> l.amount > 0),
          if(y.pnl < 0, array(named_struct('year', y.year, 'amount', -y.pnl)), cast(array() as array<struct<year:int,amount:double>>))),
        'out', concat(s.out, array(named_struct('year', y.year, 'pnl', y.pnl, 'last', y.last,
          'tax', greatest(0D, y.pnl - aggregate(open, 0D, (a, b) -> a + b.amount)) * {rate})))))[0], s -> s.out)"""
    return folded.withColumn("start", start).select(*keys, F.explode(F.expr(fold)).alias("t")).select(*keys, "t.year", "t.pnl", "t.last", "t.tax")


def after_tax(series: DataFrame, keys: list[str], model: str = "annual_net", rate: float = 0.20315, carry_years: int = 3, enabled: bool = True) -> DataFrame:
    """Adds tax_paid and net_after_tax; a null return is 0, the tax of a year falls on its last row."""
    rows = series.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    if not enabled:
        return rows.withColumns({"tax_paid": F.lit(0.0), "net_after_tax": c("ret")})
    if model == "daily_positive_only":
        rows = rows.withColumn("tax_paid", daily_tax(c("ret"), rate))
    elif model == "annual_net":
        due = yearly_tax(rows, keys, rate, carry_years).select(*keys, c("last").alias("date"), "tax")
        rows = rows.join(due, [*keys, "date"], "left").withColumn("tax_paid", F.coalesce("tax", F.lit(0.0))).drop("tax")
    else:
        raise ValueError(f"unknown tax model {model!r}")
    return rows.withColumn("net_after_tax", c("ret") - c("tax_paid"))


#: Codes of a verdict in their order, each with its severity and what to do about it.
FINDINGS = (
    ("DATA_FRESHNESS_FAILED", "reject", "refresh_data"), ("CACHE_ISOLATION_FAILED", "reject", "rebuild_isolated_cache"), ("TOO_FEW_US_TICKERS", "reject", "review_lead_tickers"), ("TOO_FEW_JP_TICKERS", "reject", "review_lag_tickers"),
    ("SEVERELY_NEGATIVE_AFTER_TAX_RETURN", "reject", "revise_strategy"), ("LOW_AFTER_TAX_RETURN", "warn", "tune_quantile"), ("LOW_AFTER_TAX_RR", "warn", "tune_window_and_lambda"), ("DEEP_AFTER_TAX_DRAWDOWN", "warn", "control_exposure"),
    ("HIGH_COST_DRAG", "warn", "review_costs"), ("HIGH_TAX_DRAG", "warn", "review_tax_model"), ("DAILY_SIGNAL_NOT_READY", "warn", "synchronise_daily_data"), ("NON_STRICT_FILL_POLICY", "warn", "use_strict_fill"), ("CACHE_DATES_NOT_ALIGNED", "warn", "align_cache_dates"),
)
GO_ON = "continue_forward_test"


def verdict(metrics: DataFrame, least_ar: float = 3.0, least_rr: float = 0.30, most_mdd: float = -25.0, most_cost: float = 3.0, most_tax: float = 5.0, least_lead: int = 8, least_lag: int = 12) -> DataFrame:
    """Scores, grades, reasons (code:severity), actions (each once, in the order of the reasons) and the decision.

    ``metrics``: keys..., gross_ar, net_pre_tax_ar, net_after_tax_ar, net_after_tax_rr, net_after_tax_mdd (per cent), and
    the flags freshness_ok, cache_isolated, dates_aligned, signal_ready, strict_fill, stale, usable_lead, usable_lag.  A
    flag that is missing is false, a count that is missing 0.
    """
    ar, rr, mdd = c("net_after_tax_ar"), c("net_after_tax_rr"), c("net_after_tax_mdd")
    cost, tax = c("gross_ar") - c("net_pre_tax_ar"), c("net_pre_tax_ar") - ar
    yes, n = (lambda x: F.coalesce(c(x), F.lit(False))), (lambda x: F.coalesce(c(x), F.lit(0)))
    few_lead, few_lag = n("usable_lead") < least_lead, n("usable_lag") < least_lag
    off = lambda flag, points: F.when(flag, points).otherwise(0)
    out = metrics.withColumns({
        "profitability": F.greatest(F.lit(0), steps(ar, RETURN_STEPS) - F.when(rr < 0, 8).when(rr < least_rr * 0.5, 6).when(rr < least_rr, 4).otherwise(0)),
        "stability": F.greatest(F.lit(0), steps(mdd, DRAWDOWN_STEPS) - F.when(rr < least_rr * 0.5, 3).when(rr < least_rr, 2).otherwise(0)),
        "cost_resilience": steps(cost, COST_STEPS, below=True) + steps(tax, TAX_STEPS, below=True),
        "executability": 10 - off(~yes("signal_ready"), 5) - off(few_lead | few_lag, 5),
        "data_reliability": F.greatest(F.lit(0), 15 - off(~yes("freshness_ok"), 6) - off(~yes("strict_fill"), 3) - off(~yes("cache_isolated"), 3) - off(~yes("dates_aligned"), 2) - off(yes("stale"), 2)),
    })
    applies = (
        ~yes("freshness_ok"), ~yes("cache_isolated"), few_lead, few_lag, ar < -5.0, ar < least_ar, rr < least_rr, mdd < most_mdd, cost > most_cost, tax > most_tax, ~yes("signal_ready"), ~yes("strict_fill"), ~yes("dates_aligned"),
    )
    found = F.array_compact(F.array(*[F.when(a, F.struct(F.lit(x).alias("code"), F.lit(y).alias("severity"), F.lit(z).alias("action"))) for a, (x, y, z) in zip(applies, FINDINGS)]))
    parts = {"profitability": 30, "stability": 25, "cost_resilience": 20, "executability": 10, "data_reliability": 15}
    out = out.withColumns({"found": found, "overall_score": sum((c(p) for p in parts), F.lit(0))} | {f"{p}_grade": grade(c(p), most) for p, most in parts.items()})
    count = lambda severity: F.size(F.filter("found", lambda x: x["severity"] == severity))
    critical = F.coalesce((cost > most_cost) & (tax > most_tax), F.lit(False))
    score, todo = c("overall_score"), F.array_distinct(F.transform("found", lambda x: x["action"]))
    decision = F.when(count("reject") > 0, "reject").when((score >= 80) & ~critical, "pass").when((score >= 75) & (count("warn") <= 1) & ~critical, "pass").when(score >= 60, "hold").otherwise("reject")
    return out.withColumns({
        "overall_decision": decision, "reasons": F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["code"], x["severity"])), "|"), "actions": F.when(F.size(todo) > 0, F.array_join(todo, "|")).otherwise(GO_ON),
    }).drop("found")
