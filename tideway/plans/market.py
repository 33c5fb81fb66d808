"""The registered market queries: each is an operator applied to the panel of the order tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import sure
from ..functions.rules import RULES, rolling_selector
from ..operators import daily, performance, portfolio, regime, report, returns, scenarios, selection, sessions, signals, status, store, studies
from ..operators.work import Saved, ship
from ..sources import documents, market
from .sql import DAYS, LENGTH, PERIOD_D, PERIOD_TABLE, QUALITY, REPORT_SET, SPREAD_DAYS, flip_sql, for_days, for_universes, gates_sql, report_sql, scenario_chain, spread_sql, statement, status_sql, threshold_sql

c = F.col
#: Places that doubles are rounded to, and those of means of values that have six places: at seven, ties are frequent.
DIGITS, MEANS = 7, 9
PERIODS = {"full_period": None, "trailing_5y": 60, "trailing_3y": 36, "trailing_2y": 24, "trailing_1y": 12}
LIMITS = {"min_long": 0.02, "max_short": -0.02}
REQUIRED = "2001-11-01"
#: The rule that daily runs follow.
ACTIVE = "rule_406_no_flip"
RANKS = {"full_period": 4.0, "trailing_5y": 3.0, "trailing_3y": 2.0, "trailing_2y": 1.5, "trailing_1y": 0.5}
K = ["universe_id", "date"]


class Market:
    """The intermediate tables that queries share; each is built only if a query asks for it.

    The panel and the returns, a few rows per ticker and period, are written once to the shared folder where several
    tables are made of them, so that the order lines are read once; so are other tables that are read several times.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, by: str | None = None, grain: str = "month"):
        self.spark, self.sf_dir, self.by, self.grain, self.save = spark, sf_dir, by, grain, Saved(spark, "market")
        ship(spark)
        self.length, self.pretrain, self.per_year = (DAYS, 500, 252) if grain == "day" else (LENGTH, 36, 12)

    @cached_property
    def panel(self):
        return market.order_panel(self.spark, self.sf_dir, self.grain, self.by)

    @cached_property
    def saved_panel(self):
        return self.save(self.panel, "panel")

    @cached_property
    def rets(self):
        return self.save(returns.returns(market.dense(self.saved_panel)), "returns")

    @cached_property
    def joint(self):
        return self.save(returns.joint(self.rets), "joint")

    @cached_property
    def names(self):
        return self.saved_panel.select("universe_id", "ticker", "ord", "side", "cyc").distinct()

    @cached_property
    def signal(self):
        return signals.momentum(self.rets, self.length)

    @cached_property
    def external(self):
        """A folder for factor files and reports; empty until ``publish_external`` fills it."""
        return f"{self.save.root}/external"

    def publish_external(self):
        store.write_factors(self.factors, self.external, "carhart4.csv")
        documents.write_returns(self.portfolio.where("universe_id = 'all'").select("date", c("gross_return").alias("ret_sub")), f"{self.external}/report")

    @cached_property
    def store_rows(self):
        """The panel as a price store: raw prices, and adjusted ones, which the splits and dividends make, of the first half."""
        rows = self.saved_panel.where("open is not null or close is not null").select("universe_id", "ticker", "date", F.lit("raw").alias("price_mode"), "open", "close")
        return rows.unionByName(rows.where("date < '1996-01-01'").withColumns({"price_mode": F.lit("adjusted"), "open": c("open") * 0.8, "close": c("close") * 0.8}))

    @cached_property
    def grid_signals(self):
        """Subspace signals with next returns for all weights of the prior, from one pass."""
        return self.with_next(signals.subspace_grid(self.joint, self.names, (LENGTH,), LAMBDAS).drop("length"))

    def with_next(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.rets.where("next_oc is not null").select(*K, "ticker", "next_oc"), [*K, "ticker"])

    @cached_property
    def subspace(self):
        return self.save(self.eigen(), "subspace")

    def eigen(self, lam: float = 0.9, matrix: bool = False):
        return signals.subspace_signals(self.joint, self.names, self.length, lam=lam, pretrain=self.pretrain, matrix=matrix)

    @cached_property
    def regime(self):
        return regime.regimes(self.rets, self.signal)

    @cached_property
    def masks(self):
        return selection.quantile_masks(self.signal)

    @cached_property
    def positions(self):
        return selection.positions(self.masks)

    @cached_property
    def stats(self):
        return selection.candidate_stats(self.positions)

    @cached_property
    def portfolio(self):
        return portfolio.portfolio(self.signal, self.rets)

    @cached_property
    def saved_portfolio(self):
        return self.save(self.portfolio, "portfolio")

    @cached_property
    def run_regime(self):
        return self.save(self.regime, "regime")

    @cached_property
    def run_stats(self):
        return self.save(self.stats, "stats")

    @cached_property
    def contexts(self):
        return portfolio.contexts(self.signal, self.rets, self.regime)

    @cached_property
    def decisions(self):
        return portfolio.decisions(self.contexts[1], {n: f() for n, f in RULES.items()})

    @cached_property
    def rule_portfolio(self):
        return portfolio.rule_portfolio(self.contexts[0], self.decisions)

    def sets(self, days: DataFrame | None = None):
        """gross, net_pre_tax and net_after_tax returns of a portfolio as one series table."""
        days = self.saved_portfolio if days is None else self.save(days, "portfolio-of")
        taxed = performance.after_tax(days.select("universe_id", "date", c("net_pre_tax_return").alias("ret"), "gross_return"), ["universe_id"])
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("set_name"), c(v).alias("ret")) for n, v in (("gross", "gross_return"), ("net_pre_tax", "pre"), ("net_after_tax", "net_after_tax"))]))
        return taxed.withColumnRenamed("ret", "pre").select("universe_id", "date", each.alias("s")).select("universe_id", "date", "s.*")

    def performance(self, days: DataFrame | None = None):
        return performance.performance(self.sets(days), ["universe_id", "set_name"], self.per_year)

    @cached_property
    def scenarios(self):
        return self.save(scenarios.scenario_returns(self.signal, self.rets, **LIMITS), "scenarios")

    @cached_property
    def bounds(self):
        return scenarios.period_bounds(self.signal, PERIODS)

    @cached_property
    def period_days(self):
        return self.save(scenarios.period_days(self.scenarios, self.bounds), "period-days")

    @cached_property
    def period_table(self):
        return scenarios.period_table(self.period_days, self.strength, scenarios.lag_features(self.signal, self.rets), self.regime)

    @cached_property
    def summary(self):
        return scenarios.summaries(self.period_days, self.bounds)

    @cached_property
    def lead_features(self):
        return studies.lead_features(self.rets)

    @cached_property
    def strength(self):
        return scenarios.signal_features(self.signal, **LIMITS)

    @cached_property
    def wanted(self):
        """The tickers that are tracked: all brands up to 26, one more than there are."""
        n = self.spark.range(1, 27).select(c("id").cast("int").alias("ord"))
        ids = self.saved_panel.select("universe_id").distinct()
        return ids.crossJoin(n).select("universe_id", F.concat(F.lit("Brand#"), "ord").alias("ticker"), "ord", F.when(c("ord") <= market.LAST_LEAD, "lead").otherwise("lag").alias("side"))

    def cache(self, required: str = REQUIRED, last: int = 25):
        return status.summary(self.saved_panel, self.wanted.where(c("ord") <= last), F.lit(required).cast("date"))

    @cached_property
    def flags(self):
        """What a verdict and the tradeability need to know about the data, one row per universe."""
        known = self.cache().select("universe_id", c("aligned").alias("dates_aligned"), "signal_ready", status.is_fresh().alias("freshness_ok"), (F.size("stale") + F.size("missing") > 0).alias("stale"))
        return known.join(returns.joint_quality(self.rets).select("universe_id", "usable_lead", "usable_lag"), "universe_id", "left")

    @cached_property
    def sectors(self):
        return self.spark.range(1, 21).select(F.concat(F.lit("Brand#"), "id").alias("ticker"), F.concat(F.lit("Sector "), c("id") % 5).alias("sector"))

    @cached_property
    def runs(self):
        """The signal dates with their execution dates, from the calendar of the lag side."""
        return self.save(sessions.execution_dates(self.run_stats, self.saved_panel.where("side = 'lag'")), "runs")

    @cached_property
    def run_gaps(self):
        return self.save(sessions.gaps_as_of(self.rets.where("side = 'lag'"), self.runs), "run-gaps")

    @cached_property
    def run_contexts(self):
        return daily.contexts(self.positions, self.run_gaps, self.run_stats, self.run_regime)

    @cached_property
    def run_decisions(self):
        return self.save(portfolio.decisions(self.run_contexts, {n: f() for n, f in RULES.items()}), "run-decisions")

    @cached_property
    def after(self):
        """Positions of each date after the active rule's decision."""
        return self.save(daily.after_rule(self.positions, self.run_decisions.where(c("rule_id") == ACTIVE), self.run_gaps), "after")

    @cached_property
    def known(self):
        """What each run knows of the data: last prices, freshness, usable tickers."""
        prices = sessions.known_prices(self.saved_panel, self.wanted.where("ord <= 25"), self.runs)
        usable = sessions.usable_as_of(returns.covered(self.rets), self.runs)
        return self.save(sessions.freshness_as_of(prices).join(usable, K), "known")

    @cached_property
    def plan(self):
        return daily.plan(daily.named(self.after, self.sectors), self.saved_panel)

    def gated(self, after: DataFrame, stats: DataFrame | None = None, mode: str = "production", spread: float = 0.08, least: int = 2):
        """Tradeability of each date by what its run knows and holds after the rule, which overrides it with a skip.

        ``adopted_long`` and ``adopted_short`` are the counts before the rule, ``n_long`` and ``n_short`` those after it.
        """
        rows = (self.run_stats if stats is None else stats).join(self.runs, K).join(self.known, K).join(daily.taken(after), K)
        rows = rows.join(regime.warnings(self.run_regime), K, "left").join(after.select(*K, "strategy").distinct(), K, "left")
        rows = rows.withColumn("no_trade", selection.no_trade_class(c("adopted_long"), c("adopted_short"), c("long_gap_max"), c("short_gap_max"), sure(c("regime_warning"))))
        rows = rows.withColumn("class_after", daily.class_after(c("strategy"), c("no_trade"), c("n_long"), c("n_short"), c("long_gap_max"), c("short_gap_max")))
        held = rows.withColumnsRenamed({"adopted_long": "before_long", "adopted_short": "before_short", "trade_strength": "adopted_strength"})
        held = held.withColumnsRenamed({"n_long": "adopted_long", "n_short": "adopted_short", "strength_after": "trade_strength"})
        held = selection.tradeability(held, c("freshness_ok"), c("dates_aligned"), c("usable_lead"), c("usable_lag"), c("execution_date"), c("source"), mode, spread, least, least)
        held = held.withColumnsRenamed({"adopted_long": "n_long", "adopted_short": "n_short"}).withColumnsRenamed({"before_long": "adopted_long", "before_short": "adopted_short"})
        return daily.skip_override(held.withColumn("active_strategy", c("strategy")))

    @cached_property
    def traded(self):
        return self.save(self.gated(self.after), "traded")

    @cached_property
    def factors(self):
        """Factor columns for the regressions, made of the lead features (fractions by date)."""
        rows = self.lead_features.select("universe_id", "date", c("mean").alias("mkt_rf"), c("spread").alias("smb"), c("sd").alias("hml"), c("breadth").alias("mom"), (c("abs_mean") / 100).alias("rf"))
        return rows.where("universe_id = 'all'").drop("universe_id")

    @cached_property
    def actions(self):
        """Dividends of the tickers in March and September and splits where an open halves or doubles a close."""
        month = F.month("date")
        wide = self.saved_panel.select("universe_id", "ticker", "date", F.when(month.isin(3, 9), c("close") / 100).alias("dividend"), F.when((month == 6) & (c("open") > c("close") * 1.05), 2.0).alias("split"))
        return store.corporate_actions(wide, "orders")


@dataclass
class Query:
    build: Callable[[Market], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()
    dates: tuple[str, ...] = ("date",)
    by: str | None = None  # the column of the universes, if there are several
    grain: str = "month"
    digits: int = DIGITS


def presented(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded to seven places (or ``digits``), large ones to ten digits, so that the order of a sum does not show; dates as text."""
    out = []
    for f in df.schema.fields:
        x: Column = c(f.name)
        if isinstance(f.dataType, T.DoubleType):
            unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 9)
            x = F.when(F.abs(x) >= 1e6, F.round(x / unit) * unit).otherwise(F.round(x, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            x = x.cast("string")
        out.append(x.alias(f.name))
    return df.select(*out)


def _one_return(name: str, side: str = "lag") -> Query:
    return Query(lambda m: m.rets.where((c("side") == side) & c(name).isNotNull()).select(*K, "ticker", name), f"SELECT universe_id, date, ticker, {name} FROM rets WHERE side = '{side}' AND {name} IS NOT NULL", (name,))


def _rule(name: str) -> Query:
    return Query(lambda m: m.decisions.where(c("rule_id") == name), f"SELECT * FROM decisions WHERE rule_id = '{name}'")


def _rule_pf(name: str) -> Query:
    return Query(lambda m: m.rule_portfolio.where(c("rule_id") == name), f"SELECT universe_id, date, rule_id, strategy_decision, {PF} FROM rule_pf WHERE rule_id = '{name}'", PF_D)


def _decided(strategy: str) -> Query:
    def build(m: Market) -> DataFrame:
        rows = m.positions.join(m.rets.select(*K, "ticker", "gap"), [*K, "ticker"], "left")
        return rows.select(*K, "ticker", selection.apply_decision(c("position"), F.lit(strategy), c("gap")).alias("position"))

    case = {
        "skip": "'neutral'", "long_flip_oc": "CASE WHEN position = 'LONG' THEN 'SHORT' ELSE position END", "short_only_oc": "CASE WHEN position = 'LONG' THEN 'neutral' ELSE position END",
        "lgap_oc": "CASE WHEN position = 'LONG' AND gap > 0.005 THEN 'neutral' ELSE position END", "gap_ovht_oc": "CASE WHEN position = 'LONG' AND gap > 0.005 OR position = 'SHORT' AND gap < -0.005 THEN 'neutral' ELSE position END", "curr_oc": "position",
    }[strategy]
    return Query(build, f"SELECT p.universe_id, p.date, p.ticker, {case} AS position FROM positions p LEFT JOIN rets r USING (universe_id, date, ticker)")


PF = "gross_return, commission_cost, slippage_cost, borrow_cost, net_pre_tax_return, long_notional, short_notional, n_long, n_short"
PF_D = tuple(PF.split(", ")[:7])
STATS_D = ("signal_max", "signal_min", "signal_p25", "signal_p50", "signal_p75", "long_gap_max", "short_gap_max", "candidate_strength", "trade_strength")
AGG_D = ("gross_avg_pct", "gross_cumulative_pct", "net_avg_pct", "net_cumulative_pct", "win_rate", "long_sum_pct", "short_sum_pct", "mdd_pct")
SUM_D = ("gross_avg_pct", "gross_cumulative_pct", "net_pre_tax_avg_pct", "net_pre_tax_cumulative_pct", "net_avg_pct", "net_cumulative_pct", "median_pct", "win_rate", "long_avg_pct", "short_avg_pct", "mdd_pct")
DELTAS = ("gross_avg_pct", "gross_cumulative_pct", "net_avg_pct", "net_cumulative_pct", "win_rate", "mdd_pct", "long_avg_pct", "short_avg_pct")
LEAD_D = ("mean", "median", "iqr", "breadth", "breadth_down", "top3", "bottom3", "top_bottom_spread", "sd", "range", "abs_mean", "skew", "kurt", "cyclical", "defensive", "financial", "energy", "growth", "consumer", "spread", "growth_vs_def", "energy_vs_rest", "financial_vs_rest", "top1_share", "top3_share", "bottom1_share", "narrowness")


def _aggregate_sql(by: str, name: str) -> str:
    return f"""SELECT universe_id, period_label, scenario_id, {name}, count(*) AS n_days, avg(gross_pct) AS gross_avg_pct, (product(1 + gross_pct / 100) - 1) * 100 AS gross_cumulative_pct, avg(net_after_tax_pct) AS net_avg_pct,
      (product(1 + net_after_tax_pct / 100) - 1) * 100 AS net_cumulative_pct, avg(CASE WHEN gross_pct > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, sum(long_pct) AS long_sum_pct, sum(short_pct) AS short_sum_pct, min(e / m - 1) * 100 AS mdd_pct
      FROM (SELECT *, max(e) OVER (PARTITION BY period_label, scenario_id, {name} ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (
        SELECT *, product(1 + gross_pct / 100) OVER (PARTITION BY period_label, scenario_id, {by} ORDER BY date ROWS UNBOUNDED PRECEDING) AS e, {by} AS {name} FROM pd)) GROUP BY ALL"""


def _upsert(m: Market) -> DataFrame:
    rows = m.panel.select("ticker", "date", F.lit("raw").alias("price_mode"), "open", "close")
    fresh = rows.where(c("date") >= F.lit("2000-01-01").cast("date")).select("ticker", "date", "price_mode", (c("open") * 2).alias("open"), F.lit(None).cast("double").alias("close"))
    return store.upsert(rows, fresh)


def _verdict(m: Market) -> DataFrame:
    value = lambda s, x, n: F.round(F.max(F.when(c("set_name") == s, c(x))), n)
    metrics = m.performance().groupBy("universe_id").agg(
        value("gross", "ar", 2).alias("gross_ar"), value("net_pre_tax", "ar", 2).alias("net_pre_tax_ar"), value("net_after_tax", "ar", 2).alias("net_after_tax_ar"), value("net_after_tax", "rr", 3).alias("net_after_tax_rr"), value("net_after_tax", "mdd", 2).alias("net_after_tax_mdd"),
    )
    flags = m.flags.withColumns({"cache_isolated": F.lit(True), "strict_fill": F.lit(True)})  # one price mode, the policy of the joint matrix
    return performance.verdict(metrics.join(flags, "universe_id", "left"))


SCORES = ("profitability", "stability", "cost_resilience", "executability", "data_reliability", "overall_score")
VERDICT_SQL = """
SELECT universe_id, profitability::INT AS profitability, stability::INT AS stability, cost_resilience::INT AS cost_resilience, executability::INT AS executability, data_reliability::INT AS data_reliability, overall_score::INT AS overall_score,
  CASE WHEN rejects > 0 THEN 'reject' WHEN overall_score >= 80 AND NOT critical THEN 'pass' WHEN overall_score >= 75 AND warns <= 1 AND NOT critical THEN 'pass' WHEN overall_score >= 60 THEN 'hold' ELSE 'reject' END AS overall_decision, reasons
FROM (SELECT *, profitability + stability + cost_resilience + executability + data_reliability AS overall_score, cost > 3 AND tax > 5 AS critical, (ar < 3)::INT + (rr < 0.3)::INT + (mdd < -25)::INT + (cost > 3)::INT + (tax > 5)::INT + (NOT ready)::INT + (NOT aligned)::INT AS warns,
    (NOT fresh)::INT + (lead_n < 8)::INT + (lag_n < 12)::INT + (ar < -5)::INT AS rejects, concat_ws('|', CASE WHEN NOT fresh THEN 'DATA_FRESHNESS_FAILED:reject' END, CASE WHEN lead_n < 8 THEN 'TOO_FEW_US_TICKERS:reject' END, CASE WHEN lag_n < 12 THEN 'TOO_FEW_JP_TICKERS:reject' END,
      CASE WHEN ar < -5 THEN 'SEVERELY_NEGATIVE_AFTER_TAX_RETURN:reject' END, CASE WHEN ar < 3 THEN 'LOW_AFTER_TAX_RETURN:warn' END, CASE WHEN rr < 0.3 THEN 'LOW_AFTER_TAX_RR:warn' END, CASE WHEN mdd < -25 THEN 'DEEP_AFTER_TAX_DRAWDOWN:warn' END, CASE WHEN cost > 3 THEN 'HIGH_COST_DRAG:warn' END,
      CASE WHEN tax > 5 THEN 'HIGH_TAX_DRAG:warn' END, CASE WHEN NOT ready THEN 'DAILY_SIGNAL_NOT_READY:warn' END, CASE WHEN NOT aligned THEN 'CACHE_DATES_NOT_ALIGNED:warn' END) AS reasons FROM (
  SELECT *, greatest(0, CASE WHEN ar >= 10 THEN 30 WHEN ar >= 8 THEN 28 WHEN ar >= 6 THEN 24 WHEN ar >= 4 THEN 20 WHEN ar >= 3 THEN 18 WHEN ar >= 1 THEN 12 WHEN ar >= 0 THEN 8 ELSE 0 END - CASE WHEN rr < 0 THEN 8 WHEN rr < 0.15 THEN 6 WHEN rr < 0.3 THEN 4 ELSE 0 END) AS profitability,
    greatest(0, CASE WHEN mdd >= -10 THEN 25 WHEN mdd >= -12.5 THEN 22 WHEN mdd >= -15 THEN 20 WHEN mdd >= -17.5 THEN 18 WHEN mdd >= -20 THEN 16 WHEN mdd >= -22.5 THEN 13 WHEN mdd >= -25 THEN 10 ELSE 0 END - CASE WHEN rr < 0.15 THEN 3 WHEN rr < 0.3 THEN 2 ELSE 0 END) AS stability,
    CASE WHEN cost < 1 THEN 12 WHEN cost < 2 THEN 9 WHEN cost < 3 THEN 6 WHEN cost < 4 THEN 3 ELSE 0 END + CASE WHEN tax < 1 THEN 8 WHEN tax < 2.5 THEN 6 WHEN tax < 5 THEN 3 ELSE 0 END AS cost_resilience,
    10 - CASE WHEN ready THEN 0 ELSE 5 END - CASE WHEN lead_n < 8 OR lag_n < 12 THEN 5 ELSE 0 END AS executability, 15 - CASE WHEN fresh THEN 0 ELSE 6 END - CASE WHEN aligned THEN 0 ELSE 2 END - CASE WHEN behind THEN 2 ELSE 0 END AS data_reliability
  FROM (SELECT *, g - p AS cost, p - ar AS tax FROM (
    SELECT universe_id, max(round(ar, 2)) FILTER (set_name = 'gross') AS g, max(round(ar, 2)) FILTER (set_name = 'net_pre_tax') AS p, max(round(ar, 2)) FILTER (set_name = 'net_after_tax') AS ar, max(round(rr, 3)) FILTER (set_name = 'net_after_tax') AS rr, max(round(mdd, 2)) FILTER (set_name = 'net_after_tax') AS mdd FROM perf GROUP BY ALL)
    JOIN flags USING (universe_id))))
"""


#: The universes of the queries on several: order lines by return flag.
UNIVERSES = ("A", "N", "R")
GRID_Q, GRID_BPS = (0.15, 0.2, 0.25, 0.3), (1.0, 3.0, 5.0)


LAMBDAS = (0.7, 0.8, 0.9)  # at 1 the signals of tickers with one label are equal
WINDOWS, EIGEN_WINDOWS = (6, 12, 18), (6, 9, 12, 18, 24)


def _grid(m: Market) -> DataFrame:
    return studies.parameter_grid(m.with_next(m.signal), GRID_Q, GRID_BPS, per_year=12)


def _eigen_grid(m: Market) -> DataFrame:
    """The same for the subspace signal, with the weight of the prior as a further axis."""
    return studies.parameter_grid(m.grid_signals, GRID_Q, GRID_BPS, ("lambda",), 12)


def _lambda_grid(m: Market) -> DataFrame:
    """Performance of the subspace signal for several weights of the prior."""
    rows = signals.subspace_grid(m.joint, m.names, (LENGTH,), LAMBDAS).drop("length")
    days = portfolio.portfolio(rows, m.rets, params=("lambda",)).select(*K, "lambda", c("net_pre_tax_return").alias("ret"))
    return performance.performance(days, ["universe_id", "lambda"], 12)


def _windows(m: Market) -> DataFrame:
    """Performance of the momentum signal for several lengths of its window."""
    days = portfolio.portfolio(signals.momentum_grid(m.rets, WINDOWS), m.rets, params=("length",)).select(*K, "length", c("gross_return").alias("ret"))
    return performance.performance(days, ["universe_id", "length"], 12)


def _eigen_windows(m: Market) -> DataFrame:
    """Performance of the subspace signal, before and after costs, for several lengths of its window; one pass for all."""
    rows = signals.subspace_grid(m.joint, m.names, EIGEN_WINDOWS, (0.9,)).drop("lambda")
    days = m.save(portfolio.portfolio(rows, m.rets, params=("length",)), "eigen-windows")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("set_name"), c(v).alias("ret")) for n, v in (("gross", "gross_return"), ("net_pre_tax", "net_pre_tax_return"))]))
    return performance.performance(days.select(*K, "length", each.alias("s")).select(*K, "length", "s.*"), ["universe_id", "length", "set_name"], 12)


def _adaptive(m: Market) -> DataFrame:
    return selection.positions(m.masks.join(m.regime.select(*K, "vol_regime"), K), *selection.thresholds(c("vol_regime"), 0.02, -0.02, True))


def _checks(m: Market) -> DataFrame:
    quality = returns.joint_quality(m.rets).select("universe_id", "filled_cells")
    rows = m.traded.drop("regime_warning").join(regime.snapshots(m.run_regime, m.runs), K).join(regime.warnings(m.run_regime), K, "left").join(quality, "universe_id")
    rows = rows.withColumns({"fill_policy": F.lit("strict"), "price_mode": F.lit("raw"), "latest_lead": c("lead_max"), "latest_lag": c("lag_max"), "min_long": F.lit("0.0"), "max_short": F.lit("0.0")})
    return daily.execution_checks(rows)


def _log(m: Market) -> DataFrame:
    """Log rows of all dates: counts, tickers and classification after the rule."""
    rows = m.traded.drop("no_trade").join(daily.tickers(m.plan), K, "left").join(regime.snapshots(m.run_regime, m.runs), K)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "signal_reference_us_date": c("date").cast("string"), "execution_target_jp_date": c("execution_date").cast("string"), "execution_target_jp_date_source": c("source"), "operation_mode": F.lit("production"), "trade_signal_strength": F.round("trade_strength", 6), "trade_block_reason": c("block_reason"),
        "min_signal_spread_used": F.lit(0.08), "min_long_signal_used": F.lit(0.0), "max_short_signal_used": F.lit(0.0), "min_adopted_long_count_used": F.lit(2), "min_adopted_short_count_used": F.lit(2), "candidate_long_count": c("candidate_long"), "candidate_short_count": c("candidate_short"),
        "adopted_long_count": c("n_long"), "adopted_short_count": c("n_short"), "latest_dates_aligned": c("dates_aligned"), "usable_us_tickers": c("usable_lead"), "usable_jp_tickers": c("usable_lag"), "candidate_signal_strength": F.round("candidate_strength", 6), "adopted_signal_strength": F.round("adopted_strength", 6),
        "no_trade_classification": c("class_after"), "threshold_gap_long_max": c("long_gap_max"), "threshold_gap_short_max": c("short_gap_max"), "long_tickers": F.coalesce("long_tickers", none), "short_tickers": F.coalesce("short_tickers", none), "regime_warning_reason": F.filter(F.split("reasons", "[|]"), lambda x: x != ""),
    })
    return daily.log_rows(rows, F.lit("1970-01-01T00:00:00+00:00"))


def _history(m: Market) -> DataFrame:
    """History entries of all dates: what was held after the rule, and what the rule decided."""
    rows = m.traded.withColumns({"signal_date": c("date").cast("string"), "exec_date": c("execution_date").cast("string")}).join(daily.tickers(m.plan), K, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({x: F.coalesce(x, none) for x in ("long_tickers", "short_tickers")})
    return daily.recorded(daily.history(rows), F.lit("2026-08-20 21:30:00").cast("timestamp")).select(*K, "cached_date", "recorded_at", "dedupe_key", c("source").alias("exec_source"), "tradeable", "block_reason", "n_long", "n_short", "freshness_ok", "dates_aligned", "usable_lead", "usable_lag", "no_trade", F.lit(ACTIVE).alias("rule_id"), c("strategy").alias("selected_strategy"), daily.action(c("strategy")).alias("action"))


#: Settings that the gate is tried with: name, mode, whether the rule holds, thresholds (both sides), least spread and count.
GATES = (("as run", "production", True, 0.0, 0.08, 2), ("no rule", "production", False, 0.0, 0.0, 1), ("development", "development", False, 0.0, 0.0, 1), ("wide", "production", False, 0.0, 0.15, 1), ("many", "production", False, 0.0, 0.0, 5), ("strict", "production", False, 0.05, 0.0, 1))


def _gates(m: Market) -> DataFrame:
    """The gate under several settings; the setting is part of every key, so all share one pass for positions and one for
    the gate's inputs."""
    out = None
    for name, mode, rule, threshold, spread, least in GATES:
        pos = selection.positions(m.masks, threshold, -threshold)
        after = daily.after_rule(pos, m.run_decisions.where((c("rule_id") == ACTIVE) & F.lit(rule)), m.run_gaps)
        rows = m.gated(after, selection.candidate_stats(pos), mode, spread, least).select(*K, F.lit(name).alias("setting"), "tradeable", "block_reason", "no_trade", "calendar_warning", "n_long", "n_short")
        out = rows if out is None else out.unionByName(rows)
    return out


def _readiness(m: Market, published: bool = False) -> DataFrame:
    """Roll-up for each universe: are factors, regression, adjusted prices and a report there?  All is read from the files
    of the external folder, the saved actions and the panel."""
    if published:
        m.publish_external()
    factors, tested = store.load_factors(m.spark, m.external), documents.report_returns(m.spark, f"{m.external}/report")
    found = store.factor_status(factors, m.spark).withColumn("report_available", F.lit(tested is not None))
    ready = studies.readiness(tested, factors, "ret_sub").select(c("ready").alias("factor_regression_ready"), c("reason").alias("regression_reason"), c("n").alias("n_obs"))
    checked = status.verification(m.actions, m.wanted.where("ord <= 25").groupBy("universe_id").agg(F.count("*").alias("tickers")), F.lit("1995-01-01").cast("date"), F.lit("2001-09-01").cast("date"))
    rows = checked.select("universe_id", "coverage_ratio", "covered", (c("total") > 0).alias("actions_data_ready"), c("verified").alias("adjusted_verification_ready"), "reason_code").crossJoin(found).crossJoin(ready)  # one row each
    return status.roll_up(rows.join(m.cache().select("universe_id", "signal_ready"), "universe_id"))


def _report(m: Market) -> DataFrame:
    paid = m.saved_portfolio.groupBy("universe_id").agg(*[F.sum(x).alias(x) for x in ("commission_cost", "slippage_cost", "borrow_cost")], F.min("date").alias("eval_start"))
    taxed = performance.after_tax(m.saved_portfolio.select(*K, c("net_pre_tax_return").alias("ret")), ["universe_id"]).groupBy("universe_id").agg(F.sum("tax_paid").alias("tax_cost"))
    params = {"signal": "momentum", "window_l": LENGTH, "commission_bps_per_side": 5, "slippage_bps_per_side": 5, "allow_short": True, "tax_model": "annual_net"}
    tested = report.backtest(m.performance(), paid.join(taxed, "universe_id"), _verdict(m), params)
    entries = m.traded.withColumns({"signal_date": c("date").cast("string"), "exec_date": c("execution_date").cast("string")}).join(daily.tickers(m.plan), K, "left")
    none = F.array().cast("array<string>")
    entries = daily.history(entries.withColumns({x: F.coalesce(x, none) for x in ("long_tickers", "short_tickers")}))
    shadow = daily.shadow_decisions(m.run_decisions, ACTIVE)
    rows = report.daily_report(m.traded.drop("regime_warning"), m.plan, m.run_contexts, shadow, tested, entries, F.lit("1970-01-01T00:00:00+00:00"), ACTIVE)
    return documents.report_documents(rows, keys=("universe_id",))


def _report_set(m: Market) -> DataFrame:
    """Five tables of one run, read back from the files that the manifest names."""
    days, bounds = m.period_days, m.save(m.bounds, "bounds")
    summary = m.save(scenarios.summaries(days, bounds), "summary")
    tables = {
        "daily": m.period_table, "monthly": scenarios.aggregates(days, F.date_format("date", "yyyy-MM"), "year_month"), "yearly": scenarios.aggregates(days, F.year("date").cast("long"), "year"),
        "summary": summary, "vs_baseline": scenarios.baseline_deltas(summary),
    }
    made = documents.ReportSet(m.spark, f"{m.save.root}/reports").publish(tables, "run-1")
    return made.select("table", "period_label", "rows")


def _legacy(m: Market) -> DataFrame:
    """The last signal from a joint matrix without the share of present tickers and with filled gaps: for every pair of lag
    and lead ticker its weight and the lead's return, and the lag ticker's signal."""
    rows = m.save(returns.joint(m.rets, 0.0, "rolling_mean"), "legacy-joint")
    weights = signals.subspace_signals(rows, m.names, LENGTH, matrix=True)
    last = weights.groupBy("universe_id").agg(F.max("date").alias("date"))
    weights = weights.join(F.broadcast(last), K)  # a row a universe
    signal = signals.subspace_signals(rows, m.names, LENGTH).join(F.broadcast(last), K)
    lead = rows.where("side = 'lead'").select(*K, c("ticker").alias("lead"), c("ret").alias("lead_return"))
    return weights.join(lead, [*K, "lead"]).join(signal, [*K, "ticker"]).select(*K, "ticker", "lead", "weight", "lead_return", "signal")


def _spread_days(m: Market) -> DataFrame:
    sides = m.contexts[0].groupBy(*K).agg(F.avg(F.when(c("cand_long") & (c("signal") >= 0), c("next_oc"))).alias("l"), F.avg(F.when(c("cand_short") & (c("signal") <= 0), c("next_oc"))).alias("s"))
    rows = m.portfolio.select(*K, c("net_pre_tax_return").alias("ret")).join(m.stats.select(*K, "trade_strength"), K).join(sides, K)
    return rows.select(*K, "trade_strength", "ret", F.coalesce("l", F.lit(0.0)).alias("long_contrib"), F.coalesce(-c("s"), F.lit(0.0)).alias("short_contrib"))


def _backtest_days(m: Market) -> DataFrame:
    """The backtest of the day grain: performance of the subspace, plain and momentum signals, both eigen signals from one
    pass over the joint matrix."""
    eigen = m.save(signals.subspace_grid(m.joint, m.names, (m.length,), (0.0, 0.9), pretrain=m.pretrain), "eigen")
    kinds = eigen.select(*K, F.when(c("lambda") > 0, "subspace").otherwise("plain").alias("signal_id"), "ticker", "signal").unionByName(m.signal.select(*K, F.lit("momentum").alias("signal_id"), "ticker", "signal"))
    days = m.save(portfolio.portfolio(kinds, m.rets, params=("signal_id",)), "days")
    taxed = performance.after_tax(days.select("universe_id", "signal_id", "date", c("net_pre_tax_return").alias("ret"), "gross_return"), ["universe_id", "signal_id"])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("set_name"), c(v).alias("ret")) for n, v in (("gross", "gross_return"), ("net_pre_tax", "ret"), ("net_after_tax", "net_after_tax"))]))
    sets = taxed.select("universe_id", "signal_id", "date", each.alias("s")).select("universe_id", "signal_id", "date", "s.*")
    return performance.performance(sets, ["universe_id", "signal_id", "set_name"], m.per_year)


def _run_days(m: Market) -> DataFrame:
    """The daily run of the last signal date of the day grain: its gate, what is held after the rule, and its verdict."""
    return m.traded.withColumn("r", F.dense_rank().over(Window.partitionBy("universe_id").orderBy(F.desc("date")))).where("r = 1").select(*K, "execution_date", "source", "tradeable", "block_reason", "no_trade", "n_long", "n_short", "freshness_ok", "dates_aligned").join(_verdict(m).select("universe_id", "overall_score", "overall_decision"), "universe_id")


SPREADS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.1)
THRESHOLDS = (("fixed_10", 0.1), ("fixed_08", 0.08), ("fixed_02", 0.02), ("adaptive", None))
LOOKS = {"6m": 6, "1y": 12, "2y": 24, "3y": 36, "5y": 60, "full": 100_000}


QUERIES: dict[str, Query] = {
    "panel_prices": Query(lambda m: m.panel, "SELECT * FROM panel", ("open", "close")),
    "price_date_range": Query(lambda m: store.date_range(m.panel), "SELECT universe_id, ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM panel WHERE close IS NOT NULL GROUP BY ALL", (), ("first_date", "last_date")),
    "ret_cc_pad": _one_return("ret_cc"), "ret_cc_nopad": _one_return("ret_cc_nopad", "lead"), "ret_oc": _one_return("ret_oc"), "gap_prev_close": _one_return("gap"), "gap_next_open": _one_return("next_gap"),
    "ret_next_oc": _one_return("next_oc"), "ret_next_cc": _one_return("next_cc"), "ret_oo": _one_return("ret_oo"), "ret_1d_hold": _one_return("ret_hold"),
    "joint_strict": Query(lambda m: m.joint, "SELECT * FROM joint_strict", ("ret",)),
    "joint_rolling_fill": Query(lambda m: returns.joint(m.rets, fill="rolling_mean"), "SELECT * FROM joint_fill", ("ret",)),
    "joint_quality": Query(lambda m: returns.joint_quality(m.rets), """
      SELECT 'all' AS universe_id, (SELECT count(*) FROM t WHERE side = 'lead' AND n > 0) AS usable_lead, (SELECT count(*) FROM t WHERE side = 'lag' AND n > 0) AS usable_lag, (SELECT count(*) FROM t WHERE n = 0) AS dropped,
        (SELECT count(DISTINCT date) FROM covered) AS covered_dates, (SELECT count(*) FROM covered c JOIN filled f USING (date, ticker) WHERE c.ret IS NULL AND f.ret IS NOT NULL) AS filled_cells,
        (SELECT count(DISTINCT date) FROM joint_strict) AS joint_rows, (SELECT min(date) FROM joint_strict) AS first_date, (SELECT max(date) FROM joint_strict) AS last_date FROM (SELECT 1), (SELECT 1) WHERE true""".replace(" FROM t ", " FROM (SELECT side, ticker, count(ret) AS n FROM covered GROUP BY ALL) "), (), ("first_date", "last_date")),
    "corr_pretrain": Query(lambda m: returns.correlations(m.joint), "SELECT a.universe_id, a.ord AS i, b.ord AS j, corr(a.ret, b.ret) AS corr, count(*) AS n FROM joint_strict a JOIN joint_strict b ON a.date = b.date AND a.ord < b.ord GROUP BY ALL", ("corr",), ()),
    "rolling_zscore": Query(lambda m: returns.rolling_zscore(m.joint, LENGTH), """
      SELECT universe_id, date, ticker, ord, side, (ret - mu) / (sd + 1e-10) AS z FROM (SELECT *, count(ret) OVER w AS n, avg(ret) OVER w AS mu, stddev_pop(ret) OVER w AS sd FROM joint_strict
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12""", ("z",)),
    "rolling_corr_pairs": Query(lambda m: returns.rolling_correlations(m.joint, LENGTH), """
      SELECT universe_id, date, i, j, r AS corr FROM (SELECT a.universe_id, a.date, a.ord AS i, b.ord AS j, corr(a.ret, b.ret) OVER w AS r, count(*) OVER w AS n FROM joint_strict a JOIN joint_strict b ON a.date = b.date AND a.ord < b.ord
      WINDOW w AS (PARTITION BY a.ord, b.ord ORDER BY a.date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12""", ("corr",)),
    "signal_momentum": Query(lambda m: m.signal, "SELECT * FROM signal", ("signal",)),
    "signal_subspace_pca": Query(lambda m: m.subspace),
    "signal_plain_pca": Query(lambda m: m.eigen(lam=0.0)),
    "propagation_matrix_top": Query(lambda m: m.eigen(matrix=True).withColumn("r", F.row_number().over(Window.partitionBy(*K).orderBy(F.desc(F.abs("weight")), "ticker", "lead"))).where("r <= 10")),
    "rotation_std": Query(lambda m: m.signal.groupBy(*K).agg(F.stddev_samp("signal").alias("rotation_std")), "SELECT universe_id, date, stddev_samp(signal) AS rotation_std FROM signal GROUP BY ALL", ("rotation_std",)),
    "trend_regime": Query(lambda m: m.regime.select(*K, "trend_regime", "cum20_return"), "SELECT universe_id, date, trend_regime, cum20_return FROM regime", ("cum20_return",)),
    "vol_regime": Query(lambda m: m.regime.select(*K, "vol_regime", "vol20"), "SELECT universe_id, date, vol_regime, vol20 FROM regime", ("vol20",)),
    "regime_frame": Query(lambda m: m.regime, "SELECT * FROM regime", ("cum20_return", "vol20", "rotation_std")),
    "regime_warning": Query(lambda m: regime.warnings(m.regime), """
      SELECT universe_id, date, trend_regime = 'downtrend' OR vol_regime = 'high_vol' AS regime_warning, concat_ws('|', CASE WHEN trend_regime = 'downtrend' THEN 'downtrend' END, CASE WHEN vol_regime = 'high_vol' THEN 'high_vol' END,
      CASE WHEN trend_regime = 'downtrend' AND vol_regime = 'high_vol' THEN 'downtrend_high_vol' END) AS reasons FROM regime"""),
    "quantile_masks": Query(lambda m: m.masks.drop("n"), "SELECT * FROM mask_all", ("signal", "lo", "hi")),
    "positions_fixed": Query(lambda m: m.positions.select(*K, "ticker", "position"), "SELECT universe_id, date, ticker, position FROM positions"),
    "positions_adaptive": Query(lambda m: selection.positions(m.masks.join(m.regime.select(*K, "vol_regime"), K), *selection.thresholds(c("vol_regime"), 0.1, -0.1, True)).select(*K, "ticker", "vol_regime", "position"), """
      SELECT universe_id, date, ticker, vol_regime, CASE WHEN cand_short AND signal <= -t THEN 'SHORT' WHEN cand_long AND signal >= t THEN 'LONG' ELSE 'neutral' END AS position
      FROM (SELECT *, CASE vol_regime WHEN 'low_vol' THEN 0.12::DOUBLE WHEN 'mid_vol' THEN 0.10::DOUBLE ELSE 0.06::DOUBLE END AS t FROM mask_all JOIN regime USING (universe_id, date))"""),
    "candidate_stats": Query(lambda m: m.stats, "SELECT * FROM stats", STATS_D),
    "no_trade_class": Query(lambda m: m.stats.join(regime.warnings(m.regime), K).select(*K, selection.no_trade_class(c("adopted_long"), c("adopted_short"), c("long_gap_max"), c("short_gap_max"), c("regime_warning")).alias("no_trade")), """
      SELECT universe_id, date, CASE WHEN adopted_long >= 1 AND adopted_short >= 1 THEN NULL WHEN adopted_long >= 1 OR adopted_short >= 1 THEN 'one_side_only' WHEN (trend_regime = 'downtrend' OR vol_regime = 'high_vol') AND nl AND ns THEN 'regime_blocked' WHEN nl OR ns THEN 'near_miss_threshold' ELSE 'hard_no_signal' END AS no_trade
      FROM (SELECT *, coalesce(long_gap_max > -0.03, false) AS nl, coalesce(short_gap_max > -0.03, false) AS ns FROM stats JOIN regime USING (universe_id, date))"""),
    "strategy_context": Query(lambda m: m.contexts[1].drop("candidate_signal_strength"), "SELECT * EXCLUDE (candidate_signal_strength) FROM context", ("open_gap", "long_gap", "short_gap")),
    **{r: _rule(r) for r in RULES},
    "rule_rolling3": Query(lambda m: m.contexts[1].select(*K, rolling_selector({1997: "rule_13", 1999: "rule_87", 2000: "none"}, F.year("date")).alias("strategy")), """
      SELECT universe_id, date, CASE WHEN year(date) = 2000 THEN 'skip' ELSE strategy END AS strategy FROM decisions WHERE rule_id = CASE year(date) WHEN 1997 THEN 'rule_13' WHEN 1999 THEN 'rule_87' ELSE 'rule_406' END"""),
    **{f"apply_decision_{s}": _decided(s) for s in ("curr_oc", "skip", "long_flip_oc", "short_only_oc", "gap_ovht_oc", "lgap_oc")},
    "portfolio_detail": Query(lambda m: m.portfolio, "SELECT * FROM pf", PF_D),
    "portfolio_no_short": Query(lambda m: portfolio.portfolio(m.signal, m.rets, costs=portfolio.Costs(allow_short=False)).select(*K, "gross_return", "net_pre_tax_return", "n_long", "n_short"), """
      SELECT universe_id, date, l AS gross_return, l - 0.002 AS net_pre_tax_return, n_long, 0::BIGINT AS n_short FROM pf0""", ("gross_return", "net_pre_tax_return")),
    "portfolio_unshortable": Query(lambda m: portfolio.portfolio(m.signal, m.rets, costs=portfolio.Costs(unshortable=("Brand#12", "Brand#20"))).select(*K, "gross_return", "n_long", "n_short"), """
      SELECT universe_id, date, avg(next_oc) FILTER (cand_long AND signal >= 0) - coalesce(avg(next_oc) FILTER (cand_short AND signal <= 0 AND ticker NOT IN ('Brand#12', 'Brand#20')), 0) AS gross_return, count(*) FILTER (cand_long AND signal >= 0) AS n_long,
      count(*) FILTER (cand_short AND signal <= 0 AND ticker NOT IN ('Brand#12', 'Brand#20')) AS n_short FROM mask GROUP BY ALL HAVING count(*) FILTER (cand_long AND signal >= 0) > 0""", ("gross_return",)),
    "portfolio_both_legs": Query(lambda m: portfolio.portfolio(m.signal, m.rets, require_short=True), "SELECT * FROM pf WHERE n_short > 0", PF_D),
    **{f"portfolio_{r}": _rule_pf(r) for r in RULES},
    "cost_totals": Query(lambda m: m.portfolio.groupBy("universe_id").agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in ("commission_cost", "slippage_cost", "borrow_cost")]), "SELECT universe_id, sum(commission_cost) AS commission_cost, sum(slippage_cost) AS slippage_cost, sum(borrow_cost) AS borrow_cost FROM pf GROUP BY ALL", ("commission_cost", "slippage_cost", "borrow_cost"), ()),
    "equity_drawdown": Query(lambda m: performance.equity(m.sets(), ["universe_id", "set_name"]), "SELECT * FROM equity", ("ret", "equity", "drawdown")),
    "performance": Query(lambda m: m.performance(), "SELECT * FROM perf", ("ar", "risk", "rr", "mdd"), ()),
    "tax_daily_positive": Query(lambda m: performance.after_tax(m.portfolio.select(*K, c("net_pre_tax_return").alias("ret")), ["universe_id"], "daily_positive_only"), "SELECT universe_id, date, ret, greatest(ret, 0) * 0.20315 AS tax_paid, ret - greatest(ret, 0) * 0.20315 AS net_after_tax FROM net", ("ret", "tax_paid", "net_after_tax")),
    "tax_annual_net": Query(lambda m: performance.after_tax(m.portfolio.select(*K, c("net_pre_tax_return").alias("ret")), ["universe_id"]), "SELECT * FROM taxed", ("ret", "tax_paid", "net_after_tax")),
    "tax_yearly_pnl": Query(lambda m: performance.yearly_tax(m.portfolio.select(*K, c("net_pre_tax_return").alias("ret")), ["universe_id"]).select("universe_id", "year", c("pnl").alias("pre_tax"), c("tax").alias("tax_paid"), (c("pnl") - c("tax")).alias("after_tax")), "SELECT universe_id, year::INT AS year, pnl AS pre_tax, tax AS tax_paid, pnl - tax AS after_tax FROM fold", ("pre_tax", "tax_paid", "after_tax"), ()),
    "scenario_returns": Query(lambda m: m.scenarios.where("tradeable").drop("skip_reason"), "SELECT * EXCLUDE (skip_reason) FROM sc WHERE tradeable", ("gross", "long_contrib", "short_contrib")),
    "scenario_skip_reasons": Query(lambda m: m.scenarios.where("not tradeable").select(*K, "scenario_id", "skip_reason", "cand_long", "cand_short"), "SELECT universe_id, date, scenario_id, skip_reason, cand_long, cand_short FROM sc WHERE NOT tradeable"),
    "period_bounds": Query(lambda m: m.bounds, "SELECT * FROM bounds", (), ("start_date", "end_date")),
    "period_daily": Query(lambda m: m.period_days, "SELECT * FROM pd", ("gross_pct", "net_pre_tax_pct", "net_after_tax_pct", "long_pct", "short_pct")),
    "signal_features": Query(lambda m: scenarios.signal_features(m.signal, **LIMITS), """
      SELECT universe_id, date, avg(signal) FILTER (cand_long) - avg(signal) FILTER (cand_short) AS candidate_strength, avg(signal) FILTER (cand_long AND signal >= 0.02) - avg(signal) FILTER (cand_short AND signal <= -0.02) AS adopted_strength FROM mask_all GROUP BY ALL""", ("candidate_strength", "adopted_strength")),
    "jp_features": Query(lambda m: scenarios.lag_features(m.signal, m.rets), """
      SELECT universe_id, date, avg(next_gap) AS gap_mean, avg(next_oc) AS oc_mean, avg(next_cc) AS cc_mean, avg(next_gap) FILTER (cand_long) AS long_gap_mean, avg(next_gap) FILTER (cand_short) AS short_gap_mean, avg(next_oc) - avg(next_gap) AS gap_to_oc_reversal
      FROM mask_all LEFT JOIN rets r USING (universe_id, date, ticker) GROUP BY ALL""", ("gap_mean", "oc_mean", "cc_mean", "long_gap_mean", "short_gap_mean", "gap_to_oc_reversal")),
    "monthly_metrics": Query(lambda m: scenarios.aggregates(m.period_days, F.date_format("date", "yyyy-MM"), "year_month"), _aggregate_sql("strftime(date, '%Y-%m')", "year_month"), AGG_D, ()),
    "yearly_metrics": Query(lambda m: scenarios.aggregates(m.period_days, F.year("date").cast("long"), "year"), _aggregate_sql("year(date)", "year"), AGG_D, (), digits=MEANS),
    "period_summary": Query(lambda m: m.summary, "SELECT * FROM summary", SUM_D, ("start_date", "end_date"), digits=MEANS),
    "baseline_delta": Query(lambda m: scenarios.baseline_deltas(m.summary), f"SELECT s.universe_id, s.period_label, s.scenario_id, {', '.join(f's.{x} - b.{x} AS delta_{x}' for x in DELTAS)} FROM summary s JOIN summary b ON b.period_label = s.period_label AND b.scenario_id = 'S01_CurrOC'", tuple(f"delta_{x}" for x in DELTAS), (), digits=MEANS),
    "max_consecutive": Query(lambda m: performance.longest_runs(m.period_days.select("universe_id", "period_label", "scenario_id", "date", c("gross_pct").alias("ret")), ["universe_id", "period_label", "scenario_id"]), "SELECT * FROM pd_runs", (), ()),
    "cache_freshness": Query(lambda m: store.freshness(m.panel, F.lit("2001-11-01").cast("date")), "SELECT universe_id, ticker, max(date) AS last_date, max(date) < DATE '2001-11-01' AS stale FROM panel WHERE close IS NOT NULL GROUP BY ALL", (), ("last_date",)),
    "cache_sides": Query(lambda m: store.side_summary(m.panel), "SELECT universe_id, side, count(*) AS tickers, min(l) AS oldest_last, max(l) AS newest_last, min(l) = max(l) AS aligned FROM (SELECT universe_id, side, ticker, max(date) AS l FROM panel WHERE close IS NOT NULL GROUP BY ALL) GROUP BY ALL", (), ("oldest_last", "newest_last")),
    "missing_tickers": Query(lambda m: store.missing(m.spark.range(1, 31).select(F.concat(F.lit("Brand#"), "id").alias("ticker")), m.panel), "SELECT 'Brand#' || i AS ticker FROM range(1, 31) t(i) WHERE 'Brand#' || i NOT IN (SELECT ticker FROM panel WHERE close IS NOT NULL)", (), ()),
    "upsert_dedup": Query(_upsert, "SELECT ticker, date, 'raw' AS price_mode, CASE WHEN date >= DATE '2000-01-01' AND open IS NOT NULL THEN open * 2 ELSE open END AS open, CASE WHEN date >= DATE '2000-01-01' AND open IS NOT NULL THEN NULL ELSE close END AS close FROM panel", ("open", "close")),
    "next_session": Query(lambda m: store.next_session(m.panel), "SELECT universe_id, date, (SELECT min(b.date) FROM panel b WHERE b.side = 'lag' AND b.date > a.date) AS next_lag_date FROM (SELECT DISTINCT universe_id, date FROM panel WHERE side = 'lead') a", (), ("date", "next_lag_date")),
    "sign_consistency": Query(lambda m: studies.sign_consistency(m.signal, m.rets), """
      SELECT universe_id, grp, count(*) AS n, avg(CASE WHEN sign(signal) = sign(next_oc) THEN 1.0::DOUBLE ELSE 0 END) AS sign_rate, avg(signal * next_oc) AS mean_product FROM (SELECT *, 'all' AS grp FROM mask UNION ALL SELECT *, 'candidate' FROM mask WHERE cand_long OR cand_short
      UNION ALL SELECT *, 'adopted' FROM mask WHERE cand_long AND signal >= 0 OR cand_short AND signal <= 0) GROUP BY ALL""", ("sign_rate", "mean_product"), ()),
    "gap_decomposition": Query(lambda m: studies.gap_decomposition(m.signal, m.rets), """
      SELECT universe_id, CASE WHEN cand_long THEN 'long' WHEN cand_short THEN 'short' ELSE 'neutral' END AS grp, count(*) AS n, avg(next_gap) AS gap, avg(next_oc) AS oc, avg(next_cc) AS cc FROM mask_all JOIN rets r USING (universe_id, date, ticker) GROUP BY ALL""".replace("avg(next_gap) AS gap", "avg(r.next_gap) AS gap"), ("gap", "oc", "cc"), ()),
    "quintile_map": Query(lambda m: studies.quintile_map(m.lead_features, m.portfolio, "mean", "gross_return"), """
      SELECT universe_id, b::INT AS bucket, count(*) AS n, avg(mean) AS feature_mean, avg(gross_return) AS value_mean FROM (SELECT universe_id, date, mean, gross_return, ntile(5) OVER (ORDER BY mean, date) AS b FROM leadf JOIN pf USING (universe_id, date)) GROUP BY ALL""", ("feature_mean", "value_mean"), ()),
    "tercile_cross": Query(lambda m: studies.tercile_cross(m.lead_features, m.portfolio, "breadth", "sd", "gross_return"), """
      SELECT universe_id, ta::INT AS ta, tb::INT AS tb, count(*) AS n, avg(gross_return) AS value_mean FROM (SELECT universe_id, gross_return, ntile(3) OVER (ORDER BY breadth, date) AS ta, ntile(3) OVER (ORDER BY sd, date) AS tb FROM leadf JOIN pf USING (universe_id, date)) GROUP BY ALL""", ("value_mean",), ()),
    "us_features": Query(lambda m: m.lead_features, "SELECT * FROM leadf", LEAD_D),
    "top3_bottom3": Query(lambda m: m.signal.withColumns({"top": F.row_number().over(Window.partitionBy(*K).orderBy(F.desc("signal"), "ticker")), "bottom": F.row_number().over(Window.partitionBy(*K).orderBy("signal", "ticker"))}).where("top <= 3 or bottom <= 3"), """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, ticker)::INT AS top, row_number() OVER (PARTITION BY date ORDER BY signal, ticker)::INT AS bottom FROM signal) WHERE top <= 3 OR bottom <= 3""", ("signal",)),
    "position_counts": Query(lambda m: m.positions.groupBy("universe_id", "position").count(), "SELECT universe_id, position, count(*) AS count FROM positions GROUP BY ALL", (), ()),
    "spread_threshold_grid": Query(lambda m: studies.spread_grid(m.stats, m.portfolio, [0.0, 0.05, 0.1, 0.15]), """
      SELECT universe_id, least_spread, coalesce(sum(n) FILTER (t), 0)::BIGINT AS traded_days, sum(s) FILTER (t) / sum(n) FILTER (t) AS mean_return, coalesce(max(n) FILTER (NOT t), 0) AS longest_skip FROM (SELECT universe_id, least_spread, t, i, count(*) AS n, sum(r) AS s FROM (
      SELECT universe_id, least_spread, t, r, row_number() OVER (PARTITION BY least_spread ORDER BY date) - row_number() OVER (PARTITION BY least_spread, t ORDER BY date) AS i FROM (SELECT universe_id, date, net_pre_tax_return AS r, least_spread, trade_strength >= least_spread AS t
      FROM stats JOIN pf USING (universe_id, date), (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE)) g(least_spread))) GROUP BY ALL) GROUP BY ALL""", ("least_spread", "mean_return"), ()),
    "regime_performance": Query(lambda m: studies.regime_performance(m.portfolio, m.regime, "net_pre_tax_return"), """
      SELECT universe_id, trend_regime, vol_regime, rotation_regime, count(*) AS n, avg(net_pre_tax_return) AS mean, stddev_samp(net_pre_tax_return) AS sd FROM pf JOIN regime USING (universe_id, date)
      GROUP BY GROUPING SETS ((universe_id, trend_regime), (universe_id, vol_regime), (universe_id, rotation_regime), (universe_id, trend_regime, vol_regime))""", ("mean", "sd"), ()),
    "anomaly_days": Query(lambda m: studies.anomaly_days(m.scenarios, 0.05), "SELECT universe_id, date, diff FROM (SELECT universe_id, date, max(gross) FILTER (scenario_id = 'S02_FlipL_OC') - max(gross) FILTER (scenario_id = 'S01_CurrOC') AS diff, row_number() OVER (ORDER BY date DESC) AS b FROM sc GROUP BY universe_id, date) WHERE b <= 252 AND abs(diff) >= 0.05", ("diff",)),
    "ols_single_factor": Query(lambda m: m.portfolio.join(m.lead_features, K).groupBy("universe_id").agg(F.regr_slope("gross_return", "mean").alias("slope"), F.regr_intercept("gross_return", "mean").alias("intercept"), F.regr_r2("gross_return", "mean").alias("r2"), F.regr_count("gross_return", "mean").alias("n")), """
      SELECT universe_id, regr_slope(gross_return, mean) AS slope, regr_intercept(gross_return, mean) AS intercept, regr_r2(gross_return, mean) AS r2, regr_count(gross_return, mean)::BIGINT AS n FROM pf JOIN leadf USING (universe_id, date) GROUP BY ALL""", ("slope", "intercept", "r2"), ()),
    "spearman": Query(lambda m: studies.spearman(m.portfolio.join(m.lead_features, K), ["universe_id"], "gross_return", "breadth"), """
      SELECT universe_id, corr(ra, rb) AS rho, count(*) AS n FROM (SELECT universe_id, rank() OVER (ORDER BY gross_return) + (count(*) OVER (PARTITION BY gross_return) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY breadth) + (count(*) OVER (PARTITION BY breadth) - 1) / 2.0::DOUBLE AS rb FROM pf JOIN leadf USING (universe_id, date)) GROUP BY ALL""", ("rho",), ()),
    "lots_plan": Query(lambda m: m.plan.na.drop(subset=["lots"]).select(*K, "ticker", "position", "sector", "latest_price", "weight_pct", "min_purchase", "lots", "purchase"), "SELECT * EXCLUDE (signal), lots * latest_price AS purchase FROM plan WHERE lots IS NOT NULL", ("weight_pct",)),
    "order_documents": Query(lambda m: daily.order_documents(m.after, m.plan), """
      SELECT universe_id, date, '{"common":{"market":"TKY","price_type":"market","validity":"this_day","skip_estimate":true,"trade_password":""},"orders":[' || coalesce(o, '') || ']}' AS payload FROM (SELECT DISTINCT universe_id, date FROM positions) LEFT JOIN (
      SELECT date, string_agg('{"stock_code":"' || replace(ticker, '.T', '') || '","order_kind":"' || CASE WHEN position = 'LONG' THEN 'genbutsu_buy' ELSE 'shinyo_sell' END || '","quantity":' || coalesce(lots, 1) || CASE WHEN position = 'LONG' THEN '' ELSE ',"payment_limit":"day"' END || ',"nariyuki_condition":"寄成","sor_enabled":false,"note":"'
        || position || ' / ' || sector || ' / ' || coalesce(lots, 1) || '口"}', ',' ORDER BY position, signal DESC, ticker) AS o FROM plan GROUP BY date) USING (date)"""),
    "fetch_plan": Query(lambda m: store.fetch_plan(store.date_range(m.saved_panel), m.wanted.where("ticker not in ('Brand#3', 'Brand#7')").select(F.concat_ws("-", "side", F.when(c("ord") % 2 == 0, "even").otherwise("odd")).alias("group"), "ticker").unionByName(m.wanted.where("ord <= 5").select(F.lit("first five").alias("group"), "ticker")), "1995-01-01"), """
      SELECT g AS "group", count(*) AS tickers, CASE WHEN count(l) = count(*) AND min(f) <= DATE '1995-01-01' THEN greatest(min(l) - 7, DATE '1995-01-01') ELSE DATE '1995-01-01' END AS from_date FROM (
        SELECT CASE WHEN i <= 11 THEN 'lead' ELSE 'lag' END || '-' || CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS g, 'Brand#' || i AS ticker FROM range(1, 27) t(i) WHERE i NOT IN (3, 7) UNION ALL SELECT 'first five', 'Brand#' || i FROM range(1, 6) t(i))
      LEFT JOIN (SELECT ticker, min(date) AS f, max(date) AS l FROM panel WHERE close IS NOT NULL GROUP BY ticker) USING (ticker) GROUP BY g""", (), ("from_date",)),
    "tradeability": Query(lambda m: m.traded.select(*K, "execution_date", "source", "tradeable", "block_reason", "no_trade", "n_long", "n_short", "trade_strength"), "SELECT universe_id, date, execution_date, source, tradeable, block_reason, no_trade, n_long, n_short, strength AS trade_strength FROM traded", ("trade_strength",), ("date", "execution_date")),
    "tradeability_settings": Query(_gates, gates_sql(GATES)),
    "calendar_sources": Query(lambda m: m.runs.withColumn("horizon", F.coalesce("horizon", F.lit(0))), "SELECT * REPLACE (coalesce(horizon, 0) AS horizon) FROM runs", (), ("date", "execution_date")),
    "freshness_daily": Query(lambda m: m.known.withColumns({x: F.array_join(x, "|") for x in ("missing", "stale")}), "SELECT * FROM known", (), ("date", "lead_min", "lead_max", "lag_min", "lag_max")),
    "gaps_as_of": Query(lambda m: m.run_gaps, "SELECT * FROM run_gaps", ("gap",), ("date", "gap_date")),
    "strategy_context_daily": Query(lambda m: m.run_contexts, "SELECT * FROM run_context", ("open_gap", "long_gap", "short_gap", "candidate_signal_strength")),
    "daily_positions": Query(lambda m: m.after.select(*K, "ticker", "signal", "strategy", "position_before", "position"), "SELECT universe_id, date, ticker, signal, strategy, before AS position_before, position FROM after_rule", ("signal",)),
    "shadow_decisions": Query(lambda m: daily.shadow_decisions(m.run_decisions, ACTIVE).select(*K, "active_strategy", F.array_join(F.transform(F.map_entries("shadow"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("shadow")), """
      SELECT universe_id, date, max(strategy) FILTER (rule_id = 'rule_406_no_flip') AS active_strategy, string_agg(rule_id || '=' || strategy, '|' ORDER BY rule_id) FILTER (rule_id <> 'rule_406_no_flip') AS shadow FROM run_decisions GROUP BY ALL"""),
    "gap_pick": Query(lambda m: daily.pick_gaps(m.rets.where("side = 'lag'"), m.saved_panel.select("universe_id").distinct().select("universe_id", F.explode(F.array(*[F.lit(x).cast("date") for x in ("1997-05-01", "1997-05-02")])).alias("execution_date"))), """
      SELECT universe_id, DATE '1997-05-01' AS execution_date, date, ticker, gap FROM rets WHERE side = 'lag' AND date = DATE '1997-05-01' UNION ALL
      SELECT universe_id, DATE '1997-05-02', date, ticker, gap FROM rets WHERE side = 'lag' AND date = (SELECT max(date) FROM rets WHERE side = 'lag')
      UNION ALL SELECT universe_id, DATE '1997-05-01', date, ticker, gap FROM rets WHERE side = 'lag' AND date = (SELECT max(date) FROM rets WHERE side = 'lag') AND NOT EXISTS (FROM rets WHERE side = 'lag' AND date = DATE '1997-05-01')""", ("gap",), ("date", "execution_date")),
    "execution_checks": Query(_checks, """
      SELECT universe_id, date, n::INT AS n, level, message FROM (SELECT universe_id, date, unnest(range(0, 7)) AS n,
        unnest([CASE WHEN freshness_ok THEN 'ok' ELSE 'warn' END, 'ok', 'ok', 'ok', CASE WHEN n_short = 0 THEN 'ok' ELSE 'warn' END, 'ok', CASE WHEN trend_regime = 'downtrend' OR vol_regime = 'high_vol' THEN 'warn' END]) AS level,
        unnest(['data freshness: ' || CASE WHEN freshness_ok THEN 'OK' ELSE 'Warning' END || ' (lead=' || lead_max || ', lag=' || lag_max || ')', 'fill policy: strict / filled cells=' || (SELECT count(*) FROM covered c JOIN filled f USING (date, ticker) WHERE c.ret IS NULL AND f.ret IS NOT NULL),
          'long/short: ' || n_long || ' / ' || n_short || ' (candidates: ' || candidate_long || ' / ' || candidate_short || ')', 'thresholds: long>=0.0, short<=0.0', 'shorts need margin or borrowed stock', 'price mode: raw', 'regime: ' || trend_regime || ' x ' || vol_regime]) AS message
        FROM stats JOIN run_context USING (universe_id, date) JOIN known USING (universe_id, date) JOIN traded USING (universe_id, date)) WHERE level IS NOT NULL"""),
    "cache_summary": Query(lambda m: m.cache().withColumns({x: F.array_join(x, "|") for x in ("missing", "stale")}), "SELECT *, coalesce(lead_min = lead_max, false) AND coalesce(lag_min = lag_max, false) AS aligned, missing = '' AND stale = '' AND coalesce(lead_min = lead_max, false) AND coalesce(lag_min = lag_max, false) AS signal_ready FROM cache", (), ("lead_min", "lead_max", "lag_min", "lag_max")),
    "cache_summary_late": Query(lambda m: m.cache("2099-01-01", 26).select("universe_id", "aligned", "signal_ready", F.size("missing").alias("missing"), F.size("stale").alias("stale")), """
      SELECT 'all' AS universe_id, coalesce(min(last) FILTER (side = 'lead') = max(last) FILTER (side = 'lead'), false) AND coalesce(min(last) FILTER (side = 'lag') = max(last) FILTER (side = 'lag'), false) AS aligned, false AS signal_ready, (count(*) FILTER (last IS NULL) + 1)::INT AS missing, count(last)::INT AS stale FROM tracked""", (), ()),
    "freshness_report": Query(lambda m: status.freshness(m.cache()).withColumns({x: F.array_join(x, "|") for x in ("missing", "stale")}), "SELECT universe_id, fresh AS freshness_ok, f.lead_max AS latest_lead, f.lag_max AS latest_lag, stale, missing FROM flags f JOIN cache USING (universe_id)", (), ("latest_lead", "latest_lag")),
    "corporate_actions": Query(lambda m: m.actions, "SELECT * FROM actions", ("value",)),
    "action_tables": Query(lambda m: store.action_tables(m.actions, m.actions.where("action_type = 'split' or value > 400").withColumn("source", F.lit("again"))), "SELECT universe_id, action_type || 's' AS \"table\", ticker, date, value FROM actions", ("value",)),
    "actions_verification": Query(lambda m: status.verification(m.actions, m.wanted.where("ord <= 25").groupBy("universe_id").agg(F.count("*").alias("tickers")), F.lit("1995-01-01").cast("date"), F.lit("2001-09-01").cast("date")), "SELECT *, reason_code = 'ok' AS verified FROM verified", ("coverage_ratio",), ("actions_start", "actions_end")),
    "data_status": Query(_readiness, status_sql(False), ("coverage_ratio",), ("factor_start", "factor_end")),
    "data_status_published": Query(lambda m: _readiness(m, True), status_sql(True), ("coverage_ratio",), ("factor_start", "factor_end")),
    "daily_reports": Query(_report, report_sql(VERDICT_SQL)),
    "report_set": Query(_report_set, REPORT_SET, (), ()),
    "period_table": Query(lambda m: m.period_table, PERIOD_TABLE, PERIOD_D, ("date",)),
    "quality_records": Query(lambda m: returns.quality_records(m.rets, m.store_rows).withColumns({x: F.array_join(x, "|") for x in ("dropped_lead", "dropped_lag")}), QUALITY, (), ("sample_start", "sample_end", "effective_start", "effective_end", "cache_first_date", "cache_last_date")),
    "effective_windows": Query(lambda m: returns.effective_windows(m.joint, m.saved_panel.where("side = 'lag'"), LENGTH), """
      SELECT universe_id, date, n AS joint_rows, least(n, 12)::BIGINT AS effective_window_days FROM (SELECT universe_id, date, (SELECT count(DISTINCT j.date) FROM joint_strict j WHERE j.date <= d.date) AS n FROM (SELECT DISTINCT universe_id, date FROM panel WHERE side = 'lag') d)"""),
    "spread_study": Query(lambda m: studies.spread_study(_spread_days(m), SPREADS), spread_sql(SPREADS), ("least_spread", "pass_rate", "traded_mean", "all_mean", "traded_win_rate", "all_win_rate", "compound", "traded_long", "traded_short", "all_long", "all_short", "mdd"), ()),
    "spread_bands": Query(lambda m: studies.spread_bands(_spread_days(m), SPREADS), f"""
      SELECT universe_id, low, high, count(*) AS days, avg(ret) AS mean, avg((ret > 0)::INT) AS win_rate FROM ({SPREAD_DAYS}) JOIN (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in zip(SPREADS, (*SPREADS[1:], "NULL")))}) g(low, high) ON strength >= low AND (high IS NULL OR strength < high) GROUP BY ALL""", ("low", "high", "mean", "win_rate"), ()),
    "threshold_comparison": Query(lambda m: studies.threshold_comparison(m.contexts[0], m.regime, THRESHOLDS, (selection.ADAPTIVE_LONG, selection.ADAPTIVE_SHORT), 12), threshold_sql(THRESHOLDS), ("tradeable_rate", "no_long_rate", "gross_ar", "gross_rr", "gross_mdd", "net_ar", "net_rr", "net_mdd"), ()),
    "flip_study": Query(lambda m: studies.flip_study(selection.quantile_masks(m.signal).join(m.rets.select(*K, "ticker", "next_oc", "next_cc"), [*K, "ticker"], "left"), LOOKS, {"oc": "next_oc", "cc": "next_cc"}), flip_sql(LOOKS), ("mean", "win_rate", "compound", "long_mean", "short_mean", "mdd"), ()),
    "annual_regression": Query(lambda m: studies.annual_regression(m.portfolio.select(*K, "gross_return"), m.factors, "gross_return", per_year=12).withColumns({x: F.to_json(x) for x in ("betas", "t_stats")}).drop("betas", "t_stats")),
    "panel_days": Query(lambda m: m.panel, "SELECT * FROM panel", ("open", "close"), grain="day"),
    "portfolio_days": Query(lambda m: m.portfolio, "SELECT * FROM pf", PF_D, grain="day"),
    "performance_days": Query(lambda m: m.performance(), "SELECT * FROM perf", ("ar", "risk", "rr", "mdd"), (), grain="day"),
    "rule_portfolio_days": Query(lambda m: m.rule_portfolio, f"SELECT universe_id, date, rule_id, strategy_decision, {PF} FROM rule_pf", PF_D, grain="day"),
    "backtest_days": Query(_backtest_days, grain="day"),
    "daily_run_days": Query(_run_days, grain="day"),
    "legacy_signal": Query(_legacy),
    "parameter_grid_pca": Query(_eigen_grid),
    "window_sensitivity_pca": Query(_eigen_windows),
    "judge_scores": Query(lambda m: _verdict(m).select("universe_id", *SCORES, "overall_decision", "reasons"), VERDICT_SQL, (), ()),
    "judge_universes": Query(lambda m: _verdict(m).select("universe_id", *SCORES, "overall_decision", "reasons"), VERDICT_SQL, (), (), "l_returnflag"),
    "portfolio_universes": Query(lambda m: m.portfolio, "SELECT * FROM pf", PF_D, ("date",), "l_returnflag"),
    "regime_universes": Query(lambda m: m.regime, "SELECT * FROM regime", ("cum20_return", "vol20", "rotation_std"), ("date",), "l_returnflag"),
    "rule_portfolio_universes": Query(lambda m: m.rule_portfolio, f"SELECT universe_id, date, rule_id, strategy_decision, {PF} FROM rule_pf", PF_D, ("date",), "l_returnflag"),
    "regime_snapshots": Query(lambda m: regime.snapshots(m.regime, m.saved_panel.select("universe_id").distinct().select("universe_id", F.explode(F.array(*[F.lit(x).cast("date") for x in ("1998-03-01", "2031-01-01")])).alias("date"))), """
      SELECT 'all' AS universe_id, d AS date, coalesce(trend_regime, 'sideways') AS trend_regime, coalesce(vol_regime, 'mid_vol') AS vol_regime, coalesce(rotation_regime, 'mid_rotation') AS rotation_regime FROM (VALUES (DATE '1998-03-01'), (DATE '2031-01-01')) t(d) LEFT JOIN regime ON date = d"""),
    "joint_uncovered_fill": Query(lambda m: returns.joint(m.rets, 0.0, "rolling_mean"), """
      SELECT * FROM (SELECT universe_id, date, ticker, ord, side, coalesce(ret_cc, avg(ret_cc) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS ret FROM rets WHERE date IN (SELECT date FROM rets GROUP BY date HAVING count(DISTINCT side) = 2))
      WHERE date NOT IN (SELECT date FROM (SELECT date, coalesce(ret_cc, avg(ret_cc) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS r FROM rets WHERE date IN (SELECT date FROM rets GROUP BY date HAVING count(DISTINCT side) = 2)) WHERE r IS NULL)""", ("ret",)),
    "daily_log": Query(lambda m: _log(m).drop("created_at", "min_signal_spread_used", "min_long_signal_used", "max_short_signal_used", "min_adopted_long_count_used", "min_adopted_short_count_used", "long_contribution_pct", "short_contribution_pct", "total_return_pct"), """
      SELECT CAST(date AS VARCHAR) AS signal_reference_us_date, CAST(execution_date AS VARCHAR) AS execution_target_jp_date, source AS execution_target_jp_date_source, 'production' AS operation_mode, round(strength, 6) AS trade_signal_strength, tradeable, block_reason AS trade_block_reason,
        candidate_long AS candidate_long_count, candidate_short AS candidate_short_count, n_long AS adopted_long_count, n_short AS adopted_short_count, freshness_ok, dates_aligned AS latest_dates_aligned, usable_lead AS usable_us_tickers, usable_lag AS usable_jp_tickers,
        n_long::INT AS n_long, n_short::INT AS n_short, coalesce(replace(replace(longs, '"', ''), ',', '|'), '') AS long_tickers, coalesce(replace(replace(shorts, '"', ''), ',', '|'), '') AS short_tickers, '[]' AS details_json, trend_regime, vol_regime, rotation_regime,
        trend_regime = 'downtrend' OR vol_regime = 'high_vol' AS regime_warning, '[' || concat_ws(', ', CASE WHEN trend_regime = 'downtrend' THEN '"downtrend"' END, CASE WHEN vol_regime = 'high_vol' THEN '"high_vol"' END, CASE WHEN trend_regime = 'downtrend' AND vol_regime = 'high_vol' THEN '"downtrend_high_vol"' END) || ']' AS regime_warning_reason,
        round(candidate_strength, 6) AS candidate_signal_strength, round(trade_strength, 6) AS adopted_signal_strength, long_gap_max AS threshold_gap_long_max, short_gap_max AS threshold_gap_short_max, class_after AS no_trade_classification
      FROM traded JOIN stats USING (universe_id, date) JOIN known USING (universe_id, date) JOIN (SELECT universe_id, date, trend_regime, vol_regime, rotation_regime FROM run_context) USING (universe_id, date) LEFT JOIN held USING (date)""",
      ("trade_signal_strength", "candidate_signal_strength", "adopted_signal_strength", "threshold_gap_long_max", "threshold_gap_short_max"), ()),
    "history_entries": Query(_history, """
      SELECT universe_id, date, '{"signalDate":"' || date || '","execJpDate":' || coalesce('"' || execution_date || '"', 'null') || ',"tradeable":' || tradeable || ',"longTickers":[' || coalesce(longs, '') || '],"shortTickers":[' || coalesce(shorts, '') || ']}' AS dedupe_key, '2026-08-21' AS cached_date, '2026/08/21 06:30:00' AS recorded_at,
        source AS exec_source, tradeable, block_reason, n_long, n_short, freshness_ok, dates_aligned, usable_lead, usable_lag, no_trade, 'rule_406_no_flip' AS rule_id, strategy AS selected_strategy, CASE strategy WHEN 'skip' THEN 'skip' ELSE 'execute' END AS action
      FROM traded JOIN known USING (universe_id, date) LEFT JOIN held USING (date)"""),
    "store_tail": Query(lambda m: store.tail(m.panel, ["Brand#3", "Brand#20", "Brand#99"], "2001-06-01"), "SELECT ticker, date, open, close FROM panel WHERE ticker IN ('Brand#3', 'Brand#20') AND date >= DATE '2001-06-01'", ("open", "close")),
    "business_days": Query(lambda m: store.weekday_calendar(m.spark, "1999-12-20", "2000-01-10", ["1999-12-31", "2000-01-03"]), "SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1999-12-20', DATE '2000-01-10', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '1999-12-31', DATE '2000-01-03')"),
    "long_details": Query(lambda m: documents.last_closes(m.saved_panel, m.positions), """
      SELECT universe_id, date, ticker, close, previous, (close / previous - 1) * 100 AS change_pct, date + 1 AS execution_date FROM positions JOIN (SELECT universe_id, date, ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS previous FROM panel WHERE close IS NOT NULL) USING (universe_id, date, ticker) WHERE position = 'LONG'""", ("close", "previous", "change_pct"), ("date", "execution_date")),
    "sector_spreads": Query(lambda m: studies.spreads(m.rets, m.signal, m.names), """
      SELECT universe_id, date, lead_spread, lag_spread, coalesce((lead_spread > 0) = (lag_spread > 0), false) AS agree FROM (SELECT universe_id, date, avg(ret_cc) FILTER (cyc = 1) - avg(ret_cc) FILTER (cyc = -1) AS lead_spread FROM rets WHERE side = 'lead' GROUP BY ALL)
      JOIN (SELECT universe_id, date, avg(signal) FILTER (CAST(regexp_extract(ticker, '(\\d+)$', 1) AS INTEGER) % 3 = 2) - avg(signal) FILTER (CAST(regexp_extract(ticker, '(\\d+)$', 1) AS INTEGER) % 3 = 0) AS lag_spread FROM signal GROUP BY ALL) USING (universe_id, date)""", ("lead_spread", "lag_spread")),
    "rolling_flip_difference": Query(lambda m: studies.rolling_difference(m.scenarios, "S01_CurrOC", "S02_FlipL_OC"), """
      SELECT *, avg(diff) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling FROM (SELECT universe_id, date, max(gross) FILTER (scenario_id = 'S02_FlipL_OC') - max(gross) FILTER (scenario_id = 'S01_CurrOC') AS diff FROM sc GROUP BY ALL)""", ("diff", "rolling")),
    "quarterly_metrics": Query(lambda m: scenarios.aggregates(m.period_days, F.concat_ws("-Q", F.year("date"), F.quarter("date")), "quarter"), _aggregate_sql("year(date) || '-Q' || quarter(date)", "quarter"), AGG_D, (), digits=MEANS),
    "best_scenario": Query(lambda m: studies.best_scenarios(m.scenarios), "SELECT universe_id, date, scenario_id, gross FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY gross DESC, scenario_id) AS r FROM sc WHERE tradeable) WHERE r = 1", ("gross",)),
    "worst_days": Query(lambda m: studies.worst_days(m.lead_features, m.portfolio, "gross_return", ("mean", "sd", "breadth", "narrowness")), """
      SELECT universe_id, share, count(*) AS n, avg(gross_return) AS value_mean, avg(mean) AS mean, avg(sd) AS sd, avg(breadth) AS breadth, avg(narrowness) AS narrowness FROM (SELECT *, percent_rank() OVER (ORDER BY gross_return, date) AS place FROM leadf JOIN pf USING (universe_id, date)), (VALUES (1.0::DOUBLE), (0.2::DOUBLE), (0.1::DOUBLE)) s(share)
      WHERE place <= share GROUP BY ALL""", ("share", "value_mean", "mean", "sd", "breadth", "narrowness"), ()),
    "signal_scale": Query(lambda m: studies.signal_scale(selection.positions(m.masks, 0.02, -0.02), _adaptive(m), m.regime), """
      SELECT universe_id, trend_regime, vol_regime, count(*) AS days, avg(abs_mean) AS abs_mean, avg(median) AS median, avg(top1) AS top1, avg(fixed) AS fixed_rate, avg(adaptive) AS adaptive_rate, 1 - avg(has_long) AS no_long_rate FROM (
        SELECT universe_id, date, avg(abs(signal)) AS abs_mean, quantile_cont(signal, 0.5::DOUBLE) AS median, max(signal) AS top1, max((cand_long AND signal >= 0.02 AND NOT (cand_short AND signal <= -0.02))::INT) AS has_long, max((cand_long AND signal >= 0.02)::INT) * max((cand_short AND signal <= -0.02)::INT) AS fixed,
          max((cand_long AND signal >= t)::INT) * max((cand_short AND signal <= -t)::INT) AS adaptive, trend_regime, vol_regime FROM (SELECT *, CASE vol_regime WHEN 'low_vol' THEN 0.12::DOUBLE WHEN 'mid_vol' THEN 0.10::DOUBLE ELSE 0.06::DOUBLE END AS t FROM mask_all JOIN regime USING (universe_id, date)) GROUP BY universe_id, date, trend_regime, vol_regime)
      GROUP BY GROUPING SETS ((universe_id, vol_regime), (universe_id, trend_regime), (universe_id, trend_regime, vol_regime))""", ("abs_mean", "median", "top1", "fixed_rate", "adaptive_rate", "no_long_rate"), ()),
    "position_filter_grid": Query(lambda m: studies.position_filters(m.contexts[0]), """
      SELECT a.*, longest_loss, longest_skip FROM (SELECT universe_id, setting, avg(nl) AS long_count, avg(ns) AS short_count, avg(ret) FILTER (traded) AS traded_mean, avg(CASE WHEN traded THEN ret ELSE 0 END) AS all_mean, avg((ret > 0)::INT) FILTER (traded) AS win_rate, product(1 + CASE WHEN traded THEN ret ELSE 0 END) - 1 AS compound,
        avg(coalesce(lr, 0)) FILTER (traded) AS long_mean, avg(-coalesce(sr, 0)) FILTER (traded) AS short_mean FROM filter_days GROUP BY ALL) a JOIN (SELECT universe_id, setting, coalesce(max(n) FILTER (kind = 'loss'), 0) AS longest_loss, coalesce(max(n) FILTER (kind = 'skip'), 0) AS longest_skip FROM (
        SELECT universe_id, setting, kind, i, count(*) AS n FROM (SELECT universe_id, setting, kind, row_number() OVER (PARTITION BY setting ORDER BY date) - row_number() OVER (PARTITION BY setting, kind ORDER BY date) AS i FROM filter_days) GROUP BY ALL) GROUP BY ALL) USING (universe_id, setting)""".replace("filter_days", """(
        SELECT *, CASE WHEN NOT traded THEN 'skip' WHEN ret > 0 THEN 'win' ELSE 'loss' END AS kind FROM (SELECT *, nl > 0 AND coalesce(strength, 0) >= least AS traded, coalesce(lr, 0) - coalesce(sr, 0) AS ret FROM (
          SELECT universe_id, date, setting, least, count(*) FILTER (l) AS nl, count(*) FILTER (s) AS ns, avg(next_oc) FILTER (l) AS lr, avg(next_oc) FILTER (s) AS sr, avg(signal) FILTER (l) - avg(signal) FILTER (s) AS strength FROM (
            SELECT *, cand_long AND signal >= lo2 AS l, cand_short AND signal <= hi2 AS s FROM mask, (VALUES ('base', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('spread', 0.0951, 0.0, 0.0), ('var_a', 0.0, 0.05, -0.05), ('var_b', 0.0, 0.1, -0.1), ('both_a', 0.0951, 0.05, -0.05), ('both_b', 0.0951, 0.1, -0.1)) g(setting, least, lo2, hi2)) GROUP BY ALL)))"""),
      ("long_count", "short_count", "traded_mean", "all_mean", "win_rate", "compound", "long_mean", "short_mean"), ()),
    "recovery_scenarios": Query(lambda m: scenarios.limited(scenarios.scenario_returns(m.signal, m.rets, **LIMITS, scenarios=scenarios.RECOVERY), m.regime, m.strength, high=0.05).select(*K, "scenario_id", "gross", "tradeable", "adopt_long", "adopt_short"), f"""
      WITH {scenario_chain("recovery", "rec")} SELECT universe_id, date, scenario_id, gross, tradeable, adopt_long, adopt_short FROM rec_sc LEFT JOIN (SELECT date, vol_regime FROM regime) USING (date) LEFT JOIN (SELECT date, avg(signal) FILTER (cand_long) - avg(signal) FILTER (cand_short) AS strength FROM mask_all GROUP BY date) USING (date)
      WHERE CASE WHEN scenario_id IN ('S12_HighVol', 'S14_FlipL_HiVol') THEN vol_regime = 'high_vol' WHEN scenario_id = 'S13_NoMidVol' THEN vol_regime <> 'mid_vol' WHEN scenario_id = 'S15_HighSig' THEN strength >= 0.05 ELSE true END""", ("gross",)),
    "scenario_ranking": Query(lambda m: scenarios.ranking(m.period_days, RANKS, 12), """
      SELECT *, row_number() OVER (ORDER BY score DESC, scenario_id)::INT AS rank FROM (SELECT *, CASE good WHEN 4 THEN 'Go' WHEN 3 THEN 'Hold' ELSE 'No-Go' END AS judge FROM (SELECT *, coalesce((ar_full_period > 0)::INT, 0) + coalesce((ar_trailing_5y > 0)::INT, 0) + coalesce((ar_trailing_3y > 0)::INT, 0) + coalesce((month_rate >= 0.5)::INT, 0) AS good FROM (
        SELECT *, (coalesce(ar_full_period, 0) * 4 + coalesce(ar_trailing_5y, 0) * 3 + coalesce(ar_trailing_3y, 0) * 2 + coalesce(ar_trailing_2y, 0) * 1.5 + coalesce(ar_trailing_1y, 0) * 0.5) / 11 AS score FROM (
          SELECT universe_id, scenario_id, avg(net_after_tax_pct) FILTER (period_label = 'full_period') * 12 AS ar_full_period, avg(net_after_tax_pct) FILTER (period_label = 'trailing_5y') * 12 AS ar_trailing_5y, avg(net_after_tax_pct) FILTER (period_label = 'trailing_3y') * 12 AS ar_trailing_3y,
            avg(net_after_tax_pct) FILTER (period_label = 'trailing_2y') * 12 AS ar_trailing_2y, avg(net_after_tax_pct) FILTER (period_label = 'trailing_1y') * 12 AS ar_trailing_1y FROM pd GROUP BY ALL)
        JOIN (SELECT scenario_id, avg((s > 0)::INT) AS month_rate FROM (SELECT scenario_id, strftime(date, '%Y-%m') AS m, sum(net_after_tax_pct) AS s FROM pd WHERE period_label = 'full_period' GROUP BY ALL) GROUP BY ALL) USING (scenario_id)
        JOIN (SELECT scenario_id, avg((s > 0)::INT) AS year_rate FROM (SELECT scenario_id, year(date) AS y, sum(net_after_tax_pct) AS s FROM pd WHERE period_label = 'full_period' GROUP BY ALL) GROUP BY ALL) USING (scenario_id))))""".replace("SELECT *, row_number() OVER (ORDER BY score", "SELECT * EXCLUDE (good), row_number() OVER (ORDER BY score"),
      ("ar_full_period", "ar_trailing_5y", "ar_trailing_3y", "ar_trailing_2y", "ar_trailing_1y", "score", "month_rate", "year_rate"), ()),
    "param_grid": Query(_grid, """
      SELECT universe_id, q, slippage_bps, allow_short, avg(ret) * 12 * 100 AS ar, stddev_samp(ret) * sqrt(12) * 100 AS risk, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)) END AS rr, min(e / m - 1) * 100 AS mdd, count(*) AS n_days FROM (SELECT *, max(e) OVER (PARTITION BY q, slippage_bps, allow_short ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (
        SELECT *, product(1 + ret) OVER (PARTITION BY q, slippage_bps, allow_short ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM (
          SELECT universe_id, date, q, slippage_bps, allow_short, l - CASE WHEN allow_short THEN coalesce(s, 0) ELSE 0 END - (5 + slippage_bps) / 10000 * 2 * (1 + ns) - 0.015::DOUBLE / 252 * ns AS ret FROM (
            SELECT universe_id, date, q, slippage_bps, allow_short, avg(next_oc) FILTER (signal >= hi AND signal >= 0) AS l, avg(next_oc) FILTER (signal <= lo AND signal <= 0) AS s, CASE WHEN allow_short AND count(*) FILTER (signal <= lo AND signal <= 0) > 0 THEN 1 ELSE 0 END AS ns
            FROM (SELECT universe_id, date, ticker, signal, next_oc FROM common) JOIN (SELECT date, q, quantile_cont(signal, q) AS lo, quantile_cont(signal, 1 - q) AS hi FROM (SELECT date, signal, 0.15::DOUBLE AS q FROM common) GROUP BY date, q HAVING count(*) >= 3 UNION ALL SELECT date, 0.2::DOUBLE, quantile_cont(signal, 0.2::DOUBLE), quantile_cont(signal, 1 - 0.2::DOUBLE) FROM common GROUP BY date HAVING count(*) >= 3
              UNION ALL SELECT date, 0.25::DOUBLE, quantile_cont(signal, 0.25::DOUBLE), quantile_cont(signal, 1 - 0.25::DOUBLE) FROM common GROUP BY date HAVING count(*) >= 3 UNION ALL SELECT date, 0.3::DOUBLE, quantile_cont(signal, 0.3::DOUBLE), quantile_cont(signal, 1 - 0.3::DOUBLE) FROM common GROUP BY date HAVING count(*) >= 3) USING (date),
              (VALUES (1.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) b(slippage_bps), (VALUES (true), (false)) a(allow_short) GROUP BY universe_id, date, q, slippage_bps, allow_short) WHERE l IS NOT NULL))) GROUP BY ALL""".replace("quantile_cont(signal, q) AS lo, quantile_cont(signal, 1 - q) AS hi", "quantile_cont(signal, 0.15::DOUBLE) AS lo, quantile_cont(signal, 1 - 0.15::DOUBLE) AS hi"), ("q", "slippage_bps", "ar", "risk", "rr", "mdd"), ()),
    "window_sensitivity": Query(_windows, " UNION ALL ".join(f"""
      SELECT universe_id, {n} AS length, avg(ret) * 12 * 100 AS ar, stddev_samp(ret) * sqrt(12) * 100 AS risk, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)) END AS rr, min(e / m - 1) * 100 AS mdd, count(*) AS n_days FROM (SELECT *, max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM (
        SELECT universe_id, date, coalesce(avg(next_oc) FILTER (signal >= hi AND signal >= 0), 0) - coalesce(avg(next_oc) FILTER (signal <= lo AND signal <= 0), 0) AS ret FROM sig_{n} JOIN (SELECT date, quantile_cont(signal, 0.3::DOUBLE) AS lo, quantile_cont(signal, 1.0::DOUBLE - 0.3::DOUBLE) AS hi FROM sig_{n} GROUP BY date HAVING count(*) >= 3) USING (date)
        GROUP BY ALL HAVING count(*) FILTER (signal >= hi AND signal >= 0) > 0))) GROUP BY ALL""".replace(f"sig_{n}", f"""(SELECT universe_id, date, ticker, signal, next_oc FROM (SELECT universe_id, date, ticker, next_oc, count(ret_cc) OVER w AS n, avg(ret_cc) OVER w AS signal FROM rets WHERE side = 'lag' WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) WHERE n = {n} AND next_oc IS NOT NULL)""") for n in WINDOWS), ("ar", "risk", "rr", "mdd"), ()),
    "excess_returns": Query(lambda m: studies.excess(m.portfolio.select(*K, "gross_return").join(m.factors.select("date", "rf"), "date"), "gross_return").select(*K, "gross_return"), "SELECT universe_id, date, gross_return - abs_mean / 100 AS gross_return FROM pf JOIN leadf USING (universe_id, date)", ("gross_return",)),
    "ols_ff3": Query(lambda m: studies.ols(m.portfolio.select(*K, "gross_return").join(m.lead_features.select(*K, "mean", "spread", "sd"), K), ["universe_id"], "gross_return", ["mean", "spread", "sd"])),
    "factor_models": Query(lambda m: studies.factor_models(m.portfolio.select(*K, "gross_return"), m.factors, "gross_return")),
    "spearman_p": Query(lambda m: studies.correlation_p(studies.spearman(m.portfolio.join(m.lead_features, K), ["universe_id"], "gross_return", "breadth")), """
      SELECT universe_id, rho, n, t, greatest(0, 1 - 2 * k / sqrt(v * pi()) * (SELECT sum(pow(1 + pow(abs(t) * (i + 0.5) / 20000, 2) / v, -(v + 1) / 2)) * abs(t) / 20000 FROM range(20000) g(i))) AS p FROM (SELECT *, n - 2 AS v, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) AS k FROM (
      SELECT universe_id, corr(ra, rb) AS rho, count(*) AS n FROM (SELECT universe_id, rank() OVER (ORDER BY gross_return) + (count(*) OVER (PARTITION BY gross_return) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY breadth) + (count(*) OVER (PARTITION BY breadth) - 1) / 2.0::DOUBLE AS rb FROM pf JOIN leadf USING (universe_id, date)) GROUP BY ALL))""", ("rho", "t", "p"), ()),
    "lambda_grid": Query(_lambda_grid),
    "backtest_pca": Query(lambda m: m.performance(portfolio.portfolio(m.subspace, m.rets))),
    "daily_signal": Query(lambda m: selection.positions(selection.quantile_masks(m.subspace)).withColumn("r", F.dense_rank().over(Window.partitionBy("universe_id").orderBy(F.desc("date")))).where("r = 1").select(*K, "ticker", "signal", "position")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: presented(q.build(Market(spark, sf_dir, q.by, q.grain)), q.digits)) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    made = {name: statement(q.sql, q.doubles, q.digits, q.dates) for name, q in QUERIES.items() if q.sql}
    made = {name: for_days(sql, DAYS) if QUERIES[name].grain == "day" else sql for name, sql in made.items()}
    return {name: for_universes(sql, QUERIES[name].by, UNIVERSES) if QUERIES[name].by else sql for name, sql in made.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance before and after costs and tax of the subspace signal's portfolio."""
    m = Market(spark, sf_dir)
    return presented(m.performance(portfolio.portfolio(m.subspace, m.rets)))
