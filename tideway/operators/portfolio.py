"""Equal-weight long and short portfolios with costs, with and without a decision rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import sure
from ..functions.rules import FLIP, GAP, LONG_GAP, SHORT_ONLY, SKIP
from .selection import KEY, quantile_masks, shortable

c = F.col
YEAR = 252


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 5.0
    slippage_bps: float = 5.0
    borrow_rate: float = 0.015
    allow_short: bool = True
    unshortable: tuple[str, ...] = ()


def _legs(rows: DataFrame, keys: list[str], costs: Costs) -> DataFrame:
    """Return, costs and counts of the legs that ``long`` and ``short`` mark, both of notional one where not empty."""
    leg = lambda m: F.avg(F.when(c(m), c("next_oc")))
    days = rows.groupBy(*keys).agg(leg("long").alias("l"), leg("short").alias("s"), F.count_if("long").alias("n_long"), F.count_if("short").alias("n_short"))
    one = lambda n: (c(n) > 0).cast("double")
    days = days.withColumns({"long_notional": one("n_long"), "short_notional": one("n_short"), "gross_return": F.coalesce("l", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))})
    both = c("long_notional") + c("short_notional")
    days = days.withColumns({"commission_cost": costs.commission_bps / 1e4 * 2 * both, "slippage_cost": costs.slippage_bps / 1e4 * 2 * both, "borrow_cost": costs.borrow_rate / YEAR * c("short_notional")})
    net = c("gross_return") - c("commission_cost") - c("slippage_cost") - c("borrow_cost")
    return days.select(*keys, "gross_return", "commission_cost", "slippage_cost", "borrow_cost", net.alias("net_pre_tax_return"), "long_notional", "short_notional", "n_long", "n_short")


def portfolio(signals: DataFrame, rets: DataFrame, q: float = 0.3, costs: Costs = Costs(), min_long: float = 0.0, max_short: float = 0.0, require_short: bool = False, params: tuple[str, ...] = ()) -> DataFrame:
    """Daily portfolio of the dates with three signals that have a next-session return, and a long leg (and, on request,
    a short leg too).  ``params`` are columns of the signals that tell series apart: each has portfolios of its own."""
    rows = signals.join(rets.where("next_oc is not null").select(*KEY, "ticker", "next_oc"), [*KEY, "ticker"])
    rows = quantile_masks(rows, q, keys=params).withColumns({"long": c("cand_long") & (c("signal") >= min_long), "short": shortable(c("cand_short") & (c("signal") <= max_short), costs.allow_short, costs.unshortable)})
    days = _legs(rows, [*KEY, *params], costs).where("n_long > 0")
    return days.where("n_short > 0") if require_short else days


def contexts(signals: DataFrame, rets: DataFrame, regime: DataFrame, q: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Candidate rows of each date, and its rule context: mean gaps over all lag tickers and over either candidate side,
    and the regimes.  The candidate strength of a backtest is unknown."""
    rows = signals.join(rets.where("next_oc is not null").select(*KEY, "ticker", "next_oc", "gap"), [*KEY, "ticker"])
    rows = quantile_masks(rows, q)
    gaps = rets.where("side = 'lag'").groupBy(*KEY).agg(F.avg("gap").alias("open_gap"))
    context = rows.groupBy(*KEY).agg(F.avg(F.when(c("cand_long"), c("gap"))).alias("long_gap"), F.avg(F.when(c("cand_short"), c("gap"))).alias("short_gap"))
    context = context.join(gaps, KEY, "left").join(regime.select(*KEY, "trend_regime", "vol_regime", "rotation_regime"), KEY, "left")
    return rows, context.withColumn("candidate_signal_strength", F.lit(None).cast("double"))


def decisions(context: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(universe_id, date, rule_id, strategy) for every rule; all rules are evaluated in one pass."""
    pairs = F.array(*[F.struct(F.lit(name).alias("rule_id"), rule.alias("strategy")) for name, rule in rules.items()])
    return context.select(*KEY, F.explode(pairs).alias("d")).select(*KEY, "d.rule_id", "d.strategy")


def rule_portfolio(rows: DataFrame, decided: DataFrame, costs: Costs = Costs(), min_long: float = 0.0, max_short: float = 0.0, gap_limit: float = 0.005) -> DataFrame:
    """The portfolio of each rule: skipped dates have none, a turned or short-only date needs no longs."""
    base = rows.withColumns({
        "l": c("cand_long") & (c("signal") >= min_long), "s": shortable(c("cand_short") & (c("signal") <= max_short), costs.allow_short, costs.unshortable), "sq": shortable(c("cand_short"), costs.allow_short, costs.unshortable),
    }).join(decided.where(c("strategy") != SKIP), KEY)
    up, down = sure(c("gap") > gap_limit), sure(c("gap") < -gap_limit)
    long = F.when(c("strategy").isin(FLIP, SHORT_ONLY), False).when(c("strategy").isin(GAP, LONG_GAP), c("l") & ~up).otherwise(c("l"))
    short = F.when(c("strategy") == FLIP, c("l") | c("s")).when(c("strategy") == SHORT_ONLY, c("sq")).when(c("strategy") == GAP, c("s") & ~down).otherwise(c("s"))
    days = _legs(base.withColumns({"long": long, "short": short}), [*KEY, "rule_id", "strategy"], costs)
    return days.where((c("n_long") > 0) | ((c("n_short") > 0) & c("strategy").isin(FLIP, SHORT_ONLY))).withColumnRenamed("strategy", "strategy_decision")
