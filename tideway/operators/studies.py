"""Studies that combine the operators: direction, gaps, regimes, quantile maps, parameter grids, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .performance import equity, longest_runs, performance
from .selection import KEY, quantile_masks

c = F.col


def sign_consistency(signals: DataFrame, rets: DataFrame, q: float = 0.3, min_long: float = 0.0, max_short: float = 0.0) -> DataFrame:
    """Share of equal signs of signal and next return, and mean product, over all rows, candidates and adopted."""
    rows = signals.join(rets.where("next_oc is not null").select(*KEY, "ticker", "next_oc"), [*KEY, "ticker"])
    rows = quantile_masks(rows, q)
    adopted = (c("cand_long") & (c("signal") >= min_long)) | (c("cand_short") & (c("signal") <= max_short))
    groups = F.explode(F.filter(F.array(F.lit("all"), F.when(c("cand_long") | c("cand_short"), F.lit("candidate")), F.when(adopted, F.lit("adopted"))), lambda x: x.isNotNull()))
    rows = rows.select("universe_id", "signal", "next_oc", groups.alias("grp"))
    return rows.groupBy("universe_id", "grp").agg(F.count("*").alias("n"), F.avg((F.signum("signal") == F.signum("next_oc")).cast("double")).alias("sign_rate"), F.avg(c("signal") * c("next_oc")).alias("mean_product"))


def gap_decomposition(signals: DataFrame, rets: DataFrame, q: float = 0.3) -> DataFrame:
    """Mean gap, intraday and close-to-close return of each group."""
    rows = quantile_masks(signals, q).join(rets.select(*KEY, "ticker", "next_gap", "next_oc", "next_cc"), [*KEY, "ticker"])
    group = F.when(c("cand_long"), "long").when(c("cand_short"), "short").otherwise("neutral")
    return rows.groupBy("universe_id", group.alias("grp")).agg(F.count("*").alias("n"), F.avg("next_gap").alias("gap"), F.avg("next_oc").alias("oc"), F.avg("next_cc").alias("cc"))


def regime_performance(days: DataFrame, regime: DataFrame, value: str) -> DataFrame:
    """Mean, deviation and count of a daily value by each regime axis, and by trend and volatility together."""
    rows = days.join(regime.select(*KEY, "trend_regime", "vol_regime", "rotation_regime"), KEY)
    return (
        rows.groupingSets([["universe_id", "trend_regime"], ["universe_id", "vol_regime"], ["universe_id", "rotation_regime"], ["universe_id", "trend_regime", "vol_regime"]], "universe_id", "trend_regime", "vol_regime", "rotation_regime")
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    )


def anomaly_days(scenarios: DataFrame, limit: float = 0.03, last: int = 252, a: str = "S01_CurrOC", b: str = "S02_FlipL_OC") -> DataFrame:
    """Of the last rows, those on which two scenarios differ by ``limit`` or more."""
    order = Window.partitionBy("universe_id").orderBy(F.desc("date"))
    rows = scenarios.where(c("scenario_id").isin(a, b)).groupBy(*KEY).agg((F.max(F.when(c("scenario_id") == b, c("gross"))) - F.max(F.when(c("scenario_id") == a, c("gross")))).alias("diff"))
    return rows.withColumn("back", F.row_number().over(order)).where((c("back") <= last) & (F.abs("diff") >= limit)).drop("back")


#: Numbers of the lead tickers of each group; those of a real universe are given by ticker.
GROUPS = {"financial": (1,), "energy": (2, 3), "growth": (4,), "consumer": (5, 6)}


def lead_features(rows: DataFrame, groups: dict[str, tuple[int, ...]] = GROUPS) -> DataFrame:
    """Cross-section of the lead returns of each date: market, dispersion, leadership and concentration.

    Skewness and kurtosis are those of the population; shares are of the sum of absolute returns, null if that is 0;
    ``groups`` names tickers by their ``ord``.
    """
    r, a = c("ret_cc"), F.abs("ret_cc")
    best, big = F.sort_array(F.collect_list(r), asc=False), F.sort_array(F.collect_list(a), asc=False)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean3 = lambda x: total(x) / F.size(x)
    p = F.percentile("ret_cc", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    inside = {n: F.avg(F.when(c("ord").isin(*v), r)) for n, v in groups.items()}
    outside = {n: F.avg(F.when(~c("ord").isin(*v), r)) for n, v in groups.items()}
    out = rows.where("side = 'lead' and ret_cc is not null").groupBy(*KEY).agg(
        F.avg(r).alias("mean"), p.alias("p"), F.avg((r > 0).cast("double")).alias("breadth"), F.avg((r < 0).cast("double")).alias("breadth_down"), mean3(F.slice(best, 1, 3)).alias("top3"), mean3(F.slice(best, -F.least(F.lit(3), F.size(best)), F.lit(3))).alias("bottom3"), F.stddev_samp(r).alias("sd"),
        (F.max(r) - F.min(r)).alias("range"), F.avg(a).alias("abs_mean"), F.avg(F.when(c("cyc") == 1, r)).alias("cyclical"), F.avg(F.when(c("cyc") == -1, r)).alias("defensive"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"),
        F.sum(a).alias("moved"), F.max(a).alias("top1"), total(F.slice(big, 1, 3)).alias("big3"), F.min(a).alias("least1"), F.count("*").alias("n"), *[inside[g].alias(g) for g in groups], (inside["energy"] - outside["energy"]).alias("energy_vs_rest"), (inside["financial"] - outside["financial"]).alias("financial_vs_rest"),
    )
    share = lambda x: F.when(c("moved") > 0, c(x) / c("moved"))
    return out.select(
        *KEY, "mean", c("p")[1].alias("median"), (c("p")[2] - c("p")[0]).alias("iqr"), "breadth", "breadth_down", "top3", "bottom3", (c("top3") - c("bottom3")).alias("top_bottom_spread"), "sd", "range", "abs_mean", "skew", "kurt",
        "cyclical", "defensive", *groups, (c("cyclical") - c("defensive")).alias("spread"), (c("growth") - c("defensive")).alias("growth_vs_def"), "energy_vs_rest", "financial_vs_rest",
        share("top1").alias("top1_share"), share("big3").alias("top3_share"), share("least1").alias("bottom1_share"), (share("top1") * c("n")).alias("narrowness"),
    )


def spreads(rets: DataFrame, signals: DataFrame, names: DataFrame) -> DataFrame:
    """Cyclical less defensive: of the lead returns and of the lag signals of each date, and whether both have one sign.

    ``names(universe_id, ticker, cyc)``; a side without both groups has no spread, which never agrees.
    """
    spread = lambda x: F.avg(F.when(c("cyc") == 1, c(x))) - F.avg(F.when(c("cyc") == -1, c(x)))
    lead = rets.where("side = 'lead'").groupBy(*KEY).agg(spread("ret_cc").alias("lead_spread"))
    lag = signals.join(names.select("universe_id", "ticker", "cyc").distinct(), ["universe_id", "ticker"]).groupBy(*KEY).agg(spread("signal").alias("lag_spread"))
    return lead.join(lag, KEY).withColumn("agree", F.coalesce((c("lead_spread") > 0) == (c("lag_spread") > 0), F.lit(False)))


def rolling_difference(returns: DataFrame, a: str, b: str, width: int = 20) -> DataFrame:
    """Mean over the last ``width`` dates of what scenario b earns more than a."""
    rows = returns.where(c("scenario_id").isin(a, b)).groupBy(*KEY).agg((F.max(F.when(c("scenario_id") == b, c("gross"))) - F.max(F.when(c("scenario_id") == a, c("gross")))).alias("diff"))
    w = Window.partitionBy("universe_id").orderBy("date").rowsBetween(1 - width, 0)
    return rows.withColumn("rolling", F.avg("diff").over(w))


def signal_scale(positions: DataFrame, adaptive: DataFrame, regime: DataFrame) -> DataFrame:
    """Scale of the signals and shares of days with both sides, under fixed and adaptive thresholds, by volatility and trend.

    ``positions`` and ``adaptive`` have signal and position.
    """
    both = lambda rows, name: rows.groupBy(*KEY).agg(F.min(F.abs("signal")).alias("_x"), (F.max((c("position") == "LONG").cast("int")) * F.max((c("position") == "SHORT").cast("int"))).alias(name))
    days = positions.groupBy(*KEY).agg(F.avg(F.abs("signal")).alias("abs_mean"), F.percentile("signal", F.lit(0.5)).alias("median"), F.max("signal").alias("top1"), F.max((c("position") == "LONG").cast("int")).alias("has_long"))
    days = days.join(both(positions, "fixed").drop("_x"), KEY).join(both(adaptive, "adaptive").drop("_x"), KEY).join(regime.select(*KEY, "trend_regime", "vol_regime"), KEY)
    out = days.groupingSets([["universe_id", "vol_regime"], ["universe_id", "trend_regime"], ["universe_id", "trend_regime", "vol_regime"]], "universe_id", "trend_regime", "vol_regime")
    return out.agg(F.count("*").alias("days"), F.avg("abs_mean").alias("abs_mean"), F.avg("median").alias("median"), F.avg("top1").alias("top1"), F.avg("fixed").alias("fixed_rate"), F.avg("adaptive").alias("adaptive_rate"), (1 - F.avg("has_long")).alias("no_long_rate"))


#: Settings of the position filters: (name, least spread, least long signal, largest short signal).
SETTINGS = (("base", 0.0, 0.0, 0.0), ("spread", 0.0951, 0.0, 0.0), ("var_a", 0.0, 0.05, -0.05), ("var_b", 0.0, 0.1, -0.1), ("both_a", 0.0951, 0.05, -0.05), ("both_b", 0.0951, 0.1, -0.1))


def position_filters(masks: DataFrame, settings=SETTINGS) -> DataFrame:
    """For each setting: mean counts, returns on traded and on all days, win rate, compound, and longest runs.

    ``masks``: candidate rows with next_oc.  A day is traded if it has a long and its spread reaches the least one.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(s).alias("least"), F.lit(lo).alias("min_long"), F.lit(hi).alias("max_short")) for n, s, lo, hi in settings]))
    rows = masks.select("*", each.alias("g")).select(*KEY, "signal", "next_oc", "g.*", (c("cand_long") & (c("signal") >= c("g.min_long"))).alias("l"), (c("cand_short") & (c("signal") <= c("g.max_short"))).alias("s"))
    mean = lambda m, x: F.avg(F.when(c(m), c(x)))
    keys = ["universe_id", "setting"]
    days = rows.groupBy(*keys, "date", "least").agg(F.count_if("l").alias("nl"), F.count_if("s").alias("ns"), mean("l", "next_oc").alias("lr"), mean("s", "next_oc").alias("sr"), (mean("l", "signal") - mean("s", "signal")).alias("strength"))
    days = days.withColumns({"traded": (c("nl") > 0) & (F.coalesce("strength", F.lit(0.0)) >= c("least")), "ret": F.coalesce("lr", F.lit(0.0)) - F.coalesce("sr", F.lit(0.0))})
    w, v = Window.partitionBy(*keys).orderBy("date"), Window.partitionBy(*keys, "kind").orderBy("date")
    days = days.withColumn("kind", F.when(~c("traded"), "skip").when(c("ret") > 0, "win").otherwise("loss")).withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    runs = days.groupBy(*keys, "kind", "island").agg(F.count("*").alias("n")).groupBy(*keys).agg(*[F.coalesce(F.max(F.when(c("kind") == k, c("n"))), F.lit(0)).alias(f"longest_{k}") for k in ("loss", "skip")])
    t = lambda x: F.when(c("traded"), x)
    out = days.groupBy(*keys).agg(
        F.avg("nl").alias("long_count"), F.avg("ns").alias("short_count"), F.avg(t(c("ret"))).alias("traded_mean"), F.avg(F.when(c("traded"), c("ret")).otherwise(0.0)).alias("all_mean"), F.avg(t((c("ret") > 0).cast("double"))).alias("win_rate"),
        (F.product(1 + F.when(c("traded"), c("ret")).otherwise(0.0)) - 1).alias("compound"), F.avg(t(F.coalesce("lr", F.lit(0.0)))).alias("long_mean"), F.avg(t(-F.coalesce("sr", F.lit(0.0)))).alias("short_mean"),
    )
    return out.join(runs, keys)


def worst_days(features: DataFrame, days: DataFrame, value: str, names: tuple[str, ...], shares: tuple[float, ...] = (0.2, 0.1)) -> DataFrame:
    """Means of features over the dates whose value is in the worst share, and over all (share 1)."""
    rows = features.join(days.select(*KEY, value), KEY).withColumn("at", F.percent_rank().over(Window.partitionBy("universe_id").orderBy(value, "date")))
    each = F.explode(F.array(*map(F.lit, (1.0, *shares))))
    rows = rows.select("*", each.alias("share")).where(c("at") <= c("share"))
    return rows.groupBy("universe_id", "share").agg(F.count("*").alias("n"), F.avg(value).alias("value_mean"), *[F.avg(x).alias(x) for x in names])


def best_scenarios(returns: DataFrame) -> DataFrame:
    """The scenario that earned most on each tradeable date, ties by name."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("gross"), "scenario_id")
    return returns.where("tradeable").withColumn("r", F.row_number().over(order)).where("r = 1").select(*KEY, "scenario_id", "gross")


def quintile_map(features: DataFrame, days: DataFrame, feature: str, value: str, n: int = 5) -> DataFrame:
    """Mean of a daily value by quantile group of a feature (ties by date)."""
    w = Window.partitionBy("universe_id").orderBy(feature, "date")
    rows = features.where(c(feature).isNotNull()).select(*KEY, feature).join(days.select(*KEY, value), KEY)
    return rows.withColumn("bucket", F.ntile(n).over(w)).groupBy("universe_id", "bucket").agg(F.count("*").alias("n"), F.avg(feature).alias("feature_mean"), F.avg(value).alias("value_mean"))


def tercile_cross(features: DataFrame, days: DataFrame, a: str, b: str, value: str) -> DataFrame:
    wa, wb = (Window.partitionBy("universe_id").orderBy(x, "date") for x in (a, b))
    rows = features.select(*KEY, a, b).na.drop().join(days.select(*KEY, value), KEY)
    return rows.withColumns({"ta": F.ntile(3).over(wa), "tb": F.ntile(3).over(wb)}).groupBy("universe_id", "ta", "tb").agg(F.count("*").alias("n"), F.avg(value).alias("value_mean"))


def spread_grid(stats: DataFrame, days: DataFrame, limits: list[float]) -> DataFrame:
    """For each least signal spread: traded days, their mean, and the longest streak of skipped days."""
    rows = stats.select(*KEY, "trade_strength").join(days.select(*KEY, "net_pre_tax_return"), KEY)
    rows = rows.select("*", F.explode(F.array(*map(F.lit, limits))).alias("least_spread")).withColumn("traded", c("trade_strength") >= c("least_spread"))
    w, v = Window.partitionBy("universe_id", "least_spread").orderBy("date"), Window.partitionBy("universe_id", "least_spread", "traded").orderBy("date")
    runs = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v)).groupBy("universe_id", "least_spread", "traded", "island").agg(F.count("*").alias("n"), F.sum("net_pre_tax_return").alias("s"))
    return runs.groupBy("universe_id", "least_spread").agg(
        F.coalesce(F.sum(F.when(c("traded"), c("n"))), F.lit(0)).alias("traded_days"), (F.sum(F.when(c("traded"), c("s"))) / F.sum(F.when(c("traded"), c("n")))).alias("mean_return"), F.coalesce(F.max(F.when(~c("traded"), c("n"))), F.lit(0)).alias("longest_skip"),
    )


def parameter_grid(rows: DataFrame, quantiles: tuple[float, ...], slippage: tuple[float, ...], params: tuple[str, ...] = (), per_year: int = 252, commission: float = 5.0, borrow: float = 0.015) -> DataFrame:
    """Portfolio performance for a grid of quantiles, slippage and shorts, and of ``params``, columns of the rows.

    ``rows``: universe_id, date, signal, next_oc and the params.  Parameters multiply the rows and are part of every key, so
    the grid is one pass; the bounds of all quantiles come from one window.
    """
    keys = [*KEY, *params]
    w = Window.partitionBy(*keys)
    rows = rows.where("signal is not null and next_oc is not null").withColumns({"n": F.count("*").over(w), "p": F.percentile("signal", F.array(*[F.lit(x) for q in quantiles for x in (q, 1 - q)])).over(w)}).where("n >= 3")
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), c("p")[2 * i].alias("lo"), c("p")[2 * i + 1].alias("hi")) for i, q in enumerate(quantiles)]))
    rows = rows.select(*keys, "signal", "next_oc", each.alias("g")).select(*keys, "signal", "next_oc", "g.*")
    rows = rows.withColumns({"long": (c("signal") >= c("hi")) & (c("signal") >= 0), "short": (c("signal") <= c("lo")) & (c("signal") <= 0)})
    costs = F.explode(F.array(*[F.struct(F.lit(b).alias("slippage_bps"), F.lit(a).alias("allow_short")) for b in slippage for a in (True, False)]))
    days = rows.groupBy(*keys, "q").agg(F.avg(F.when(c("long"), c("next_oc"))).alias("l"), F.avg(F.when(c("short"), c("next_oc"))).alias("s"), F.max("long").alias("has_long"), F.max("short").alias("has_short")).where("has_long")
    days = days.select("*", costs.alias("g")).select(*keys, "q", "l", "s", "has_short", "g.*")
    ns = (c("has_short") & c("allow_short")).cast("double")
    ret = c("l") - F.when(c("allow_short"), F.coalesce("s", F.lit(0.0))).otherwise(0.0) - (commission + c("slippage_bps")) / 1e4 * 2 * (1 + ns) - borrow / 252 * ns
    return performance(days.withColumn("ret", ret), ["universe_id", *params, "q", "slippage_bps", "allow_short"], per_year)


def spread_study(days: DataFrame, limits: tuple[float, ...]) -> DataFrame:
    """For each least signal spread: what is traded, its returns and win rates, risk, runs and contributions of the sides.

    ``days``: universe_id, date, trade_strength, ret, long_contrib, short_contrib.  A date below the spread is skipped and
    earns nothing.  A run of losses is one of traded dates that do not win; skipped ones end it.
    """
    keys = ["universe_id", "least_spread"]
    rows = days.select(*KEY, "trade_strength", "ret", "long_contrib", "short_contrib", F.explode(F.array(*map(F.lit, limits))).alias("least_spread"))
    rows = rows.withColumn("traded", c("trade_strength") >= c("least_spread"))
    held = lambda x: F.when(c("traded"), c(x))
    zero = lambda x: F.when(c("traded"), c(x)).otherwise(0.0)
    rows = rows.withColumns({"kept": zero("ret"), "kind": F.when(~c("traded"), "skip").when(c("ret") > 0, "win").otherwise("loss")})
    w, v = Window.partitionBy(*keys).orderBy("date"), Window.partitionBy(*keys, "kind").orderBy("date")
    runs = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v)).groupBy(*keys, "kind", "island").agg(F.count("*").alias("n"))
    runs = runs.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(c("kind") == k, c("n"))), F.lit(0)).alias(f"longest_{k}") for k in ("loss", "skip")])
    out = rows.groupBy(*keys).agg(
        F.count_if("traded").alias("traded_days"), F.count_if(~c("traded")).alias("skipped_days"), F.avg(c("traded").cast("double")).alias("pass_rate"), F.avg(held("ret")).alias("traded_mean"), F.avg("kept").alias("all_mean"),
        F.avg(F.when(c("traded"), (c("ret") > 0).cast("double"))).alias("traded_win_rate"), F.avg((c("kept") > 0).cast("double")).alias("all_win_rate"), (F.product(1 + c("kept")) - 1).alias("compound"),
        F.avg(held("long_contrib")).alias("traded_long"), F.avg(held("short_contrib")).alias("traded_short"), F.avg(zero("long_contrib")).alias("all_long"), F.avg(zero("short_contrib")).alias("all_short"),
    )
    falls = equity(rows.select(*keys, "date", c("kept").alias("ret")), keys).groupBy(*keys).agg(F.min("drawdown").alias("mdd"))
    return out.join(falls, keys).join(runs, keys)


def spread_bands(days: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """Days, mean return and win rate of each band of the signal spread: from one edge up to the next, the last one open."""
    bands = F.array(*map(F.lit, edges))
    rows = days.select("universe_id", "ret", F.size(F.filter(bands, lambda e: e <= c("trade_strength"))).alias("band")).where("band > 0")
    low, high = F.get(bands, c("band") - 1), F.get(bands, c("band"))
    return rows.groupBy("universe_id", "band").agg(F.count("*").alias("days"), F.avg("ret").alias("mean"), F.avg((c("ret") > 0).cast("double")).alias("win_rate")).select("universe_id", low.alias("low"), high.alias("high"), "days", "mean", "win_rate")


def threshold_comparison(masks: DataFrame, regime: DataFrame, settings: tuple[tuple[str, float | None], ...], adaptive: tuple[dict[str, float], dict[str, float]], per_year: int = 252, cost: float = 0.002, borrow: float = 0.015) -> DataFrame:
    """Fixed thresholds against adaptive ones: shares of days that trade or have no long, and returns before and after costs,
    over all dates, by volatility, and by trend and volatility.

    ``masks``: candidate rows with next_oc; ``settings``: (name, threshold of both sides, None: by volatility).  A date
    trades if it has a long and a short; its return counts if it has a long.
    """
    long_table, short_table = adaptive
    of = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c("vol_regime")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), (F.lit(t) if t is not None else of(long_table)).alias("min_long"), (F.lit(-t) if t is not None else of(short_table)).alias("max_short")) for n, t in settings]))
    rows = masks.join(regime.select(*KEY, "trend_regime", "vol_regime"), KEY)
    rows = rows.select(*KEY, "trend_regime", "vol_regime", "signal", "next_oc", "cand_long", "cand_short", each.alias("g")).select("*", "g.*")
    rows = rows.withColumns({"l": c("cand_long") & (c("signal") >= c("min_long")), "s": c("cand_short") & (c("signal") <= c("max_short"))})
    mean = lambda m: F.coalesce(F.avg(F.when(c(m), c("next_oc"))), F.lit(0.0))
    days = rows.groupBy(*KEY, "setting", "trend_regime", "vol_regime").agg(F.count_if("l").alias("nl"), F.count_if("s").alias("ns"), (mean("l") - mean("s")).alias("gross"))
    has = lambda n: (c(n) > 0).cast("double")
    days = days.withColumn("net", c("gross") - cost * (has("nl") + has("ns")) - borrow / 252 * has("ns"))
    groups = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("trend"), F.lit(None).cast("string").alias("vol")), F.struct(F.lit(None).cast("string").alias("trend"), c("vol_regime").alias("vol")), F.struct(c("trend_regime").alias("trend"), c("vol_regime").alias("vol"))))
    days = days.select(*KEY, "setting", "nl", "ns", "gross", "net", groups.alias("g")).select(*KEY, "setting", "nl", "ns", "gross", "net", F.coalesce("g.trend", F.lit("all")).alias("trend_regime"), F.coalesce("g.vol", F.lit("all")).alias("vol_regime"))
    keys = ["universe_id", "setting", "trend_regime", "vol_regime"]
    shares = days.groupBy(*keys).agg(F.count("*").alias("days"), F.avg(((c("nl") > 0) & (c("ns") > 0)).cast("double")).alias("tradeable_rate"), F.avg((c("nl") == 0).cast("double")).alias("no_long_rate"))
    held = days.where("nl > 0")
    for name in ("gross", "net"):
        one = performance(held.select(*keys, "date", c(name).alias("ret")), keys, per_year)
        shares = shares.join(one.select(*keys, *[c(x).alias(f"{name}_{x}") for x in ("ar", "rr", "mdd")]), keys, "left")
    return shares


#: What each flip scenario does with the long and the short candidates (1: as signalled, -1: turned).
FLIPS = (("A_orig", 1, 1), ("B_flip_L", -1, 1), ("C_flip_S", 1, -1), ("D_flip_B", -1, -1))


def flip_study(masks: DataFrame, looks: dict[str, int], horizons: dict[str, str], flips=FLIPS) -> DataFrame:
    """The flip scenarios over several look-backs (numbers of last dates) and horizons (name: return column).

    ``masks``: candidate rows with the return columns.  A date's return is the half of both sides' contributions, or that of
    the one side it has; dates without either are left out.  Scenario, look-back and horizon multiply the dates, which are
    few, after one aggregation of the rows.
    """
    mean = lambda m, x: F.avg(F.when(c(m), c(x)))
    days = masks.groupBy(*KEY).agg(*[x for n, v in horizons.items() for x in (mean("cand_long", v).alias(f"l_{n}"), mean("cand_short", v).alias(f"s_{n}"))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), c(f"l_{n}").alias("l"), c(f"s_{n}").alias("s")) for n in horizons]))
    days = days.select(*KEY, each.alias("g")).select(*KEY, "g.*").where("l is not null or s is not null")
    days = days.withColumn("back", F.row_number().over(Window.partitionBy("universe_id", "horizon").orderBy(F.desc("date"))))
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("look"), F.lit(n).alias("last"), F.lit(i).alias("scenario"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, n in looks.items() for i, a, b in flips]))
    days = days.select(*KEY, "horizon", "l", "s", "back", grid.alias("g")).select(*KEY, "horizon", "l", "s", "back", "g.*").where(c("back") <= c("last"))
    long, short = c("l") * c("a"), -c("s") * c("b")
    days = days.withColumns({"long": long, "short": short, "ret": F.coalesce((long + short) / 2, long, short)})
    keys = ["universe_id", "horizon", "look", "scenario"]
    out = days.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg((c("ret") > 0).cast("double")).alias("win_rate"), (F.product(1 + c("ret")) - 1).alias("compound"), F.avg("long").alias("long_mean"), F.avg("short").alias("short_mean"))
    falls = equity(days.select(*keys, "date", "ret"), keys).groupBy(*keys).agg(F.min("drawdown").alias("mdd"))
    runs = longest_runs(days.select(*keys, "date", "ret"), keys).select(*keys, c("max_losses").alias("longest_loss"))
    return out.join(falls, keys).join(runs, keys)


def annual_regression(returns: DataFrame, factors: DataFrame, value: str, rate: str = "rf", keys: tuple[str, ...] = ("universe_id",), per_year: int = 252) -> DataFrame:
    """The regression of returns, less the risk-free rate if there is one, on all factors that are there.

    One row for each key: n_obs, alpha_annual, t_alpha, r2, betas and t_stats (maps by factor), stars (** from a t of 2, * from
    1.65) and error: ``insufficient observations: n=, k=`` unless there are more rows than coefficients.  Rows with a
    missing value are left out; a key without any has no row.
    """
    xs = [x for x in factors.columns if x not in ("date", rate)]
    rows = returns.select(*keys, "date", value).join(factors, "date").na.drop()
    rows = excess(rows, value, rate)
    k = len(xs) + 1
    fitted = ols(rows, list(keys), value, xs)
    beta = F.map_from_entries(F.sort_array(F.collect_list(F.when(c("term") != "alpha", F.struct("term", "coefficient")))))
    t_of = F.map_from_entries(F.sort_array(F.collect_list(F.when(c("term") != "alpha", F.struct("term", "t_value")))))
    alpha = lambda x: F.max(F.when(c("term") == "alpha", c(x)))
    out = fitted.groupBy(*keys).agg(F.max("n").alias("n_obs"), (alpha("coefficient") * per_year).alias("alpha_annual"), alpha("t_value").alias("t_alpha"), F.max("r2").alias("r2"), beta.alias("betas"), t_of.alias("t_stats"))
    few = c("n_obs") <= k
    size = F.abs("t_alpha")
    out = out.withColumns({"stars": F.when(size >= 2.0, "**").when(size >= 1.65, "*").otherwise(""), "error": F.when(few, F.format_string(f"insufficient observations: n=%d, k={k}", "n_obs"))})
    return out.select(*keys, "n_obs", *[F.when(~few, c(x)).alias(x) for x in ("alpha_annual", "t_alpha", "r2", "betas", "t_stats", "stars")], "error")


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""

    def rank(x: str):
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(x)) + (F.count("*").over(w.partitionBy(*keys, x)) - 1) / 2

    return rows.select(*keys, a, b).na.drop().withColumns({"ra": rank(a), "rb": rank(b)}).groupBy(*keys).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def correlation_p(rows: DataFrame, steps: int = 2000) -> DataFrame:
    """Adds t and the two-sided p of a correlation ``rho`` of ``n`` rows: t has n - 2 degrees of freedom.

    With t = sqrt(v) tan(x), the share of t's distribution between -t and t is a ratio of integrals of cos(x)^(v - 1), which
    Simpson's rule gives; null with fewer than three rows.
    """
    v = c("n") - 2
    t = c("rho") * F.sqrt(v / (1 - c("rho") * c("rho")))
    end = F.when(F.abs("rho") >= 1, F.lit(1.5707963267948966)).otherwise(F.atan(F.abs(t) / F.sqrt(v)))

    def area(upper: Column) -> Column:
        height = lambda i: F.pow(F.cos(upper * i / steps), v - 1) * F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2)
        return upper * F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + height(i))

    p = F.when(v >= 1, F.greatest(F.lit(0.0), 1 - area(end) / area(F.lit(1.5707963267948966))))
    return rows.withColumns({"t": F.when((v >= 1) & (F.abs("rho") < 1), t), "p": p})


#: The columns of the factor models.
MODELS = {"ff3": ("mkt_rf", "smb", "hml"), "carhart4": ("mkt_rf", "smb", "hml", "mom")}


def excess(rows: DataFrame, value: str, rate: str = "rf") -> DataFrame:
    """``value`` less the risk-free rate of the date."""
    return rows.withColumn(value, c(value) - F.coalesce(c(rate), F.lit(0.0)) if rate in rows.columns else c(value))


def factor_models(returns: DataFrame, factors: DataFrame, value: str, keys: tuple[str, ...] = ("universe_id",)) -> DataFrame | None:
    """Regressions of each model whose columns the factors have, on the dates that both have; None if there is none."""
    rows, out = returns.join(factors, "date"), None
    for model, xs in MODELS.items():
        if all(x in factors.columns for x in xs):
            part = ols(rows, list(keys), value, list(xs)).withColumn("model", F.lit(model))
            out = part if out is None else out.unionByName(part)
    return out


def ols(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Least squares with intercept: coefficients, t values, R squared and n for each key.

    Only moments are aggregated; the normal equations (a few numbers a group) are solved in a batch of groups.
    """
    import numpy as np
    import pyarrow as pa

    names = ["_one", *xs]
    rows = rows.select(*keys, y, *xs).na.drop().withColumn("_one", F.lit(1.0))
    moments = [F.sum(c(p) * c(q)) for i, p in enumerate(names) for q in names[i:]]
    sums = rows.groupBy(*keys).agg(F.array(*moments).alias("xx"), F.array(*[F.sum(c(p) * c(y)) for p in names]).alias("xy"), F.sum(c(y) * c(y)).alias("yy"), F.count("*").alias("n"))
    kind = ", ".join([f"{k} {dict(rows.dtypes)[k]}" for k in keys] + ["term string", "coefficient double", "t_value double", "r2 double", "n long"])

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                a, k = np.zeros((len(names),) * 2), iter(r["xx"])
                for i in range(len(names)):
                    for j in range(i, len(names)):
                        a[i, j] = a[j, i] = next(k)
                inv = np.linalg.pinv(a)
                beta = inv @ np.array(r["xy"])
                ssr = max(0.0, r["yy"] - beta @ np.array(r["xy"]))
                total = r["yy"] - r["xy"][0] ** 2 / r["n"]
                se = np.sqrt(np.maximum(ssr / max(1, r["n"] - len(names)) * np.diag(inv), 0))
                for i, name in enumerate(["alpha", *xs]):
                    out.append([*(r[x] for x in keys), name, float(beta[i]), float(beta[i] / se[i]) if se[i] > 0 else None, 1 - ssr / total if total > 0 else None, r["n"]])
            cols = list(zip(*out)) or [()] * (len(keys) + 5)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], [*keys, "term", "coefficient", "t_value", "r2", "n"])

    return sums.mapInArrow(solve, kind)


def readiness(returns: DataFrame | None, factors: DataFrame | None, value: str, least: int = 60) -> DataFrame:
    """Whether a regression on three factors can be run, and the first reason why not; n and the range of the dates."""
    spark = (returns if returns is not None else factors).sparkSession if (returns is not None or factors is not None) else SparkSession.getActiveSession()
    said = lambda reason: spark.createDataFrame([(0, reason, False)], "n long, reason string, ready boolean").withColumns({"start": F.lit(None).cast("date"), "end": F.lit(None).cast("date")})
    if factors is None or factors.isEmpty():
        return said("factor_data_unavailable")
    missing = sorted(x.upper() for x in MODELS["ff3"] if x not in factors.columns)
    if missing:
        return said("missing_columns:" + ",".join(missing))
    if returns is None or returns.isEmpty():
        return said("returns_unavailable")
    n = returns.join(factors, "date").select("date", value, *MODELS["ff3"]).na.drop().agg(F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"))
    few = c("n") < least
    return n.select("n", F.when(few, F.concat(F.lit("insufficient_observations:"), c("n"))).otherwise("ok").alias("reason"), (~few).alias("ready"), F.when(~few, c("start")).alias("start"), F.when(~few, c("end")).alias("end"))
