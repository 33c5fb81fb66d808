"""The daily decision: gap of the execution day, shadow decisions, checks, orders, log rows and history entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import sure
from ..functions.rules import BASE, FLIP, LONG_GAP, SHORT_ONLY, SKIP
from .selection import KEY, apply_decision, no_trade_class

c = F.col
MIN_LOT = 10
#: The fields that all orders of a document share, and the words of its format.
COMMON = {"market": "TKY", "price_type": "market", "validity": "this_day", "skip_estimate": True, "trade_password": ""}
AT_OPEN, LOTS = "寄成", "口"
#: The columns of a log row.
LOG_FIELDS = (
    "created_at", "signal_reference_us_date", "execution_target_jp_date", "execution_target_jp_date_source", "operation_mode", "trade_signal_strength", "tradeable", "trade_block_reason", "min_signal_spread_used", "min_long_signal_used", "max_short_signal_used",
    "min_adopted_long_count_used", "min_adopted_short_count_used", "candidate_long_count", "candidate_short_count", "adopted_long_count", "adopted_short_count", "freshness_ok", "latest_dates_aligned", "usable_us_tickers", "usable_jp_tickers", "n_long", "n_short",
    "long_tickers", "short_tickers", "long_contribution_pct", "short_contribution_pct", "total_return_pct", "details_json", "trend_regime", "vol_regime", "rotation_regime", "regime_warning", "regime_warning_reason", "candidate_signal_strength", "adopted_signal_strength",
    "threshold_gap_long_max", "threshold_gap_short_max", "no_trade_classification",
)


def named(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """``rows`` with the sector of each ticker, the ticker itself where ``sectors(ticker, sector)`` has none."""
    return rows.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", "ticker"))


def plan(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """One row for each long and short position: weight, price, least purchase, lots and their purchase.

    Prices are rounded first (half to even), and lots taken from the rounded ones so that a position is worth about the
    dearest one of the date.  A position without a price has neither.
    """
    by_date, side = Window.partitionBy(*KEY), Window.partitionBy(*KEY, "position")
    rows = positions.where("position <> 'neutral'").join(prices.select(*KEY, "ticker", "close"), [*KEY, "ticker"], "left")
    rows = rows.withColumn("latest_price", F.bround("close").cast("long"))
    lots = F.when(c("latest_price") > 0, F.greatest(F.lit(1).cast("long"), F.bround(F.max("latest_price").over(by_date) / c("latest_price")).cast("long")))
    rows = rows.withColumns({"weight_pct": F.round(100 / F.count("*").over(side), 1), "min_purchase": F.bround(c("close") * MIN_LOT).cast("long"), "lots": lots})
    return rows.withColumn("purchase", c("lots") * c("latest_price")).drop("close")


def order_documents(dates: DataFrame, planned: DataFrame) -> DataFrame:
    """A JSON document of orders for each of ``dates(universe_id, date)``, without orders where nothing is planned.

    ``planned``: plan with signal and sector; longs come first, each side by falling signal and ticker.
    """
    long = c("position") == "LONG"
    lots = F.coalesce("lots", F.lit(1))
    order = F.struct(
        F.regexp_replace("ticker", r"\.T", "").alias("stock_code"), F.when(long, "genbutsu_buy").otherwise("shinyo_sell").alias("order_kind"), lots.alias("quantity"), F.when(~long, "day").alias("payment_limit"),
        F.lit(AT_OPEN).alias("nariyuki_condition"), F.lit(False).alias("sor_enabled"), F.concat("position", F.lit(" / "), "sector", F.lit(" / "), lots, F.lit(LOTS)).alias("note"),
    )
    ranked = F.struct(F.when(long, 0).otherwise(1).alias("side"), (-c("signal")).alias("s"), "ticker", order.alias("order"))
    orders = planned.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["order"]).alias("orders"))
    common = F.struct(*[F.lit(v).alias(k) for k, v in COMMON.items()])
    rows = dates.select(*KEY).distinct().join(orders, KEY, "left")
    none = F.array().cast(dict(rows.dtypes)["orders"])
    return rows.select(*KEY, F.to_json(F.struct(common.alias("common"), F.coalesce("orders", none).alias("orders"))).alias("payload"))


def pick_gaps(gaps: DataFrame, wanted: DataFrame) -> DataFrame:
    """The gaps of ``wanted(universe_id, execution_date)``: those of that date, or of the last date there is."""
    dates = gaps.select(*KEY).distinct()
    hit = F.struct(sure(c("date") == c("execution_date")).alias("hit"), "date")
    picked = wanted.join(dates, "universe_id").groupBy("universe_id", "execution_date").agg(F.max(hit).alias("h")).select("universe_id", "execution_date", c("h.date").alias("date"))
    return picked.join(gaps.select(*KEY, "ticker", "gap"), KEY)


def contexts(positions: DataFrame, gaps: DataFrame, stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The rule context of each signal date of a daily run.

    Gaps are those that the run picks (``gaps``: universe_id, date, ticker, gap): over all tickers, over the candidate longs
    and over the candidate shorts; a ticker that is taken short is no long candidate.  The candidates' strength is that of
    ``stats``, to six places, and unknown if it is zero.  ``labels`` has the regimes; a date without any has the middle ones.
    """
    rows = positions.join(gaps.select(*KEY, "ticker", "gap"), [*KEY, "ticker"], "left")
    turned = (c("position") == "SHORT") & c("cand_long") & (c("signal") >= c("long_threshold"))
    sides = rows.groupBy(*KEY).agg(F.avg(F.when(c("cand_long") & ~turned, c("gap"))).alias("long_gap"), F.avg(F.when(c("cand_short"), c("gap"))).alias("short_gap"))
    overall = gaps.groupBy(*KEY).agg(F.avg("gap").alias("open_gap"))
    strength = F.round("candidate_strength", 6)
    out = stats.select(*KEY, F.when(strength != 0, strength).alias("candidate_signal_strength")).join(overall, KEY, "left").join(sides, KEY, "left")
    label = lambda x, other: F.coalesce(x, F.lit(other)).alias(x)
    labels = labels.select(*KEY, "trend_regime", "vol_regime", "rotation_regime")
    return out.join(labels, KEY, "left").select(
        *KEY, "open_gap", "long_gap", "short_gap", "candidate_signal_strength", label("trend_regime", "sideways"), label("vol_regime", "mid_vol"), label("rotation_regime", "mid_rotation"),
    )


def after_rule(positions: DataFrame, decided: DataFrame, gaps: DataFrame) -> DataFrame:
    """Positions after the decision of ``decided(universe_id, date, strategy)``, with the one before in ``position_before``.

    A date without a decision keeps its positions; a ticker without a gap keeps its position.
    """
    rows = positions.join(decided.select(*KEY, "strategy"), KEY, "left").join(gaps.select(*KEY, "ticker", c("gap").alias("run_gap")), [*KEY, "ticker"], "left")
    after = F.coalesce(apply_decision(c("position"), c("strategy"), c("run_gap")), "position")
    return rows.withColumns({"position_before": c("position"), "position": after})


def taken(after: DataFrame) -> DataFrame:
    """Counts and strength of what a date's positions after the rule hold; a missing side has strength 0."""
    mean = lambda s: F.avg(F.when(c("position") == s, c("signal")))
    out = after.groupBy(*KEY).agg(F.count_if(c("position") == "LONG").alias("n_long"), F.count_if(c("position") == "SHORT").alias("n_short"), mean("LONG").alias("l"), mean("SHORT").alias("s"))
    return out.select(*KEY, "n_long", "n_short", F.coalesce(c("l") - c("s"), F.lit(0.0)).alias("strength_after"))


def action(strategy: Column) -> Column:
    """What a decision does: skip, override (another direction or filter than the default) or execute."""
    return F.when(strategy == SKIP, "skip").when(strategy.isin(FLIP, SHORT_ONLY, LONG_GAP), "override").otherwise("execute")


def class_after(strategy: Column, before: Column, n_long: Column, n_short: Column, long_gap: Column, short_gap: Column) -> Column:
    """The classification that a log row has: with the counts after the rule; a rule that changes nothing keeps that of the
    signal."""
    kept = strategy.isNull() | (strategy == BASE)
    return F.when(kept, before).otherwise(no_trade_class(n_long, n_short, long_gap, short_gap, F.lit(False)))


def shadow_decisions(decided: DataFrame, active: str) -> DataFrame:
    """For each date the active rule's strategy and those of all other rules, as a map."""
    rule = F.struct(c("rule_id"), c("strategy"))
    others = F.map_from_entries(F.array_sort(F.collect_list(F.when(c("rule_id") != active, rule))))
    return decided.groupBy(*KEY).agg(F.max(F.when(c("rule_id") == active, c("strategy"))).alias("active_strategy"), others.alias("shadow"))


def skip_override(rows: DataFrame) -> DataFrame:
    """A skip of the active rule overrides what else forbids or allows a trade.

    ``rows``: tradeable, block_reason, no_trade, adopted_long, adopted_short (all before the rule) and active_strategy.
    """
    skip = sure(c("active_strategy") == SKIP)
    both = (c("adopted_long") >= 1) & (c("adopted_short") >= 1)
    return rows.withColumns({
        "tradeable": ~skip & c("tradeable"), "block_reason": F.when(skip, "strategy_rule_skip").otherwise(c("block_reason")),
        "no_trade": F.when(skip & both, "strategy_rule_skip_with_candidates").when(skip, "strategy_rule_skip").otherwise(c("no_trade")),
    })


def execution_checks(rows: DataFrame) -> DataFrame:
    """The checks of each date in their order: number, level and message.

    ``rows``: freshness_ok, latest_lead, latest_lag, fill_policy, filled_cells, n_long, n_short, candidate_long,
    candidate_short, min_long, max_short, price_mode, trend_regime, vol_regime, regime_warning.  A regime without a warning
    has no check.
    """
    text = lambda *parts: F.concat_ws("", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    level = lambda good: F.when(good, "ok").otherwise("warn")
    fresh, strict = sure(c("freshness_ok")), sure(c("fill_policy") == "strict")
    checks = (
        (level(fresh), text("data freshness: ", F.when(fresh, "OK").otherwise("Warning"), " (lead=", c("latest_lead"), ", lag=", c("latest_lag"), ")")),
        (level(strict), text("fill policy: ", c("fill_policy"), " / filled cells=", c("filled_cells"))),
        (F.lit("ok"), text("long/short: ", c("n_long"), " / ", c("n_short"), " (candidates: ", c("candidate_long"), " / ", c("candidate_short"), ")")),
        (F.lit("ok"), text("thresholds: long>=", c("min_long"), ", short<=", c("max_short"))),
        (level(c("n_short") == 0), F.lit("shorts need margin or borrowed stock")),
        (F.lit("ok"), text("price mode: ", c("price_mode"))),
        (F.when(sure(c("regime_warning")), "warn"), text("regime: ", c("trend_regime"), " x ", c("vol_regime"))),
    )
    each = F.posexplode(F.filter(F.array(*[F.struct(a.alias("level"), b.alias("message")) for a, b in checks]), lambda x: x["level"].isNotNull()))
    return rows.select(*KEY, each.alias("n", "check")).select(*KEY, "n", "check.level", "check.message")


def tickers(planned: DataFrame) -> DataFrame:
    """Sorted long and short tickers of each date."""
    side = lambda s: F.array_sort(F.collect_list(F.when(c("position") == s, c("ticker"))))
    return planned.groupBy(*KEY).agg(side("LONG").alias("long_tickers"), side("SHORT").alias("short_tickers"))


def log_rows(rows: DataFrame, created_at: Column) -> DataFrame:
    """The log's columns in their order; tickers are joined by ``|``, reasons and details are JSON lists, what ``rows`` lacks
    is null, counts are those of the tickers."""
    have = set(rows.columns)

    def field(name: str) -> Column:
        if name == "created_at":
            return created_at
        if name in ("n_long", "n_short"):
            return F.size(name.removeprefix("n_") + "_tickers")
        if name in ("long_tickers", "short_tickers") and name in have:
            return F.array_join(name, "|")
        if name == "regime_warning_reason" and name in have:
            quoted = F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
            return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
        if name == "details_json" and name not in have:
            return F.lit("[]")
        return c(name) if name in have else F.lit(None).cast("string")

    return rows.select(*[field(n).alias(n) for n in LOG_FIELDS])


def append_log(rows: DataFrame, path: str) -> None:
    """Appends log rows as CSV files, each with the header."""
    rows.select(*LOG_FIELDS).write.mode("append").option("header", True).csv(path)


#: Where the clock of a daily run stands.
ZONE = "Asia/Tokyo"


def recorded(rows: DataFrame, now: Column) -> DataFrame:
    """Adds the date and the time at which an entry is recorded, by the clock of the run: ``now`` is a time in UTC."""
    here = F.from_utc_timestamp(now, ZONE)
    return rows.withColumns({"cached_date": F.to_date(here), "recorded_at": F.date_format(here, "yyyy/MM/dd HH:mm:ss")})


def history(rows: DataFrame) -> DataFrame:
    """Adds the key by which an entry counts once: compact JSON of dates, tradeability and sorted tickers.

    ``rows``: signal_date, exec_date (text or null), tradeable, long_tickers, short_tickers (arrays).
    """
    key = F.struct(c("signal_date").alias("signalDate"), c("exec_date").alias("execJpDate"), c("tradeable").alias("tradeable"), F.array_sort("long_tickers").alias("longTickers"), F.array_sort("short_tickers").alias("shortTickers"))
    return rows.withColumn("dedupe_key", F.to_json(key, {"ignoreNullFields": "false"}))


def append_history(entries: DataFrame, path: str) -> None:
    """Appends those entries as JSON lines whose key the history does not have yet; a repeated run appends nothing."""
    spark = entries.sparkSession
    fresh = entries.dropDuplicates(["dedupe_key"])
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        fresh = fresh.join(spark.read.schema("dedupe_key string").json(path), "dedupe_key", "left_anti")
    fresh.write.mode("append").option("ignoreNullFields", False).json(path)
