"""Returns, gaps and the joint lead and lag matrix, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def series() -> Window:
    """Each ticker in the order of dates."""
    return Window.partitionBy("universe_id", "ticker").orderBy("date")


def returns(dense: DataFrame) -> DataFrame:
    """Adds every return of a dense panel, on each side's own calendar; all come from one sort by ticker and date.

    ret_cc pads missing closes with the last one, ret_cc_nopad does not; gap is the open over the previous close,
    next_gap the next open over this close; ret_oo and ret_hold begin at the next open; next_oc and next_cc are the
    next session's returns.
    """
    padded = dense.withColumn("close_pad", F.last("close", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0)))
    lag, lead = (lambda x: F.lag(x, 1).over(series())), (lambda x, n=1: F.lead(x, n).over(series()))
    out = padded.withColumns({
        "ret_cc": c("close_pad") / lag("close_pad") - 1, "ret_cc_nopad": c("close") / lag("close") - 1, "ret_oc": c("close") / c("open") - 1,
        "gap": c("open") / lag("close") - 1, "next_gap": lead("open") / c("close") - 1, "ret_oo": lead("open", 2) / lead("open") - 1, "ret_hold": lead("close", 2) / lead("open") - 1,
    })
    return out.withColumns({"next_oc": lead("ret_oc"), "next_cc": lead("ret_cc")})


def covered(rets: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Rows of dates that both sides have, with at least ``ratio`` of each side's tickers present."""
    # a dense panel has a row for every ticker of the side
    days = rets.groupBy("universe_id", "date", "side").agg(F.count("ret_cc").alias("n"), F.count("*").alias("names"))
    good = days.groupBy("universe_id", "date").agg(F.countDistinct("side").alias("sides"), F.min((c("n") >= ratio * c("names")).cast("int")).alias("ok")).where("sides = 2 and ok = 1")
    return rets.join(good.select("universe_id", "date"), ["universe_id", "date"], "left_semi").select("universe_id", "date", "ticker", "ord", "side", F.col("ret_cc").alias("ret"))


def complete(rows: DataFrame) -> DataFrame:
    """Without the dates on which a return is missing."""
    bad = rows.groupBy("universe_id", "date").agg(F.count_if(c("ret").isNull()).alias("gaps")).where("gaps > 0")
    return rows.join(bad, ["universe_id", "date"], "left_anti")


def joint(rets: DataFrame, ratio: float = 0.8, fill: str = "strict", width: int = 5) -> DataFrame:
    """The joint matrix; ``ratio`` 0 asks only for dates that both sides have.  ``rolling_mean`` fills a missing return by the mean of the present ones of the last ``width``
    rows; then, as with ``strict``, dates with a missing return go."""
    rows = covered(rets, ratio)
    if fill == "rolling_mean":
        rows = rows.withColumn("ret", F.coalesce("ret", F.avg("ret").over(series().rowsBetween(1 - width, 0))))
    elif fill != "strict":
        raise ValueError(f"unknown fill policy {fill!r}")
    return complete(rows)


def joint_quality(rets: DataFrame, ratio: float = 0.8) -> DataFrame:
    """One row per universe: rows and cells before and after filling, tickers without any return, effective dates."""
    rows = covered(rets, ratio)
    filled = rows.withColumn("f", F.coalesce("ret", F.avg("ret").over(series().rowsBetween(-4, 0))))
    names = rows.groupBy("universe_id", "side", "ticker").agg(F.count("ret").alias("n"))
    tickers = names.groupBy("universe_id").agg(
        F.count_if((c("side") == "lead") & (c("n") > 0)).alias("usable_lead"), F.count_if((c("side") == "lag") & (c("n") > 0)).alias("usable_lag"), F.count_if(c("n") == 0).alias("dropped"),
    )
    cells = filled.groupBy("universe_id").agg(F.countDistinct("date").alias("covered_dates"), F.count_if(c("ret").isNull() & c("f").isNotNull()).alias("filled_cells"))
    kept = complete(rows).groupBy("universe_id").agg(F.countDistinct("date").alias("joint_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return tickers.join(cells, "universe_id").join(kept, "universe_id", "left")


def quality_records(rets: DataFrame, prices: DataFrame, sample: tuple[str | None, str | None] = (None, None), mode: str = "raw", ratio: float = 0.8, width: int = 5) -> DataFrame:
    """The quality record of the joint matrix, one row for each universe and fill policy.

    ``prices(universe_id, date, price_mode)`` is the store; its date range is that of the mode.  Both policies come from one
    scan of the covered rows: a missing cell is filled by the policy or its date goes.  A universe without a covered date
    has no row; sample bounds that aren't given are those of the joint rows.
    """
    rows = covered(rets, ratio).withColumn("mean", F.avg("ret").over(series().rowsBetween(1 - width, 0)))
    rows = rows.select("*", F.explode(F.array(F.lit("strict"), F.lit("rolling_mean"))).alias("fill_policy"))
    rows = rows.withColumn("value", F.when(c("fill_policy") == "strict", c("ret")).otherwise(F.coalesce("ret", "mean")))
    keys = ["universe_id", "fill_policy"]
    days = rows.groupBy(*keys, "date").agg(F.count_if(c("value").isNull()).alias("gaps"), F.count_if(c("ret").isNull() & c("value").isNotNull()).alias("filled"))
    kept = lambda x: F.when(c("gaps") == 0, x)
    out = days.groupBy(*keys).agg(F.sum("filled").alias("filled_cells"), F.min(kept(c("date"))).alias("effective_start"), F.max(kept(c("date"))).alias("effective_end"), F.count(kept(c("date"))).alias("joint_rows"))
    names = rows.where("fill_policy = 'strict'").groupBy("universe_id", "side", "ticker").agg(F.count("ret").alias("n"))
    side = lambda s, x: F.array_sort(F.collect_list(F.when((c("side") == s) & (c("n") == 0), x)))
    names = names.groupBy("universe_id").agg(side("lead", c("ticker")).alias("dropped_lead"), side("lag", c("ticker")).alias("dropped_lag"), F.count_if(c("side") == "lead").alias("usable_lead"), F.count_if(c("side") == "lag").alias("usable_lag"))
    held = prices.groupBy("universe_id").agg(F.min(F.when(c("price_mode") == mode, c("date"))).alias("cache_first_date"), F.max(F.when(c("price_mode") == mode, c("date"))).alias("cache_last_date"), (F.countDistinct("ticker", "date", "price_mode") == F.count("*")).alias("cache_isolated"))
    bound = lambda given, other: F.coalesce(F.lit(given).cast("date"), c(other))
    return out.join(names, "universe_id").join(held, "universe_id", "left").select(
        "universe_id", bound(sample[0], "effective_start").alias("sample_start"), bound(sample[1], "effective_end").alias("sample_end"), "fill_policy", F.lit(mode).alias("price_mode"), "filled_cells", "dropped_lead", "dropped_lag", "effective_start", "effective_end", "joint_rows",
        c("joint_rows").alias("effective_window_days"), "usable_lead", "usable_lag", "cache_first_date", "cache_last_date", F.lit(mode).alias("cache_price_mode"), F.coalesce("cache_isolated", F.lit(False)).alias("cache_isolated"),
    )


def effective_windows(joint_: DataFrame, dates: DataFrame, length: int) -> DataFrame:
    """universe_id, date, joint_rows, effective_window_days: rows of the joint matrix up to each of ``dates``, and how many of
    them its window of ``length`` rows has."""
    days = joint_.select("universe_id", "date").distinct().withColumn("row", F.lit(1)).unionByName(dates.select("universe_id", "date").distinct().withColumn("row", F.lit(0)))
    w = Window.partitionBy("universe_id").orderBy("date", F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("joint_rows", F.sum("row").over(w)).where("row = 0")
    return days.select("universe_id", "date", "joint_rows", F.least("joint_rows", F.lit(length).cast("long")).alias("effective_window_days"))


def rolling_zscore(rows: DataFrame, length: int) -> DataFrame:
    """Each return standardised by the ``length`` rows strictly before it (population deviation)."""
    w = series().rowsBetween(-length, -1)
    out = rows.withColumns({"n": F.count("ret").over(w), "mu": F.avg("ret").over(w), "sd": F.stddev_pop("ret").over(w)})
    return out.where(c("n") == length).select("universe_id", "date", "ticker", "ord", "side", ((c("ret") - c("mu")) / (c("sd") + 1e-10)).alias("z"))


def correlations(rows: DataFrame) -> DataFrame:
    """Correlation of each pair of tickers over all rows, upper triangle; pairs come from an equi-join on the date.

    A ticker that never moves has none."""
    a, b = rows.select("universe_id", "date", c("ord").alias("i"), c("ret").alias("x")), rows.select("universe_id", "date", c("ord").alias("j"), c("ret").alias("y"))
    corr = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    return a.join(b, ["universe_id", "date"]).where("i < j").groupBy("universe_id", "i", "j").agg(corr.alias("corr"), F.count("*").alias("n"))


def rolling_correlations(rows: DataFrame, length: int) -> DataFrame:
    """As ``correlations``, over the ``length`` rows strictly before each date."""
    a, b = rows.select("universe_id", "date", c("ord").alias("i"), c("ret").alias("x")), rows.select("universe_id", "date", c("ord").alias("j"), c("ret").alias("y"))
    w = Window.partitionBy("universe_id", "i", "j").orderBy("date").rowsBetween(-length, -1)
    pairs = a.join(b, ["universe_id", "date"]).where("i < j")
    corr = F.try_divide(F.covar_samp("x", "y").over(w), F.stddev_samp("x").over(w) * F.stddev_samp("y").over(w))
    return pairs.select("universe_id", "date", "i", "j", corr.alias("corr"), F.count("*").over(w).alias("n")).where(c("n") == length).drop("n")
