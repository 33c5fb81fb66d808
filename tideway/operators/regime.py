"""Regime labels of each date of the lag side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
TREND = 0.03


def quantile_label(x: Column, lo: Column, hi: Column, low: str, mid: str, high: str) -> Column:
    """Low wins where both bounds are met; null is mid."""
    return F.when(x <= lo, low).when(x >= hi, high).otherwise(mid)


def regimes(rets: DataFrame, signals: DataFrame, width: int = 20, least: int = 10) -> DataFrame:
    """trend, volatility and rotation labels with their measures; the cut-offs are quantiles of the whole sample."""
    proxy = rets.where("side = 'lag'").groupBy("universe_id", "date").agg(F.avg("ret_cc").alias("m"))
    w = Window.partitionBy("universe_id").orderBy("date").rowsBetween(1 - width, 0)
    enough = F.count("m").over(w) >= least
    proxy = proxy.select("universe_id", "date", F.when(enough, F.sum("m").over(w)).alias("cum20_return"), F.when(enough, F.stddev_samp("m").over(w)).alias("vol20"))
    rotation = signals.groupBy("universe_id", "date").agg(F.stddev_samp("signal").alias("rotation_std"))
    rows = proxy.join(rotation, ["universe_id", "date"], "full")
    q = lambda x: F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    w = Window.partitionBy("universe_id")  # a row per date, so few that the quantiles need no join
    rows = rows.withColumns({"v": q("vol20").over(w), "r": q("rotation_std").over(w)})
    return rows.select(
        "universe_id", "date", F.when(c("cum20_return") > TREND, "uptrend").when(c("cum20_return") < -TREND, "downtrend").otherwise("sideways").alias("trend_regime"),
        quantile_label(c("vol20"), c("v")[0], c("v")[1], "low_vol", "mid_vol", "high_vol").alias("vol_regime"),
        quantile_label(c("rotation_std"), c("r")[0], c("r")[1], "weak_rotation", "mid_rotation", "strong_rotation").alias("rotation_regime"), "cum20_return", "vol20", "rotation_std",
    )


def warning_reasons(trend: Column, vol: Column) -> Column:
    down, high = trend == "downtrend", vol == "high_vol"
    return F.filter(F.array(F.when(down, F.lit("downtrend")), F.when(high, F.lit("high_vol")), F.when(down & high, F.lit("downtrend_high_vol"))), lambda x: x.isNotNull())


def warnings(regime: DataFrame) -> DataFrame:
    reasons = warning_reasons(c("trend_regime"), c("vol_regime"))
    return regime.select("universe_id", "date", (F.size(reasons) > 0).alias("regime_warning"), F.array_join(reasons, "|").alias("reasons"))


def snapshots(regime: DataFrame, wanted: DataFrame) -> DataFrame:
    """The labels of ``wanted(universe_id, date)``; a date that has none is sideways, mid_vol and mid_rotation."""
    rows = wanted.select("universe_id", "date").join(regime.select("universe_id", "date", "trend_regime", "vol_regime", "rotation_regime"), ["universe_id", "date"], "left")
    for name, label in (("trend_regime", "sideways"), ("vol_regime", "mid_vol"), ("rotation_regime", "mid_rotation")):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(label)))
    return rows
