"""Decision rules as column expressions over the context of a signal date.

A context has open_gap, long_gap, short_gap, candidate_signal_strength, trend_regime, vol_regime and rotation_regime; any
may be null.  A rule is a strategy column; ``skip`` means no trade that day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import abs_gt, abs_le, ge, sure

SKIP, BASE, GAP, LONG_GAP, FLIP, SHORT_ONLY = "skip", "curr_oc", "gap_ovht_oc", "lgap_oc", "long_flip_oc", "short_only_oc"
c = F.col


def _is(name: str, *values: str) -> Column:
    return sure(c(name).isin(*values))


def rule_406() -> Column:
    return F.when(~abs_le(c("open_gap"), 0.015), SKIP).when(_is("rotation_regime", "weak_rotation"), SKIP).when(abs_gt(c("short_gap"), 0.010), FLIP).otherwise(GAP)


def rule_406_no_flip() -> Column:
    return F.when(~abs_le(c("open_gap"), 0.015), SKIP).when(_is("rotation_regime", "weak_rotation"), SKIP).otherwise(GAP)


def rule_399() -> Column:
    return F.when(~ge(c("candidate_signal_strength"), 0.3), SKIP).when(_is("vol_regime", "high_vol") & abs_gt(c("open_gap"), 0.005), FLIP).otherwise(GAP)


def _active() -> Column:
    return _is("vol_regime", "high_vol") | _is("rotation_regime", "strong_rotation")


def rule_13() -> Column:
    return F.when(~_active(), SKIP).when(abs_gt(c("short_gap"), 0.010), SHORT_ONLY).otherwise(GAP)


def rule_87() -> Column:
    return F.when(~_active(), SKIP).when(abs_gt(c("short_gap"), 0.0075), LONG_GAP).otherwise(GAP)


def rule_1357() -> Column:
    return F.when(~_is("trend_regime", "uptrend", "downtrend"), SKIP).when(abs_gt(c("open_gap"), 0.0075), LONG_GAP).otherwise(GAP)


RULES: dict[str, Callable[[], Column]] = {f.__name__: f for f in (rule_406, rule_406_no_flip, rule_399, rule_13, rule_87, rule_1357)}

DESCRIPTIONS = {
    "rule_406": "skips large open gaps and weak rotation; turns longs when the shorts gap",
    "rule_406_no_flip": "skips large open gaps and weak rotation",
    "rule_399": "needs a strong signal; turns longs in high volatility with an open gap",
    "rule_13": "needs high volatility or strong rotation; shorts only when the shorts gap",
    "rule_87": "needs high volatility or strong rotation; filters long gaps when the shorts gap",
    "rule_1357": "needs a trend; filters long gaps when the market gaps",
    "rolling3_selector": "each year's rule from a table, else rule_406",
}


def get_rule(rule_id: str) -> Column:
    if rule_id not in RULES:
        raise ValueError(f"unknown rule {rule_id!r}; known: {', '.join(RULES)}")
    return RULES[rule_id]()


def rolling_selector(year_rules: dict[int, str], year: Column, fallback: str = "rule_406") -> Column:
    """The strategy of the rule that the table names for the year, of ``fallback`` else; a rule that isn't known skips."""
    out = None
    for y, rule in sorted(year_rules.items()):
        decided = get_rule(rule) if rule in RULES else F.lit(SKIP)
        out = F.when(year == y, decided) if out is None else out.when(year == y, decided)
    last = get_rule(fallback) if fallback in RULES else F.lit(SKIP)
    return last if out is None else out.otherwise(last)
