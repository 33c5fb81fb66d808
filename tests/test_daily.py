"""The daily run: execution dates, what a run knows, the rule's context, and what is held after its decision."""

import datetime as dt
import json
import random

import pytest
from oracle import both
from pyspark.sql import functions as F

from tideway.functions.rules import RULES
from tideway.operators import daily, portfolio, selection, sessions
from tideway.plans import market

c = F.col
NEW = ("calendar_sources", "freshness_daily", "gaps_as_of", "strategy_context_daily", "daily_positions", "tradeability_settings", "daily_log", "lots_plan")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, sf, name):
    got, want = both(spark, sf, market.queries()[name], market.oracle_sql()[name])
    assert got == want and (got or name == "lots_plan")


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)  # a Monday


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_execution_dates_and_their_sources(spark):
    calendar = frame(spark, [("u", day(i)) for i in (0, 5, 45, 245, 745)] + [("u", day(5))], "universe_id string, date date")
    dates = frame(spark, [("u", day(i)) for i in (-3, 0, 4, 5, 45, 245, 745, 749, 750)] + [("none", day(4)), ("none", day(0)), ("u", day(0))], "universe_id string, date date")
    got = {(r.universe_id, r.date): (r.execution_date, r.source, r.horizon) for r in sessions.execution_dates(dates, calendar).collect()}
    known = lambda i, h: (day(i), "jpx_calendar", h)
    fallback = lambda i: (day(i), "weekday_fallback", None)
    assert got == {
        ("u", day(-3)): known(0, 14), ("u", day(0)): known(5, 14), ("u", day(4)): known(5, 14), ("u", day(5)): known(45, 60), ("u", day(45)): known(245, 366), ("u", day(245)): (None, "jpx_calendar_unavailable", None),
        ("u", day(745)): fallback(746), ("u", day(749)): fallback(750), ("u", day(750)): fallback(751), ("none", day(4)): fallback(7), ("none", day(0)): fallback(1),
    }
    for i in range(740, 760):
        later = next(day(i + k) for k in (1, 2, 3) if day(i + k).weekday() < 5)
        assert spark.range(1).select(sessions.next_weekday(F.lit(day(i)))).first()[0] == later


def test_gaps_of_the_execution_date_or_the_last_before_it(spark):
    gaps = frame(spark, [("u", day(i), t, i + k / 10) for i in (0, 2, 9) for k, t in enumerate("AB")], "universe_id string, date date, ticker string, gap double")
    runs = frame(spark, [("u", day(0), day(2)), ("u", day(1), day(2)), ("u", day(2), day(5)), ("u", day(3), None), ("u", day(4), day(-1)), ("u", day(9), day(10)), ("other", day(0), day(2))], "universe_id string, date date, execution_date date")
    got = {}
    for r in sessions.gaps_as_of(gaps, runs).collect():
        got.setdefault((r.universe_id, r.date), set()).add((r.gap_date, r.ticker, r.gap))
    row = lambda i: {(day(i), "A", float(i)), (day(i), "B", i + 0.1)}
    assert got == {("u", day(0)): row(2), ("u", day(1)): row(2), ("u", day(2)): row(2), ("u", day(3)): row(9), ("u", day(9)): row(9)}


@pytest.mark.parametrize("seed", range(3))
def test_what_a_run_knows(spark, seed):
    rng = random.Random(seed)
    wanted = [("u", "lead", "L1"), ("u", "lead", "L2"), ("u", "lag", "G1"), ("u", "lag", "G2"), ("u", "lag", "new")]
    tickers = wanted[:4] if seed else wanted
    panel = [("u", day(i), t, s, rng.choice((None, 1.0, 2.0)), rng.choice((None, 1.0, 2.0, 3.0))) for i in range(12) for _, s, t in tickers if rng.random() < (0.9 if seed < 2 else 0.5) and (t != "new" or i > 4)]
    runs = [("u", day(i), rng.choice((None, day(i + 1), day(i + 2)))) for i in range(0, 14, 2)]
    known = sessions.known_prices(frame(spark, panel, "universe_id string, date date, ticker string, side string, open double, close double"), frame(spark, wanted, "universe_id string, side string, ticker string"), frame(spark, runs, "universe_id string, date date, execution_date date"))
    got = {r.date: r for r in sessions.freshness_as_of(known).collect()}
    assert len(got) == len(runs)
    for _, d, e in runs:
        last, rows = {}, 0
        for _, s, t in wanted:
            own = [p[1] for p in panel if p[2] == t and (p[4] or p[5]) and p[1] <= (d if s == "lead" else e or d)]
            last[t], rows = max(own, default=None), rows + len(own)
        side = lambda s: [last[t] for _, x, t in wanted if x == s and last[t]]  # noqa: E731, B023
        missing, stale = sorted(t for t in last if last[t] is None), sorted(t for t in last if last[t] and last[t] < d)
        aligned = all(side(s) and min(side(s)) == max(side(s)) for s in ("lead", "lag"))
        r = got[d]
        assert (r.missing, r.stale, r.dates_aligned, r.rows) == (missing, stale, aligned, rows)
        assert r.freshness_ok == (not missing and not stale and bool(side("lead")) and bool(side("lag"))) and r.signal_ready == (not missing and not stale and aligned)
        assert (r.lead_max, r.lag_min) == (max(side("lead"), default=None), min(side("lag"), default=None))


def test_usable_tickers_grow_with_the_date(spark):
    covered = frame(spark, [("u", day(i), t, s, None if i < first else 0.1) for t, s, first in (("a", "lead", 0), ("b", "lead", 3), ("c", "lag", 2)) for i in range(6)], "universe_id string, date date, ticker string, side string, ret double")
    runs = frame(spark, [("u", day(i)) for i in range(-1, 5)], "universe_id string, date date")
    got = {r.date: (r.usable_lead, r.usable_lag) for r in sessions.usable_as_of(covered, runs).collect()}
    assert got == {day(-1): (0, 0) if got[day(-1)] != (None, None) else (None, None), day(0): (1, 0), day(1): (1, 0), day(2): (1, 1), day(3): (2, 1), day(4): (2, 1)}


SIGNALS = dict(zip(("1617.T", "1618.T", "1619.T", "1620.T", "1621.T", "1622.T", "1623.T", "1624.T", "1625.T"), (0.40, 0.35, 0.30, 0.10, 0.0, -0.10, -0.30, -0.35, -0.40)))


def one_day(spark, gaps, labels=("sideways", "mid_vol", "mid_rotation"), values=SIGNALS):
    """Positions, contexts and decisions of one date with the given gaps of its run."""
    signal = frame(spark, [("u", day(0), t, v) for t, v in values.items()], "universe_id string, date date, ticker string, signal double")
    pos = selection.positions(selection.quantile_masks(signal))
    picked = frame(spark, [("u", day(0), t, g) for t, g in gaps.items()], "universe_id string, date date, ticker string, gap double")
    regime = frame(spark, [("u", day(0), *labels)], "universe_id string, date date, trend_regime string, vol_regime string, rotation_regime string")
    context = daily.contexts(pos, picked, selection.candidate_stats(pos), regime)
    return pos, picked, context, portfolio.decisions(context, {n: f() for n, f in RULES.items()})


def held(spark, rule, gaps, **more):
    pos, picked, context, decided = one_day(spark, gaps, **more)
    after = daily.after_rule(pos, decided.where(c("rule_id") == rule), picked)
    rows = after.collect()
    return context.first(), rows[0].strategy, {r.ticker: r.position for r in rows}, {r.ticker: r.position_before for r in rows}, after


def test_a_context_has_the_gaps_of_the_run_and_the_strength_of_the_candidates(spark):
    gaps = {t: k / 1000 for k, t in enumerate(SIGNALS)}
    context, *_ = held(spark, "rule_399", gaps)
    assert context.candidate_signal_strength == pytest.approx(0.7) and context.open_gap == pytest.approx(0.004) and context.long_gap == pytest.approx(0.001) and context.short_gap == pytest.approx(0.007)
    pos, picked, context, decided = one_day(spark, {}, values=dict.fromkeys(SIGNALS, 0.0))
    row = context.first()
    assert (row.open_gap, row.long_gap, row.short_gap, row.candidate_signal_strength) == (None,) * 4 and row.vol_regime == "mid_vol"
    # a ticker that is a candidate of both sides is taken short, and no long candidate then
    tied, *_ = held(spark, "rule_406", dict.fromkeys(SIGNALS, 0.01), values=dict.fromkeys(SIGNALS, 0.0))
    assert tied.long_gap is None and tied.short_gap == pytest.approx(0.01)


def test_rule_399_trades_on_strong_signals_only(spark):
    gaps = dict.fromkeys(SIGNALS, 0.0)
    _, strategy, position, before, after = held(spark, "rule_399", gaps)
    assert strategy == "gap_ovht_oc" and position == before
    assert sorted(t for t, p in position.items() if p == "LONG") == ["1617.T", "1618.T", "1619.T"] and sorted(t for t, p in position.items() if p == "SHORT") == ["1623.T", "1624.T", "1625.T"]
    assert tuple(daily.taken(after).first())[2:] == (3, 3, pytest.approx(0.7))
    _, strategy, position, *_ = held(spark, "rule_399", gaps | {"1617.T": 0.02, "1618.T": 0.006, "1624.T": -0.02, "1625.T": 0.02})
    assert strategy == "gap_ovht_oc" and [t for t, p in position.items() if p == "LONG"] == ["1619.T"] and sorted(t for t, p in position.items() if p == "SHORT") == ["1623.T", "1625.T"]
    _, strategy, position, *_ = held(spark, "rule_399", dict.fromkeys(SIGNALS, 0.006), labels=("sideways", "high_vol", "mid_rotation"))
    assert strategy == "long_flip_oc" and "LONG" not in position.values() and list(position.values()).count("SHORT") == 6
    weak = {t: v / 3 for t, v in SIGNALS.items()}
    _, strategy, position, before, after = held(spark, "rule_399", gaps, values=weak)
    assert strategy == "skip" and set(position.values()) == {"neutral"} and set(before.values()) == {"LONG", "SHORT", "neutral"}
    assert tuple(daily.taken(after).first())[2:] == (0, 0, 0.0)


def test_a_skip_leaves_no_orders_no_lots_and_no_tickers(spark):
    _, strategy, _, _, after = held(spark, "rule_406", dict.fromkeys(SIGNALS, 0.02))
    assert strategy == "skip"
    prices = frame(spark, [("u", day(0), t, 1000.0) for t in SIGNALS], "universe_id string, date date, ticker string, close double")
    sectors = frame(spark, [("1617.T", "foods")], "ticker string, sector string")
    planned = daily.plan(daily.named(after, sectors), prices)
    assert planned.count() == 0 and daily.tickers(planned).count() == 0
    assert json.loads(daily.order_documents(after, planned).first().payload)["orders"] == []
    _, _, _, _, after = held(spark, "rule_406", dict.fromkeys(SIGNALS, 0.012), labels=("sideways", "mid_vol", "mid_rotation"))
    planned = daily.plan(daily.named(after, sectors), prices)  # the shorts' gap turns the longs
    orders = json.loads(daily.order_documents(after, planned).first().payload)["orders"]
    assert len(orders) == 6 and {o["order_kind"] for o in orders} == {"shinyo_sell"} and {round(r.weight_pct, 1) for r in planned.collect()} == {16.7}


def test_every_reason_of_the_gate(spark):
    fine = {"freshness_ok": True, "dates_aligned": True, "usable_lead": 3, "usable_lag": 3, "execution_date": day(1), "source": "jpx_calendar", "candidate_long": 3, "candidate_short": 3, "adopted_long": 3, "adopted_short": 3, "trade_strength": 0.2}
    cases = [
        (None, {}), ("freshness_not_ok", {"freshness_ok": None, "dates_aligned": False}), ("cache_dates_not_aligned", {"dates_aligned": False, "usable_lag": 0}), ("too_few_usable_tickers", {"usable_lag": 0, "execution_date": None}), ("no_execution_target_date", {"execution_date": None, "source": "weekday_fallback"}),
        ("calendar_source_untrusted", {"source": "weekday_fallback", "adopted_long": 0}), ("no_long_candidates_after_threshold", {"adopted_long": 0, "adopted_short": 0}), ("no_short_candidates_after_threshold", {"adopted_short": 0}), ("too_few_usable_tickers", {"adopted_short": 0, "candidate_short": 0}),
        ("insufficient_positions_after_threshold", {"adopted_long": 1, "trade_strength": 0.0}), ("signal_spread_too_small", {"trade_strength": 0.09}),
    ]
    kind = "i int, freshness_ok boolean, dates_aligned boolean, usable_lead int, usable_lag int, execution_date date, source string, candidate_long int, candidate_short int, adopted_long int, adopted_short int, trade_strength double"
    rows = frame(spark, [(i, *(fine | x).values()) for i, (_, x) in enumerate(cases)], kind)
    gate = lambda mode: selection.tradeability(rows, c("freshness_ok"), c("dates_aligned"), c("usable_lead"), c("usable_lag"), c("execution_date"), c("source"), mode, 0.1, 2, 2).orderBy("i").collect()
    got = gate("production")
    assert [r.block_reason for r in got] == [x for x, _ in cases] and [r.tradeable for r in got] == [x is None for x, _ in cases]
    assert not any(r.calendar_warning for r in got)
    got = gate("development")
    assert got[5].block_reason == "no_long_candidates_after_threshold" and got[5].calendar_warning and not got[0].calendar_warning
    assert len({x for x, _ in cases if x} | {"strategy_rule_skip"}) == 10


def test_the_settings_of_the_gate_show_most_reasons(spark, sf):
    got = market.queries()["tradeability_settings"](spark, "/root/testdata/sf0.01").groupBy("block_reason").count().collect()
    reasons = {r.block_reason for r in got}
    assert None in reasons and len(reasons) >= 7, reasons


def test_the_class_that_a_log_row_has(spark):
    cases = [("curr_oc", "regime_blocked", 0, 0), (None, None, 2, 2), ("skip", None, 0, 0), ("gap_ovht_oc", None, 1, 0), ("long_flip_oc", "x", 0, 4)]
    rows = frame(spark, [(i, s, b, n, m, -0.01, -0.5) for i, (s, b, n, m) in enumerate(cases)], "i int, strategy string, before string, n_long int, n_short int, g double, h double")
    got = rows.select("i", daily.class_after(c("strategy"), c("before"), c("n_long"), c("n_short"), c("g"), c("h")).alias("k"), daily.action(c("strategy")).alias("a")).orderBy("i").collect()
    assert [r.k for r in got] == ["regime_blocked", None, "near_miss_threshold", "one_side_only", "one_side_only"]
    assert [r.a for r in got] == ["execute", "execute", "skip", "execute", "override"]
