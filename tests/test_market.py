"""Market operators: SQL twins, boundary fixtures, and the subspace signal against a plain restatement."""

import datetime as dt
import json

import numpy as np
import pytest
from oracle import both
from pyspark.sql import functions as F

from tideway.functions.predicates import abs_gt, abs_le, ge
from tideway.functions.rules import RULES, get_rule, rolling_selector
from tideway.operators import daily, performance, portfolio, regime, returns, selection, signals, status, store, studies
from tideway.plans import market
from tideway.sources import documents

HERE = (
    "panel_prices", "ret_cc_pad", "gap_next_open", "joint_strict", "joint_rolling_fill", "signal_momentum", "regime_frame", "candidate_stats", "portfolio_detail", "rule_406", "tax_annual_net", "judge_scores", "next_session", "upsert_dedup", "spearman",
    "order_documents", "fetch_plan", "shadow_decisions", "tradeability", "execution_checks", "cache_summary", "data_status", "judge_universes", "history_entries", "recovery_scenarios", "scenario_ranking", "us_features", "param_grid",
)


@pytest.mark.parametrize("name", HERE)
def test_query_equals_its_sql(spark, sf, name):
    got, want = both(spark, sf, market.queries()[name], market.oracle_sql()[name])
    assert got == want


def test_every_query_is_registered_once():
    assert len(market.queries()) == len(market.QUERIES) >= 130


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_padding_and_gaps(spark):
    rows = [("u", day(i), "A", 1, "lag", 0, 1.0, c) for i, c in enumerate([1.0, None, 2.0])]
    dense = spark.createDataFrame(rows, "universe_id string, date date, ticker string, ord int, side string, cyc int, open double, close double")
    got = returns.returns(dense).orderBy("date").collect()
    assert [r.ret_cc for r in got] == [None, 0.0, 1.0]
    assert [r.ret_cc_nopad for r in got] == [None, None, None]


def test_predicates_are_false_for_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.015,), (-0.02,)], "x double")
    got = df.select(abs_gt(F.col("x"), 0.015), abs_le(F.col("x"), 0.015), ge(F.col("x"), 0.015)).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (False, False, False), (False, True, True), (True, False, False)]


CONTEXT = "open_gap double, short_gap double, candidate_signal_strength double, trend_regime string, vol_regime string, rotation_regime string"


@pytest.mark.parametrize(
    "rule, context, want",
    [
        ("rule_406", (0.015, 0.01, None, None, None, None), "gap_ovht_oc"), ("rule_406", (0.0151, 0.0, None, None, None, None), "skip"), ("rule_406", (None, 0.0, None, None, None, None), "skip"), ("rule_406", (0.0, 0.011, None, None, None, None), "long_flip_oc"),
        ("rule_406", (0.0, 0.02, None, None, None, "weak_rotation"), "skip"), ("rule_406_no_flip", (0.0, 0.02, None, None, None, None), "gap_ovht_oc"), ("rule_399", (0.0, 0.0, 0.3, None, None, None), "gap_ovht_oc"), ("rule_399", (0.006, 0.0, 0.3, None, "high_vol", None), "long_flip_oc"),
        ("rule_399", (0.0, 0.0, None, None, None, None), "skip"), ("rule_13", (0.0, 0.011, None, None, "high_vol", None), "short_only_oc"), ("rule_13", (0.0, 0.011, None, None, "mid_vol", None), "skip"), ("rule_87", (0.0, 0.008, None, None, None, "strong_rotation"), "lgap_oc"),
        ("rule_1357", (0.008, None, None, "uptrend", None, None), "lgap_oc"), ("rule_1357", (0.008, None, None, "sideways", None, None), "skip"),
    ],
)
def test_rules(spark, rule, context, want):
    assert spark.createDataFrame([context], CONTEXT).select(get_rule(rule)).first()[0] == want


def test_rule_registry(spark):
    with pytest.raises(ValueError):
        get_rule("rule_0")
    df = spark.createDataFrame([(0.0, 0.0, None, "uptrend", None, None)], CONTEXT)
    chosen = rolling_selector({2020: "rule_1357", 2021: "nothing"}, F.col("y"))
    assert [df.withColumn("y", F.lit(y)).select(chosen).first()[0] for y in (2020, 2021, 2022)] == ["gap_ovht_oc", "skip", "gap_ovht_oc"]
    assert "rule_406" in RULES


def masks(spark, values):
    df = spark.createDataFrame([("u", day(0), f"T{i:02}", v) for i, v in enumerate(values)], "universe_id string, date date, ticker string, signal double")
    return selection.quantile_masks(df, 0.3)


def test_ties_are_short_and_bounds_are_included(spark):
    assert {r.position for r in selection.positions(masks(spark, [0.0] * 4)).collect()} == {"SHORT"}
    got = masks(spark, [i / 10 for i in range(11)])
    want = np.quantile(np.arange(11) / 10, [0.3, 0.7])
    assert np.allclose([got.first().lo, got.first().hi], want)
    assert masks(spark, [1.0, 2.0]).count() == 0


def test_tax_carries_losses_forward_and_lets_them_lapse(spark):
    def tax(pairs, **kw):
        df = spark.createDataFrame([("s", dt.date(y, 12, 30), r) for y, r in pairs], "k string, date date, ret double")
        return {r.year: round(r.tax, 10) for r in performance.yearly_tax(df, ["k"], 0.2, **kw).collect()}

    assert tax([(2024, -0.10), (2025, 0.08)]) == {2024: 0.0, 2025: 0.0}
    assert tax([(2020, -0.10), (2021, 0.04), (2022, 0.10)]) == {2020: 0.0, 2021: 0.0, 2022: round(0.04 * 0.2, 10)}
    assert tax([(2020, -0.10), (2024, 0.10)]) == {2020: 0.0, 2024: 0.02}  # lapsed after three years

    rng = np.random.default_rng(3)
    series = [(2000 + i, float(x)) for i, x in enumerate(rng.normal(0, 0.1, 15))]
    losses, want = [], {}
    for y, p in series:
        losses = [(ly, a) for ly, a in losses if y - ly <= 3]
        want[y] = round(max(0.0, p - sum(a for _, a in losses)) * 0.2, 10)
        left, kept = max(0.0, p), []
        for ly, a in losses:
            used = min(a, left)
            left -= used
            if a - used > 0:
                kept.append((ly, a - used))
        losses = kept + ([(y, -p)] if p < 0 else [])
    assert tax(series) == want


def test_performance_of_nothing_and_first_day_loss(spark):
    df = spark.createDataFrame([("s", day(0), -0.5), ("s", day(1), 0.1)], "k string, date date, ret double")
    assert performance.performance(df, ["k"]).first().mdd == 0.0
    assert performance.performance(df.where("false"), ["k"]).count() == 0
    zero = spark.createDataFrame([("s", day(i), x) for i, x in enumerate([0.0, 0.0, 0.1, -0.1])], "k string, date date, ret double")
    assert performance.longest_runs(zero, ["k"]).first()[1:] == (1, 2)


def test_net_is_never_above_gross_and_no_short_has_no_borrow(spark, sf):
    m = market.Market(spark, sf)
    rows = portfolio.portfolio(m.signal, m.rets).collect()
    assert all(r.net_pre_tax_return <= r.gross_return for r in rows)
    assert {r.borrow_cost for r in portfolio.portfolio(m.signal, m.rets, costs=portfolio.Costs(allow_short=False)).collect()} <= {0.0}


def test_subspace_signal_equals_a_plain_restatement(spark):
    rng, leads, lags, n, length, k, lam, early = np.random.default_rng(1), 3, 4, 150, 12, 2, 0.9, 40
    x = rng.normal(0, 0.01, (n, leads + lags))
    names = [(f"T{j}", j, "lead" if j < leads else "lag", j % 3 - 1) for j in range(leads + lags)]
    rows = spark.createDataFrame([("u", day(i), t, o, s, float(x[i, j])) for i in range(n) for j, (t, o, s, _) in enumerate(names)], "universe_id string, date date, ticker string, ord int, side string, ret double")
    known = spark.createDataFrame([("u", *r) for r in names], "universe_id string, ticker string, ord int, side string, cyc int")
    got = {(r.date, r.ticker): r.signal for r in signals.subspace_signals(rows.repartition(7), known, length, k, lam, early).collect()}
    assert len(got) == (n - length) * lags
    v = [np.ones(7)]
    for w in (np.array([1, 1, 1, -1, -1, -1, -1.0]), np.array([c for *_, c in names], float)):
        q, _ = np.linalg.qr(np.stack([*v, w], axis=1))
        v.append(q[:, -1])
    v = np.stack([u / np.linalg.norm(u) for u in v], axis=1)
    z0 = (x[:early] - x[:early].mean(0)) / (x[:early].std(0) + 1e-10)
    c0 = v @ np.diag(np.diag(v.T @ (z0.T @ z0 / early) @ v)) @ v.T
    c0 = c0 / np.sqrt(np.outer(np.diag(c0), np.diag(c0)))
    for i in (length, 77, n - 1):
        w = x[i - length : i]
        mu, sd = w.mean(0), w.std(0) + 1e-10
        z = (w - mu) / sd
        c = z.T @ z / length
        np.fill_diagonal(c, 1)
        c = (1 - lam) * c + lam * c0
        np.fill_diagonal(c, 1)
        top = np.linalg.eigh(c)[1][:, -k:]
        want = top[leads:] @ (top[:leads].T @ ((x[i] - mu) / sd)[:leads])
        assert np.allclose([got[day(i), t] for t, _, s, _ in names if s == "lag"], want, atol=1e-9)


def test_the_future_does_not_change_past_signals_but_does_change_labels(spark, sf):
    m = market.Market(spark, sf)
    cut = m.panel.where("date < '2000-01-01'")
    early = signals.momentum(returns.returns(market.market.dense(cut)), 12)
    late = m.signal.where("date < '2000-01-01'")
    assert {(r.date, r.ticker): round(r.signal, 12) for r in early.collect()} == {(r.date, r.ticker): round(r.signal, 12) for r in late.collect()}
    assert regime.regimes(m.rets, m.signal).count() == m.panel.where("side = 'lag'").select("date").distinct().count()


def test_ols_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = 0.5 + x @ [1.0, -2.0, 0.3] + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([("k", *map(float, r), float(v)) for r, v in zip(x, y)], "k string, a double, b double, c double, y double")
    got = {r.term: r.coefficient for r in studies.ols(df, ["k"], "y", ["a", "b", "c"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    assert np.allclose([got[t] for t in ("alpha", "a", "b", "c")], want)


def test_factor_models_and_readiness(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    y = 0.1 + x @ [1.0, -2.0, 0.3, 0.5] + rng.normal(0, 0.1, 80)
    factors = spark.createDataFrame([(day(i), *map(float, r), 0.25) for i, r in enumerate(x)], "date date, mkt_rf double, smb double, hml double, mom double, rf double")
    returns_ = spark.createDataFrame([("u", day(i), float(v)) for i, v in enumerate(y)], "universe_id string, date date, ret double")
    got = {(r.model, r.term): r for r in studies.factor_models(returns_, factors, "ret").collect()}
    for model, k in (("ff3", 3), ("carhart4", 4)):
        a = np.column_stack([np.ones(80), x[:, :k]])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        left = y - a @ beta
        t = beta / np.sqrt(left @ left / (80 - k - 1) * np.diag(np.linalg.inv(a.T @ a)))
        terms = ["alpha", *studies.MODELS[model]]
        assert np.allclose([got[model, n].coefficient for n in terms], beta) and np.allclose([got[model, n].t_value for n in terms], t)
    assert {r.model for r in studies.factor_models(returns_, factors.drop("mom"), "ret").collect()} == {"ff3"}
    assert studies.factor_models(returns_, factors.drop("smb"), "ret") is None
    said = lambda a, b: studies.readiness(a, b, "ret").first()
    assert said(returns_, None).reason == "factor_data_unavailable" and said(returns_, factors.drop("smb")).reason == "missing_columns:SMB"
    assert said(returns_.where("false"), factors).reason == "returns_unavailable" and said(returns_.limit(10), factors).reason == "insufficient_observations:10"
    assert tuple(said(returns_, factors)) == (80, "ok", True, day(0), day(79))
    assert studies.excess(returns_.join(factors, "date"), "ret").orderBy("date").first().ret == pytest.approx(y[0] - 0.25)


def subspace(joint, length=12, k=3, lam=0.9, early=36):
    """Signals and matrices by plain NumPy: {date: ({ticker: signal}, {(ticker, lead): weight})}."""
    joint = joint.sort_values(["date", "ord"])
    wide = joint.pivot(index="date", columns="ord", values="ret").sort_index()
    names = joint.drop_duplicates("ord").set_index("ord")
    leads = [o for o in wide.columns if names.side[o] == "lead"]
    x, n, nl = wide.to_numpy(), len(wide.columns), len(leads)
    side, cyc = np.array([1.0] * nl + [-1.0] * (n - nl)), np.array([o % 3 - 1 for o in wide.columns], float)
    v = []
    for u in (np.ones(n), side, cyc):
        for w in v:
            u = u - (u @ w) * w
        v.append(u / np.linalg.norm(u))
    v = np.stack(v, axis=1)
    z0 = (x[:early] - x[:early].mean(0)) / (x[:early].std(0) + 1e-10)
    c0 = v @ np.diag(np.diag(v.T @ (z0.T @ z0 / early) @ v)) @ v.T
    c0 = c0 / np.sqrt(np.outer(np.diag(c0), np.diag(c0)))
    out = {}
    for i in range(length, len(x)):
        w = x[i - length : i]
        mu, sd = w.mean(0), w.std(0) + 1e-10
        c = ((w - mu) / sd).T @ ((w - mu) / sd) / length
        np.fill_diagonal(c, 1)
        c = (1 - lam) * c + lam * c0
        np.fill_diagonal(c, 1)
        top = np.linalg.eigh(c)[1][:, -k:]
        b = top[nl:] @ top[:nl].T
        out[wide.index[i]] = ({names.ticker[o]: s for o, s in zip(wide.columns[nl:], b @ ((x[i] - mu) / sd)[:nl])}, {(names.ticker[o], names.ticker[u]): b[j, m] for j, o in enumerate(wide.columns[nl:]) for m, u in enumerate(leads)})
    return out


def test_registered_eigen_queries_equal_a_plain_restatement(spark, sf):
    m = market.Market(spark, sf)
    joint = m.joint.toPandas()
    run = lambda name: market.queries()[name](spark, sf).toPandas()
    for name, lam in (("signal_subspace_pca", 0.9), ("signal_plain_pca", 0.0)):
        want = {(str(d), t): s for d, (signal, _) in subspace(joint, lam=lam).items() for t, s in signal.items()}
        got = {(r.date, r.ticker): r.signal for r in run(name).itertuples()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-5)
    found = subspace(joint)
    for d, part in run("propagation_matrix_top").groupby("date"):
        weights = sorted(map(abs, found[dt.date.fromisoformat(d)][1].values()), reverse=True)[:10]
        assert np.allclose(sorted(map(abs, part.weight), reverse=True), weights, atol=1e-6)
    last = max(found)
    signal = found[last][0]
    lo, hi = np.quantile(list(signal.values()), [0.3, 0.7])
    place = lambda s: "SHORT" if s <= lo and s <= 0 else "LONG" if s >= hi and s >= 0 else "neutral"
    assert {r.ticker: r.position for r in run("daily_signal").itertuples()} == {t: place(s) for t, s in signal.items()}
    nxt = {(r.date, r.ticker): r.next_oc for r in m.rets.where("side = 'lag' and next_oc is not null").collect()}
    for name, lams in (("backtest_pca", (0.9,)), ("lambda_grid", (0.7, 0.8, 0.9))):
        table = run(name)
        for lam in lams:
            gross, net = [], []
            for d, (signal, _) in sorted(subspace(joint, lam=lam).items()):
                rows = [(s, nxt[d, t]) for t, s in signal.items() if (d, t) in nxt]
                if len(rows) >= 3:
                    s, r = np.array(rows).T
                    lo, hi = np.quantile(s, [0.3, 0.7])
                    long, short = (s >= hi) & (s >= 0), (s <= lo) & (s <= 0)
                    if long.any():
                        gross.append(r[long].mean() - (r[short].mean() if short.any() else 0))
                        net.append(gross[-1] - 0.002 * (1 + short.any()) - 0.015 / 252 * short.any())
            row = table[table["lambda"] == lam].iloc[0] if name == "lambda_grid" else table[table.set_name == "net_pre_tax"].iloc[0]
            assert row.n_days == len(net) and row.ar == pytest.approx(np.mean(net) * 1200, rel=1e-5) and row.risk == pytest.approx(np.std(net, ddof=1) * 12**0.5 * 100, rel=1e-5)


FLAGS = {"freshness_ok": True, "cache_isolated": True, "dates_aligned": True, "signal_ready": True, "strict_fill": True, "stale": False, "usable_lead": 11, "usable_lag": 17}


def judged(spark, cases):
    names = ("gross_ar", "net_pre_tax_ar", "net_after_tax_ar", "net_after_tax_rr", "net_after_tax_mdd")
    rows = [(i, *map(float, c[:5]), *({**FLAGS, **(c[5] if len(c) > 5 else {})}[f] for f in FLAGS)) for i, c in enumerate(cases)]
    kind = "i int, " + ", ".join(f"{n} double" for n in names) + ", " + ", ".join(f"{f} {'int' if f.startswith('usable') else 'boolean'}" for f in FLAGS)
    return performance.verdict(spark.createDataFrame(rows, kind)).orderBy("i").collect()


def test_verdict_ladders_at_their_bounds(spark):
    ladder = lambda x, steps: next((p for b, p in steps if x >= b), 0)
    ars = [y for x in (10, 8, 6, 4, 3, 1, 0) for y in (x, x - 0.01)]
    got = judged(spark, [(a, a, a, 1.0, -5) for a in ars])
    assert [r.profitability for r in got] == [ladder(a, [(10, 30), (8, 28), (6, 24), (4, 20), (3, 18), (1, 12), (0, 8)]) for a in ars]
    mdds = [y for x in (-10, -12.5, -15, -17.5, -20, -22.5, -25) for y in (x, x - 0.01)]
    got = judged(spark, [(10, 10, 10, 1.0, d) for d in mdds])
    assert [r.stability for r in got] == [ladder(d, [(-10, 25), (-12.5, 22), (-15, 20), (-17.5, 18), (-20, 16), (-22.5, 13), (-25, 10)]) for d in mdds]
    got = judged(spark, [(16, 16 - cost, 16 - cost - tax, 1.0, -5) for cost in (0.5, 1, 2, 3, 4) for tax in (0.5, 1, 2.5, 5)])
    assert [r.cost_resilience for r in got] == [c + t for c in (12, 9, 6, 3, 0) for t in (8, 6, 3, 0)]
    got = judged(spark, [(10, 10, 10, rr, -5) for rr in (0.3, 0.29, 0.15, 0.14, 0, -0.1)])
    assert [(r.profitability, r.stability) for r in got] == [(30, 25), (26, 23), (26, 23), (24, 22), (24, 22), (22, 22)]


def test_verdict_rejects_what_is_missing_and_names_what_to_do(spark):
    fine = (10, 9.5, 9.0, 1.0, -5)
    cases = [fine, (*fine, dict.fromkeys(FLAGS)), (*fine, {"usable_lead": None}), (*fine, {"freshness_ok": None}), (*fine, {"signal_ready": None, "dates_aligned": False, "stale": True}), (-6, -6, -6, -1, -40), (20, 14, 8, 1.0, -5)]
    got = judged(spark, cases)
    assert [r.overall_decision for r in got] == ["pass", "reject", "reject", "reject", "pass", "reject", "hold"]
    assert got[0].reasons == "" and got[0].actions == performance.GO_ON
    assert got[1].reasons.split("|")[:4] == ["DATA_FRESHNESS_FAILED:reject", "CACHE_ISOLATION_FAILED:reject", "TOO_FEW_US_TICKERS:reject", "TOO_FEW_JP_TICKERS:reject"]
    assert (got[1].executability, got[1].data_reliability) == (0, 1) and (got[4].executability, got[4].data_reliability) == (5, 11)
    assert got[5].reasons == "SEVERELY_NEGATIVE_AFTER_TAX_RETURN:reject|LOW_AFTER_TAX_RETURN:warn|LOW_AFTER_TAX_RR:warn|DEEP_AFTER_TAX_DRAWDOWN:warn"
    assert got[5].actions == "revise_strategy|tune_quantile|tune_window_and_lambda|control_exposure" and "HIGH_TAX_DRAG" in got[6].reasons


def test_order_documents_have_the_agreed_keys(spark):
    rows = [("u", day(0), "1615.T", 0.5, "LONG"), ("u", day(0), "1617.T", 0.6, "LONG"), ("u", day(0), "1618.T", -0.5, "SHORT"), ("u", day(0), "1619.T", -0.6, "SHORT"), ("u", day(0), "1620.T", 0.0, "neutral"), ("u", day(1), "1615.T", 0.1, "neutral")]
    positions = spark.createDataFrame(rows, "universe_id string, date date, ticker string, signal double, position string")
    prices = spark.createDataFrame([("u", day(0), t, p) for t, p in (("1615.T", 1000.5), ("1617.T", 2500.0), ("1618.T", 401.0))], "universe_id string, date date, ticker string, close double")
    sectors = spark.createDataFrame([("1615.T", "banks"), ("1617.T", "foods")], "ticker string, sector string")
    planned = daily.plan(daily.named(positions, sectors), prices)
    got = {r.ticker: (r.latest_price, r.min_purchase, r.lots, r.purchase, r.weight_pct) for r in planned.collect()}
    # 2500 / 1000 is 2.5, to the even number; the price itself is rounded to the even number too
    assert got == {"1615.T": (1000, 10005, 2, 2000, 50.0), "1617.T": (2500, 25000, 1, 2500, 50.0), "1618.T": (401, 4010, 6, 2406, 50.0), "1619.T": (None, None, None, None, 50.0)}
    made = {r.date: json.loads(r.payload) for r in daily.order_documents(positions, planned).collect()}
    assert made[day(0)]["common"] == {"market": "TKY", "price_type": "market", "validity": "this_day", "skip_estimate": True, "trade_password": ""}
    assert made[day(1)]["orders"] == [] and [o["stock_code"] for o in made[day(0)]["orders"]] == ["1617", "1615", "1618", "1619"]
    long, short = made[day(0)]["orders"][1], made[day(0)]["orders"][3]
    assert long == {"stock_code": "1615", "order_kind": "genbutsu_buy", "quantity": 2, "nariyuki_condition": "寄成", "sor_enabled": False, "note": "LONG / banks / 2口"}
    assert short == {"stock_code": "1619", "order_kind": "shinyo_sell", "quantity": 1, "payment_limit": "day", "nariyuki_condition": "寄成", "sor_enabled": False, "note": "SHORT / 1619.T / 1口"}


def test_gap_picker_and_skip_override(spark):
    gaps = spark.createDataFrame([("u", day(i), t, i + k / 10) for i in range(3) for k, t in enumerate("AB")], "universe_id string, date date, ticker string, gap double")
    wanted = spark.createDataFrame([("u", day(1)), ("u", day(9)), ("u", None), ("none", day(1))], "universe_id string, execution_date date")
    got = {(r.execution_date, r.ticker): r.gap for r in daily.pick_gaps(gaps, wanted).collect()}
    assert got == {(day(1), "A"): 1.0, (day(1), "B"): 1.1, (day(9), "A"): 2.0, (day(9), "B"): 2.1, (None, "A"): 2.0, (None, "B"): 2.1}
    rows = spark.createDataFrame([(1, True, None, None, 1, 1, "skip"), (2, False, "freshness_not_ok", "one_side_only", 1, 0, "skip"), (3, True, None, None, 2, 2, "gap_ovht_oc"), (4, False, "x", "y", 0, 0, None)], "i int, tradeable boolean, block_reason string, no_trade string, adopted_long int, adopted_short int, active_strategy string")
    got = [(r.tradeable, r.block_reason, r.no_trade) for r in daily.skip_override(rows).orderBy("i").collect()]
    assert got == [(False, "strategy_rule_skip", "strategy_rule_skip_with_candidates"), (False, "strategy_rule_skip", "strategy_rule_skip"), (True, None, None), (False, "x", "y")]


def test_fetch_plan_decides_for_the_group(spark):
    ranges = spark.createDataFrame([("A", day(0), day(50)), ("B", day(5), day(40)), ("C", day(5), day(60))], "ticker string, first_date date, last_date date")
    wanted = spark.createDataFrame([("ab", "A"), ("ab", "B"), ("c", "C"), ("az", "A"), ("az", "Z")], "group string, ticker string")
    plan = lambda start: {r.group: r.from_date for r in store.fetch_plan(ranges, wanted, str(start)).collect()}
    assert plan(day(0)) == {"ab": day(33), "c": day(0), "az": day(0)}
    assert plan(day(36)) == {"ab": day(36), "c": day(53), "az": day(36)}


def test_adjusted_series_verification_reasons(spark):
    rows = [(u, f"t{k}", day(d), a) for u, n, d1, a in (("good", 20, 90, "dividend"), ("few", 8, 90, "dividend"), ("thin", 10, 90, "split"), ("short", 20, 30, "dividend"), ("odd", 20, 90, "other")) for k in range(n) for d in ((0, d1) if u != "thin" else (d1 * (k > 0),))]
    rows += [("thin", f"t{k}", day(0), "split") for k in range(10, 11)]
    actions = spark.createDataFrame([r for r in rows if not (r[0] == "thin" and r[1] in ("t0", "t1", "t2", "t3"))], "universe_id string, ticker string, date date, action_type string").unionByName(spark.createDataFrame([("thin", "t0", day(0), "split"), ("thin", "t1", day(90), "split")], "universe_id string, ticker string, date date, action_type string"))
    expected = spark.createDataFrame([(u, 28 if u not in ("thin",) else 12) for u in ("good", "few", "thin", "short", "odd", "none")], "universe_id string, tickers int")
    got = {r.universe_id: r.reason_code for r in status.verification(actions, expected, F.lit(day(1)), F.lit(day(80))).collect()}
    assert got == {"good": "ok", "few": "coverage_ratio_below_threshold", "thin": "insufficient_actions_events", "short": "required_range_not_covered", "odd": "no_dividends_or_splits", "none": "actions_data_unavailable"}
    flags = spark.createDataFrame([(True, True, True, True), (True, None, False, True)], ", ".join(f"{x} boolean" for x in status.CONDITIONS))
    assert sorted(r.paper_reproduction_reason for r in status.roll_up(flags).collect()) == ["missing_requirements:factor_regression_ready,adjusted_verification_ready", "ok"]


def test_documents_scans_and_writers(spark, tmp_path):
    for name, text in (("a", '{"schema_version": 1, "date": "2024-01-01", "backtest": {"ar": 1.5}}'), ("b", "{broken"), ("c", '{"date": "2024-01-03"}'), ("d", "")):
        (tmp_path / f"{name}.json").write_text(text)
    got = documents.reports(spark, str(tmp_path / "*.json")).collect()
    assert [r.date for r in got] == ["2024-01-03", "2024-01-01"] and json.loads(got[1].backtest) == {"ar": 1.5}
    (tmp_path / "h.jsonl").write_text('{"date": "1", "summary": "x"}\n\nnot json\n{"date": "2"}\n{"date": "3"}\n')
    assert [r.date for r in documents.history(spark, str(tmp_path / "h.jsonl"))
            .collect()] == ["3", "2", "1"]
    assert [r.date for r in documents.history(spark, str(tmp_path / "h.jsonl"), 2).collect()] == ["3", "2"]
    parts = spark.createDataFrame([(day(0), float("nan"), [1.0, float("inf")], {"a": float("-inf"), "b": 2.0}, "log")], "date date, ar double, xs array<double>, m map<string,double>, log string")
    made = documents.report_documents(parts)
    assert json.loads(made.first().document) == {"schema_version": 1, "date": "2024-01-01", "ar": None, "xs": [1.0, None], "m": {"a": None, "b": 2.0}}
    documents.write_reports(made, str(tmp_path / "out"))
    assert documents.reports(spark, str(tmp_path / "out" / "*")).count() == 1
    rows = spark.createDataFrame([("full", 1.5, None), ("last", None, "x")], "period_label string, a double, b string")
    documents.write_periods(rows, str(tmp_path / "periods"))
    assert sorted(p.name for p in (tmp_path / "periods").glob("period*")) == ["period_label=full", "period_label=last"]
    assert any("1.5,NA" in f.read_text() for f in (tmp_path / "periods").rglob("*.csv"))


def test_log_and_history_are_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(["B", "A"], [], True, "2024-01-01", None)], "long_tickers array<string>, short_tickers array<string>, tradeable boolean, signal_date string, exec_date string")
    log = daily.log_rows(rows, F.lit("now"))
    assert tuple(log.columns) == daily.LOG_FIELDS and len(daily.LOG_FIELDS) == 39
    for _ in range(2):
        daily.append_log(log, str(tmp_path / "log"))
    read = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert read.count() == 2 and read.first().long_tickers == "B|A" and read.first().n_long == "2"
    entries = daily.history(rows.union(rows))
    assert entries.first().dedupe_key == '{"signalDate":"2024-01-01","execJpDate":null,"tradeable":true,"longTickers":["A","B"],"shortTickers":[]}'
    for _ in range(2):
        daily.append_history(entries, str(tmp_path / "history"))
    assert spark.read.json(str(tmp_path / "history")).count() == 1


def test_p_of_a_correlation(spark):
    rows = spark.createDataFrame([(0.5, 20), (-0.5, 20), (0.0, 20), (0.9, 5), (1.0, 5), (0.3, 3), (0.4, 2)], "rho double, n long")
    got = [r.p for r in studies.correlation_p(rows).collect()]

    def p(rho, n):
        if n < 3:
            return None
        t, v = abs(rho) / np.sqrt(max(1e-300, 1 - rho * rho)) * np.sqrt(n - 2), n - 2
        x = np.linspace(0, np.pi / 2, 200_001)
        f = np.cos(x) ** (v - 1)
        return 1 - np.trapezoid(f[x <= np.arctan(t / np.sqrt(v))], x[x <= np.arctan(t / np.sqrt(v))]) / np.trapezoid(f, x)

    assert got == [pytest.approx(p(rho, n), abs=2e-5) if n > 2 else None for rho, n in ((0.5, 20), (-0.5, 20), (0.0, 20), (0.9, 5), (1.0, 5), (0.3, 3), (0.4, 2))]


def test_factor_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text("A note\n\n,Mkt-RF,SMB,RF\n20240102,  0.50, -99.99, 0.01\n20240103,1.00,0.20,0.01\n\n Annual\n2024, 5, 5, 5\n")
    rows = store.factor_csv(spark, str(tmp_path / "f.csv")).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 1, 2), 0.005, None, 0.0001), (dt.date(2024, 1, 3), 0.01, 0.002, 0.0001)]
    assert store.factor_csv(spark, str(tmp_path / "f.csv")).columns == ["date", "mkt_rf", "smb", "rf"]
    (tmp_path / "m.csv").write_text("x\n,WML\n20240103,2.00\n20240104,1.00\n")
    both_ = store.carhart(store.factor_csv(spark, str(tmp_path / "f.csv")), store.factor_csv(spark, str(tmp_path / "m.csv")))
    assert [(r.date, r.mom) for r in both_.collect()] == [(dt.date(2024, 1, 3), 0.02)]
    assert store.load_factors(spark, str(tmp_path)) is None
    (tmp_path / "ff3.csv").write_text("date,mkt_rf,smb,hml,rf\n2024-01-03,0.01,0.02,0.03,0\n")
    assert store.load_factors(spark, str(tmp_path)).columns == ["date", "mkt_rf", "smb", "hml", "rf"]
    (tmp_path / "carhart4.csv").write_text("date,mkt_rf,smb,hml,rf,wml\n2024-01-03,0.01,0.02,0.03,0,0.04\n")
    assert store.load_factors(spark, str(tmp_path)).first().mom == 0.04


def test_store_and_ingest(spark, tmp_path):
    from tideway.streaming.ingest import ingest

    schema = "ticker string, date date, price_mode string, open double, close double"
    first = spark.createDataFrame([("A", day(0), "raw", 1.0, 1.0), ("A", day(0), "adjusted", 0.8, 0.8)], schema)
    store.write_store(first, str(tmp_path / "store"))
    spark.createDataFrame([("A", day(0), "raw", 2.0, 2.0), ("B", day(1), "raw", 3.0, 3.0), ("C", day(1), "raw", None, None)], schema).write.parquet(str(tmp_path / "land"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "land"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    got = store.scan(spark, str(tmp_path / "store"), ["A", "B", "C"], "2024-01-01", "2024-02-01", "raw").collect()
    assert [(r.ticker, r.close) for r in got] == [("A", 2.0), ("B", 3.0)]
    assert store.scan(spark, str(tmp_path / "store"), ["A"], "2024-01-01", "2024-02-01", "adjusted").first().close == 0.8
