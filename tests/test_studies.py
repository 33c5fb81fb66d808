"""Grids of the subspace signal, quality records, the store by month, report sets, readiness from files, studies."""

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from oracle import both
from pyspark.sql import functions as F

from tideway.operators import portfolio, returns, signals, status, store, studies
from tideway.operators.work import Saved
from tideway.plans import market
from tideway.sources import documents

c = F.col
NEW = ("data_status", "data_status_published", "daily_reports", "report_set", "period_table", "quality_records", "effective_windows", "spread_study", "spread_bands", "threshold_comparison", "flip_study", "window_sensitivity", "param_grid", "action_tables", "panel_days", "portfolio_days", "performance_days")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, sf, name):
    got, want = both(spark, sf, market.queries()[name], market.oracle_sql()[name])
    assert got == want and (got or name.endswith("_days"))


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


# ---------------------------------------------------------------- grids


def test_moments_equal_those_of_each_window():
    rng = np.random.default_rng(0)
    x = rng.normal(0.01, 0.02, (60, 5))
    x[:, 4] = 0.03  # does not move
    x[20:40, 3] = 0.5
    for length in (2, 7, 19):
        at = np.arange(length, 60)
        mean, sd, corr = signals.moments(x, at, length)
        for d, i in enumerate(at):
            w = x[i - length : i]
            z = (w - w.mean(0)) / (w.std(0) + 1e-10)
            assert np.allclose(mean[d], w.mean(0)) and np.allclose(sd[d], w.std(0) + 1e-10, rtol=1e-6, atol=1e-12) and np.allclose(corr[d], z.T @ z / length, atol=1e-6)


@pytest.fixture(scope="module")
def made(spark, sf):
    return market.Market(spark, sf)


def test_the_grid_has_the_signals_of_each_length_and_weight(spark, made):
    lengths, lams = (6, 9, 12, 18, 24), (0.0, 0.5, 0.9)
    got = {}
    for r in signals.subspace_grid(made.joint, made.names, lengths, lams).collect():
        got.setdefault((r.length, r["lambda"]), {})[r.date, r.ticker] = r.signal
    assert set(got) == {(n, w) for n in lengths for w in lams}
    for length, lam in ((6, 0.9), (12, 0.0), (12, 0.9), (24, 0.5)):
        want = {(r.date, r.ticker): r.signal for r in signals.subspace_signals(made.joint, made.names, length, lam=lam).collect()}
        assert got[length, lam].keys() == want.keys() and np.allclose([got[length, lam][k] for k in want], list(want.values()), atol=1e-5)


def test_blocks_of_dates_change_no_signal(spark, made):
    first = signals.subspace_grid(made.joint, made.names, (6, 30), (0.9,))
    assert first.where("length = 6").select("date").distinct().count() == made.joint.select("date").distinct().count() - 6
    rows = made.joint.repartition(5)
    one = {tuple(r)[:5]: r.signal for r in first.collect()}
    two = {tuple(r)[:5]: r.signal for r in signals.subspace_grid(rows, made.names, (30, 6), (0.9,)).collect()}
    assert one.keys() == two.keys() and np.allclose([one[k] for k in one], [two[k] for k in one], atol=1e-7)


def measured(signal, nxt, q, slippage, short, gross=False):
    """Annual return, risk and number of days by plain NumPy."""
    out = []
    for d in sorted({d for d, _ in signal}):
        rows = [(s, nxt[d, t]) for (e, t), s in signal.items() if e == d and (d, t) in nxt]
        if len(rows) < 3:
            continue
        s, r = np.array(rows).T
        lo, hi = np.quantile(s, [q, 1 - q])
        long, shorts = (s >= hi) & (s >= 0), (s <= lo) & (s <= 0)
        if long.any():
            has = bool(shorts.any() and short)
            ret = r[long].mean() - (r[shorts].mean() if has else 0)
            out.append(ret if gross else ret - (5 + slippage) / 1e4 * 2 * (1 + has) - 0.015 / 252 * has)
    return np.mean(out) * 1200, np.std(out, ddof=1) * 12**0.5 * 100, len(out)


def test_the_registered_grids_equal_a_plain_restatement(spark, sf, made):
    nxt = {(r.date, r.ticker): r.next_oc for r in made.rets.where("side = 'lag' and next_oc is not null").collect()}
    table = market.queries()["parameter_grid_pca"](spark, sf).toPandas()
    assert len(table) == 3 * 4 * 3 * 2
    for lam in market.LAMBDAS:
        signal = {(r.date, r.ticker): r.signal for r in signals.subspace_signals(made.joint, made.names, 12, lam=lam).collect()}
        for q, slippage, short in ((0.15, 1.0, True), (0.3, 5.0, False), (0.25, 3.0, True)):
            row = table[(table["lambda"] == lam) & (table.q == q) & (table.slippage_bps == slippage) & (table.allow_short == short)].iloc[0]
            ar, risk, n = measured(signal, nxt, q, slippage, short)
            assert row.n_days == n and row.ar == pytest.approx(ar, rel=1e-4, abs=1e-4) and row.risk == pytest.approx(risk, rel=1e-4)
    table = market.queries()["window_sensitivity_pca"](spark, sf).toPandas()
    assert sorted(set(table.length)) == list(market.EIGEN_WINDOWS) and len(table) == 10
    for length in market.EIGEN_WINDOWS:
        signal = {(r.date, r.ticker): r.signal for r in signals.subspace_signals(made.joint, made.names, length).collect()}
        for name, gross in (("gross", True), ("net_pre_tax", False)):
            row = table[(table.length == length) & (table.set_name == name)].iloc[0]
            ar, risk, n = measured(signal, nxt, 0.3, 5.0, True, gross)
            assert row.n_days == n and row.ar == pytest.approx(ar, rel=1e-4, abs=1e-4) and row.risk == pytest.approx(risk, rel=1e-4)


def test_the_joint_matrix_is_read_once_for_all_lengths(spark, made):
    plan = signals.subspace_grid(made.joint, made.names, (6, 9, 12, 18, 24), (0.7, 0.9))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("[universe_id#") < 60
    assert len([x for x in plan.split("\n") if "Relation" in x and "ret#" in x]) <= 2  # the windows, and the first rows for the prior


# ---------------------------------------------------------------- quality


def test_quality_record_of_the_agreed_case(spark):
    n = None
    wide = {("lead", "SPY"): [0.01, 0.02, n, 0.01, 0.0], ("lead", "QQQ"): [0.01, 0.02, 0.01, 0.0, 0.02], ("lag", "1306.T"): [0.0, 0.01, 0.02, n, 0.01], ("lag", "1321.T"): [0.0, 0.01, 0.01, 0.02, 0.01], ("lag", "none"): [n] * 5}
    rows = [("u", day(i), t, o, s, v) for o, ((s, t), vs) in enumerate(wide.items()) for i, v in enumerate(vs)]
    rets = spark.createDataFrame([r for r in rows if r[2] != "none"], "universe_id string, date date, ticker string, ord int, side string, ret_cc double")
    prices = spark.createDataFrame([("u", "SPY", day(i), m) for i in range(7) for m in ("raw", "adjusted") if m == "raw" or i < 3], "universe_id string, ticker string, date date, price_mode string")
    got = {r.fill_policy: r for r in returns.quality_records(rets, prices, ("2023-12-01", None), ratio=0.5).collect()}
    assert (got["strict"].joint_rows, got["strict"].filled_cells) == (3, 0) and got["rolling_mean"].joint_rows == 5 and got["rolling_mean"].filled_cells == 2
    r = got["strict"]
    assert (r.sample_start, r.sample_end, r.effective_start, r.effective_end) == (dt.date(2023, 12, 1), day(4), day(0), day(4)) and (r.usable_lead, r.usable_lag, r.dropped_lead, r.dropped_lag) == (2, 2, [], [])
    assert (r.cache_first_date, r.cache_last_date, r.cache_isolated, r.cache_price_mode) == (day(0), day(6), True, "raw") and len(r) - 1 == 17
    assert returns.quality_records(rets, prices, mode="adjusted", ratio=0.5).first().cache_last_date == day(2)
    whole = spark.createDataFrame(rows, rets.schema)
    assert returns.quality_records(whole, prices.union(prices.limit(1)), ratio=0.5).where("fill_policy = 'strict'").select("dropped_lag", "joint_rows", "cache_isolated").first() == (["none"], 0, False)


# ---------------------------------------------------------------- the store


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_an_upsert_rewrites_only_the_months_it_touches(spark, tmp_path):
    from tideway.streaming.ingest import ingest

    path, land = str(tmp_path / "store"), str(tmp_path / "land")
    rows = [(t, dt.date(2024, m, d), mode, float(m), float(d)) for t in "ABC" for m in range(1, 7) for d in (1, 15) for mode in ("raw", "adjusted")]
    store.write_store(spark.createDataFrame(rows, store.PRICES), path)
    before = files(path)
    assert len(before) == 12
    fresh = [("A", dt.date(2024, 3, 1), "raw", 9.0, 9.0), ("D", dt.date(2024, 3, 20), "raw", 1.0, 1.0), ("B", dt.date(2024, 8, 1), "raw", 2.0, None), ("C", dt.date(2024, 5, 1), "adjusted", 7.0, 7.0), ("C", dt.date(2024, 2, 1), "raw", None, None)]
    spark.createDataFrame(fresh, store.PRICES).write.parquet(land)
    ingest(spark, land, path, str(tmp_path / "cp")).awaitTermination()
    after = files(path)
    kept = {f for f in before if after.get(f) == before[f]}
    gone = {f.rsplit("/", 1)[0] for f in before if f not in kept}
    assert gone == {"price_mode=raw/month=2024-03", "price_mode=adjusted/month=2024-05"} and {f.rsplit("/", 1)[0] for f in after if f not in before} == gone | {"price_mode=raw/month=2024-08"}
    got = store.stored(spark, path)
    assert got.count() == len(rows) + 2 and got.where("ticker = 'A' and date = '2024-03-01' and price_mode = 'raw'").first().open == 9.0
    rows = sorted(map(str, got.collect()))
    ingest(spark, land, path, str(tmp_path / "cp2")).awaitTermination()  # a new reader of the same files changes nothing
    assert sorted(map(str, store.stored(spark, path).collect())) == rows


def test_a_range_reads_its_months_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("A", dt.date(2024, m, d), mode, float(m), float(d)) for m in range(1, 13) for d in (1, 28) for mode in ("raw", "adjusted")]
    store.write_store(spark.createDataFrame(rows, store.PRICES), path)
    got = store.scan(spark, path, ["A", "B"], "2024-03-15", "2024-06-01", "raw")
    assert [(r.date.month, r.date.day) for r in got.collect()] == [(3, 28), (4, 1), (4, 28), (5, 1), (5, 28)]
    read = {f.split("month=")[1][:7] for f in got.inputFiles()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(price_mode" in plan and "month" in plan.split("PartitionFilters")[1].split("]")[0]
    metrics = store.stored(spark, path).where("price_mode = 'raw' and month >= '2024-03' and month <= '2024-05'").select(F.input_file_name().alias("f")).distinct().count()
    assert metrics == 3 and read
    assert store.scan(spark, path, ["A"], "2024-03-01", "2024-03-01", "raw").count() == 0


# ---------------------------------------------------------------- readiness, reports


def test_readiness_follows_the_files(spark, tmp_path):
    folder = str(tmp_path / "external")
    assert store.factor_status(store.load_factors(spark, folder), spark).first().factor_data_ready is False and documents.report_returns(spark, f"{folder}/report") is None
    factors = spark.createDataFrame([(day(i), 0.1, 0.2, float(i % 7), 0.0) for i in range(70)], "date date, mkt_rf double, smb double, hml double, rf double")
    store.write_factors(factors, folder, "ff3.csv")
    found = store.load_factors(spark, folder)
    assert tuple(store.factor_status(found, spark).first()) == (True, "FF3", 70, day(0), day(69))
    said = studies.readiness(None, found, "ret_sub").first()
    assert (said.reason, said.ready) == ("returns_unavailable", False)
    documents.write_returns(spark.createDataFrame([(day(i), 0.01 * i) for i in range(65)], "date date, ret_sub double"), f"{folder}/report")
    said = studies.readiness(documents.report_returns(spark, f"{folder}/report"), found, "ret_sub").first()
    assert (said.reason, said.n, said.ready) == ("ok", 65, True)
    store.write_factors(factors.withColumn("mom", F.lit(0.5)), folder, "carhart4.csv")
    assert store.factor_status(store.load_factors(spark, folder), spark).first().factor_model == "Carhart4"
    store.write_factors(factors.where("false"), folder, "carhart4.csv")
    assert store.factor_status(store.load_factors(spark, folder), spark).first().factor_data_ready in (False, None)
    flags = spark.createDataFrame([(True, True, True, False)], ", ".join(f"{x} boolean" for x in status.CONDITIONS))
    assert status.roll_up(flags).first().paper_reproduction_reason == "missing_requirements:report_available"


def test_a_daily_report_has_all_parts(spark, sf):
    rows = market.queries()["daily_reports"](spark, sf).collect()
    assert rows
    for r in rows:
        d = json.loads(r.document)
        assert list(d) == ["schema_version", "date", "generated_at_utc", "backtest", "daily_signal", "fetch", "history_entry", "slack_fallback_text"]
        assert set(d["backtest"]) == {"settings_name", "params", "judge", "performance_sets", "cost_breakdown", "eval_start"} and set(d["backtest"]["performance_sets"]) == {"gross", "net_pre_tax", "net_after_tax"}
        assert set(d["fetch"]) == {"status", "error_summary", "steps"} and "raw_signal_json" not in d["history_entry"] and d["date"] == r.date == d["daily_signal"]["signal_reference_us_date"]
        plan = d["daily_signal"]["execution_plan"]
        assert (len(plan["long"]), len(plan["short"])) == (plan["n_long"], plan["n_short"])
        if d["daily_signal"]["strategy_decision"]["action"] == "skip":
            assert plan["long"] == plan["short"] == [] and not d["daily_signal"]["tradeable"]
        assert json.loads(d["history_entry"]["dedupe_key"])["signalDate"] == r.date


def test_a_report_set_is_replaced_whole(spark, tmp_path):
    folder = documents.ReportSet(spark, str(tmp_path / "reports"))
    assert folder.manifest() is None
    table = lambda k: spark.createDataFrame([(p, i, k * 1.5 if i else None) for p in ("full", "last") for i in range(k)], "period_label string, i int, x double")
    names = ("daily", "monthly", "yearly", "summary", "vs_baseline")
    made = folder.publish({n: table(k + 1) for k, n in enumerate(names)}, "a")
    assert sorted(tuple(r) for r in made.collect()) == sorted(("a", n, p, k + 1) for k, n in enumerate(names) for p in ("full", "last"))
    assert [(r.i, r.x) for r in folder.read("yearly", "full").orderBy("i").collect()] == [(0, None), (1, 4.5), (2, 4.5)]
    with pytest.raises(ValueError, match="published"):
        folder.publish({"daily": table(1)}, "a")
    bad = spark.range(3).select(F.lit("full").alias("period_label"), F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        folder.publish({"daily": table(2), "monthly": bad}, "b")
    assert {r.run for r in folder.manifest().collect()} == {"a"} and folder.read("daily", "last").count() == 1
    folder.publish({n: table(7) for n in names}, "c")
    assert {(r.run, r.rows) for r in folder.manifest().collect()} == {("c", 7)} and folder.read("daily", "last").count() == 7 and not (tmp_path / "reports" / "a").exists()
    with pytest.raises(ValueError, match="no table"):
        folder.read("daily", "other")


# ---------------------------------------------------------------- studies


def test_annual_regression_and_its_error(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    y = 0.02 + x @ [0.5, -1.0, 0.2] + rng.normal(0, 0.02, 40)
    factors = spark.createDataFrame([(day(i), *map(float, r), 0.01) for i, r in enumerate(x)], "date date, mkt_rf double, smb double, wml double, rf double")
    days = spark.createDataFrame([("u", day(i), float(v)) for i, v in enumerate(y)] + [("few", day(i), float(y[i])) for i in range(4)] + [("u", day(99), 1.0)], "universe_id string, date date, ret double")
    got = {r.universe_id: r for r in studies.annual_regression(days, factors, "ret").collect()}
    a = np.column_stack([np.ones(40), x])
    beta, *_ = np.linalg.lstsq(a, y - 0.01, rcond=None)
    left = y - 0.01 - a @ beta
    t = beta / np.sqrt(left @ left / 36 * np.diag(np.linalg.inv(a.T @ a)))
    r = got["u"]
    assert (r.n_obs, r.error) == (40, None) and r.alpha_annual == pytest.approx(beta[0] * 252) and r.t_alpha == pytest.approx(t[0]) and r.stars == ("**" if abs(t[0]) >= 2 else "*" if abs(t[0]) >= 1.65 else "")
    assert r.betas == pytest.approx(dict(zip(("mkt_rf", "smb", "wml"), beta[1:]))) and r.t_stats == pytest.approx(dict(zip(("mkt_rf", "smb", "wml"), t[1:]))) and r.r2 == pytest.approx(1 - left @ left / ((y - 0.01 - (y - 0.01).mean()) ** 2).sum())
    assert got["few"].error == "insufficient observations: n=4, k=4" and got["few"].alpha_annual is None
    plain = studies.annual_regression(days, factors.drop("rf"), "ret").where("universe_id = 'u'").first()
    assert plain.alpha_annual == pytest.approx((beta[0] + 0.01) * 252)


def test_portfolios_of_several_series_stay_apart(spark, made):
    rows = signals.momentum_grid(made.rets, (6, 12))
    many = {(r.date, r.length): r.gross_return for r in portfolio.portfolio(rows, made.rets, params=("length",)).collect()}
    for n in (6, 12):
        one = {r.date: r.gross_return for r in portfolio.portfolio(signals.momentum(made.rets, n), made.rets).collect()}
        assert {d: v for (d, k), v in many.items() if k == n} == pytest.approx(one)


def test_the_legacy_signal_has_every_pair(spark, sf, made):
    from test_market import subspace

    joint = returns.joint(made.rets, 0.0, "rolling_mean").toPandas()
    found = subspace(joint)
    last = max(found)
    signal, weights = found[last]
    rows = market.queries()["legacy_signal"](spark, sf).toPandas()
    assert set(rows.date) == {str(last)} and len(rows) == len(weights) == 14 * 11
    assert np.allclose([weights[r.ticker, r.lead] for r in rows.itertuples()], rows.weight, atol=1e-6) and np.allclose([signal[t] for t in rows.ticker], rows.signal, atol=1e-5)
    back = {(r.ticker): r.ret for r in joint[joint.date == last].itertuples()}
    assert np.allclose([back[t] for t in rows.lead], rows.lead_return, atol=1e-6)


def test_factor_dates_lose_their_zone_and_actions_are_split(spark, tmp_path):
    (tmp_path / "ff3.csv").write_text("Date,Mkt_RF,smb\n2024-01-03T23:30:00+09:00,0.01,0.02\n2024-01-04 00:10:00-11:00,0.03,0.04\n")
    assert [r.date for r in store.load_factors(spark, str(tmp_path)).orderBy("date").collect()] == [dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
    one = spark.createDataFrame([("u", "B", day(1), "dividend", 2.0, "x"), ("u", "A", day(2), "split", 2.0, "x"), ("u", "A", day(1), "other", 1.0, "x")], "universe_id string, ticker string, date date, action_type string, value double, source string")
    two = spark.createDataFrame([("u", "B", day(1), "dividend", 2.0, "y"), ("u", "A", day(5), "dividend", 1.0, "y")], one.schema)
    rows = store.action_tables(one, two)
    assert sorted(map(tuple, rows.collect())) == [("u", "dividends", "A", day(5), 1.0), ("u", "dividends", "B", day(1), 2.0), ("u", "splits", "A", day(2), 2.0)]
    store.write_actions(rows, str(tmp_path / "actions"))
    assert sorted(p.name for p in (tmp_path / "actions").glob("table=*")) == ["table=dividends", "table=splits"]


def test_entries_are_recorded_by_the_clock_of_the_run(spark):
    from tideway.operators import daily

    row = daily.recorded(spark.range(1), F.lit("2024-12-31 15:00:00").cast("timestamp")).first()
    assert (row.cached_date, row.recorded_at) == (dt.date(2025, 1, 1), "2025/01/01 00:00:00")


def test_the_day_grain_has_a_row_for_each_day(spark, sf):
    m = market.Market(spark, sf, grain="day")
    days = m.panel.groupBy("ticker").agg(F.countDistinct("date").alias("n"), F.count("*").alias("k")).collect()
    assert all(r.n == r.k for r in days) and m.panel.select("date").distinct().count() > 1500
    with pytest.raises(ValueError, match="no"):
        market.for_days("SELECT 1", 60)


def test_saved_tables_can_be_removed(spark, tmp_path):
    save = Saved(spark, "closing")
    save(spark.range(3).toDF("x"), "t")
    folder = Path(save.root.removeprefix("file://"))
    assert folder.exists()
    save.close()
    assert not folder.exists()
