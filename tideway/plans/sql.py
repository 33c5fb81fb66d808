"""DuckDB SQL that states the same results as the queries, as common table expressions over the test tables."""

from __future__ import annotations

import re

#: Rows of a signal's window, by months and by days.
LENGTH, DAYS = 12, 60

_CTES = r"""
panel AS (
  SELECT 'all' AS universe_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_brand AS ticker, CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) AS ord,
    CASE WHEN CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) <= 11 THEN 'lead' ELSE 'lag' END AS side, CAST(CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) % 3 - 1 AS INTEGER) AS cyc,
    avg(CASE WHEN day(l_shipdate) <= 15 THEN l_extendedprice END) AS open, avg(CASE WHEN day(l_shipdate) > 15 THEN l_extendedprice END) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
dense AS (
  SELECT universe_id, date, ticker, ord, side, cyc, p.open, p.close FROM (SELECT DISTINCT universe_id, side, date FROM panel)
  JOIN (SELECT DISTINCT universe_id, side, ticker, ord, cyc FROM panel) USING (universe_id, side) LEFT JOIN panel p USING (universe_id, date, ticker, ord, side, cyc)),
padded AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close_pad FROM dense),
rets0 AS (
  SELECT *, close_pad / lag(close_pad) OVER w - 1 AS ret_cc, close / lag(close) OVER w - 1 AS ret_cc_nopad, close / open - 1 AS ret_oc, open / lag(close) OVER w - 1 AS gap,
    lead(open) OVER w / close - 1 AS next_gap, lead(open, 2) OVER w / lead(open) OVER w - 1 AS ret_oo, lead(close, 2) OVER w / lead(open) OVER w - 1 AS ret_hold
  FROM padded WINDOW w AS (PARTITION BY ticker ORDER BY date)),
rets AS (SELECT *, lead(ret_oc) OVER w AS next_oc, lead(ret_cc) OVER w AS next_cc FROM rets0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
good AS (
  SELECT date FROM (SELECT date, side, count(ret_cc) AS n, count(*) AS names FROM rets GROUP BY date, side) GROUP BY date
  HAVING count(*) = 2 AND bool_and(n >= 0.8::DOUBLE * names)),
covered AS (SELECT universe_id, date, ticker, ord, side, ret_cc AS ret FROM rets JOIN good USING (date)),
filled AS (SELECT * REPLACE (coalesce(ret, avg(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS ret) FROM covered),
joint_strict AS (SELECT * FROM covered WHERE date NOT IN (SELECT date FROM covered WHERE ret IS NULL)),
joint_fill AS (SELECT * FROM filled WHERE date NOT IN (SELECT date FROM filled WHERE ret IS NULL)),
signal AS (
  SELECT universe_id, date, ticker, signal FROM (
    SELECT universe_id, date, ticker, count(ret_cc) OVER w AS n, avg(ret_cc) OVER w AS signal FROM rets WHERE side = 'lag'
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12),
mask_all AS (
  SELECT s.*, lo, hi, signal >= hi AS cand_long, signal <= lo AS cand_short FROM signal s JOIN (
    SELECT date, count(*) AS n, quantile_cont(signal, 0.3::DOUBLE) AS lo, quantile_cont(signal, 1.0::DOUBLE - 0.3::DOUBLE) AS hi FROM signal GROUP BY date HAVING count(*) >= 3) USING (date)),
common AS (SELECT s.*, r.next_oc, r.gap FROM signal s JOIN rets r USING (universe_id, date, ticker) WHERE r.next_oc IS NOT NULL),
mask AS (
  SELECT s.*, lo, hi, signal >= hi AS cand_long, signal <= lo AS cand_short FROM common s JOIN (
    SELECT date, quantile_cont(signal, 0.3::DOUBLE) AS lo, quantile_cont(signal, 1.0::DOUBLE - 0.3::DOUBLE) AS hi FROM common GROUP BY date HAVING count(*) >= 3) USING (date)),
proxy AS (
  SELECT universe_id, date, CASE WHEN count(m) OVER w >= 10 THEN sum(m) OVER w END AS cum20_return, CASE WHEN count(m) OVER w >= 10 THEN stddev_samp(m) OVER w END AS vol20
  FROM (SELECT universe_id, date, avg(ret_cc) AS m FROM rets WHERE side = 'lag' GROUP BY ALL) WINDOW w AS (PARTITION BY universe_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
regime0 AS (SELECT * FROM proxy FULL JOIN (SELECT universe_id, date, stddev_samp(signal) AS rotation_std FROM signal GROUP BY ALL) USING (universe_id, date)),
regime AS (
  SELECT universe_id, date, CASE WHEN cum20_return > 0.03 THEN 'uptrend' WHEN cum20_return < -0.03 THEN 'downtrend' ELSE 'sideways' END AS trend_regime,
    CASE WHEN vol20 <= v25 THEN 'low_vol' WHEN vol20 >= v75 THEN 'high_vol' ELSE 'mid_vol' END AS vol_regime,
    CASE WHEN rotation_std <= r25 THEN 'weak_rotation' WHEN rotation_std >= r75 THEN 'strong_rotation' ELSE 'mid_rotation' END AS rotation_regime, cum20_return, vol20, rotation_std
  FROM regime0, (SELECT quantile_cont(vol20, 0.25::DOUBLE) AS v25, quantile_cont(vol20, 0.75::DOUBLE) AS v75, quantile_cont(rotation_std, 0.25::DOUBLE) AS r25, quantile_cont(rotation_std, 0.75::DOUBLE) AS r75 FROM regime0)),
positions AS (
  SELECT *, CASE WHEN cand_short AND signal <= 0 THEN 'SHORT' WHEN cand_long AND signal >= 0 THEN 'LONG' ELSE 'neutral' END AS position, 0.0::DOUBLE AS lt, 0.0::DOUBLE AS st FROM mask_all),
stats AS (
  SELECT universe_id, date, max(signal) AS signal_max, min(signal) AS signal_min, quantile_cont(signal, 0.25::DOUBLE) AS signal_p25, quantile_cont(signal, 0.5::DOUBLE) AS signal_p50, quantile_cont(signal, 0.75::DOUBLE) AS signal_p75,
    count(*) FILTER (cand_long) AS candidate_long, count(*) FILTER (cand_short) AS candidate_short, count(*) FILTER (position = 'LONG') AS adopted_long, count(*) FILTER (position = 'SHORT') AS adopted_short,
    array_to_string((list(ticker ORDER BY signal DESC, ticker) FILTER (cand_long))[1:5], '|') AS top_long, array_to_string((list(ticker ORDER BY signal, ticker) FILTER (cand_short))[1:5], '|') AS top_short,
    round(max(signal) FILTER (cand_long) - max(lt), 6) AS long_gap_max, round(max(st) - min(signal) FILTER (cand_short), 6) AS short_gap_max,
    coalesce(avg(signal) FILTER (cand_long), 0) - coalesce(avg(signal) FILTER (cand_short), 0) AS candidate_strength,
    coalesce(avg(signal) FILTER (position = 'LONG') - avg(signal) FILTER (position = 'SHORT'), 0) AS trade_strength
  FROM positions GROUP BY ALL),
pf0 AS (
  SELECT universe_id, date, avg(next_oc) FILTER (cand_long AND signal >= 0) AS l, avg(next_oc) FILTER (cand_short AND signal <= 0) AS s, count(*) FILTER (cand_long AND signal >= 0) AS n_long, count(*) FILTER (cand_short AND signal <= 0) AS n_short
  FROM mask GROUP BY ALL HAVING count(*) FILTER (cand_long AND signal >= 0) > 0),
pf AS (
  SELECT universe_id, date, gross_return, commission_cost, slippage_cost, borrow_cost, gross_return - commission_cost - slippage_cost - borrow_cost AS net_pre_tax_return, ln AS long_notional, sn AS short_notional, n_long, n_short FROM (
    SELECT *, coalesce(l, 0) - coalesce(s, 0) AS gross_return, 0.001 * (ln + sn) AS commission_cost, 0.001 * (ln + sn) AS slippage_cost, 0.015::DOUBLE / 252 * sn AS borrow_cost
    FROM (SELECT *, CASE WHEN n_long > 0 THEN 1.0::DOUBLE ELSE 0 END AS ln, CASE WHEN n_short > 0 THEN 1.0::DOUBLE ELSE 0 END AS sn FROM pf0))),
context AS (
  SELECT universe_id, date, open_gap, long_gap, short_gap, NULL::DOUBLE AS candidate_signal_strength, trend_regime, vol_regime, rotation_regime
  FROM (SELECT universe_id, date, avg(gap) FILTER (cand_long) AS long_gap, avg(gap) FILTER (cand_short) AS short_gap FROM mask GROUP BY ALL)
  LEFT JOIN (SELECT universe_id, date, avg(gap) AS open_gap FROM rets WHERE side = 'lag' GROUP BY ALL) USING (universe_id, date) LEFT JOIN regime USING (universe_id, date)),
decisions AS (
  SELECT universe_id, date, unnest(['rule_406', 'rule_406_no_flip', 'rule_399', 'rule_13', 'rule_87', 'rule_1357']) AS rule_id, unnest([
    CASE WHEN NOT coalesce(abs(open_gap) <= 0.015, false) OR coalesce(rotation_regime = 'weak_rotation', false) THEN 'skip' WHEN coalesce(abs(short_gap) > 0.010, false) THEN 'long_flip_oc' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(abs(open_gap) <= 0.015, false) OR coalesce(rotation_regime = 'weak_rotation', false) THEN 'skip' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(candidate_signal_strength >= 0.3, false) THEN 'skip' WHEN coalesce(vol_regime = 'high_vol' AND abs(open_gap) > 0.005, false) THEN 'long_flip_oc' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(vol_regime = 'high_vol' OR rotation_regime = 'strong_rotation', false) THEN 'skip' WHEN coalesce(abs(short_gap) > 0.010, false) THEN 'short_only_oc' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(vol_regime = 'high_vol' OR rotation_regime = 'strong_rotation', false) THEN 'skip' WHEN coalesce(abs(short_gap) > 0.0075, false) THEN 'lgap_oc' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(trend_regime IN ('uptrend', 'downtrend'), false) THEN 'skip' WHEN coalesce(abs(open_gap) > 0.0075, false) THEN 'lgap_oc' ELSE 'gap_ovht_oc' END]) AS strategy
  FROM context),
rule_rows AS (
  SELECT *, CASE WHEN strategy IN ('long_flip_oc', 'short_only_oc') THEN false WHEN strategy IN ('gap_ovht_oc', 'lgap_oc') THEN l AND NOT coalesce(gap > 0.005, false) ELSE l END AS lm,
    CASE WHEN strategy = 'long_flip_oc' THEN l OR s WHEN strategy = 'short_only_oc' THEN cand_short WHEN strategy = 'gap_ovht_oc' THEN s AND NOT coalesce(gap < -0.005, false) ELSE s END AS sm
  FROM (SELECT m.*, rule_id, strategy, cand_long AND signal >= 0 AS l, cand_short AND signal <= 0 AS s FROM mask m JOIN decisions d USING (universe_id, date) WHERE strategy <> 'skip')),
rule_pf AS (
  SELECT universe_id, date, rule_id, strategy AS strategy_decision, g AS gross_return, 0.001 * (ln + sn) AS commission_cost, 0.001 * (ln + sn) AS slippage_cost, 0.015::DOUBLE / 252 * sn AS borrow_cost, g - 0.002 * (ln + sn) - 0.015::DOUBLE / 252 * sn AS net_pre_tax_return,
    ln AS long_notional, sn AS short_notional, n_long, n_short
  FROM (SELECT *, coalesce(l, 0) - coalesce(s, 0) AS g, CASE WHEN n_long > 0 THEN 1.0::DOUBLE ELSE 0 END AS ln, CASE WHEN n_short > 0 THEN 1.0::DOUBLE ELSE 0 END AS sn FROM (
    SELECT universe_id, date, rule_id, strategy, avg(next_oc) FILTER (lm) AS l, avg(next_oc) FILTER (sm) AS s, count(*) FILTER (lm) AS n_long, count(*) FILTER (sm) AS n_short FROM rule_rows GROUP BY ALL))
  WHERE n_long > 0 OR (n_short > 0 AND strategy IN ('long_flip_oc', 'short_only_oc'))),
net AS (SELECT universe_id, date, net_pre_tax_return AS ret FROM pf),
years AS (SELECT universe_id, year(date) AS year, sum(ret) AS pnl, max(date) AS last, row_number() OVER (PARTITION BY universe_id ORDER BY year(date)) AS k FROM net GROUP BY universe_id, year(date)),
fold AS (
  SELECT universe_id, k, year, pnl, last, greatest(0, pnl) * 0.20315::DOUBLE AS tax, CASE WHEN pnl < 0 THEN -pnl ELSE 0 END AS l1, 0.0::DOUBLE AS l2, 0.0::DOUBLE AS l3 FROM years WHERE k = 1
  UNION ALL
  SELECT y.universe_id, y.k, y.year, y.pnl, y.last, greatest(0, y.pnl - f.l1 - f.l2 - f.l3) * 0.20315::DOUBLE, CASE WHEN y.pnl < 0 THEN -y.pnl ELSE 0 END,
    f.l1 - least(f.l1, greatest(0, greatest(0, y.pnl) - f.l3 - f.l2)), f.l2 - least(f.l2, greatest(0, greatest(0, y.pnl) - f.l3))
  FROM fold f JOIN years y ON y.universe_id = f.universe_id AND y.k = f.k + 1),
taxed AS (SELECT n.universe_id, n.date, n.ret, coalesce(tax, 0) AS tax_paid, n.ret - coalesce(tax, 0) AS net_after_tax FROM net n LEFT JOIN fold f ON f.universe_id = n.universe_id AND f.last = n.date),
sets AS (
  SELECT universe_id, 'gross' AS set_name, date, gross_return AS ret FROM pf UNION ALL SELECT universe_id, 'net_pre_tax', date, net_pre_tax_return FROM pf UNION ALL SELECT universe_id, 'net_after_tax', date, net_after_tax FROM taxed),
equity0 AS (SELECT *, product(1 + ret) OVER w AS equity FROM sets WINDOW w AS (PARTITION BY universe_id, set_name ORDER BY date ROWS UNBOUNDED PRECEDING)),
equity AS (SELECT *, equity / max(equity) OVER (PARTITION BY universe_id, set_name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM equity0),
perf AS (
  SELECT universe_id, set_name, avg(ret) * 12 * 100 AS ar, stddev_samp(ret) * sqrt(12) * 100 AS risk, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)) END AS rr, min(drawdown) * 100 AS mdd, count(*) AS n_days FROM equity GROUP BY ALL),
scenario AS (
  SELECT * FROM (VALUES ('S01_CurrOC', 'orig', 'oc', 'none'), ('S02_FlipL_OC', 'flip_l', 'oc', 'none'), ('S03_CurrCC', 'orig', 'cc', 'none'), ('S04_FlipL_CC', 'flip_l', 'cc', 'none'), ('S05_CurrOO', 'orig', 'oo', 'none'),
    ('S06_Curr1D', 'orig', '1d', 'none'), ('S08_GapOvht05', 'orig', 'oc', 'both'), ('S09_LGapFlt05', 'orig', 'oc', 'long'), ('S10_ShortOnly', 'short_only', 'oc', 'none')) t(scenario_id, direction, horizon, filter_)),
sc_rows AS (
  SELECT s.universe_id, s.date, s.ticker, s.signal, coalesce(r.next_gap, 0) AS g, c.*, CASE horizon WHEN 'oc' THEN r.next_oc WHEN 'cc' THEN r.next_cc WHEN 'oo' THEN r.ret_oo ELSE r.ret_hold END AS ret
  FROM signal s LEFT JOIN rets r USING (universe_id, date, ticker), scenario c),
sc_head AS (SELECT universe_id, date, scenario_id, direction, count(*) AS n_signal, count(ret) AS n_ret FROM sc_rows GROUP BY ALL),
sc_mask AS (
  SELECT r.*, signal >= hi AND signal >= 0.02 AS cl, signal <= lo AND signal <= -0.02 AS cs FROM sc_rows r JOIN (
    SELECT date, scenario_id, quantile_cont(signal, 0.3::DOUBLE) AS lo, quantile_cont(signal, 1.0::DOUBLE - 0.3::DOUBLE) AS hi FROM sc_rows WHERE ret IS NOT NULL GROUP BY ALL) USING (date, scenario_id) WHERE ret IS NOT NULL),
sc_legs AS (
  SELECT universe_id, date, scenario_id, count(*) FILTER (cl) AS cl, count(*) FILTER (cs) AS cs, count(*) FILTER (l) AS nl, count(*) FILTER (s) AS ns, avg(ret) FILTER (l) AS lr, avg(ret) FILTER (s) AS sr
  FROM (SELECT *, cl AND (filter_ = 'none' OR g <= 0.005) AS l, cs AND (filter_ <> 'both' OR g >= -0.005) AS s FROM sc_mask) GROUP BY ALL),
sc0 AS (
  SELECT *, CASE WHEN n_signal < 3 THEN 'insufficient_signal' WHEN n_ret = 0 THEN 'no_jp_return_data' WHEN n_ret < 2 THEN 'too_few_common_tickers' WHEN nl + ns = 0 AND cl + cs = 0 THEN 'no_threshold_candidates' WHEN nl + ns = 0 THEN 'gap_filter_removed_all' END AS skip_reason
  FROM sc_head LEFT JOIN sc_legs USING (universe_id, date, scenario_id)),
sc1 AS (
  SELECT *, skip_reason IS NULL AS tradeable, CASE WHEN skip_reason IS NOT NULL THEN 0 WHEN direction = 'orig' THEN coalesce(lr, 0) WHEN direction = 'flip_l' THEN -coalesce(lr, 0) ELSE 0 END AS long_contrib, CASE WHEN skip_reason IS NULL THEN -coalesce(sr, 0) ELSE 0 END AS short_contrib FROM sc0),
sc AS (
  SELECT universe_id, date, scenario_id, CASE WHEN NOT tradeable THEN 0 WHEN nl > 0 AND ns > 0 THEN 0.5::DOUBLE * long_contrib + 0.5::DOUBLE * short_contrib WHEN nl > 0 THEN long_contrib ELSE short_contrib END AS gross, long_contrib, short_contrib, tradeable, skip_reason,
    CASE WHEN n_signal < 3 OR n_ret < 2 THEN 0 ELSE coalesce(cl, 0) END AS cand_long, CASE WHEN n_signal < 3 OR n_ret < 2 THEN 0 ELSE coalesce(cs, 0) END AS cand_short, CASE WHEN tradeable THEN nl ELSE 0 END AS adopt_long, CASE WHEN tradeable THEN ns ELSE 0 END AS adopt_short FROM sc1),
bounds AS (
  SELECT universe_id, period_label, min(date) AS start_date, max(date) AS end_date FROM (SELECT universe_id, date, row_number() OVER (PARTITION BY universe_id ORDER BY date DESC) AS back FROM (SELECT DISTINCT universe_id, date FROM signal)),
    (VALUES ('full_period', NULL), ('trailing_5y', 60), ('trailing_3y', 36), ('trailing_2y', 24), ('trailing_1y', 12)) p(period_label, n) WHERE n IS NULL OR back <= n GROUP BY ALL),
pd0 AS (SELECT sc.*, period_label, gross - CASE WHEN tradeable THEN 0.001::DOUBLE ELSE 0 END AS ret FROM sc JOIN bounds USING (universe_id) WHERE date BETWEEN start_date AND end_date),
pd_years AS (SELECT period_label, scenario_id, year(date) AS year, sum(ret) AS pnl, max(date) AS last, row_number() OVER (PARTITION BY period_label, scenario_id ORDER BY year(date)) AS k FROM pd0 GROUP BY period_label, scenario_id, year(date)),
pd_fold AS (
  SELECT period_label, scenario_id, k, pnl, last, greatest(0, pnl) * 0.20315::DOUBLE AS tax, CASE WHEN pnl < 0 THEN -pnl ELSE 0 END AS l1, 0.0::DOUBLE AS l2, 0.0::DOUBLE AS l3 FROM pd_years WHERE k = 1
  UNION ALL
  SELECT y.period_label, y.scenario_id, y.k, y.pnl, y.last, greatest(0, y.pnl - f.l1 - f.l2 - f.l3) * 0.20315::DOUBLE, CASE WHEN y.pnl < 0 THEN -y.pnl ELSE 0 END,
    f.l1 - least(f.l1, greatest(0, greatest(0, y.pnl) - f.l3 - f.l2)), f.l2 - least(f.l2, greatest(0, greatest(0, y.pnl) - f.l3))
  FROM pd_fold f JOIN pd_years y ON y.period_label = f.period_label AND y.scenario_id = f.scenario_id AND y.k = f.k + 1),
pd AS (
  SELECT universe_id, period_label, scenario_id, date, tradeable, skip_reason, round(gross * 100, 6) AS gross_pct, round(ret * 100, 6) AS net_pre_tax_pct, round((ret - coalesce(tax, 0)) * 100, 6) AS net_after_tax_pct, round(long_contrib * 100, 6) AS long_pct, round(short_contrib * 100, 6) AS short_pct,
    cand_long, cand_short, adopt_long, adopt_short FROM pd0 LEFT JOIN (SELECT period_label, scenario_id, last AS date, tax FROM pd_fold) USING (period_label, scenario_id, date)),
pd_runs AS (
  SELECT universe_id, period_label, scenario_id, coalesce(max(n) FILTER (win), 0) AS max_wins, coalesce(max(n) FILTER (NOT win), 0) AS max_losses FROM (
    SELECT universe_id, period_label, scenario_id, win, i, count(*) AS n FROM (
      SELECT *, gross_pct / 100 > 0 AS win, row_number() OVER (PARTITION BY period_label, scenario_id ORDER BY date) - row_number() OVER (PARTITION BY period_label, scenario_id, gross_pct / 100 > 0 ORDER BY date) AS i FROM pd) GROUP BY ALL) GROUP BY ALL),
pd_dd AS (
  SELECT period_label, scenario_id, min(e / m - 1) * 100 AS mdd_pct FROM (SELECT *, max(e) OVER (PARTITION BY period_label, scenario_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (
    SELECT *, product(1 + gross_pct / 100) OVER (PARTITION BY period_label, scenario_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM pd)) GROUP BY ALL),
summary AS (
  SELECT universe_id, period_label, start_date, end_date, scenario_id, coalesce(n_days, 0) AS n_days, gross_avg_pct, gross_cumulative_pct, net_pre_tax_avg_pct, net_pre_tax_cumulative_pct, net_avg_pct, net_cumulative_pct, median_pct, win_rate, long_avg_pct, short_avg_pct, mdd_pct, max_wins, max_losses,
    CASE WHEN n_days IS NULL THEN 'no_data' END AS notes
  FROM bounds CROSS JOIN (SELECT scenario_id FROM scenario) LEFT JOIN (
    SELECT universe_id, period_label, scenario_id, count(*) AS n_days, avg(gross_pct) AS gross_avg_pct, (product(1 + gross_pct / 100) - 1) * 100 AS gross_cumulative_pct, avg(net_pre_tax_pct) AS net_pre_tax_avg_pct, (product(1 + net_pre_tax_pct / 100) - 1) * 100 AS net_pre_tax_cumulative_pct,
      avg(net_after_tax_pct) AS net_avg_pct, (product(1 + net_after_tax_pct / 100) - 1) * 100 AS net_cumulative_pct, quantile_cont(gross_pct, 0.5::DOUBLE) AS median_pct, avg(CASE WHEN gross_pct > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(long_pct) AS long_avg_pct, avg(short_pct) AS short_avg_pct FROM pd GROUP BY ALL)
    USING (universe_id, period_label, scenario_id) LEFT JOIN pd_dd USING (period_label, scenario_id) LEFT JOIN pd_runs USING (universe_id, period_label, scenario_id)),
leadf AS (
  SELECT universe_id, date, mean, median, iqr, breadth, breadth_down, top3, bottom3, top3 - bottom3 AS top_bottom_spread, sd, range, abs_mean, skew, kurt, cyclical, defensive, financial, energy, growth, consumer, cyclical - defensive AS spread, growth - defensive AS growth_vs_def, energy - rest_e AS energy_vs_rest,
    financial - rest_f AS financial_vs_rest, top1 / nullif(moved, 0) AS top1_share, big3 / nullif(moved, 0) AS top3_share, least1 / nullif(moved, 0) AS bottom1_share, top1 / nullif(moved, 0) * n AS narrowness
  FROM (SELECT universe_id, date, avg(ret_cc) AS mean, quantile_cont(ret_cc, 0.5::DOUBLE) AS median, quantile_cont(ret_cc, 0.75::DOUBLE) - quantile_cont(ret_cc, 0.25::DOUBLE) AS iqr, avg(CASE WHEN ret_cc > 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth, avg(CASE WHEN ret_cc < 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth_down,
      list_avg((list(ret_cc ORDER BY ret_cc DESC))[1:3]) AS top3, list_avg((list(ret_cc ORDER BY ret_cc))[1:3]) AS bottom3, stddev_samp(ret_cc) AS sd, max(ret_cc) - min(ret_cc) AS range, avg(abs(ret_cc)) AS abs_mean, avg(ret_cc) FILTER (cyc = 1) AS cyclical, avg(ret_cc) FILTER (cyc = -1) AS defensive,
      (avg(ret_cc * ret_cc * ret_cc) - 3 * avg(ret_cc) * avg(ret_cc * ret_cc) + 2 * pow(avg(ret_cc), 3)) / pow(stddev_pop(ret_cc), 3) AS skew, kurtosis_pop(ret_cc) AS kurt, avg(ret_cc) FILTER (ord = 1) AS financial, avg(ret_cc) FILTER (ord IN (2, 3)) AS energy, avg(ret_cc) FILTER (ord = 4) AS growth, avg(ret_cc) FILTER (ord IN (5, 6)) AS consumer,
      avg(ret_cc) FILTER (ord NOT IN (2, 3)) AS rest_e, avg(ret_cc) FILTER (ord <> 1) AS rest_f, sum(abs(ret_cc)) AS moved, max(abs(ret_cc)) AS top1, list_sum((list(abs(ret_cc) ORDER BY abs(ret_cc) DESC))[1:3]) AS big3, min(abs(ret_cc)) AS least1, count(*) AS n
    FROM rets WHERE side = 'lead' AND ret_cc IS NOT NULL GROUP BY ALL)),
tracked AS (
  SELECT 'Brand#' || i AS ticker, CASE WHEN i <= 11 THEN 'lead' ELSE 'lag' END AS side, n, last FROM range(1, 26) t(i)
  LEFT JOIN (SELECT ticker, count(*) AS n, max(date) AS last FROM panel WHERE open IS NOT NULL OR close IS NOT NULL GROUP BY ticker) p ON p.ticker = 'Brand#' || i),
cache AS (
  SELECT 'all' AS universe_id, coalesce(sum(n), 0)::BIGINT AS rows, min(last) FILTER (side = 'lead') AS lead_min, max(last) FILTER (side = 'lead') AS lead_max, min(last) FILTER (side = 'lag') AS lag_min, max(last) FILTER (side = 'lag') AS lag_max,
    coalesce(string_agg(ticker, '|' ORDER BY ticker) FILTER (last IS NULL), '') AS missing, coalesce(string_agg(ticker, '|' ORDER BY ticker) FILTER (last < DATE '2001-11-01'), '') AS stale FROM tracked),
flags AS (
  SELECT universe_id, coalesce(lead_min = lead_max, false) AND coalesce(lag_min = lag_max, false) AS aligned, missing = '' AND stale = '' AND coalesce(lead_min = lead_max, false) AND coalesce(lag_min = lag_max, false) AS ready, missing = '' AND stale = '' AND lead_max IS NOT NULL AND lag_max IS NOT NULL AS fresh,
    missing <> '' OR stale <> '' AS behind, lead_max, lag_max, (SELECT count(*) FROM (SELECT ticker FROM covered WHERE side = 'lead' GROUP BY ticker HAVING count(ret) > 0)) AS lead_n, (SELECT count(*) FROM (SELECT ticker FROM covered WHERE side = 'lag' GROUP BY ticker HAVING count(ret) > 0)) AS lag_n FROM cache),
runs AS (
  SELECT universe_id, date, CASE WHEN nxt IS NULL THEN date + 1 + CASE WHEN isodow(date + 1) > 5 THEN (8 - isodow(date + 1))::INT ELSE 0 END WHEN nxt - date <= 366 THEN nxt END AS execution_date,
    CASE WHEN nxt IS NULL THEN 'weekday_fallback' WHEN nxt - date <= 366 THEN 'jpx_calendar' ELSE 'jpx_calendar_unavailable' END AS source, CASE WHEN nxt - date <= 14 THEN 14 WHEN nxt - date <= 60 THEN 60 WHEN nxt - date <= 366 THEN 366 END AS horizon
  FROM (SELECT universe_id, date, (SELECT min(b.date) FROM panel b WHERE b.side = 'lag' AND b.date > a.date) AS nxt FROM (SELECT DISTINCT universe_id, date FROM mask_all) a)),
run_gaps AS (
  SELECT universe_id, r.date, gap_date, ticker, gap FROM (SELECT r.universe_id, r.date, max(h.date) AS gap_date FROM runs r JOIN (SELECT DISTINCT date FROM rets WHERE side = 'lag') h ON r.execution_date IS NULL OR h.date <= r.execution_date GROUP BY ALL) r
  JOIN (SELECT date AS gap_date, ticker, gap FROM rets WHERE side = 'lag') g USING (gap_date)),
run_context AS (
  SELECT universe_id, date, open_gap, long_gap, short_gap, nullif(round(candidate_strength, 6), 0.0::DOUBLE) AS candidate_signal_strength, coalesce(trend_regime, 'sideways') AS trend_regime, coalesce(vol_regime, 'mid_vol') AS vol_regime, coalesce(rotation_regime, 'mid_rotation') AS rotation_regime
  FROM stats LEFT JOIN (SELECT date, avg(gap) AS open_gap FROM run_gaps GROUP BY date) USING (date) LEFT JOIN (
    SELECT p.date, avg(gap) FILTER (cand_long AND NOT (position = 'SHORT' AND signal >= lt)) AS long_gap, avg(gap) FILTER (cand_short) AS short_gap FROM positions p LEFT JOIN run_gaps g USING (universe_id, date, ticker) GROUP BY p.date) USING (date)
  LEFT JOIN (SELECT date, trend_regime, vol_regime, rotation_regime FROM regime) USING (date)),
run_decisions AS (
  SELECT universe_id, date, unnest(['rule_406', 'rule_406_no_flip', 'rule_399', 'rule_13', 'rule_87', 'rule_1357']) AS rule_id, unnest([
    CASE WHEN NOT coalesce(abs(open_gap) <= 0.015, false) OR coalesce(rotation_regime = 'weak_rotation', false) THEN 'skip' WHEN coalesce(abs(short_gap) > 0.010, false) THEN 'long_flip_oc' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(abs(open_gap) <= 0.015, false) OR coalesce(rotation_regime = 'weak_rotation', false) THEN 'skip' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(candidate_signal_strength >= 0.3, false) THEN 'skip' WHEN coalesce(vol_regime = 'high_vol' AND abs(open_gap) > 0.005, false) THEN 'long_flip_oc' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(vol_regime = 'high_vol' OR rotation_regime = 'strong_rotation', false) THEN 'skip' WHEN coalesce(abs(short_gap) > 0.010, false) THEN 'short_only_oc' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(vol_regime = 'high_vol' OR rotation_regime = 'strong_rotation', false) THEN 'skip' WHEN coalesce(abs(short_gap) > 0.0075, false) THEN 'lgap_oc' ELSE 'gap_ovht_oc' END,
    CASE WHEN NOT coalesce(trend_regime IN ('uptrend', 'downtrend'), false) THEN 'skip' WHEN coalesce(abs(open_gap) > 0.0075, false) THEN 'lgap_oc' ELSE 'gap_ovht_oc' END]) AS strategy
  FROM run_context),
after_rule AS (
  SELECT p.* EXCLUDE (position), position AS before, strategy, CASE WHEN strategy = 'skip' THEN 'neutral' WHEN strategy = 'gap_ovht_oc' AND (position = 'LONG' AND coalesce(gap > 0.005, false) OR position = 'SHORT' AND coalesce(gap < -0.005, false)) THEN 'neutral' ELSE position END AS position
  FROM positions p LEFT JOIN (SELECT universe_id, date, strategy FROM run_decisions WHERE rule_id = 'rule_406_no_flip') USING (universe_id, date) LEFT JOIN run_gaps USING (universe_id, date, ticker)),
plan0 AS (
  SELECT p.universe_id, p.date, p.ticker, p.position, p.signal, CASE WHEN CAST(regexp_extract(p.ticker, '(\d+)$', 1) AS INTEGER) <= 20 THEN 'Sector ' || (CAST(regexp_extract(p.ticker, '(\d+)$', 1) AS INTEGER) % 5) ELSE p.ticker END AS sector, close, round_even(close, 0)::BIGINT AS latest_price
  FROM after_rule p LEFT JOIN panel USING (universe_id, date, ticker) WHERE p.position <> 'neutral'),
plan AS (
  SELECT * EXCLUDE (close), round(100.0::DOUBLE / count(*) OVER (PARTITION BY date, position), 1) AS weight_pct, round_even(close * 10, 0)::BIGINT AS min_purchase,
    CASE WHEN latest_price > 0 THEN greatest(1, round_even(max(latest_price) OVER (PARTITION BY date) / latest_price, 0)::BIGINT) END AS lots FROM plan0),
known0 AS (
  SELECT r.universe_id, r.date, t.side, t.ticker, count(p.date) AS rows, max(p.date) AS last
  FROM runs r CROSS JOIN (SELECT 'Brand#' || i AS ticker, CASE WHEN i <= 11 THEN 'lead' ELSE 'lag' END AS side FROM range(1, 26) g(i)) t
  LEFT JOIN panel p ON p.ticker = t.ticker AND (p.open IS NOT NULL OR p.close IS NOT NULL) AND p.date <= CASE WHEN t.side = 'lag' THEN coalesce(r.execution_date, r.date) ELSE r.date END GROUP BY ALL),
known1 AS (
  SELECT universe_id, date, sum(rows)::BIGINT AS rows, min(last) FILTER (side = 'lead') AS lead_min, max(last) FILTER (side = 'lead') AS lead_max, min(last) FILTER (side = 'lag') AS lag_min, max(last) FILTER (side = 'lag') AS lag_max,
    coalesce(string_agg(ticker, '|' ORDER BY ticker) FILTER (last IS NULL), '') AS missing, coalesce(string_agg(ticker, '|' ORDER BY ticker) FILTER (last < date), '') AS stale FROM known0 GROUP BY ALL),
known AS (
  SELECT *, coalesce(lead_min = lead_max, false) AND coalesce(lag_min = lag_max, false) AS dates_aligned, missing = '' AND stale = '' AND coalesce(lead_min = lead_max, false) AND coalesce(lag_min = lag_max, false) AS signal_ready,
    missing = '' AND stale = '' AND lead_max IS NOT NULL AND lag_max IS NOT NULL AS freshness_ok, (SELECT count(DISTINCT ticker) FROM covered c WHERE c.side = 'lead' AND c.ret IS NOT NULL AND c.date <= k.date) AS usable_lead,
    (SELECT count(DISTINCT ticker) FROM covered c WHERE c.side = 'lag' AND c.ret IS NOT NULL AND c.date <= k.date) AS usable_lag FROM known1 k),
held AS (SELECT date, string_agg('"' || ticker || '"', ',' ORDER BY ticker) FILTER (position = 'LONG') AS longs, string_agg('"' || ticker || '"', ',' ORDER BY ticker) FILTER (position = 'SHORT') AS shorts FROM plan GROUP BY date),
actions AS (
  SELECT universe_id, ticker, date, 'dividend' AS action_type, close / 100 AS value, 'orders' AS source FROM panel WHERE month(date) IN (3, 9) AND close / 100 > 0
  UNION ALL SELECT universe_id, ticker, date, 'split', 2.0::DOUBLE, 'orders' FROM panel WHERE month(date) = 6 AND open > close * 1.05::DOUBLE),
verified AS (
  SELECT universe_id, coverage_ratio, covered, total, actions_start, actions_end, least_events, CASE WHEN total = 0 THEN 'actions_data_unavailable' WHEN NOT (actions_start <= DATE '1995-01-01' AND actions_end >= DATE '2001-09-01') THEN 'required_range_not_covered' WHEN coverage_ratio < 0.6 THEN 'coverage_ratio_below_threshold' WHEN total < least_events THEN 'insufficient_actions_events' ELSE 'ok' END AS reason_code
  FROM (SELECT 'all' AS universe_id, count(DISTINCT ticker) / 25.0::DOUBLE AS coverage_ratio, count(DISTINCT ticker) AS covered, count(*) AS total, min(date) AS actions_start, max(date) AS actions_end, 10::BIGINT AS least_events FROM actions)),
recovery AS (
  SELECT * FROM scenario UNION ALL SELECT * FROM (VALUES ('S07_GapFlt05', 'orig', 'oc', 'abs'), ('S11_FlipLGapFlt', 'flip_l', 'oc', 'both'), ('S12_HighVol', 'orig', 'oc', 'none'), ('S13_NoMidVol', 'orig', 'oc', 'none'), ('S14_FlipL_HiVol', 'flip_l', 'oc', 'none'), ('S15_HighSig', 'orig', 'oc', 'none')) t(scenario_id, direction, horizon, filter_))
"""


def _between(start: str, end: str) -> str:
    """The text of an expression, without its name and brackets."""
    at = _CTES.index(f"{start} AS (") + len(start) + 5
    return _CTES[at : _CTES.index(f"{end} AS (", at)].strip().rstrip(",").removesuffix(")")


def _held(after: str) -> str:
    return f"SELECT universe_id, date, max(strategy) AS strategy, count(*) FILTER (position = 'LONG') AS n_long, count(*) FILTER (position = 'SHORT') AS n_short, coalesce(avg(signal) FILTER (position = 'LONG') - avg(signal) FILTER (position = 'SHORT'), 0) AS strength FROM ({after}) GROUP BY ALL"


def _class(long: str, short: str, warning: str) -> str:
    near = "coalesce(long_gap_max > -0.03, false)", "coalesce(short_gap_max > -0.03, false)"
    return f"CASE WHEN {long} >= 1 AND {short} >= 1 THEN NULL WHEN {long} >= 1 OR {short} >= 1 THEN 'one_side_only' WHEN {warning} AND {near[0]} AND {near[1]} THEN 'regime_blocked' WHEN {near[0]} OR {near[1]} THEN 'near_miss_threshold' ELSE 'hard_no_signal' END"


def gate(after: str, stats: str, mode: str, spread: float, least: int) -> str:
    """Tradeability after the rule: ``after`` has the positions that are held, ``stats`` the counts before the rule."""
    warning = "coalesce(trend_regime = 'downtrend' OR vol_regime = 'high_vol', false)"
    return f"""
  SELECT universe_id, date, execution_date, source, NOT skip AND reason IS NULL AS tradeable, CASE WHEN skip THEN 'strategy_rule_skip' ELSE reason END AS block_reason,
    CASE WHEN skip AND adopted_long >= 1 AND adopted_short >= 1 THEN 'strategy_rule_skip_with_candidates' WHEN skip THEN 'strategy_rule_skip' ELSE cls END AS no_trade,
    CASE WHEN strategy IS NULL OR strategy = 'curr_oc' THEN cls ELSE cls_after END AS class_after, '{mode}' = 'development' AND source = 'weekday_fallback' AS calendar_warning, n_long, n_short, strength, strategy
  FROM (SELECT *, coalesce(strategy = 'skip', false) AS skip, {_class("adopted_long", "adopted_short", warning)} AS cls, {_class("n_long", "n_short", "false")} AS cls_after,
      CASE WHEN NOT freshness_ok THEN 'freshness_not_ok' WHEN NOT dates_aligned THEN 'cache_dates_not_aligned' WHEN usable_lead < 1 OR usable_lag < 1 THEN 'too_few_usable_tickers' WHEN execution_date IS NULL THEN 'no_execution_target_date'
        WHEN '{mode}' = 'production' AND source <> 'jpx_calendar' THEN 'calendar_source_untrusted' WHEN candidate_long > 0 AND n_long = 0 THEN 'no_long_candidates_after_threshold' WHEN candidate_short > 0 AND n_short = 0 THEN 'no_short_candidates_after_threshold'
        WHEN n_long = 0 OR n_short = 0 THEN 'too_few_usable_tickers' WHEN n_long < {least} OR n_short < {least} THEN 'insufficient_positions_after_threshold' WHEN strength < {spread} THEN 'signal_spread_too_small' END AS reason
    FROM ({stats}) JOIN runs USING (universe_id, date) JOIN known USING (universe_id, date) JOIN ({_held(after)}) USING (universe_id, date) LEFT JOIN (SELECT universe_id, date, trend_regime, vol_regime FROM regime) USING (universe_id, date))"""


def gates_sql(settings) -> str:
    """The gate under several settings (name, mode, whether the rule holds, threshold, least spread, least count)."""
    each = []
    for name, mode, rule, t, spread, least in settings:
        positions = f"SELECT * EXCLUDE (position, lt, st), CASE WHEN cand_short AND signal <= -{t} THEN 'SHORT' WHEN cand_long AND signal >= {t} THEN 'LONG' ELSE 'neutral' END AS position, {t}::DOUBLE AS lt, -{t}::DOUBLE AS st FROM positions"
        after = _between("after_rule", "plan0").replace("FROM positions p", f"FROM ({positions}) p").replace("rule_id = 'rule_406_no_flip'", "rule_id = 'rule_406_no_flip'" if rule else "false")
        stats = _between("stats", "pf0").replace("FROM positions", f"FROM ({positions})")
        each.append(f"SELECT universe_id, date, '{name}' AS setting, tradeable, block_reason, no_trade, calendar_warning, n_long, n_short FROM ({gate(after, stats, mode, spread, least)})")
    return " UNION ALL ".join(each)


CTES = _CTES.replace("held AS (SELECT", f"traded AS ({gate('SELECT * FROM after_rule', 'SELECT * FROM stats', 'production', 0.08, 2)}),\nheld AS (SELECT")

PERIOD_D = (
    "gross_return_pct", "net_pre_tax_return_pct", "net_after_tax_return_pct", "long_contribution_pct", "short_contribution_pct", "trade_signal_strength", "candidate_signal_strength", "adopted_signal_strength",
    "jp_next_open_gap_mean", "jp_oc_mean", "jp_cc_mean", "jp_gap_to_oc_reversal", "jp_long_gap_mean", "jp_short_gap_mean",
)
PERIOD_TABLE = """
  SELECT pd.universe_id, pd.date, period_label, scenario_id AS strategy_id, strategy_name, gross_pct AS gross_return_pct, net_pre_tax_pct AS net_pre_tax_return_pct, net_after_tax_pct AS net_after_tax_return_pct, long_pct AS long_contribution_pct, short_pct AS short_contribution_pct,
    tradeable, skip_reason, cand_long AS candidate_long_count, cand_short AS candidate_short_count, adopt_long AS adopted_long_count, adopt_short AS adopted_short_count, adopted AS trade_signal_strength, candidate AS candidate_signal_strength, adopted AS adopted_signal_strength,
    jp_next_open_gap_mean, jp_oc_mean, jp_cc_mean, jp_gap_to_oc_reversal, jp_long_gap_mean, jp_short_gap_mean, trend_regime, vol_regime, rotation_regime
  FROM pd JOIN (VALUES ('S01_CurrOC', 'current, open to close'), ('S02_FlipL_OC', 'longs turned, open to close'), ('S03_CurrCC', 'current, close to close'), ('S04_FlipL_CC', 'longs turned, close to close'), ('S05_CurrOO', 'current, open to open'), ('S06_Curr1D', 'current, held a day'),
    ('S08_GapOvht05', 'gap filter on both sides'), ('S09_LGapFlt05', 'gap filter on the longs'), ('S10_ShortOnly', 'shorts only')) n(scenario_id, strategy_name) USING (scenario_id)
  LEFT JOIN (SELECT date, avg(signal) FILTER (cand_long) - avg(signal) FILTER (cand_short) AS candidate, avg(signal) FILTER (cand_long AND signal >= 0.02) - avg(signal) FILTER (cand_short AND signal <= -0.02) AS adopted FROM mask_all GROUP BY date) a ON a.date = pd.date
  LEFT JOIN (SELECT date, avg(next_gap) AS jp_next_open_gap_mean, avg(next_oc) AS jp_oc_mean, avg(next_cc) AS jp_cc_mean, avg(next_gap) FILTER (cand_long) AS jp_long_gap_mean, avg(next_gap) FILTER (cand_short) AS jp_short_gap_mean, avg(next_oc) - avg(next_gap) AS jp_gap_to_oc_reversal
    FROM mask_all LEFT JOIN rets r USING (universe_id, date, ticker) GROUP BY date) f ON f.date = pd.date
  LEFT JOIN (SELECT date, trend_regime, vol_regime, rotation_regime FROM regime) r ON r.date = pd.date"""

REPORT_SET = """
  SELECT "table", period_label, count(*) AS rows FROM (
    SELECT 'daily' AS "table", period_label FROM pd UNION ALL SELECT 'monthly', period_label FROM (SELECT DISTINCT period_label, scenario_id, strftime(date, '%Y-%m') FROM pd) UNION ALL SELECT 'yearly', period_label FROM (SELECT DISTINCT period_label, scenario_id, year(date) FROM pd)
    UNION ALL SELECT 'summary', period_label FROM summary UNION ALL SELECT 'vs_baseline', period_label FROM summary) GROUP BY ALL"""

QUALITY = """
  SELECT universe_id, effective_start AS sample_start, effective_end AS sample_end, fill_policy, 'raw' AS price_mode, filled_cells, dropped_lead, dropped_lag, effective_start, effective_end, joint_rows, joint_rows AS effective_window_days, usable_lead, usable_lag, cache_first_date, cache_last_date, 'raw' AS cache_price_mode, true AS cache_isolated
  FROM (SELECT 'all' AS universe_id, 'strict' AS fill_policy, 0::BIGINT AS filled_cells, min(date) AS effective_start, max(date) AS effective_end, count(DISTINCT date) AS joint_rows FROM joint_strict
    UNION ALL SELECT 'all', 'rolling_mean', (SELECT count(*) FROM covered c JOIN filled f USING (date, ticker) WHERE c.ret IS NULL AND f.ret IS NOT NULL)::BIGINT, min(date), max(date), count(DISTINCT date) FROM joint_fill),
    (SELECT coalesce(string_agg(ticker, '|' ORDER BY ticker) FILTER (side = 'lead' AND n = 0), '') AS dropped_lead, coalesce(string_agg(ticker, '|' ORDER BY ticker) FILTER (side = 'lag' AND n = 0), '') AS dropped_lag, count(*) FILTER (side = 'lead') AS usable_lead, count(*) FILTER (side = 'lag') AS usable_lag
      FROM (SELECT side, ticker, count(ret) AS n FROM covered GROUP BY ALL)), (SELECT min(date) AS cache_first_date, max(date) AS cache_last_date FROM panel WHERE open IS NOT NULL OR close IS NOT NULL)"""

SPREAD_DAYS = """SELECT universe_id, date, trade_strength AS strength, net_pre_tax_return AS ret, long_contrib, short_contrib FROM pf JOIN stats USING (universe_id, date)
    JOIN (SELECT universe_id, date, coalesce(avg(next_oc) FILTER (cand_long AND signal >= 0), 0) AS long_contrib, coalesce(-avg(next_oc) FILTER (cand_short AND signal <= 0), 0) AS short_contrib FROM mask GROUP BY ALL) USING (universe_id, date)"""


def _grid_values(items) -> str:
    return ", ".join(f"({', '.join(map(str, x))})" for x in items)


def spread_sql(limits) -> str:
    rows = f"""(SELECT *, CASE WHEN traded THEN ret ELSE 0 END AS kept, CASE WHEN NOT traded THEN 'skip' WHEN ret > 0 THEN 'win' ELSE 'loss' END AS kind FROM (
      SELECT *, strength >= least_spread AS traded FROM ({SPREAD_DAYS}), (VALUES {_grid_values((f"{x}::DOUBLE",) for x in limits)}) g(least_spread)))"""
    return f"""
  SELECT a.*, mdd, longest_loss, longest_skip FROM (
    SELECT universe_id, least_spread, count(*) FILTER (traded) AS traded_days, count(*) FILTER (NOT traded) AS skipped_days, avg(traded::INT) AS pass_rate, avg(ret) FILTER (traded) AS traded_mean, avg(kept) AS all_mean, avg((ret > 0)::INT) FILTER (traded) AS traded_win_rate, avg((kept > 0)::INT) AS all_win_rate,
      product(1 + kept) - 1 AS compound, avg(long_contrib) FILTER (traded) AS traded_long, avg(short_contrib) FILTER (traded) AS traded_short, avg(CASE WHEN traded THEN long_contrib ELSE 0 END) AS all_long, avg(CASE WHEN traded THEN short_contrib ELSE 0 END) AS all_short FROM {rows} GROUP BY ALL) a
  JOIN (SELECT universe_id, least_spread, min(e / m - 1) AS mdd FROM (SELECT *, max(e) OVER (PARTITION BY least_spread ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, product(1 + kept) OVER (PARTITION BY least_spread ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM {rows})) GROUP BY ALL) b USING (universe_id, least_spread)
  JOIN (SELECT universe_id, least_spread, coalesce(max(n) FILTER (kind = 'loss'), 0) AS longest_loss, coalesce(max(n) FILTER (kind = 'skip'), 0) AS longest_skip FROM (SELECT universe_id, least_spread, kind, i, count(*) AS n FROM (
    SELECT universe_id, least_spread, kind, row_number() OVER (PARTITION BY least_spread ORDER BY date) - row_number() OVER (PARTITION BY least_spread, kind ORDER BY date) AS i FROM {rows}) GROUP BY ALL) GROUP BY ALL) d USING (universe_id, least_spread)"""


def _performance(value: str, rows: str, keys: str) -> str:
    return f"""SELECT {keys}, avg({value}) * 12 * 100 AS {value}_ar, CASE WHEN stddev_samp({value}) > 0 THEN avg({value}) * 12 / (stddev_samp({value}) * sqrt(12)) END AS {value}_rr, min(e / m - 1) * 100 AS {value}_mdd
    FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, product(1 + {value}) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM {rows} WHERE nl > 0)) GROUP BY ALL"""


def threshold_sql(settings) -> str:
    adaptive = "CASE vol_regime WHEN 'low_vol' THEN 0.12::DOUBLE WHEN 'mid_vol' THEN 0.10::DOUBLE ELSE 0.06::DOUBLE END"
    days = " UNION ALL ".join(f"""
      SELECT universe_id, date, '{n}' AS setting, trend_regime, vol_regime, count(*) FILTER (cand_long AND signal >= {t}) AS nl, count(*) FILTER (cand_short AND signal <= -({t})) AS ns, coalesce(avg(next_oc) FILTER (cand_long AND signal >= {t}), 0) - coalesce(avg(next_oc) FILTER (cand_short AND signal <= -({t})), 0) AS gross
      FROM mask JOIN regime USING (universe_id, date) GROUP BY universe_id, date, trend_regime, vol_regime""" for n, t in ((n, adaptive if t is None else f"{t}::DOUBLE") for n, t in settings))
    rows = f"""(SELECT universe_id, date, setting, g.trend AS trend_regime, g.vol AS vol_regime, nl, ns, gross, gross - 0.002 * ((nl > 0)::INT + (ns > 0)::INT) - 0.015::DOUBLE / 252 * (ns > 0)::INT AS net
      FROM (SELECT *, unnest([{{'trend': 'all', 'vol': 'all'}}, {{'trend': 'all', 'vol': vol_regime}}, {{'trend': trend_regime, 'vol': vol_regime}}]) AS g FROM ({days})))"""
    keys = "universe_id, setting, trend_regime, vol_regime"
    return f"""
  SELECT * FROM (SELECT {keys}, count(*) AS days, avg((nl > 0 AND ns > 0)::INT) AS tradeable_rate, avg((nl = 0)::INT) AS no_long_rate FROM {rows} GROUP BY ALL)
  LEFT JOIN ({_performance("gross", rows, keys)}) USING ({keys}) LEFT JOIN ({_performance("net", rows, keys)}) USING ({keys})"""


def flip_sql(looks) -> str:
    sides = " UNION ALL ".join(f"SELECT universe_id, date, '{n}' AS horizon, avg({v}) FILTER (cand_long) AS l, avg({v}) FILTER (cand_short) AS s FROM mask_all LEFT JOIN rets r USING (universe_id, date, ticker) GROUP BY ALL" for n, v in (("oc", "next_oc"), ("cc", "next_cc")))
    keys = "universe_id, horizon, look, scenario"
    rows = f"""(SELECT *, coalesce((l * a - s * b) / 2, l * a, -s * b) AS ret, l * a AS long, -s * b AS short FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY date DESC) AS back FROM ({sides}) WHERE l IS NOT NULL OR s IS NOT NULL),
      (VALUES {_grid_values((f"'{k}'", n) for k, n in looks.items())}) k(look, last), (VALUES ('A_orig', 1, 1), ('B_flip_L', -1, 1), ('C_flip_S', 1, -1), ('D_flip_B', -1, -1)) f(scenario, a, b) WHERE back <= last)"""
    return f"""
  SELECT * FROM (SELECT {keys}, count(*) AS n, avg(ret) AS mean, avg((ret > 0)::INT) AS win_rate, product(1 + ret) - 1 AS compound, avg(long) AS long_mean, avg(short) AS short_mean FROM {rows} GROUP BY ALL)
  JOIN (SELECT {keys}, min(e / m - 1) AS mdd FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM {rows})) GROUP BY ALL) USING ({keys})
  JOIN (SELECT {keys}, coalesce(max(k) FILTER (NOT win), 0) AS longest_loss FROM (SELECT {keys}, win, i, count(*) AS k FROM (SELECT {keys}, ret > 0 AS win, row_number() OVER (PARTITION BY {keys} ORDER BY date) - row_number() OVER (PARTITION BY {keys}, ret > 0 ORDER BY date) AS i FROM {rows}) GROUP BY ALL) GROUP BY ALL) USING ({keys})"""


def status_sql(published: bool) -> str:
    n = "(SELECT count(*) FROM pf JOIN leadf USING (universe_id, date) WHERE gross_return IS NOT NULL AND mean IS NOT NULL AND spread IS NOT NULL AND sd IS NOT NULL)" if published else "0::BIGINT"
    factors = "true AS factor_data_ready, 'Carhart4' AS factor_model, (SELECT count(*) FROM leadf) AS factor_rows, (SELECT min(date) FROM leadf) AS factor_start, (SELECT max(date) FROM leadf) AS factor_end, true AS report_available" if published else (
        "false AS factor_data_ready, NULL::VARCHAR AS factor_model, 0::BIGINT AS factor_rows, NULL::DATE AS factor_start, NULL::DATE AS factor_end, false AS report_available")
    return f"""
  SELECT *, factor_data_ready AND factor_regression_ready AND adjusted_verification_ready AND report_available AS paper_reproduction_ready, CASE WHEN factor_data_ready AND factor_regression_ready AND adjusted_verification_ready AND report_available THEN 'ok' ELSE 'missing_requirements:' ||
    concat_ws(',', CASE WHEN NOT factor_data_ready THEN 'factor_data_ready' END, CASE WHEN NOT factor_regression_ready THEN 'factor_regression_ready' END, CASE WHEN NOT adjusted_verification_ready THEN 'adjusted_verification_ready' END, CASE WHEN NOT report_available THEN 'report_available' END) END AS paper_reproduction_reason
  FROM (SELECT universe_id, coverage_ratio, covered, total > 0 AS actions_data_ready, v.reason_code = 'ok' AS adjusted_verification_ready, v.reason_code, {factors}, n_obs >= 60 AS factor_regression_ready,
      CASE WHEN NOT {str(published).lower()} THEN 'factor_data_unavailable' WHEN n_obs >= 60 THEN 'ok' ELSE 'insufficient_observations:' || n_obs END AS regression_reason, n_obs, f.ready AS signal_ready
    FROM verified v JOIN flags f USING (universe_id), (SELECT {n} AS n_obs))"""


def report_sql(verdict: str) -> str:
    """Report documents, put together as text; numbers have six places."""
    num = lambda x: f"coalesce(CAST(CAST({x} AS DECIMAL(20,6)) AS VARCHAR), 'null')"
    txt = lambda x: f"""coalesce('"' || {x} || '"', 'null')"""
    whole = lambda x: f"coalesce(({x})::VARCHAR, 'null')"
    listed = lambda x, sep: f"""'[' || CASE WHEN {x} = '' THEN '' ELSE '"' || replace({x}, '{sep}', '","') || '"' END || ']'"""

    def record(**fields: str) -> str:
        return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + " || '}'"

    one = lambda n: record(**{k: (f"(SELECT {num(v) if k != 'N_days' else whole(v)} FROM perf WHERE set_name = '{n}')") for k, v in (("AR", "ar"), ("Risk", "risk"), ("RR", "rr"), ("MDD", "mdd"), ("N_days", "n_days"))})
    scores = ("overall_score", "overall_decision", "profitability", "stability", "cost_resilience", "executability", "data_reliability")
    judge = record(**{x: (txt(x) if x == "overall_decision" else whole(x)) for x in scores}, reasons=listed("reasons", "|"))
    costs = record(**{x: f"(SELECT {num(f'sum({x})')} FROM pf)" for x in ("commission_cost", "slippage_cost", "borrow_cost")}, tax_cost=f"(SELECT {num('sum(tax_paid)')} FROM taxed)")
    params = record(signal="""'"momentum"'""", window_l="'12'", commission_bps_per_side="'5'", slippage_bps_per_side="'5'", allow_short="'true'", tax_model="""'"annual_net"'""")
    tested = record(settings_name="""'"production"'""", params=params, judge=judge, performance_sets=record(**{n: one(n) for n in ("gross", "net_pre_tax", "net_after_tax")}), cost_breakdown=costs, eval_start=f"(SELECT {txt('min(date)')} FROM pf)")
    entry = record(ticker=txt("ticker"), sector=txt("sector"), signal=num("signal"), weight=num("weight_pct"), latest_price_jpy=whole("latest_price"), min_lot="'10'", min_purchase_jpy=whole("min_purchase"), normalized_lots=whole("lots"), normalized_purchase_jpy=whole("lots * latest_price"))
    sides = f"SELECT date, string_agg({entry}, ',' ORDER BY signal DESC, ticker) FILTER (position = 'LONG') AS long, string_agg({entry}, ',' ORDER BY signal DESC, ticker) FILTER (position = 'SHORT') AS short FROM plan GROUP BY date"
    shadow = "SELECT date, '{' || string_agg('\"' || rule_id || '\":\"' || strategy || '\"', ',' ORDER BY rule_id) FILTER (rule_id <> 'rule_406_no_flip') || '}' AS shadow FROM run_decisions GROUP BY date".replace('\\"', '"')
    gaps = "concat_ws(',', nullif(replace(missing, '|', ','), ''), nullif(replace(stale, '|', ','), ''))"
    step = lambda s: record(status=f"""'"' || CASE WHEN {s}_max IS NULL THEN 'missing' WHEN {s}_min = {s}_max THEN 'ok' ELSE 'uneven' END || '"'""", latest=txt(f"{s}_max"))
    key = """'{"signalDate":"' || date || '","execJpDate":' || coalesce('"' || execution_date || '"', 'null') || ',"tradeable":' || tradeable || ',"longTickers":[' || coalesce(longs, '') || '],"shortTickers":[' || coalesce(shorts, '') || ']}'"""
    signal = record(
        signal_reference_us_date=txt("date"), execution_target_jp_date=txt("execution_date"), execution_target_jp_date_source=txt("source"), operation_mode="""'"production"'""", tradeable=whole("tradeable"), trade_block_reason=txt("block_reason"), calendar_warning=whole("calendar_warning"),
        trade_signal_strength=num("strength"), candidate_long_count=whole("candidate_long"), candidate_short_count=whole("candidate_short"), adopted_long_count=whole("n_long"), adopted_short_count=whole("n_short"), pre_rule_adopted_long_count=whole("adopted_long"), pre_rule_adopted_short_count=whole("adopted_short"),
        no_trade_classification=txt("no_trade"), trend_regime=txt("trend_regime"), vol_regime=txt("vol_regime"), rotation_regime=txt("rotation_regime"), regime_warning=whole("(trend_regime = 'downtrend' OR vol_regime = 'high_vol')"),
        execution_plan=record(n_long=whole("n_long"), n_short=whole("n_short"), long="'[' || coalesce(long, '') || ']'", short="'[' || coalesce(short, '') || ']'"), data_quality=record(usable_us_tickers=whole("usable_lead"), usable_jp_tickers=whole("usable_lag")),
        freshness=record(freshness_ok=whole("freshness_ok"), latest_dates_aligned=whole("dates_aligned"), latest_us_date=txt("lead_max"), latest_jp_date=txt("lag_max"), stale_tickers=listed("stale", "|"), missing_tickers=listed("missing", "|")),
        strategy_decision=record(rule_id="""'"rule_406_no_flip"'""", selected_strategy=txt("strategy"), action="""'"' || CASE strategy WHEN 'skip' THEN 'skip' ELSE 'execute' END || '"'"""),
        strategy_context=record(**{x: num(x) for x in ("open_gap", "long_gap", "short_gap", "candidate_signal_strength")}), shadow_decisions="shadow",
    )
    document = record(
        schema_version="'1'", date=txt("date"), generated_at_utc="""'"1970-01-01T00:00:00+00:00"'""", backtest="tested", daily_signal=signal,
        fetch=record(status="""'"' || CASE WHEN freshness_ok THEN 'ok' ELSE 'partial' END || '"'""", error_summary=txt(f"nullif({gaps}, '')"), steps=record(lead=step("lead"), lag=step("lag"))),
        history_entry=record(dedupe_key=f"""'"' || replace({key}, '"', '\\"') || '"'""", signal_date=txt("date"), exec_jp_date=txt("execution_date"), tradeable=whole("tradeable"), n_long=whole("n_long"), n_short=whole("n_short"), selected_strategy=txt("strategy")),
        slack_fallback_text="""'"' || date || ': ' || strategy || ' / long ' || n_long || ' / short ' || n_short || CASE WHEN tradeable THEN '' ELSE ' / ' || block_reason END || '"'""",
    )
    return f"""
  SELECT universe_id, date, {document} AS document FROM (SELECT * EXCLUDE (strength), strength, tested FROM traded JOIN (SELECT universe_id, date, candidate_long, candidate_short, adopted_long, adopted_short FROM stats) USING (universe_id, date) JOIN known USING (universe_id, date)
    JOIN run_context USING (universe_id, date) LEFT JOIN ({sides}) USING (date) LEFT JOIN ({shadow}) USING (date) LEFT JOIN held USING (date), (SELECT {tested} AS tested FROM ({verdict})))"""


#: The chain from scenarios to their summary.
_CHAIN = ("sc_rows", "sc_head", "sc_mask", "sc_legs", "sc0", "sc1", "sc")


def scenario_chain(table: str, prefix: str) -> str:
    """The expressions of the scenario chain over another table of scenarios, their names with a prefix."""
    start, end = CTES.index("sc_rows AS ("), CTES.index("bounds AS (")
    text = CTES[start:end].strip().rstrip(",").replace("rets r USING (universe_id, date, ticker), scenario c)", f"rets r USING (universe_id, date, ticker), {table} c)")
    text = text.replace("(filter_ = 'none' OR g <= 0.005)", "CASE WHEN filter_ = 'abs' THEN abs(g) <= 0.005 ELSE filter_ = 'none' OR g <= 0.005 END").replace("(filter_ <> 'both' OR g >= -0.005)", "CASE WHEN filter_ = 'abs' THEN abs(g) <= 0.005 ELSE filter_ <> 'both' OR g >= -0.005 END")
    for name in _CHAIN:
        text = re.sub(rf"\b{name}\b(?= AS \()|(?<=FROM ){name}\b|(?<=JOIN ){name}\b", f"{prefix}_{name}", text)
    return text


def for_days(sql: str, length: int) -> str:
    """A statement over months as one over days, with windows of ``length`` rows and 252 rows a year."""
    changes = (
        ("CAST(date_trunc('month', l_shipdate) AS DATE) AS date", "CAST(l_shipdate AS DATE) AS date"), ("CASE WHEN day(l_shipdate) <= 15 THEN", "CASE WHEN l_linenumber <= 2 THEN"), ("CASE WHEN day(l_shipdate) > 15 THEN", "CASE WHEN l_linenumber > 2 THEN"),
        ("ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12)", f"ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)) WHERE n = {length})"), ("avg(ret) * 12 * 100 AS ar, stddev_samp(ret) * sqrt(12) * 100 AS risk, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)) END AS rr",
        "avg(ret) * 252 * 100 AS ar, stddev_samp(ret) * sqrt(252) * 100 AS risk, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) END AS rr"),
    )
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"the statement has no {old!r}")
        sql = sql.replace(old, new)
    return sql


def for_universes(sql: str, column: str, values: tuple[str, ...]) -> str:
    """A statement over the whole panel as the union of those over the universes that a column of lineitem names."""
    each = [sql.replace("'all' AS universe_id", f"'{v}' AS universe_id").replace("ON l_partkey = p_partkey GROUP BY ALL", f"ON l_partkey = p_partkey WHERE {column} = '{v}' GROUP BY ALL") for v in values]
    return " UNION ALL ".join(f"SELECT * FROM ({x})" for x in each)


def statement(final: str, doubles: tuple[str, ...], digits: int, dates: tuple[str, ...]) -> str:
    """``final`` over the expressions, its doubles rounded and its dates as text, as ``presented`` does for a query."""
    unit = "pow(10.0::DOUBLE, floor(log10(abs({d}::DOUBLE))) - 9)"
    rounded = f"CASE WHEN abs({{d}}::DOUBLE) >= 1e6 THEN round({{d}}::DOUBLE / {unit}) * {unit} ELSE round({{d}}::DOUBLE, {digits}) END"
    changes = [f"{rounded.format(d=d)} + 0.0::DOUBLE AS {d}" for d in doubles] + [f"CAST({d} AS VARCHAR) AS {d}" for d in dates]
    return f"WITH RECURSIVE {CTES.strip()}\nSELECT * {f'REPLACE ({", ".join(changes)})' if changes else ''} FROM ({final})"
