"""DuckDB SQL of the queries that aren't formulas."""

from __future__ import annotations

from ..sources.panels import BARS_SQL, TICKS_SQL

_S = "PARTITION BY instrument ORDER BY date"
_BARS = f"b AS ({BARS_SQL})"
_SIG = f"""{_BARS}, s AS (SELECT *, close > avg(close) OVER w * 1.05 AS entry, close < avg(close) OVER w * 0.95 AS exit, row_number() OVER ({_S}) - 1 AS idx
  FROM b WINDOW w AS ({_S} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
_R6 = lambda *c: ", ".join(f"round({x}, 6) + 0 AS {x}" for x in c)
_RUNS = f"""{_BARS}, n AS (SELECT *, row_number() OVER ({_S}) - 1 AS idx, count(*) OVER (PARTITION BY instrument) AS c FROM b),
  u AS (SELECT *, idx - row_number() OVER ({_S}) AS g FROM n WHERE close > open),
  r AS (SELECT instrument, min(idx) AS start_idx, CASE WHEN max(idx) = max(c) - 1 THEN max(idx) ELSE max(idx) + 1 END AS end_idx,
    CASE WHEN max(idx) = max(c) - 1 THEN 'open' ELSE 'closed' END AS status FROM u GROUP BY instrument, g)"""
_DD = f"""{_BARS}, n AS (SELECT instrument, date, close AS v, row_number() OVER ({_S}) - 1 AS idx, max(close) OVER ({_S}) AS peak FROM b),
  g AS (SELECT *, sum(CASE WHEN v >= peak THEN 1 ELSE 0 END) OVER ({_S}) AS k FROM n),
  a AS (SELECT instrument, k, min(idx) AS peak_idx, max(peak) AS peak_val, min(idx) + 1 AS start_idx, count(*) AS c, arg_min(idx, row(v, idx)) FILTER (v < peak) AS valley_idx,
    min(v) FILTER (v < peak) AS valley_val, max(idx) AS last_idx, arg_max(v, idx) AS last_val FROM g GROUP BY instrument, k),
  l AS (SELECT *, lead(peak_idx) OVER (PARTITION BY instrument ORDER BY k) AS ni, lead(peak_val) OVER (PARTITION BY instrument ORDER BY k) AS nv FROM a),
  d AS (SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY peak_idx) - 1 AS id, peak_idx, start_idx, valley_idx, coalesce(ni, last_idx) AS end_idx, peak_val, valley_val,
    coalesce(nv, last_val) AS end_val, CASE WHEN ni IS NULL THEN 'open' ELSE 'closed' END AS status, (valley_val - peak_val) / peak_val AS drawdown FROM l WHERE c > 1)"""
_RET = f"""{_BARS}, r0 AS (SELECT instrument, date, close / lag(close) OVER ({_S}) - 1 AS r FROM b), q AS (SELECT *, avg(r) OVER (PARTITION BY date) AS b FROM r0)"""
_UP = "pow(greatest({p}, 0), 12.0 / nullif({n}, 0)) - 1"


def _measures(w: str) -> str:
    o = f" {w}" if w else ""
    f = lambda e, c="": f"{e}{f' FILTER ({c})' if c else ''}{o}"
    both = "r IS NOT NULL AND b IS NOT NULL"
    cap = lambda c: f"(pow(greatest({f('product(1 + r)', c)}, 0), 12.0 / nullif({f('count(r)', c)}, 0)) - 1) / nullif(pow(greatest({f('product(1 + b)', c)}, 0), 12.0 / nullif({f('count(b)', c)}, 0)) - 1, 0)"
    beta = f"{f('covar_pop(r, b)')} / nullif({f('var_pop(b)', both)}, 0)"
    parts = {
        "total_return": f"CASE WHEN {f('count(r)')} > 0 THEN {f('product(1 + r)')} - 1 END", "annualized_return": f"CASE WHEN {f('count(r)')} > 0 THEN pow(greatest({f('product(1 + r)')}, 0), 12.0 / {f('count(*)')}) - 1 END",
        "annualized_volatility": f"{f('stddev_samp(r)')} * sqrt(12)", "omega": f"{f('sum(r)', 'r > 0')} / nullif({f('sum(-r)', 'r < 0')}, 0)",
        "sharpe": f"CASE WHEN {f('count(r)')} >= 2 THEN {f('avg(r)')} / nullif({f('stddev_samp(r)')}, 0) * sqrt(12) END", "downside_risk": f"sqrt({f('avg(pow(least(r, 0), 2))', 'r IS NOT NULL')}) * sqrt(12)",
        "sortino": f"{f('avg(r)')} * 12 / nullif(sqrt({f('avg(pow(least(r, 0), 2))', 'r IS NOT NULL')}) * sqrt(12), 0)", "information_ratio": f"{f('avg(r - b)')} / nullif({f('stddev_samp(r - b)')}, 0)", "beta": beta,
        "alpha": f"pow({f('avg(r)', both)} - {beta} * {f('avg(b)', both)} + 1, 12) - 1", "tail_ratio": f"abs({f('quantile_cont(r, 0.95)')}) / nullif(abs({f('quantile_cont(r, 0.05)')}), 0)",
        "value_at_risk": f"{f('quantile_cont(r, 0.05)')}", "capture": cap(both), "up_capture": cap(both + " AND b > 0"), "down_capture": cap(both + " AND b < 0"),
    }
    return ", ".join(f"{e} AS {k}" for k, e in parts.items())


_MEASURES = ["total_return", "annualized_return", "annualized_volatility", "omega", "sharpe", "downside_risk", "sortino", "information_ratio", "beta", "alpha", "tail_ratio", "value_at_risk", "capture", "up_capture", "down_capture"]
_PRED = f"""{_BARS}, p0 AS (SELECT instrument, date, CASE WHEN count(close) OVER w >= 5 THEN avg(close) OVER w END / close AS p, lead(close, 2) OVER ({_S}) / lead(close, 1) OVER ({_S}) - 1 AS y
  FROM b WINDOW w AS ({_S} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), k AS (SELECT * FROM p0 WHERE p IS NOT NULL AND y IS NOT NULL)"""
_IC = f"""{_PRED}, rk AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY p) + (count(*) OVER (PARTITION BY date, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM k),
  ic AS (SELECT date, CASE WHEN count(*) > 1 THEN covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0) END AS ic, CASE WHEN count(*) > 1 THEN covar_pop(rp, ry) / nullif(stddev_pop(rp) * stddev_pop(ry), 0) END AS rank_ic, count(*) AS n FROM rk GROUP BY date)"""
_LS = f"""{_PRED}, h AS (SELECT *, floor(count(*) OVER (PARTITION BY date) * 0.2) AS q, row_number() OVER (PARTITION BY date ORDER BY p DESC, instrument) AS a, row_number() OVER (PARTITION BY date ORDER BY p, instrument) AS z FROM k),
  ls AS (SELECT date, (avg(y) FILTER (a <= q) - avg(y) FILTER (z <= q)) / 2 AS long_short, avg(y) AS mean, avg(CAST(y > 0 AS DOUBLE)) FILTER (a <= q) AS long_precision, avg(CAST(y < 0 AS DOUBLE)) FILTER (z <= q) AS short_precision FROM h GROUP BY date)"""

SQL = {
    "asof_orders": """WITH o AS (SELECT o_custkey AS user_id, o_orderdate, arg_max(o_totalprice, row(o_orderkey, o_totalprice)) AS o_totalprice FROM orders GROUP BY 1, 2)
      SELECT e.event_id, e.user_id, e.ts, o.o_totalprice FROM events e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.o_orderdate""",
    "asof_next_order": """SELECT o.o_custkey AS user_id, o.o_orderkey, o.o_orderdate, e.ts AS next_at, e.value AS next_value FROM orders o
      ASOF LEFT JOIN events e ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts""",
    "records_ranges": f"WITH {_RUNS} SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY start_idx) - 1 AS id, start_idx, end_idx, status, end_idx - start_idx + CAST(status = 'open' AS INT) AS duration FROM r",
    "records_coverage": f"WITH {_RUNS} SELECT instrument, round(avg(CAST(close > open AS DOUBLE)), 6) + 0 AS coverage FROM n GROUP BY instrument",
    "records_mask": f"WITH {_BARS} SELECT instrument, date, close > open AS covered FROM b",
    "records_drawdowns": f"""WITH {_DD} SELECT instrument, id, peak_idx, start_idx, valley_idx, end_idx, status, {_R6("peak_val", "valley_val", "end_val", "drawdown")}, valley_idx - start_idx + 1 AS decline_duration, end_idx - valley_idx AS recovery_duration,
      round((end_idx - valley_idx) / CAST(valley_idx - start_idx + 1 AS DOUBLE), 6) + 0 AS duration_ratio, round((end_val - valley_val) / valley_val, 6) + 0 AS recovery_return FROM d""",
    "records_top_drawdowns": f"WITH {_DD} SELECT instrument, id, peak_idx, valley_idx, round(drawdown, 6) + 0 AS drawdown FROM d QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY d.drawdown, id) <= 3",
    "records_described": f"""WITH {_BARS}, n AS (SELECT *, row_number() OVER ({_S}) - 1 AS idx FROM b) SELECT instrument, CAST(count(close) AS DOUBLE) AS count, round(avg(close), 6) + 0 AS mean, round(stddev_samp(close), 6) + 0 AS std, round(min(close), 6) + 0 AS min,
      round(quantile_cont(close, 0.25), 6) + 0 AS q25, round(quantile_cont(close, 0.5), 6) + 0 AS q50, round(quantile_cont(close, 0.75), 6) + 0 AS q75, round(max(close), 6) + 0 AS max, arg_min(idx, row(close, idx)) AS argmin, arg_max(idx, row(close, -idx)) AS argmax FROM n GROUP BY instrument""",
    "signals_clean": f"""WITH {_SIG}, o AS (SELECT *, CASE WHEN entry AND NOT exit THEN 1 WHEN exit AND NOT entry THEN 0 END AS one FROM s), l AS (SELECT *, last_value(one IGNORE NULLS) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM o)
      SELECT instrument, date, coalesce(one = 1 AND coalesce(was <> 1, TRUE), FALSE) AS entry, coalesce(one = 0 AND was = 1, FALSE) AS exit FROM l""",
    "signals_ranks": f"""WITH {_SIG}, x AS (SELECT *, entry AND NOT coalesce(lag(entry) OVER ({_S}), FALSE) AS first FROM s), y AS (SELECT *, sum(CAST(first AS INT)) OVER ({_S}) AS part FROM x)
      SELECT instrument, date, CASE WHEN entry THEN row_number() OVER (PARTITION BY instrument, part, entry ORDER BY date) - 1 ELSE -1 END AS pos_rank, CAST(CASE WHEN entry THEN part - 1 ELSE -1 END AS BIGINT) AS part_rank FROM y""",
    "signals_between": f"WITH {_SIG}, e AS (SELECT instrument, idx AS start_idx, lead(idx) OVER ({_S}) AS end_idx FROM s WHERE entry) SELECT * FROM e WHERE end_idx IS NOT NULL",
    "signals_between_two": f"WITH {_SIG} SELECT e.instrument, e.idx AS start_idx, min(x.idx) AS end_idx FROM s e JOIN s x ON x.instrument = e.instrument AND x.exit AND x.idx >= e.idx WHERE e.entry GROUP BY 1, 2",
    "signals_back_to_entry": f"WITH {_SIG} SELECT x.instrument, max(e.idx) AS start_idx, x.idx AS end_idx FROM s x JOIN s e ON x.instrument = e.instrument AND e.entry AND e.idx <= x.idx WHERE x.exit GROUP BY 1, 3",
    "signals_index": f"WITH {_SIG} SELECT instrument, list_sort(list(idx) FILTER (entry))[3] AS nth_idx, round(CASE WHEN count(*) > 1 THEN 2 * avg(idx) FILTER (entry) / (count(*) - 1) - 1 END, 6) + 0 AS norm_avg_idx FROM s GROUP BY instrument",
    "returns_summary": f"""WITH {_RET}, m AS (SELECT instrument, {_measures("")}, list_sort(list(r) FILTER (r IS NOT NULL)) AS sorted FROM q GROUP BY instrument), c AS (SELECT instrument, date, coalesce(product(1 + r) OVER ({_S}), 1) AS c FROM q),
      e AS (SELECT instrument, min(c / m - 1) AS max_drawdown FROM (SELECT *, max(c) OVER ({_S}) AS m FROM c) GROUP BY instrument)
      SELECT instrument, {_R6(*_MEASURES)}, round(max_drawdown, 6) + 0 AS max_drawdown, round(list_avg(sorted[1:CAST(floor((len(sorted) - 1) * 0.05) AS INT) + 1]), 6) + 0 AS cond_value_at_risk, round(m.annualized_return / nullif(abs(e.max_drawdown), 0), 6) + 0 AS calmar FROM m JOIN e USING (instrument)""",
    "returns_drawdown": f"WITH {_RET}, c AS (SELECT instrument, date, coalesce(product(1 + r) OVER ({_S}), 1) AS c FROM q) SELECT instrument, date, round(c - 1, 6) + 0 AS cum_return, round(c / max(c) OVER ({_S}) - 1, 6) + 0 AS drawdown FROM c",
    "returns_rolling": f"""WITH {_RET}, w AS (SELECT instrument, date, count(*) OVER x AS c12, {_measures("OVER x")} FROM q WINDOW x AS ({_S} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
      SELECT instrument, date, {", ".join(f"CASE WHEN c12 = 12 THEN round({m}, 6) + 0 END AS {m}" for m in _MEASURES)} FROM w""",
    "evaluate_ic": f"WITH {_IC} SELECT date, {_R6('ic', 'rank_ic')}, n FROM ic",
    "evaluate_ic_summary": f"WITH {_IC} SELECT round(avg(ic), 6) + 0 AS ic, round(avg(rank_ic), 6) + 0 AS rank_ic, round(stddev_samp(rank_ic), 6) + 0 AS std, round(avg(rank_ic) / stddev_samp(rank_ic), 6) + 0 AS ir, round(avg(rank_ic) / stddev_samp(rank_ic) * sqrt(count(rank_ic)), 6) + 0 AS t, round(avg(CAST(rank_ic > 0 AS DOUBLE)), 6) + 0 AS win FROM ic",
    "evaluate_long_short": f"WITH {_LS} SELECT date, {_R6('long_short', 'mean', 'long_precision', 'short_precision')} FROM ls",
    "evaluate_autocorrelation": f"""WITH {_PRED}, d AS (SELECT *, dense_rank() OVER (ORDER BY date) AS d FROM p0) SELECT a.date, round(CASE WHEN count(*) > 1 THEN covar_pop(a.p, z.p) / nullif(stddev_pop(a.p) * stddev_pop(z.p), 0) END, 6) + 0 AS autocorr
      FROM d a JOIN d z ON a.instrument = z.instrument AND a.d = z.d + 1 WHERE a.p IS NOT NULL AND z.p IS NOT NULL GROUP BY a.date""",
    "evaluate_risk": f"""WITH {_LS}, c AS (SELECT date, long_short AS v, sum(long_short) OVER (ORDER BY date) AS l FROM ls WHERE long_short IS NOT NULL), x AS (SELECT *, l - max(l) OVER (ORDER BY date) AS fall FROM c)
      SELECT round(avg(v), 6) + 0 AS mean, round(stddev_samp(v), 6) + 0 AS std, round(avg(v) * 12, 6) + 0 AS annualized_return, round(avg(v) / stddev_samp(v) * sqrt(12), 6) + 0 AS information_ratio, round(min(fall), 6) + 0 AS max_drawdown FROM x""",
    "recursive_breakout": f"""WITH {_BARS}, x AS (SELECT *, {", ".join(f"lead(close, {k}) OVER ({_S}) AS n{k}" for k in range(1, 6))} FROM b) SELECT instrument, date, round(close, 6) + 0 AS close,
      CAST(CASE {" ".join(f"WHEN n{k} >= close * 1.1 THEN 1 WHEN n{k} <= close * 0.9 THEN -1" for k in range(1, 6))} ELSE 0 END AS INT) AS breakout FROM x""",
    "stream_bars_batch": f"""WITH t AS ({TICKS_SQL}) SELECT instrument, time_bucket(INTERVAL 6 HOUR, date, TIMESTAMP '1970-01-01') AS date, round(arg_min(close, row(date, close)), 6) + 0 AS open, round(max(close), 6) + 0 AS high, round(min(close), 6) + 0 AS low,
      round(arg_max(close, row(date, close)), 6) + 0 AS close, count(*) AS ticks FROM t GROUP BY 1, 2""",
    "portfolio_topk": f"""WITH {_BARS}, s AS (SELECT instrument, date, close / lag(close, 5) OVER ({_S}) - 1 AS score, lead(close) OVER ({_S}) / close - 1 AS r FROM b), k AS (SELECT * FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument) <= 10),
      w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY date) AS weight, dense_rank() OVER (ORDER BY date) AS d FROM k), g AS (SELECT d, date, sum(weight * coalesce(r, 0)) AS gross FROM w GROUP BY d, date),
      m AS (SELECT coalesce(a.d, z.d + 1) AS d, sum(abs(coalesce(a.weight, 0) - coalesce(z.weight, 0))) AS turnover FROM w a FULL JOIN w z ON a.instrument = z.instrument AND a.d = z.d + 1 GROUP BY 1)
      SELECT date, {_R6("gross", "turnover")}, round(gross - 0.001 * turnover, 6) + 0 AS net FROM g JOIN m USING (d)""",
}

#: The registry, written by hand: expressions over the bars, windows w5 and w10 of the last rows.
_CORE = {
    "kmid": "(close - open) / open", "klen": "(high - low) / open", "kmid2": "(close - open) / (high - low + 1e-12)", "kup": "(high - greatest(open, close)) / open",
    "klow": "(least(open, close) - low) / open", "ksft": "(2 * close - high - low) / open", "roc5": "lag(close, 5) OVER w / close", "roc10": "lag(close, 10) OVER w / close",
    "ma5": "CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 / close - 1 END", "ma10": "CASE WHEN count(close) OVER w10 = 10 THEN avg(close) OVER w10 / close - 1 END",
    "std5": "CASE WHEN count(close) OVER w5 = 5 THEN stddev_samp(close) OVER w5 / close END", "vma10": "CASE WHEN count(volume) OVER w10 = 10 THEN avg(volume) OVER w10 / (volume + 1e-12) - 1 END",
    "rsv5": "CASE WHEN count(close) OVER w5 = 5 THEN (close - min(low) OVER w5) / (max(high) OVER w5 - min(low) OVER w5 + 1e-12) END",
}
SQL |= {
    f"core_{k}": f"""WITH {_BARS} SELECT instrument, date, round(CAST({v} AS DOUBLE), 6) + 0 AS v FROM b
  WINDOW w AS ({_S}), w5 AS ({_S} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS ({_S} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
    for k, v in _CORE.items()
}
#: The four k-bars that divide by the range, of the wide set.
_RANGE = {"kmid2": "close - open", "kup2": "high - greatest(open, close)", "klow2": "least(open, close) - low", "ksft2": "2 * close - high - low"}
SQL["feature_kbar_range"] = f"WITH {_BARS} SELECT instrument, date, {', '.join(f'round(CAST(({v}) / (high - low + 1e-12) AS DOUBLE), 6) + 0 AS {k}' for k, v in _RANGE.items())} FROM b"
SQL["cross_spearman"] = f"""WITH {_BARS}, n AS (SELECT *, row_number() OVER ({_S}) AS t FROM b),
  p AS (SELECT a.instrument, a.date, c.close, c.volume FROM n a JOIN n c ON a.instrument = c.instrument AND c.t BETWEEN a.t - 11 AND a.t WHERE c.close IS NOT NULL AND c.volume IS NOT NULL),
  k AS (SELECT instrument, date, rank() OVER (PARTITION BY instrument, date ORDER BY close) + (count(*) OVER (PARTITION BY instrument, date, close) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY instrument, date ORDER BY volume) + (count(*) OVER (PARTITION BY instrument, date, volume) - 1) / 2.0 AS y FROM p),
  r AS (SELECT instrument, date, CASE WHEN count(*) = 12 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS v FROM k GROUP BY 1, 2)
  SELECT b.instrument, b.date, round(r.v, 6) + 0 AS v FROM b LEFT JOIN r ON b.instrument = r.instrument AND b.date = r.date"""
#: Operators with no formula: adjustments, events, regressions, days, functions of the user.
SQL["adjusted_bars"] = f"""WITH {_BARS}, sp AS (SELECT s_suppkey AS instrument, DATE '1993-01-01' + CAST(s_suppkey * 37 % 2000 AS INT) AS date, 0.5 AS ratio, TRUE AS split FROM supplier),
  dv AS (SELECT s_suppkey AS instrument, DATE '1995-06-15' + CAST(s_suppkey % 300 AS INT) AS date, CAST(s_suppkey % 7 + 5 AS DOUBLE) AS amount FROM supplier),
  dr AS (SELECT d.instrument, d.date, 1 - d.amount / arg_max(b.close, b.date) AS ratio, FALSE AS split FROM dv d JOIN b ON b.instrument = d.instrument AND b.date < d.date GROUP BY d.instrument, d.date, d.amount),
  adj AS (SELECT * FROM sp UNION ALL SELECT * FROM dr WHERE ratio > 0),
  m AS (SELECT b.instrument, b.date, product(a.ratio) AS m, product(a.ratio) FILTER (a.split) AS v FROM b JOIN adj a ON a.instrument = b.instrument AND a.date > b.date GROUP BY 1, 2)
  SELECT b.instrument, b.date, {", ".join(f"round({c} * coalesce(m.m, 1), 8) + 0 AS {c}" for c in ("open", "high", "low", "close"))}, round(volume / coalesce(m.v, 1), 8) + 0 AS volume
  FROM b LEFT JOIN m ON m.instrument = b.instrument AND m.date = b.date"""
_WEEKDAYS = "CAST(len(list_filter(range(CAST({a} AS TIMESTAMP), CAST({b} AS TIMESTAMP), INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS DOUBLE)"
SQL["events_business_days"] = f"""WITH {_BARS}, e AS (SELECT DISTINCT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS at FROM lineitem WHERE l_returnflag = 'R'),
  s AS (SELECT b.instrument, b.date, max(e.at) FILTER (e.at <= b.date) AS a, min(e.at) FILTER (e.at >= b.date) AS z FROM b LEFT JOIN e ON e.instrument = b.instrument GROUP BY 1, 2)
  SELECT instrument, date, CASE WHEN a IS NOT NULL THEN {_WEEKDAYS.format(a="a", b="date")} END AS since, CASE WHEN z IS NOT NULL THEN {_WEEKDAYS.format(a="date", b="z")} END AS until FROM s"""
SQL["events_restricted"] = f"""WITH {_BARS}, c AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS at, bool_or(l_returnflag = 'R') AS frozen FROM lineitem GROUP BY 1, 2)
  SELECT b.instrument, b.date, coalesce(c.frozen, FALSE) AS restricted FROM b ASOF LEFT JOIN c ON b.instrument = c.instrument AND b.date >= c.at"""
SQL["regression_target"] = f"""WITH {_BARS}, r AS (SELECT instrument, date, close / lag(close) OVER ({_S}) - 1 AS r FROM b),
  p AS (SELECT y.instrument, y.date, CASE WHEN x.r IS NOT NULL THEN y.r END AS y, CASE WHEN y.r IS NOT NULL THEN x.r END AS x FROM r y LEFT JOIN r x ON x.instrument = 1 AND x.date = y.date),
  g AS (SELECT instrument, date, count(x) OVER w AS n, regr_slope(y, x) OVER w AS beta, regr_intercept(y, x) OVER w AS alpha, greatest(-1, least(1, corr(y, x) OVER w)) AS r, var_pop(y) OVER w / var_pop(x) OVER w AS q FROM p
    WINDOW w AS ({_S} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
  t AS (SELECT *, atan(abs(r) * sqrt(10 / ((1 - r + 1e-20) * (1 + r + 1e-20))) / sqrt(10)) AS a FROM g)
  SELECT instrument, date, {", ".join(f"CASE WHEN n = 12 THEN round({v}, 6) + 0 END AS {k}" for k, v in {"alpha": "alpha", "beta": "beta", "r_value": "r", "stderr": "sqrt((1 - r * r) * q / 10)",
    "p_value": "greatest(1 - sin(a) * (1 + pow(cos(a), 2) / 2 + 3 * pow(cos(a), 4) / 8 + 5 * pow(cos(a), 6) / 16 + 35 * pow(cos(a), 8) / 128), 0)"}.items())} FROM t"""
SQL["signals_between_runs"] = f"""WITH {_SIG}, f AS (SELECT *, entry AND NOT coalesce(lag(entry) OVER ({_S}), FALSE) AS a, entry AND NOT coalesce(lead(entry) OVER ({_S}), FALSE) AS z FROM s)
  SELECT l.instrument, l.idx AS start_idx, min(n.idx) AS end_idx FROM f l JOIN f n ON n.instrument = l.instrument AND n.a AND n.idx > l.idx WHERE l.z GROUP BY 1, 2"""
SQL["day_operators"] = f"""WITH t AS ({TICKS_SQL}), u AS (SELECT *, hour(date) * 60 + minute(date) BETWEEN 570 AND 899 AS inside FROM t)
  SELECT instrument, date, round(close, 6) + 0 AS close, CASE WHEN inside THEN round(sum(close) FILTER (inside) OVER (PARTITION BY instrument, CAST(date AS DATE) ORDER BY date), 6) + 0 ELSE 0.0 END AS cum,
  round(arg_max(close, row(date, close)) OVER (PARTITION BY instrument, CAST(date AS DATE)), 6) + 0 AS last, CAST(CAST(date AS DATE) - DATE '1970-01-01' AS DOUBLE) AS day FROM u"""
SQL["other_instrument"] = f"""WITH {_BARS}, n AS (SELECT *, row_number() OVER ({_S}) AS i, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS j FROM b)
  SELECT n.instrument, n.date, round(o.close, 8) + 0 AS other, round(n.close - o.close, 8) + 0 AS apart, CASE WHEN i > 2 AND j > 1 THEN round(n.close, 8) + 0 END AS cut FROM n LEFT JOIN b o ON o.instrument = 1 AND o.date = n.date"""
SQL["custom_rolling"] = f"""WITH {_BARS} SELECT instrument, date, round(close, 8) + 0 AS close, CASE WHEN count(close) OVER w = 12 THEN round(max(close) OVER w - min(close) OVER w, 8) + 0 END AS applied
  FROM b WINDOW w AS ({_S} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
SQL["custom_groups"] = f"WITH {_BARS} SELECT instrument, CAST(year(date) AS INT) AS year, round(max(close) - min(close), 6) + 0 AS spread, round(CAST(sum(volume) AS DOUBLE), 6) + 0 AS volume FROM b GROUP BY 1, 2"
SQL["custom_nth"] = f"""WITH {_BARS}, n AS (SELECT *, row_number() OVER ({_S}) - 1 AS i, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS j FROM b)
  SELECT instrument, round(max(close) FILTER (j = 3), 6) + 0 AS nth, max(i) FILTER (j = 3) AS nth_idx FROM n GROUP BY 1"""
SQL["custom_squeezed"] = f"WITH {_BARS} SELECT instrument % 5 AS team, date, round(CAST(sum(volume) AS DOUBLE), 6) + 0 AS squeezed FROM b GROUP BY 1, 2"
