"""DuckDB SQL with the same columns and rows as the queries of ``catalog``."""

from __future__ import annotations

from tidewell.plans.catalog import SQL
from tidewell.sources.payloads import FIELDS

# Month grid of the price series, and what is built on it.
_GRID = """
v AS (SELECT o_orderpriority AS asset_id, last_day(CAST(o_orderdate AS DATE)) AS month_end, o_totalprice AS close FROM orders WHERE o_totalprice IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY o_orderpriority, last_day(CAST(o_orderdate AS DATE)) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
g AS (SELECT asset_id, last_day(CAST(unnest(generate_series(date_trunc('month', min(month_end)), date_trunc('month', max(month_end)), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM v GROUP BY asset_id),
m AS (SELECT g.asset_id, g.month_end, v.close FROM g LEFT JOIN v ON v.asset_id = g.asset_id AND v.month_end = g.month_end),
r AS (SELECT asset_id, month_end, close, ln(close) - lag(ln(close)) OVER (PARTITION BY asset_id ORDER BY month_end) AS lr FROM m)
"""
_RATE = """
pv AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS month_end, l_discount AS rate FROM lineitem WHERE {where}
       QUALIFY row_number() OVER (PARTITION BY last_day(CAST(l_shipdate AS DATE)) ORDER BY l_discount IS NULL, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1),
pg AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month_end)), date_trunc('month', max(month_end)), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM pv),
pf AS (SELECT pg.month_end, last_value(rate IGNORE NULLS) OVER (ORDER BY pg.month_end ROWS UNBOUNDED PRECEDING) AS rate FROM pg LEFT JOIN pv ON pv.month_end = pg.month_end),
pd AS (SELECT month_end, rate - lag(rate) OVER (ORDER BY month_end) AS delta FROM pf),
pl AS (SELECT month_end, lag(delta, 1) OVER (ORDER BY month_end) AS policy FROM pd)
"""
_CORR = f"""{_GRID}, {_RATE.format(where="TRUE")},
j AS (SELECT r.*, policy, CASE WHEN lr IS NOT NULL AND policy IS NOT NULL THEN lr END AS x, CASE WHEN lr IS NOT NULL AND policy IS NOT NULL THEN policy END AS y FROM r JOIN pl USING (month_end)),
c AS (SELECT asset_id, month_end, close, lr, CASE WHEN count(x) OVER w = 36 THEN covar_samp(x, y) OVER w / nullif(sqrt(var_samp(x) OVER w * var_samp(y) OVER w), 0) END AS corr
      FROM j WINDOW w AS (PARTITION BY asset_id ORDER BY month_end ROWS 35 PRECEDING)),
l AS (SELECT *, CASE WHEN round(corr, 6) > 0.1 THEN 'positive' WHEN round(corr, 6) < -0.1 THEN 'negative' ELSE 'neutral' END AS regime FROM c)
"""
_STRATEGY = f"""{_CORR},
k AS (SELECT asset_id, month_end, lag(regime) OVER (PARTITION BY asset_id ORDER BY month_end) AS regime FROM l),
a AS (SELECT r.asset_id, r.month_end, round(lr, 6) / 10 AS ret, k.regime FROM r JOIN k ON k.asset_id = r.asset_id AND k.month_end = r.month_end WHERE lr IS NOT NULL AND k.regime IS NOT NULL)
"""
_TOTALS = """round(coalesce(product(1 + sr), 1) - 1, 6) AS total_return, CAST(count(*) FILTER (WHERE invested) AS BIGINT) AS months_invested, round(avg(sr), 6) AS mean_return, round(stddev_pop(sr), 6) AS volatility"""

_RSI = """
t AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, value AS close FROM events),
d AS (SELECT user_id, seq, close, close - lag(close) OVER (PARTITION BY user_id ORDER BY seq) AS ch FROM t),
s AS (SELECT user_id, avg(greatest(ch, 0)) AS up, avg(greatest(-ch, 0)) AS down FROM d WHERE seq BETWEEN 2 AND 15 GROUP BY user_id HAVING count(*) = 14),
q(user_id, seq, up, down) AS (
  SELECT user_id, 15, up, down FROM s
  UNION ALL
  SELECT q.user_id, d.seq, (q.up * 13 + greatest(d.ch, 0)) / 14, (q.down * 13 + greatest(-d.ch, 0)) / 14 FROM q JOIN d ON d.user_id = q.user_id AND d.seq = q.seq + 1
),
i AS (SELECT d.user_id, d.seq, d.close, CASE WHEN q.down = 0 THEN 100.0 ELSE 100 - 100 / (1 + q.up / q.down) END AS rsi FROM d LEFT JOIN q ON q.user_id = d.user_id AND q.seq = d.seq)
"""
_BARS = f"""{_RSI},
z AS (SELECT *, CASE WHEN rsi <= 45 THEN 'buy' WHEN rsi >= 55 THEN 'sell' ELSE 'hold' END AS sig, (seq % 5) / 10.0 > 0.2 AS gate FROM (SELECT user_id, seq, close, CASE WHEN seq >= 15 THEN rsi END AS rsi FROM i)),
e AS (SELECT user_id, seq, close, sig, gate, lag(CASE WHEN sig = 'buy' AND NOT gate THEN 1 WHEN sig = 'sell' THEN 0 END) OVER w AS eff, coalesce(lag(sig = 'buy' AND gate) OVER w, FALSE) AS gated FROM z WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
p AS (SELECT *, coalesce(last_value(eff IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS position FROM e),
b AS (SELECT *, position = 1 AND coalesce(lag(position) OVER w, 0) = 0 AS entry, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS ar FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
x AS (SELECT *, product(1 + ar * position) OVER w AS equity, product(1 + ar) OVER w AS hold FROM b WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, equity / max(equity) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM x)
"""
_JOBS = """
jobs AS (SELECT 'S' || CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderkey AS VARCHAR) AS dataset, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'retry' ELSE 'pending' END AS status, o_orderkey % 5 AS attempts,
  CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS next_retry_ts, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate END AS last_attempt_ts, 'err' AS last_error FROM orders)
"""


def _corr_rows(table: str, columns: list[str], kind: str = "") -> str:
    parts = []
    for i, a in enumerate(columns):
        for b in columns[: i + 1]:
            source = f"SELECT CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM {table}"
            if kind == "spearman":
                source = f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS b FROM {table}"
            parts.append(f"SELECT '{a}' AS row, '{b}' AS col, round(covar_samp(a, b) / nullif(sqrt(var_samp(a) * var_samp(b)), 0), 6) AS corr FROM ({source})")
    return " UNION ALL ".join(parts)


def _tau(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS row, '{b}' AS col, round(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / nullif(sqrt(CAST(count(*) FILTER (WHERE x.{a} <> y.{a}) AS DOUBLE) * count(*) FILTER (WHERE x.{b} <> y.{b})), 0), 6) AS corr
FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey"""


def _tau_by_value(a: str, b: str) -> str:
    """Over the pairs of distinct values, each with its rows."""
    return f"""SELECT '{a}' AS row, '{b}' AS col, round(s / nullif(sqrt(p - ta) * sqrt(p - tb), 0), 6) AS corr FROM
(SELECT CAST(sum(x.n * y.n * sign(x.a - y.a) * sign(x.b - y.b)) AS DOUBLE) / 2 AS s FROM c_{a}_{b} x, c_{a}_{b} y),
(SELECT CAST(sum(n) AS DOUBLE) * (sum(n) - 1) / 2 AS p FROM c_{a}_{b}),
(SELECT CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS ta FROM (SELECT sum(n) AS n FROM c_{a}_{b} GROUP BY a)),
(SELECT CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS tb FROM (SELECT sum(n) AS n FROM c_{a}_{b} GROUP BY b))"""


def _tau_rows(table: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    counts = ", ".join(f"c_{a}_{b} AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)" for a, b in pairs)
    return f"WITH {counts} " + " UNION ALL ".join(_tau_by_value(a, b) for a, b in pairs)


def _payload(kind: str) -> str:
    api = [c for c, f in FIELDS[kind].items() if f]
    sums = [f"CAST(sum(CAST(l_quantity AS BIGINT) * {i + 3}) AS BIGINT) AS {c}" for i, c in enumerate(api)]
    if kind == "cash_flow":
        low, high = api.index("operating_cashflow") + 3, api.index("capital_expenditures") + 3
        sums.append(f"CAST(sum(CAST(l_quantity AS BIGINT) * ({low} - {high})) AS BIGINT) AS free_cash_flow")
    return f"""SELECT 'S' || CAST(l_orderkey AS VARCHAR) AS symbol, CASE WHEN l_linenumber % 2 = 1 THEN 'annual' ELSE 'quarterly' END AS period_type, CAST(count(*) AS BIGINT) AS n,
min(CAST(l_shipdate AS DATE)) AS first_date, {', '.join(sums)} FROM lineitem GROUP BY 1, 2"""


ORACLES: dict[str, str] = {
    "month_end_last": f"WITH {_GRID} SELECT asset_id, month_end, close FROM m",
    "log_returns": f"WITH {_GRID} SELECT asset_id, month_end, round(lr, 6) AS log_return FROM r",
    "lagged_returns": f"WITH {_GRID} SELECT asset_id, month_end, lag(round(lr, 6), 2) OVER w AS lag_2, round(round(lr, 6) - lag(round(lr, 6)) OVER w, 6) AS change FROM r WINDOW w AS (PARTITION BY asset_id ORDER BY month_end)",
    "rolling_beta_36m": f"""WITH {_GRID}, b AS (SELECT month_end, lag(lr, 1) OVER (ORDER BY month_end) AS br FROM r WHERE asset_id = '1-URGENT'),
j AS (SELECT asset_id, month_end, lr, br FROM r JOIN b USING (month_end) WHERE asset_id <> '1-URGENT')
SELECT asset_id, month_end, round(CASE WHEN count(lr + br) OVER w = 36 THEN covar_samp(lr, br) OVER w / nullif(var_samp(br) OVER w, 0) END, 6) AS beta_36m
FROM j WINDOW w AS (PARTITION BY asset_id ORDER BY month_end ROWS 35 PRECEDING)""",
    "policy_ffill": f"WITH {_RATE.format(where='month(l_shipdate) <> 3')} SELECT month_end, rate FROM pf",
    "rolling_corr_36m": f"WITH {_CORR} SELECT asset_id, month_end, round(corr, 6) AS corr FROM c",
    "regime_labels": f"WITH {_CORR} SELECT asset_id, month_end, regime FROM l",
    "regime_counts": f"WITH {_CORR} SELECT asset_id, regime, CAST(count(*) AS BIGINT) AS months FROM l GROUP BY asset_id, regime",
    "current_regimes": f"WITH {_CORR} SELECT asset_id, arg_max(regime, month_end) AS regime FROM l GROUP BY asset_id",
    "model_input_frame": f"WITH {_CORR} SELECT asset_id, month_end, close AS spy_close, round(lr, 6) AS spy_log_ret_1m, round(corr, 6) AS corr, round(abs(corr), 6) AS strength, CASE WHEN corr > 0.1 THEN 'positive' WHEN corr < -0.1 THEN 'negative' ELSE 'neutral' END AS regime FROM c",
    "regime_filtered_summary": f"WITH {_STRATEGY} SELECT asset_id, strategy, {_TOTALS} FROM (SELECT asset_id, strategy, regime = strategy AS invested, CASE WHEN regime = strategy THEN ret ELSE 0.0 END AS sr FROM a, (VALUES ('positive'), ('negative'), ('neutral')) n(strategy)) GROUP BY asset_id, strategy",
    "regime_weighted_summary": f"""WITH {_STRATEGY}, w AS (SELECT *, CASE regime WHEN 'negative' THEN 0.5 ELSE 1.0 END AS weight FROM a)
SELECT asset_id, strategy, {_TOTALS} FROM (SELECT asset_id, 'weighted_by_regime' AS strategy, weight > 0 AS invested, ret * weight AS sr FROM w UNION ALL SELECT asset_id, 'always_long', TRUE, ret FROM w) GROUP BY asset_id, strategy""",
    "rsi_14": f"WITH RECURSIVE {_RSI} SELECT user_id, seq, CASE WHEN seq >= 15 THEN round(rsi, 6) END AS rsi FROM i",
    "rsi_signal": f"WITH RECURSIVE {_RSI} SELECT user_id, seq, CASE WHEN seq < 15 THEN 'hold' WHEN round(rsi, 6) <= 45 THEN 'buy' WHEN round(rsi, 6) >= 55 THEN 'sell' ELSE 'hold' END AS signal FROM i",
    "rsi_position": f"WITH RECURSIVE {_BARS} SELECT user_id, seq, position, gated, entry FROM b",
    "equity_curve": f"WITH RECURSIVE {_BARS} SELECT user_id, seq, round(log10(equity), 6) AS equity_log10, round(drawdown, 6) + 0.0 AS drawdown FROM y",
    "rsi_backtest_metrics": f"""WITH RECURSIVE {_BARS} SELECT user_id, round(log10(arg_max(equity, seq)), 6) AS total_log10, round(log10(arg_max(hold, seq)), 6) AS hold_log10, CAST(count(*) FILTER (WHERE entry) AS BIGINT) AS trades,
round(coalesce(CAST(count(*) FILTER (WHERE position = 1 AND seq > 1 AND ar > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE position = 1 AND seq > 1), 0), 0.0), 6) AS hit_rate,
CAST(count(*) FILTER (WHERE gated) AS BIGINT) AS gated_buys, CAST(count(*) AS BIGINT) AS bars FROM y GROUP BY user_id HAVING count(*) >= 2""",
    "max_drawdown": f"WITH RECURSIVE {_BARS} SELECT user_id, round(min(drawdown), 6) + 0.0 AS max_drawdown FROM y GROUP BY user_id HAVING count(*) >= 2",
    "upsert_latest": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'newer' WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name, round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 6) AS c_acctbal FROM customer",
    "insert_ignore": "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 20, 'added' FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)",
    "seed_cross": "SELECT replace(upper(trim(n_name)), '.', '-') AS symbol, r_name AS dataset FROM nation, region GROUP BY 1, 2",
    "due_jobs_topk": f"WITH {_JOBS} SELECT symbol, dataset, attempts FROM jobs WHERE status <> 'success' AND (next_retry_ts IS NULL OR next_retry_ts <= TIMESTAMP '1998-01-01') ORDER BY coalesce(next_retry_ts, TIMESTAMP '1970-01-01'), attempts, symbol, dataset LIMIT 25",
    "recent_failures_topk": f"WITH {_JOBS} SELECT symbol, dataset, attempts, last_error, CAST(last_attempt_ts AS VARCHAR) AS last_attempt_ts, CAST(next_retry_ts AS VARCHAR) AS next_retry_ts FROM jobs WHERE status = 'retry' ORDER BY coalesce(last_attempt_ts, TIMESTAMP '1970-01-01') DESC, symbol, dataset LIMIT 10",
    "status_counts": f"WITH {_JOBS} SELECT s.status, CAST(count(jobs.status) AS BIGINT) AS jobs FROM (VALUES ('pending'), ('retry'), ('success')) s(status) LEFT JOIN jobs ON jobs.status = s.status GROUP BY s.status",
    "next_retry": f"WITH {_JOBS} SELECT CAST(min(next_retry_ts) FILTER (WHERE status = 'retry') AS VARCHAR) AS next_retry FROM jobs",
    "status_rollup": f"WITH {_JOBS} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE status <> 'success') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE status = 'retry') AS BIGINT) AS retrying FROM jobs",
    "backoff_delay": f"WITH {_JOBS} SELECT dataset, CAST(30 * (1 << least(attempts, 4)) AS BIGINT) AS minutes, next_retry_ts + to_minutes(CAST(30 * (1 << least(attempts, 4)) AS BIGINT)) AS again FROM jobs",
    "mark_outcomes": f"""WITH {_JOBS} SELECT symbol, dataset, CASE attempts WHEN 1 THEN 'success' WHEN 2 THEN 'retry' ELSE status END AS status, attempts + CASE WHEN attempts IN (1, 2) THEN 1 ELSE 0 END AS attempts,
CAST(CASE WHEN attempts = 1 THEN 7 ELSE 0 END AS BIGINT) AS rows_written, CASE attempts WHEN 1 THEN NULL WHEN 2 THEN 'boom' ELSE last_error END AS last_error,
CASE attempts WHEN 1 THEN NULL WHEN 2 THEN TIMESTAMP '1998-01-01' ELSE next_retry_ts END AS next_retry_ts FROM jobs""",
    "to_int_clean": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1234 WHEN 1 THEN -7 WHEN 5 THEN event_id END AS n FROM events",
    "json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent FROM events",
    "canonical_props": "SELECT event_id, replace(props, ' ', '') AS props FROM events",
    "free_cash_flow": "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_discount, 6) AS free_cash_flow FROM lineitem",
    "price_validation": "SELECT o_orderpriority AS asset_id, o_orderkey AS tie, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 6) AS close FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_totalprice IS NOT NULL",
    "corr_pearson": _corr_rows("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "corr_spearman": _corr_rows("part", ["p_size", "p_retailprice", "p_partkey"], "spearman"),
    "corr_kendall": " UNION ALL ".join(_tau(a, b) for a, b in (("s_nationkey", "s_nationkey"), ("s_acctbal", "s_nationkey"), ("s_acctbal", "s_acctbal"))),
    "corr_kendall_rows": _tau_rows("lineitem", ["l_quantity", "l_discount", "l_tax"]),
    "series_scans": """SELECT l_orderkey, l_linenumber, row_number() OVER w AS place, last_value(CASE WHEN l_discount > 0.08 THEN l_extendedprice END IGNORE NULLS) OVER s AS discounted,
max(l_extendedprice) OVER s AS highest, lag(l_extendedprice) OVER w AS before
FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_discount), s AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_discount ROWS UNBOUNDED PRECEDING)""",
    "zscore": "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / coalesce(nullif(stddev_pop(p_size) OVER (), 0), 1), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / coalesce(nullif(stddev_pop(p_retailprice) OVER (), 0), 1), 6) AS p_retailprice FROM part",
    "numeric_model_frame": "SELECT s_suppkey, s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM supplier WHERE s_suppkey IS NOT NULL AND s_nationkey IS NOT NULL AND s_acctbal IS NOT NULL",
    "row_sample": "SELECT p_partkey FROM part ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 50",
    "time_points": "SELECT o_orderdate AS x, o_totalprice AS y, o_orderpriority AS color FROM orders",
    "asof_join": """WITH q AS (SELECT l_suppkey AS k, l_shipdate AS at, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
SELECT o.o_orderkey AS id, round(q.v, 6) AS v FROM orders o ASOF LEFT JOIN q ON q.k = o.o_custkey AND q.at <= o.o_orderdate""",
    "point_in_interval": """WITH w AS (SELECT s_suppkey, TIMESTAMP '1994-01-01' + to_days(CAST(s_suppkey * 13 % 1500 AS INTEGER)) AS b, TIMESTAMP '1994-01-01' + to_days(CAST(s_suppkey * 13 % 1500 + s_nationkey AS INTEGER)) AS e FROM supplier)
SELECT s_suppkey, CAST(count(*) AS BIGINT) AS orders, min(o_orderkey) AS first_order FROM w JOIN orders ON o_orderdate BETWEEN b AND e GROUP BY s_suppkey""",
    "interval_overlap": """SELECT p_partkey, CAST(count(*) AS BIGINT) AS customers, min(c_custkey) AS first_customer FROM part JOIN customer ON p_partkey <= c_custkey * 2 + c_nationkey * c_nationkey AND c_custkey * 2 <= p_partkey + p_size GROUP BY p_partkey""",
    "rising_runs": """WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value FROM events),
s AS (SELECT *, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY seq) THEN 0 ELSE 1 END AS starts FROM t),
r AS (SELECT user_id, value, seq, sum(starts) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM s),
g AS (SELECT user_id, run, count(value) AS n, arg_min(value, seq) AS first FROM r WHERE value IS NOT NULL GROUP BY user_id, run)
SELECT user_id, CAST(count(*) AS BIGINT) AS runs, CAST(max(n) AS BIGINT) AS longest, round(max(first), 6) AS highest_start FROM g GROUP BY user_id""",
    "html_links": "SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, h[pos] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages))",
    "html_table_rows": "SELECT p_name AS company, 'T' || CAST(p_partkey AS VARCHAR) AS ticker, p_type || ' x' AS sector FROM part",
    **{f"payload_{kind}": _payload(kind) for kind in FIELDS},
    **SQL,
}
