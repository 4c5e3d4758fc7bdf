"""The same queries in SQL, written independently of the operators (joins instead of frames where both can say it)."""

from __future__ import annotations

import math
import re

from rankloom.plans import reference as q

N, K, B, X, Y, TTL = q.N, q.TOPK["k"], int(q.TOPK["k"] * q.TOPK["buffer_ratio"]), q.TOPK["x"], q.TOPK["y"], q.TOPK["ttl"]
L, MISS, M = q.LOOKBACK, q.MISSING, q.MIN_STOCKS
PERIOD = f"BETWEEN DATE '{q.START}' AND DATE '{q.END}'"


def normal_quantile(p: float) -> float:
    """By halving, on the error function."""
    lo, hi = -10.0, 10.0
    while hi - lo > 1e-15:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if (1 + math.erf(mid / math.sqrt(2))) / 2 < p else (lo, mid)
    return lo


def luck(trials: int, variance: float) -> float:
    """The highest Sharpe ratio to expect of so many trials without skill."""
    euler = 0.5772156649
    return math.sqrt(variance) * ((1 - euler) * normal_quantile(1 - 1 / trials) + euler * normal_quantile(1 - 1 / trials / math.e))


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


PANEL = """bars AS (SELECT l_suppkey AS security_id, date_trunc('week', l_shipdate)::DATE AS date, arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS dollar, sum(l_quantity::DECIMAL(18,0))::DOUBLE AS volume FROM lineitem GROUP BY 1, 2),
panel AS (SELECT security_id, date, open, high, low, dollar / volume AS close, volume, dollar / volume AS adj_close, (dollar / volume) / lag(dollar / volume) OVER (PARTITION BY security_id ORDER BY date) - 1 AS ret_total FROM bars),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_idx FROM (SELECT DISTINCT date FROM panel)),
px AS (SELECT panel.*, day_idx, ln(1 + ret_total) AS lr FROM panel JOIN cal USING (date))"""

FEAT = f""", feat AS (SELECT security_id, date, day_idx, lr AS log_ret, CASE WHEN count(adj_close) OVER w = {N} THEN adj_close / avg(adj_close) OVER w - 1 END AS dist_sma_{N},
  CASE WHEN count(lr) OVER w = {N} THEN stddev_samp(lr) OVER w END AS vol_{N} FROM px WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW))"""


def label(h: int, offset: int, name: str = "lab") -> str:
    return f""", {name} AS (SELECT c.date, p.security_id, CASE WHEN max(n.day_idx) = p.day_idx + {offset + h} AND count(*) FILTER (n.day_idx IS NOT NULL AND n.ret_total IS NULL) = 0 THEN product(1 + n.ret_total) - 1 END AS label
  FROM px p JOIN cal c ON c.day_idx = p.day_idx + 1 LEFT JOIN px n ON n.security_id = p.security_id AND n.day_idx BETWEEN p.day_idx + {offset + 1} AND p.day_idx + {offset + h}
  WHERE p.close IS NOT NULL AND c.date {PERIOD} GROUP BY c.date, p.security_id, p.day_idx)"""


PRED = FEAT + label(5, 0) + f""", pred AS (SELECT lab.date, lab.security_id, round(-dist_sma_{N}, 9) AS score, round(label, 9) AS label FROM feat JOIN cal c ON c.day_idx = feat.day_idx + 1
  JOIN lab ON lab.date = c.date AND lab.security_id = feat.security_id WHERE dist_sma_{N} IS NOT NULL), use AS (SELECT * FROM pred WHERE label IS NOT NULL AND score IS NOT NULL)"""

_AVG_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def ic(table: str = "use", by: str = "date") -> str:
    a, b = _AVG_RANK.format(by=by, x="score"), _AVG_RANK.format(by=by, x="label")
    return f"(SELECT {by}, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM (SELECT *, ({a})::DOUBLE AS a, ({b})::DOUBLE AS b FROM {table}) GROUP BY {by} HAVING count(*) >= {M} AND stddev_samp(score) >= 1e-12 AND covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) IS NOT NULL)"


def bucketed(table: str = "use", by: str = "date", n: int = q.BUCKETS) -> str:
    return f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS c, ((row_number() OVER (PARTITION BY {by} ORDER BY score, security_id) - 1) * {n}) // count(*) OVER (PARTITION BY {by}) + 1 AS bucket FROM {table}) WHERE c >= {M})"


def spread(table: str = "use", by: str = "date", cost: float = 0.0) -> str:
    n = q.BUCKETS
    return f"(SELECT * FROM (SELECT {by}, avg(label) FILTER (bucket = {n}) - avg(label) FILTER (bucket = 1) - {cost / 1e4} AS spread FROM {bucketed(table, by)} GROUP BY {by}) WHERE spread IS NOT NULL)"


def universe(agg: str = "sum") -> str:
    score = {"sum": "coalesce(sum(n.close * n.volume) FILTER (n.day_idx >= i.day_idx - %d), 0)", "mean": "avg(n.close * n.volume) FILTER (n.day_idx >= i.day_idx - %d)", "median": "median(n.close * n.volume) FILTER (n.day_idx >= i.day_idx - %d)"}[agg] % X
    return f""", days AS (SELECT date, day_idx, day_idx - min(day_idx) OVER () AS since, max(date) OVER () AS last FROM cal WHERE date {PERIOD}),
i AS (SELECT since // {TTL} AS j, day_idx, date AS refresh_date, coalesce(lead(date) OVER (ORDER BY date), last + 1) AS valid_until FROM days WHERE since % {TTL} = 0),
cand AS (SELECT i.j, n.security_id, {score} AS score FROM i JOIN px n ON n.day_idx BETWEEN i.day_idx - {Y} AND i.day_idx - 1 AND n.close IS NOT NULL GROUP BY i.j, n.security_id, i.day_idx HAVING count(*) >= {X} AND max(n.day_idx) = i.day_idx - 1),
top AS (SELECT i.j, coalesce(list(security_id ORDER BY rk) FILTER (rk <= {K + B}), []) AS ids FROM i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC NULLS LAST, security_id) AS rk FROM cand) USING (j) GROUP BY i.j),
chain(j, sel) AS (SELECT 0::BIGINT, ids[1:{K}] FROM top WHERE j = 0 UNION ALL SELECT t.j, list_filter(t.ids, lambda s: list_contains(c.sel, s) OR list_contains(list_filter(t.ids, lambda u: NOT list_contains(c.sel, u))[1:{K} - len(list_filter(t.ids, lambda v: list_contains(c.sel, v)))], s))
  FROM chain c JOIN top t ON t.j = c.j + 1),
uni AS (SELECT refresh_date, valid_until, slot, sel[slot + 1] AS security_id, sel[slot + 1] IS NULL AS is_pad FROM chain JOIN i USING (j), (SELECT unnest(range({K})) AS slot))"""


SLOTS = ", slots AS (SELECT c.date, c.day_idx, slot, security_id, is_pad FROM uni JOIN cal c ON c.date >= refresh_date AND c.date < valid_until)"
WINDOW = FEAT + universe() + SLOTS + f""", w0 AS (SELECT s.date, s.day_idx, s.slot, s.security_id, lag, f.log_ret, f.dist_sma_{N} FROM slots s, (SELECT unnest(range({L})) AS lag) LEFT JOIN feat f ON f.security_id = s.security_id AND f.day_idx = s.day_idx - {L} + lag WHERE s.day_idx >= {L}),
win AS (SELECT *, security_id IS NOT NULL AND count(*) FILTER (log_ret IS NULL OR dist_sma_{N} IS NULL) OVER (PARTITION BY day_idx, slot) <= {MISS} AS real FROM w0)"""


def long(sub: str) -> str:
    cols = ", ".join(r(f"CASE WHEN real THEN coalesce({n}, 0) ELSE 0 END", n) for n in q.NAMES)
    return f"SELECT date, slot::BIGINT AS slot, lag::BIGINT AS lag, real, {cols} FROM ({sub})"


def zscored(clip: bool = False, ddof: int = 1) -> str:
    sd = "stddev_samp" if ddof else "stddev_pop"
    z = lambda n: f"CASE WHEN real AND count(CASE WHEN real THEN {n} END) OVER d > {ddof} THEN ({n} - avg(CASE WHEN real THEN {n} END) OVER d) / ({sd}(CASE WHEN real THEN {n} END) OVER d + 1e-8) END"
    a, b = (z(n) for n in q.NAMES)
    if clip:
        a = f"CASE WHEN ({a}) IS NOT NULL THEN greatest(-1.5, least(1.5, {a})) END"
    return f"SELECT date, slot, lag, real, {a} AS {q.NAMES[0]}, {b} AS {q.NAMES[1]} FROM win WINDOW d AS (PARTITION BY day_idx, lag)"


def ranked() -> str:
    z = lambda n: f"CASE WHEN real AND {n} IS NOT NULL AND count(CASE WHEN real THEN {n} END) OVER (PARTITION BY day_idx, lag) >= 2 THEN (row_number() OVER (PARTITION BY day_idx, lag ORDER BY CASE WHEN real THEN {n} END ASC NULLS LAST, slot) - 1) / (count(CASE WHEN real THEN {n} END) OVER (PARTITION BY day_idx, lag) - 1)::DOUBLE - 0.5 END"
    return f"SELECT date, slot, lag, real, {z(q.NAMES[0])} AS {q.NAMES[0]}, {z(q.NAMES[1])} AS {q.NAMES[1]} FROM win"


FILLED = "SELECT date, slot, lag, real, " + ", ".join(f"last_value({n} IGNORE NULLS) OVER (PARTITION BY day_idx, slot ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}" for n in q.NAMES) + " FROM win"

PERIODS = PRED + f""", fwd AS (SELECT date, security_id, CASE WHEN count(lr) OVER w = {q.FREQ} THEN sum(lr) OVER w END AS fwd FROM px WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {q.FREQ} FOLLOWING)),
have AS (SELECT p.date, p.security_id, score, fwd FROM pred p JOIN fwd USING (date, security_id) WHERE fwd IS NOT NULL AND score IS NOT NULL),
reb AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM have)) WHERE k % {q.FREQ} = 0),
side AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, security_id) AS lo, count(*) OVER (PARTITION BY date) AS n FROM have SEMI JOIN reb USING (date)),
per AS (SELECT date, 0.5 * (avg(fwd) FILTER (lo > n - {q.HOLD}) - avg(fwd) FILTER (lo <= {q.HOLD})) AS gross, 0.5 * (avg(fwd) FILTER (lo > n - {q.HOLD}) - avg(fwd) FILTER (lo <= {q.HOLD})) - {q.COST / 1e4} AS net FROM side WHERE n >= {2 * q.HOLD} GROUP BY date),
curve AS (SELECT *, equity / max(equity) OVER (ORDER BY date) - 1 AS drawdown FROM (SELECT *, product(1 + net) OVER (ORDER BY date) AS equity FROM per))"""


def tau(table: str, by: str = "date") -> str:
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"a.{k}" for k in keys)
    sx, sy = "sign(a.score - b.score)", "sign(a.label - b.label)"
    return f"""(SELECT * FROM (SELECT {cols}, sum({sx} * {sy}) / nullif(sqrt(sum({sx} * {sx})::DOUBLE) * sqrt(sum({sy} * {sy})::DOUBLE), 0) AS tau FROM {table} a JOIN {table} b ON {on} AND a.security_id < b.security_id
  JOIN (SELECT {by} FROM {table} GROUP BY {by} HAVING count(*) >= {M} AND stddev_samp(score) > 1e-6) g ON {" AND ".join(f"a.{k} = g.{k}" for k in keys)} GROUP BY {cols}) WHERE tau IS NOT NULL)"""


LEGACY = """, lg0 AS (SELECT date, security_id, close, greatest(-0.5, least(0.5, x)) AS log_ret FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY security_id ORDER BY date)) AS x FROM px) WHERE x IS NOT NULL
  UNION ALL SELECT date, security_id, close, NULL FROM (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY date) AS x FROM px) WHERE x IS NULL),
lg AS (SELECT date, security_id, log_ret, CASE WHEN count(log_ret) OVER a = 12 THEN stddev_samp(log_ret) OVER a END AS vol, CASE WHEN count(close) OVER b = 4 THEN close / avg(close) OVER b - 1 END AS dsma_short,
  CASE WHEN count(close) OVER a = 12 THEN close / avg(close) OVER a - 1 END AS dsma_long FROM lg0 WINDOW a AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""
LG = ["log_ret", "vol", "dsma_short", "dsma_long"]


def fold_rows(n: int | None = None) -> str:
    """The split's arithmetic on the number of days, as SQL."""
    f, p, e, v = q.SPLIT["n_folds"], q.SPLIT["purge"], q.SPLIT["embargo"], q.SPLIT["val_frac"]
    return f"""SELECT 'fold_' || k AS fold, s.segment, CASE s.segment WHEN 'train' THEN 0 WHEN 'val' THEN hist - floor(hist * {v})::BIGINT ELSE test END AS lo,
  CASE s.segment WHEN 'train' THEN hist - floor(hist * {v})::BIGINT - {p} WHEN 'val' THEN hist ELSE CASE WHEN k = {f} THEN n ELSE test + size END END AS hi
  FROM (SELECT k, n, n // {f + 1} AS size, n - ({f + 1} - k) * (n // {f + 1}) AS test, n - ({f + 1} - k) * (n // {f + 1}) - {p + e} AS hist FROM nd, (SELECT unnest(range(1, {f + 1})) AS k)), (VALUES ('train'), ('val'), ('test')) s(segment)"""


FOLDS = PRED + f""", pd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM pred)), nd AS (SELECT count(*) AS n FROM pd), fr AS ({fold_rows()}),
uf AS (SELECT use.*, fold FROM use JOIN pd USING (date) JOIN fr ON fr.segment = 'test' AND pos >= lo AND pos < hi UNION ALL SELECT use.*, 'all' FROM use JOIN pd USING (date) JOIN fr ON fr.segment = 'test' AND pos >= lo AND pos < hi)"""


MODEL_TEST = WINDOW + f""", mrow AS (SELECT DISTINCT date, slot, security_id FROM win WHERE real), mday AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM mrow)), nd AS (SELECT count(*) AS n FROM mday), mfold AS ({fold_rows()}),
mtest AS (SELECT date, slot, security_id, fold FROM mrow JOIN mday USING (date) JOIN mfold ON segment = 'test' AND pos >= lo AND pos < hi)"""


def w(body: str, ctes: str = "", recursive: bool = False) -> str:
    """The whole statement; days come out as strings, as in the queries."""
    days = [c for c in ("refresh_date", "valid_until", "date") if re.match(rf"SELECT (DISTINCT )?([^()]*[ .])?{c}\b", body)]
    sql = f"WITH {'RECURSIVE ' if recursive else ''}{PANEL}{ctes} {body}"
    return f"SELECT * REPLACE ({', '.join(f'strftime({c}, {chr(39)}%Y-%m-%d{chr(39)}) AS {c}' for c in days)}) FROM ({sql})" if days else sql


def feature(expr: str, name: str, ctes: str = FEAT, table: str = "feat") -> str:
    return w(f"SELECT date, security_id, {r(expr, name)} FROM {table}", ctes)


SQL: dict[str, str] = {
    "panel_weekly": w("SELECT security_id, date, " + ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume", "adj_close", "ret_total")) + " FROM panel"),
    "panel_between": w(f"SELECT security_id, date, {r('close', 'close')} FROM panel WHERE date BETWEEN DATE '1997-01-06' AND DATE '1997-12-29'"),
    "calendar_days": w("SELECT date, day_idx FROM cal"),
    "feat_log_ret": feature("log_ret", "log_ret"),
    "feat_log_ret_clip": feature("CASE WHEN lr IS NOT NULL THEN greatest(-0.2, least(0.2, lr)) END", "log_ret", "", "px"),
    "feat_vol": feature(f"vol_{N}", f"vol_{N}"),
    "feat_dist_sma": feature(f"dist_sma_{N}", f"dist_sma_{N}"),
    "feat_log_dollar_volume": feature("ln(1 + close * volume)", "log_dollar_volume", "", "px"),
    "feat_log_dollar_volume_n": w(f"SELECT date, security_id, {r('CASE WHEN count(*) OVER w = 4 THEN ln(1 + avg(close * volume) OVER w) END', 'log_dollar_volume_4')} FROM px WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"),
    "feat_raw": feature("volume", "units", "", "px"),
    "ind_equal_weight_return": w(f"SELECT date, {r('avg(lr)', 'value')} FROM px GROUP BY date"),
    "market_table": w(f"SELECT date, {r('avg(lr)', 'ts__equal_weight_return')}, {r('avg(CASE WHEN ret_total IS NOT NULL THEN (ret_total > 0)::INT END)', 'static__breadth')}, {r('avg(lr)', 'ts__again')} FROM px GROUP BY date"),
    **{name: w("SELECT refresh_date, valid_until, slot::BIGINT AS slot, security_id, is_pad FROM uni", universe(agg), True) for name, agg in (("universe_topk", "sum"), ("universe_topk_mean", "mean"), ("universe_topk_median", "median"))},
    "slots_per_day": w("SELECT date, day_idx, slot::BIGINT AS slot, security_id, is_pad FROM slots", universe() + SLOTS, True),
    "label_forward_return": w(f"SELECT date, security_id, {r('label', 'label')} FROM lab", label(5, 0)),
    "label_offset1": w(f"SELECT date, security_id, {r('label', 'label')} FROM lab", label(3, 1)),
    "window_mask": w("SELECT DISTINCT date, slot::BIGINT AS slot, security_id, real FROM win", WINDOW, True),
    "window_zero": w(long("SELECT * FROM win"), WINDOW, True),
    "window_ffill": w(long(FILLED), WINDOW, True),
    "xf_zscore": w(long(zscored()), WINDOW, True),
    "xf_clip": w(long(zscored(True)), WINDOW, True),
    "xf_rank": w(long(ranked()), WINDOW, True),
    "window_market": w(
        f"SELECT d.date, lag::BIGINT AS lag, {r('coalesce(a.ew, 0)', 'ts__equal_weight_return')}, {r('coalesce(b.br, 0)', 'static__breadth')} FROM (SELECT DISTINCT date, day_idx FROM slots WHERE day_idx >= {L}) d, (SELECT unnest(range({L})) AS lag) LEFT JOIN mk a ON a.day_idx = d.day_idx - {L} + lag LEFT JOIN mk b ON b.day_idx = d.day_idx - 1",
        universe() + SLOTS + ", mk AS (SELECT day_idx, avg(lr) AS ew, avg(CASE WHEN ret_total IS NOT NULL THEN (ret_total > 0)::INT END) AS br FROM px GROUP BY day_idx)",
        True,
    ),
    "split_purged": w(f"SELECT fold, segment, lo::BIGINT AS lo, hi::BIGINT AS hi FROM ({fold_rows()})", ", nd AS (SELECT count(*) AS n FROM cal)"),
    "metric_ic_by_date": w(f"SELECT date, {r('ic', 'ic')} FROM {ic()}", PRED),
    "metric_mean_ic": w(f"SELECT {r('avg(ic)', 'value')} FROM {ic()}", PRED),
    "metric_icir": w(f"SELECT {r('avg(ic) / stddev_samp(ic) * sqrt(52)', 'value')} FROM {ic()}", PRED),
    "metric_hit_rate": w(f"SELECT {r('avg((ic > 0)::INT)', 'value')} FROM {ic()}", PRED),
    "metric_decile_spread": w(f"SELECT date, {r('spread', 'spread')} FROM {spread(cost=10.0)}", PRED),
    "metric_bucket_profile": w(f"SELECT bucket::BIGINT AS bucket, {r('avg(m)', 'label')} FROM (SELECT date, bucket, avg(label) AS m FROM {bucketed()} GROUP BY date, bucket) GROUP BY bucket", PRED),
    "metric_bucket_pooled": w(f"SELECT bucket::BIGINT AS bucket, {r('avg(label)', 'label')} FROM {bucketed()} GROUP BY bucket", PRED),
    "metric_decile_monotonicity": w(
        f"SELECT {r('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)', 'value')} FROM (SELECT rank() OVER (ORDER BY bucket)::DOUBLE AS a, rank() OVER (ORDER BY l)::DOUBLE AS b FROM (SELECT bucket, avg(m) AS l FROM (SELECT date, bucket, avg(label) AS m FROM {bucketed()} GROUP BY date, bucket) GROUP BY bucket))", PRED
    ),
    "metrics_by_fold": w(
        f"SELECT fold, 'mean_ic' AS metric, {r('avg(ic)', 'value')} FROM {ic('uf', 'fold, date')} GROUP BY fold UNION ALL SELECT fold, 'ic_hit_rate', round(avg((ic > 0)::INT), 6) + 0.0 FROM {ic('uf', 'fold, date')} GROUP BY fold UNION ALL SELECT fold, 'decile_spread', round(avg(spread), 6) + 0.0 FROM {spread('uf', 'fold, date')} GROUP BY fold", FOLDS
    ),
    "loss_hinge": w(
        f"SELECT date, {r('h + m', 'loss')} FROM (SELECT a.date, avg(greatest(0, 0.1 - (a.score - b.score))) AS h FROM lt a JOIN lt b ON a.date = b.date WHERE a.rk > a.n - a.tail AND b.rk <= b.tail GROUP BY a.date) JOIN (SELECT date, avg((score - y) * (score - y)) AS m FROM lt GROUP BY date) USING (date)",
        PRED
        + ", lt AS (SELECT *, greatest(1, floor(n * 0.1))::BIGINT AS tail FROM (SELECT date, score, (label - avg(label) OVER d) / (stddev_samp(label) OVER d + 1e-8) AS y, row_number() OVER (PARTITION BY date ORDER BY label, security_id) AS rk, count(*) OVER d AS n FROM use WINDOW d AS (PARTITION BY date)) WHERE n >= 2)",
    ),
    "loss_pearson_rank": w(f"SELECT date, {r('-(covar_pop(score, k) * count(*)) / (sqrt(var_pop(score) * count(*)) * sqrt(var_pop(k) * count(*)) + 1e-8)', 'loss')} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY label, security_id)::DOUBLE AS k FROM use) GROUP BY date HAVING count(*) >= 2", PRED),
    "validation_ic": w(f"SELECT {r('coalesce(avg(v), 0)', 'value')} FROM (SELECT date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS v FROM (SELECT date, row_number() OVER (PARTITION BY date ORDER BY score, security_id)::DOUBLE AS a, row_number() OVER (PARTITION BY date ORDER BY label, security_id)::DOUBLE AS b FROM use) GROUP BY date)", PRED),
    "bt_long_short": w(f"SELECT date, {r('gross', 'gross')}, {r('net', 'net')} FROM per", PERIODS),
    "bt_drawdown": w(f"SELECT date, {r('net', 'net')}, {r('equity', 'equity')}, {r('drawdown', 'drawdown')}, {r('CASE WHEN count(*) OVER w = 24 THEN avg(net) OVER w / stddev_samp(net) OVER w * sqrt(252.0 / 5) END', 'rolling_sharpe')} FROM curve WINDOW w AS (ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)", PERIODS),
    "bt_summary": w(
        f"SELECT {r('avg(net) * 50.4', 'ann_return')}, {r('stddev_samp(net) * sqrt(50.4)', 'ann_vol')}, {r('avg(net) * 50.4 / (stddev_samp(net) * sqrt(50.4))', 'sharpe')}, {r('avg(net) * 50.4 / (stddev_samp(net) FILTER (net < 0) * sqrt(50.4))', 'sortino')}, {r('avg(net) * 50.4 / abs(min(drawdown))', 'calmar')}, {r('min(drawdown)', 'max_drawdown')}, count(*) AS periods FROM curve", PERIODS
    ),
    "bt_turnover": w(
        f"SELECT date, {r('sum(abs(d)) / 2', 'turnover')} FROM (SELECT p.p, coalesce(b.w, 0) - coalesce(a.w, 0) AS d FROM (SELECT DISTINCT p, security_id FROM (SELECT p, security_id FROM held UNION ALL SELECT p + 1, security_id FROM held)) p LEFT JOIN held b USING (p, security_id) LEFT JOIN held a ON a.p = p.p - 1 AND a.security_id = p.security_id) JOIN hd USING (p) WHERE p > 1 GROUP BY date",
        PRED
        + f""", rd AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM pred WHERE score IS NOT NULL)) WHERE k % {q.FREQ} = 0),
sd AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, security_id) AS lo, count(*) OVER (PARTITION BY date) AS n FROM (SELECT * FROM pred WHERE score IS NOT NULL) SEMI JOIN rd USING (date)),
hd AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM sd WHERE n >= {2 * q.HOLD})),
held AS (SELECT p, security_id, CASE WHEN lo > n - {q.HOLD} THEN 1.0 ELSE -1.0 END / {q.HOLD} AS w FROM sd JOIN hd USING (date) WHERE n >= {2 * q.HOLD} AND (lo > n - {q.HOLD} OR lo <= {q.HOLD}))""",
    ),
    "bt_top_beats_bottom": w(f"SELECT {r('avg((spread > 0)::INT)', 'value')} FROM {spread('rb')}", PRED + f", rb AS (SELECT * FROM use SEMI JOIN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM pred)) WHERE k % {q.FREQ} = 0) USING (date))"),
    "kendall_ic": w(f"SELECT date, {r('tau', 'tau')} FROM {tau('use')}", PRED),
    "kendall_summary": w(f"SELECT {r('avg(tau)', 'mean_tau')}, {r('avg(tau) / stddev_samp(tau) * sqrt(252)', 'tau_ir')}, {r('sum(tau)', 'cum_tau')} FROM {tau('use')}", PRED),
    "alpha_decay": w(
        f"SELECT lag::BIGINT AS lag, {r('coalesce(avg(tau), 0)', 'mean_tau')} FROM (SELECT unnest(range(1, 6)) AS lag) LEFT JOIN {tau('dl', 'lag, date')} USING (lag) GROUP BY lag",
        PRED + ", dl AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS lag, date, security_id, score, lead(label, {k}) OVER (PARTITION BY security_id ORDER BY date) AS label FROM pred" for k in range(1, 6)) + ") WHERE score IS NOT NULL AND label IS NOT NULL)",
    ),
    "horizon_retention": w(
        f"SELECT horizon::BIGINT AS horizon, {r('m', 'mean_tau')}, {r('m / max(m) FILTER (horizon = 1) OVER () * 100', 'retention')} FROM (SELECT horizon, avg(tau) AS m FROM (SELECT *, count(*) OVER (PARTITION BY date) AS k FROM {tau('hl', 'horizon, date')}) WHERE k = 3 GROUP BY horizon)",
        PRED
        + ", hs AS (SELECT date, security_id, "
        + ", ".join(f"CASE WHEN count(lr) OVER w{h} = {h} THEN sum(lr) OVER w{h} END AS h{h}" for h in (1, 5, 10))
        + " FROM px WINDOW "
        + ", ".join(f"w{h} AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (1, 5, 10))
        + "), hj AS (SELECT p.date, p.security_id, score, h1, h5, h10 FROM pred p JOIN hs USING (date, security_id) WHERE h1 IS NOT NULL AND h5 IS NOT NULL AND h10 IS NOT NULL AND score IS NOT NULL), hl AS ("
        + " UNION ALL ".join(f"SELECT {h} AS horizon, date, security_id, score, h{h} AS label FROM hj" for h in (1, 5, 10))
        + ")",
    ),
    "newey_west": w(
        f"SELECT count(*) AS n, {r('avg(v)', 'mean')}, {r('avg(v) / sqrt((sum(e * e) + ' + ' + '.join(f'2 * {1 - k / 6} * coalesce(sum(e * e{k}), 0)' for k in range(1, 6)) + ') / count(*) / count(*))', 't_stat')}, {r('avg((v > 0)::INT)', 'share_positive')} FROM (SELECT v, e, "
        + ", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS e{k}" for k in range(1, 6))
        + f" FROM (SELECT date, ic AS v, ic - avg(ic) OVER () AS e FROM {ic()}))",
        PRED,
    ),
    "deflated_sharpe": w(
        f"SELECT {r('sr', 'sharpe')}, {r(f'(sr - {luck(5, 0.3)!r}) * sqrt(n) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr)', 'stat')}, n FROM (SELECT avg(gross) * 50.4 / (stddev_samp(gross) * sqrt(50.4)) AS sr, count(*) AS n, kurtosis_pop(gross) + 3 AS g4, avg(c3) / (var_pop(gross) ** 1.5) AS g3 FROM (SELECT gross, (gross - avg(gross) OVER ()) ** 3 AS c3 FROM per))", PERIODS
    ),
    "ic_trend": w(f"SELECT {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'intercept')} FROM (SELECT sum(ic) OVER (ORDER BY date) AS y, (row_number() OVER (ORDER BY date) - 1)::DOUBLE AS x FROM {ic()})", PRED),
    "audit": w(
        f"SELECT * FROM (SELECT {r('avg(ic)', 'mean_ic')}, {r('avg(ic) / stddev_samp(ic) * sqrt(252)', 'icir')} FROM {ic('au')}), (SELECT {r('avg(net) * 252', 'ann_return')}, {r('stddev_samp(net) * sqrt(252)', 'ann_vol')}, {r('avg(net) * 252 / (stddev_samp(net) * sqrt(252))', 'sharpe')}, {r('min(dd)', 'max_drawdown')} FROM (SELECT net, eq / max(eq) OVER (ORDER BY date) - 1 AS dd FROM (SELECT date, net, product(1 + net) OVER (ORDER BY date) AS eq FROM (SELECT date, avg(lr) FILTER (bucket = {q.BUCKETS}) - avg(lr) FILTER (bucket = 1) - 0.001 AS net FROM {bucketed('(SELECT * FROM au WHERE lr IS NOT NULL)')} GROUP BY date) WHERE net IS NOT NULL)))",
        PRED + ", au AS (SELECT use.date, use.security_id, score, label, lr FROM use JOIN px USING (date, security_id))",
    ),
    "legacy_features": w("SELECT date, security_id, " + ", ".join(r(c, c) for c in LG) + " FROM lg", LEGACY),
    "legacy_zscores": w(
        "SELECT date, security_id, " + ", ".join(r(f"greatest(-3, least(3, {c}))", c) for c in LG) + " FROM (SELECT date, security_id, " + ", ".join(f"({c} - avg({c}) OVER d) / (stddev_samp({c}) OVER d + 1e-8) AS {c}" for c in LG) + " FROM lg WINDOW d AS (PARTITION BY date)) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LG), LEGACY
    ),
    "vol_factor_quintile": w(f"SELECT date, {r('avg(log_ret) FILTER (vol <= lo) - avg(log_ret) FILTER (vol > hi)', 'factor')} FROM lg JOIN (SELECT date, quantile_cont(vol, 0.2::DOUBLE) AS lo, quantile_cont(vol, 0.8::DOUBLE) AS hi FROM lg WHERE vol IS NOT NULL GROUP BY date) USING (date) GROUP BY date", LEGACY),
    "regime_flags": w(
        f"SELECT date, {r('v', 'market_vol')}, CASE WHEN coalesce(v > (SELECT median(v) FROM lg JOIN md USING (date)), false) THEN 'High_Vol' ELSE 'Low_Vol' END AS regime FROM md",
        LEGACY + ", md AS (SELECT date, CASE WHEN count(m) OVER w = 12 THEN median(m) OVER w END AS v FROM (SELECT date, median(vol) AS m FROM lg WHERE vol IS NOT NULL GROUP BY date) WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))",
    ),
    "densify_ffill": w(
        f"SELECT date, security_id, {r('close', 'close')}, {r('volume', 'volume')} FROM (SELECT cal.date, s.security_id, last_value(p.close IGNORE NULLS) OVER w AS close, last_value(p.volume IGNORE NULLS) OVER w AS volume FROM cal CROSS JOIN (SELECT DISTINCT security_id FROM panel) s LEFT JOIN panel p ON p.date = cal.date AND p.security_id = s.security_id WINDOW w AS (PARTITION BY s.security_id ORDER BY cal.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE close IS NOT NULL"
    ),
    "strict_intersection": w(
        f"SELECT date, security_id, {r('close', 'close')} FROM panel SEMI JOIN best USING (security_id) SEMI JOIN (SELECT date FROM panel SEMI JOIN best USING (security_id) GROUP BY date HAVING count(*) = (SELECT count(*) FROM best)) USING (date)",
        ", cnt AS (SELECT security_id, count(*) AS n FROM panel GROUP BY 1), best AS (SELECT security_id FROM cnt WHERE n = (SELECT max(n) FROM cnt))",
    ),
    "dictionary_ids": "SELECT ticker, dense_rank() OVER (ORDER BY ticker) - 1 AS stock_id FROM (SELECT DISTINCT ticker FROM residualizer WHERE ticker IS NOT NULL)",
    "neutral_scores": w(
        f"SELECT date, security_id, {r('score - regr_intercept(score, loading) OVER d - regr_slope(score, loading) OVER d * loading', 'score')}, {r('label', 'label')} FROM pred JOIN (SELECT security_id, avg(lr) AS loading FROM px GROUP BY 1) USING (security_id) WHERE score IS NOT NULL AND loading IS NOT NULL WINDOW d AS (PARTITION BY date)", PRED
    ),
    "rolling_ols_residual": w(
        f"SELECT date, security_id, {r('v', 'residual')} FROM (SELECT date, security_id, product(1 + x) OVER h - 1 - (regr_intercept(x, f) OVER b + regr_slope(x, f) OVER b * (product(1 + f) OVER h - 1)) AS v, count(*) OVER b AS nb, count(*) OVER h AS nh FROM rf WINDOW b AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE nb = 26 AND nh = 5",
        ", rf AS (SELECT date, security_id, lr AS x, f FROM px JOIN (SELECT date, avg(lr) AS f FROM px GROUP BY date) USING (date) WHERE lr IS NOT NULL)",
    ),
    "quantile_deciles": w("SELECT date, security_id, 1 + " + " + ".join(f"(score > c{i})::BIGINT" for i in range(1, q.BUCKETS)) + " AS bucket FROM use JOIN (SELECT date, " + ", ".join(f"quantile_cont(score, {i / q.BUCKETS}::DOUBLE) AS c{i}" for i in range(1, q.BUCKETS)) + " FROM use GROUP BY date) USING (date)", PRED),
    "ic_rolling": w(f"SELECT date, {r('CASE WHEN count(*) OVER w = 20 THEN avg(ic) OVER w END', 'mean')}, {r('sum(ic) OVER (ORDER BY date)', 'running')} FROM {ic()} WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", PRED),
    "bucket_columns": w("SELECT date, " + ", ".join(r(f"avg(label) FILTER (bucket = {i})", f"b{i}") for i in range(1, q.BUCKETS + 1)) + f" FROM {bucketed()} GROUP BY date", PRED),
    "kendall_monotonicity": w(
        f"SELECT {r('sum(sign(a.bucket - b.bucket) * sign(a.l - b.l)) / sqrt(sum(abs(sign(a.bucket - b.bucket))) * sum(abs(sign(a.l - b.l))))', 'value')} FROM bp a JOIN bp b ON a.bucket < b.bucket", PRED + f", bp AS (SELECT bucket, avg(m) AS l FROM (SELECT date, bucket, avg(label) AS m FROM {bucketed()} GROUP BY date, bucket) GROUP BY bucket)"
    ),
    "decision_days": w(f"SELECT DISTINCT date, day_idx FROM slots WHERE day_idx >= {L}", universe() + SLOTS, True),
    "labelled_days": w("SELECT date, count(label) AS n FROM slots JOIN lab USING (date, security_id) WHERE NOT is_pad GROUP BY date HAVING count(label) >= 20", universe() + SLOTS + label(5, 0), True),
    "scored_returns": w(f"SELECT date, security_id, {r('lr', 'log_ret')} FROM px SEMI JOIN pred USING (security_id) WHERE date >= (SELECT min(date) FROM pred)", PRED),
    "regime_attribution": w(
        "SELECT regime, feature, round(avg(a), 6) + 0.0 AS attribution FROM (" + " UNION ALL ".join(f"SELECT regime, '{c}' AS feature, abs({k} * ({c} - avg({c}) OVER ())) AS a FROM zr" for c, k in (("log_ret", 0.5), ("vol", -0.2), ("dsma_short", -0.3))) + ") GROUP BY regime, feature",
        LEGACY
        + ", md AS (SELECT date, CASE WHEN count(m) OVER w = 12 THEN median(m) OVER w END AS v FROM (SELECT date, median(vol) AS m FROM lg WHERE vol IS NOT NULL GROUP BY date) WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), lz AS (SELECT date, security_id, "
        + ", ".join(f"greatest(-3, least(3, {c})) AS {c}" for c in LG[:3])
        + " FROM (SELECT date, security_id, "
        + ", ".join(f"({c} - avg({c}) OVER d) / (stddev_samp({c}) OVER d + 1e-8) AS {c}" for c in LG[:3])
        + " FROM lg WINDOW d AS (PARTITION BY date)) WHERE log_ret IS NOT NULL AND vol IS NOT NULL AND dsma_short IS NOT NULL), zr AS (SELECT lz.*, CASE WHEN coalesce(v > (SELECT median(v) FROM lg JOIN md USING (date)), false) THEN 'High_Vol' ELSE 'Low_Vol' END AS regime FROM lz JOIN md USING (date))",
    ),
    "series_alignment": w(f"SELECT date, {r('ic', 'ic')}, {r('spread', 'spread')} FROM {ic()} FULL JOIN {spread()} USING (date)", PRED),
}
SQL["turnover_annual"] = "SELECT round(avg(turnover) * 50.4, 6) + 0.0 AS value FROM (" + SQL["bt_turnover"].replace("round(sum(abs(d)) / 2, 6) + 0.0", "sum(abs(d)) / 2") + ")"
SQL["xf_zscore_population"] = w(long(zscored(ddof=0)), WINDOW, True)
SQL["window_tensor"] = w(
    "SELECT date, slot::BIGINT AS slot, lag::BIGINT AS lag, feature::BIGINT AS feature, v FROM (" + " UNION ALL ".join(f"SELECT date, slot, lag, {i} AS feature, round((CASE WHEN real THEN coalesce({n}, 0) ELSE 0 END)::FLOAT::DOUBLE, 4) + 0.0 AS v FROM win" for i, n in enumerate(q.NAMES)) + ")", WINDOW, True
)
SQL["split_burn_in"] = w(
    f"SELECT 'fold_' || k AS fold, segment, CASE segment WHEN 'test' THEN greatest(test - {L - 1}, 0) ELSE 0 END AS lo, CASE segment WHEN 'train' THEN greatest(test - {q.SPLIT['purge'] + q.SPLIT['embargo']}, 0) WHEN 'val' THEN 0 ELSE CASE WHEN k = {q.SPLIT['n_folds']} THEN n ELSE test + size END END AS hi "
    f"FROM (SELECT k, n, n // {q.SPLIT['n_folds'] + 1} AS size, n - ({q.SPLIT['n_folds'] + 1} - k) * (n // {q.SPLIT['n_folds'] + 1}) AS test FROM (SELECT count(*) AS n FROM cal), (SELECT unnest(range(1, {q.SPLIT['n_folds'] + 1})) AS k)), (VALUES ('train'), ('val'), ('test')) x(segment)"
)
# the integral of the density from 0 to the statistic by Simpson's rule
SQL["deflated_probability"] = (
    "WITH t AS (" + SQL["deflated_sharpe"].replace(repr(luck(5, 0.3)), repr(luck(3, 0.01))).replace("round((sr", "((sr").replace("/ 4 * sr * sr), 6) + 0.0 AS stat", "/ 4 * sr * sr)) AS stat") + "), g AS (SELECT stat, i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c, stat * i / 2000 AS x FROM t, (SELECT unnest(range(2001)) AS i))"
    " SELECT round(any_value(stat), 6) + 0.0 AS stat, round(0.5 + sum(c * exp(-x * x / 2)) * any_value(stat) / 6000 / sqrt(2 * pi()), 6) + 0.0 AS probability FROM g"
)
SQL["model_test_rows"] = w("SELECT date, slot::BIGINT AS slot, security_id, fold FROM mtest", MODEL_TEST, True)
SQL["ranker_invariance"] = "SELECT * FROM (VALUES ('pads', 0.0::DOUBLE), ('slots', 0.0::DOUBLE)) t(change, largest_difference)"
_CENTRED = {"ff": "var_pop(f) OVER b", "gg": "var_pop(g) OVER b", "fg": "covar_pop(f, g) OVER b", "xf": "covar_pop(x, f) OVER b", "xg": "covar_pop(x, g) OVER b"}
SQL["rolling_ols_two_factors"] = w(
    f"SELECT date, security_id, {r('hx - (mx + (xf * gg - xg * fg) / (ff * gg - fg * fg) * (hf - mf) + (xg * ff - xf * fg) / (ff * gg - fg * fg) * (hg - mg))', 'residual')} FROM (SELECT date, security_id, "
    + ", ".join(f"{v} AS {k}" for k, v in _CENTRED.items())
    + ", "
    + ", ".join(f"avg({c}) OVER b AS m{c}, product(1 + {c}) OVER h - 1 AS h{c}" for c in "xfg")
    + ", count(*) OVER b AS nb, count(*) OVER h AS nh FROM rg WINDOW b AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE nb = 26 AND nh = 5",
    LEGACY
    + ", vf AS (SELECT date, avg(log_ret) FILTER (vol <= lo) - avg(log_ret) FILTER (vol > hi) AS g FROM lg JOIN (SELECT date, quantile_cont(vol, 0.2::DOUBLE) AS lo, quantile_cont(vol, 0.8::DOUBLE) AS hi FROM lg WHERE vol IS NOT NULL GROUP BY date) USING (date) GROUP BY date), "
    "rg AS (SELECT date, security_id, lr AS x, f, g FROM px JOIN (SELECT date, avg(lr) AS f FROM px GROUP BY date) USING (date) JOIN vf USING (date) WHERE lr IS NOT NULL AND g IS NOT NULL)",
)
