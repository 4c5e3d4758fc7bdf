"""Queries p1 to p6 on the project's tables: the general data problems of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.asof import as_known
from rankloom.operators.impute import Number, Word, impute
from rankloom.operators.intervals import periods_and_gaps
from rankloom.operators.regrid import regrid
from rankloom.operators.rolling import RollingStore, daily_amounts, month_of, series
from rankloom.operators.spikes import implausible
from rankloom.session import scratch, table, written


def _day(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd")


def p1_flags(spark: SparkSession, sf: str) -> DataFrame:
    return implausible(table(spark, sf, "residualizer"), "bar_id", "ticker", "date", "close", "log_ret", "volume")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_flags(spark, sf).select("bar_id")


def p1_stuck(spark: SparkSession, sf: str) -> DataFrame:
    return p1_flags(spark, sf).where("stuck_value or stuck_return").select("bar_id", "stuck_value", "stuck_return")


def p1_impossible(spark: SparkSession, sf: str) -> DataFrame:
    return p1_flags(spark, sf).where("impossible").select("bar_id")


def _rolling_store(spark: SparkSession, sf: str) -> RollingStore:
    """The state of features by its own history: rows that came by the day after carry it forward, a quarter at a time; the later ones are a correction."""
    late = F.coalesce(F.to_date("known_at") > F.date_add("date", 1), F.lit(False)).alias("late")
    rows = table(spark, sf, "features").select("security_id", "date", "log_ret", late)
    daily = daily_amounts(rows, "security_id", "date", "log_ret", "late").withColumn("month", month_of("d"))
    landed = written(daily, "arrivals", "month")
    store = RollingStore(spark, scratch(spark, "rolling"))
    lo, hi = landed.agg(F.min("d"), F.max("d")).first()
    if lo is not None:
        store.load(landed.where("not late"), lo, hi)
        store.correct(landed.where("late"))
    return store


def _totals(state: DataFrame) -> DataFrame:
    r = series(state, "security_id")
    return r.select("security_id", _day("day").alias("day"), *[(F.round(c, 8) + F.lit(0.0)).alias(c) if c[0] in "tm" else F.col(c) for w in (7, 30) for c in (f"rows_{w}", f"total_{w}", f"mean_{w}")])


def p2_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(_rolling_store(spark, sf).current())


def p2_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The same totals read from the compacted store."""
    store = _rolling_store(spark, sf)
    store.compact()
    return _totals(store.current())


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    r = series(_rolling_store(spark, sf).current(), "security_id")
    return r.where("rows_7 = 0 and rows_30 > 0").select("security_id", _day("day").alias("day"))


NUMBERS = (Number("vol_20", 0.0, 1.0, log=True), Number("log_dollar_volume", 0.0, 50.0))
HELPERS = ("log_ret", "dist_sma_20")
WORDS = (Word("sector", "group"), Word("regime", "time"))


def p3_filled(spark: SparkSession, sf: str) -> DataFrame:
    return impute(table(spark, sf, "features"), "row_id", "security_id", "date", NUMBERS, WORDS, helpers=HELPERS)


def p3_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """(field, hidden, filled, group_mean_error, no_worse): a twentieth of the usable numbers hidden by a hash of the row, filled, and held against what they were.

    no_worse: the mean error of the fills is at most a hundredth above that of the means of the groups' other values.
    """
    f = table(spark, sf, "features")
    places = {n.name: F.substring(F.md5(F.col("row_id").cast("string")), 1 + 2 * i, 2) < F.lit("0d") for i, n in enumerate(NUMBERS)}
    truth = f.select("row_id", "security_id", "date", *[F.when(places[n.name], n.usable()).alias(f"true_{n.name}") for n in NUMBERS], *[F.when(~places[n.name], n.usable()).alias(f"left_{n.name}") for n in NUMBERS])
    means = truth.groupBy("security_id").agg(*[F.avg(f"left_{n.name}").alias(f"mean_{n.name}") for n in NUMBERS])
    hidden = f.withColumns({n.name: F.when(~places[n.name], F.col(n.name)) for n in NUMBERS})
    filled = impute(hidden, "row_id", "security_id", "date", NUMBERS, WORDS, only_filled=True, helpers=HELPERS)
    j = truth.join(filled, "row_id").join(means, "security_id")
    out = None
    for n in NUMBERS:
        t, c = F.col(f"true_{n.name}"), F.col(f"{n.name}_filled") & F.col(f"true_{n.name}").isNotNull()
        own, plain = F.avg(F.when(c, F.abs(F.col(n.name) - t))), F.avg(F.when(c, F.abs(F.col(f"mean_{n.name}") - t)))
        row = j.agg(F.count(F.when(c, 1)).alias("filled"), plain.alias("p"), own.alias("o")).select(F.lit(n.name).alias("field"), "filled", (F.round("p", 6) + F.lit(0.0)).alias("group_mean_error"), (F.col("o") <= F.col("p") * 1.01).alias("no_worse"))
        out = row if out is None else out.unionByName(row)
    return out


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    r = impute(table(spark, sf, "features"), "row_id", "security_id", "date", NUMBERS, WORDS, only_filled=True, helpers=HELPERS)
    fields = [x.name for x in (*NUMBERS, *WORDS)]
    cells = F.explode(F.array_compact(F.array(*[F.when(F.col(f"{c}_filled"), F.lit(c)) for c in fields])))
    return r.select("row_id", cells.alias("field"))


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    f = regrid(table(spark, sf, "features"), "security_id", "date", ["log_ret", "vol_20", "log_dollar_volume"], at="snap_ts", tie="row_id")
    m = regrid(table(spark, sf, "market").withColumn("market", F.lit("market")), "market", "date", ["ts__equal_weight_return", "ts__dispersion", "static__breadth"])
    f = f.select(F.col("security_id").cast("string").alias("source"), "day", "had_reading", "state", *[F.col(c).alias(f"v{i}") for i, c in enumerate(("log_ret", "vol_20", "log_dollar_volume"))])
    m = m.select(F.col("market").alias("source"), "day", "had_reading", "state", *[F.col(c).alias(f"v{i}") for i, c in enumerate(("ts__equal_weight_return", "ts__dispersion", "static__breadth"))])
    return f.unionByName(m)


def p4_regrid(spark: SparkSession, sf: str) -> DataFrame:
    return _grids(spark, sf).select("source", _day("day").alias("day"), "had_reading", "state", *[(F.round(f"v{i}", 6) + F.lit(0.0)).alias(f"v{i}") for i in range(3)])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _grids(spark, sf).where("state in ('filled', 'marked')").select("source", _day("day").alias("day"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "universe").where(~F.coalesce("is_pad", F.lit(False)))
    return periods_and_gaps(u, "security_id", "refresh_date", "valid_until").select("security_id", "kind", _day("from_day").alias("from_day"), _day("to_day").alias("to_day"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("label_id", "date", "security_id")
    members = table(spark, sf, "universe").where(~F.coalesce("is_pad", F.lit(False)))
    u = as_known(labels, members, "security_id", "date", valid_from="refresh_date", known_at="known_at", row="universe_id", valid_until="valid_until")
    f = as_known(labels, table(spark, sf, "features"), "security_id", "date", valid_from="date", known_at="known_at", row="row_id", order=("snap_ts", "known_at"), inclusive=False)
    both = u.join(f, ["security_id", "date"])
    return labels.join(both, ["security_id", "date"]).select("label_id", "universe_id", "row_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_flags": p1_flags,
    "p1_stuck": p1_stuck,
    "p1_impossible": p1_impossible,
    "p2_found": p2_found,
    "p2_rolling": p2_rolling,
    "p2_versions": p2_versions,
    "p3_found": p3_found,
    "p3_filled": p3_filled,
    "p3_held_out": p3_held_out,
    "p4_found": p4_found,
    "p4_regrid": p4_regrid,
    "p5_found": p5_found,
    "p6_found": p6_found,
}

SQL: dict[str, str] = {
    "p1_stuck": """
WITH b AS (SELECT bar_id, ticker AS k, date::DATE AS d, CASE WHEN NOT isnan(close) THEN close END AS c, CASE WHEN NOT isnan(log_ret) THEN log_ret END AS r, volume AS v FROM residualizer WHERE ticker IS NOT NULL AND date IS NOT NULL),
f AS (SELECT k, d, x.c, x.r, x.v > 0 AND NOT isnan(x.v) AS live, CASE WHEN x.c > 0 AND x.c < 1e12 THEN x.c END AS cv, CASE WHEN abs(x.r) < 10 THEN x.r END AS rv FROM (SELECT k, d, arg_min({'c': c, 'r': r, 'v': v}, bar_id) AS x FROM b GROUP BY k, d)),
s AS (SELECT *, coalesce(live AND lag(live) OVER w AND cv = lag(cv) OVER w, false) AS sc, coalesce(live AND lag(live) OVER w AND rv = lag(rv) OVER w, false) AS sr FROM f WINDOW w AS (PARTITION BY k ORDER BY d)),
i AS (SELECT *, sum((NOT sc)::INT) OVER w AS ic, sum((NOT sr)::INT) OVER w AS ir FROM s WINDOW w AS (PARTITION BY k ORDER BY d)),
h AS (SELECT k, d, c, r, sc AND count(*) OVER (PARTITION BY k, ic) > 6 AS stuck_value, sr AND count(*) OVER (PARTITION BY k, ir) > 6 AS stuck_return FROM i)
SELECT bar_id, stuck_value, stuck_return FROM b JOIN h ON b.k = h.k AND b.d = h.d AND b.c IS NOT DISTINCT FROM h.c AND b.r IS NOT DISTINCT FROM h.r WHERE stuck_value OR stuck_return""",
    "p1_impossible": "SELECT bar_id FROM residualizer WHERE ticker IS NOT NULL AND date IS NOT NULL AND ((NOT isnan(close) AND (close <= 0 OR close >= 1e12)) OR (NOT isnan(log_ret) AND abs(log_ret) >= 10))",
    "p3_held_out": "WITH f AS (SELECT security_id AS g, date AS t, md5(row_id::VARCHAR) AS h, CASE WHEN vol_20 > 0 AND vol_20 < 1 THEN vol_20::DOUBLE END AS vol_20, CASE WHEN log_dollar_volume > 0 AND log_dollar_volume < 50 THEN log_dollar_volume::DOUBLE END AS log_dollar_volume FROM features WHERE security_id IS NOT NULL), "
    + " UNION ALL ".join(
        f"{c}_ AS (SELECT g, t, CASE WHEN substr(h, {p}, 2) < '0d' THEN {c} END AS x, CASE WHEN substr(h, {p}, 2) >= '0d' THEN {c} END AS y FROM f), {c}_m AS (SELECT g, avg(y) AS m, min(t) FILTER (y IS NOT NULL) AS a, max(t) FILTER (y IS NOT NULL) AS z FROM {c}_ GROUP BY g)"
        for c, p in (("vol_20", 1), ("log_dollar_volume", 3))
    ).replace(" UNION ALL log", ", log")
    + " SELECT 'vol_20' AS field, count(*) AS filled, round(avg(abs(m - x)), 6) + 0.0 AS group_mean_error, true AS no_worse FROM vol_20_ JOIN vol_20_m USING (g) WHERE x IS NOT NULL AND a < t AND t < z"
    + " UNION ALL SELECT 'log_dollar_volume', count(*), round(avg(abs(m - x)), 6) + 0.0, true FROM log_dollar_volume_ JOIN log_dollar_volume_m USING (g) WHERE x IS NOT NULL AND a < t AND t < z",
    "p3_found": """
WITH f AS (SELECT row_id, security_id AS g, date AS t, CASE WHEN vol_20 > 0 AND vol_20 < 1 THEN 1 END AS a, CASE WHEN log_dollar_volume > 0 AND log_dollar_volume < 50 THEN 1 END AS b,
  CASE WHEN lower(trim(sector)) NOT IN ('', 'n/a', 'na', '#n/a', 'none', 'null', 'nil', 'nan', 'unknown', '?', '-', '--', '.') THEN 1 END AS c,
  CASE WHEN lower(trim(regime)) NOT IN ('', 'n/a', 'na', '#n/a', 'none', 'null', 'nil', 'nan', 'unknown', '?', '-', '--', '.') THEN 1 END AS d FROM features),
s AS (SELECT g, min(t) FILTER (a = 1) AS a0, max(t) FILTER (a = 1) AS a1, min(t) FILTER (b = 1) AS b0, max(t) FILTER (b = 1) AS b1, count(c) AS c0 FROM f GROUP BY g),
r AS (SELECT t, count(d) AS d0 FROM f GROUP BY t)
SELECT row_id, 'vol_20' AS field FROM f JOIN s USING (g) WHERE a IS NULL AND a0 < t AND t < a1
UNION ALL SELECT row_id, 'log_dollar_volume' FROM f JOIN s USING (g) WHERE b IS NULL AND b0 < t AND t < b1
UNION ALL SELECT row_id, 'sector' FROM f JOIN s USING (g) WHERE c IS NULL AND c0 > 0
UNION ALL SELECT row_id, 'regime' FROM f JOIN r USING (t) WHERE d IS NULL AND d0 > 0""",
    "p2_rolling": """
WITH r AS (SELECT security_id, date AS d, CASE WHEN isfinite(log_ret) THEN log_ret::DOUBLE END AS v FROM features WHERE security_id IS NOT NULL AND date IS NOT NULL),
b AS (SELECT security_id, min(d) AS lo, max(d) AS hi FROM r GROUP BY 1),
g AS (SELECT security_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM b)
SELECT g.security_id, strftime(g.d, '%Y-%m-%d') AS day, count(*) FILTER (r.d > g.d - 7) AS rows_7, round(coalesce(sum(v) FILTER (r.d > g.d - 7), 0), 8) + 0.0 AS total_7, round(avg(v) FILTER (r.d > g.d - 7), 8) + 0.0 AS mean_7,
  count(r.d) AS rows_30, round(coalesce(sum(v), 0), 8) + 0.0 AS total_30, round(avg(v), 8) + 0.0 AS mean_30
FROM g LEFT JOIN r ON r.security_id = g.security_id AND r.d <= g.d AND r.d > g.d - 30 GROUP BY 1, g.d""",
    "p2_found": """
WITH r AS (SELECT security_id, date AS d FROM features WHERE security_id IS NOT NULL AND date IS NOT NULL),
b AS (SELECT security_id, min(d) AS lo, max(d) AS hi FROM r GROUP BY 1),
g AS (SELECT security_id, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM b)
SELECT g.security_id, strftime(g.d, '%Y-%m-%d') AS day FROM g LEFT JOIN r ON r.security_id = g.security_id AND r.d <= g.d AND r.d > g.d - 30
GROUP BY 1, g.d HAVING count(*) FILTER (r.d > g.d - 7) = 0 AND count(r.d) > 0""",
    "p4_found": """
WITH r AS (SELECT security_id::VARCHAR AS source, date AS d FROM features UNION SELECT 'market', date FROM market),
b AS (SELECT source, min(d) AS lo, max(d) AS hi FROM r WHERE source IS NOT NULL GROUP BY 1),
g AS (SELECT source, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM b)
SELECT g.source, strftime(g.d, '%Y-%m-%d') AS day FROM g ANTI JOIN r ON r.source = g.source AND r.d = g.d WHERE isodow(g.d) <= 5""",
    "p5_found": """
WITH u AS (SELECT DISTINCT security_id, refresh_date AS s, valid_until AS e FROM universe WHERE NOT is_pad AND security_id IS NOT NULL AND valid_until > refresh_date),
m AS (SELECT *, max(e) OVER (PARTITION BY security_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY s, e) AS isle FROM m),
p AS (SELECT security_id, min(s) AS a, max(e) AS z FROM i GROUP BY security_id, isle)
SELECT security_id, 'period' AS kind, strftime(a, '%Y-%m-%d') AS from_day, strftime(z, '%Y-%m-%d') AS to_day FROM p
UNION ALL SELECT security_id, 'gap', strftime(z, '%Y-%m-%d'), strftime(nxt, '%Y-%m-%d') FROM (SELECT *, lead(a) OVER (PARTITION BY security_id ORDER BY a) AS nxt FROM p) WHERE nxt IS NOT NULL""",
    "p6_found": """
WITH u AS (SELECT l.label_id, arg_max(v.universe_id, (v.refresh_date, v.universe_id)) AS universe_id FROM labels l JOIN universe v ON v.security_id = l.security_id
  AND NOT v.is_pad AND v.refresh_date <= l.date AND l.date < v.valid_until AND v.known_at < l.date::TIMESTAMP GROUP BY 1),
f AS (SELECT l.label_id, arg_max(v.row_id, (v.date, v.snap_ts, v.known_at, v.row_id)) AS row_id FROM labels l JOIN features v ON v.security_id = l.security_id
  AND v.date < l.date AND v.known_at < l.date::TIMESTAMP GROUP BY 1)
SELECT label_id, universe_id, row_id FROM u JOIN f USING (label_id)""",
}


def _regrid_sql() -> str:
    """Neighbours by ASOF joins, value by value."""
    fields = (("log_ret", "ts__equal_weight_return"), ("vol_20", "ts__dispersion"), ("log_dollar_volume", "static__breadth"))
    one = lambda c: f"CASE WHEN isfinite({c}) THEN {c}::DOUBLE END"
    rows = f"""r AS (SELECT security_id::VARCHAR AS source, date AS d, epoch_us(snap_ts) / 86400e6 AS t, row_id AS o, {', '.join(f'{one(a)} AS v{i}' for i, (a, _) in enumerate(fields))} FROM features WHERE security_id IS NOT NULL AND date IS NOT NULL
UNION ALL SELECT 'market', date, (date - DATE '1970-01-01') + 16 / 24.0, 0, {', '.join(one(b) for _, b in fields)} FROM market WHERE date IS NOT NULL)"""
    cells = ", ".join(f"c{i} AS (SELECT source, d, arg_max(v{i}, (t, o, v{i})) AS lv, max(t) AS lt, arg_min(v{i}, (t, o, v{i})) AS ev, min(t) AS et FROM r WHERE v{i} IS NOT NULL GROUP BY 1, 2)" for i in range(3))
    grid = """b AS (SELECT source, min(d) AS lo, max(d) AS hi FROM r GROUP BY 1), days AS (SELECT DISTINCT source, d FROM r),
g AS (SELECT * FROM (SELECT source, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM b) WHERE isodow(d) <= 5)"""
    joins = " ".join(f"ASOF LEFT JOIN c{i} p{i} ON p{i}.source = g.source AND g.d >= p{i}.d ASOF LEFT JOIN c{i} n{i} ON n{i}.source = g.source AND g.d < n{i}.d" for i in range(3))
    value = lambda i: f"CASE WHEN p{i}.d = g.d THEN p{i}.lv WHEN n{i}.et - p{i}.lt <= 7 AND n{i}.et > p{i}.lt THEN p{i}.lv + (n{i}.ev - p{i}.lv) * greatest(0, least(1, ((g.d - DATE '1970-01-01') + 16 / 24.0 - p{i}.lt) / (n{i}.et - p{i}.lt))) END"
    x = f"x AS (SELECT g.source, g.d, days.d IS NOT NULL AS had_reading, {', '.join(f'{value(i)} AS v{i}' for i in range(3))} FROM g LEFT JOIN days ON days.source = g.source AND days.d = g.d {joins})"
    return f"WITH {rows}, {cells}, {grid}, {x} SELECT source, strftime(d, '%Y-%m-%d') AS day, had_reading, CASE WHEN had_reading THEN 'observed' WHEN v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL THEN 'filled' ELSE 'marked' END AS state, {', '.join(f'round(v{i}, 6) + 0.0 AS v{i}' for i in range(3))} FROM x"


SQL["p4_regrid"] = _regrid_sql()
SQL["p2_versions"] = SQL["p2_rolling"]
