"""Queries on price series, sessions and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.bindings import BARS, FILINGS, REF, SESSIONS, bars, filings, ref, sessions
from tidewater.operators import linkage, periods, prices
from tidewater.sources.files import table
from tidewater.spec import LIMITS


def _b(spark, folder):
    return bars(spark, folder).select("security", "day", "low", "high", F.round("close", 8).alias("close"), "quantity", F.round("value", 2).alias("value"))


#: the same in SQL
_BARS = BARS.replace("sum(l_extendedprice) AS value, sum(l_extendedprice) / sum(l_quantity) AS close", "round(sum(l_extendedprice), 2) AS value, round(sum(l_extendedprice) / sum(l_quantity), 8) AS close")


def daily_bars(spark, folder):
    return _b(spark, folder).select("security", "day", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "quantity", "value", "close")


def sessions_after_lateness(spark, folder):
    s = sessions(spark, folder)
    f = filings(spark, folder).select("order_id", "line", "security", "value", "day_from", "day_to")
    placed = prices.sessions_upto(prices.sessions_upto(f, s, "day_from", "n_from"), s, "day_to", "n_to")
    lag = F.when(F.col("day_to") >= F.col("day_from"), F.col("n_to") - F.col("n_from"))
    return placed.groupBy(lag.alias("sessions")).agg(F.count("*").alias("n"), F.count_if(lag > 2).alias("late"))


def implied_factors(spark, folder):
    out = prices.implied_factors(_b(spark, folder), "security", "day", "close", 0.30, 0.05)
    return out.groupBy("security", "kind").agg(F.count("*").alias("n"), F.max("gap_days").alias("longest_gap"))


def _factors(spark, folder):
    b = _b(spark, folder)
    large = prices.implied_factors(b, "security", "day", "close", 0.30, 0.05).where("kind = 'large'")
    return b, large.select("security", "day", "factor")


def adjusted_close(spark, folder):
    b, factors = _factors(spark, folder)
    return prices.adjusted_close(b, factors, "security", "day", "close", ref()).select("security", "day", F.round("cum_factor", 5).alias("cum_factor"), F.round(F.log("adjusted"), 6).alias("log_adjusted"))


def price_jumps(spark, folder):
    o = table(spark, folder, "lineitem").where("l_linestatus = 'F' and l_quantity >= 49").select(F.col("l_partkey").alias("security"), F.col("l_shipdate").cast("date").alias("day")).distinct()
    return prices.price_jumps(_b(spark, folder), "security", "day", "close", o, 0.40, 30).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("factor"), 3).alias("sum_factor"))


def high_52w_distance_all(spark, folder):
    """The default window: 250 bars, null before 120."""
    out = prices.rolling_high(_b(spark, folder), "security", "day", "close")
    return out.select("security", "day", F.round("high_close", 4).alias("high_close"), F.round("from_high_pct", 4).alias("from_high_pct"))


def _returns_all(spark, folder):
    """Every filing of both sides at its own security's prices, over the default horizons."""
    events = filings(spark, folder).select("order_id", "line", "security", "person", F.col("day_to").alias("day"), F.concat_ws(":", "side", (F.col("person") % 5).cast("string")).alias("signal"))
    return prices.forward_returns(events, _b(spark, folder), sessions(spark, folder), "security", "day", "close")


def forward_returns_all(spark, folder):
    return _returns_all(spark, folder).select("order_id", "line", "security", "day", "entry", *[F.round(f"r_{n}", 4).alias(f"r_{n}") for n in LIMITS.horizons])


def track_summary_all(spark, folder):
    out = prices.return_summary(_returns_all(spark, folder), "signal")
    return out.select("signal", "horizon", "cases", *[F.round(c, 3).alias(c) for c in ("mean", "median", "up_share", "half_width")])


def evidence_verdict_all(spark, folder):
    return prices.verdict(prices.return_summary(_returns_all(spark, folder), "signal")).select("signal", "horizon", "verdict")


def _events_numbered_all(spark, folder):
    return prices.sessions_upto(filings(spark, folder).select("person", F.col("day_to").alias("day")).distinct(), sessions(spark, folder), "day", "number")


def spacing_21_sessions_all(spark, folder):
    return prices.spaced(_events_numbered_all(spark, folder), ["person"], "number")


def basket_positions_all(spark, folder):
    kept = prices.spaced(_events_numbered_all(spark, folder), ["person"], "number", LIMITS.hold + 1)
    return kept.select("person", (F.col("number") + 1).alias("entry_no"), (F.col("number") + 1 + LIMITS.hold).alias("exit_no"))


def average_daily_value(spark, folder):
    return prices.average_daily_value(_b(spark, folder), "security", "day", "value").select("security", F.round("adv", 6).alias("adv"), "days")


def interval_day_range(spark, folder):
    # told apart by plain columns, so that rows stay where the join by order put them
    f = filings(spark, folder, finer=True).select("order_id", "line", "security", "person", "value", "day_from", "day_to").distinct()
    f = f.select(F.struct("order_id", "line", "security", "person", "value").alias("row_id"), "security", "day_from", "day_to")
    out = linkage.span_stats(f, _b(spark, folder), "security", "row_id", "day_from", "day_to", "day", "low", "high")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("sessions").alias("sessions"), F.round(F.sum("low"), 1).alias("low"))


def price_check_ladder(spark, folder):
    b = _b(spark, folder).select(F.col("security").alias("sec"), F.col("day").alias("d"), "low", "high")
    f = filings(spark, folder).join(b, (F.col("security") == F.col("sec")) & (F.col("day_from") == F.col("d")), "left")
    status = prices.price_ladder(F.col("value") / F.col("quantity"), F.col("low"), F.col("high"), F.col("value"))
    return f.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def holding_check(spark, folder):
    f = filings(spark, folder)
    state = prices.holding_state(F.col("tax") * 1000, F.col("discount") * 1000, F.col("quantity"), F.when(F.col("status") == "F", F.col("side")))
    return f.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def price_summary(spark, folder):
    b = _b(spark, folder)
    last = periods.latest_dates(b, "security", "day", 1).select("security", F.col("day").alias("last_day"), "close")
    span = b.groupBy("security").agg(F.max("close").alias("hi"), F.min("close").alias("lo"), F.count("*").alias("bars"))
    ranked = last.join(span, "security").join(table(spark, folder, "part").select(F.col("p_partkey").alias("security"), "p_retailprice"), "security")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.year("last_day")).orderBy(F.desc("p_retailprice"), "security"))
    return ranked.withColumn("place", place).select("security", "last_day", "close", "hi", "lo", "bars", F.when(F.col("place") <= 20, "large").when(F.col("place") <= 100, "mid").otherwise("small").alias("bucket"))


QUERIES = {f.__name__: f for f in (daily_bars, sessions_after_lateness, implied_factors, adjusted_close, price_jumps, high_52w_distance_all, forward_returns_all, track_summary_all, evidence_verdict_all, spacing_21_sessions_all, basket_positions_all, average_daily_value, interval_day_range, price_check_ladder, holding_check, price_summary)}

_FACTORS = f"""{_BARS}, p AS (SELECT *, lag(close) OVER w AS prev_close, day - lag(day) OVER w AS gap_days FROM b WINDOW w AS (PARTITION BY security ORDER BY day)),
    k AS (SELECT *, CASE WHEN prev_close > 0 THEN close / prev_close END AS factor FROM p)"""
_RETURNS_ALL = f"""{FILINGS}, {_BARS}, {SESSIONS}, m AS (SELECT security, close, session_no AS no FROM b JOIN s ON s.day = b.day),
    e AS (SELECT order_id, line, security, f.day_to AS day, side || ':' || (person % 5) AS signal, session_no + 1 AS entry_no FROM f JOIN s ON s.day = f.day_to),
    r AS (SELECT e.*, m0.close AS entry, {", ".join(f"(m{n}.close / m0.close - 1) * 100 - 0.25::DOUBLE AS r_{n}" for n in LIMITS.horizons)} FROM e
        LEFT JOIN m m0 ON m0.security = e.security AND m0.no = entry_no {" ".join(f"LEFT JOIN m m{n} ON m{n}.security = e.security AND m{n}.no = entry_no + {n}" for n in LIMITS.horizons)})"""
_SUMMARY_ALL = _RETURNS_ALL + f""", l AS ({" UNION ALL ".join(f"SELECT signal, {n} AS horizon, r_{n} AS r FROM r WHERE r_{n} IS NOT NULL" for n in LIMITS.horizons)}),
    g AS (SELECT signal, horizon, count(*) AS cases, avg(r) AS mean, median(r) AS median, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS up_share, 1.645 * stddev_samp(r) / sqrt(count(*)) AS half_width FROM l GROUP BY 1, 2)"""
_SPACED_ALL = f"""{FILINGS}, {SESSIONS}, e AS (SELECT DISTINCT person, session_no AS number FROM f JOIN s ON s.day = day_to),
    x AS MATERIALIZED (SELECT person, number, min(number) OVER (PARTITION BY person ORDER BY number RANGE BETWEEN {{0}} FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM e),
    k AS (SELECT person, min(number) AS number FROM e GROUP BY 1 UNION ALL SELECT k.person, x.following FROM k JOIN x ON x.person = k.person AND x.number = k.number WHERE x.following IS NOT NULL)"""
_IN = "{0} BETWEEN low * 0.98::DOUBLE AND high * 1.02::DOUBLE"
_POWER = " OR ".join(_IN.format(f"p * 1e{k}") + " OR " + _IN.format(f"p / 1e{k}") for k in (2, 3, 5, 6, 7))

ORACLE_SQL = {
    "daily_bars": f"WITH {_BARS} SELECT security, day, round(low, 9) AS low, round(high, 9) AS high, quantity, value, close FROM b",
    "sessions_after_lateness": f"""WITH {FILINGS}, {SESSIONS}, dd AS (SELECT DISTINCT day_from AS day FROM f), a AS (SELECT dd.day, count(s.day) AS n FROM dd LEFT JOIN s ON s.day <= dd.day GROUP BY 1),
        x AS (SELECT CASE WHEN day_to >= day_from THEN t.session_no - a.n END AS sessions FROM f JOIN a ON a.day = day_from JOIN s t ON t.day = day_to) SELECT sessions, count(*) AS n, count(*) FILTER (sessions > 2) AS late FROM x GROUP BY 1""",
    "implied_factors": f"WITH {_FACTORS} SELECT security, CASE WHEN factor IS NULL THEN 'unknown' WHEN abs(factor - 1) > 0.30 THEN 'large' WHEN abs(factor - 1) > 0.05 THEN 'minor' ELSE 'none' END AS kind, count(*) AS n, max(gap_days)::INT AS longest_gap FROM k GROUP BY 1, 2",
    "adjusted_close": f"""WITH {_FACTORS}, x AS (SELECT security, day, close, CASE WHEN abs(factor - 1) > 0.30 AND factor > 0 AND day <= DATE '{REF}' THEN ln(factor) END AS g FROM k),
        y AS (SELECT *, exp(coalesce(sum(g) OVER (PARTITION BY security ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS cum FROM x) SELECT security, day, round(cum, 5) AS cum_factor, round(ln(close * cum), 6) AS log_adjusted FROM y""",
    "price_jumps": f"""WITH {_FACTORS}, a AS (SELECT DISTINCT l_partkey AS security, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linestatus = 'F' AND l_quantity >= 49),
        x AS (SELECT *, EXISTS (SELECT 1 FROM a WHERE a.security = k.security AND a.day <= k.day AND a.day > k.day - CAST(k.gap_days AS INTEGER)) AS filed FROM k WHERE abs(factor - 1) >= 0.40)
        SELECT CASE WHEN filed THEN 'action_filed' WHEN gap_days > 30 THEN 'after_gap' ELSE 'unexplained' END AS status, count(*) AS n, round(sum(factor), 3) AS sum_factor FROM x GROUP BY 1""",
    "high_52w_distance_all": f"""WITH {_BARS}, x AS (SELECT *, CASE WHEN count(*) OVER w >= 120 THEN max(close) OVER w END AS h FROM b WINDOW w AS (PARTITION BY security ORDER BY day ROWS BETWEEN 249 PRECEDING AND CURRENT ROW))
        SELECT security, day, round(h, 4) AS high_close, round((close / h - 1) * 100, 4) AS from_high_pct FROM x""",
    "forward_returns_all": f"WITH {_RETURNS_ALL} SELECT order_id, line, security, day, entry, {', '.join(f'round(r_{n}, 4) AS r_{n}' for n in LIMITS.horizons)} FROM r",
    "track_summary_all": f"WITH {_SUMMARY_ALL} SELECT signal, horizon, cases, round(mean, 3) AS mean, round(median, 3) AS median, round(up_share, 3) AS up_share, round(half_width, 3) AS half_width FROM g",
    "evidence_verdict_all": f"WITH {_SUMMARY_ALL} SELECT signal, horizon, CASE WHEN cases < 30 THEN 'few' WHEN mean - half_width > 0 THEN 'positive' WHEN mean + half_width < 0 THEN 'drag' ELSE 'no_edge' END AS verdict FROM g",
    "spacing_21_sessions_all": f"WITH RECURSIVE {_SPACED_ALL.format(21)} SELECT person, number FROM k",
    "basket_positions_all": f"WITH RECURSIVE {_SPACED_ALL.format(64)} SELECT person, number + 1 AS entry_no, number + 64 AS exit_no FROM k",
    "average_daily_value": f"WITH {_BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY security ORDER BY day DESC) AS n FROM b) SELECT security, round(avg(value), 6) AS adv, count(*) AS days FROM r WHERE n <= 20 GROUP BY 1",
    "interval_day_range": f"""WITH {FILINGS}, {_BARS}, g AS (SELECT DISTINCT order_id, line, security, person, value, day_from, day_to FROM f),
        j AS (SELECT order_id, line, g.security, person, g.value, day_from, day_to, min(low) AS low, count(b.day) AS n FROM g LEFT JOIN b ON b.security = g.security AND b.day BETWEEN day_from AND day_to AND day_to - day_from BETWEEN 0 AND 31 GROUP BY 1, 2, 3, 4, 5, 6, 7)
        SELECT CASE WHEN day_to < day_from THEN 'dates_out_of_order' WHEN day_to - day_from > 31 THEN 'span_too_long' WHEN n = 0 THEN 'no_session' ELSE 'ok' END AS status, count(*) AS n, sum(n)::BIGINT AS sessions, round(sum(low), 1) AS low FROM j GROUP BY 1""",
    "price_check_ladder": f"""WITH {FILINGS}, {_BARS}, x AS (SELECT f.value / f.quantity AS p, f.value, low, high FROM f LEFT JOIN b ON b.security = f.security AND b.day = day_from)
        SELECT CASE WHEN p IS NULL OR low IS NULL OR p <= 0 THEN 'no_price' WHEN {_IN.format('p')} THEN 'inside' WHEN {_POWER} THEN 'power_of_ten' WHEN {_IN.format('(1 / p)')} THEN 'swapped' WHEN {_IN.format('value')} THEN 'value_is_price'
        WHEN p IN (1, 2, 5, 10) AND p < low * 0.98::DOUBLE * 0.8::DOUBLE THEN 'face_value' WHEN p < low * 0.98::DOUBLE * 0.8::DOUBLE THEN 'far_below' WHEN p > high * 1.02::DOUBLE * 1.2::DOUBLE THEN 'far_above' WHEN p < low * 0.98::DOUBLE THEN 'below' ELSE 'above' END AS status, count(*) AS n FROM x GROUP BY 1""",
    "holding_check": f"""WITH {FILINGS}, x AS (SELECT discount * 1000 - tax * 1000 AS d, quantity AS q, CASE WHEN status = 'F' THEN side END AS side FROM f), y AS (SELECT *, abs(abs(d) - q) <= greatest(q * 0.01::DOUBLE, 1.0) AS ok, d * CASE WHEN side = 'SELL' THEN -1 ELSE 1 END < 0 AS against FROM x)
        SELECT CASE WHEN side IS NULL THEN 'not_applicable' WHEN d IS NULL OR q <= 0 THEN 'not_filed' WHEN ok AND NOT against THEN 'match' WHEN ok THEN 'against_side' WHEN against THEN 'against_side_and_differs' ELSE 'differs' END AS state, count(*) AS n FROM y GROUP BY 1""",
    "price_summary": f"""WITH {_BARS}, g AS (SELECT security, max(day) AS last_day, arg_max(close, day) AS close, max(close) AS hi, min(close) AS lo, count(*) AS bars FROM b GROUP BY 1),
        r AS (SELECT g.*, row_number() OVER (PARTITION BY year(last_day) ORDER BY p_retailprice DESC, security) AS place FROM g JOIN part ON p_partkey = security)
        SELECT security, last_day, close, hi, lo, bars, CASE WHEN place <= 20 THEN 'large' WHEN place <= 100 THEN 'mid' ELSE 'small' END AS bucket FROM r""",
}
