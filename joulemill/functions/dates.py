"""Date and time functions, and time windows in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.registry import query

DATE, STAMP = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def d(c, name):
    return F.date_format(c, DATE).alias(name)


def s(c, name):
    return F.date_format(c, STAMP).alias(name)


@query("dt_1_current", "DT-1", "SELECT o_orderpriority, count(*) AS n, true AS consistent FROM orders GROUP BY 1")
def current(t):
    """Fixed once per query: all spellings agree and lie after every order."""
    same = (F.curdate() == F.current_date()) & (F.now() == F.current_timestamp()) & (F.to_date(F.current_timestamp()) == F.current_date()) & (
        F.current_timezone() == "UTC") & (F.localtimestamp() > F.col("o_orderdate"))
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.bool_and(same).alias("consistent"))


@query("dt_2_fields", "DT-2", """
SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, dayofweek(ts) + 1 AS dow, day(ts) AS dom, dayofyear(ts) AS doy, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, week(ts) AS w, (dayofweek(ts) + 6) % 7 AS wd, true AS same FROM events""")
def fields(t):
    ts = F.col("ts")
    same = (F.dayofmonth(ts) == F.day(ts)) & (F.extract(F.lit("YEAR"), ts) == F.year(ts)) & (F.date_part(F.lit("MONTH"), ts) == F.month(ts)) & (F.datepart(F.lit("DAY"), ts) == F.day(ts))
    return t.events.select("event_id", F.year(ts).alias("y"), F.quarter(ts).alias("q"), F.month(ts).alias("m"), F.dayofweek(ts).alias("dow"), F.dayofmonth(ts).alias("dom"), F.dayofyear(ts).alias("doy"),
                           F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.second(ts).alias("s"), F.weekofyear(ts).alias("w"), F.weekday(ts).alias("wd"), same.alias("same"))


@query("dt_3_arithmetic", "DT-3", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS s, o_orderdate::DATE AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(s + 10, '%Y-%m-%d') AS plus, strftime(s - 10, '%Y-%m-%d') AS minus, (s - o) AS diff, strftime(s + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month,
 round(CASE WHEN day(s) = day(o) OR (s = last_day(s) AND o = last_day(o)) THEN (year(s) - year(o)) * 12 + month(s) - month(o) ELSE (year(s) - year(o)) * 12 + month(s) - month(o) + (day(s) - day(o)) / 31.0 END, 6) AS months,
 strftime(s + CASE WHEN dayofweek(s) = 1 THEN 7 ELSE (8 - dayofweek(s)) % 7 END::INTEGER, '%Y-%m-%d') AS monday, strftime(last_day(s), '%Y-%m-%d') AS month_end, strftime(date_trunc('month', s), '%Y-%m-%d') AS month_start, strftime(date_trunc('quarter', s), '%Y-%m-%d') AS quarter_start FROM x""")
def arithmetic(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("s", F.to_date("l_shipdate")).withColumn("o", F.to_date("o_orderdate"))
    same = (F.date_add("s", 10) == F.dateadd("s", F.lit(10))) & (F.datediff("s", "o") == F.date_diff("s", "o"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", d(F.when(same, F.date_add("s", 10)), "plus"), d(F.date_sub("s", 10), "minus"), F.datediff("s", "o").alias("diff"), d(F.add_months("s", 1), "next_month"),
                    F.round(F.months_between("s", "o"), 6).alias("months"), d(F.next_day("s", "Mon"), "monday"), d(F.last_day("s"), "month_end"), d(F.trunc("s", "month"), "month_start"), d(F.date_trunc("quarter", "l_shipdate"), "quarter_start"))


@query("dt_4_construct", "DT-4", """
SELECT o_orderkey, strftime(make_date(year(o_orderdate), month(o_orderdate), 15), '%Y-%m-%d') AS mid, strftime(make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6.0), '%Y-%m-%d %H:%M:%S') AS stamp,
 strftime(o_orderdate + INTERVAL 1 DAY + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS dt, strftime(o_orderdate + INTERVAL 14 MONTH, '%Y-%m-%d %H:%M:%S') AS ym, strftime(o_orderdate + INTERVAL 1 MONTH + INTERVAL 14 DAY, '%Y-%m-%d %H:%M:%S') AS mixed, true AS same FROM orders""")
def construct(t):
    o, y = F.col("o_orderdate"), F.year("o_orderdate")
    parts = [y, F.lit(2), F.lit(3), F.lit(4), F.lit(5), F.lit(6.0).cast("decimal(8,6)")]
    same = (F.make_timestamp_ltz(*parts) == F.make_timestamp(*parts)) & (F.make_timestamp_ntz(*parts).cast("timestamp") == F.make_timestamp(*parts))
    return t.orders.select("o_orderkey", d(F.make_date(y, F.month(o), F.lit(15)), "mid"), s(F.make_timestamp(*parts), "stamp"), s(o + F.make_dt_interval(F.lit(1), F.lit(2)), "dt"),
                           s(o + F.make_ym_interval(F.lit(1), F.lit(2)), "ym"), s(o + F.make_interval(F.lit(0), F.lit(1), F.lit(2)), "mixed"), same.alias("same"))


@query("dt_5_parse_format", "DT-5", """
SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS shown, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS back, epoch(date_trunc('second', ts))::BIGINT AS unix, event_type AS bad_kept, true AS same FROM events""")
def parse_format(t):
    ts = F.col("ts")
    text = F.date_format(ts, STAMP)
    back = F.to_timestamp(text, STAMP)
    same = (F.to_timestamp_ltz(text, F.lit(STAMP)) == back) & (F.to_timestamp_ntz(text, F.lit(STAMP)).cast("timestamp") == back) & (F.unix_timestamp(text, STAMP) == F.to_unix_timestamp(text, F.lit(STAMP)))
    bad = F.try_to_timestamp(F.col("event_type"), F.lit(STAMP))
    return t.events.select("event_id", F.date_format(ts, "dd/MM/yyyy HH:mm").alias("shown"), d(F.to_date(text, STAMP), "day"), s(F.to_timestamp(F.from_unixtime(F.unix_timestamp(text, STAMP), STAMP), STAMP), "back"),
                           F.unix_timestamp(text, STAMP).alias("unix"), F.when(bad.isNull(), F.col("event_type")).alias("bad_kept"), same.alias("same"))


@query("dt_6_epoch", "DT-6", """
SELECT event_id, strftime(ts::DATE, '%Y-%m-%d') AS day, (ts::DATE - DATE '1970-01-01') AS days, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, epoch(date_trunc('second', ts))::BIGINT AS s, true AS same FROM events""")
def epoch(t):
    ts = F.col("ts")
    days = F.unix_date(F.to_date(ts))
    same = (F.timestamp_micros(F.unix_micros(ts)) == ts) & (F.unix_millis(F.timestamp_millis(F.unix_millis(ts))) == F.unix_millis(ts)) & (F.timestamp_seconds(F.unix_seconds(ts)) == F.date_trunc("second", ts))
    return t.events.select("event_id", d(F.date_from_unix_date(days), "day"), days.alias("days"), F.unix_micros(ts).alias("us"), F.unix_millis(ts).alias("ms"), F.unix_seconds(ts).alias("s"), same.alias("same"))


@query("dt_7_zones", "DT-7", """
SELECT event_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS la, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS berlin FROM events""")
def zones(t):
    """January: no daylight saving in either zone, so the shifts are whole hours."""
    ts = F.col("ts")
    return t.events.select("event_id", s(F.from_utc_timestamp(ts, "America/Los_Angeles"), "la"), s(F.to_utc_timestamp(ts, "America/Los_Angeles"), "utc"),
                           s(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), ts.cast("timestamp_ntz")), "berlin"))


@query("dt_8_tumbling_window", "DT-8", """
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND, '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY ALL""")
def tumbling(t):
    w = t.events.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return w.select(s(F.col("window.start"), "start"), "event_type", "n", s(F.window_time("window"), "at"))


@query("dt_8_sliding_window", "DT-8", """
WITH b AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS b, value FROM events)
SELECT strftime(b - to_hours(2 * i), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM b, range(0, 3) r(i) GROUP BY ALL""")
def sliding(t):
    w = t.events.groupBy(F.window("ts", "6 hours", "2 hours")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(s(F.col("window.start"), "start"), "n", F.round("total", 4).alias("total"))


@query("dt_8_session_window", "DT-8", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM i GROUP BY user_id, sid""")
def session(t):
    """Sessions are merged inside each map partition first, so a hot user ships sessions, not events."""
    t.spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    w = t.events.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", s(F.col("session_window.start"), "start"), s(F.col("session_window.end"), "stop"), "n")
