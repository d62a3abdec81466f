"""Carbon queries over the events table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from joulemill.carbon import accounting as acc, logs, provisioning as prov, report
from joulemill.operators.exact import rounded
from joulemill.operators.ordered import framed, percentiles, running
from joulemill.registry import query
from joulemill.storage import cut, gathered, scratch

BASE = """
WITH hours AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS ci FROM events GROUP BY 1),
trace AS (SELECT hour, ci, row_number() OVER (ORDER BY hour) - 1 AS idx, count(*) OVER () AS n FROM hours),
samples AS (SELECT user_id AS job_id, event_type AS model, strftime(date_trunc('week', ts), '%Y-%m-%d') AS tag,
  ts, event_id, event_id % 4 AS pod FROM events),
origin AS (SELECT min(ts) AS t0 FROM events),
priced AS (SELECT s.*, t.idx, t.ci FROM samples s CROSS JOIN origin
  JOIN trace t ON t.idx = (5 + CAST(floor((epoch_us(s.ts) - epoch_us(t0)) / 60000000) AS BIGINT)) % t.n),
job_runs AS (SELECT model, tag, job_id, min(ts) AS start_time, CASE WHEN count(*) > 1 THEN max(ts) END AS end_time,
  sum(ci) / 60 AS carbon_footprint, count(*) AS samples FROM priced GROUP BY ALL),
done AS (SELECT * FROM job_runs WHERE end_time IS NOT NULL),
totals AS (SELECT model, tag, sum(carbon_footprint) AS total_carbon FROM done GROUP BY ALL),
spans AS (SELECT model, tag,
  (epoch_us(max_by(end_time, job_id)) - epoch_us(min_by(start_time, job_id))) / 1e6 AS end_to_end_s,
  (epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1e6 AS makespan_s FROM done GROUP BY ALL)
"""
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STAMP_SQL = "%Y-%m-%d %H:%M:%S.%f"


@query("co_01_read_run_logs", "CO-01", BASE + f"""
SELECT model, tag, job_id, strftime(start_time, '{STAMP_SQL}') AS start_time,
  coalesce(strftime(end_time, '{STAMP_SQL}'), 'open') AS end_time, round(carbon_footprint, 6) AS carbon FROM job_runs""")
def read_run_logs(t):
    """Write the runs as CSV logs in run folders, then read them back with keys from the path."""
    runs = acc.runs_of(t.events)
    root = scratch(t.spark, "results")
    for_disk = runs.select(
        "job_id", "start_time", "end_time", "carbon_footprint", F.lit("[]").alias("executors"), "model", "tag"
    )
    gathered(for_disk, "model", "tag").write.partitionBy("model", "tag").option("header", True).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(root)
    read = t.spark.read.schema(logs.RUN_LOG).option("header", True).csv(f"{root}/*/*/*.csv")
    path = F.col("_metadata.file_path")
    return read.select(
        F.regexp_extract(path, "model=([^/]+)", 1).alias("model"),
        F.regexp_extract(path, "tag=([^/]+)", 1).alias("tag"),
        F.col("job_id").cast("long").alias("job_id"),
        F.date_format("start_time", STAMP).alias("start_time"),
        F.coalesce(F.date_format("end_time", STAMP), F.lit("open")).alias("end_time"),
        F.round("carbon_footprint", 6).alias("carbon"),
    )


@query("co_02_finished_jobs", "CO-02", BASE + "SELECT model, tag, job_id, samples FROM done")
def finished_jobs(t):
    return logs.finished(acc.runs_of(t.events)).select("model", "tag", "job_id", "samples")


@query("co_03_first_jobs", "CO-03", BASE + """SELECT model, tag, job_id FROM done
QUALIFY row_number() OVER (PARTITION BY model, tag ORDER BY job_id) <= 25""")
def first_jobs(t):
    return logs.first_jobs(logs.finished(acc.runs_of(t.events)), 25).select("model", "tag", "job_id")


@query("co_04_job_duration", "CO-04", BASE + """
SELECT model, tag, job_id, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 6) AS duration_s FROM done""")
def job_duration(t):
    runs = logs.with_duration(logs.finished(acc.runs_of(t.events)))
    return runs.select("model", "tag", "job_id", F.round("duration_s", 6).alias("duration_s"))


@query("co_05_run_total_carbon", "CO-05", BASE + "SELECT model, tag, round(total_carbon::DECIMAL(38,9), 4)::DOUBLE AS total_carbon FROM totals")
def run_total_carbon(t):
    return report.run_totals(acc.runs_of(t.events)).withColumn("total_carbon", rounded("total_carbon", 4))


@query("co_06_mean_total_carbon", "CO-06", BASE + "SELECT model, round(avg(total_carbon)::DECIMAL(38,9), 4)::DOUBLE AS total_carbon FROM totals GROUP BY 1")
def mean_total_carbon(t):
    out = report.per_model(report.run_totals(acc.runs_of(t.events)), "total_carbon")
    return out.withColumn("total_carbon", rounded("total_carbon", 4))


@query("co_07_end_to_end", "CO-07", BASE + """
SELECT model, tag, round(end_to_end_s, 4) AS end_to_end_s, round(makespan_s, 4) AS makespan_s FROM spans""")
def end_to_end(t):
    out = report.end_to_end(acc.runs_of(t.events))
    return out.select("model", "tag", F.round("end_to_end_s", 4).alias("end_to_end_s"), F.round("makespan_s", 4).alias("makespan_s"))


@query("co_08_mean_end_to_end", "CO-08", BASE + "SELECT model, round(avg(end_to_end_s)::DECIMAL(38,9), 3)::DOUBLE AS end_to_end_s FROM spans GROUP BY 1")
def mean_end_to_end(t):
    out = report.per_model(report.end_to_end(acc.runs_of(t.events)), "end_to_end_s")
    return out.withColumn("end_to_end_s", rounded("end_to_end_s", 3))


@query("co_09_normalized_carbon", "CO-09", BASE + """
, m AS (SELECT model, avg(total_carbon) AS c FROM totals GROUP BY 1)
SELECT model, round(c / max(c) OVER (), 6) AS share FROM m""")
def normalized_carbon(t):
    models = report.per_model(report.run_totals(acc.runs_of(t.events)), "total_carbon")
    return report.normalized(models, "total_carbon").select("model", F.round("total_carbon_share", 6).alias("share"))


@query("co_10_against_baseline", "CO-10", BASE + """
, c AS (SELECT model, avg(total_carbon) AS x FROM totals GROUP BY 1),
e AS (SELECT model, avg(end_to_end_s) AS x FROM spans GROUP BY 1)
SELECT 'carbon' AS metric, p.m AS model, p.b AS baseline, round((b.x - a.x) / b.x * 100, 4) AS percent
FROM (VALUES ('click','view'), ('purchase','view'), ('purchase','signup')) p(m, b)
JOIN c a ON a.model = p.m JOIN c b ON b.model = p.b
UNION ALL SELECT 'time', p.m, p.b, round((a.x - b.x) / b.x * 100, 4)
FROM (VALUES ('click','view'), ('purchase','signup')) p(m, b)
JOIN e a ON a.model = p.m JOIN e b ON b.model = p.b""")
def against_baseline(t):
    runs = cut(acc.runs_of(t.events), "runs")
    carbon = report.per_model(report.run_totals(runs), "total_carbon")
    spans = report.per_model(report.end_to_end(runs), "end_to_end_s")
    saved = report.against_baseline(carbon, "total_carbon", report.CARBON_PAIRS, True).withColumn("metric", F.lit("carbon"))
    slower = report.against_baseline(spans, "end_to_end_s", report.TIME_PAIRS, False).withColumn("metric", F.lit("time"))
    return saved.unionByName(slower).select("metric", "model", "baseline", F.round("percent", 4).alias("percent"))


@query("co_11_job_means", "CO-11", BASE + """
, r AS (SELECT model, tag, avg(carbon_footprint) AS c, avg((epoch_us(end_time) - epoch_us(start_time)) / 1e6) AS s
  FROM done GROUP BY ALL)
SELECT model, round(avg(c)::DECIMAL(38,9), 5)::DOUBLE AS job_carbon, round(avg(s)::DECIMAL(38,9), 3)::DOUBLE AS job_seconds FROM r GROUP BY 1""")
def job_means(t):
    out = report.job_means(acc.runs_of(t.events))
    return out.select("model", rounded("job_carbon", 5).alias("job_carbon"), rounded("job_seconds", 3).alias("job_seconds"))


@query("co_12_write_cleaned", "CO-12", BASE + """
SELECT model, tag, job_id, round(carbon_footprint, 6) AS carbon_footprint,
  round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 6) AS duration_s FROM done""")
def write_cleaned(t):
    clean = logs.with_duration(logs.finished(acc.runs_of(t.events))).select(
        "model", "tag", "job_id", "start_time", "carbon_footprint", "duration_s"
    )
    path = scratch(t.spark, "cleaned")
    gathered(clean, "model", "tag").write.partitionBy("model", "tag").option("header", True).csv(path)
    back = t.spark.read.option("header", True).schema(
        "job_id long, start_time timestamp, carbon_footprint double, duration_s double, model string, tag string"
    ).csv(path)
    return back.select("model", "tag", "job_id", F.round("carbon_footprint", 6).alias("carbon_footprint"),
                       F.round("duration_s", 6).alias("duration_s"))


@query("co_13_selected_runs", "CO-13", BASE + """
SELECT model, round(avg(total_carbon)::DECIMAL(38,9), 4)::DOUBLE AS total_carbon, round(avg(end_to_end_s)::DECIMAL(38,9), 3)::DOUBLE AS end_to_end_s
FROM totals JOIN spans USING (model, tag) WHERE tag IN ('2024-01-08', '2024-01-15', '2024-01-22') GROUP BY 1""")
def selected_runs(t):
    """The older report looks at three of the runs only; models keep their own names."""
    tags = ["2024-01-08", "2024-01-15", "2024-01-22"]
    runs = acc.runs_of(t.events).filter(F.col("tag").isin(tags))
    carbon = report.per_model(report.run_totals(runs), "total_carbon", tags)
    spans = report.per_model(report.end_to_end(runs), "end_to_end_s", tags)
    return carbon.join(spans, "model").select("model", rounded("total_carbon", 4).alias("total_carbon"), rounded("end_to_end_s", 3).alias("end_to_end_s"))


@query("co_14_intensity_at", "CO-14", BASE + "SELECT event_id, idx, round(ci, 6) AS ci FROM priced")
def intensity_at(t):
    priced = acc.price(acc.samples(t.events), acc.hourly_trace(t.events))
    return priced.select("event_id", "idx", F.round("ci", 6).alias("ci"))


@query("co_15_attribute_samples", "CO-15", """
WITH drivers AS (SELECT DISTINCT 'drv-' || user_id AS driver, user_id AS job_id FROM events WHERE event_type = 'signup'),
s AS (SELECT 'drv-' || user_id AS driver FROM events)
SELECT driver, CAST(job_id AS BIGINT) AS job_id, 'matched' AS state, count(*) AS n FROM s JOIN drivers USING (driver) GROUP BY ALL
UNION ALL SELECT driver, -1, 'unmatched', count(*) FROM s WHERE driver NOT IN (SELECT driver FROM drivers) GROUP BY ALL""")
def attribute_samples(t):
    driver = F.concat(F.lit("drv-"), F.col("user_id"))
    drivers = t.events.filter("event_type = 'signup'").select(driver.alias("driver"), F.col("user_id").alias("job_id")).distinct()
    owned, orphans = acc.attribute(t.events.select(driver.alias("driver")), drivers)
    return owned.groupBy("driver", "job_id").agg(F.lit("matched").alias("state"), F.count("*").alias("n")).unionByName(
        orphans.groupBy("driver").agg(F.lit(-1).cast("long").alias("job_id"), F.lit("unmatched").alias("state"), F.count("*").alias("n")))


@query("co_16_carbon_per_job", "CO-16", BASE + """
SELECT job_id, count(*) AS samples, round(sum(ci) / 60, 6) AS carbon FROM priced GROUP BY 1""")
def carbon_per_job(t):
    priced = acc.price(acc.samples(t.events), acc.hourly_trace(t.events))
    return priced.groupBy("job_id").agg(F.count("*").alias("samples"), F.round(F.sum("ci") / 60, 6).alias("carbon"))


@query("co_17_measured_jobs", "CO-17", BASE + """
, coded AS (SELECT *, CASE WHEN model = 'error' AND samples > 3 THEN 1 ELSE 0 END AS return_code FROM job_runs)
SELECT model, tag, job_id, round(carbon_footprint, 6) AS carbon FROM coded WHERE return_code = 0 AND carbon_footprint >= 1""")
def measured_jobs(t):
    coded = acc.runs_of(t.events).withColumn(
        "return_code", F.when((F.col("model") == "error") & (F.col("samples") > 3), 1).otherwise(0))
    return acc.keep_measured(coded).select("model", "tag", "job_id", F.round("carbon_footprint", 6).alias("carbon"))


def _log_cells(t):
    """Log rows with an executors text of two samples each, spread over up to 84 minutes after the start."""
    lag = F.make_dt_interval(secs=F.pmod("event_id", F.lit(5040)))
    e = t.events.withColumn("later", F.col("ts") + lag)
    pod = F.concat(F.lit("exec-"), F.pmod("event_id", F.lit(4)))
    return e.select(
        F.col("event_id").alias("job_id"), F.col("user_id"), F.col("ts").alias("start_time"),
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end_time"),
        F.format_string("[('%s', '%s'), ('%s', '%s')]", F.date_format("ts", "mm:ss"), pod,
                        F.date_format("later", "mm:ss"), F.concat(pod, F.lit("b"))).alias("executors"),
    )


@query("co_18_parse_executors", "CO-18", """
SELECT event_id AS job_id, strftime(ts, '%M:%S') AS at, 'exec-' || (event_id % 4) AS pod FROM events
UNION ALL SELECT event_id, strftime(ts + to_seconds(event_id % 5040), '%M:%S'), 'exec-' || (event_id % 4) || 'b' FROM events""")
def parse_executors(t):
    return logs.explode_samples(_log_cells(t)).select("job_id", "at", "pod")


@query("co_19_restore_sample_time", "CO-19", """
WITH s AS (SELECT event_id AS job_id, ts, 'exec-' || (event_id % 4) AS pod, ts AS moment FROM events
  UNION ALL SELECT event_id, ts, 'exec-' || (event_id % 4) || 'b', ts + to_seconds(event_id % 5040) FROM events),
b AS (SELECT *, date_trunc('hour', ts) + to_minutes(CAST(minute(moment) AS BIGINT)) + to_seconds(CAST(second(moment) AS BIGINT)) AS x FROM s),
r AS (SELECT *, CASE WHEN x < date_trunc('second', ts) THEN x + INTERVAL 1 HOUR ELSE x END AS y FROM b)
SELECT job_id, pod, strftime(y, '%Y-%m-%d %H:%M:%S') AS sample_time,
  CASE WHEN y > date_trunc('second', ts + INTERVAL 30 MINUTE) THEN 1 ELSE 0 END AS outside FROM r""")
def restore_sample_time(t):
    parsed = logs.restore_sample_time(logs.explode_samples(_log_cells(t)))
    return parsed.select("job_id", "pod", F.date_format("sample_time", "yyyy-MM-dd HH:mm:ss").alias("sample_time"),
                         F.col("outside").cast("int").alias("outside"))


@query("co_20_executor_concurrency", "CO-20", """
WITH m AS (SELECT user_id AS job_id, date_trunc('hour', ts) AS slot, count(DISTINCT event_id % 4) AS pods FROM events GROUP BY ALL),
r AS (SELECT job_id, slot, pods, max(pods) OVER (PARTITION BY job_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS peak_so_far FROM m)
SELECT job_id, strftime(slot, '%Y-%m-%d %H:%M') AS slot, pods, peak_so_far, max(pods) OVER (PARTITION BY job_id) AS peak FROM r""")
def executor_concurrency(t):
    per_slot = acc.samples(t.events).groupBy("job_id", F.date_trunc("hour", "ts").alias("slot")).agg(
        F.count_distinct("pod").alias("pods"))
    per_slot = cut(per_slot, "slots")
    peaks = per_slot.groupBy("job_id").agg(F.max("pods").alias("peak"))
    so_far = running(per_slot, ["job_id"], [F.col("slot")], {"peak_so_far": ("max", F.col("pods"))})
    return so_far.join(peaks, "job_id").select(
        "job_id", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "pods", "peak_so_far", "peak")


BOUNDS = BASE + """
, drv AS (SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS d FROM events GROUP BY 1),
b AS (SELECT hour, idx, ci, min(ci) OVER w AS lower_bound, max(ci) OVER w AS upper_bound FROM trace
  WINDOW w AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING)),
lim AS (SELECT 1 + max(d) // 4 AS least, 3 * max(d) + 10 AS most FROM drv),
x AS (SELECT b.*, d, least, most, most - least - d AS k, (lower_bound * 1.1 / upper_bound - 1) / exp(1) AS z FROM b JOIN drv USING (hour) CROSS JOIN lim),
w AS (SELECT *, list_reduce(list_prepend(CASE WHEN z < 0 THEN sqrt(greatest((z * exp(1) + 1) * 2, 0)) - 1 ELSE z / (z + 1) END,
    CAST(range(1, 31) AS DOUBLE[])), lambda w, i: CASE WHEN abs(w * exp(w) - z) < 1e-15 THEN w ELSE
    w - (w * exp(w) - z) / (exp(w) * (w + 1) - (w + 2) * (w * exp(w) - z) / (2 * w + 2)) END) AS lw FROM x),
al AS (SELECT *, 1 / (1 + lw) AS alpha FROM w),
dec AS (SELECT *, CASE WHEN k <= 0 OR upper_bound <= 0 THEN most ELSE coalesce(least + list_filter(range(0, CAST(greatest(k, 1) AS BIGINT)),
    lambda i: upper_bound * (1 - (1 - 1 / alpha) * pow(1 + 1 / (alpha * k), i)) < ci)[1], most) END AS allowed FROM al)
"""


@query("co_21_allowed_executors", "CO-21", BOUNDS + """
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, d AS drivers, round(alpha, 6) AS alpha, CAST(allowed AS BIGINT) AS allowed FROM dec""")
def allowed_executors(t):
    dec = _decisions(t)
    low = F.col("lower_bound") * prov.LOWER_MARGIN / F.col("upper_bound")
    alpha = F.lit(1.0) / (F.lit(1.0) + prov.lambert_w((low - 1) / math.e))
    return dec.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "drivers", F.round(alpha, 6).alias("alpha"), "allowed")


def _decisions(t):
    """Floor and cap follow the busiest hour, so that thresholds are searched at any size of the input."""
    events = t.events
    drivers = cut(events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_distinct("user_id").cast("int").alias("drivers")), "drivers")
    peak = F.max("drivers")
    limits = drivers.agg((1 + F.floor(peak / 4)).cast("int").alias("least"), (3 * peak + 10).cast("int").alias("most"))  # one row
    bounds = prov.forecast_bounds(acc.hourly_trace(events).rows)
    return bounds.join(drivers, "hour").crossJoin(F.broadcast(limits)).withColumn("allowed", prov.allowed_executors(
        F.col("ci"), F.col("lower_bound"), F.col("upper_bound"), F.col("least"), F.col("drivers"), F.col("most")))


@query("co_22_resource_limits", "CO-22", """
SELECT event_type, n, n * 4 AS cpu, n * 8 AS memory_gi FROM (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1)""")
def resource_limits(t):
    return prov.resource_limits(t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n")), "n")


@query("co_23_live_pods", "CO-23", """
SELECT strftime(ts, '%Y-%m-%d') AS snapshot, count(*) FILTER (event_id % 3 = 0 AND event_type NOT IN ('error', 'signup')) AS drivers,
 count(*) FILTER (event_id % 3 <> 0 AND event_type NOT IN ('error', 'signup')) AS executors FROM events GROUP BY 1""")
def live_pods(t):
    state = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "signup", "Completed").otherwise("Running")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("job-"), "user_id", F.lit("-driver"))).otherwise(
        F.concat(F.lit("job-"), "user_id", F.lit("-exec-"), F.col("event_id") % 4))
    listing = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot"),
                              F.format_string("%s   1/1   %s   0   5m", name, state).alias("line"))
    return prov.live_pods(listing)


@query("co_24_forecast_bounds", "CO-24", BASE + """
SELECT idx, round(min(ci) OVER w, 6) AS lower_bound, round(max(ci) OVER w, 6) AS upper_bound FROM trace
WINDOW w AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING)""")
def forecast_bounds(t):
    out = prov.forecast_bounds(acc.hourly_trace(t.events).rows)
    return out.select("idx", F.round("lower_bound", 6).alias("lower_bound"), F.round("upper_bound", 6).alias("upper_bound"))


@query("co_25_replay_provisioning", "CO-25", BOUNDS + """
SELECT idx, CAST(allowed AS BIGINT) AS allowed, CAST(allowed * 4 AS BIGINT) AS cpu, CAST(allowed * 8 AS BIGINT) AS memory_gi FROM dec""")
def replay_provisioning(t):
    return prov.resource_limits(_decisions(t)).select("idx", "allowed", "cpu", "memory_gi")


@query("co_26_interarrival", "CO-26", BASE + """
, g AS (SELECT model, tag, (epoch_us(start_time) - epoch_us(lag(start_time) OVER (PARTITION BY model, tag ORDER BY start_time, job_id))) / 60e6 AS gap
  FROM job_runs)
SELECT model, count(gap) AS gaps, round(avg(gap), 4) AS mean_gap_min, round(1 / avg(gap), 6) AS rate_per_min,
  round(quantile_cont(gap, 0.5), 4) AS median_gap_min, round(ln(2) / quantile_cont(gap, 0.5), 6) AS rate_from_median FROM g GROUP BY 1""")
def interarrival(t):
    """Gaps between job starts; the rate by mean and, as an exponential fit, by the median."""
    runs = cut(acc.runs_of(t.events), "runs")
    gaps = framed(runs, ["model", "tag"], [F.col("start_time"), F.col("job_id")], 1, 0,
                  {"prev": lambda _, w: F.lag("start_time").over(w)})
    gaps = cut(gaps.select("model", (logs.seconds(F.col("start_time"), F.col("prev")) / 60).alias("gap")), "gaps")
    medians = percentiles(gaps, ["model"], "gap", {"median_gap": 0.5})
    means = gaps.groupBy("model").agg(F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"))
    return means.join(medians, "model").select(
        "model", "gaps", F.round("mean_gap", 4).alias("mean_gap_min"), F.round(1 / F.col("mean_gap"), 6).alias("rate_per_min"),
        F.round("median_gap", 4).alias("median_gap_min"), F.round(F.log(F.lit(2.0)) / F.col("median_gap"), 6).alias("rate_from_median"))


@query("co_28_run_index", "CO-28", BASE + """
SELECT model, tag, count(*) AS submitted, count(end_time) AS finished FROM job_runs GROUP BY ALL""")
def run_index(t):
    return acc.runs_of(t.events).groupBy("model", "tag").agg(F.count("*").alias("submitted"), F.count("end_time").alias("finished"))
