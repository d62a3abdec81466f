"""Pinned values of the provisioning rule, run logs on disk, sample times and trace wrap-around."""

import math

import pytest
from pyspark.sql import functions as F

from joulemill.carbon import accounting as acc, logs, provisioning as prov, report

PINNED = [  # c, L, U, B, d, K, allowed
    (300.0, 100.0, 600.0, 20, 5, 100, 23), (100.0, 100.0, 600.0, 20, 5, 100, 100), (650.0, 100.0, 600.0, 20, 5, 100, 20), (250.0, 200.0, 300.0, 2, 1, 10, 6),
    (400.0, 100.0, 600.0, 20, 80, 100, 100), (500.0, 100.0, 600.0, 2, 0, 10, 2), (260.0, 200.0, 200.0, 2, 0, 10, 2),
]


def test_allowed_executors(spark):
    df = spark.createDataFrame(PINNED, "c double, l double, u double, b int, d int, k int, want int")
    got = df.withColumn("got", prov.allowed_executors(*[F.col(x) for x in "clubdk"])).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_lambert_w(spark):
    xs = [(-1 / math.e + 1e-9,), (-0.3,), (-0.05,), (0.0,), (0.2,), (3.0,)]
    for x, w in spark.createDataFrame(xs, "x double").select("x", prov.lambert_w(F.col("x"))).collect():
        assert w * math.exp(w) == pytest.approx(x, abs=1e-12)


def test_limits_and_pods(spark):
    got = prov.resource_limits(spark.createDataFrame([(23,)], "allowed int")).first()
    assert (got["cpu"], got["memory_gi"]) == (92, 184)
    lines = [("s", "job-1-driver 1/1 Running"), ("s", "job-2-driver 0/1 Completed"), ("s", "job-3-driver 0/1 Error"), ("s", "job-1-exec-1 1/1 Running"), ("s", "job-1-exec-2 0/1 Pending")]
    r = prov.live_pods(spark.createDataFrame(lines, "snapshot string, line string")).first()
    assert (r["drivers"], r["executors"]) == (1, 1)


@pytest.fixture()
def results(tmp_path):
    text = "job_id,start_time,end_time,carbon_footprint,executors\n"
    rows = [
        (0, "2024-12-23 22:37:13.266925", "2024-12-23 22:37:41.216787", "17.25", "\"[('37:31', 'p-exec-1'), ('37:33', 'p-exec-2')]\""),
        (1, "2024-12-23 22:59:53.000000", "2024-12-23 23:00:20.500000", "19.5", "\"[('59:58', 'p-exec-1'), ('00:03', 'p-exec-1')]\""),
        (2, "2024-12-23 23:01:00.000000", "", "", "[]"),
    ]
    for model, folder, tag in (("green", "steady_25_DE", "0"), ("default", "steady_25_CAISO_prev", "3"), ("default", "closure_10", "0")):
        d = tmp_path / model / folder
        d.mkdir(parents=True)
        (d / f"times_{tag}.csv").write_text(text + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    return str(tmp_path)


def test_run_logs(spark, results):
    runs = logs.read_run_logs(spark, results)
    keys = {tuple(r) for r in runs.select("model", "job_type", "jobs", "trace", "suffix", "tag").distinct().collect()}
    assert keys == {("green", "steady", 25, "DE", "", "0"), ("default", "steady", 25, "CAISO", "prev", "3"), ("default", "closure", 10, "", "", "0")}
    done = logs.with_duration(logs.finished(runs.filter("model = 'green'"))).orderBy("job_id").collect()
    assert [r["job_id"] for r in done] == [0, 1]
    assert done[0]["duration_s"] == pytest.approx(27.949862) and done[0]["duration"].total_seconds() == pytest.approx(27.949862)


def test_sample_times(spark, results):
    runs = logs.finished(logs.read_run_logs(spark, results).filter("model = 'green'"))
    got = logs.restore_sample_time(logs.explode_samples(runs)).select("at", F.date_format("sample_time", "HH:mm:ss").alias("s"), "outside").collect()
    assert {(r["at"], r["s"], r["outside"]) for r in got} == {("37:31", "22:37:31", False), ("37:33", "22:37:33", False), ("59:58", "22:59:58", False), ("00:03", "23:00:03", False)}


def test_report(spark):
    rows = [("view", "0", 0, 0, 10, 4.0), ("view", "0", 1, 5, 30, 6.0), ("view", "0", 2, 8, 20, 10.0), ("click", "0", 0, 0, 10, 5.0), ("click", "0", 1, 2, 30, 5.0)]
    runs = spark.createDataFrame(rows, "model string, tag string, job_id int, a long, b long, carbon_footprint double").withColumns({"start_time": F.timestamp_seconds("a"), "end_time": F.timestamp_seconds("b")}).drop("a", "b")
    spans = {r["model"]: (r["end_to_end_s"], r["makespan_s"]) for r in report.end_to_end(runs).collect()}
    assert spans == {"view": (20.0, 30.0), "click": (30.0, 30.0)}  # the last submitted job need not end last
    totals = report.per_model(report.run_totals(runs), "total_carbon")
    assert {r["model"]: r["total_carbon_share"] for r in report.normalized(totals, "total_carbon").collect()} == {"view": 1.0, "click": 0.5}
    saved = report.against_baseline(totals, "total_carbon", [("click", "view")], True).first()
    assert saved["percent"] == 50.0
    many = spark.range(150).selectExpr("'view' AS model", "'0' AS tag", "int(id) AS job_id", "timestamp_seconds(id) AS start_time", "timestamp_seconds(id + 60) AS end_time", "2.0D AS carbon_footprint")
    assert report.run_totals(many).first()["total_carbon"] == 300.0 and report.end_to_end(many).first()["end_to_end_s"] == 209.0  # no job is left out


def test_trace_wraps(spark):
    events = spark.createDataFrame([(i, f"2024-01-01 {i:02d}:00:30", float(i)) for i in range(4)], "event_id long, t string, value double").withColumn("ts", F.to_timestamp("t"))
    trace = acc.hourly_trace(events)
    assert trace.size == 4
    moments = spark.createDataFrame([(0, "2024-01-01 00:00:30"), (1, "2024-01-01 00:01:30"), (2, "2024-01-01 00:03:29"), (3, "2024-01-01 00:04:31")], "event_id long, t string").withColumn("ts", F.to_timestamp("t"))
    got = {r["event_id"]: r["ci"] for r in acc.price(moments, trace, offset=2).collect()}
    assert got == {0: 2.0, 1: 3.0, 2: 0.0, 3: 2.0}


def test_attribution(spark):
    s = spark.createDataFrame([("d1", 1), ("d2", 2), ("d9", 3)], "driver string, n int")
    owned, orphans = acc.attribute(s, spark.createDataFrame([("d1", 10), ("d2", 20)], "driver string, job_id int"))
    assert {r["job_id"] for r in owned.collect()} == {10, 20} and [r["driver"] for r in orphans.collect()] == ["d9"]
