"""Sources and sinks: every format is written from a given table, read back and compared with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.registry import query
from joulemill.storage import bucket_number, gathered, scratch, write_bucketed


def new_name(prefix: str, path: str) -> str:
    return f"{prefix}_{path.rsplit('-', 1)[1]}"


@query("src_01_load", "SRC-01 SRC-12", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def load(t):
    """Generic sink and source, with a glob and the recursive option over nested folders."""
    root = scratch(t.spark, "nested")
    t.part.filter("p_size <= 25").write.save(f"{root}/a/low", format="parquet")
    t.part.filter("p_size > 25").write.save(f"{root}/b/high", format="parquet")
    df = t.spark.read.load(root, format="parquet", schema=t.part.schema, recursiveFileLookup=True, pathGlobFilter="*.parquet", modifiedAfter="2000-01-01T00:00:00")
    return df.groupBy("p_type").agg(F.count("*").alias("n"))


@query("src_02_parquet", "SRC-02 SRC-16", "SELECT n_nationkey, n_name, coalesce(CASE WHEN n_nationkey > 11 THEN n_regionkey END, -1) AS n_regionkey FROM nation")
def parquet(t):
    """Two Parquet folders of different schema, merged on read."""
    root = scratch(t.spark, "merge")
    t.nation.filter("n_nationkey <= 11").drop("n_regionkey").write.parquet(f"{root}/v=1", compression="snappy")
    t.nation.filter("n_nationkey > 11").write.parquet(f"{root}/v=2")
    return t.spark.read.option("mergeSchema", True).parquet(root).select("n_nationkey", "n_name", F.coalesce("n_regionkey", F.lit(-1)).alias("n_regionkey"))


def round_trip(t, fmt, **options):
    path = scratch(t.spark, fmt)
    t.customer.write.options(**options).format(fmt).mode("errorifexists").save(path)
    return t.spark.read.schema(t.customer.schema).options(**options).format(fmt).load(path)


@query("src_03_orc", "SRC-03 SRC-19", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 5")
def orc(t):
    return round_trip(t, "orc", compression="zlib").filter("c_nationkey = 5").select("c_custkey", "c_name", "c_acctbal")


@query("src_04_json", "SRC-04 SRC-15 SRC-28", "SELECT c_custkey, c_name, c_acctbal, 1 AS good FROM customer UNION ALL SELECT -1, 'bad', -1, 0")
def json(t):
    """JSON lines with one broken record, kept apart by the permissive mode."""
    path = scratch(t.spark, "json")
    t.customer.write.json(path, compression="gzip")
    line = t.spark.range(1).select(F.lit("{broken").alias("value"))
    line.write.mode("append").text(path)
    df = t.spark.read.json(path, schema="c_custkey long, c_name string, c_acctbal double, _bad string", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return df.select(F.coalesce("c_custkey", F.lit(-1).cast("long")).alias("c_custkey"), F.coalesce("c_name", F.lit("bad")).alias("c_name"), F.coalesce("c_acctbal", F.lit(-1.0)).alias("c_acctbal"), F.col("_bad").isNull().cast("int").alias("good"))


@query("src_28_to_json", "SRC-28", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def to_json(t):
    return t.nation.select("n_nationkey", F.to_json(F.struct("*")).alias("line"))


@query("src_05_csv", "SRC-05 SRC-18", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv(t):
    return round_trip(t, "csv", header=True, sep="|", quote='"')


@query("src_05_csv_inferred", "SRC-05", "SELECT 'int,string,double' AS kinds, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier")
def csv_inferred(t):
    path = scratch(t.spark, "csv")
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.csv(path, header=True)
    df = t.spark.read.csv(path, header=True, inferSchema=True)
    kinds = ",".join(k for _, k in df.dtypes)
    return df.agg(F.lit(kinds).alias("kinds"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("src_08_save_modes", "SRC-08", "SELECT 'append' AS mode, count(*) * 2 AS n FROM region UNION ALL SELECT 'overwrite', count(*) FROM region UNION ALL SELECT 'ignore', count(*) FROM region UNION ALL SELECT 'error', 1 FROM region WHERE r_regionkey = 0")
def save_modes(t):
    from pyspark.errors import AnalysisException

    spark, path = t.spark, scratch(t.spark, "modes")
    out = []

    def count(label):
        out.append(spark.read.parquet(path).agg(F.lit(label).alias("mode"), F.count("*").alias("n")).first())

    t.region.write.parquet(path)
    t.region.write.mode("append").parquet(path)
    count("append")
    t.region.write.mode("overwrite").parquet(path)
    count("overwrite")
    t.region.write.mode("ignore").parquet(path)
    count("ignore")
    refused = 0
    try:
        t.region.write.mode("error").parquet(path)
    except AnalysisException:
        refused = 1
    rows = [(r["mode"], r["n"]) for r in out] + [("error", refused)]
    return spark.createDataFrame(rows, "mode string, n long")


@query("src_09_partitioned", "SRC-09", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def partitioned(t):
    """Rows are gathered by the partition column before the write; a common value is split over as many files as its size asks for."""
    path = scratch(t.spark, "by_status")
    gathered(t.orders, "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return t.spark.read.parquet(path).filter("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def bucketed(t):
    """Orders and lines, the columns in use, bucketed and sorted on the order key: their join needs no exchange."""
    sides = {"orders": (t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey"), "lines": (t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice"), "l_orderkey")}
    buckets = bucket_number(*[df for df, _ in sides.values()])
    out = []
    for label, (df, key) in sides.items():
        path = scratch(t.spark, f"bucketed_{label}")
        out.append(write_bucketed(df, new_name(label, path), path, key, buckets))
    return out


@query("src_10_bucketed_join", "SRC-07 SRC-10 SRC-11 SRC-14 SRC-24", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def bucketed_join(t):
    o, l = bucketed(t)
    return o.hint("merge").join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("src_13_insert_into", "SRC-13", "SELECT p_type, CASE WHEN p_type = 'PROMO' THEN count(*) FILTER (p_size > 10) ELSE count(*) END AS n FROM part GROUP BY 1")
def insert_into(t):
    """Position-based inserts; then one partition alone is replaced by a dynamic overwrite."""
    spark, path = t.spark, scratch(t.spark, "parts")
    name = new_name("parts", path)
    rows = t.part.select("p_partkey", "p_size", "p_type")
    rows.limit(0).write.partitionBy("p_type").option("path", path).format("parquet").saveAsTable(name)
    rows.write.insertInto(name)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.filter("p_type = 'PROMO' AND p_size > 10").write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return spark.table(name).groupBy("p_type").agg(F.count("*").alias("n"))


@query("src_22_range", "SRC-22", "SELECT k, count(o_orderkey) AS n FROM range(0, 40) r(k) LEFT JOIN orders ON o_orderkey % 40 = k GROUP BY 1")
def number_range(t):
    """A generated range as the complete axis of a histogram of the orders."""
    counts = t.orders.groupBy((F.col("o_orderkey") % 40).alias("k")).agg(F.count("*").alias("c"))
    return t.spark.range(0, 40, 1).withColumnRenamed("id", "k").join(counts, "k", "left").select("k", F.coalesce("c", F.lit(0).cast("long")).alias("n"))


@query("wl_23_file_tour", "WL-23", """
SELECT 'skip_corrupt' AS step, count(*) AS n FROM nation UNION ALL SELECT 'glob', count(*) FROM nation UNION ALL SELECT 'recursive', count(*) * 2 FROM nation UNION ALL SELECT 'after', 0 FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'sql_on_file', count(*) FROM nation UNION ALL SELECT 'multiline', count(*) FROM region""")
def file_tour(t):
    spark, root = t.spark, scratch(t.spark, "tour")
    t.nation.write.parquet(f"{root}/dir1")
    t.nation.write.parquet(f"{root}/dir1/dir2")
    bad = t.spark.range(1).select(F.lit('{"file":"corrupt"}').alias("value"))
    bad.write.text(f"{root}/mixed")
    t.nation.write.mode("append").parquet(f"{root}/mixed")
    t.region.select(F.lit(1).alias("one"), F.to_json(F.struct("*")).alias("value")).groupBy("one").agg(F.array_join(F.sort_array(F.collect_list("value")), ",\n").alias("v")).select(F.concat(F.lit("[\n"), "v", F.lit("\n]")).alias("value")).write.option("lineSep", "\n").text(f"{root}/multi")
    base = spark.read.schema(t.nation.schema)
    steps = {
        "skip_corrupt": spark.read.schema(t.nation.schema).option("ignoreCorruptFiles", "true").parquet(f"{root}/mixed"),
        "glob": base.option("pathGlobFilter", "*.parquet").parquet(f"{root}/dir1"),
        "recursive": spark.read.schema(t.nation.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/dir1"),
        "after": spark.read.schema(t.nation.schema).option("recursiveFileLookup", "true").option("modifiedAfter", "2100-01-01T00:00:00").parquet(f"{root}/dir1"),
        "sql_on_file": spark.sql(f"SELECT * FROM parquet.`{root}/dir1/dir2`"),
        "multiline": spark.read.option("multiLine", True).json(f"{root}/multi", schema="r_regionkey int, r_name string"),
    }
    out = None
    for step, df in steps.items():
        part = df.agg(F.lit(step).alias("step"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out
