"""Projection, filtering, predicates, null handling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.registry import query


@query("prj_01_select", "PRJ-01 PRJ-30", """
SELECT o_orderkey AS order_key, o_custkey AS cust_key, round(o_totalprice * 1.1, 4) AS gross FROM orders""")
def select(t):
    return t.orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"),
                           F.round(F.col("o_totalprice") * 1.1, 4).alias("gross"))


@query("prj_02_select_expr", "PRJ-02 COL-1", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net,
 round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge, 'line' AS kind FROM lineitem""")
def select_expr(t):
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "round(l_extendedprice * (1 - l_discount), 6) AS net",
                                 "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge").withColumn("kind", F.lit("line"))


@query("prj_03_filter", "PRJ-03 PRJ-23 PRJ-25 PRJ-27 PRJ-28", """
SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 30 AND p_type IN ('SMALL', 'LARGE', 'PROMO')
 AND p_name LIKE '%ring' AND p_brand ILIKE 'BRAND#1%' AND NOT (p_retailprice > 1500 OR p_size = 7)""")
def filter_rows(t):
    p = t.part
    return p.filter(p.p_size.between(5, 30) & p.p_type.isin("SMALL", "LARGE", "PROMO")).where(
        p.p_name.like("%ring") & p.p_brand.ilike("BRAND#1%") & ~((p.p_retailprice > 1500) | (p.p_size == 7))
    ).select("p_partkey", "p_name")


@query("prj_04_with_column", "PRJ-04 PRJ-05 PRJ-06 PRJ-07 PRJ-08 PRJ-09", """
SELECT s_suppkey AS supplier_id, s_nationkey AS nation_id, round(s_acctbal * 2, 2) AS doubled, s_acctbal < 0 AS negative,
 s_nationkey % 5 AS slot FROM supplier""")
def with_column(t):
    return (
        t.supplier.withColumn("doubled", F.round(F.col("s_acctbal") * 2, 2))
        .withColumns({"negative": F.col("s_acctbal") < 0, "slot": F.col("s_nationkey") % 5})
        .withColumnRenamed("s_suppkey", "supplier_id")
        .withColumnsRenamed({"s_nationkey": "nation_id", "doubled": "twice"})
        .drop("s_name", "s_acctbal")
        .toDF("supplier_id", "nation_id", "doubled", "negative", "slot")
    )


@query("prj_10_to_schema", "PRJ-10", "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def to_schema(t):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return t.nation.to(StructType([StructField("n_name", StringType()), StructField("n_nationkey", LongType())]))


@query("prj_11_alias", "PRJ-11 PRJ-12 PRJ-13", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0""")
def alias_regex_transform(t):
    def positive(df, column):
        return df.filter(F.col(f"c.{column}") > 0)

    c = t.customer.alias("c").transform(positive, "c_acctbal")
    return c.select(c.colRegex("`c_.*`"))


@query("prj_14_unpivot", "PRJ-14", """
SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS measure, l_discount AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem""")
def unpivot(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"], "measure", "amount")


@query("prj_15_dropna", "PRJ-15", """
WITH x AS (SELECT d.doc_id, d.lang, l.quality, CASE WHEN l.toxic = 1 THEN 1 END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'any' AS rule, count(*) AS n FROM x WHERE quality IS NOT NULL AND toxic IS NOT NULL
UNION ALL SELECT 'all', count(*) FROM x WHERE quality IS NOT NULL OR toxic IS NOT NULL
UNION ALL SELECT 'thresh', count(*) FROM x WHERE quality IS NOT NULL OR toxic IS NOT NULL""")
def dropna(t):
    x = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").withColumn("toxic", F.when(F.col("toxic") == 1, 1))
    rules = {
        "any": x.dropna(),
        "all": x.dropna(how="all", subset=["quality", "toxic"]),
        "thresh": x.dropna(thresh=3),
    }
    out = None
    for rule, df in rules.items():
        part = df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("prj_16_fillna", "PRJ-16 PRJ-17", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic,
 CASE d.lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE d.lang END AS lang
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def fillna_replace(t):
    return (
        t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
        .fillna({"quality": -1}).na.fill(0, ["toxic"]).replace({"en": "English", "de": "German"}, subset=["lang"])
    )


@query("prj_18_is_empty", "PRJ-18", """
SELECT count(*) = 0 AS no_urgent, (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0 AS no_negative
FROM orders WHERE o_orderpriority = '1-URGENT'""")
def is_empty(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").isEmpty()
    negative = t.orders.filter("o_totalprice < 0").isEmpty()
    return t.spark.range(1).select(F.lit(urgent).alias("no_urgent"), F.lit(negative).alias("no_negative"))


@query("prj_19_nested_fields", "PRJ-19 PRJ-20 PRJ-21 PRJ-22 STC-1", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, p_brand AS brand, p_size + 1 AS grown, 2 AS fields_left,
 CAST(json_extract(j, '$.t') AS VARCHAR) = '"' || p_type || '"' AS same_type
FROM (SELECT *, json_object('t', p_type) AS j FROM part)""")
def nested_fields(t):
    packed = t.part.select(
        "p_partkey", F.split("p_name", " ").alias("words"), "p_type",
        F.struct("p_brand", "p_size").alias("s"),
        F.named_struct(F.lit("t"), F.col("p_type"), F.lit("size"), F.col("p_size")).alias("m"),
    ).withColumn("s", F.col("s").withField("grown", F.col("s.p_size") + 1)).withColumn("left", F.col("s").dropFields("p_size"))
    return packed.select(
        "p_partkey", F.col("words").getItem(0).alias("first_word"), F.col("left").getField("p_brand").alias("brand"),
        F.col("left.grown").alias("grown"), F.size(F.json_object_keys(F.to_json("left"))).alias("fields_left"),
        (F.col("m").getField("t") == F.col("p_type")).alias("same_type"))


@query("prj_24_predicates", "PRJ-24 PRJ-26 PRJ-29 PRJ-31 PRJ-32", """
SELECT c_custkey, substr(c_name, 10, 9) AS number, CAST(substr(c_name, 10, 9) AS INTEGER) AS parsed,
 CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band,
 (c_custkey & 5) AS bits_and, (c_custkey | 8) AS bits_or, xor(c_custkey, 3) AS bits_xor
FROM customer WHERE regexp_matches(c_mktsegment, '^(AUTO|BUILD)') AND starts_with(c_name, 'Customer') AND NOT ends_with(c_name, '7')
 AND contains(c_name, '#0') AND c_nationkey IS NOT DISTINCT FROM c_nationkey AND c_acctbal IS NOT NULL""")
def predicates(t):
    c = t.customer
    number = c.c_name.substr(10, 9)
    return c.filter(
        c.c_mktsegment.rlike("^(AUTO|BUILD)") & c.c_name.startswith("Customer") & ~c.c_name.endswith("7")
        & c.c_name.contains("#0") & c.c_nationkey.eqNullSafe(c.c_nationkey) & c.c_acctbal.isNotNull() & ~c.c_acctbal.isNull()
    ).select(
        "c_custkey", number.alias("number"), number.cast("int").alias("parsed"),
        F.when(c.c_acctbal < 0, "debt").when(c.c_acctbal < 5000, "low").otherwise("high").alias("band"),
        c.c_custkey.bitwiseAND(5).alias("bits_and"), c.c_custkey.bitwiseOR(8).alias("bits_or"), c.c_custkey.bitwiseXOR(3).alias("bits_xor"))


@query("nul_1_null_functions", "NUL-1", """
WITH x AS (SELECT d.doc_id, l.quality AS q, l.toxic AS x, CASE WHEN d.doc_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE d.n_chars END AS c
 FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(q, x, -1) AS co, isnan(c) AS is_nan, q IS NULL AS is_null, q IS NOT NULL AS is_not_null,
 CASE WHEN isnan(c) THEN 0.0 ELSE c END AS nanvl, ifnull(q, 7) AS if_null, coalesce(nullif(q, 1), -5) AS null_if, coalesce(q, 8) AS nvl,
 CASE WHEN q IS NOT NULL THEN 1 ELSE 2 END AS nvl2, q IS NOT DISTINCT FROM x AS equal_null,
 greatest(coalesce(q, 0), coalesce(x, 0), 0) AS great, least(coalesce(q, 5), coalesce(x, 9)) AS least,
 CASE WHEN q = 1 AND x = 0 THEN 'good' WHEN x = 1 THEN 'bad' ELSE 'unknown' END AS verdict FROM x""")
def null_functions(t):
    q, x, c = F.col("quality"), F.col("toxic"), F.col("c")
    df = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").withColumn(
        "c", F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double")))
    return df.select(
        "doc_id", F.coalesce(q, x, F.lit(-1)).alias("co"), F.isnan(c).alias("is_nan"), F.isnull(q).alias("is_null"),
        F.isnotnull(q).alias("is_not_null"), F.nanvl(c, F.lit(0.0)).alias("nanvl"), F.ifnull(q, F.lit(7)).alias("if_null"),
        F.coalesce(F.nullif(q, F.lit(1)), F.lit(-5)).alias("null_if"), F.nvl(q, F.lit(8)).alias("nvl"),
        F.nvl2(q, F.lit(1), F.lit(2)).alias("nvl2"), F.equal_null(q, x).alias("equal_null"),
        F.greatest(q, x, F.lit(0)).alias("great"), F.least(F.coalesce(q, F.lit(5)), F.coalesce(x, F.lit(9))).alias("least"),
        F.when((q == 1) & (x == 0), "good").when(x == 1, "bad").otherwise("unknown").alias("verdict"))


@query("nul_2_assertions", "NUL-2", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def assertions(t):
    """A gate that fails the job on a bad row: assert_true yields null when it holds, raise_error never returns."""
    checked = t.lineitem.withColumn("gate", F.assert_true(F.col("l_quantity") > 0, "quantity must be positive"))
    flagged = checked.withColumn("flag", F.when(F.col("l_returnflag").isin("A", "N", "R"), F.col("l_returnflag"))
                                 .otherwise(F.raise_error(F.lit("unknown return flag")).cast("string")))
    return flagged.filter(F.col("gate").isNull()).groupBy(F.col("flag").alias("l_returnflag")).agg(F.count("*").alias("n"))


@query("env_1_types", "ENV-1", """
SELECT 'bigint' AS key_type, 'double' AS price_type, 'string' AS status_type, count(*) AS n, true AS has_session FROM orders""")
def types(t):
    session = (F.length(F.current_catalog()) > 0) & (F.length(F.current_database()) > 0) & (F.length(F.current_schema()) > 0) & (
        F.length(F.current_user()) > 0) & (F.length(F.user()) > 0) & (F.length(F.version()) > 0)
    return t.orders.groupBy(
        F.typeof("o_orderkey").alias("key_type"), F.typeof("o_totalprice").alias("price_type"), F.typeof("o_orderstatus").alias("status_type")
    ).agg(F.count("*").alias("n"), F.bool_and(session).alias("has_session"))


@query("meta_1_provenance", "META-1", "SELECT 'orders.parquet' AS file, count(*) AS n, count(*) AS ids, true AS positive_length FROM orders")
def provenance(t):
    tagged = t.orders.select(
        F.regexp_extract(F.input_file_name(), r"(orders\.parquet)", 1).alias("file"), F.monotonically_increasing_id().alias("id"),
        F.spark_partition_id().alias("part"), F.input_file_block_length().alias("len"), F.input_file_block_start().alias("start"))
    return tagged.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"),
                                      F.bool_and((F.col("len") > 0) & (F.col("start") >= 0) & (F.col("part") >= 0)).alias("positive_length"))
