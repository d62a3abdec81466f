"""Math, trigonometry, bits, tolerant arithmetic and random columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.registry import query


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


@query("math_1_arithmetic", "MATH-1", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS p, l_discount AS d, l_quantity AS q, 20 - l_quantity AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 2) AS p, abs(s) AS abs, round(sqrt(p), 6) AS sqrt, round(cbrt(p), 6) AS cbrt, round(exp(d), 6) AS exp, round(exp(d) - 1, 6) AS expm1, round(ln(p), 6) AS ln, round(ln(p), 6) AS log,
 round(ln(p) / ln(3), 6) AS log3, round(log10(p), 6) AS log10, round(ln(1 + d), 6) AS log1p, round(log2(p), 6) AS log2, pow(q, 2) AS pow, round(sqrt(q * q + s * s), 6) AS hypot, factorial(l_linenumber)::BIGINT AS fact, -s AS neg, s AS pos,
 sign(s)::DOUBLE AS sgn, ((s::BIGINT % 7) + 7) % 7 AS pmod, round_even(q / 2, 0) AS rint, round(q / 8, 2) AS rnd, round_even(q / 8, 2) AS brnd, ceil(p)::BIGINT AS ceil, floor(p)::BIGINT AS floor, upper(to_base(l_partkey, 16)) AS hex, round(exp(1) + pi(), 6) AS e_pi,
 CASE WHEN q < 0 THEN 0 WHEN q >= 50 THEN 11 ELSE floor(q / 5)::BIGINT + 1 END AS bucket FROM x""")
def arithmetic(t):
    p, d, q = F.col("p"), F.col("l_discount"), F.col("l_quantity")
    s = 20 - q
    same = (F.ceil(p) == F.ceiling(p)) & (F.signum(s) == F.sign(s))
    return t.lineitem.withColumn("p", F.col("l_extendedprice")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(p, "p", 2), F.abs(s).alias("abs"), r(F.sqrt(p), "sqrt"), r(F.cbrt(p), "cbrt"), r(F.exp(d), "exp"), r(F.expm1(d), "expm1"), r(F.ln(p), "ln"), r(F.log(p), "log"),
        r(F.log(3.0, p), "log3"), r(F.log10(p), "log10"), r(F.log1p(d), "log1p"), r(F.log2(p), "log2"), F.pow(q, F.lit(2)).alias("pow"), r(F.hypot(q, s), "hypot"), F.factorial("l_linenumber").alias("fact"),
        F.negative(s).alias("neg"), F.positive(s).alias("pos"), F.when(same, F.signum(s)).alias("sgn"), F.pmod(s.cast("long"), F.lit(7)).alias("pmod"), F.rint(q / 2).alias("rint"), F.round(q / 8, 2).alias("rnd"), F.bround(q / 8, 2).alias("brnd"),
        F.ceil(p).alias("ceil"), F.floor(p).alias("floor"), F.conv(F.col("l_partkey").cast("string"), 10, 16).alias("hex"), r(F.e() + F.pi(), "e_pi"), F.width_bucket(q, F.lit(0.0), F.lit(50.0), F.lit(10)).alias("bucket"))


@query("math_2_trigonometry", "MATH-2", """
WITH x AS (SELECT p_partkey, p_size AS a, p_size / 51.0 AS u FROM part)
SELECT p_partkey, round(acos(u), 6) AS acos, round(acosh(a + 1.0), 6) AS acosh, round(asin(u), 6) AS asin, round(asinh(u), 6) AS asinh, round(atan(u), 6) AS atan, round(atanh(u), 6) AS atanh, round(atan2(a, 3), 6) AS atan2,
 round(cos(a), 6) AS cos, round(cosh(u), 6) AS cosh, round(1 / tan(u), 6) AS cot, round(1 / sin(u), 6) AS csc, round(1 / cos(u), 6) AS sec, round(sin(a), 6) AS sin, round(sinh(u), 6) AS sinh, round(tan(u), 6) AS tan, round(tanh(u), 6) AS tanh,
 round(degrees(u), 6) AS deg, round(radians(a), 6) AS rad FROM x""")
def trigonometry(t):
    a, u = F.col("p_size"), F.col("p_size") / 51.0
    deg = F.when(F.degrees(u) == F.toDegrees(u), F.degrees(u))
    rad = F.when(F.radians(a) == F.toRadians(a), F.radians(a))
    named = {"acos": F.acos(u), "acosh": F.acosh(a + 1.0), "asin": F.asin(u), "asinh": F.asinh(u), "atan": F.atan(u), "atanh": F.atanh(u), "atan2": F.atan2(a, F.lit(3)), "cos": F.cos(a), "cosh": F.cosh(u),
             "cot": F.cot(u), "csc": F.csc(u), "sec": F.sec(u), "sin": F.sin(a), "sinh": F.sinh(u), "tan": F.tan(u), "tanh": F.tanh(u), "deg": deg, "rad": rad}
    return t.part.select("p_partkey", *[r(c, n) for n, c in named.items()])


@query("math_3_bits", "MATH-3", """
SELECT o_orderkey, (-o_orderkey - 1) AS inv, bit_count(o_orderkey)::BIGINT AS ones, (o_orderkey >> 2) & 1 AS bit2, o_orderkey * 8 AS up, o_orderkey >> 1 AS down, ((-o_orderkey - 1) >> 60) & 15 AS top FROM orders""")
def bits(t):
    k = F.col("o_orderkey")
    inv = F.bitwise_not(k)
    same = (F.bitwiseNOT(k) == inv) & (F.getbit(k, F.lit(2)) == F.bit_get(k, F.lit(2))) & (F.shiftLeft(k, 3) == F.shiftleft(k, 3)) & (
        F.shiftRight(k, 1) == F.shiftright(k, 1)) & (F.shiftRightUnsigned(inv, 60) == F.shiftrightunsigned(inv, 60))
    return t.orders.select("o_orderkey", F.when(same, inv).alias("inv"), F.bit_count(k).cast("long").alias("ones"), F.bit_get(k, F.lit(2)).cast("int").alias("bit2"),
                           F.shiftleft(k, 3).alias("up"), F.shiftright(k, 1).alias("down"), F.shiftrightunsigned(inv, 60).alias("top"))


@query("math_4_tolerant", "MATH-4", """
SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS undefined, count(*) AS overflow, count(*) AS products, count(*) AS differences, round(sum(CASE WHEN l_discount > 0 THEN l_tax / l_discount END), 4) AS ratio FROM lineitem GROUP BY 1""")
def tolerant(t):
    """Overflow and division by zero give null instead of stopping the job."""
    top = F.lit(9223372036854775807)
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_if(F.try_divide("l_tax", "l_discount").isNull()).alias("undefined"), F.count_if(F.try_add(top, F.col("l_linenumber")).isNull()).alias("overflow"),
        F.count_if(F.try_multiply(top, F.col("l_linenumber") + 1).isNull()).alias("products"), F.count_if(F.try_subtract(-top, F.col("l_linenumber") + 1).isNull()).alias("differences"),
        F.round(F.sum(F.try_divide("l_tax", "l_discount")), 4).alias("ratio"))


@query("math_5_random", "MATH-5", "SELECT true AS unit, true AS mean_ok, true AS normal_ok, count(*) AS n FROM events")
def random_columns(t):
    x = t.events.select(F.rand(11).alias("u"), F.randn(11).alias("g"))
    return x.agg(F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("unit"), (F.abs(F.avg("u") - 0.5) < 0.06).alias("mean_ok"),
                 ((F.abs(F.avg("g")) < 0.2) & (F.abs(F.stddev("g") - 1) < 0.2)).alias("normal_ok"), F.count("*").alias("n"))
