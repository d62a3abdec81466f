"""Strings, hashing, encryption and XPath."""

from __future__ import annotations

import zlib
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from joulemill.registry import query
from joulemill.storage import cut


def agree(*conditions):
    return reduce(lambda a, b: a & b, conditions)


@query("hash_1_digests", "HASH-1", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha2, sha1(text) AS sha1, true AS stable FROM documents")
def digests(t):
    """``stable``: the 64-bit hash and the checksum equal those of independent implementations over the same bytes."""
    x = F.col("text")

    @F.pandas_udf("long")
    def seeded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: xxhash.xxh64_intdigest(v.encode(), 42)).astype("uint64").astype("int64")

    @F.pandas_udf("long")
    def checksum(s: pd.Series) -> pd.Series:
        return s.map(lambda v: zlib.crc32(v.encode())).astype("int64")

    stable = agree(F.sha(x) == F.sha1(x), F.xxhash64(x) == seeded(x), F.crc32(x) == checksum(x))
    return t.documents.select("doc_id", F.md5(x).alias("md5"), F.sha2(x, 256).alias("sha2"), F.sha1(x).alias("sha1"), stable.alias("stable"))


@query("hash_2_encryption", "HASH-2", "SELECT conv_id, turn, length(text) AS n, true AS hidden, true AS restored, true AS wrong_key FROM conversations")
def encryption(t):
    """Text is protected with a key and restored; a wrong key gives null from the tolerant form. Every row gets a random nonce of its own, so equal texts
    don't show; the cipher text is written before it is read twice."""
    key, other, x = F.lit("0123456789abcdef"), F.lit("fedcba9876543210"), F.col("text")
    enc = cut(t.conversations.select("conv_id", "turn", "text", F.aes_encrypt(x, key, F.lit("GCM")).alias("e")), "encrypted")
    return enc.select("conv_id", "turn", F.length(x).alias("n"), (F.col("e") != F.encode(x, "utf-8")).alias("hidden"),
                      (F.aes_decrypt("e", key, F.lit("GCM")).cast("string") == x).alias("restored"), F.try_aes_decrypt("e", other, F.lit("GCM")).isNull().alias("wrong_key"))


@query("str_1_case", "STR-1", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS cap,
 ascii(p_name) AS code, chr(65 + p_size % 26) AS ch FROM part""")
def case(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", F.when(F.upper(n) == F.ucase(n), F.upper(n)).alias("up"), F.when(F.lower("p_brand") == F.lcase(F.col("p_brand")), F.lower("p_brand")).alias("low"), F.initcap(n).alias("cap"),
                         F.ascii(n).alias("code"), F.char(65 + F.col("p_size") % 26).alias("ch"))


@query("str_2_trim_pad", "STR-2", """
SELECT p_partkey, ltrim('  ' || p_brand || ' ') AS l, rtrim(' ' || p_brand || '  ') AS r, trim('  ' || p_brand || ' ') AS b, trim(p_brand, 'B1') AS bt, lpad(p_partkey::VARCHAR, 9, '0') AS lp, rpad(p_brand, 12, '*') AS rp, repeat(left(p_name, 2), 3) AS rep FROM part""")
def trim_pad(t):
    b = F.col("p_brand")
    padded = F.concat(F.lit("  "), b, F.lit(" "))
    return t.part.select("p_partkey", F.ltrim(padded).alias("l"), F.rtrim(F.concat(F.lit(" "), b, F.lit("  "))).alias("r"), F.trim(padded).alias("b"), F.btrim(b, F.lit("B1")).alias("bt"),
                         F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("lp"), F.rpad(b, 12, "*").alias("rp"), F.repeat(F.substring("p_name", 1, 2), 3).alias("rep"))


@query("str_3_search", "STR-3", """
SELECT doc_id, instr(text, 'the') AS at, CASE WHEN instr(substr(text, 10), 'the') = 0 THEN 0 ELSE instr(substr(text, 10), 'the') + 9 END AS at10, contains(text, 'and') AS has, starts_with(text, 'T') AS first, ends_with(text, '.') AS last,
 coalesce(list_position(['en', 'de', 'fr'], lang), 0)::BIGINT AS place, text LIKE '%the%' AS lk, text ILIKE 'THE%' AS il, regexp_matches(text, '[0-9]{3}') AS digits, true AS same FROM documents""")
def search(t):
    x = F.col("text")
    digits = F.lit("[0-9]{3}")
    same = agree(F.locate("the", "text") == F.instr(x, "the"), F.position(F.lit("the"), x) == F.instr(x, "the"), F.regexp(x, digits) == F.rlike(x, digits), F.regexp_like(x, digits) == F.rlike(x, digits))
    return t.documents.select("doc_id", F.instr(x, "the").alias("at"), F.locate("the", "text", 10).alias("at10"), F.contains(x, F.lit("and")).alias("has"), F.startswith(x, F.lit("T")).alias("first"), F.endswith(x, F.lit(".")).alias("last"),
                              F.find_in_set(F.col("lang"), F.lit("en,de,fr")).cast("long").alias("place"), F.like(x, F.lit("%the%")).alias("lk"), F.ilike(x, F.lit("THE%")).alias("il"), F.rlike(x, digits).alias("digits"), same.alias("same"))


@query("str_4_regex", "STR-4", r"""
SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), '|') AS hrefs,
 length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_len, regexp_extract(html, '<h1>') AS sub, instr(html, '<h1>') AS at FROM pages""")
def regex(t):
    h = F.col("html")
    return t.pages.select("page_id", F.regexp_count(h, F.lit("<a href=")).cast("long").alias("links"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"),
                          F.array_join(F.regexp_extract_all(h, F.lit('href="([^"]*)"'), F.lit(1)), "|").alias("hrefs"), F.length(F.regexp_replace(h, "<[^>]*>", "")).cast("long").alias("text_len"),
                          F.coalesce(F.regexp_substr(h, F.lit("<h1>")), F.lit("")).alias("sub"), F.regexp_instr(h, F.lit("<h1>")).cast("long").alias("at"))


@query("str_5_slice_replace", "STR-5", """
SELECT page_id, substr(url, 8, 6) AS mid, split_part(url, '/', 3) AS host, left(url, 4) AS lf, right(url, 3) AS rt, string_split(url, '/')[4] AS third, 'HTTP' || substr(url, 5) AS over, replace(url, 'example', 'site') AS rep,
 translate(url, ':/', '--') AS tr, CASE page_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS el, regexp_replace(regexp_replace(regexp_replace(c, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS masked, true AS same
FROM (SELECT *, split_part(url, '.', 2) AS c FROM pages)""")
def slice_replace(t):
    u = F.col("url")
    same = agree(F.substr(u, F.lit(8), F.lit(6)) == F.substring(u, 8, 6), F.substring_index(u, "/", 3).endswith(F.split_part(u, F.lit("/"), F.lit(3))))
    return t.pages.select("page_id", F.substring(u, 8, 6).alias("mid"), F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), F.left(u, F.lit(4)).alias("lf"), F.right(u, F.lit(3)).alias("rt"), F.split(u, "/", -1)[3].alias("third"),
                          F.overlay(u, F.lit("HTTP"), 1, 4).alias("over"), F.replace(u, F.lit("example"), F.lit("site")).alias("rep"), F.translate(u, ":/", "--").alias("tr"),
                          F.elt((F.col("page_id") % 2 + 1).cast("int"), F.lit("even"), F.lit("odd")).alias("el"), F.mask(F.split_part(u, F.lit("."), F.lit(2))).alias("masked"), same.alias("same"))


@query("str_6_format", "STR-6", """
SELECT c_custkey, concat_ws('-', c_mktsegment, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'ok' END, c_nationkey::VARCHAR) AS ws, c_mktsegment || ':' || c_nationkey AS cc, format('{:,.2f}', c_acctbal) AS fmt, printf('%05d/%s', c_custkey, c_mktsegment) AS pf,
 printf('%.2f', abs(c_acctbal)) AS ch, c_custkey AS num, true AS bad FROM customer""")
def formatting(t):
    key = F.col("c_custkey")
    text = F.format_string("%05d/%s", key, F.col("c_mktsegment"))
    dec = F.abs("c_acctbal").cast("decimal(12,2)")
    shown = F.to_char(dec, F.lit("9999999990.00"))
    return t.customer.select("c_custkey", F.concat_ws("-", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, "ok"), F.col("c_nationkey").cast("string")).alias("ws"), F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey")).alias("cc"),
                             F.format_number("c_acctbal", 2).alias("fmt"), F.when(F.printf(F.lit("%05d/%s"), key, F.col("c_mktsegment")) == text, text).alias("pf"),
                             F.trim(F.when(F.to_varchar(dec, F.lit("9999999990.00")) == shown, shown)).alias("ch"), F.to_number(key.cast("string"), F.lit("9999999999")).cast("long").alias("num"),
                             F.try_to_number(F.lit("x1"), F.lit("99")).isNull().alias("bad"))


@query("str_7_encodings", "STR-7", """
SELECT page_id, to_base64(encode(url)) AS b64, hex(url) AS hx, to_base(page_id, 2) AS bn, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, true AS same FROM pages""")
def encodings(t):
    u = F.col("url")
    b64 = F.base64(F.encode(u, "utf-8"))
    same = agree(F.decode(F.unbase64(b64), "utf-8") == u, F.unhex(F.hex(u)).cast("string") == u, F.to_binary(b64, F.lit("base64")).cast("string") == u, F.try_to_binary(F.lit("zz"), F.lit("hex")).isNull(), F.url_decode(F.url_encode(u)) == u)
    return t.pages.select("page_id", b64.alias("b64"), F.hex(u).alias("hx"), F.bin("page_id").alias("bn"), F.parse_url(u, F.lit("HOST")).alias("host"), F.coalesce(F.parse_url(u, F.lit("PATH")), F.lit("")).alias("path"),
                          F.coalesce(F.parse_url(u, F.lit("QUERY"), F.lit("page")), F.lit("")).alias("page"), same.alias("same"))


@query("str_8_length_similarity", "STR-8", """
SELECT p_partkey, length(p_name) AS n, strlen(p_name) AS bytes, strlen(p_name) * 8 AS bits, levenshtein(p_name, 'red widget') AS dist, CASE WHEN levenshtein(p_name, 'red widget') <= 3 THEN levenshtein(p_name, 'red widget') ELSE -1 END AS near, true AS same FROM part""")
def length_similarity(t):
    n, target = F.col("p_name"), F.lit("red widget")
    same = agree(F.char_length(n) == F.length(n), F.character_length(n) == F.length(n), F.length(F.soundex(n)) == 4, F.size(F.sentences(n)) == 1)
    return t.part.select("p_partkey", F.length(n).alias("n"), F.octet_length(n).alias("bytes"), F.bit_length(n).alias("bits"), F.levenshtein(n, target).alias("dist"), F.levenshtein(n, target, 3).alias("near"), same.alias("same"))


XPATH_ROWS = 10_000  # of a task: some seconds of parsing


@query("xml_1_xpath", "XML-1", """
SELECT p_partkey, p_name AS name, p_size AS size, p_retailprice AS price, p_size > 25 AS big, split_part(p_name, ' ', 1) || ',' || split_part(p_name, ' ', 2) AS words, true AS same FROM part""")
def xpath(t):
    """Every expression parses the text again: each path and type is evaluated once, and the rows are dealt over the cores, as a small file is one task."""
    words = F.split("p_name", " ")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    x = F.concat(F.lit("<part>"), tag("name", F.col("p_name")), tag("size", F.col("p_size")), tag("price", F.col("p_retailprice").cast("decimal(12,2)")), tag("w", words[0]), tag("w", words[1]), F.lit("</part>"))
    p = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    df = p.repartition(-(-p.count() // XPATH_ROWS) or 1).select("p_partkey", x.alias("x"))
    size, price = F.lit("part/size"), F.lit("part/price")
    once = df.select("p_partkey", "x", F.xpath_int("x", size).alias("size"), F.xpath_double("x", price).alias("price"))
    same = agree(F.xpath_long("x", size) == F.col("size"), F.xpath_short("x", size) == F.col("size"), F.xpath_number("x", price) == F.col("price"), F.abs(F.xpath_float("x", price) - F.col("price")) < 0.01)
    return once.select("p_partkey", F.xpath_string("x", F.lit("part/name")).alias("name"), "size", "price", F.xpath_boolean("x", F.lit("part/size > 25")).alias("big"),
                       F.array_join(F.xpath("x", F.lit("part/w/text()")), ",").alias("words"), same.alias("same"))
