"""Arrays, maps, higher-order functions, generators, JSON and CSV columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.registry import query


def join(c, name):
    return F.array_join(c, ",").alias(name)


@query("arr_1_arrays", "ARR-1", """
WITH x AS (SELECT p_partkey, [p_size % 7, p_size % 5, p_size % 3] AS a, [1, 2, p_size % 4] AS b FROM part)
SELECT p_partkey, array_to_string(a, ',') AS a, list_contains(a, 2) AS has2, list_has_any(a, b) AS over, array_to_string(a[2:3], ',') AS sl, coalesce(list_position(a, 2), 0)::BIGINT AS pos, a[1] AS first, coalesce(a[9], -1) AS none, a[3] AS third,
 array_to_string(list_prepend(9, a), ',') AS pre, array_to_string(list_append(a, 9), ',') AS app, array_to_string(list_filter(a, lambda v: v <> 2), ',') AS rem, array_to_string(list_sort(list_distinct(a)), ',') AS dis,
 array_to_string([a[1], 8, a[2], a[3]], ',') AS ins, array_to_string(list_sort(list_intersect(list_distinct(a), list_distinct(b))), ',') AS isect, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS un,
 array_to_string(list_sort(list_filter(list_distinct(a), lambda v: NOT list_contains(b, v))), ',') AS exc, list_min(a) AS mn, list_max(a) AS mx, 3 AS n, array_to_string(list_sort(a), ',') AS srt, array_to_string(list_reverse_sort(a), ',') AS rsrt,
 array_to_string(list_reverse(a), ',') AS rev, array_to_string(flatten([a, b]), ',') AS flat, array_to_string([p_partkey, p_partkey], ',') AS rep, array_to_string(list_transform(list_zip(a, b), lambda z: z[1] * 10 + z[2]), ',') AS zip, array_to_string(range(1, a[1] + 2), ',') AS seq, true AS same FROM x""")
def arrays(t):
    size = F.col("p_size")
    x = t.part.select("p_partkey", F.array(size % 7, size % 5, size % 3).alias("a"), F.array(F.lit(1), F.lit(2), size % 4).alias("b"))
    a, b = F.col("a"), F.col("b")
    same = (F.size(a) == F.cardinality(a)) & (F.array_size(a) == 3) & (F.array_sort(a, lambda p, q: p - q) == F.array_sort(a)) & (F.sort_array(F.shuffle(a)) == F.sort_array(a)) & F.try_element_at(a, F.lit(9)).isNull()
    return x.select(
        "p_partkey", join(a, "a"), F.array_contains(a, 2).alias("has2"), F.arrays_overlap(a, b).alias("over"), join(F.slice(a, 2, 2), "sl"), F.array_position(a, 2).alias("pos"), F.element_at(a, 1).alias("first"), F.coalesce(F.get(a, F.lit(8)), F.lit(-1)).alias("none"),
        F.get(a, F.lit(2)).alias("third"), join(F.array_prepend(a, 9), "pre"), join(F.array_append(a, 9), "app"), join(F.array_remove(a, 2), "rem"), join(F.sort_array(F.array_distinct(a)), "dis"), join(F.array_insert(a, 2, 8), "ins"), join(F.sort_array(F.array_intersect(a, b)), "isect"),
        join(F.sort_array(F.array_union(a, b)), "un"), join(F.sort_array(F.array_except(a, b)), "exc"), F.array_min(a).alias("mn"), F.array_max(a).alias("mx"), F.size(F.array_compact(F.array_append(a, F.lit(None).cast("int")))).alias("n"), join(F.sort_array(a), "srt"), join(F.sort_array(a, False), "rsrt"),
        join(F.reverse(a), "rev"), join(F.flatten(F.array(a, b)), "flat"), join(F.array_repeat("p_partkey", 2), "rep"), join(F.transform(F.arrays_zip(a, b), lambda z: z["a"] * 10 + z["b"]), "zip"), join(F.sequence(F.lit(1), a[0] + 1), "seq"), same.alias("same"))


@query("map_1_maps", "MAP-1", """
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, true AS has, 'k,type,value' AS keys, event_type AS type, 3 AS n, event_type || '=' || event_id AS text FROM events""")
def maps(t):
    k = F.from_json("props", "map<string,bigint>")
    e = t.events.select("event_id", "event_type", k.alias("p"), F.create_map(F.lit("type"), F.col("event_type")).alias("m"),
                        F.map_from_arrays(F.array(F.lit("value")), F.array(F.col("value").cast("string"))).alias("v"))
    every = F.map_concat(F.transform_values("p", lambda _, x: x.cast("string")), "m", "v")
    back = F.map_from_entries(F.map_entries("m"))
    text = F.str_to_map(F.concat("event_type", F.lit("="), "event_id"), F.lit(","), F.lit("="))
    return e.select("event_id", F.element_at("p", "k").alias("k"), (F.map_contains_key(every, "value")).alias("has"), F.array_join(F.sort_array(F.map_keys(every)), ",").alias("keys"), back["type"].alias("type"),
                    F.size(F.map_values(every)).alias("n"), F.concat(F.map_keys(text)[0], F.lit("="), F.map_values(text)[0]).alias("text"))


@query("hof_1_higher_order", "HOF-1", """
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda v: v * v))), 6) AS norm, round(list_sum(list_transform(range(1, 64), lambda i: e[i] * e[i + 1])), 6) AS lagdot, len(list_filter(e, lambda v: v > 0)) AS positive, list_max(list_transform(e, lambda v: abs(v))) > 0.25 AS peaked,
 list_max(e) < 1 AS below_one, round(list_sum(list_transform(e, lambda v: v * 2)), 6) AS twice, 2 AS map_n, true AS zipped FROM x""")
def higher_order(t):
    e = F.transform("embedding", lambda v: v.cast("double"))
    x = t.embeddings.select("vec_id", e.alias("e"), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2), F.lit("c"), F.lit(3)).alias("m"))
    dot = F.aggregate(F.zip_with(F.slice("e", 1, 63), F.slice("e", 2, 63), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    m = F.map_filter(F.transform_values(F.transform_keys("m", lambda k, _: F.upper(k)), lambda _, v: v * 10), lambda _, v: v > 10)
    zipped = F.map_zip_with("m", "m", lambda _, p, q: p == q)
    return x.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v, F.sqrt), 6).alias("norm"), F.round(dot, 6).alias("lagdot"), F.size(F.filter("e", lambda v: v > 0)).alias("positive"),
                    F.exists("e", lambda v: F.abs(v) > 0.25).alias("peaked"), F.forall("e", lambda v: v < 1).alias("below_one"), F.round(F.reduce(F.transform("e", lambda v: v * 2), F.lit(0.0), lambda s, v: s + v), 6).alias("twice"),
                    F.size(m).alias("map_n"), F.forall(F.map_values(zipped), lambda v: v).alias("zipped"))


@query("gen_1_generators", "GEN-1", r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM documents),
l AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part)
SELECT 'explode' AS form, count(*) AS n, count(DISTINCT word) AS d FROM w UNION ALL SELECT 'posexplode', sum(i)::BIGINT, count(DISTINCT w) FROM l UNION ALL SELECT 'outer', count(*), 0 FROM part
UNION ALL SELECT 'posouter', count(*), 0 FROM part UNION ALL SELECT 'inline', count(*) * 2, count(DISTINCT p_size) FROM part UNION ALL SELECT 'inlineouter', count(*), 0 FROM part UNION ALL SELECT 'stack', count(*) * 2, count(DISTINCT p_brand) + count(DISTINCT p_type) FROM part""")
def generators(t):
    p = t.part
    empty = F.array().cast("array<string>")
    pair = F.array(F.struct(F.lit("size").alias("k"), F.col("p_size").alias("v")), F.struct(F.lit("again").alias("k"), F.col("p_size").alias("v")))
    none = F.filter(pair, lambda s: s["v"] < 0)
    forms = {
        "explode": t.documents.select(F.explode(F.split("text", r"\s+")).alias("x")).agg(F.count("*").alias("n"), F.count_distinct("x").alias("d")),
        "posexplode": p.select(F.posexplode(F.split("p_name", " "))).agg(F.sum("pos").alias("n"), F.count_distinct("col").alias("d")),
        "outer": p.select(F.explode_outer(empty).alias("x")).agg(F.count("*").alias("n"), F.count("x").alias("d")),
        "posouter": p.select(F.posexplode_outer(empty)).agg(F.count("*").alias("n"), F.count("pos").alias("d")),
        "inline": p.select(F.inline(pair)).agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")),
        "inlineouter": p.select(F.inline_outer(none)).agg(F.count("*").alias("n"), F.count("v").alias("d")),
        "stack": p.select(F.stack(F.lit(2), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("k", "v")).agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")),
    }
    out = None
    for form, df in forms.items():
        part = df.select(F.lit(form).alias("form"), F.col("n").cast("long").alias("n"), F.col("d").cast("long").alias("d"))
        out = part if out is None else out.union(part)
    return out


@query("json_1_json", "JSON-1", """
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k') AS k_text, '{"t":"' || event_type || '","v":' || event_id || '}' AS built, 'k' AS keys, 2 AS n, 'STRUCT<k: BIGINT>' AS ddl FROM events""")
def json(t):
    e = t.events
    parsed = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    fields = e.select("event_id", "event_type", "props", F.json_tuple("props", "k").alias("k_text"))
    return fields.select("event_id", F.when(parsed["k"].cast("string") == F.get_json_object("props", "$.k"), parsed["k"]).alias("k"), "k_text",
                         F.to_json(F.struct(F.col("event_type").alias("t"), F.col("event_id").alias("v"))).alias("built"), F.array_join(F.json_object_keys("props"), ",").alias("keys"),
                         F.json_array_length(F.to_json(F.array("event_id", "event_id"))).alias("n"), F.schema_of_json(F.lit('{"k": 1}')).alias("ddl"))


@query("csv_1_csv", "CSV-1", """
SELECT c_custkey, c_custkey || ',' || c_mktsegment || ',' || c_nationkey AS line, c_mktsegment AS segment, c_nationkey AS nation, 'STRUCT<_c0: INT, _c1: STRING>' AS ddl FROM customer""")
def csv(t):
    line = F.to_csv(F.struct("c_custkey", "c_mktsegment", "c_nationkey"))
    c = t.customer.select("c_custkey", line.alias("line")).withColumn("p", F.from_csv("line", "key bigint, segment string, nation int"))
    return c.select("c_custkey", "line", F.col("p.segment").alias("segment"), F.col("p.nation").alias("nation"), F.schema_of_csv(F.lit("1,a")).alias("ddl"))
