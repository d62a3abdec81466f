"""User-defined types: unwrapping ML vectors into plain structs."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from joulemill.registry import query


@query("udf_0_unwrap", "UDF-0", "SELECT vec_id, 64 AS n, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 5) AS total FROM embeddings")
def unwrap(t):
    x = t.embeddings.select("vec_id", array_to_vector("embedding").alias("v"))
    values = F.unwrap_udt("v")["values"]
    total = F.aggregate(vector_to_array("v"), F.lit(0.0), lambda s, e: s + e)
    return x.select("vec_id", F.size(values).alias("n"), F.round(total, 5).alias("total"))
