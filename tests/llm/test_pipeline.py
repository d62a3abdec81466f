"""The pipeline's stages, one by one, against plain Python, and the run as a whole."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from joulemill.llm import mixing, packing, quality
from joulemill.llm.registry import table
from tests.llm.test_documents import brute_components, check_sequences, odd, documents  # noqa: F401


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    given = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.judge(docs, table(spark, folder, "labels")).filter("kept").collect()}
    state = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).toPandas(), docs.schema)
        assert docs.columns == pipeline.DOCUMENT
        state[name] = docs.collect()
    assert {r["doc_id"] for r in state["quality_rules"]} == kept and 0 < len(kept) < len(given)
    roots = brute_components([(r["doc_id"], r["text"]) for r in state["quality_rules"]])
    assert {r["doc_id"] for r in state["near_dedup"]} == {root for _, root in roots.values()} < kept
    assert len(state["pii"]) == len(state["near_dedup"])
    changed = [r for r in state["pii"] if r["text"] != given[r["doc_id"]]["text"]]
    assert changed and all(r["n_chars"] == len(r["text"]) for r in state["pii"])
    before = spark.createDataFrame(state["pii"], docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.counted(before).collect()}
    assert Counter(r["doc_id"] for r in state["mixing"]) == Counter({i: n for i, n in copies.items() if n})
    last = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tokens = sum(len(p["ids"]) // 4 for p in packing.tokenise(docs, packing.vocabulary()).collect())
    assert sum(r["length"] for r in last) == tokens
    check_sequences(last)


def test_run(spark, folder):
    got = pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_rows(spark, folder, odd, name, stage):  # noqa: F811
    """Null, empty, blank and long texts, ties, repeated rows and ids, and extra columns with clashing names; then tables without anything."""
    clashing = odd.withColumn("_found", F.lit(1)).withColumn("_s", F.lit(2)).withColumn("_w", F.lit(3)).withColumn("_rate", F.lit(4)).withColumn("a.b", F.lit(5))
    got = stage(spark, clashing, folder)
    n = got.count()
    if name == "quality_rules":
        assert {r["doc_id"] for r in got.collect()} <= {6} and n == quality.judge(odd, table(spark, folder, "labels")).filter("kept").count()  # only the long text has fifty words
    elif name == "near_dedup":
        kept = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert sum(t == "same text here, twice" for _, t in kept) == 1 and sum(not (t or "").strip() for _, t in kept) == 3 and (None, "no id at all") in kept
    elif name == "pii":
        assert n == clashing.count() and got.filter("text is null and n_chars is null").count() == 1
    elif name == "packing":
        check_sequences(got.collect())
    assert name == "packing" or got.columns == pipeline.DOCUMENT
    assert stage(spark, clashing.limit(0), folder).count() == 0
    blank = documents(spark, [None, "", None])
    assert stage(spark, blank, folder).count() == {"quality_rules": 0, "mixing": 0}.get(name, 3)
