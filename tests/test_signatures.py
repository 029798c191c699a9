"""Signatures: rows that share a key are one text, and its tokens are added up before anything is shuffled."""

from pyspark.sql import functions as F

from siteval.operators.groups import signature64


def test_tokens_are_added_up_in_one_aggregation(spark):
    words = [f"w{i % 7}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:150])), (2, " ".join(words[150:])), (3, None), (4, "  ")]
    got = signature64(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    sig = {r.id: r.sig for r in got.collect()}
    assert sig[1] == sig[2] != 0 and sig[3] == sig[4] == 0
