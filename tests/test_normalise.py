"""Lines without marks skip the patterns that take marks away."""

from pyspark.sql import functions as F

from corpusdeck.functions.text import normalise


def test_normalise_looks_for_a_mark_first(spark):
    rows = spark.createDataFrame([("a  b ",), ("**a** b",), ("`x` _y_",), ("end \\",), ("",), ("a*b",)], "t string").select(normalise(F.col("t")).alias("n"))
    assert [x.n for x in rows.collect()] == ["a b", "a b", "x y", "end", "", "a*b"]
    assert "CASE WHEN" in rows._jdf.queryExecution().optimizedPlan().toString() or "CASE WHEN" in rows._jdf.queryExecution().analyzed().toString()
