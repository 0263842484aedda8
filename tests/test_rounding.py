"""Rounding to the even neighbour goes by the binary number, as DuckDB's does."""

import random

import duckdb

from corpusdeck.functions.text import round_even


def test_round_even_as_duckdb(spark):
    rng = random.Random(7)
    values = [rng.randint(1, 400) / rng.randint(1, 3000) * 10 for _ in range(3000)] + [k / 200 for k in range(2000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    for places in (0, 1, 2, 4):
        got = [x.r for x in rows.select("i", round_even("v", places).alias("r")).orderBy("i").collect()]
        want = [x[0] for x in duckdb.execute(f"SELECT round_even(v, {places}) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
        assert got == want, places
