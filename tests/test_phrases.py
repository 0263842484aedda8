"""Phrases of a text are found in one scan; patterns that are asked for less often find the same."""

import random

from pyspark.sql import functions as F

from corpusdeck import dims
from corpusdeck.functions.text import phrases_in
from corpusdeck.operators import signals as G
from corpusdeck.operators.classify import add_intents


def test_phrases_in_one_scan(spark):
    rng = random.Random(3)
    texts = ["", "processes", "as a resultof", "conconcern", "q:", "e.g.", "if\tno", *[" ".join(rng.choice(G.PHRASES)[: rng.randint(1, 20)] for _ in range(9)) for _ in range(200)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", phrases_in(F.col("t"), G.PHRASES).alias("found")).collect()
    for x in rows:
        assert sorted(x.found) == [p for p in G.PHRASES if p in x.t], x.t


def test_a_text_is_not_searched_phrase_by_phrase(spark):
    """Hundreds of searches over a whole text were most of the time of signals and intents."""
    units = spark.createDataFrame([(1, 0, "Title", "A process because of it.")], "doc_id long, unit_id int, title string, text string")
    plan = add_intents(G.add_signals(units)).select("_intents", *G.KINDS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(_low_text") + plan.count("Contains(_lowered") == 0 and plan.count("(?=((?:") == 1


def test_definitions_between_points_as_over_the_whole_text(spark):
    rng = random.Random(5)
    words = ["Cell", "a unit", "means", "is a", "is", "refers to", ". ", ".", ".x", "1.5", ": ", "—  ", "\n", "of", "dogs.", "so", "An area", "\t", "is defined as", "3"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 25))) for _ in range(400)]
    text = F.col("t")
    whole = F.regexp_extract_all(text, F.lit(dims.DEFINITION), F.lit(0))
    parts = F.flatten(F.transform(F.filter(F.split(text, dims.DEFINITION_END), lambda x: x.rlike(dims.DEFINITION_CUE)), lambda x: F.regexp_extract_all(x, F.lit(dims.DEFINITION), F.lit(0))))
    cued = (F.size(F.array_intersect(phrases_in(F.lower(text), G.PHRASES), F.array(*map(F.lit, G.DEFINITION_CUES)))) > 0) | text.rlike(r"[iI][sS]\s+[aA][nN]?\s")
    for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", whole.alias("whole"), parts.alias("parts"), cued.alias("cued")).collect():
        assert x.whole == x.parts and (x.cued or not x.whole), x.t
