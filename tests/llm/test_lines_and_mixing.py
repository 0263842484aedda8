import random
from collections import Counter

from corpusdeck.llm.line_dedup import line_dedup
from corpusdeck.llm.mixing import mix_sources, water_fill

from . import plain

LONG = "a line that is long enough to count"


def test_lines_against_brute_force(spark):
    r = random.Random(1)
    pool = [LONG, LONG.upper() + " ", "  " + LONG, "short", "", "Émile écrit une longue ligne ici", "ÉMILE écrit une longue ligne ici", "\t" + LONG + "\x0b", LONG + "\xa0"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, LONG), (None, None), (5, rows[5][1]), (63, "\n".join([LONG] * 3000 + ["x " * 50_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup(df).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert Counter(tuple(x) for x in got) == Counter(plain.line_dedup(rows))


def test_lines_count_distinct_documents(spark):
    """Variants of a line in one document, and rows that repeat an id, are one document each."""
    two = [(1, f"  {LONG}\n{LONG}\n{LONG} \r"), (2, LONG)]
    repeated = [(11, "another line that is long enough"), (11, "another line that is long enough"), (12, "another line that is long enough")]
    three = [(21, "a third line that is long enough\n\ta third line that is long enough"), (22, "A third line that is long enough"), (23, "a third line that is long enough ")]
    got = {(x.doc_id, x.n_dropped) for x in line_dedup(spark.createDataFrame(two + repeated + three, "doc_id long, text string")).collect()}
    assert got == {(1, 0), (2, 0), (11, 0), (12, 0), (21, 2), (22, 1), (23, 0)}


def test_lines_keep_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, LONG, 7, "x"), (2, LONG, 8, "y"), (3, LONG, 9, "z")], "doc_id long, text string, n_lines int, _dropped string")
    out = {x.doc_id: x for x in line_dedup(df).collect()}
    assert (out[1].text, out[1].n_lines, out[1].n_dropped) == ("", 1, 1) and out[3].text == LONG
    assert line_dedup(df.where("false")).count() == 0


def fill(parts):
    """parts: [(weight, size)], by clamping and resharing until nothing changes."""
    total, full = sum(s for _, s in parts), set()
    while True:
        left = total - sum(3 * parts[i][1] for i in full)
        weight = sum(w for i, (w, _) in enumerate(parts) if i not in full)
        target = [3.0 * s if i in full else w * left / weight for i, (w, s) in enumerate(parts)]
        more = {i for i, (w, s) in enumerate(parts) if i not in full and target[i] > 3 * s}
        if not more:
            return target
        full |= more


def test_water_filling(spark):
    r = random.Random(2)
    for n in (1, 2, 5, 9):
        parts = [(r.choice((5, 2, 1)), r.choice((0, 1, 10, 1000))) for _ in range(n)]
        if not sum(s for _, s in parts):
            parts[0] = (parts[0][0], 3)
        df = spark.createDataFrame([(f"s{i}", w, s) for i, (w, s) in enumerate(parts)], "source string, weight long, source_size long")
        got = {x.source: x.target for x in water_fill(df).collect()}
        for i, want in enumerate(fill(parts)):
            assert abs(got[f"s{i}"] - want) < 1e-6, (parts, got)


def test_mix_meets_targets_and_repeats(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.choice((0, 1, 7, 300)), r.choice(["a", "b", "c", None]), 1.0) for i in range(900)] + [(900, None, "a", 0.0), (None, "w w", "z", 0.0), (3, "w", "a", 0.0), (3, "w", "a", 0.0), (901, "w " * 20_000, "b", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    one = mix_sources(df, bucket_docs=64)
    key = lambda x: str((x.doc_id, x.source, x.size, x.taken))
    got = sorted(one.collect(), key=key)
    again = sorted(mix_sources(df.repartition(7), bucket_docs=64).collect(), key=key)
    assert got == again and len(got) == len(rows)
    assert one.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    for source in ("a", "b", "c", None, "z"):
        own = [x for x in got if x.source == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 1 + len(own) / 32
        assert all(0 <= x.taken <= 3 * x.size for x in own) and own[0].source_size == sum(x.size for x in own)
    assert mix_sources(df.where("false")).count() == 0
    assert {x.taken for x in mix_sources(df.where("text is null")).collect()} == {0}


def test_columns_of_the_operators_own_names_stay(spark):
    row = (1, LONG, "a", 1, 2, 3, 4, 5)
    df = spark.createDataFrame([row, row], "doc_id long, text string, source string, _doc int, _lines int, _borders int, _order int, _bucket int")
    for out in (line_dedup(df), mix_sources(df)):
        assert [tuple(x)[3:8] for x in out.collect()] == [(1, 2, 3, 4, 5)] * 2


def test_mix_spreads_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, f"w {i}", "a") for i in range(400)] + [(7, "w w w", "b")], "doc_id long, text string, source string")
    got = mix_sources(df, bucket_docs=16).where("source = 'a'").collect()
    assert abs(sum(x.taken for x in got) - got[0].target) <= 1 + 400 / 8
