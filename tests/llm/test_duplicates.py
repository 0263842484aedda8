import random

from corpusdeck.llm import minhash
from corpusdeck.llm.components import components
from corpusdeck.llm.minhash import near_duplicates
from corpusdeck.llm.substrings import SuffixAutomaton, removed_spans, substring_dedup  # noqa: F401

from . import plain


def words(r, n, pool=400):
    return [f"w{r.randrange(pool)}" for _ in range(n)]


def corpus(seed, n=90):
    """Texts with copies, near copies of near copies, shared passages and odd cases."""
    r, texts = random.Random(seed), []
    shared = [words(r, 30) for _ in range(3)]
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.45:
            w = r.choice(texts).split()
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                if w:
                    w[r.randrange(len(w))] = f"e{r.randrange(99)}"
        else:
            w = words(r, r.choice((0, 1, 3, 4, 5, 19, 20, 21, 60, 200)))
        if r.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = r.choice(shared)
        texts.append(r.choice((" ", "\n", " \t ")).join(w))
    long = words(r, 6000, 10**6)
    texts += [None, "", "  \n ", " ".join(long), " ".join(long[:3000] + ["x"] + long[3000:]), "w1 " * 100, "w1 " * 90, "A b C d E f", "a B c D e F", "É b c d e", "é b c d e"]
    return list(enumerate(texts))


def test_near_duplicates_against_brute_force(spark):
    for seed, percent in ((1, 85), (2, 80), (3, 60)):
        rows = corpus(seed)
        sets = {i: plain.shingles(t) for i, t in rows}
        want = plain.components({i: s for i, s in sets.items() if s}, percent)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert len(got) == len(rows)
        for x in got:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want.get(x.doc_id, x.doc_id), want.get(x.doc_id, x.doc_id) == x.doc_id)


def test_near_duplicates_of_a_large_group(spark):
    """A group far larger than any neighbourhood stays one component, and strangers stay out."""
    r = random.Random(7)
    base = words(r, 300, 10**6)
    rows = []
    for i in range(400):
        w = list(base)
        w[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words(r, 80, 10**6))) for i in range(20)]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[1000 + i] == 1000 + i for i in range(20))


def test_near_duplicates_of_hubs(spark):
    """Texts whose only links lead to one of two texts of a crowded region are found, as brute force finds them."""
    for percent, edits in ((85, 3), (80, 4)):
        r = random.Random(percent)
        base = words(r, 200, 10**6)
        second = [f"s{i}" if i in (40, 90, 140, 180) else w for i, w in enumerate(base)]
        texts = []
        for i in range(700):
            w = list(base if i % 2 else second)
            for place in r.sample(range(5, 195), edits):
                w[place] = f"x{i}_{place}"
            texts.append(w)
        rows = [(i, " ".join(w)) for i, w in enumerate([*texts, base, second])]
        r.shuffle(rows)
        want = plain.components({i: plain.shingles(t) for i, t in rows}, percent)
        got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
        assert got == want


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Small blocks give the same components, with and without rows that link with many."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "BLOCK_COLUMNS", 50)
    monkeypatch.setattr(minhash, "_with_hubs", lambda rows, links, percent: links.where("false"))
    r = random.Random(8)
    base = words(r, 120, 10**6)
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for place in r.sample(range(120), 2 if i % 3 else 5):
            w[place] = f"x{i}_{place}"
        rows.append((i, " ".join(w)))
    want = plain.components({i: plain.shingles(t) for i, t in rows}, 85)
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == want and len(set(want.values())) > 20


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 3), (9, "a b c d e f", 4), (5, None, 5)], "doc_id long, text string, kept int")
    got = sorted(tuple(x) for x in near_duplicates(df).select("doc_id", "component_id", "kept").collect() if x.doc_id is not None)
    assert got == [(4, 4, True), (4, 4, True), (5, 5, True), (9, 4, False)]
    assert near_duplicates(df).where("doc_id is null").select("component_id", "kept").collect() == [(None, True)]
    assert near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(500, 501 + i) for i in range(50)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and {got[500 + i] for i in range(51)} == {500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_automaton():
    r = random.Random(4)
    for _ in range(30):
        refs = [[r.choice((b"a", b"b", b"c")) for _ in range(r.randint(0, 25))] for _ in range(3)]
        machine = SuffixAutomaton()
        for x in refs:
            machine.add(x)
        text = [r.choice((b"a", b"b", b"c")) for _ in range(60)]
        known = {tuple(x[i : i + 4]) for x in refs for i in range(len(x) - 3)}
        assert machine.matches(text, 4) == [i for i in range(3, 60) if tuple(text[i - 3 : i + 1]) in known]


def test_substrings_against_brute_force(spark):
    for seed in (11, 12):
        rows = corpus(seed, 120)
        r = random.Random(seed)
        loop = words(r, 25)
        rows += [(5000, " ".join(loop * 4)), (5001, " ".join(loop + ["y"] + loop)), (5002, "v " * 300)]
        r.shuffle(rows)
        want = plain.substring_dedup(rows)
        got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        for x in got:
            assert (x.n_words, x.n_removed, x.text) == want[x.doc_id], x.doc_id


def test_substrings_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(None, text, 1), (2, text, 2), (2, text, 3), (7, "q " + text, 4), (8, None, 5)], "doc_id long, text string, n_words int")
    got = sorted((x.doc_id or -1, x.n_words, x.n_removed) for x in substring_dedup(df).collect())
    assert got == [(-1, 30, 0), (2, 30, 0), (2, 30, 0), (7, 31, 30), (8, 0, 0)]
    assert substring_dedup(df.where("false")).count() == 0


def test_substrings_of_different_texts_under_one_id(spark):
    passage, other = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, "a b c " + passage), (2, other), (3, other)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup(df).collect())
    assert got == [(1, 30, 0), (2, 33, 30), (2, 60, 0), (3, 60, 60)]


def test_recall_of_a_region_of_scattered_edits(spark):
    """Texts of 200 words with two to four edits each to one base: the components of brute force, whatever the seed."""
    for seed, percent in ((1, 85), (2, 80)):
        r = random.Random(seed)
        base = words(r, 200, 10**6)
        rows = []
        for i in range(600):
            w = list(base)
            for place in r.sample(range(200), r.choice((2, 3, 4))):
                w[place] = f"x{i}_{place}"
            rows.append((i, " ".join(w)))
        want = plain.components({i: plain.shingles(t) for i, t in rows}, percent)
        got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
        assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
