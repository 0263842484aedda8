import base64
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusdeck.llm import secrets
from corpusdeck.llm.decontamination import benchmark_hits, best_match, decontaminate
from corpusdeck.llm.secrets import rejections, secret_scan
from corpusdeck.llm.tokens import grams, inside, sliding, words_of

from . import plain

BASE = [
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    found = [(m.start(), i, m.end()) for i, (p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{secrets.KINDS[i]}:{a}:{b}" for a, i, b in sorted(found))


def test_base_spans_against_brute_force(spark):
    r = random.Random(1)
    pieces = ["password=", "TOKEN: ", "Api_key = '", "apikey:", "secret", "ab12", "token", "=", ":", "'", " ", "é", "😀", "\n", "AKIA" + "Z9" * 8, "AKIA123", "0123456789abcdef" * 2, "deadbeef", "x.y-z/+", "abc", "secret: token: abcdefgh"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "token=abcdefgh"), (302, "password = hunter2x " * 300), (302, "a " * 60_000 + "f" * 24), (303, "passwd=" + "k" * 50_000)]
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), base_spans(t)) for d, t in rows)
    assert sorted((str(x.doc_id), x.base_spans) for x in got) == want
    for x in got:
        kinds = [s.split(":")[0] for s in x.base_spans.split(",") if s]
        assert [kinds.count(k) for k in ("assign", "access", "hex")] == [x.n_assign, x.n_access, x.n_hex]
        assert set(filter(None, x.base_spans.split(","))) <= set(x.spans.split(","))


def test_random_tokens_are_found_and_others_left(spark):
    r = random.Random(2)
    alphabet = string.ascii_letters + string.digits
    secret = ["".join(r.choice(alphabet) for _ in range(r.choice((24, 32, 48)))) for _ in range(100)]
    secret += [base64.b64encode(bytes(r.randrange(256) for _ in range(30))).decode() for _ in range(40)]
    secret += ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(32)) for _ in range(20)]
    harmless = ["the-quick-brown-fox-jumps-over-2-lazy-dogs", "version_1_of_the_document_name", "aaaaaaaaaaaaaaaaaaaaaaaa1", "1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a", "Internationalization20Localization", "abcdefghijklmnopqrstuvwxyz0123456789", "photos/summer/holidays/beach/img1"]
    rows = [(i, f"see {s} there") for i, s in enumerate(secret)] + [(1000 + i, f"see {s} there") for i, s in enumerate(harmless * 20)]
    got = {x.doc_id: x for x in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i, s in enumerate(secret) if f"random:4:{4 + len(s)}" in got[i].spans]
    assert len(found) >= 0.95 * len([s for s in secret if any(c.isdigit() for c in s)]) - 2
    assert not [x for d, x in got.items() if d >= 1000 and x.n_random]


def test_rejections_follow_the_step_up_rule(spark):
    r = random.Random(3)
    rows = [(band, min(secrets.LAST, int(r.expovariate(0.3) if r.random() < 0.6 else r.uniform(0, 40)))) for band in (4, 5, 9) for _ in range(r.choice((3, 200)))]
    got = dict(tuple(x) for x in rejections(spark.createDataFrame(rows, "band int, step int"), 0.05).collect())
    for band in (4, 5, 9):
        steps = [s for b, s in rows if b == band]
        cuts = [s for s in set(steps) if 10 ** (-s / secrets.STEPS) <= 0.05 * sum(t >= s for t in steps) / len(steps)]
        assert got.get(band) == (min(cuts) if cuts else None)


def test_secret_scan_of_nothing(spark):
    assert secret_scan(spark.createDataFrame([], "doc_id long, text string, spans string")).count() == 0


def test_words_and_grams():
    texts = ["", "a", " a  b\tc\n", "É b\xa0c", "x" * 3_000_000 + " y", "a b c d e f g", None]
    w = words_of(pa.array(texts))
    for i, t in enumerate(texts):
        own = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert own == plain.WORD.findall(t or "")
    one, two = words_of(pa.array(["Ab ab AB"])), words_of(pa.array(["Ab ab AB"]), fold=True)
    assert len(set(one.hash.tolist())) == 3 and len(set(two.hash.tolist())) == 1
    sliced = pa.array(["zz", "b c d e", "q"]).slice(1, 2)
    assert (words_of(sliced).hash[:4] == words_of(pa.array(["a b c d e"])).hash[1:]).all()
    g, at = grams(w.hash, 3), inside(w.first, 3)
    assert len(at) == sum(max(0, len(plain.WORD.findall(t or "")) - 2) for t in texts) and len(set(g[at].tolist())) == len(at) - 1
    x = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 5, 13, 50):
        assert sliding(x, width).tolist() == [x[i : i + width].min() for i in range(51 - width)]
    assert len(sliding(x, 51)) == 0


def test_best_match_against_dynamic_programming():
    r = random.Random(5)
    for _ in range(200):
        pattern, text = ([r.randrange(4) for _ in range(n)] for n in (r.randint(1, 12), r.randint(0, 30)))
        assert best_match(pattern, text)[0] == plain.edit_distance_within(pattern, text)


def test_hits_against_brute_force(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 3, 8, 14, 20, 35, 60))] + [(8, None), (9, ""), (10, "!?"), (None, "w1 w2")]
    rows = []
    for d in range(150):
        w = [word() for _ in range(r.choice((0, 5, 40, 200)))]
        for _ in range(r.choice((0, 1, 2))):
            copy = items[r.randrange(7)][1].split()
            for _ in range(r.choice((0, 0, 1, 3, 8))):
                at, edit = r.randrange(len(copy)), r.randrange(3)
                copy[at : at + (edit > 0)] = [word()] if edit < 2 else []
                copy = copy or ["w0"]
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + r.choice(("", ",", ".")) for x in copy]
        rows.append((d, r.choice((" ", "\n", " - ")).join(w)))
    rows += [(200, None), (201, ""), (None, items[3][1]), (202, "z " * 40_000 + items[4][1])]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in items:
        pattern = re.findall("[a-z0-9]+", (text or "").lower())
        if not pattern:
            continue
        for d, t in rows[:-1]:
            best = plain.edit_distance_within(pattern, re.findall("[a-z0-9]+", (t or "").lower()))
            if best <= int(0.2 * len(pattern)):
                want[d, i] = best
    want[202, 4] = 0
    got = {(x.doc_id, x.item_id): x.distance for x in benchmark_hits(docs, tests).collect()}
    assert {k: v for k, v in got.items() if k[0] != 202} == {k: v for k, v in want.items() if k[0] != 202} and got[202, 4] == 0
    long = tests.where(F.length("text") > 20)
    hit = {x.doc_id for x in benchmark_hits(docs, long).collect()}
    left = decontaminate(docs.withColumn("distance", F.lit(1)), long)
    assert left.columns == ["doc_id", "text", "distance"]
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(d) for d, _ in rows if d not in hit)
    assert benchmark_hits(docs.where("false"), tests).count() == 0 and benchmark_hits(docs, tests.where("false")).count() == 0
