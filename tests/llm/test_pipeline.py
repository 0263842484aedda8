"""The pipeline's stages against plain versions of what each one decides."""

import random

import corpus_pipeline
from corpusdeck.llm.decontamination import benchmark_hits
from corpusdeck.llm.toxicity import toxicity

from . import plain


def tables(spark, folder):
    r = random.Random(5)
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re")) for _ in range(r.randint(1, 4)))
    shared, items = "a line that many of these documents have", [(i, " ".join(word() for _ in range(30))) for i in range(3)]
    docs, labels = [], []
    for i in range(500):
        w = [word() for _ in range(r.randint(20, 80))]
        bad = r.random() < 0.2
        if bad:
            w[3], w[9] = "zorgo", "vaklum"
        if i % 50 == 7:
            w += items[i % 3][1].split()
        if i % 40 == 9 and docs:
            w = docs[-1][1].split()[:-1] + ["end"]
        text = " ".join(w) + (f"\n{shared}" if i % 10 == 0 else "")
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(bad)))
    docs += [(900, None, "en", None, None), (901, "", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        out = spark.read.parquet(f"{d}/out{k}")
        after = {r.doc_id: r for r in out.collect()}
        if k < 4:
            assert out.columns == columns
        if k == 0:
            bad = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 1").collect()}
            assert set(after) == set(before) - bad and len(bad) > 50 and all(after[i] == before[i] for i in after)
        elif k == 1:
            want = {x[0]: x[3] for x in plain.line_dedup([(i, r.text) for i, r in before.items()])}
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        elif k == 2:
            near = plain.components({i: s for i, r in before.items() if (s := plain.shingles(r.text))}, 80)
            assert set(after) == {i for i in before if near.get(i, i) == i} and len(after) < len(before)
        elif k == 3:
            hit = {r.doc_id for r in benchmark_hits(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
            assert hit and set(after) == set(before) - hit
        else:
            per = {}
            for r in after.values():
                per.setdefault(r.source, []).append(r)
            assert all(abs(sum(r.taken for r in rows) - rows[0].target) <= 2 and all(0 < r.taken <= 3 * r.size for r in rows) for rows in per.values())
        seen.append(name)
        docs = out
    assert seen == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, d).select("doc_id", "taken").collect()) == sorted((r.doc_id, r.taken) for r in docs.collect())
