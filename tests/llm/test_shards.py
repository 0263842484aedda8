import random
import zlib
from collections import Counter, defaultdict

from corpusdeck.llm import queries, shards
from corpusdeck.llm.shards import kd_shards, write_shards

SCHEMA = "doc_id long, text string, lang string, source string"


def rows(n=3000, seed=1):
    """A hot source, a group of copies with a quarter of the bytes, small groups across sources, odd rows."""
    r = random.Random(seed)
    out = [(i, "".join(r.choice("ab é") for _ in range(r.choice((0, 5, 60, 400)))), r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "s1", "s2", "s3", None])) for i in range(n)]
    out += [(n + i, "the same long text " * 8, r.choice(["en", "de"]), r.choice(["hot", "s1"])) for i in range(n // 2)]
    out += [(2 * n + 3 * g + i, f"small group {g}", "en", f"s{i}") for g in range(60) for i in range(3)]
    return out + [(None, None, None, None), (None, "x", "en", "s1"), (5, out[5][1], "en", "s9"), (5, out[5][1], "en", "s9")]


def size(x):
    return len((x[1] or "").encode()) + 16


def check(given, got, count):
    """The contract of rows, sizes, checksums and slots; returns bytes per shard."""
    want = Counter((d, size((d, t)), zlib.crc32((t or "").encode())) for d, t, *_ in given)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == want
    slots, load = defaultdict(list), Counter({i: 0 for i in range(count)})
    for x in got:
        slots[x.shard].append(x.slot)
        load[x.shard] += x.size
    assert set(slots) <= set(range(count)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_shards_are_near_equal_and_groups_stay_together(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA)
    got = kd_shards(df).collect()
    load = check(given, got, 40)
    target = sum(load.values()) / 40
    assert max(load.values()) <= 1.06 * target and min(load.values()) >= 0.94 * target
    text = {x[0]: x[1] for x in given}
    where = defaultdict(set)
    for x in got:
        where[text.get(x.doc_id) if x.doc_id is not None else x.size].add(x.shard)
    assert all(len(where[f"small group {g}"]) == 1 for g in range(60))  # though their sources differ
    copies = sum(size(x) for x in given if (x[1] or "").startswith("the same"))
    assert copies / target <= len(where["the same long text " * 8]) <= copies / target + 3  # as many shards as it takes


def test_every_cut_is_a_weighted_median_of_the_widest_line(spark):
    given = rows(1200, seed=3)
    df = spark.createDataFrame(given, SCHEMA)
    keyed = shards._keyed(shards._described(df, ("source", "lang"), "doc_id", "text", ["doc_id"]), 3)
    table = keyed.collect()
    root = shards._grow(keyed, 3, 16)
    limit = sum(x["size"] for x in table) / 16 / 200
    assert len(list(root.leaves())) == 16

    def visit(node, part):
        if not node.sides:
            return
        ends = [(min(c), max(c)) for c in ([x[f"_k{i}"] // (1 << 31) for x in part] for i in range(3))]
        spread = [b - a for a, b in ends]
        assert spread[node.line] == max(spread)
        place = lambda x: (x[f"_k{node.line}"], x["_r"])
        left = [x for x in part if place(x) < (node.key, node.row)]
        right = [x for x in part if place(x) >= (node.key, node.row)]
        goal = sum(x["size"] for x in part) * (node.shards // 2) / node.shards
        next_to = max([x["size"] for x in sorted(part, key=place)[max(0, len(left) - 2) : len(left) + 2]])
        assert abs(sum(x["size"] for x in left) - goal) <= max(limit, next_to)
        visit(node.sides[0], left)
        visit(node.sides[1], right)

    visit(root, table)


def test_large_documents_few_rows_and_empty_tables(spark):
    given = [(1, "x" * 100_000, "en", "a"), *((i, "y" * 1000, "en", "a") for i in range(2, 102))]
    load = check(given, kd_shards(spark.createDataFrame(given, SCHEMA), shards=4).collect(), 4)
    assert sorted(load.values())[-1] == 100_016 and min(load.values()) >= 0.95 * 101_600 / 3  # the large one alone
    given += [(200 + i, "x" * 100_000, "en", "a") for i in range(5)] + [(1, "x" * 100_000, "en", "a")]
    check(given, kd_shards(spark.createDataFrame(given, SCHEMA), shards=9).collect(), 9)
    few = [(1, "a", "en", "a"), (2, None, None, None), (3, "a", "en", "a")]
    assert sum(check(few, kd_shards(spark.createDataFrame(few, SCHEMA)).collect(), 40).values()) == 50
    same = [(1, "a", "en", "a")] * 9
    check(same, kd_shards(spark.createDataFrame(same, SCHEMA)).collect(), 40)
    empty = kd_shards(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "lang", "source", "size", "text_crc32", "shard", "slot"]


def test_target_bytes_numeric_dimensions_and_clashing_names(spark):
    r = random.Random(8)
    given = [(i, "w" * r.randint(0, 300), r.choice([None, float("nan"), float("inf"), r.random() * 1e300, -1e300]), i % 7, "keep", None) for i in range(800)]
    df = spark.createDataFrame(given, "doc_id long, text string, when double, _k0 int, _r string, slot string")
    out = kd_shards(df, shards=None, target_bytes=15_000, dims=("when", "_k0"))
    assert out.columns == ["doc_id", "when", "_k0", "_r", "size", "text_crc32", "shard", "slot"]
    got = out.collect()
    count = -(-sum(map(size, given)) // 15_000)
    load = check(given, got, count)
    assert max(load.values()) <= 16_000 and {x["_r"] for x in got} == {"keep"} and all(x["_k0"] == x.doc_id % 7 for x in got)


def test_written_shards_and_many_slot_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SLOT_ROWS", 10)
    given = rows(600, seed=5)
    df = spark.createDataFrame(given, SCHEMA)
    got = kd_shards(df, shards=8).collect()
    check(given, got, 8)
    again = kd_shards(df.repartition(7), shards=8).collect()
    assert {(x.doc_id, x.shard, x.slot) for x in got} == {(x.doc_id, x.shard, x.slot) for x in again}
    write_shards(df, f"{tmp_path}/out", shards=8)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((x.doc_id, x.text, x.lang, x.source) for x in back.collect()) == Counter(given)
    assert Counter((x.doc_id, x.shard) for x in back.collect()) == Counter((x.doc_id, x.shard) for x in got)


def test_query(spark, tmp_path):
    given = rows(400, seed=9)
    spark.createDataFrame(given, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_sharding(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    check(given, got, 40)
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}
