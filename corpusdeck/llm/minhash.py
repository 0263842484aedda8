"""MinHash near-dedup with an LSH forest.

Equal shingle sets are first folded into classes. The signature of each class is put into several orders
(the trees). In each order the classes are range-sorted over the whole table, and sorted neighbours that
share a prefix of min_depth values are candidates: where many share it, the neighbours are those with the
longest common prefix, so the depth adapts to the region. Candidates are confirmed on their full sets.
Where more rows share a prefix than neighbours meet, those of different components are then held against
the row with the most links, and what is still apart against all rows of the prefix, in blocks of both
sides: so all classes that share a prefix in any tree, and are not linked otherwise, have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored
from .components import components
from .tokens import U64, Words, chunks, grams, inside, mix, words_of

#: Trees of the forest and values of a sorted key. Each tree's first MIN_DEPTH values are its own, so a
#: link of similarity s is missed with probability (1 - s ** MIN_DEPTH) ** TREES: 4e-7 at 0.85, 3e-5 at 0.8.
#: The values beyond only order a region, a byte of each is enough; deep keys bring the most similar
#: classes of even a very large region together.
TREES, MIN_DEPTH, DEPTH = 20, 4, 28
#: How many neighbours before it in an order each class is held against.
NEIGHBOURS = 6
#: Rows and shingles of a block (a larger set is a block of its own), and columns of a matrix of blocks.
BLOCK_ROWS, BLOCK_SHINGLES, BLOCK_COLUMNS = 2048, 1_000_000, 4096
#: Trees of the first round; the others' candidates are confirmed only between different components.
FIRST_TREES = 2

_VALUES = TREES * MIN_DEPTH
_XOR, _MULTIPLY = mix(np.arange(1, _VALUES + 1, dtype=U64)), mix(np.arange(1, _VALUES + 1, dtype=U64) + U64(1 << 32)) | U64(1)
#: Bytes of a key: whole values first, then a byte of each further one.
_PREFIX = MIN_DEPTH * 4
_KEY = _PREFIX + DEPTH - MIN_DEPTH


def _orders() -> list[tuple[np.ndarray, np.ndarray]]:
    """Each tree's own signature values, and the others that go on ordering it."""
    r, out = np.random.default_rng(1), []
    for t in range(TREES):
        own = np.arange(t * MIN_DEPTH, (t + 1) * MIN_DEPTH)
        out.append((own, r.permutation(np.setdiff1d(np.arange(_VALUES), own))[: DEPTH - MIN_DEPTH]))
    return out


_ORDERS = _orders()


def _spread() -> Column:
    """A further grouping column keeps an aggregate's partitioning from being the join's, so adaptive execution can split its hot prefixes."""
    return F.pmod(F.xxhash64("prefix"), F.lit(1024)).alias("_spread")


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one text after the other, and their n + 1 offsets."""
    count, n = words.count(), len(words.first) - 1
    values = grams(words.hash, k)[inside(words.first, k)] if len(words.hash) >= k else np.zeros(0, U64)
    at = np.concatenate(([0], np.cumsum(np.maximum(count - k + 1, 0))))
    sets = []
    for i in range(n):
        if count[i] >= k:
            sets.append(np.unique(values[at[i] : at[i + 1]]))
        elif count[i]:
            sets.append(mix(grams(words.hash[words.first[i] : words.first[i + 1]], int(count[i])) + U64(count[i])))
        else:
            sets.append(np.zeros(0, U64))
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), offsets


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values, at = shingle_sets(words_of(batch.column(1), fold=True), k)
            full = np.flatnonzero(np.diff(at))
            sums = np.zeros((2, batch.num_rows), U64)
            signature = np.zeros((batch.num_rows, _VALUES), ">u4")
            if len(full):
                begin = at[:-1][full]
                for j in range(2):
                    sums[j, full] = np.add.reduceat(mix(values + U64(j + 1)), begin)
                for j in range(_VALUES):
                    signature[full, j] = np.minimum.reduceat((values ^ _XOR[j]) * _MULTIPLY[j], begin) >> U64(32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                ],
                ["doc_id", "n_shingles", "s1", "s2", "signature"],
            )

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, signature) to a sorted key per tree."""
    for whole in batches:
        for row in range(0, whole.num_rows, 2000):
            batch = whole.slice(row, 2000)
            signature = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(batch.num_rows, _VALUES)
            for t in range(TREES):
                own, more = _ORDERS[t]
                whole_values = np.ascontiguousarray(signature[:, own]).view(np.uint8)
                keys = np.ascontiguousarray(np.concatenate((whole_values, (signature[:, more] & 255).astype(np.uint8)), axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array([x.tobytes() for x in keys], pa.binary()), batch.column(0), batch.column(1)],
                    ["tree", "key", "rep", "n"],
                )


def _neighbours(percent: int):
    """Candidates between near rows of a sorted partition, and the rows at its borders.

    Output rows are candidate pairs (a, b, tree, prefix), or for the NEIGHBOURS rows at either end of a partition
    (border, rep, n, tree, prefix): border p lies between partitions p - 1 and p. Rows of a prefix that
    more than half of NEIGHBOURS rows share come as (rep, n, tree, prefix) too, some more than once: with
    the border rows these are all rows of each prefix that more than NEIGHBOURS + 1 rows share.
    """
    def table(**columns) -> pa.RecordBatch:
        n = len(columns["tree"])
        kinds = {"a": pa.int64(), "b": pa.int64(), "tree": pa.int32(), "border": pa.int32(), "side": pa.int32(), "prefix": pa.binary(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        tail: list[np.ndarray] | None = None
        head = True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, _KEY)
            prefix = keys[:, :_PREFIX].copy().view(np.uint64)
            new = [np.asarray(batch.column(0)), prefix, np.asarray(batch.column(2)), np.asarray(batch.column(3))]
            if head:
                top = [x[:NEIGHBOURS] for x in new]
                size = len(top[0])
                yield table(tree=top[0], a=top[2], n=top[3], prefix=[x.tobytes() for x in top[1]], border=[place] * size, side=[1] * size)
                head = False
            fresh = len(tail[0]) if tail else 0
            rows = [np.concatenate((x, y)) for x, y in zip(tail, new, strict=True)] if tail else new
            tree, prefix, rep, n = rows
            for step in range(1, NEIGHBOURS + 1):
                i = np.arange(max(step, fresh), len(tree))
                j = i - step
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                ok = (tree[i] == tree[j]) & (prefix[i] == prefix[j]).all(axis=1) & (100 * small >= percent * large)
                i, j = i[ok], j[ok]
                if len(i):
                    yield table(a=np.minimum(rep[i], rep[j]), b=np.maximum(rep[i], rep[j]), tree=tree[i], prefix=[x.tobytes() for x in prefix[i]])
            half = NEIGHBOURS // 2
            i = np.arange(max(half, fresh), len(tree))
            i = i[(tree[i] == tree[i - half]) & (prefix[i] == prefix[i - half]).all(axis=1)]
            if len(i):
                i = np.unique(i[:, None] - np.arange(half + 1))
                yield table(tree=tree[i], a=rep[i], n=n[i], prefix=[x.tobytes() for x in prefix[i]])
            tail = [x[-NEIGHBOURS:] for x in rows]
        if tail:
            size = len(tail[0])
            yield table(tree=tail[0], a=tail[2], n=tail[3], prefix=[x.tobytes() for x in tail[1]], border=[place + 1] * size, side=[0] * size)

    return run


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, tree): pairs of class representatives that are neighbours in a tree, the first such tree; and
    (tree, prefix, rep, n): all rows of the prefixes whose rows did not all meet as neighbours.

    Neighbours in such a prefix are pairs in the first FIRST_TREES trees alone: those of the other trees are
    left to the comparison of all its rows, which moves a text once a block and not once a pair.
    """
    keys = classes.select("rep", "n", "signature").mapInArrow(_trees, "tree int, key binary, rep long, n long")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "key", "rep"]
    found = cut(
        keys.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_neighbours(percent), "a long, b long, tree int, border int, side int, prefix binary, n long")
    )
    border = found.where("border is not null").select("border", "side", "tree", "prefix", F.col("a").alias("rep"), "n")
    left = border.where("side = 0").select("border", "tree", "prefix", F.col("rep").alias("l"), F.col("n").alias("ln"))
    right = border.where("side = 1").select("border", "tree", "prefix", F.col("rep").alias("r"), F.col("n").alias("rn"))
    across = left.join(right, ["border", "tree", "prefix"]).where((F.col("l") != F.col("r")) & (100 * F.least("ln", "rn") >= percent * F.greatest("ln", "rn")))
    pairs = found.where("b is not null").select("a", "b", "tree", "prefix").unionAll(across.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "tree", "prefix"))
    place = F.col("border") - 1 + F.col("side")
    rows = found.where("b is null").groupBy("tree", "prefix", F.col("a").alias("rep")).agg(F.max("n").alias("n"), F.max(place).alias("place"))
    # Rows of fewer also pass each other by if a partition with fewer than NEIGHBOURS rows, or none, lies between.
    crowded = rows.groupBy("tree", "prefix", _spread()).agg(F.count(F.lit(1)).alias("m"), F.min("place").alias("lo"), F.max("place").alias("hi")).where((F.col("m") > NEIGHBOURS + 1) | (F.col("hi") > F.col("lo") + 1))
    crowded = stored(crowded.select("tree", "prefix"))
    runs = rows.join(crowded, ["tree", "prefix"]).select("tree", "prefix", "rep", "n")
    early = pairs.where(F.col("tree") < FIRST_TREES).select("a", "b", "tree")
    late = pairs.where(F.col("tree") >= FIRST_TREES).join(crowded, ["tree", "prefix"], "left_anti").select("a", "b", "tree")
    return early.unionAll(late).where("a <> b").groupBy("a", "b").agg(F.min("tree").alias("tree")), runs


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ta"):
            (x, xa), (y, ya) = (shingle_sets(words_of(batch.column(i), fold=True), k) for i in (2, 3))
            links = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                both = np.concatenate((x[xa[i] : xa[i + 1]], y[ya[i] : ya[i + 1]]))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                links[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select([0, 1]).filter(pa.array(links))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts has (doc_id, text)."""
    one = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(_confirm(k, percent), "a long, b long").distinct()


def _meet(runs: DataFrame, label: DataFrame) -> DataFrame:
    """runs with each row's component, without prefixes whose rows are all in one."""
    rows = runs.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = rows.groupBy("tree", "prefix", _spread()).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return stored(rows.join(apart.select("tree", "prefix"), ["tree", "prefix"]).select("tree", "prefix", "rep", "n", "component"))


def _with_hubs(rows: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(a, b): each row of a prefix with the prefix' row of the most links, if they are in different components."""
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    ranked = rows.join(degree, "rep", "left")
    hub = ranked.groupBy("tree", "prefix", _spread()).agg(F.max_by(F.struct("rep", "n", "component"), F.struct(F.coalesce("degree", F.lit(0)), -F.col("rep"))).alias("h"))
    met = rows.join(hub.select("tree", "prefix", "h"), ["tree", "prefix"])
    alike = 100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n")
    return met.where((F.col("component") != F.col("h.component")) & alike).select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b")).distinct()


def _block_links(k: int, percent: int):
    """Links between the two blocks of a cell, or in its one, as (a, b): each row with a row it is connected to."""

    def run(cell: pa.Table) -> pa.Table:
        rep, side, component = (cell.column(c).to_numpy() for c in ("rep", "side", "component"))
        text = cell.column("text").combine_chunks()
        values, at = shingle_sets(words_of(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks), fold=True), k)
        size, owner = np.diff(at), np.repeat(np.arange(len(rep)), np.diff(at))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if cell.column("two")[0].as_py() else left
        links = np.zeros((len(left), len(right)), bool)
        if len(left) and len(right):
            _, column, times = np.unique(values, return_inverse=True, return_counts=True)
            shared = times[column] > 1
            owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            common = np.zeros(links.shape, np.int64)
            for first in range(0, int((times > 1).sum()), BLOCK_COLUMNS):
                lo, hi = np.searchsorted(column, (first, first + BLOCK_COLUMNS))
                has = np.zeros((len(rep), min(BLOCK_COLUMNS, int(column[-1]) + 1 - first)), np.float32)
                has[owner[lo:hi], column[lo:hi] - first] = 1
                common += (has[left] @ has[right].T).astype(np.int64)
            links = (100 * common >= percent * (size[left][:, None] + size[right] - common)) & (component[left][:, None] != component[right])
        i, j = (x[y] for x, y in zip((left, right), np.nonzero(links), strict=True))
        least = np.arange(len(rep))
        while True:
            new = least.copy()
            np.minimum.at(new, i, least[j])
            np.minimum.at(new, j, least[i])
            if (new == least).all():
                break
            least = new
        found = np.flatnonzero(least != np.arange(len(rep)))
        return pa.table({"a": rep[least[found]], "b": rep[found]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _all_links(rows: DataFrame, plain: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between different components of all rows that share a prefix.

    A prefix' largest component needs no comparison with itself, the others meet it and each other. The rows
    of all prefixes with the same largest component are taken together, as trees repeat each other's pairs.
    Both parts are dealt into blocks of bounded size, and each pair of blocks is one cell, compared on full sets.
    """
    key = ["tree", "prefix"]
    counts = rows.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("m"))
    mains = counts.groupBy(*key, _spread()).agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    dealt = stored(rows.join(mains.select(*key, "main"), key).select("main", "rep", "n", "component").distinct().withColumn("other", F.col("component") != F.col("main")))

    def blocks(mine: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(mine) / BLOCK_ROWS, F.sum(F.when(mine, F.col("n"))) / BLOCK_SHINGLES)).cast("int")

    totals = dealt.groupBy("main", F.pmod(F.xxhash64("main"), F.lit(1024)).alias("_spread")).agg(blocks(F.col("other")).alias("p"), blocks(~F.col("other")).alias("q"))
    dealt = dealt.join(totals.select("main", "p", "q"), "main")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("other"), F.col("p")).otherwise(F.col("q")).cast("long")).cast("int"))
    cell = lambda i, j, two, side: F.struct(i.alias("i"), j.alias("j"), two.alias("two"), side.alias("side"))
    yes, no, zero, one, own = F.lit(True), F.lit(False), F.lit(0), F.lit(1), F.col("block")
    others = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda x: cell(F.least(own, x), F.greatest(own, x), x != own, F.when(own > x, one).otherwise(zero)))
    # Blocks of the largest component are numbered after those of the others.
    main = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda x: cell(own, F.col("p") + x, yes, zero))
    met = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda x: cell(x, F.col("p") + own, yes, one))
    placed = dealt.withColumn("c", F.explode(F.when(F.col("other"), F.concat(others, main)).otherwise(met)))
    placed = placed.select("main", "c.i", "c.j", "c.two", "c.side", "rep", "component")
    texts = plain.join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text").distinct()
    return placed.join(texts, "rep").groupBy("main", "i", "j").applyInArrow(_block_links(k, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs.

    Words are split at ASCII white space, with A-Z lower-cased; a text's set has its distinct k-word
    shingles, or its whole word sequence if it has fewer words. Sets are linked if 100 * intersection >=
    percent * union, and component_id is the smallest id that links reach. Texts without words (null too)
    have an empty set and link with nothing. Rows with a null id link with nothing, have a null component
    and are kept. Rows that repeat an id are one document for links; each gets its row. An empty table
    gives an empty table; other columns of docs play no part.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(plain.mapInArrow(_signatures(k), "doc_id long, n_shingles long, s1 long, s2 long, signature binary"))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("s1", "s2", F.pmod("s1", F.lit(1024)).alias("_spread")).agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("c"))
    classes = classes.select("s1", "s2", F.col("c.doc_id").alias("rep"), F.col("c.n_shingles").alias("n"), F.col("c.signature").alias("signature"))
    pairs, runs = map(cut, candidates(classes, percent))
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = cut(plain.join(wanted, "doc_id", "left_semi"))
    first = confirmed(pairs.where(F.col("tree") < FIRST_TREES), texts, k, percent)
    links = stored(first)
    label = components(links)
    rest = pairs.where(F.col("tree") >= FIRST_TREES)
    for side in ("a", "b"):
        rest = rest.join(label.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = stored(links.unionAll(confirmed(rest, texts, k, percent)))
    label = components(links)
    apart = _meet(runs, label)
    if not apart.isEmpty():
        stars = stored(_with_hubs(apart, links, percent))
        wanted = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        more = stored(confirmed(stars, plain.join(wanted, "doc_id", "left_semi"), k, percent))
        if not more.isEmpty():
            label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
            apart = _meet(apart.drop("component"), label)
        more = stored(_all_links(apart, plain, k, percent))
        if not more.isEmpty():
            label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    classed = classes.select("s1", "s2", "rep").join(label, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    # Texts without words share one key, so they stay out of the join.
    linked = full.select("doc_id", "n_shingles", "s1", "s2").join(classed, ["s1", "s2"], "left").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
