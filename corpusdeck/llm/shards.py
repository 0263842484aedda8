"""Shards of near equal bytes by a k-d tree over document metadata.

Each dimension places a document on a line of 2**31 codes: categories by a hash, so a category is one point,
numbers by their share of the table's range, the size by its logarithm. A node is split along the dimension
in which its documents spread widest, at the weighted median of their bytes, until a leaf holds the bytes of
one shard. Medians are found without sorting or moving documents: all nodes of a level share a histogram of
bytes over equal cells of their range, of which the cell with the median is cut into cells again. What comes
to the driver is one number per node and cell, and the tree, whose size is the number of shards.

Ties on a line are broken by a hash of the text, so equal texts stay together; a group of equal texts takes
its place by one of its members' metadata. Only a group that outweighs a median's tolerance is cut, by a hash
of the rows, and only where a median falls into it. Documents that alone outweigh a shard are leaves of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, stored

#: Added to a document's bytes (fixed value of the contract).
ROW_BYTES = 16
#: Cells of a node's histogram, and the share of a shard's bytes by which a median may be off.
CELLS, TOLERANCE = 4096, 1 / 200
#: Rows of one shard that are numbered in a task, about.
SLOT_ROWS = 100_000
_CODES = 1 << 31


@dataclass
class Node:
    """A part of the table that is to become so many shards; a leaf becomes shard first."""

    shards: int
    first: int = 0
    line: int = 0
    key: int = 0
    row: int = 0
    sides: list[Node] = field(default_factory=list)

    def leaves(self) -> Iterator[Node]:
        if not self.sides:
            yield self
        for side in self.sides:
            yield from side.leaves()

    def pick(self, value) -> str:
        """SQL for value(leaf) of the leaf that a row with columns _k0, _k1, ... and _r falls into."""
        if not self.sides:
            return value(self)
        key = f"_k{self.line}"
        low = f"{key} < {self.key} OR ({key} = {self.key} AND _r < {self.row})"
        return f"CASE WHEN {low} THEN {self.sides[0].pick(value)} ELSE {self.sides[1].pick(value)} END"


@dataclass
class Search:
    """The range that holds a node's median: keys from low to high or, where that is one key, hashes of rows."""

    node: Node
    goal: float
    low: int
    high: int
    below: int = 0
    key: int | None = None

    def step(self) -> int:
        return (self.high - self.low) // CELLS + 1

    def narrow(self, cells: list, tolerance: float) -> bool:
        """Takes (cell, bytes, least, greatest) by cell; true if the node has been cut."""
        for _, mass, least, greatest in cells:
            if self.below + mass >= self.goal:
                break
            self.below += mass
        if mass > tolerance and least < greatest:
            self.low, self.high = least, greatest
            return False
        if mass > tolerance and self.key is None:
            self.key, self.low, self.high = least, 0, (1 << 62) - 1
            return False
        after = self.below + mass - self.goal < self.goal - self.below
        at = greatest + 1 if after else least
        self.below += mass if after else 0
        self.node.key, self.node.row = (at, 0) if self.key is None else (self.key, at)
        return True


def _code(df: DataFrame, dim: str) -> Column:
    """Place of column dim on its line."""
    kind = df.schema[dim].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        value = F.col(dim).cast("double")
        value = F.when(F.isnan(value) | value.isNull() | (F.abs(value) == float("inf")), None).otherwise(value)
        low, high = df.agg(F.min(value), F.max(value)).first()
        if low is None or low == high:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((value / 2 - low / 2) / (high / 2 - low / 2) * (_CODES - 1)), F.lit(0)).cast("long")
    return F.pmod(F.xxhash64(F.col(dim)), F.lit(_CODES))


def _described(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """columns of docs plus size, text_crc32, the text's hash (_h1, _h2), codes _c0, ... (the last is the size's) and _r."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    codes = [_code(docs, dim) for dim in dims] + [F.floor(F.log2(size) / 64 * _CODES).cast("long")]
    row = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text, *dims), 2)
    return docs.select(
        *columns,
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h1"),
        F.xxhash64(F.lit(1), text).alias("_h2"),
        *[c.alias(f"_c{i}") for i, c in enumerate(codes)],
        row.alias("_r"),
    )


def _keyed(described: DataFrame, places: int) -> DataFrame:
    """Codes become keys _k0, ...: the code, then a hash of the text. Groups of equal texts take their least member's codes."""
    codes = [f"_c{i}" for i in range(places)]
    # The spread column keeps the aggregate's partitioning from being the join's, so that the join gets
    # exchanges of its own, in which adaptive execution can split a hot group.
    groups = (
        described.groupBy("_h1", "_h2", F.pmod("_h1", F.lit(1024)).alias("_spread"))
        .agg(F.min(F.struct(*codes)).alias("_least"), F.max(F.struct(*codes)).alias("_most"))
        .where("_least <> _most")
        .select("_h1", "_h2", "_least")
    )
    tie = F.pmod(F.col("_h1"), F.lit(_CODES))
    keys = [(F.coalesce(F.col(f"_least.{c}"), F.col(c)) * _CODES + tie).alias(f"_k{i}") for i, c in enumerate(codes)]
    return described.join(groups, ["_h1", "_h2"], "left").select(*[c for c in described.columns if c not in codes and c not in ("_h1", "_h2")], *keys)


def _grow(keyed: DataFrame, places: int, shards: int) -> Node:
    """The tree of a table with columns size, _k0, ... and _r: level by level, all nodes of a level at once."""
    root = Node(shards)
    level, tolerance = [root], 0.0
    while level := [n for n in level if n.shards > 1]:
        at = {id(n): i for i, n in enumerate(level)}
        ends = [f(f"_k{i}").alias(f"{f.__name__}{i}") for i in range(places) for f in (F.min, F.max)]
        node = F.expr(root.pick(lambda leaf, at=at: str(at.get(id(leaf), "CAST(NULL AS INT)"))))
        found = keyed.groupBy(node.alias("_node")).agg(F.sum("size").alias("bytes"), *ends).where("_node is not null").collect()
        searches, total = [], {}
        for x in found:
            node = level[x["_node"]]
            total[id(node)] = x["bytes"]
            tolerance = tolerance or x["bytes"] / shards * TOLERANCE
            node.line = max(range(places), key=lambda i: (x[f"max{i}"] // _CODES - x[f"min{i}"] // _CODES, -i))
            searches.append(Search(node, x["bytes"] * (node.shards // 2) / node.shards, x[f"min{node.line}"], x[f"max{node.line}"]))
        _cut(keyed, root, searches, tolerance)
        level = []
        for s in searches:
            node, share = s.node, s.below / total[id(s.node)]
            if not 0 < share < 1:  # A single row, or rows that are equal in all that counts.
                continue
            left = min(max(round(node.shards * share), 1), node.shards - 1)
            level += [Node(left, node.first), Node(node.shards - left, node.first + left)]
            node.sides = level[-2:]
    return root


def _cut(keyed: DataFrame, root: Node, searches: list[Search], tolerance: float) -> None:
    """Finds the key (and row hash) at which each node is cut; a round narrows all of them to a cell of a cell."""
    while searches:
        of = {id(s.node): (i, s) for i, s in enumerate(searches)}

        def value(leaf: Node, of=of) -> str:
            if id(leaf) not in of:
                return "CAST(NULL AS BIGINT)"
            s = of[id(leaf)][1]
            if s.key is None:
                return f"CASE WHEN _k{leaf.line} BETWEEN {s.low} AND {s.high} THEN _k{leaf.line} END"
            return f"CASE WHEN _k{leaf.line} = {s.key} AND _r BETWEEN {s.low} AND {s.high} THEN _r END"

        def cell(leaf: Node, of=of) -> str:
            """A number per node and cell; null outside the node's range. Rounding is monotone, so cells are ranges."""
            if id(leaf) not in of:
                return "CAST(NULL AS BIGINT)"
            i, s = of[id(leaf)]
            return f"floor(({value(leaf)} - {s.low}) / {s.step()}) + {i * 2 * CELLS}"

        v = F.expr(root.pick(value))
        cells = keyed.groupBy(F.expr(root.pick(cell)).alias("_cell")).agg(F.sum("size").alias("mass"), F.min(v).alias("least"), F.max(v).alias("most"))
        by: dict[int, list] = {}
        for x in sorted(cells.where("_cell is not null").collect()):
            by.setdefault(x["_cell"] // (2 * CELLS), []).append((x["_cell"], x["mass"], x["least"], x["most"]))
        searches = [s for i, s in enumerate(searches) if not s.narrow(by[i], tolerance)]


def _heavy(keyed: DataFrame, shards: int) -> list[int]:
    """Row hashes of the documents that outweigh what is left per shard; each is a leaf by itself. Fewer than shards."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    largest = keyed.orderBy(F.desc("size"), "_r").select("size", "_r").limit(shards - 1).collect()
    seen = Counter(x["_r"] for x in largest)
    out: list[int] = []
    for x in largest:
        if x["size"] * (shards - len(out)) < total:
            break
        if seen[x["_r"]] == 1:  # Rows that are equal in all that counts cannot be told apart.
            out.append(x["_r"])
            total -= x["size"]
    return out


def _placed(keyed: DataFrame, slim: DataFrame, places: int, shards: int) -> tuple[DataFrame, int]:
    """keyed plus shard, by a tree grown from slim, and the number of shards in use."""
    heavy = _heavy(slim, shards) if shards > 1 else []
    tree = _grow(slim.where(~F.col("_r").isin(heavy)) if heavy else slim, places, shards - len(heavy))
    shard = F.expr(tree.pick(lambda leaf: str(leaf.first)))
    for i, row in enumerate(heavy):
        shard = F.when(F.col("_r") == row, F.lit(shards - 1 - i)).otherwise(shard)
    return keyed.withColumn("shard", shard), sum(1 for _ in tree.leaves()) + len(heavy)


def _counted(docs: DataFrame, shards: int | None, target_bytes: int | None) -> int:
    if shards is None:
        total = docs.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    return shards


def kd_shards(
    docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs without the text, plus size, text_crc32, shard and slot (numbers from 0 within a shard).

    size is the text's bytes in UTF-8 plus 16 (null: none). There are as many shards as asked for or, with
    shards None, as it takes for target_bytes each. Dimensions are the columns dims and the size. Shards differ
    by no more than the tolerance of a few medians and a document or two at each; documents that alone outweigh a shard get one each. Reruns on the
    same rows agree.

    Null metadata is a value of its own (in numbers, the least). Rows with a null or repeated id are rows like
    others; rows equal in all that counts share their places in any order. An empty table gives an empty
    table; with fewer documents than shards some shards are empty. Columns size, text_crc32, shard and slot of
    docs are replaced, other columns stay.
    """
    docs, back, (id_col, text_col, *dims) = _renamed(docs, id_col, text_col, *dims)
    columns = [c for c in docs.columns if c != text_col]
    places = len(dims) + 1
    keyed = stored(_keyed(_described(docs, dims, id_col, text_col, columns), places))
    out = _numbered(*_placed(keyed, keyed, places, _counted(keyed, shards, target_bytes)), id_col)
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in columns], "size", "text_crc32", "shard", "slot")


def _renamed(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """docs without the result's columns and with those named like a helper renamed, the way back, and what the used columns are called now."""
    if clash := {"size", "text_crc32", "shard", "slot"} & {c.lower() for c in used}:
        raise ValueError(f"columns of the result cannot be used: {sorted(clash)}")
    own = ["_h1", "_h2", "_r", "_least", "_most", "_spread", "_node", "_cell", "_bucket", "_offset", "_n", *[f"{x}{i}" for x in ("_c", "_k") for i in range(len(used))]]
    docs, there = docs.drop("size", "text_crc32", "shard", "slot"), {}
    for c in docs.columns:
        if c.lower() in own:
            (there[c],) = free_names([*docs.columns, *own], f"_{c}")
            docs = docs.withColumnRenamed(c, there[c])
    return docs, {new: old for old, new in there.items()}, [there.get(c, c) for c in used]


def _numbered(placed: DataFrame, shards: int, id_col: str) -> DataFrame:
    """Adds slot: a shard's rows are dealt to buckets by their hash, numbered there, and each bucket begins where the last one ends."""
    rows = placed.agg(F.count(F.lit(1))).first()[0]
    bucketed = placed.withColumn("_bucket", F.pmod("_r", F.lit(max(1, rows // (shards * SLOT_ROWS)))))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    order = Window.partitionBy("shard", "_bucket").orderBy("_r", id_col)
    return bucketed.join(offsets, ["shard", "_bucket"]).withColumn("slot", (F.col("_offset") + F.row_number().over(order) - 1).cast("long"))


def write_shards(docs: DataFrame, path: str, shards: int | None = 40, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs to path as Parquet, a folder shard=... for each shard, in files of about SLOT_ROWS rows; see kd_shards."""
    docs, back, (id_col, text_col, *dims) = _renamed(docs, id_col, text_col, *dims)
    places = len(dims) + 1
    keyed = _keyed(_described(docs, dims, id_col, text_col, docs.columns), places)
    slim = stored(keyed.select("size", *[f"_k{i}" for i in range(places)], "_r"))
    placed, used = _placed(keyed, slim, places, _counted(slim, shards, target_bytes))
    out = placed.repartition("shard", F.pmod("_r", F.lit(max(1, slim.count() // (used * SLOT_ROWS)))))
    out.select(*[F.col(c).alias(back.get(c, c)) for c in docs.columns], "shard").write.partitionBy("shard").parquet(path)
