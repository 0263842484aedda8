"""Secret scans with DataFrame functions only: known patterns, and a battery of randomness tests.

Each token that mixes letters and digits is tested against the hypothesis that it is uniformly random in the
smallest encoding that holds all of its characters. A token is reported unless the hypothesis is rejected,
and rejections are controlled for false discoveries within bands of similar length, since short tokens
give weak evidence. Only a histogram of bounded size, by band and p-value, is gathered from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import stored

#: Base patterns in the order in which equal starts are listed; the least code points of the match or of its value (fixed values of the contract).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 6, 20, 24, 20
#: Runs of encoding characters with a letter and a digit.
TOKEN = r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings from the smallest to the largest: a pattern of their tokens without padding, and the alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[a-z0-9]+$", _LOWER + _DIGITS),
    ("^[A-Z0-9]+$", _UPPER + _DIGITS),
    ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: Bins of the chi-squared test (with five, its tail has a closed form), steps of a tenfold p-value, and the last step.
BINS, STEPS, LAST = 5, 4, 80

_FOUND = "array<struct<start:int,end:int,hit:string>>"


def _parts(array: Column) -> Column:
    """An array in parts of about the square root of its size, so that folds and searches over it needn't take quadratic time."""

    def by(width: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(array), width), lambda at: F.slice(array, at, width))

    return F.when(F.size(array) > 0, let(F.ceil(F.sqrt(F.size(array))).cast("int"), by)).otherwise(F.slice(F.array(array), 1, 0))


def _hits(text: Column, pattern: str) -> Column:
    """[(start, end, hit)] of all leftmost non-overlapping matches, in code points; end is exclusive.

    Matches and the gaps between them add up to the text, so running lengths are the positions: first those
    within each part of the matches, then the parts are moved by the lengths before them.
    """
    nothing = F.array().cast(_FOUND)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        found = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(pair["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(found))).alias("found"))

    def moved(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + part["at"])))

        def move(h: Column, by: Column) -> Column:
            return F.struct((h["start"] + by).alias("start"), (h["end"] + by).alias("end"), h["hit"].alias("hit"))

        return let(before, lambda at: F.flatten(F.transform(parts, lambda part, i: F.transform(part["found"], lambda h: move(h, F.get(at, i))))))

    pairs = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
    folded = let(pairs, lambda p: let(F.transform(_parts(p), lambda part: F.aggregate(part, zero, step)), moved))
    return F.when(text.rlike(pattern), folded).otherwise(nothing)


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _touched(h: Column, grouped: list[Column]) -> Column:
    """Whether a span overlaps one of the spans in parts of (low, high, spans)."""
    found = F.lit(False)
    for groups in grouped:
        found = found | F.exists(groups, lambda g: (h["start"] < g["high"]) & (g["low"] < h["end"]) & F.exists(g["spans"], lambda b: _overlaps(h, b)))
    return found


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z, by a polynomial for the complementary error function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return tail * F.exp(-x * x)


def _symbols(token: Column) -> tuple[Column, Column]:
    """Places of a token's characters in the alphabet of its encoding, and the alphabet's size."""
    bare = F.rtrim(token, F.lit("="))
    alphabet = F.coalesce(*[F.when(bare.rlike(p), F.lit(a)) if p else F.lit(a) for p, a in ENCODINGS])
    places = F.transform(F.split(bare, ""), lambda c: F.instr(alphabet, c) - 1)
    return F.filter(places, lambda x: x >= 0), F.length(alphabet)


def _tally(x: Column, k: Column) -> Column:
    """One pass over a token: counts by bin, sums, products of neighbours, and runs above and below the alphabet's middle."""
    zero = F.struct(
        F.lit(0).alias("n"), *[F.lit(0).alias(f"b{j}") for j in range(BINS)], F.lit(0).alias("s"), F.lit(0).alias("q"), F.lit(0).alias("lag"),
        F.lit(0).alias("last"), F.lit(0).alias("first"), F.lit(0).alias("runs"), F.lit(0).alias("high"), F.lit(-1).alias("side"),
    )

    def step(a: Column, v: Column) -> Column:
        place, side = F.floor(v * BINS / k).cast("int"), (v * 2 >= k).cast("int")
        return F.struct(
            (a["n"] + 1).alias("n"),
            *[(a[f"b{j}"] + (place == j).cast("int")).alias(f"b{j}") for j in range(BINS)],
            (a["s"] + v).alias("s"),
            (a["q"] + v * v).alias("q"),
            (a["lag"] + a["last"] * v).alias("lag"),
            v.alias("last"),
            F.when(a["n"] == 0, v).otherwise(a["first"]).alias("first"),
            (a["runs"] + (a["side"] != side).cast("int")).alias("runs"),
            (a["high"] + side).alias("high"),
            side.alias("side"),
        )

    return F.aggregate(x, zero, step)


def _p_value(t: Column, k: Column) -> Column:
    """Three times the least p-value of the battery, 1 at most."""
    n = t["n"].cast("double")
    sizes = [F.ceil(k * (j + 1) / BINS) - F.ceil(k * j / BINS) for j in range(BINS)]
    chi = sum((F.pow(t[f"b{j}"] - n * sizes[j] / k, 2) / (n * sizes[j] / k) for j in range(BINS)), F.lit(0.0))
    uniform = F.exp(-chi / 2) * (1 + chi / 2)
    high, low = t["high"].cast("double"), n - t["high"]
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.when(spread > 0, _two_sided((t["runs"] - mean) / F.sqrt(spread))).otherwise(0.0)
    centre = t["s"] / n
    square = t["q"] - n * centre * centre
    lagged = t["lag"] - centre * (2 * t["s"] - t["first"] - t["last"]) + (n - 1) * centre * centre
    serial = F.when(square > 1e-9, _two_sided((lagged / square + 1 / n) * F.sqrt(n))).otherwise(0.0)
    return F.when(n >= 2, F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))).otherwise(0.0)


def _scanned(docs: DataFrame, text: Column) -> DataFrame:
    """Adds _assign, _access, _hex and _tokens: [(start, end, band, step)] of tokens that no base span touches."""
    found = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    found = found.withColumns(
        {
            "_assign": F.filter(_hits(F.col("_text"), ASSIGN), lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN, 2)) >= ASSIGN_LEAST),
            "_access": F.filter(_hits(F.col("_text"), ACCESS), lambda h: F.length(h["hit"]) >= ACCESS_LEAST),
            # Runs are maximal either way, so shorter ones need not be matched first.
            "_hex": _hits(F.col("_text"), HEX[:-1] + f"{{{HEX_LEAST},}}"),
            "_tokens": _hits(F.col("_text"), TOKEN),
        }
    )
    # Spans of one kind are in order and apart, so a token needs a look into one or two parts of each.
    grouped = [F.transform(_parts(F.col(c)), lambda p: F.struct(p[0]["start"].alias("low"), F.element_at(p, -1)["end"].alias("high"), p.alias("spans"))) for c in ("_assign", "_access", "_hex")]
    free = let(F.struct(*[g.alias(f"g{i}") for i, g in enumerate(grouped)]), lambda s: F.filter("_tokens", lambda h: ~_touched(h, [s[f"g{i}"] for i in range(len(grouped))])))
    found = found.withColumn("_tokens", free)

    def symbols(h: Column) -> Column:
        x, k = _symbols(h["hit"])
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), x.alias("x"), k.alias("k"))

    found = found.withColumn("_tokens", F.transform("_tokens", symbols))
    found = found.withColumn("_tokens", F.transform("_tokens", lambda h: F.struct(h["start"], h["end"], h["k"], _tally(h["x"], h["k"]).alias("t"))))
    found = found.withColumn("_tokens", F.transform("_tokens", lambda h: F.struct(h["start"], h["end"], _p_value(h["t"], h["k"]).alias("p"))))

    def stepped(h: Column) -> Column:
        step = F.when(h["p"] > 0, F.least(F.lit(LAST), F.floor(-F.log10(h["p"]) * STEPS).cast("int"))).otherwise(LAST)
        return F.struct(h["start"], h["end"], F.floor(F.log2((h["end"] - h["start"]).cast("double"))).cast("int").alias("band"), step.alias("step"))

    return found.withColumn("_tokens", F.transform("_tokens", stepped)).drop("_text")


def rejections(tokens: DataFrame, rate: float) -> DataFrame:
    """(band, cut): from which step on a band's tokens are rejected as random, by step-up control at rate.

    Of the steps s with p-values of at most 10 ** (-s / STEPS), the first with 10 ** (-s / STEPS) <= rate *
    (share of the band's tokens at s or beyond) is the cut: the step-up rule on a grid. Bands without one
    reject nothing. The table has LAST + 1 rows per doubling of length at most.
    """
    counts = tokens.groupBy("band", "step").count()
    beyond = F.sum("count").over(Window.partitionBy("band").orderBy(F.desc("step")))
    whole = F.sum("count").over(Window.partitionBy("band"))
    ranked = counts.select("band", "step", (beyond / whole).alias("share"))
    return ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("share")).groupBy("band").agg(F.min("step").alias("cut"))


def _listed(kinds: dict[str, str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""

    def numbered(i: int, column: str) -> Column:
        return F.transform(column, lambda h: F.struct(h["start"].alias("start"), F.lit(i).alias("i"), h["end"].alias("end")))

    parts = [numbered(i, column) for i, column in enumerate(kinds.values())]
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.concat(*parts))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["i"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans) per row of docs.

    Spans are kind:start:end in code points. Base kinds follow their patterns; random ones are tokens of
    TOKEN_LEAST characters or more that no base span touches and that the battery does not reject. A null
    text counts as empty and has no spans; null or repeated ids change nothing, each row is scanned alone.
    An empty table gives an empty table; other columns play no part.
    """
    scanned = _scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw")), F.col("_raw"))
    places = [F.transform(c, lambda h: F.struct(h["start"], h["end"])).alias(c) for c in ("_assign", "_access", "_hex")]
    # Places of spans alone, without texts, are written: both passes below read them, and texts are scanned once.
    scanned = stored(scanned.select("doc_id", *places, "_tokens"))
    tokens = scanned.select(F.explode("_tokens").alias("t")).select("t.band", "t.step")
    cuts = rejections(tokens, rate)
    # One row: a map of the bands' cuts, at most one entry per doubling of length.
    table = cuts.agg(F.map_from_entries(F.collect_list(F.struct("band", "cut"))).alias("_cuts"))
    found = scanned.join(F.broadcast(table))
    random = F.filter("_tokens", lambda h: h["step"] < F.coalesce(F.element_at(F.col("_cuts"), h["band"]), F.lit(LAST + 1)))
    found = found.withColumn("_random", random)
    base = {"assign": "_assign", "access": "_access", "hex": "_hex"}
    return found.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in (base | {"random": "_random"}).items()],
        _listed(base).alias("base_spans"),
        _listed(base | {"random": "_random"}).alias("spans"),
    )
