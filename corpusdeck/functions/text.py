"""Column expressions over text and arrays of text, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from ..dims import HEADING, LIST_MARKER

WHITE = " \t\n\x0b\x0c\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    """Lines of a text; null has none."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def letter_words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts after . ! or ? and white space that are longer than three characters."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \t\n\x0b\f\r]+"), strip), lambda s: F.length(s) > 3)


def heading_level(line: Column) -> Column:
    """Number of hashes of a heading line, 0 for other lines."""
    return F.length(F.regexp_extract(strip(line), HEADING, 1))


def heading_text(line: Column) -> Column:
    return strip(F.regexp_extract(strip(line), HEADING, 2))


def without_marker(line: Column) -> Column:
    return strip(F.regexp_replace(line, LIST_MARKER, ""))


def is_junk_heading(title: Column) -> Column:
    """Whether a heading is content: empty, an unfinished formula, mostly symbols, one word over and over, or over 12 words."""
    bare = F.filter(F.transform(words(title), lambda w: F.lower(F.btrim(w, F.lit(":;,.")))), lambda w: w != "")
    letters = F.length(F.regexp_replace(title, r"[^\p{L}]", ""))
    return (
        (title == "")
        | (title.rlike(r"[=+\-/*:]$") & title.contains("="))
        | (letters < F.greatest(F.lit(3.0), F.length(title) * 0.4))
        | ((F.size(bare) >= 2) & (F.size(F.array_distinct(bare)) == 1))
        | (F.size(bare) > 12)
    )


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_any(lowered: Column, phrases: list[str]) -> Column:
    """Whether a lower-case text holds one of the phrases, also inside words. Searching each phrase takes a
    small part of the time of one pattern with all of them; lowered should be a column or bound by let."""
    return reduce(lambda a, b: a | b, [lowered.contains(p) for p in phrases])


def phrases_pattern(phrases: list[str]) -> str:
    """A pattern that matches nothing wide wherever one of the phrases begins and captures the longest that does: the phrases as a tree of
    letters, whose wide forks are split by a look at the letter ahead."""
    tree: dict = {}
    for p in phrases:
        node = tree
        for ch in p:
            node = node.setdefault(ch, {})
        node[""] = {}

    def quoted(ch: str) -> str:
        return ch if ch.isalnum() or ch == " " else "\\" + ch

    def fork(node: dict) -> str:
        ways = [quoted(ch) + fork(node[ch]) for ch in sorted(node) if ch]
        if len(ways) > 6:
            letters = [quoted(ch) for ch in sorted(node) if ch]
            ways = [f"(?=[{''.join(letters[i : i + 6])}])(?:{'|'.join(ways[i : i + 6])})" for i in range(0, len(ways), 6)]
        if not ways:
            return ""
        return ("(?:" + "|".join(ways) + ")" if len(ways) > 1 or "" in node else ways[0]) + ("?" if "" in node else "")

    return f"(?=({fork(tree)}))"


def phrases_in(lowered: Column, phrases: list[str]) -> Column:
    """Those of the phrases that a lower-case text holds, also inside words: one scan, however many there are."""
    begins = {q: [p for p in phrases if p != q and q.startswith(p)] for q in phrases}
    shorter = [(q, F.array(*map(F.lit, ps))) for q, ps in begins.items() if ps]

    def whole(found: Column) -> Column:
        return F.array_distinct(F.concat(found, *[F.when(F.array_contains(found, q), ps).otherwise(F.array().cast("array<string>")) for q, ps in shorter]))

    return let(F.array_distinct(F.regexp_extract_all(lowered, F.lit(phrases_pattern(phrases)), F.lit(1))), whole)


def dedupe(items: Column, most: int | None = None) -> Column:
    """The first of each item, compared lower-case and stripped, blanks dropped; at most most of them."""

    def first(clean: Column) -> Column:
        def pick(keys: Column) -> Column:
            kept = F.array_distinct(keys)
            return F.transform(F.slice(kept, 1, most) if most else kept, lambda k: F.element_at(clean, F.array_position(keys, k).cast("int")))

        return let(F.transform(clean, F.lower), pick)

    return let(F.filter(F.transform(items, strip), lambda x: x != ""), first)


def first_hits(text: Column, pattern: str, before: int, after: int, most: int, clean=strip, cue: Column | None = None) -> Column:
    """The text around each match of pattern, from before characters ahead of it to after behind it, cleaned, the
    first of each (compared in lower case), at most most of them.

    Gaps and matches add up to the text, so running lengths are positions; the fold stops looking once it has most.
    cue: what holds of each text with a match and is cheaper to ask for.
    """

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        low = F.greatest(start - before, F.lit(0))
        found = let(clean(F.substring(text, low + 1, end + after - low)), lambda x: F.when((x == "") | F.exists(acc["out"], lambda o: F.lower(o) == F.lower(x)), acc["out"]).otherwise(F.concat(acc["out"], F.array(x))))
        return F.struct(end.alias("at"), F.when(pair["hit"].isNull() | (F.size(acc["out"]) >= most), acc["out"]).otherwise(found).alias("out"))

    nothing = F.array().cast("array<string>")
    pairs = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])
    some = text.rlike(pattern)
    return F.when(some if cue is None else cue & some, folded).otherwise(nothing)


def normalise(text: Column) -> Column:
    """Text without markdown emphasis, code ticks and stray escapes; an asterisk inside a word stays."""
    out = F.regexp_replace(text, r"(?s)\*\*(.+?)\*\*", "$1")
    out = F.regexp_replace(out, r"(?s)__(.+?)__", "$1")
    out = F.regexp_replace(out, r"(?s)(?<!\w)[*_](?!\s)(.+?)(?<!\s)[*_](?!\w)", "$1")
    out = F.regexp_replace(out, "`([^`]+)`", "$1")
    out = F.regexp_replace(out, r"\\+(?=\s|$)", " ")
    out = F.regexp_replace(out, r"\*\*|__", "")
    out = F.regexp_replace(out, r"(?<!\w)[*_]+|[*_]+(?!\w)", "")
    # Each of these takes a mark; most lines have none.
    return squeeze(F.when(text.rlike(r"[*_`\\]"), out).otherwise(text))


def clean_bullet(text: Column) -> Column:
    """One bullet without heading hashes, list or step markers and markdown."""
    out = F.regexp_replace(text, r"^\s*#{1,6}\s*", "")
    return normalise(F.regexp_replace(out, r"(?i)^\s*(?:[-*+•]|[0-9]+[.)]|step\s*[0-9]+\s*[:.\-])\s*", ""))


def truncate_on_word(text: Column, limit: int) -> Column:
    """At most limit characters, cut at the last space if that is past 60 % of them, with an ellipsis."""
    cut = F.substring(text, 1, limit)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    held = F.when((F.locate(" ", F.reverse(cut)) > 0) & (space > limit * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(held, F.lit(" ,;:.-")), F.lit("…")))


def bare(text: Column) -> Column:
    """A text in [a-z0-9 ], with single spaces."""
    return squeeze(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def _restates(a: Column, b: Column) -> Column:
    """Whether one of two bare texts is the other or stands in it by whole words (four characters or more)."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(short) >= 4) & F.concat(F.lit(" "), long, F.lit(" ")).contains(F.concat(F.lit(" "), short, F.lit(" "))))


def restates_any(text: Column, others: Column) -> Column:
    """Whether a text has no words or restates one of others."""
    return let(bare(text), lambda t: (t == "") | F.exists(F.transform(others, bare), lambda o: _restates(o, t)))


def drop_restatements(bullets: Column, seed: Column | None = None) -> Column:
    """Bullets that neither equal, hold nor are held by an earlier kept one, compared in [a-z0-9 ] by whole words.

    seed: bullets that stay as they are, ahead of the others. Each bullet's bare form is made once.
    """
    item = "array<struct<text:string,bare:string>>"
    pairs = lambda xs: F.transform(xs, lambda x: F.struct(x.alias("text"), bare(x).alias("bare")))

    def step(kept: Column, x: Column) -> Column:
        return F.when((x["bare"] == "") | F.exists(kept, lambda k: _restates(k["bare"], x["bare"])), kept).otherwise(F.concat(kept, F.array(x)))

    start = F.array().cast(item) if seed is None else pairs(seed).cast(item)
    return F.transform(F.aggregate(pairs(bullets), start, step), lambda k: k["text"])


def sentences_abbrev(text: Column) -> Column:
    """Sentences without their points at the ends; a point is no end before a lower-case letter, nor after a digit,
    a single capital or an abbreviation."""
    # Such a point becomes a mark, the others before white space cut, and the marks become points again.
    flat = squeeze(F.coalesce(text, F.lit("")))
    token = r"(?<![A-Za-z0-9.])"
    known = "|".join(a.replace(".", r"\.?") for a in dims.ABBREVIATIONS)
    held = F.regexp_replace(flat, r"([.!?])(?= *\p{Ll})", "$1\u0001")
    held = F.regexp_replace(held, r"(?<=[0-9])([.!?])(?= )", "$1\u0001")
    held = F.regexp_replace(held, token + r"([A-Z])([.!?])(?= )", "$1$2\u0001")
    held = F.regexp_replace(held, token + rf"(\.*(?i:{known})\.*)([.!?])(?= )", "$1$2\u0001")
    parts = F.transform(F.split(held, r"(?<=[.!?]) "), lambda p: F.btrim(F.replace(p, F.lit("\u0001"), F.lit("")), F.lit(" .;:")))
    return F.filter(parts, lambda p: p != "")


def restore_missing_points(bullets: Column, source: Column) -> Column:
    """bullets, then the source's sentences of four words or more that none of them restates, in order."""
    some = F.filter(sentences_abbrev(source), lambda s: F.size(words(s)) >= 4)
    cleaned = F.filter(F.transform(some, clean_bullet), lambda c: c != "")
    return F.when(F.size(cleaned) > 0, drop_restatements(cleaned, bullets)).otherwise(bullets)


def split_label_body(text: Column, fallback: Column) -> Column:
    """(label, body) of 'Label: body' with a label of five words at most, in capitals; up to two labels that only
    name a field are peeled off; without a label the fallback and the whole text."""

    def split(t: Column) -> Column:
        label, rest = strip(F.regexp_extract(t, dims.LABELLED, 1)), strip(F.regexp_extract(t, dims.LABELLED, 2))
        return let(F.struct(t.alias("t"), label.alias("label"), rest.alias("rest")), lambda x: F.struct(x["t"], x["label"], x["rest"], ((x["rest"] != "") & (x["label"] != "") & (F.size(words(x["label"])) <= 5)).alias("ok"), F.lower(x["label"]).isin(*dims.META_LABELS).alias("meta")))

    def found(x: Column) -> Column:
        return F.struct(F.upper(x["label"]).alias("label"), x["rest"].alias("body"))

    def none(t: Column) -> Column:
        return F.struct(fallback.alias("label"), t.alias("body"))

    def again(x: Column) -> Column:
        second = let(split(x["rest"]), lambda y: F.when(~y["ok"], none(x["rest"])).when(y["meta"], none(y["rest"])).otherwise(found(y)))
        return F.when(~x["ok"], none(x["t"])).when(x["meta"], second).otherwise(found(x))

    return let(split(normalise(F.coalesce(text, F.lit("")))), again)


def trim_bullet(text: Column, max_words: Column, max_chars: Column) -> Column:
    """A bullet within a profile's budget: words, back to the last clause break past half, then characters at a space past 60 %."""
    clean = clean_bullet(text)
    some = words(clean)
    candidate = F.array_join(F.slice(some, F.lit(1), max_words), " ")
    clause = F.length(F.regexp_extract(candidate, r"^(.*)[,;:—–]\s", 1))
    held = F.when((clause > F.length(candidate) * 0.5) & candidate.rlike(r"[,;:—–]\s"), F.substring(candidate, F.lit(1), clause)).otherwise(candidate)
    clean = F.when(F.size(some) > max_words, F.rtrim(held, F.lit(" ,;:—–"))).otherwise(clean)
    cut = F.substring(clean, F.lit(1), max_chars)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    short = F.when((F.locate(" ", F.reverse(cut)) > 0) & (space > max_chars * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(clean) > max_chars, F.rtrim(short)).otherwise(clean)


def clean_label(text: Column, limit: int = 60) -> Column:
    """A bullet for a box: cleaned, without points at its ends, cut at a word beyond limit characters."""
    return truncate_on_word(F.btrim(clean_bullet(text), F.lit(" .;:")), limit)


def round_binary(share: Column) -> Column:
    """A share between 0.25 and 1 to two places, as the binary number it is: 0.885 is a little more than that and becomes 0.89.

    bround and round go by the decimal digits that a double is printed with. Doubles of this range are whole
    numbers of 2**-54, so the sum is exact in 64 bits.
    """
    scale = 1 << 54
    return ((share * float(scale)).cast("long") * 100 + scale // 2).bitwiseAND(F.lit(-scale)) / scale / 100


def round_even(value: Column | str, places: int = 0) -> Column:
    """A number to some places, halves to the even neighbour, decided on the scaled binary number.

    bround goes by the decimal digits that a double is printed with, so a value a hair off a half falls to another side.
    """
    return F.rint((F.col(value) if isinstance(value, str) else value) * 10.0**places) / 10.0**places
