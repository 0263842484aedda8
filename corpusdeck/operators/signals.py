"""Signals of units: one narrow projection evaluates all extractors over a unit's sentences.

A unit has doc_id, unit_id, title and text. Its blocks are the title as a heading and its lines without list
markers as bullets, or the unit's own column blocks where it has one; notes, tables, equations and counts of
diagrams and charts are optional columns too. Each signal is an array column; explode_signals makes the long
table. Only the signals that a query reads are computed, as Catalyst prunes the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.rows import exploded
from ..functions.text import contains_any, dedupe, first_hits, let, letter_words, lines, phrases_in, round_even, sentences, strip, without_marker, words

PAIR = "array<struct<left:string,right:string,aspect:string>>"
BLOCK = "struct<text:string,is_heading:boolean,heading_level:int,bullet_level:int,is_bold:boolean,font_size:double>"
TABLE = "struct<headers:array<string>,rows:array<array<string>>>"
TEXTS = "array<string>"
#: Optional columns of units and what stands for a missing one.
OPTIONAL = {"notes": ("string", ""), "tables": (f"array<{TABLE}>", None), "equations": (TEXTS, None), "n_diagrams": ("int", 0), "n_charts": ("int", 0), "n_images": ("int", 0)}
LETTER_WORD = "[a-z']+"
FORMULA_CUES = ["formula", "equation", "expression"]
#: Of these a text with a definition's cue has one, unless it has 'is a'.
DEFINITION_CUES = ["means", "refers", "defined", "known", "process", ":", "—", "–"]
#: All phrases that the rules on units look for; one scan of a text tells which of them it holds.
PHRASES = sorted(
    {*sum(dims.SIGNAL_PHRASES.values(), []), *dims.COMPARISON_PHRASES, *dims.CAUSE_PHRASES, *dims.EFFECT_PHRASES, *dims.ORDINAL_WORDS, *FORMULA_CUES, *DEFINITION_CUES}
    | {*sum(dims.INTENT_KEYWORDS.values(), []), *dims.FILLER_PHRASES, *sum(dims.VISUAL_PHRASES.values(), [])}
)
#: The same matches, with a look at the character ahead before all branches are tried (a range or single Latin ones, which Java tests fast).
NUMBER = "(?=[$-9])" + dims.NUMBER
DATE = "(?=[jfmasondJFMASOND0123456789])" + dims.DATE


def _block(text: Column, heading: bool) -> Column:
    return F.struct(
        text.alias("text"), F.lit(heading).alias("is_heading"), F.lit(int(heading)).alias("heading_level"), F.lit(int(not heading)).alias("bullet_level"), F.lit(False).alias("is_bold"), F.lit(None).cast("double").alias("font_size")
    )


def with_items(units: DataFrame) -> DataFrame:
    """Adds _items, the unit's blocks, and the optional columns that units lacks."""
    missing = {}
    for name, (kind, value) in OPTIONAL.items():
        empty = F.array().cast(kind) if value is None else F.lit(value).cast(kind)
        missing[name] = F.coalesce(F.col(name).cast(kind), empty) if name in units.columns else empty
    out = units.withColumns(missing)
    if "blocks" in units.columns:
        return out.withColumn("_items", F.filter(F.col("blocks").cast(f"array<{BLOCK}>"), lambda b: F.coalesce(b["text"], F.lit("")) != "")).drop("blocks")
    body = F.filter(F.transform(lines(F.col("text")), without_marker), lambda x: x != "")
    head = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.array().cast(f"array<{BLOCK}>")).otherwise(F.array(_block(F.col("title"), True)))
    return out.withColumn("_items", F.concat(head, F.transform(body, lambda x: _block(x, False))))


def with_sentences(units: DataFrame) -> DataFrame:
    """Adds _items, _blocks (texts of the body), _text, _sentences, _low, _low_blocks and _low_text (in lower case), and _known (those of PHRASES in _low_text)."""
    out = with_items(units)
    out = out.withColumn("_blocks", F.transform(F.filter("_items", lambda b: ~b["is_heading"]), lambda b: b["text"]))
    notes = F.when(F.col("notes") == "", F.array().cast(TEXTS)).otherwise(F.array("notes"))
    out = out.withColumn("_text", F.array_join(F.concat(F.transform("_items", lambda b: b["text"]), notes), " "))
    out = out.withColumn("_sentences", sentences(F.col("_text"))).withColumns({"_low": F.transform("_sentences", F.lower), "_low_blocks": F.transform("_blocks", F.lower), "_low_text": F.lower("_text")})
    return out.withColumn("_known", phrases_in(F.col("_low_text"), PHRASES))


def sentence_table(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, sentence)."""
    return exploded(with_sentences(units), "_sentences", "doc_id", "unit_id", value="sentence")


def _told(items: Column, lowered: Column) -> Column:
    """(s, low): items with their lower-case forms, in the array lowered."""
    return F.zip_with(items, lowered, lambda s, low: F.struct(s.alias("s"), low.alias("low")))


def known_of(phrases: list[str], known: Column | str = "_known") -> Column:
    """Those of the phrases, in their order, that a unit's text holds."""
    return F.array_intersect(F.array(*map(F.lit, phrases)), known)


def _where_any(known: Column, phrases: list[str], use, nothing: Column) -> Column:
    """use(those of the phrases that a unit's text holds), nothing if it holds none: its sentences are read only
    where there is something to find, and for what is there."""
    return let(known_of(phrases, known), lambda some: F.when(F.size(some) > 0, use(some)).otherwise(nothing))


def holds_one(low: Column, known: Column) -> Column:
    return F.exists(known, lambda p: low.contains(p))


def _first(told: Column, test, most: int, value=lambda s: s) -> Column:
    """What dedupe makes of the values of the items that pass test on their lower-case form; no item is looked at beyond the last one kept."""

    def add(out: Column, x: Column) -> Column:
        return F.when((x == "") | F.exists(out, lambda o: F.lower(o) == F.lower(x)), out).otherwise(F.concat(out, F.array(x)))

    def step(out: Column, x: Column) -> Column:
        return F.when(F.size(out) >= most, out).when(test(x["low"]), let(strip(value(x["s"])), lambda v: add(out, v))).otherwise(out)

    return F.aggregate(told, F.array().cast(TEXTS), step)


def _halves(sentence: Column, lowered: Column, phrase: Column) -> tuple[Column, Column]:
    """What stands before and after a phrase's first place in a sentence, without commas and semicolons there."""
    at = F.instr(lowered, phrase)
    left = F.rtrim(strip(F.substring(sentence, F.lit(1), at - 1)), F.lit(",;"))
    right = F.ltrim(strip(F.substring(sentence, at + F.length(phrase), F.length(sentence))), F.lit(",;"))
    return left, right


def _cut_at(sentence: Column, lowered: Column, known: Column, most: int) -> Column:
    """(left, right, aspect) of a sentence at the first of the phrases in the array known that it has; null if it has none or a side is empty."""

    def parts(phrase: Column) -> Column:
        left, right = _halves(sentence, lowered, phrase)
        return F.struct(left.alias("left"), right.alias("right"), phrase.alias("aspect"))

    def whole(p: Column) -> Column:
        return F.when((p["left"] != "") & (p["right"] != ""), F.struct(F.substring(p["left"], 1, most).alias("left"), F.substring(p["right"], 1, most).alias("right"), p["aspect"].alias("aspect")))

    return let(F.get(F.filter(known, lambda p: lowered.contains(p)), F.lit(0)), lambda phrase: F.when(phrase.isNotNull(), let(parts(phrase), whole)))


def phrase_signals(sents: Column, lowered: Column, blocks: Column, low_blocks: Column, known: Column, items: Column) -> dict[str, Column]:
    """Sentences that hold a signal's phrase, first ones kept; advantages and disadvantages take body blocks too, facts bold ones."""
    out = {}
    for kind, phrases in dims.SIGNAL_PHRASES.items():
        most, told = dims.SIGNAL_CAPS[kind], _told(sents, lowered)
        if kind in ("advantage", "disadvantage"):
            told = F.concat(told, _told(blocks, low_blocks))
        found = _where_any(known, phrases, lambda some, told=told, most=most: _first(told, lambda low: holds_one(low, some), most), F.array().cast(TEXTS))
        if kind == "fact":
            found = dedupe(F.concat(found, F.transform(F.filter(items, lambda b: b["is_bold"] & ~b["is_heading"]), lambda b: b["text"])), most)
        out[kind] = found
    return out


def comparisons(sents: Column, lowered: Column, known: Column, tables: Column, most: int = 6) -> Column:
    """(left, right, aspect) of sentences with a comparison phrase, then of tables with two headers or more."""
    nothing = F.array().cast(PAIR)

    def found(some: Column) -> Column:
        def step(out: Column, x: Column) -> Column:
            pair = let(_cut_at(x["s"], x["low"], some, 100), lambda p: F.when(p.isNull(), out).otherwise(F.concat(out, F.array(p))))
            return F.when(F.size(out) >= most, out).when(holds_one(x["low"], some), pair).otherwise(out)

        return F.aggregate(_told(sents, lowered), nothing, step)

    headed = F.transform(
        F.filter(tables, lambda t: F.size(t["headers"]) >= 2),
        lambda t: F.struct(F.element_at(t["headers"], 1).alias("left"), F.element_at(t["headers"], 2).alias("right"), F.lit("table comparison").alias("aspect")),
    )
    return F.slice(F.concat(_where_any(known, dims.COMPARISON_PHRASES, found, nothing), headed), 1, most)


def causes(sents: Column, lowered: Column, known: Column, most: int = 6) -> Column:
    """(cause, effect) of sentences with a cause phrase or an effect phrase; a pair by effect that is there already is left out."""
    nothing = F.array().cast("array<struct<cause:string,effect:string>>")

    def step(out: Column, x: Column, some: Column) -> Column:
        def more(both: Column) -> Column:
            first = F.when(both["c"].isNull(), out).otherwise(F.concat(out, F.array(F.struct(both["c"]["right"].alias("cause"), both["c"]["left"].alias("effect")))))

            def second(so_far: Column) -> Column:
                pair = F.struct(both["e"]["left"].alias("cause"), both["e"]["right"].alias("effect"))
                return F.when(both["e"].isNull() | F.exists(so_far, lambda p: (p["cause"] == both["e"]["left"]) & (p["effect"] == both["e"]["right"])), so_far).otherwise(F.concat(so_far, F.array(pair)))

            return let(first, second)

        found = F.struct(_cut_at(x["s"], x["low"], some["c"], 150).alias("c"), _cut_at(x["s"], x["low"], some["e"], 150).alias("e"))
        return F.when(F.size(out) >= most, out).when(holds_one(x["low"], some["c"]) | holds_one(x["low"], some["e"]), let(found, more)).otherwise(out)

    def pairs(some: Column) -> Column:
        folded = F.aggregate(_told(sents, lowered), nothing, lambda out, x: step(out, x, some))
        return F.when(F.size(some["c"]) + F.size(some["e"]) > 0, F.slice(folded, 1, most)).otherwise(nothing)

    return let(F.struct(known_of(dims.CAUSE_PHRASES, known).alias("c"), known_of(dims.EFFECT_PHRASES, known).alias("e")), pairs)


def numbers(text: Column, most: int = 12) -> Column:
    """Numbers with units, percentages, amounts and years, each with up to 30 characters on both sides, a leading partial word dropped."""
    return first_hits(text, NUMBER, 30, 30, most, lambda c: strip(F.regexp_replace(strip(c), r"^\S+\s", "")), text.rlike("[0-9]"))


def chronology(sents: Column, lowered: Column, known: Column, text: Column, most: int = 10) -> Column:
    """Dates with what stands around them, then sentences with an ordinal or temporal word."""
    dates = first_hits(text, DATE, 10, 60, most, lambda c: F.substring(strip(c), 1, 120), text.rlike("[0-9]"))
    word = r"\b(" + "|".join(dims.ORDINAL_WORDS) + r")\b"
    timed = _where_any(known, dims.ORDINAL_WORDS, lambda some: _first(_told(sents, lowered), lambda low: holds_one(low, some) & low.rlike(word), most, lambda s: F.substring(s, 1, 150)), F.array().cast(TEXTS))
    return dedupe(F.concat(dates, timed), most)


def steps(items: Column, text: Column, most: int = 10) -> Column:
    """The whole text without its marker if it begins with a step marker, then bullets of level 0 or 1 that do (marker kept)."""
    whole = let(
        strip(text),
        lambda t: F.when(t.rlike(dims.STEP) & (F.length(t) > 4), F.array(F.regexp_replace(t, dims.STEP, ""))).otherwise(F.array().cast(TEXTS)),
    )
    marked = F.filter(items, lambda b: b["bullet_level"].isin(0, 1) & ~b["is_heading"] & b["text"].rlike(dims.STEP))
    return dedupe(F.concat(whole, F.transform(marked, lambda b: b["text"])), most)


def definitions(items: Column, text: Column, known: Column) -> Column:
    """(term, definition): of 'term is defined as ...' and its like the last one of each term, and of 'Term: ...' blocks the first of terms not found so."""
    kind = "array<struct<term:string,definition:string>>"

    def cut(x: Column, pattern: str) -> Column:
        return F.struct(strip(F.regexp_extract(x, pattern, 1)).alias("term"), strip(F.regexp_extract(x, pattern, 2)).alias("definition"))

    def plain(p: Column) -> Column:
        return F.struct(strip(F.regexp_replace(p["term"], r"(?i)\s+(a|an|the)\s*$", "")).alias("term"), F.substring(p["definition"], 1, 300).alias("definition"))

    # No match goes past a point unless a cue ends right before it, so what lies between such points is matched alone, and only where it has a cue.
    cued = (F.size(known_of(DEFINITION_CUES, known)) > 0) | text.rlike(r"[iI][sS]\s+[aA][nN]?\s")
    parts = F.filter(F.split(text, dims.DEFINITION_END), lambda x: x.rlike(dims.DEFINITION_CUE))
    found = F.when(cued & text.rlike(dims.DEFINITION_CUE), F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(x, F.lit(dims.DEFINITION), F.lit(0))))).otherwise(F.array().cast(TEXTS))
    hits = F.transform(found, lambda h: cut(h, dims.DEFINITION))
    by_phrase = F.transform(F.filter(hits, lambda p: (F.length(p["term"]) >= 3) & (F.length(p["definition"]) >= 5)), plain)
    marked = F.transform(F.filter(items, lambda b: b["text"].contains(":") & strip(b["text"]).rlike(dims.COLON_DEFINITION)), lambda b: plain_colon(cut(strip(b["text"]), dims.COLON_DEFINITION)))

    def last(pairs: Column) -> Column:
        def pick(terms: Column) -> Column:
            return let(F.reverse(terms), lambda back: F.transform(F.array_distinct(terms), lambda t: F.element_at(pairs, (F.size(pairs) + 1 - F.array_position(back, t)).cast("int"))))

        return let(F.transform(pairs, lambda p: p["term"]), pick)

    def first(pairs: Column) -> Column:
        return let(F.transform(pairs, lambda p: p["term"]), lambda terms: F.transform(F.array_distinct(terms), lambda t: F.element_at(pairs, F.array_position(terms, t).cast("int"))))

    def both(phrased: Column) -> Column:
        known = F.transform(phrased, lambda p: p["term"])
        return F.concat(phrased, let(known, lambda k: F.filter(let(marked, first), lambda p: ~F.array_contains(k, p["term"]))))

    return let(let(by_phrase, last), both).cast(kind)


def plain_colon(p: Column) -> Column:
    return F.struct(p["term"].alias("term"), F.substring(p["definition"], 1, 300).alias("definition"))


def formulas(text: Column, known: Column, equations: Column, most: int = 8) -> Column:
    """Equations of the unit, then stretches of the text around a mathematical sign, then what follows 'formula', 'equation' or 'expression'."""
    # A match begins where its run of letters, digits and spaces does; stated, no run is read again from each of its characters.
    inline = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9\s])" + dims.FORMULA.replace("]+[", "]++[", 1)), F.lit(0))
    # Two ranges that hold all signs are looked for first: a set of single signs beyond Latin is slow to test.
    some = (text.rlike("[=^\u00b1\u00d7\u00f7]") | text.rlike("[\u0394-\u2265]")) & text.rlike("[" + dims.FORMULA_SIGNS.replace("^", r"\^") + "]")
    signed = F.when(some, inline).otherwise(F.array().cast(TEXTS))
    fit = F.filter(F.transform(signed, strip), lambda x: F.length(x).between(4, 200))
    worded = F.when((F.size(known_of(FORMULA_CUES, known)) > 0), F.regexp_extract_all(text, F.lit(dims.FORMULA_WORD), F.lit(1))).otherwise(F.array().cast(TEXTS))
    named = F.transform(worded, lambda x: F.substring(strip(x), 1, 150))
    return dedupe(F.concat(F.transform(equations, strip), fit, named), most)


def bullet_lists(items: Column, tables: Column, most: int = 8) -> Column:
    """Runs of two bullets or more, then headers and columns of tables: an array of lists."""

    def bullet(i: Column) -> Column:
        return F.coalesce((F.get(items, i)["bullet_level"] > 0) & (strip(F.get(items, i)["text"]) != ""), F.lit(False))

    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: bullet(i) & ((i == 0) | ~bullet(i - 1)))
    ends = F.filter(places, lambda i: bullet(i) & ((i == F.size(items) - 1) | ~bullet(i + 1)))
    runs = F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda r: r["b"] > r["a"])
    listed = F.transform(F.slice(runs, 1, most), lambda r: F.transform(F.slice(items, r["a"] + 1, r["b"] - r["a"] + 1), lambda b: strip(b["text"])))

    def columns(t: Column) -> Column:
        wide = F.greatest(F.size(t["headers"]), F.coalesce(F.array_max(F.transform(t["rows"], F.size)), F.lit(0)))
        some = F.when(wide > 0, F.sequence(F.lit(0), wide - 1)).otherwise(F.array().cast("array<int>"))
        cells = F.transform(some, lambda c: F.filter(F.transform(t["rows"], lambda r: strip(F.get(r, c))), lambda v: v.isNotNull() & (v != "")))
        headed = F.when(F.size(t["headers"]) > 0, F.array(t["headers"])).otherwise(F.array().cast("array<array<string>>"))
        return F.concat(headed, F.filter(cells, lambda c: F.size(c) > 0))

    return F.slice(F.concat(listed, F.flatten(F.transform(tables, columns))), 1, most)


def questions(sents: Column, lowered: Column, most: int = 6) -> Column:
    """(question, answer): a question is followed by its answer, which is not a question in turn.

    In a run of question sentences the odd ones ask and the even ones answer, so a fold over a flag is enough.
    """

    def asks(s: Column, low: Column) -> Column:
        return F.endswith(s, F.lit("?")) | (F.regexp_extract(low, LETTER_WORD, 0).isin(*dims.QUESTION_WORDS) & (F.size(words(s)) < 15))

    flags = F.zip_with(sents, lowered, lambda s, low: F.struct(s.alias("s"), asks(s, low).alias("asks")))
    zero = F.struct(F.array().cast("array<struct<question:string,answer:string>>").alias("out"), F.lit(False).alias("skip"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        ask = ~a["skip"] & x["asks"]
        answer = F.coalesce(F.get(sents, a["i"] + 1), F.lit(""))
        pair = F.array(F.struct(x["s"].alias("question"), answer.alias("answer")))
        return F.struct(F.when(ask & (F.size(a["out"]) < most), F.concat(a["out"], pair)).otherwise(a["out"]).alias("out"), ask.alias("skip"), (a["i"] + 1).alias("i"))

    return F.aggregate(flags, zero, step, lambda a: a["out"])


def key_concepts(items: Column, title: Column, most: int = 10) -> Column:
    """Parts between separators of heading, bold and large blocks, and the title's runs of capitalised words."""
    marked = F.filter(items, lambda b: (b["is_heading"] | b["is_bold"] | (F.coalesce(b["font_size"], F.lit(0.0)) >= 20)) & (F.length(strip(b["text"])) > 1))
    parts = F.flatten(F.transform(marked, lambda b: F.filter(F.transform(F.split(b["text"], r"[:\-–|/]"), strip), lambda p: F.length(p) > 1)))
    return dedupe(F.concat(parts, F.regexp_extract_all(title, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), F.lit(0))), most)


def word_set(text: Column) -> Column:
    """A text's distinct lower-case runs of letters and apostrophes."""
    return F.array_distinct(letter_words(text))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets; 0 if one is empty."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(n / (F.size(a) + F.size(b) - n)))


def supporting_concepts(items: Column, concepts: Column, most: int = 8) -> Column:
    """Plain body blocks of five characters or more that are no figures and not like a key concept, 120 characters of each."""
    body = F.transform(F.filter(items, lambda b: ~b["is_heading"] & ~b["is_bold"]), lambda b: strip(b["text"]))

    def fit(t: Column, sets: Column) -> Column:
        return (F.length(t) >= 5) & ~t.rlike(r"^[0-9\s.,%$\-]+$") & ((F.size(sets) == 0) | let(word_set(t), lambda w: ~F.exists(sets, lambda c: overlap(w, c) > 0.7)))

    return let(F.transform(concepts, word_set), lambda sets: _first(_told(body, body), lambda t: fit(t, sets), most, lambda t: F.substring(t, 1, 120)))


def relationships(sents: Column, lowered: Column, concepts: Column, most: int = 10) -> Column:
    """(subject, predicate, object, confidence) of sentences with two key concepts; the predicate comes from the first verb group found."""

    def link(s: Column, i: Column) -> Column:
        low = F.get(lowered, i)
        kind = F.coalesce(*[F.when(contains_any(low, verbs), F.lit(name)) for name, verbs in dims.LINK_VERBS], F.lit("UNKNOWN"))

        def row(here: Column) -> Column:
            made = let(kind, lambda k: F.struct(F.element_at(here, 1).alias("subject"), k.alias("predicate"), F.element_at(here, 2).alias("object"), F.when(k == "UNKNOWN", 0.3).otherwise(0.7).alias("confidence")))
            return F.when(F.size(here) >= 2, made)

        return let(F.filter(concepts, lambda c: low.contains(F.lower(c))), row)

    found = F.filter(F.transform(sents, link), lambda x: x.isNotNull())
    return F.when(F.size(concepts) >= 2, F.slice(found, 1, most)).otherwise(F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>"))


def add_signals(units: DataFrame) -> DataFrame:
    """units plus the helper columns of with_sentences and an array column per signal, E2 to E19."""
    sents, low, blocks, items, text, known = (F.col(c) for c in ("_sentences", "_low", "_blocks", "_items", "_text", "_known"))
    out = with_sentences(units).withColumns(
        phrase_signals(sents, low, blocks, F.col("_low_blocks"), known, items)
        | {
            "comparison": comparisons(sents, low, known, F.col("tables")),
            "cause": causes(sents, low, known),
            "number": numbers(text),
            "chronology": chronology(sents, low, known, text),
            "step": steps(items, text),
            "definition": definitions(items, text, known),
            "formula": formulas(text, known, F.col("equations")),
            "list": bullet_lists(items, F.col("tables")),
            "faq": questions(sents, low),
            "concept": key_concepts(items, F.coalesce("title", F.lit(""))),
        }
    )
    return out.withColumns({"supporting": supporting_concepts(items, F.col("concept")), "relationship": relationships(sents, low, F.col("concept"))})


def unit_signals(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, title, and an array column per signal): E2 to E19 in one projection."""
    return add_signals(units).select("doc_id", "unit_id", "title", *KINDS)


#: Signals that are arrays of texts, and all of them.
TEXT_KINDS = [*dims.SIGNAL_PHRASES, "number", "chronology", "step", "formula", "concept", "supporting"]
KINDS = [*TEXT_KINDS, "comparison", "cause", "definition", "list", "faq", "relationship"]


def explode_signals(signals: DataFrame, kinds=tuple(dims.SIGNAL_PHRASES)) -> DataFrame:
    """(doc_id, unit_id, kind, ord, value) of text signals."""
    pairs = F.flatten(F.array(*[_kind(k) for k in kinds]))
    return exploded(signals, pairs, "doc_id", "unit_id", pos="_at").select("doc_id", "unit_id", "x.kind", "x.ord", "x.value")


def _kind(kind: str) -> Column:
    return F.transform(F.col(kind), lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), v.alias("value")))


def signal_counts(signals: DataFrame) -> DataFrame:
    """(doc_id, unit_id, n_<signal>...)."""
    return signals.select("doc_id", "unit_id", *[F.size(k).alias(f"n_{k}") for k in KINDS])


def glossary(signals: DataFrame) -> DataFrame:
    """(term, n_docs, definition): the corpus' terms with the definition of the smallest document."""
    terms = exploded(signals, "definition", "doc_id").select("doc_id", "x.term", "x.definition")
    return terms.groupBy("term").agg(F.count_distinct("doc_id").alias("n_docs"), F.min_by("definition", "doc_id").alias("definition"))


def main_topics(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, topic): the title unless it is 'slide n', else the first heading, else the first block's 80 characters."""
    return with_items(units).select("doc_id", "unit_id", topic_of(F.col("title"), F.col("_items")).alias("topic"))


def topic_of(title: Column, items: Column) -> Column:
    plain = strip(F.coalesce(title, F.lit("")))
    heading = F.get(F.filter(items, lambda b: b["is_heading"]), F.lit(0))["text"]
    own = F.when((plain != "") & ~plain.rlike(r"(?i)^slide\s+[0-9]+$"), plain)
    return F.coalesce(own, strip(heading), F.substring(strip(F.get(items, F.lit(0))["text"]), 1, 80), F.lit("Untitled Slide"))


def complexity_columns(with_text: DataFrame) -> DataFrame:
    """Adds vocab_richness, avg_sent_length, technical_density, element_count, max_bullet_depth, total_words and sentence_count to units with _text."""
    s = with_text.withColumn("_words", letter_words(F.col("_text")))
    total = F.greatest(F.size("_words"), F.lit(1))
    technical = F.size(F.filter("_words", lambda w: w.isin(*dims.TECHNICAL_TERMS)))
    n = F.size("_sentences")
    return s.withColumns(
        {
            "vocab_richness": round_even(F.size(F.array_distinct("_words")) / total, 4),
            "avg_sent_length": round_even(F.when(n > 0, total / n).otherwise(0.0), 2),
            "technical_density": round_even(technical / (total / 100), 2),
            "element_count": F.size("_items") + F.size("tables") + F.size("equations") + F.col("n_charts") + F.col("n_diagrams"),
            "special_elements": F.size("equations") * 1.0 + (F.size("tables") + F.col("n_charts") + F.col("n_diagrams")) * 0.8,
            "max_bullet_depth": F.coalesce(F.array_max(F.transform("_items", lambda b: b["bullet_level"])), F.lit(0)),
            "total_words": total,
            "sentence_count": n,
        }
    ).drop("_words")


def complexity_signals(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, vocab_richness, avg_sent_length, technical_density, element_count, max_bullet_depth, total_words, sentence_count)."""
    out = complexity_columns(with_sentences(units))
    return out.select("doc_id", "unit_id", "vocab_richness", "avg_sent_length", "technical_density", "element_count", "max_bullet_depth", "total_words", "sentence_count")
