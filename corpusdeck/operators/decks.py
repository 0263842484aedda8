"""Pagination of slides to density profiles, quizzes, scores and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.rows import exploded
from ..functions.text import drop_restatements, round_even, strip, trim_bullet, words
from ..plans.specs import chain_text


def density_profiles(decks: DataFrame, density_col: str = "density") -> DataFrame:
    """decks plus the fields of their profile; unknown or null ones are the default."""
    name = F.lower(F.coalesce(F.col(density_col), F.lit("")))
    default = dims.PROFILES[dims.DEFAULT_PROFILE]
    for i, field in enumerate(dims.PROFILE_FIELDS):
        value = F.lit(default[i])
        for profile, numbers in dims.PROFILES.items():
            value = F.when(name == profile, F.lit(numbers[i])).otherwise(value)
        decks = decks.withColumn(field, value)
    return decks


def balanced_page(n: Column, size: Column, place: Column) -> Column:
    """The page (from 0) of item place (from 0) of n, in ceil(n / size) pages whose sizes differ by one at most."""
    pages = F.ceil(n / F.greatest(size, F.lit(1))).cast("int")
    base, extra = F.floor(n / pages), n % pages
    return F.when(place < extra * (base + 1), F.floor(place / (base + 1))).otherwise(extra + F.floor((place - extra * (base + 1)) / base)).cast("int")


def page_of(items: Column, size: Column, page: Column) -> Column:
    """The items of a page of an array; a page beyond the last has none."""
    n = F.size(items)
    pages = F.ceil(n / F.greatest(size, F.lit(1))).cast("int")
    base, extra = F.floor(n / F.greatest(pages, F.lit(1))).cast("int"), n % F.greatest(pages, F.lit(1))
    start = page * base + F.least(page, extra)
    length = base + (page < extra).cast("int")
    return F.when(page < pages, F.slice(items, start + 1, length)).otherwise(F.slice(items, 1, 0))


def balanced_pages(items: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """items plus page: each key's rows in order, in balanced pages of at most size."""
    group = Window.partitionBy(*keys)
    placed = items.withColumns({"_n": F.count(F.lit(1)).over(group), "_at": F.row_number().over(group.orderBy(*order)) - 1})
    return placed.withColumn("page", balanced_page(F.col("_n"), F.lit(size), F.col("_at"))).drop("_n", "_at")


def _bare(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", ""))


def without_title_restatements(bullets: Column, title: Column) -> Column:
    """Bullets that are not the title, nor a part of it of eight characters or more."""
    t = _bare(title)

    def restates(b: Column) -> Column:
        a = _bare(b)
        return (a != "") & (t != "") & ((a == t) | ((F.length(a) >= 8) & t.contains(a)))

    return F.filter(bullets, lambda b: ~restates(b))


def part_title(title: Column, page: Column, pages: Column) -> Column:
    base = strip(F.regexp_replace(title, r"\s*\([0-9]+/[0-9]+\)\s*$", ""))
    return F.when(pages <= 1, title).otherwise(F.concat(base, F.lit(" ("), (page + 1).cast("string"), F.lit("/"), pages.cast("string"), F.lit(")")))


def extras_of(items: Column) -> Column:
    """Up to items extras of the enhancement columns, the first non-blank text of each kind, with its label."""
    first = lambda c: F.get(F.filter(F.transform(F.col(c), strip), lambda x: x != ""), F.lit(0))
    labelled = F.array(*[F.concat(F.lit(f"{label}: "), first(column)) for label, column in dims.EXTRAS])
    return F.slice(F.filter(labelled, lambda x: x.isNotNull()), F.lit(1), items)


def with_profile(rows: DataFrame, density: str | DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """rows of decks and the fields of their profile as columns: those of one density for all, or of each deck's own.

    A table of densities (doc_id, density) is joined by doc_id, its numbers as columns beside each row. Decks
    that it lacks, null densities and unknown ones have the default profile; of several the alphabetically first counts.
    """
    if not isinstance(density, DataFrame):
        numbers = dims.PROFILES.get((density or "").lower(), dims.PROFILES[dims.DEFAULT_PROFILE])
        return rows, {f: F.lit(n) for f, n in zip(dims.PROFILE_FIELDS, numbers, strict=True)}
    own = density.groupBy(F.col("doc_id").alias("_deck")).agg(F.min("density").alias("_density"))
    joined = rows.join(own, F.col("doc_id").eqNullSafe(F.col("_deck")), "left").drop("_deck")
    fields = {f: f"_{f}" for f in dims.PROFILE_FIELDS}
    profiled = density_profiles(joined.withColumnsRenamed({f: f"__{f}" for f in dims.PROFILE_FIELDS if f in joined.columns}), "_density")
    back = profiled.withColumnsRenamed(fields).withColumnsRenamed({f"__{f}": f for f in dims.PROFILE_FIELDS}).drop("_density")
    return back, {f: F.col(name) for f, name in fields.items()}


def fold_extras(enhancements: DataFrame, density: str | DataFrame | None = None) -> DataFrame:
    """(doc_id, slide_ix, ord, extra): what a deck's profile shows of each slide's examples, analogies, applications, mistakes and revision points."""
    rows, profile = with_profile(enhancements, density)
    return exploded(rows, extras_of(profile["extras"]), "doc_id", "slide_ix", value="extra")


def apply_density(slides: DataFrame, density: str | DataFrame | None = None, enhancements: DataFrame | None = None) -> DataFrame:
    """(doc_id, slide_ix, page, layout_type, title, bullets, table_rows, takeaway, image, diagram, continued): slides within a profile, nothing lost.

    enhancements (doc_id, slide_ix and the columns of dims.EXTRAS) add the profile's extras to text slides. The
    image, where slides have one, stays on the first page; a flow's pages have a diagram of their own steps.

    METRIC and QUIZ slides stay whole; tables page their rows with the header on each page, and their lead
    bullets beside them; flows page their steps; other slides drop restatements of bullets and title first.
    A slide is one row and its pages are made from its arrays, so nothing is shuffled, but for a table of
    densities, which meets its decks' slides in a join (see with_profile).
    """
    slides, profile = with_profile(slides, density)
    layout = F.upper(F.coalesce("layout_type", F.lit("MINIMAL_TEXT")))
    bullets = F.coalesce("bullets", F.array().cast("array<string>"))
    trimmed = lambda xs: F.filter(F.transform(xs, lambda b: trim_bullet(b, profile["max_words"], profile["max_chars"])), lambda b: b != "")
    is_table = (layout == "TABLE") & (F.size(F.coalesce("table_rows", F.array().cast("array<array<string>>"))) > 1)
    is_flow = layout.isin("FLOWCHART", "PROCESS_DIAGRAM") & (F.size(bullets) > 0)
    atomic = layout.isin("METRIC", "QUIZ")
    extras = F.array().cast("array<string>")
    if enhancements is not None:
        columns = [c for _, c in dims.EXTRAS]
        joined = slides.join(enhancements.select("doc_id", "slide_ix", *[F.col(c).alias(f"_{c}") for c in columns]), ["doc_id", "slide_ix"], "left")
        slides = joined.withColumns({c: F.coalesce(f"_{c}", extras) for c in columns}).drop(*[f"_{c}" for c in columns])
        extras = extras_of(profile["extras"])
    text = F.concat(trimmed(without_title_restatements(drop_restatements(bullets), F.col("title"))), trimmed(extras))
    items = F.when(atomic, trimmed(F.slice(bullets, F.lit(1), profile["max_bullets"]))).when(is_table | is_flow, trimmed(bullets)).otherwise(text)
    size = F.when(is_flow, profile["max_steps"]).when(layout == "CARD_GRID", profile["max_cards"]).otherwise(profile["max_bullets"])
    rows = F.when(is_table, F.slice("table_rows", F.lit(2), F.size("table_rows") - 1)).otherwise(F.array().cast("array<array<string>>"))
    image = F.col("image") if "image" in slides.columns else F.lit(None).cast("string")
    diagram = chain_text(page_of(F.col("_items"), F.col("_size"), F.col("page")), "P", 40, "LR")
    whole = slides.withColumns({"_layout": layout, "_flow": is_flow, "_items": items, "_size": F.when(atomic, F.greatest(F.size(items), F.lit(1))).otherwise(size), "_rows": rows, "_head": F.when(is_table, F.slice("table_rows", 1, 1))})
    pages = F.greatest(F.lit(1), F.ceil(F.size("_items") / F.col("_size")), F.ceil(F.size("_rows") / profile["max_rows"])).cast("int")
    paged = whole.withColumn("_pages", pages)
    out = exploded(paged, F.sequence(F.lit(0), F.col("_pages") - 1), *paged.columns, pos="page", value="_at")
    own_rows = page_of(F.col("_rows"), profile["max_rows"], F.col("page"))
    return out.select(
        "doc_id",
        "slide_ix",
        "page",
        F.when((F.col("_layout") == "TABLE") & (F.size(own_rows) == 0) & (F.size("_rows") > 0), "MINIMAL_TEXT").otherwise(F.col("_layout")).alias("layout_type"),
        part_title(F.col("title"), F.col("page"), F.col("_pages")).alias("title"),
        page_of(F.col("_items"), F.col("_size"), F.col("page")).alias("bullets"),
        F.when(F.size(own_rows) > 0, F.concat("_head", own_rows)).alias("table_rows"),
        F.when(F.col("page") == F.col("_pages") - 1, F.col("takeaway")).otherwise("").alias("takeaway"),
        F.when(F.col("page") == 0, image).alias("image"),
        F.when(F.col("_flow"), diagram).alias("diagram"),
        (F.col("page") > 0).alias("continued"),
    )


def quiz_batches(slides: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, batch, n_slides, content): slides in batches of size, their bullets joined."""
    part = F.concat_ws("\n", F.col("title"), F.array_join("bullets", "\n"))
    grouped = slides.groupBy("doc_id", F.floor(F.col("slide_ix") / size).alias("batch")).agg(F.count(F.lit(1)).alias("n_slides"), F.array_sort(F.collect_list(F.struct("slide_ix", part.alias("part")))).alias("parts"))
    return grouped.select("doc_id", "batch", "n_slides", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("content"))


def interleave_quizzes(slides: DataFrame, quizzes: DataFrame, frequency: int = 4, inline: bool = True) -> DataFrame:
    """Quiz k of a document (quiz_no from 1) goes to slide k x frequency: onto it, or as a row of its own after it."""
    if frequency < 1:
        raise ValueError("frequency must be at least 1")
    plain = slides.withColumn("slide_no", F.col("slide_ix") + 1)
    asked = quizzes.select("doc_id", (F.col("quiz_no") * frequency).alias("slide_no"), F.struct("question", F.slice("options", 1, 4).alias("options"), "correct").alias("quiz"))
    if inline:
        return plain.join(asked, ["doc_id", "slide_no"], "left").drop("slide_no")
    there = plain.select("doc_id", "slide_no").join(asked, ["doc_id", "slide_no"]).select("doc_id", "slide_no", F.lit("QUIZ").alias("layout_type"), F.col("quiz.question").alias("title"), "quiz", F.lit(1).alias("_after"))
    both = plain.withColumn("_after", F.lit(0)).unionByName(there, allowMissingColumns=True)
    return both.withColumn("slide_ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("slide_no", "_after")) - 1).drop("slide_no", "_after")


def score_slides(slides: DataFrame, strict_reference: bool = False) -> DataFrame:
    """(doc_id, slide_ix, six parts, score): how engaging a slide is, out of 100.

    Where slides have a column has_image, or an image that is not null, 5 points are added for it, to a visual
    bonus of 15 at most. strict_reference keeps the formula's value beyond its bound for slides without bullets.
    """
    text = F.array_join("bullets", " ")
    w, n = words(text), F.size("bullets")
    count = F.size(w)
    mean = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / count
    t = F.size(words(F.coalesce("title", F.lit(""))))
    density = F.when(count.between(20, 80), 20.0).when(count < 20, 20.0 * (count / 20)).when(count <= 100, F.greatest(F.lit(0.0), 20.0 * (1 - (count - 80) / 20))).otherwise(5.0)
    many = F.greatest(F.lit(4.0), 20.0 - (n - 4) * 3.0)
    bullets = F.when(n.between(2, 4), 20.0).when(n == 5, 16.0).when(n == 1, 10.0).otherwise(many if strict_reference else F.least(F.lit(20.0), many))
    title = F.when(t.between(3, 8), 15.0).when(t < 3, 15.0 * (t / 3)).otherwise(F.greatest(F.lit(3.0), 15.0 * (1 - (t - 8) / 4)))
    takeaway = F.when(F.length(strip(F.coalesce("takeaway", F.lit("")))) > 5, 15.0).otherwise(0.0)
    readable = F.when(count == 0, 0.0).when(mean < 6.5, 15.0).when(mean < 8.5, F.greatest(F.lit(0.0), 15.0 * (1 - (mean - 6.5) / 2))).otherwise(4.0)
    layout = F.upper(F.coalesce("layout_type", F.lit("MINIMAL_TEXT")))
    visual = F.when(layout.isin("FLOWCHART", "TABLE", "METRIC", "QUIZ"), 10.0).when(layout == "CARD_GRID", 7.0).otherwise(0.0)
    image = F.coalesce(F.col("has_image"), F.lit(False)) if "has_image" in slides.columns else F.col("image").isNotNull() if "image" in slides.columns else F.lit(False)
    visual = F.least(F.lit(15.0), visual + F.when(image, 5.0).otherwise(0.0))
    parts = {"text_density": density, "bullet_count": bullets, "title_quality": title, "has_takeaway": takeaway, "readability": readable, "visual_bonus": visual}
    out = slides.select("doc_id", "slide_ix", *[round_even(c, 1).alias(k) for k, c in parts.items()])
    return out.withColumn("score", round_even(F.least(F.lit(100.0), sum((F.col(k) for k in parts), F.lit(0.0)))).cast("int"))


def score_decks(scores: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, overall_score, n_slides): the rounded mean of a deck's slide scores; 0 for documents without slides."""
    per = scores.groupBy("doc_id").agg(round_even(F.avg("score")).cast("int").alias("overall_score"), F.count(F.lit(1)).alias("n_slides"))
    if docs is None:
        return per
    joined = docs.select("doc_id").join(per, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("overall_score", F.lit(0)).alias("overall_score"), F.coalesce("n_slides", F.lit(0)).alias("n_slides"))


def score_breakdown(scores: DataFrame) -> DataFrame:
    """(doc_id, slide_ix, part, value): a row per part."""
    parts = ["text_density", "bullet_count", "title_quality", "has_takeaway", "readability", "visual_bonus"]
    return scores.unpivot(["doc_id", "slide_ix"], parts, "part", "value")


def keyword_top_k(chunks: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, doc_id, chunk_id, overlap): chunks by shared distinct lower-case words, ties in chunk order.

    An equi-join on words with a map-side combined count. Queries that fewer than k chunks share a word with
    are filled up with the corpus' first chunks at overlap 0, k + (at most k) of which are enough.
    """

    def tokens(text: str) -> Column:
        return F.explode(F.array_distinct(words(F.lower(F.coalesce(F.col(text), F.lit(""))))))

    own = chunks.select("doc_id", "chunk_id", tokens("text").alias("word"))
    asked = queries.select("query_id", tokens("text").alias("word"))
    shared = own.join(asked, "word").groupBy("query_id", "doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("overlap"))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "doc_id", "chunk_id")
    best = shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = chunks.select("doc_id", "chunk_id").orderBy("doc_id", "chunk_id").limit(2 * k)
    none = queries.select("query_id").join(F.broadcast(first)).withColumn("overlap", F.lit(0).cast("long"))
    both = best.drop("rank").unionByName(none.join(best.drop("overlap", "rank"), ["query_id", "doc_id", "chunk_id"], "left_anti"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "chunk_id", "overlap")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def join_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks of documents that have a vector, with it."""
    return chunks.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


#: Outcomes of a stage; others, as running, are no outcome (fixed values).
OUTCOMES = ["ok", "failed", "skipped"]


def run_stages(events: DataFrame) -> DataFrame:
    """(run, stage, place, status, seconds, detail) of events (run, stage, ts, event_id, status, seconds, detail): a run's stages in the order of their first outcome.

    A stage that ran more than once has its last outcome and all its seconds. place is the time and id of the first one.
    """
    ended = events.where(F.col("status").isin(*OUTCOMES) & F.col("stage").isNotNull())
    last = F.max(F.struct("ts", "event_id", "status", "detail"))
    per = ended.groupBy("run", "stage").agg(F.min(F.struct("ts", "event_id")).alias("place"), last.alias("x"), F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))
    return per.select("run", "stage", "place", "x.status", "seconds", F.coalesce("x.detail", F.lit("")).alias("detail"))


def run_summary(slides: DataFrame, quizzes: DataFrame, scores: DataFrame, events: DataFrame, decks: DataFrame | None = None) -> DataFrame:
    """(run, slide_count, quiz_count, overall_score, density_profile, total_seconds, stages): every run that any of the tables knows.

    slides, quizzes and scores (with score) have a doc_id, which is the run; decks (doc_id, density) names its
    profile. stages is an array of (name, status, seconds, detail) in order, see run_stages. Counts without rows
    are 0, the score without scores too, and the profile without a known density is the default.

    Each table is brought to the same narrow columns, and one aggregate over their union takes the place of
    full joins: a run's rows are combined before the only exchange, whatever table they come from.
    """
    none = {"slides": F.lit(0), "quizzes": F.lit(0), "score": F.lit(None).cast("double"), "density": F.lit(None).cast("string"), "stage": F.lit(None).cast("struct<place:struct<ts:timestamp,event_id:bigint>,name:string,status:string,seconds:double,detail:string>")}

    def rows(table: DataFrame, key: str, **own: Column) -> DataFrame:
        return table.select(F.col(key).cast("string").alias("run"), *[(own | {k: c for k, c in none.items() if k not in own})[k].alias(k) for k in none])

    place = F.struct(F.col("place.ts").cast("timestamp").alias("ts"), F.col("place.event_id").cast("bigint").alias("event_id"))
    stage = F.struct(place.alias("place"), F.col("stage").alias("name"), "status", F.col("seconds").cast("double").alias("seconds"), "detail")
    parts = [rows(slides, "doc_id", slides=F.lit(1)), rows(quizzes, "doc_id", quizzes=F.lit(1)), rows(scores, "doc_id", score=F.col("score").cast("double")), rows(run_stages(events), "run", stage=stage)]
    if decks is not None:
        parts.append(rows(decks, "doc_id", density=F.lower("density")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    known = F.min(F.when(F.col("density").isin(*dims.PROFILES), F.col("density")))
    per = whole.groupBy("run").agg(F.sum("slides").alias("slide_count"), F.sum("quizzes").alias("quiz_count"), F.avg("score").alias("mean"), known.alias("density"), F.sort_array(F.collect_list("stage")).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda t, x: t + x["seconds"])
    named = F.transform("all", lambda x: F.struct(x["name"].alias("name"), x["status"].alias("status"), round_even(x["seconds"], 2).alias("seconds"), x["detail"].alias("detail")))
    score = F.coalesce(round_even("mean").cast("int"), F.lit(0))
    return per.select("run", "slide_count", "quiz_count", score.alias("overall_score"), F.coalesce("density", F.lit(dims.DEFAULT_PROFILE)).alias("density_profile"), round_even(total, 2).alias("total_seconds"), named.alias("stages"))


def stage_outcomes(events: DataFrame) -> DataFrame:
    """(stage, status, n, mean_seconds, max_seconds) of stage events (stage, status, seconds); a null status is unknown."""
    return events.groupBy("stage", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"))


def stage_metrics(events: DataFrame) -> DataFrame:
    """(stage, n, mean_seconds, max_seconds) of stage events (run, stage, ts, seconds)."""
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"))


def run_progress(events: DataFrame, stages: list[str]) -> DataFrame:
    """(run, progress): how far a run's furthest stage is along stages."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    return events.groupBy("run").agg((F.max(place) / len(stages)).alias("progress"))


def latest_status(events: DataFrame) -> DataFrame:
    """(run, stage, ts, event_id): the last event of each run, ties to the larger id."""
    last = events.groupBy("run").agg(F.max(F.struct("ts", "event_id", "stage")).alias("x"))
    return last.select("run", "x.stage", "x.ts", "x.event_id")
