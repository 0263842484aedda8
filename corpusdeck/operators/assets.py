"""Assets: duplicates, size filters, and anchoring to the sections that discuss them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about a section's topic (fixed values).
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "is", "are", "was", "were", "be", "by", "as", "at", "from", "that", "this", "it", "its", "into", "than", "then", "but", "not", "can", "will", "step",
]
LEAST_OVERLAP = 0.25


def dedupe_assets(assets: DataFrame) -> DataFrame:
    """assets (doc_id, ord, content, ...) plus sha256, the first of equal contents in each document."""
    keyed = assets.withColumn("sha256", F.sha2("content", 256))
    first = keyed.groupBy("doc_id", "sha256").agg(F.min("ord").alias("ord"))
    return keyed.join(first, ["doc_id", "sha256", "ord"], "left_semi")


def filter_small_assets(assets: DataFrame, least: int = 100, icon: int = 120) -> DataFrame:
    """Assets of least x least pixels or more, with kind icon if both sides are below icon."""
    kept = assets.where((F.col("width") >= least) & (F.col("height") >= least))
    return kept.withColumn("kind", F.when((F.col("width") < icon) & (F.col("height") < icon), "icon").otherwise("figure"))


def _tokens(text) -> F.Column:
    parts = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(parts, lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS))


def anchor_assets(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, asset_ix, section_id, tier): the section each asset belongs to.

    Tier 1: the first section with the asset's unit title (in any case). Tier 2: the section that shares the
    largest share of the smaller word set, LEAST_OVERLAP at least, first on ties. Tier 3: the section at the
    asset's place, else the first. Words meet in an equi-join within a document.
    """
    keys = ["doc_id", "asset_ix"]
    title = F.lower(F.trim("title"))
    exact = (
        assets.where(F.trim("unit_title") != "")
        .select(*keys, F.lower(F.trim("unit_title")).alias("t"))
        .join(sections.select("doc_id", "section_id", title.alias("t")), ["doc_id", "t"])
        .groupBy(*keys)
        .agg(F.min("section_id").alias("exact"))
    )
    own = sections.select("doc_id", "section_id", _tokens(F.concat_ws(" ", "title", "text")).alias("w")).select("doc_id", "section_id", F.size("w").alias("ns"), F.explode("w").alias("w"))
    has = assets.select(*keys, _tokens(F.col("unit_text")).alias("w")).select(*keys, F.size("w").alias("na"), F.explode("w").alias("w"))
    shared = has.join(own, ["doc_id", "w"]).groupBy(*keys, "section_id", "na", "ns").agg(F.count(F.lit(1)).alias("n"))
    overlap = shared.withColumn("overlap", F.col("n") / F.least("na", "ns")).where(F.col("overlap") >= LEAST_OVERLAP)
    order = Window.partitionBy(*keys).orderBy(F.desc("overlap"), "section_id")
    alike = overlap.withColumn("r", F.row_number().over(order)).where("r = 1").select(*keys, F.col("section_id").alias("alike"))
    place = sections.select("doc_id", F.col("section_id").alias("unit_index"), F.col("section_id").alias("place"))
    out = assets.select(*keys, "unit_index").join(exact, keys, "left").join(alike, keys, "left").join(place, ["doc_id", "unit_index"], "left")
    tier = F.when(F.col("exact").isNotNull(), 1).when(F.col("alike").isNotNull(), 2).otherwise(3)
    return out.select(*keys, F.coalesce("exact", "alike", "place", F.lit(0)).alias("section_id"), tier.alias("tier"))


def attach_assets(units: DataFrame, anchored: DataFrame) -> DataFrame:
    """units plus images (asset_ix in order) and image (the first)."""
    per = anchored.groupBy("doc_id", F.col("section_id").alias("unit_id")).agg(F.array_sort(F.collect_list("asset_ix")).alias("images"))
    return units.join(per, ["doc_id", "unit_id"], "left").withColumn("image", F.try_element_at("images", F.lit(1)))


def attach_descriptions(chunks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """chunks (with image_sha256) whose image has a description get it appended to their text."""
    joined = chunks.join(descriptions.select(F.col("sha256").alias("image_sha256"), "description"), "image_sha256", "left")
    extra = F.concat(F.col("text"), F.lit("\n\n[Extracted OCR & Image Diagram Content:\n"), F.col("description"), F.lit("]"))
    return joined.withColumn("text", F.coalesce(extra, "text")).drop("description")


def needs_ocr_pages(pages: DataFrame, least_words: int = 30) -> DataFrame:
    """Pages (doc_id, page, n_words, n_assets, n_image_blocks) with hardly any words, or images that no asset covers."""
    return pages.where(((F.col("n_assets") == 0) & (F.col("n_image_blocks") > 0)) | (F.col("n_words") < least_words))


def primary_image(assets: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit_id, n_images, formats, place, format, content): of each unit the first asset that has bytes, else its rendered page.

    assets (doc_id, unit_id, ord, format, content) are all kept as formats in order; n_images counts them, and
    the rendered page (doc_id, unit_id, format, content) where it stands in. place is the asset's ord, -1 for a
    rendered page. Units come from both tables; one without any bytes has a null place, format and content.

    Which asset it is is decided on keys and lengths alone. Bytes are fetched afterwards, of the winners only;
    where the winners' keys are few enough to be broadcast, nobody else's bytes leave their task.
    Null and empty contents are no bytes. Of equal keys the row with more bytes counts, then the larger
    format, then the larger content. Null keys are keys.
    """
    keys = ["doc_id", "unit_id"]
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    fit = F.when(size > 0, F.struct(F.col("ord"), (-size).alias("less"), F.coalesce("format", F.lit("")).alias("format")))
    listed = assets.groupBy(*keys).agg(F.min(fit).alias("first"), F.sort_array(F.collect_list(F.struct("ord", "format"))).alias("all"))
    per = listed.select(*keys, F.col("first.ord").alias("place"), (-F.col("first.less")).alias("_size"), F.col("all.format").alias("formats"))
    won = per.where("place is not null").select(*[F.col(c).alias(f"_{c}") for c in keys], "place", "_size")
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("ord") == F.col("place"), size == F.col("_size")]
    best = F.max(F.struct(F.coalesce("format", F.lit("")).alias("_known"), "format", "content"))
    fetched = assets.where(size > 0).join(won, match).groupBy(*[f"_{c}" for c in keys]).agg(best.alias("best"))
    out = per.join(fetched, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left").select(*keys, "formats", "place", F.col("best.format").alias("format"), F.col("best.content").alias("content"))
    if rendered is None:
        return out.select(*keys, F.size("formats").alias("n_images"), "formats", "place", "format", "content")
    pages = rendered.where(size > 0).groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(best.alias("page"))
    both = out.join(pages, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "full")
    stands_in = F.col("place").isNull() & F.col("page").isNotNull()
    known = F.coalesce("formats", F.array().cast("array<string>"))
    unit = [F.when(F.col("formats").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in keys]
    all_of = F.when(stands_in, F.concat(known, F.array("page.format"))).otherwise(known)
    return both.select(
        *unit,
        F.size(all_of).alias("n_images"),
        all_of.alias("formats"),
        F.when(stands_in, -1).otherwise(F.col("place")).alias("place"),
        F.when(stands_in, F.col("page.format")).otherwise(F.col("format")).alias("format"),
        F.when(stands_in, F.col("page.content")).otherwise(F.col("content")).alias("content"),
    )
