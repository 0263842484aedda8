"""The thin contract queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import benchmark_hits
from .fim import fim_digests, fim_pieces
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality import quality
from .runs import periodic_runs
from .secrets import secret_scan
from .shards import kd_shards
from .substrings import substring_dedup
from .topk import top_k
from .toxicity import toxicity
from .warc import archive_round_trip


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op7_mixing": op7_mixing,
}


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op6_quality"] = op6_quality
QUERIES["op8_toxicity"] = op8_toxicity
QUERIES["op9_decontamination"] = op9_decontamination


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES["op10_topk_search"] = op10_topk_search


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(table(spark, sf_dir, "pages"), payloads=False)
    main = F.col("response")
    return found.select("page_id", main["payload_bytes"].alias("payload_bytes"), main["payload_digest"].alias("payload_digest"), main["type"].alias("record_type"), "refers_to")


QUERIES["op4_warc"] = op4_warc


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES["op5_substring_dedup"] = op5_substring_dedup


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


QUERIES["op2_secret_scans"] = op2_secret_scans


def planted_repeats(docs: DataFrame) -> DataFrame:
    """docs, with the end of every tenth text (by crc32 of the id) made periodic, as op13's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return docs.withColumn("text", F.when(h % 10 == 0, text).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # The longest run, then the smallest start, then the smallest period: the least of these triples.
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listing = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("first"), F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = F.col("first.s"), -F.col("first.l"), F.col("first.p")
    milli = F.floor(1000 * length / period)
    return best.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES["op13_periodic_runs"] = op13_periodic_runs


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(fim_pieces(table(spark, sf_dir, "documents")))


QUERIES["op11_fill_in_middle"] = op11_fill_in_middle


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op12_sharding"] = op12_sharding
