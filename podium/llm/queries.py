"""The operators as named queries over the whole test tables: op1 to op13."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import (
    align, chat, codes, decontaminate, licences, line_dedup, mixing, pii, quality, simhash, toxicity, url_filter, warc,
)
from podium.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_chat_formatting(spark, folder):
    """All conversations and one made of control strings, formatted and read back."""
    own = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.render_conversations(turns))


@query
def op2_simhash_dedup(spark, folder):
    """Fingerprints and near-duplicate components of all documents."""
    linked = simhash.near_components(read_table(spark, folder, "documents"))
    return linked.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_pii(spark, folder):
    """Personal data and disclosing terms of every document."""
    found = pii.find_personal_data(read_table(spark, folder, "documents"))
    return found.withColumn("base_sha256", F.sha2(F.col("base_spans"), 256)).drop("base_spans")


@query
def op4_url_filters(spark, folder):
    """The verdict on every page's url."""
    return url_filter.judge_urls(read_table(spark, folder, "pages"))


@query
def op5_toxicity(spark, folder):
    """Toxicity scores of all documents."""
    return toxicity.toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op6_quality_rules(spark, folder):
    """Counters and the verdict on every document."""
    return quality.judge_quality(read_table(spark, folder, "documents"))


@query
def op7_mixing(spark, folder):
    """How often the mix takes every document."""
    mix = mixing.mix(read_table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "repeats")


@query
def op8_warc(spark, folder):
    """Every page archived and read back."""
    archive = warc.write_archive(read_table(spark, folder, "pages"))
    return warc.parse_records(warc.read_archive(archive))


@query
def op9_decontamination(spark, folder):
    """Every document and benchmark item of which it has a passage."""
    return decontaminate.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op10_license_scans(spark, folder):
    """Licences named in every document."""
    return licences.licence_scan(read_table(spark, folder, "documents"))


@query
def op11_cross_tokenizer_alignment(spark, folder):
    """Tokens of two tokenizers aligned in all documents."""
    aligned = align.align_documents(read_table(spark, folder, "documents").select("doc_id", "text"), digests=True)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query
def op12_vector_codes(spark, folder):
    """All usable vectors as codes."""
    coded, books = codes.compress(read_table(spark, folder, "embeddings"))
    result = codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error")
    return result.withColumn("codebooks_sha256", F.lit(codes.codebooks_sha256(books)))


@query
def op13_line_dedup(spark, folder):
    """All documents without the lines that many documents have."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    index = line_dedup.insert_documents(line_dedup.empty_index(spark), docs)
    kept = line_dedup.dedup_lines(docs, index)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
