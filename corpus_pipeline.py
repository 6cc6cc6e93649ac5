"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Stages, in order: language identification (texts without a sure language go),
n-gram Jaccard join (five words, 0.8: the document of the least id of each group
stays), suffix-array deduplication (repeated passages are cut out of texts),
benchmark decontamination (contaminated documents go) and byte-level BPE.

Within a stage a row is known by ``ROW``, a hash of its doc_id, text, language and
source; rows that differ in these but share the hash are found by a second one and
named anew.  So rows with a null doc_id or with one doc_id are told apart; rows that
are equal in all four are decided alike, and of them the second stage keeps one.
All other columns pass through all stages, whatever their names; the last stage adds
n_tokens, ids_sha256, decoded_sha256 and token_ids.  Without ``lang`` or ``source`` the
first stage has less evidence, and ``n_chars`` follows the text where it exists.  An
empty table passes through empty.  A stage's table goes when the next one is written,
the last one when the driver ends.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barproof.llm import bpe, decontaminate, graph, jaccard_join, language_id, suffix_dedup

ROW = "_pipeline_row"


def with_row(docs: DataFrame) -> DataFrame:
    known = [F.col(c).cast("string") for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    known += [c.isNull() for c in known]
    own = docs.withColumns({ROW: F.xxhash64(*known), "_other": F.xxhash64(F.lit("another hash"), *known)})
    # one hash for several rows is rare: some 300 pairs in 1e11 rows
    pairs = graph.left_over(own.groupBy(ROW).agg(F.min("_other").alias("_a"), F.max("_other").alias("_b")).where("_a <> _b").select(ROW))
    if pairs.isEmpty():
        return own.drop("_other")
    own = own.join(pairs.withColumn("_shared", F.lit(True)), ROW, "left")
    return own.withColumn(ROW, F.when(F.col("_shared"), F.xxhash64("_other", ROW)).otherwise(F.col(ROW))).drop("_other", "_shared")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = with_row(docs)
    known = own if "lang" in docs.columns else own.withColumn("lang", F.lit(None).cast("string"))
    found = language_id.identify(known, ROW, address_col="source" if "source" in docs.columns else None)
    return own.join(found.where("kept").select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = with_row(docs)
    groups = jaccard_join.jaccard_components(own, ROW).select(F.col("doc_id").alias(ROW), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    first = own.select("doc_id", ROW).join(groups, ROW).groupBy("component_id").agg(F.min(order).alias("least")).select(F.col(f"least.{ROW}").alias(ROW))
    return own.join(first, ROW, "left_semi").dropDuplicates([ROW]).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = with_row(docs)
    kept = suffix_dedup.remove_repeated_bytes(own, ROW).select(F.col("doc_id").alias(ROW), F.col("kept_text").alias("_kept_text")).dropDuplicates([ROW])
    out = own.join(kept, ROW).withColumn("text", F.when(F.col("text").isNotNull(), F.col("_kept_text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, items = with_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontaminate.decontaminate(own, items, ROW, full=False).where("contaminated").select(F.col("doc_id").alias(ROW))
    return own.join(bad, ROW, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = with_row(docs)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode_and_decode(own, ranks, public_tokenizers.PATTERN, ROW, outputs=("ids",)).dropDuplicates(["doc_id"])
    added = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    coded = coded.withColumnsRenamed({"doc_id": ROW, "ids": "token_ids"})
    return own.drop(*added).join(coded, ROW).select(*[c for c in docs.columns if c not in added], *added)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: Language identification and the parity sketches can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the cluster's shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        out = graph.new_folder(docs)
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            graph.delete(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
