"""One query opN_<name> for each training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, filter_audit, mixing, neardup, packing, pii, quality, secrets, token_counts, token_files, whitening
from . import spans as S
from .common import read_table
from .encoding import read_spec
from .oracles import ORACLES  # noqa: F401


def _vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), read_spec(_vocabulary_path("byte_bpe_50k.json")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.join_turns(table.unionByName(added)))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    kinds = [S.count(F.col("base"), r.kind).alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select("doc_id", *kinds, F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    ranks = bpe.read_ranks(_vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), ranks, PATTERN, digests_only=True)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_labelled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), read_spec(_vocabulary_path("byte_bpe_50k.json")), end_id=0, sequence=1024)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(read_table(spark, sf_dir, "documents"), read_spec(_vocabulary_path("byte_bpe_50k.json")), end_id=2)
    back = token_files.read_token_files(spark, manifest)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    kinds = [S.count(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *kinds, F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"), pii.points(F.col("spans")).alias("scores"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_chat_formatting, op3_secret_scans, op4_bpe, op5_minhash_near_dedup,
        op6_quality_rules, op7_packing, op8_token_files, op9_pii, op10_exact_dedup,
        op11_source_mix, op12_whitening, op13_filter_audit,
    )
}

