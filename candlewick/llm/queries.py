"""The registered queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    blocks = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    rows = read_archives(blocks, with_data=False).where("last")
    return rows.select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op2_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orc_tokens import token_digests, write_token_ids

    path = new_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_digests(spark, path)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated_lines

    return deduplicated_lines(table(spark, sf_dir, "documents"))


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Ids of every text, decoded again: their number, and digests of ids and decoded text."""
    from .sentencepiece_lattice import encode

    back = encode(docs, tokenizer_path("piece_bpe_32k.model"), decoded=True)
    ids = F.md5(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_md5"), F.md5(F.col("text").cast("binary")).alias("decoded_md5"))


def op4_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import Machine, score, train

    docs, labels, machine = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Machine()
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0
    fitted = train(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")), machine)
    out = score(docs, fitted, machine)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix, mixed

    return mixed(table(spark, sf_dir, "documents"), Mix())


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_warc_chunks, op2_orc_token_ids, op3_line_dedup, op4_sentencepiece_lattice, op5_quality_rules, op6_factorisation_machine, op7_nearest_neighbours, op8_personal_data, op9_source_mixing, op10_simhash_near_dedup)}
