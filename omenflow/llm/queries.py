"""The named queries of the training-data operators, and the SQL that some of them must agree with."""

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, hard_negatives, html_main, langid, licenses, line_dedup, minhash, mixing, ngram_lm, simhash, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(_table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_digest(_table(spark, sf_dir, "documents"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_digest(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negative_digest(_table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_corpus(_table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


NAMED = {f.__name__: f for f in (op1_line_dedup, op2_mix_sources, op3_toxicity, op4_simhash, op5_token_files, op6_main_text, op7_decontaminate, op8_language_id, op9_license_scan, op10_fingerprints, op11_lm_scores, op12_hard_negatives, op13_tokenizer_alignment)}
ORACLE = {"op1_line_dedup": line_dedup.LINE_SQL, "op2_mix_sources": mixing.mix_sql(), "op12_hard_negatives": hard_negatives.HARD_NEGATIVE_SQL}
