"""The thin queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, scoring, sql, toxicity
from tessera.llm.audit import interactions
from tessera.llm.common import NULL_KEY, read_table
from tessera.llm.fingerprints import compared, with_neighbours
from tessera.llm.language import held_out, identify, learn, prototypes
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.phrases import collocations
from tessera.llm.quality import judged
from tessera.llm.rans import encode_files, read_documents
from tessera.llm.repeats import remove_repeats
from tessera.llm.urls import url_verdicts
from tessera.plans.shared import materialize

#: The rules of the url query: (host, path, action).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. Null texts are their end id; repeated rows are packed as often as they come."""
    pieces = pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeats. Null texts are empty, equal texts under a larger id go whole."""
    cut = remove_repeats(read_table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_rans_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from token files. Null texts are their end id; rows of one id stand in the order of a hash of their text."""
    files = materialize(encode_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2), "token_files")
    n = (F.octet_length("ids") / 4).cast("long")
    return read_documents(files).select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates. Null and wordless texts stand alone."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and the text decoded from them. Null texts have no ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and of their edited form, and how alike they are to their neighbours'. Null texts are empty."""
    rows = with_neighbours(read_table(spark, sf_dir, "documents"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    return compared(rows, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")}).drop("next_fingerprint")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages. Null texts and those without a letter are und."""
    docs = read_table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    known = prototypes(materialize(learn(docs.where(~out)), "prototypes"))
    return identify(docs, known).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts. Null texts have no words and fail; null languages and sources are groups of their own."""
    return judged(read_table(spark, sf_dir, "documents")).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on urls. A null url, or one without ``://``, has no rule and is allowed."""
    return url_verdicts(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of toxicity. Null and empty texts are scored as one empty window."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(toxicity.training_part(F.col("doc_id"))))
    rows = toxicity.scored(docs, model).select("row.doc_id", "score")
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of texts by word counts and by attention. Null texts are their end alone; null ids are in training."""
    train = ~held_out(F.nullif("k", F.lit(NULL_KEY)), 10, 0)
    rows = scoring.scored(read_table(spark, sf_dir, "documents"), train, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to five words. Null texts have no words, null languages are und."""
    return collocations(read_table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders. Null texts are empty, null languages a part of their own."""
    return interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries():
    import corpus_pipeline

    own = (op1_packing, op2_suffix_dedup, op3_rans_output, op4_minhash, op5_language, op6_quality, op7_bpe, op8_toxicity, op9_urls, op10_fingerprints, op11_lm_scoring, op12_phrases, op13_filter_audit)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Tokens, files, models and hashes of chunks have no SQL form; their queries are held against brute force in the tests."""
    return {"op2_suffix_dedup": sql.OP2, "op4_minhash": sql.OP4, "op9_urls": sql.OP9, "op12_phrases": sql.OP12, "op13_filter_audit": sql.OP13}
