"""The registered queries of the corpus operators and, where SQL can say it, the SQL for their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import (
    collocations, dedup, hard_negatives, language_model, mixing, near_vectors, pieces, pii, quality, secret_scan, topk, toxicity, warc,
)
from kinelake.llm.common import read, span_digest, span_list, stage

#: A public vocabulary of pieces; another place is set by this configuration of the session.
VOCABULARY_CONF, VOCABULARY = "spark.kinelake.pieces", "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(spark: SparkSession) -> str:
    return spark.conf.get(VOCABULARY_CONF, VOCABULARY)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return topk.nearest(rows, rows.where("vec_id % 100 = 0"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stage(warc.write_archives(warc.plan_records(read(spark, sf_dir, "pages"))))
    records = warc.resolve(warc.read_archives(archives))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf_dir, "documents"), size=4)


def _counted(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and the list of all spans."""

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds],
        span_digest(base).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(secret_scan.scan(read(spark, sf_dir, "documents")), secret_scan.KINDS[:3])


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = pieces.encode(read(spark, sf_dir, "documents"), vocabulary(spark))
    return sampled.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "ids", "log_prob",
        "inclusion", "round_trip",
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(pii.extract(read(spark, sf_dir, "documents")), pii.KINDS[:4])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("quality")
    return judged.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), label=hard_negatives.shifted_label())


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_secrets": op5_secrets,
    "op6_pieces": op6_pieces,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_language_model": op9_language_model,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_near_vectors": op13_near_vectors,
}

ORACLE: dict[str, str] = {
    "op1_topk": topk.NEAREST_SQL,
    "op11_collocations": collocations.MINE_SQL,
    "op12_hard_negatives": hard_negatives.MINE_SQL,
    "op13_near_vectors": near_vectors.NEAR_SQL,
}
