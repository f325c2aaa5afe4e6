"""A training corpus from `documents`: quality rules, line and near deduplication, mixing, and SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read as the next one's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domframe.llm import common, jaccard, line_dedup, mixing, pieces, quality_rules

#: The columns of documents; all stages but the last return them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are.

    Null and empty texts have no words and go; very long texts are judged whole; a null language is a language of its own.
    Rows that repeat id, text and language share one verdict and all stay or go. Other columns are dropped; an empty
    table stays empty.
    """
    return quality_rules.kept(docs).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; n_chars is that of the new text. Documents of which nothing is left go.

    The copy at the least doc_id stays, null ids last; within a text the first. Rows that repeat id and text are one
    document and get one result. Null texts become empty and stay, since nothing was removed from them. Texts of any
    length are taken whole; other columns, whatever their names, are dropped; an empty table stays empty.
    """
    out = line_dedup.line_dedup(docs.select(*[c for c in COLUMNS if c != "n_chars"]))
    left = out.where((F.length("text") > 0) | (F.size("removed") == 0))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id, of each group linked by SimHash and by five-word shingles of similarity 0.8 or more.

    Rows with one doc_id are told apart by their texts; of rows that repeat both, the least of the other columns stays.
    Null ids come last. Null and word-less texts are one group. Very long texts are shingled whole. Other columns are
    dropped; an empty table stays empty.
    """
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("_s")
    stay = found.groupBy("component").agg(order).select(F.col("_s.doc_id").alias("_d"), F.col("_s.text_hash").alias("_t"))
    rows = docs.join(stay, docs["doc_id"].eqNullSafe(stay["_d"]) & (F.xxhash64(docs["text"]) == stay["_t"]), "left_semi")
    return rows.groupBy("doc_id", F.xxhash64("text").alias("_t")).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_r")).select("doc_id", "_r.*").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, none more than twice, by output shard.

    Null texts have size 0; a null source is the last one. Rows that repeat a doc_id are drawn together, and equal hashes
    too. Only the number of words of a text counts, whatever its length. Other columns are dropped; an empty table stays
    empty.
    """
    return mixing.mix(docs.select(*COLUMNS))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the ids of each row of the mix, and of what they decode to.

    Null texts count as empty and have the end id only. Rows stay, repeats included, with their doc_id, null or not; other
    columns are ignored. Very long texts are encoded whole, one at a time. An empty table gives an empty result.
    """
    import public_tokenizers

    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("sentencepiece", piece_stage)]

#: Several stages are no SQL: perplexity bands, seeded draws and piece merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's table goes once the next one's is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = common.written(stage(spark, docs, sf_dir), name)
        common.discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
