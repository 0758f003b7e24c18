"""The text operators over the driver tables, with production parameters, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import chat, decontaminate, filter_audit, line_runs, mixing, near_documents, near_vectors, quality, repeats, scoring, sharding, token_counts, vector_codes
from foliant.llm.common import table


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix takes, with its source's size and target."""
    sizes = mixing.measured(table(spark, folder, "documents"))
    decided = mixing.plan(sizes)
    taken = mixing.copies(sizes, decided, keep=("source_size", "target"))
    return taken.select("doc_id", "size", "source_size", "target", (taken["copies"] * taken["size"]).alias("taken"), "source", "copies")


def op2_chat_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of each conversation as read back from the packed prefix tree."""
    return chat.query(spark, folder)


def op3_quality_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade of each document, and whether it is selected."""
    return quality.query(spark, folder)


def op4_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each document that repeat an earlier document."""
    return repeats.query(spark, folder)


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item."""
    return decontaminate.query(spark, folder)


def op6_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of each vector."""
    return near_vectors.query(spark, folder)


def op7_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.placed(table(spark, folder, "documents"))


def op8_near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near duplicates of each document."""
    return near_documents.query(spark, folder)


def op9_interpolated_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The log probability of each document."""
    return scoring.query(spark, folder)


def op10_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document that repeat an earlier run of three lines, or of fewer lines with 50 words together."""
    return line_runs.query(spark, folder)


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each filter removes at each step of every order, by language."""
    return filter_audit.query(spark, folder)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of each vector, with a digest of the codebooks."""
    return vector_codes.query(spark, folder)


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of each document."""
    return token_counts.query(spark, folder)


#: name: (query, SQL or None)
QUERIES = {
    "op1_mix_sources": (op1_mix_sources, None),
    "op2_chat_tree": (op2_chat_tree, None),
    "op3_quality_grades": (op3_quality_grades, None),
    "op4_repeated_bytes": (op4_repeated_bytes, None),
    "op5_decontaminate": (op5_decontaminate, None),
    "op6_near_vectors": (op6_near_vectors, None),
    "op7_rendezvous_shards": (op7_rendezvous_shards, None),
    "op8_near_documents": (op8_near_documents, None),
    "op9_interpolated_scores": (op9_interpolated_scores, None),
    "op10_line_runs": (op10_line_runs, line_runs.SQL),
    "op10_line_runs_by_words": (op10_line_runs, line_runs.SQL),  # the same query under its name of the last round
    "op11_filter_audit": (op11_filter_audit, filter_audit.SQL),
    "op12_vector_codes": (op12_vector_codes, vector_codes.SQL),
    "op13_token_counts": (op13_token_counts, None),
}
