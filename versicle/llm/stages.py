"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all of docs.

All but the last return the columns of docs, whatever their names. An empty table stays empty.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, piece_codec, rule_ensemble, shingle_join
from .common import boxed, table, text_of, unboxed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null texts count as empty; rows that repeat are judged each, all alike.
    Without usable labels all scores are 0.5 and all stay; so do, or go, all with labels of one class."""
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    scored = rule_ensemble.classify(boxed(docs, text=text_of()), model)
    return unboxed(scored.filter(F.col("_score") >= rule_ensemble.THRESHOLD), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them. Null texts and rows without an id stay as they are; rows
    that repeat an id are one document. n_chars, where docs has it, follows the text."""
    out = line_dedup.dedup_lines(boxed(docs, doc_id=F.col("doc_id"), text=F.col("text")))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        old = F.col("row").getField("n_chars")
        new["n_chars"] = F.when(F.col("_n_dropped") > 0, F.char_length("text")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return unboxed(out, docs.columns, **new)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id stays: five-word shingles, similar by 0.8 or more; the
    op6 query has four words and 0.85. Documents are rows, not ids: rows that repeat an id with other texts are judged
    each, a null id comes after all others, and rows that repeat both id and text are one. Texts without words stay."""
    found = shingle_join.join(docs.select("doc_id", "text"), size=5, percent=80)
    alone, empty = F.col("c").isNull(), F.col("n_shingles") == 0
    group = ["c", *(F.when(alone, F.col(k)).alias(k) for k in "vw"), *(F.when(empty, F.col(g)).alias(f"e{g}") for g in ("g1", "g2"))]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "g1", "g2")).alias("first")
    stays = found.groupBy(*group).agg(first).select(F.col("first.g1").alias("g1"), F.col("first.g2").alias("g2"))
    one, two = shingle_join.row_key()
    keyed = boxed(docs, g1=one, g2=two).hint("merge")
    return unboxed(keyed.join(stays.hint("merge"), ["g1", "g2"], "left_semi").dropDuplicates(["g1", "g2"]), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Null and empty texts hold none; rows that repeat go or stay together."""
    found = decontamination.contamination(boxed(docs, doc_id=F.col("doc_id"), text=F.col("text")), table(spark, sf_dir, "benchmark"))
    return unboxed(found.filter("_n_hit = 0"), docs.columns)


def tokens(model: bytes):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """(doc_id, n_tokens, ids, text): ids with an end id, and the text that they decode to. Null and empty texts
        have the end id only and decode to nothing; null ids and rows that repeat are kept; no other column is."""
        return piece_codec.round_trip(docs, model)

    return stage
