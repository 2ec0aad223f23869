"""Words of a text matched to heard words, and sentences timed by them."""

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import to_ms
from ..functions.text import normal_word, word_tokens
from . import timeline


def match_sequences(text: list[str], heard: list[str]) -> list[tuple[int, int]]:
    """Index pairs of the longest matching blocks of two sequences of normal words; empty words never match."""
    a = [i for i, w in enumerate(text) if w]
    b = [i for i, w in enumerate(heard) if w]
    blocks = SequenceMatcher(None, [text[i] for i in a], [heard[i] for i in b], autojunk=False).get_matching_blocks()
    return [(a[x.a + k], b[x.b + k]) for x in blocks for k in range(x.size)]


def match_words(words: DataFrame, heard: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, word_pos, heard_pos) for words (keys, word_pos, norm) and heard (keys, heard_pos, norm).

    Each chapter is one group on either side: a sequence alignment needs both whole, and a chapter is bounded.
    """
    kinds = dict(words.dtypes)

    def match(key, w: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        w, h = w.sort_values("word_pos"), h.sort_values("heard_pos")
        pairs = match_sequences(w["norm"].tolist(), h["norm"].tolist())
        wp, hp = w["word_pos"].tolist(), h["heard_pos"].tolist()
        return pd.DataFrame([(*key, wp[i], hp[j]) for i, j in pairs], columns=[*keys, "word_pos", "heard_pos"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "word_pos long, heard_pos long"])
    side = lambda df, pos: df.select(*keys, pos, "norm").groupBy(*keys)
    return side(words, "word_pos").cogroup(side(heard, "heard_pos")).applyInPandas(match, schema)


def sentence_words(sentences: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """(keys, pos, word_pos, norm): words in order of sentence and place. word_pos is unique and rising, not dense."""
    w = sentences.select(*keys, pos, F.posexplode(word_tokens(F.col("text"))).alias("_i", "_w"))
    return w.select(*keys, pos, (F.col(pos).cast("long") * (1 << 24) + F.col("_i")).alias("word_pos"), normal_word(F.col("_w")).alias("norm"))


def align_sentences(sentences: DataFrame, heard: DataFrame, keys: Sequence[str], pos: str = "pos", least: float = 0.05) -> DataFrame:
    """Timeline of sentences (keys, pos, text, duration_s, ...) by heard (keys, heard_pos, word, start_s, end_s).

    Times of a sentence are the first start and last end of its matched words that have times; others are interpolated;
    confidence is the share of its words that match, timed or not.
    """
    words = sentence_words(sentences, keys, pos)
    pairs = match_words(words, heard.withColumn("norm", normal_word(F.col("word"))), keys)
    hit = pairs.join(words.select(*keys, pos, "word_pos"), [*keys, "word_pos"]).join(heard.select(*keys, "heard_pos", "start_s", "end_s"), [*keys, "heard_pos"])
    timed = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    found = hit.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("matched"), F.min(F.when(timed, F.col("start_s"))).alias("start_s"), F.max(F.when(timed, F.col("end_s"))).alias("end_s"))
    rows = sentences.join(found, [*keys, pos], "left").withColumn("chars", F.char_length("text")).withColumn("n_words", F.size(word_tokens(F.col("text"))))
    rows = timeline.interpolate_gaps(rows, keys, pos, "duration_s", least)
    rows = rows.withColumn("matched", F.coalesce("matched", F.lit(0))).withColumn("confidence", timeline.confidence(F.col("matched"), F.col("n_words")))
    rows = rows.withColumn("start_ms", to_ms(F.col("s_start"))).withColumn("end_ms", to_ms(F.col("s_end"))).withColumn("duration_ms", to_ms(F.col("duration_s")))
    return timeline.clamp(rows.drop("s_start", "s_end", "start_s", "end_s"), keys, pos, "duration_ms", max(1, round(least * 1000)))
