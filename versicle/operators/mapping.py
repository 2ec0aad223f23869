"""Chapters to audio units: by position, by hand, or by titles in order."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import CREDIT_WORDS, normal_title, section_reason, similarity_of_normal


class MismatchError(ValueError):
    pass


def without(chapters: DataFrame, skipped: DataFrame, key: str = "id") -> DataFrame:
    """chapters but those in the skip list; entries are trimmed, empty ones ignored."""
    names = skipped.select(F.trim(key).alias(key)).filter(F.col(key) != "").distinct()
    return chapters.join(names, key, "left_anti")


def with_sentences(chapters: DataFrame, sentences: DataFrame, keys: Sequence[str]) -> DataFrame:
    return chapters.join(sentences.select(*keys).distinct(), list(keys), "left_semi")


def positional(chapters: DataFrame, units: DataFrame, book: Sequence[str], chapter_pos: str, unit_pos: str) -> DataFrame:
    """(book, rank, chapter_pos, unit_pos): the n-th with the n-th. One side is null where the counts differ."""
    a = chapters.select(*book, chapter_pos, F.row_number().over(Window.partitionBy(*book).orderBy(chapter_pos)).alias("rank"))
    b = units.select(*book, unit_pos, F.row_number().over(Window.partitionBy(*book).orderBy(unit_pos)).alias("rank"))
    return a.join(b, [*book, "rank"], "full_outer")


def require_matched(pairs: DataFrame, chapter_pos: str, unit_pos: str) -> DataFrame:
    """pairs, failing when one side is missing."""
    whole = F.col(chapter_pos).isNotNull() & F.col(unit_pos).isNotNull()
    return pairs.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("numbers of chapters and audio units differ")).cast("boolean")))


def by_hand(chapters: DataFrame, units: DataFrame, mapping: DataFrame, book: Sequence[str], chapter_pos: str, unit_pos: str) -> DataFrame:
    """mapping (book, chapter_index, unit_index) from 0; indexes out of bounds fail. In the mapping's order."""
    n = lambda df, c: df.withColumn("_i", F.row_number().over(Window.partitionBy(*book).orderBy(c)) - 1).select(*book, c, "_i")
    a, b = n(chapters, chapter_pos).withColumnRenamed("_i", "chapter_index"), n(units, unit_pos).withColumnRenamed("_i", "unit_index")
    return require_matched(mapping.join(a, [*book, "chapter_index"], "left").join(b, [*book, "unit_index"], "left"), chapter_pos, unit_pos)


def subsequence(chapters: list[tuple[str, str | None]], units: list[str], credit_words: tuple[str, ...] = CREDIT_WORDS, title_words: tuple[str, ...] = ("title", "credits", "author", "publisher")):
    """Best order-preserving match of units (titles) to chapters (title, reason to skip).

    Returns pairs (chapter, unit) and skipped chapters (chapter, reason), by position. Skipping a chapter with a reason
    is free, else costs 1; skipping a unit costs 100 unless it is credits. On ties a chapter is skipped rather than
    matched, and matched rather than the unit skipped.
    """
    m, n = len(chapters), len(units)
    if not m or not n:
        return [], [(i, "empty collection") for i in range(m)]
    names, heard = [normal_title(t) for t, _ in chapters], [normal_title(u) for u in units]

    def worth(j: int, i: int) -> float:
        name, unit = names[j], heard[i]
        if "opening credits" in unit or unit == "credits":
            return 80 if j <= 2 or any(w in name for w in title_words) else -100
        if "closing credits" in unit:
            return 80 if j + 1 >= m - 2 else -100
        if chapters[j][1] and not (unit and unit in name):
            return -100
        s = similarity_of_normal(name, unit, credit_words)
        return 50 + 50 * s if s > 0.5 else 50 * s if s > 0 else -20

    pass_chapter = [0 if reason else -1 for _, reason in chapters]
    pass_unit = [0 if "credits" in u else -100 for u in heard]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    step = [["chapter"] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            ways = []
            if j:
                ways.append((best[i][j - 1] + pass_chapter[j - 1], "chapter"))
            if i and j:
                ways.append((best[i - 1][j - 1] + worth(j - 1, i - 1), "match"))
            if i:
                ways.append((best[i - 1][j] + pass_unit[i - 1], "unit"))
            for k, (value, way) in enumerate(ways):
                if not k or value > best[i][j]:
                    best[i][j], step[i][j] = value, way
    pairs, skipped, i, j = [], [], n, m
    while i or j:
        way = step[i][j]
        i, j = i - (way != "chapter"), j - (way != "unit")
        if way == "match":
            pairs.append((j, i))
        elif way == "chapter":
            skipped.append((j, chapters[j][1] or "no matching audio unit"))
    return pairs[::-1], skipped[::-1]


def by_titles(chapters: DataFrame, units: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, chapter_pos, unit_pos or null, reason or null) from chapters (book, chapter_pos, title, preview, guide_type)
    and units (book, unit_pos, title). Each book is matched as a whole: its chapters and units, not their texts."""
    told = chapters.select(book, "chapter_pos", "title", section_reason(F.col("title"), F.col("preview"), F.col("guide_type")).alias("reason"))
    heard = units.select(book, "unit_pos", "title")

    def match(key, c: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        c, u = c.sort_values("chapter_pos"), u.sort_values("unit_pos")
        reasons = [r if isinstance(r, str) else None for r in c["reason"]]
        pairs, skipped = subsequence(list(zip(c["title"].fillna(""), reasons)), u["title"].fillna("").tolist())
        cp, up = c["chapter_pos"].tolist(), u["unit_pos"].tolist()
        rows = [(key[0], cp[j], up[i], None) for j, i in pairs] + [(key[0], cp[j], None, r) for j, r in skipped]
        out = pd.DataFrame(rows, columns=[book, "chapter_pos", "unit_pos", "reason"])
        return out.astype({"unit_pos": "Int64"})

    kind = dict(chapters.dtypes)[book]
    return told.groupBy(book).cogroup(heard.groupBy(book)).applyInPandas(match, f"{book} {kind}, chapter_pos long, unit_pos long, reason string")


def map_units(chapters: DataFrame, units: DataFrame, book: str = "book_id", manual: DataFrame | None = None) -> DataFrame:
    """(book, chapter_pos, unit_pos): by hand if a mapping is given; else by titles in books where every unit found its
    chapter; else by position, which fails in books where the counts differ."""
    if manual is not None:
        return by_hand(chapters, units, manual, [book], "chapter_pos", "unit_pos").select(book, "chapter_pos", "unit_pos")
    auto = by_titles(chapters, units, book).filter("unit_pos IS NOT NULL").select(book, "chapter_pos", "unit_pos")
    n = units.groupBy(book).agg(F.count(F.lit(1)).alias("n"))
    whole = auto.groupBy(book).agg(F.count(F.lit(1)).alias("k")).join(n, book).filter("k = n").select(book)
    rest = positional(chapters.join(whole, book, "left_anti"), units.join(whole, book, "left_anti"), [book], "chapter_pos", "unit_pos")
    rest = require_matched(rest, "chapter_pos", "unit_pos").select(book, "chapter_pos", "unit_pos")
    return auto.join(whole, book, "left_semi").unionByName(rest)
