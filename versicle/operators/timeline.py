"""Timelines: numbering, gap interpolation, clamping, continuous clips, checks and durations.

A timeline has rows in order of `pos` within `keys` (a book and a chapter). Windows are partitioned by keys; only
number_in_book orders across chapters, and does so by sums of blocks.
"""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import half_even
from ..functions.clock import hms_clock

BLOCK = 1024


def number_in_book(rows: DataFrame, book: Sequence[str], chapter: str, pos: str, name: str = "number") -> DataFrame:
    """rows with a running number from 1 over chapters and positions of each book.

    Chapters are counted, counts are summed in blocks of BLOCK chapters, and block sums are summed in turn, so the
    only window over a whole book has one row for each block.
    """
    counts = rows.groupBy(*book, chapter).agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col(chapter) / BLOCK))
    blocks = counts.groupBy(*book, "_block").agg(F.sum("_n").alias("_sum"))
    heads = blocks.withColumn("_head", F.coalesce(F.sum("_sum").over(_before(Window.partitionBy(*book).orderBy("_block"))), F.lit(0))).drop("_sum")
    starts = counts.join(heads, [*book, "_block"]).withColumn("_before", F.col("_head") + F.coalesce(F.sum("_n").over(_before(Window.partitionBy(*book, "_block").orderBy(chapter))), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*book, chapter).orderBy(pos))
    return rows.withColumn("_row", within).join(starts.select(*book, chapter, "_before"), [*book, chapter]).withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_before", "_row")


def _before(spec):
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def interpolate_gaps(rows: DataFrame, keys: Sequence[str], pos: str = "pos", duration: str = "duration_s", least: float = 0.05) -> DataFrame:
    """rows (start_s, end_s nullable, chars) with s_start and s_end.

    A run of rows without times shares what lies between its neighbours by number of characters, `least` seconds each
    at any rate; before the first row time starts at 0, after the last it ends with the audio.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    so_far, rest = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    timed = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    out = rows.withColumn("_timed", timed).withColumn("_end", F.when(timed, F.greatest("end_s", F.col("start_s") + least)))
    out = out.withColumn("_run", F.sum(F.col("_timed").cast("int")).over(so_far)).withColumn("_left", F.coalesce(F.last("_end", True).over(so_far), F.lit(0.0)))
    out = out.withColumn("_right", F.first(F.when(F.col("_timed"), F.col("start_s")), True).over(rest))
    run = Window.partitionBy(*keys, "_run", "_timed")
    out = out.withColumn("_size", F.count(F.lit(1)).over(run)).withColumn("_chars", F.greatest("chars", F.lit(1))).withColumn("_total", F.sum("_chars").over(run))
    right = F.coalesce("_right", F.when(F.col(duration) > F.col("_left"), F.col(duration)).otherwise(F.col("_left") + 2.0 * F.col("_size")))
    share = F.greatest(F.col("_chars") / F.col("_total") * F.greatest(F.col("_size") * least, right - F.col("_left")), F.lit(least))
    ordered = run.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    # the left bound is in the first addend, so sums associate as a loop from there would
    first = F.row_number().over(run.orderBy(pos)) == 1
    out = out.withColumn("_share", share).withColumn("_add", F.when(first, F.col("_left") + F.col("_share")).otherwise(F.col("_share")))
    out = out.withColumn("_to", F.sum("_add").over(ordered))
    start = F.coalesce(F.lag("_to").over(run.orderBy(pos)), F.col("_left"))
    out = out.withColumn("s_start", F.when(F.col("_timed"), F.col("start_s")).otherwise(start)).withColumn("s_end", F.when(F.col("_timed"), F.col("_end")).otherwise(F.col("_to")))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in rows.columns])


def clamp(rows: DataFrame, keys: Sequence[str], pos: str = "pos", duration_ms: str = "duration_ms", min_ms: int = 50) -> DataFrame:
    """rows (start_ms, end_ms) made strictly forward. Each end depends on the clamped start before it, so this is a
    fold: one pass over each chapter, which is as long as a chapter and no longer."""
    floor = max(1, min_ms)
    names = rows.columns

    def fold(chapter: pd.DataFrame) -> pd.DataFrame:
        chapter = chapter.sort_values(pos, kind="stable")
        starts, ends, reached = [], [], 0
        for start, end, last in zip(chapter["start_ms"].tolist(), chapter["end_ms"].tolist(), chapter[duration_ms].tolist()):
            start = max(start, reached)
            end = end if end > start else start + floor
            reached = last if start < last < end else end
            starts.append(start)
            ends.append(reached)
        return chapter.assign(start_ms=starts, end_ms=ends)[names]

    return rows.groupBy(*keys).applyInPandas(fold, rows.schema)


def clips(rows: DataFrame, keys: Sequence[str], pos: str = "pos", continuous: bool = True) -> DataFrame:
    """rows with clip_start, clip_end and par_id. Continuous clips leave no gap: the first starts at 0, each lasts until
    the next begins."""
    order = Window.partitionBy(*keys).orderBy(pos)
    start, end = F.col("start_ms"), F.col("end_ms")
    if continuous:
        until = F.greatest(end, F.coalesce(F.lead("start_ms").over(order), end))
        start, end = F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(F.greatest("start_ms", F.lag("end_ms").over(order))), until
    return rows.withColumn("clip_start", start.cast("long")).withColumn("clip_end", end.cast("long")).withColumn("par_id", F.format_string("par_%04d", F.row_number().over(order)))


def clip_faults(rows: DataFrame, keys: Sequence[str], pos: str = "pos", continuous: bool = False) -> DataFrame:
    """Rows with a negative time, an end before the start, or, unless continuous, a start before the last one."""
    order = Window.partitionBy(*keys).orderBy(pos)
    back = F.lit(False) if continuous else F.coalesce(F.col("start_ms") < F.lag("start_ms").over(order), F.lit(False))
    fault = F.when((F.col("start_ms") < 0) | (F.col("end_ms") < 0), "negative").when(F.col("end_ms") < F.col("start_ms"), "backward").when(back, "order")
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL")


#: Rules in the order in which an entry is checked.
RULES = ("id", "duplicate id", "text", "integer", "negative", "duration", "order", "overlap", "confidence")


def violations(rows: DataFrame, book: Sequence[str], chapter: str, pos: str = "pos", allow_overlap: bool = False) -> DataFrame:
    """(book, chapter, pos, element_id, rule_no): every rule that an entry breaks, numbered from 1 as in RULES.

    Times that are not integers come as null. A fail-fast check would report first_violation().
    """
    order = Window.partitionBy(*book, chapter).orderBy(pos)
    first = F.min(F.struct(chapter, pos)).over(Window.partitionBy(*book, "element_id"))
    both = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    before = lambda c: F.lag(c).over(order)
    tests = [
        F.trim(F.coalesce("element_id", F.lit(""))) == "",
        (F.trim(F.coalesce("element_id", F.lit(""))) != "") & (first < F.struct(chapter, pos)),
        F.col("text").isNull(),
        ~both,
        both & ((F.col("start_ms") < 0) | (F.col("end_ms") < 0)),
        both & (F.col("end_ms") <= F.col("start_ms")),
        F.col("start_ms") < before("start_ms"),
        F.lit(False) if allow_overlap else F.col("start_ms") < before("end_ms"),
        F.col("confidence").isNull() | F.isnan("confidence"),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(i)) for i, t in enumerate(tests, 1)]))
    return rows.withColumn("_broken", broken).select(*book, chapter, pos, "element_id", F.explode("_broken").alias("rule_no"))


def first_violation(found: DataFrame, book: Sequence[str], chapter: str, pos: str = "pos") -> DataFrame:
    return found.groupBy(*book).agg(F.min(F.struct(chapter, pos, "rule_no")).alias("v")).select(*book, "v.*")


def durations(rows: DataFrame, book: Sequence[str], chapter: str) -> DataFrame:
    """(book, chapter, duration_ms, par_count, clock): chapters, and each book's total with a null chapter."""
    per = rows.groupBy(*book, chapter).agg(F.max("end_ms").alias("duration_ms"), F.count(F.lit(1)).alias("par_count"))
    total = per.groupBy(*book).agg(F.sum("duration_ms").alias("duration_ms"), F.sum("par_count").alias("par_count")).withColumn(chapter, F.lit(None).cast(rows.schema[chapter].dataType))
    return per.unionByName(total).withColumn("clock", hms_clock(F.col("duration_ms")))


def last_end(rows: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Duration of playlists found on disk: the end of the last clip, not the largest."""
    return rows.groupBy(*keys).agg(F.max_by("end_ms", pos).alias("duration_ms"))


def confidence(matched: Column, total: Column) -> Column:
    """Share of matched words to three places; 1 for a sentence without words."""
    return F.when(total == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), half_even(matched / total, 3))))
