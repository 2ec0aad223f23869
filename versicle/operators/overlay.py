"""Overlay documents: spans over text segments, playlists, manifests, file resolution and their checks."""

from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import smil_clock
from ..functions.text import audio_mime, basename, slug, stem


def slice_plan(segments: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg_pos, element_id, from, to, is_first): overlaps of segments (seg_pos, seg_start, seg_end) with ranges
    (element_id, char_start, char_end) of one block, offsets within the segment. The first piece bears the id."""
    met = segments.join(ranges, list(keys)).filter(F.greatest("seg_start", "char_start") < F.least("seg_end", "char_end"))
    order = Window.partitionBy(*keys, "element_id").orderBy("seg_pos")
    return met.select(
        *keys, "seg_pos", "element_id", (F.greatest("seg_start", "char_start") - F.col("seg_start")).alias("from"),
        (F.least("seg_end", "char_end") - F.col("seg_start")).alias("to"), (F.row_number().over(order) == 1).alias("is_first"),
    )


def wrap_segments(segments: DataFrame, plan: DataFrame, keys: Sequence[str], continued: str = "mo-continue") -> DataFrame:
    """(keys, seg_pos, markup): each segment's text with spans around its slices."""
    pieces = plan.groupBy(*keys, "seg_pos").agg(F.array_sort(F.collect_list(F.struct("from", "to", "element_id", "is_first"))).alias("p"))
    rows = segments.join(pieces, [*keys, "seg_pos"], "left")
    text = F.col("text")
    cut = lambda a, b: F.substring(text, a + 1, b - a)

    def mark(i: Column) -> Column:
        p = F.get("p", i)
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("p", i - 1)["to"])
        head = F.when(p["is_first"], F.concat(F.lit('<span id="'), p["element_id"], F.lit('">'))).otherwise(F.lit(f'<span class="{continued}">'))
        return F.concat(cut(before, p["from"]), head, cut(p["from"], p["to"]), F.lit("</span>"))

    n = F.size("p")
    rest = cut(F.get("p", n - 1)["to"], F.char_length(text))
    made = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), mark), ""), rest)
    return rows.select(*keys, "seg_pos", F.when(F.col("p").isNull(), text).otherwise(made).alias("markup"))


def unknown_ids(timeline: DataFrame, document_ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries whose id no document has."""
    return timeline.join(document_ids.select(*keys, "element_id"), [*keys, "element_id"], "left_anti")


def colliding_ids(document_ids: DataFrame, timeline: DataFrame, keys: Sequence[str], prefix: str = "mo_s_") -> DataFrame:
    """Ids that documents had before any were injected: those of the timeline, or of its prefix."""
    taken = timeline.select(*keys, "element_id").distinct()
    ours = document_ids.join(taken, [*keys, "element_id"], "left_semi").select(*keys, "element_id")
    return ours.unionByName(document_ids.filter(F.col("element_id").startswith(prefix)).select(*keys, "element_id")).distinct()


def unresolved_blocks(timeline: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, block_xpath, n): paths that name no block or more than one."""
    n = blocks.groupBy(*keys, "block_xpath").agg(F.count(F.lit(1)).alias("_n"))
    return timeline.select(*keys, "block_xpath").distinct().join(n, [*keys, "block_xpath"], "left").withColumn("n", F.coalesce("_n", F.lit(0))).filter("n <> 1").drop("_n")


def group_by_block(timeline: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Blocks in order of their first entry."""
    g = timeline.groupBy(*keys, "block_xpath").agg(F.min(pos).alias("first_pos"), F.array_sort(F.collect_list(F.struct(pos, "element_id"))).alias("entries"))
    return g.withColumn("block_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("first_pos")))


def best_candidate(candidates: DataFrame, keys: Sequence[str], priority: Sequence[str], value: str) -> DataFrame:
    """Ordered fallback: the value of the least priority for each key."""
    return candidates.groupBy(*keys).agg(F.min_by(value, F.struct(*priority)).alias(value))


def resolve(wanted: DataFrame, files: DataFrame, keys: Sequence[str], directories: Sequence[str] = ("EPUB", "OEBPS", "OPS")) -> DataFrame:
    """(keys, name, path): a wanted file name among files (keys, path): itself, in the usual directories in order, or
    anywhere by base name, shortest and then least path first. Null if there is none."""
    f = files.withColumn("_base", basename(F.col("path")))
    met = wanted.withColumn("_base", basename(F.col("name"))).join(f, [*keys, "_base"], "left")
    place = F.when(F.col("path") == F.col("name"), 0)
    for i, d in enumerate(directories, 1):
        place = place.when(F.col("path") == F.concat(F.lit(d + "/"), F.col("name")), i)
    met = met.withColumn("_p", place.otherwise(len(directories) + 1)).withColumn("_n", F.char_length("path"))
    return best_candidate(met, [*keys, "name"], ["_p", "_n", "path"], "path")


def playlist(pars: DataFrame, keys: Sequence[str], pos: str = "pos", text_ref: str = "text_ref") -> DataFrame:
    """(keys, smil): a media overlay from clips (par_id, clip_start, clip_end, text_ref, element_id, audio_src)."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    line = F.concat(
        F.lit('<par id="'), "par_id", F.lit('"><text src="'), esc(F.col(text_ref)), F.lit("#"), "element_id", F.lit('"/><audio src="'), esc(F.col("audio_src")),
        F.lit('" clipBegin="'), smil_clock(F.col("clip_start")), F.lit('" clipEnd="'), smil_clock(F.col("clip_end")), F.lit('"/></par>'),
    )
    g = pars.withColumn("_line", line).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("_line").alias("l")))).alias("p"), F.min(text_ref).alias("_t"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<smil xmlns="http://www.w3.org/ns/SMIL" xmlns:epub="http://www.idpf.org/2007/ops" version="3.0"><body><seq epub:textref="'), esc(F.col("_t")), F.lit('">\n'))
    return g.select(*keys, F.concat(head, F.array_join(F.transform("p", lambda x: x["l"]), "\n"), F.lit("\n</seq></body></smil>\n")).alias("smil"))


def manifest_items(paths: DataFrame, keys: Sequence[str], taken: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """(keys, pos, path, item_id, media_type): ids are slugs of the stems, with _1, _2 and so on where one is taken.

    An id with a suffix may be another's own slug, so each book's items are named in turn.
    """
    rows = paths.select(*keys, pos, "path", slug(stem(F.col("path"))).alias("base"), audio_mime(F.col("path")).alias("media_type"))
    if taken is None:
        taken = paths.select(*keys).distinct().withColumn("item_id", F.lit(None).cast("string"))
    kinds = dict(rows.dtypes)

    def name(key, items: pd.DataFrame, used: pd.DataFrame) -> pd.DataFrame:
        seen, ids = set(used["item_id"].dropna()), []
        items = items.sort_values(pos, kind="stable")
        for base in items["base"]:
            new, k = base, 0
            while new in seen:
                k += 1
                new = f"{base}_{k}"
            seen.add(new)
            ids.append(new)
        return items.assign(item_id=ids)[[*keys, pos, "path", "item_id", "media_type"]]

    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in (*keys, pos, "path", "item_id", "media_type"))
    return rows.groupBy(*keys).cogroup(taken.select(*keys, "item_id").groupBy(*keys)).applyInPandas(name, schema)


def first_distinct(rows: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """First occurrence of each value."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, value).orderBy(seq))).filter("_r = 1").drop("_r")


def link_overlays(smils: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, smil_id, item_id): the text item of each playlist: by its chapter id, by path, or by stem of the href."""
    text = items.filter(F.col("media_type").contains("html"))
    met = smils.join(text, list(keys)).withColumn("_p", F.when(F.col("chapter_id") == F.col("item_id"), 0).when(F.col("xhtml_path") == F.col("href"), 1).when(stem(F.col("xhtml_path")) == stem(F.col("href")), 2))
    return best_candidate(met.filter("_p IS NOT NULL"), [*keys, "smil_id"], ["_p", "item_id"], "item_id")


def with_svg(items: DataFrame, html: str = "html", properties: str = "properties") -> DataFrame:
    """items whose documents hold an svg element get that property."""
    has = F.contains(F.lower(html), F.lit("<svg"))
    return items.withColumn(properties, F.when(has, F.array_union(F.coalesce(properties, F.array()), F.array(F.lit("svg")))).otherwise(F.col(properties)))


def dead_links(links: DataFrame, files: DataFrame, keys: Sequence[str], instead: str = "titlepage.xhtml") -> DataFrame:
    """(keys, src, new_src): links to files that are missing, and what replaces them if the book has it."""
    gone = links.join(files.select(*keys, F.col("path").alias("src")), [*keys, "src"], "left_anti")
    has = files.filter(F.col("path") == instead).select(*keys, F.col("path").alias("new_src"))
    return gone.join(has, list(keys), "left").select(*keys, "src", "new_src")


# Fixed value: the highlight's colour unless another is asked for.
HIGHLIGHT = "#ffe58a"


def active_style(css: Column, name: str = "-epub-media-overlay-active", color: str = HIGHLIGHT) -> Column:
    """css with a rule for the active class, unless it has one; a rule alone where there is no css."""
    css = F.coalesce(css, F.lit(""))
    rule = f"\n\n.{name} {{\n  background-color: {color};\n}}\n"
    return F.when(css.contains(name), css).when(F.trim(css) == "", rule.lstrip()).otherwise(F.concat(F.regexp_replace(css, r"\s+\z", ""), F.lit(rule)))


def nav_document(entries: list[tuple[str, str]]) -> str:
    """A navigation document from (href, title)."""
    items = "\n".join(f"<li><a href={quoteattr(h)}>{escape(t)}</a></li>" for h, t in entries)
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>\n{items}\n</ol></nav></body></html>\n'
