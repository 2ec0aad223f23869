"""Registered queries over the driver's tables, and their SQL. The tables stand in for books: documents by source are
chapters of a book, events by user a timeline, pages its markup, conversations its audio units."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, text, titles
from ..operators import mapping, overlay, timeline, wordmatch
from ..sources import books, markup, packages, rewrite, timelines


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sentences(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(text.sentence_spans(F.col("text"))).alias("pos", "s"))
    return d.select("doc_id", "source", "pos", F.col("s.start").alias("char_start"), F.col("s.stop").alias("char_end"), "s.text")


def sentence_spans(spark, sf_dir):
    return _sentences(spark, sf_dir).drop("source")


def sentence_ids(spark, sf_dir):
    s = timeline.number_in_book(_sentences(spark, sf_dir), ["source"], "doc_id", "pos")
    return s.select("source", "doc_id", "pos", text.element_id(F.col("number")).alias("element_id"), "char_start", "char_end")


def word_tokens(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(text.word_tokens(F.col("text"))).alias("pos", "word"))


def word_norm(spark, sf_dir):
    w = word_tokens(spark, sf_dir).withColumn("norm", text.normal_word(F.col("word"))).filter("norm <> ''")
    return w.groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


def _titles(spark, sf_dir) -> DataFrame:
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def chapter_titles(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", markup.chapter_title("html", F.lit(None).cast("string"), F.lit(None).cast("string")).alias("title"))


def html_blocks(spark, sf_dir):
    return markup.blocks(_t(spark, sf_dir, "pages"), "page_id", "html")


def block_segments(spark, sf_dir):
    return markup.segments(_t(spark, sf_dir, "pages"), "page_id", "html")


def _lines(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def section_reasons(spark, sf_dir):
    """Titles made of an event's type or a part's words, so that every rule is met."""
    p = _t(spark, sf_dir, "part")
    words = F.array(*[F.lit(x) for x in SECTION_TITLES])
    title = F.concat(F.element_at(words, (F.col("p_partkey") % len(SECTION_TITLES) + 1).cast("int")), F.lit(" "), F.col("p_name"))
    preview = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("'"), F.col("p_name"), F.lit("' - "), F.col("p_brand"))).otherwise(F.col("p_type"))
    guide = F.when(F.col("p_size") % 11 == 0, F.element_at(F.array(F.lit("TOC"), F.lit("copyright-page"), F.lit("cover"), F.lit("text")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return p.select("p_partkey", title.alias("title"), titles.section_reason(title, preview, guide).alias("reason"))


SECTION_TITLES = [
    "Chapter", "Contents of", "Dramatis Personae", "All Rights Reserved", "Half Title", "Dedication", "Epigraph", "Books by", "Timeline", "Appendix",
    "About the Author", "Colophon", "Glossary", "Footnotes", "Preview", "Contentsof", "Part", "Notes", "Prologue", "TOC", "Act",
]


def title_numbers(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    heads = F.array(*[F.lit(x) for x in ("Ch.", "Chapter", "PT", "Bk.", "", "Scene")])
    numbers = F.array(*[F.lit(x) for x in ("Twenty-One", "XIV", "3", "first", "2nd", "iii", "Forty Two", "x")])
    t = F.concat_ws(" ", F.element_at(heads, (F.col("p_partkey") % 6 + 1).cast("int")), F.element_at(numbers, (F.floor(F.col("p_partkey") / 6) % 8 + 1).cast("int")))
    return p.select("p_partkey", t.alias("title"), titles.normal_title_udf(t).alias("normal"))


def title_fuzzy(spark, sf_dir):
    """Titles of pages next to each other."""
    w = Window.partitionBy(F.regexp_extract("url", "https?://([^/]+)", 1)).orderBy("page_id")
    t = _titles(spark, sf_dir).withColumn("normal", titles.normal_title_udf("title")).withColumn("other", F.lag("normal").over(w))
    return t.filter("other IS NOT NULL").select("page_id", "normal", "other", titles.similarity(F.col("normal"), F.col("other")).alias("similarity"))


def _events(spark, sf_dir) -> DataFrame:
    """Events by user as a timeline: pos, start_ms from the user's first event, end_ms by value."""
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL AND ts IS NOT NULL")
    user = Window.partitionBy("user_id")
    ms = clock.epoch_ms(F.col("ts"))
    e = e.select("user_id", "event_id", "event_type", F.row_number().over(user.orderBy("ts", "event_id")).alias("pos"), (F.floor((ms - F.min(ms).over(user)) / 60000)).cast("long").alias("start_ms"), F.floor(F.coalesce("value", F.lit(0.0)) * 20).cast("long").alias("_len"))
    return e.withColumn("end_ms", F.col("start_ms") + F.col("_len")).drop("_len")


def timeline_continuous(spark, sf_dir):
    return timeline.clips(_events(spark, sf_dir), ["user_id"]).select("user_id", "pos", "par_id", "clip_start", "clip_end")


def clip_faults(spark, sf_dir):
    return timeline.clip_faults(_events(spark, sf_dir).withColumn("end_ms", F.col("end_ms") - 30), ["user_id"]).select("user_id", "pos", "fault")


def timeline_clamp(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("duration_ms", F.max("start_ms").over(Window.partitionBy("user_id")) + 100)
    return timeline.clamp(e, ["user_id"]).select("user_id", "pos", "start_ms", "end_ms")


def timeline_validate(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("element_id", F.concat(F.lit("mo_s_"), (F.col("event_id") % 5000).cast("string")))
    e = e.withColumn("text", F.when(F.col("event_id") % 97 != 0, F.col("event_type"))).withColumn("confidence", F.lit(1.0)).withColumn("chapter_pos", F.lit(0))
    return timeline.violations(e, ["user_id"], "chapter_pos").select("user_id", "pos", "rule_no")


def gap_interpolate(spark, sf_dir):
    e = _events(spark, sf_dir)
    on = F.col("event_type") != "error"
    e = e.select("user_id", "pos", F.when(on, F.col("start_ms") / 1000).alias("start_s"), F.when(on, F.col("end_ms") / 1000).alias("end_s"), (F.col("event_id") % 40).alias("chars"), (F.max("end_ms").over(Window.partitionBy("user_id")) / 1000).alias("duration_s"))
    out = timeline.interpolate_gaps(e, ["user_id"])
    return out.select("user_id", "pos", clock.to_ms(F.col("s_start")).alias("start_ms"), clock.to_ms(F.col("s_end")).alias("end_ms"))


def durations_rollup(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("book_id", F.col("user_id") % 10)
    return timeline.durations(e, ["book_id"], "user_id").withColumn("user_id", F.coalesce("user_id", F.lit(-1)).cast("long"))


def last_clip_end(spark, sf_dir):
    return timeline.last_end(_events(spark, sf_dir), ["user_id"])


def clocks(spark, sf_dir):
    e = _events(spark, sf_dir).filter("start_ms >= 0")
    c = clock.smil_clock(F.col("start_ms"))
    return e.select("event_id", c.alias("smil"), clock.hms_clock(F.col("start_ms") * 61).alias("hms"), F.rint(clock.parse_clock(clock.hms_clock(F.col("start_ms") * 61)) * 1000).cast("long").alias("parsed_ms"), F.rint(clock.parse_clock(c) * 1000).cast("long").alias("smil_ms"))


def positional_map(spark, sf_dir):
    chapters = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("book_id"), F.col("n_nationkey").alias("chapter_pos"))
    units = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).cast("int").alias("book_id"), F.col("s_suppkey").alias("unit_pos"))
    pairs = mapping.positional(chapters, units, ["book_id"], "chapter_pos", "unit_pos")
    return pairs.select(F.col("book_id").cast("long").alias("book_id"), "rank", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("chapter_pos", "unit_pos")])


def _book_titles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A book for every 20 parts: some chapters with front matter, and audio units for the others."""
    p = _t(spark, sf_dir, "part").withColumn("book_id", F.floor(F.col("p_partkey") / 20)).withColumn("k", (F.col("p_partkey") % 20).cast("int"))
    front = F.array(*[F.lit(x) for x in ("Contents", "Dedication", "Title Page", "Copyright")])
    title = F.when(F.col("k") < 4, F.element_at(front, F.least(F.col("k") + 1, F.lit(4)))).otherwise(F.concat(F.lit("Chapter "), (F.col("k") - 3).cast("string"), F.lit(": "), F.col("p_name")))
    chapters = p.select("book_id", F.col("p_partkey").alias("chapter_pos"), title.alias("title"), F.lit("").alias("preview"), F.lit(None).cast("string").alias("guide_type"))
    heard = p.filter("k >= 4 AND (k <> 9 OR book_id % 2 = 0)")
    units = heard.select("book_id", F.col("p_partkey").alias("unit_pos"), F.when(F.col("k") == 4, F.lit("Opening Credits")).otherwise(F.concat(F.lit("Ch. "), (F.col("k") - 3).cast("string"))).alias("title"))
    return chapters, units


def subsequence_map(spark, sf_dir):
    return mapping.by_titles(*_book_titles(spark, sf_dir))


def unit_map(spark, sf_dir):
    return mapping.map_units(*_book_titles(spark, sf_dir))


def manual_map(spark, sf_dir):
    """The chapters of each region in reverse order, by a mapping of indexes."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("book_id"), F.col("n_nationkey").alias("chapter_pos"))
    hand = n.select("book_id", (F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_pos")) - 1).alias("chapter_index"), (F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("chapter_pos"))) - 1).alias("unit_index"))
    return mapping.by_hand(n, n.withColumnRenamed("chapter_pos", "unit_pos"), hand, ["book_id"], "chapter_pos", "unit_pos").select("book_id", "chapter_index", "unit_index", "chapter_pos", "unit_pos")


def _heard(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as sentences, and their words as heard: every ninth missed, every seventh without a time."""
    c = _t(spark, sf_dir, "conversations")
    s = c.select("conv_id", F.col("turn").cast("long").alias("pos"), "text", F.lit(600.0).alias("duration_s"))
    w = wordmatch.sentence_words(s, ["conv_id"]).withColumn("heard_pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("word_pos")).cast("long"))
    w = w.filter("heard_pos % 9 <> 0").withColumnRenamed("norm", "word")
    at = F.when(F.col("heard_pos") % 7 != 0, F.col("heard_pos") * 0.25)
    return s, w.select("conv_id", "heard_pos", "word", at.alias("start_s"), (at + 0.2).alias("end_s"))


def word_match(spark, sf_dir):
    s, h = _heard(spark, sf_dir)
    return wordmatch.match_words(wordmatch.sentence_words(s, ["conv_id"]), h.withColumn("norm", text.normal_word(F.col("word"))), ["conv_id"])


def sentence_align(spark, sf_dir):
    s, h = _heard(spark, sf_dir)
    return wordmatch.align_sentences(s, h, ["conv_id"]).select("conv_id", "pos", "start_ms", "end_ms", "matched", "n_words", "confidence")


def _segments(spark, sf_dir) -> DataFrame:
    line = _lines(spark, sf_dir)
    upto = F.sum(F.char_length("line") + 1).over(Window.partitionBy("doc_id").orderBy("pos"))
    return line.select("doc_id", F.col("pos").alias("seg_pos"), (upto - F.char_length("line") - 1).alias("seg_start"), (upto - 1).alias("seg_end"), F.col("line").alias("text"))


def _ranges(spark, sf_dir) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("element_id"), "char_start", "char_end")


def span_overlap(spark, sf_dir):
    return overlay.slice_plan(_segments(spark, sf_dir), _ranges(spark, sf_dir), ["doc_id"])


def wrapped_segments(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return overlay.wrap_segments(s, overlay.slice_plan(s, _ranges(spark, sf_dir), ["doc_id"]), ["doc_id"])


def skip_filter(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    skipped = _t(spark, sf_dir, "labels").filter("quality = 0").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("id"))
    return mapping.without(d, skipped)


def id_checks(spark, sf_dir):
    """Labelled ids without a document that is long enough, as timeline entries without a place in the text."""
    d = _t(spark, sf_dir, "documents").filter("n_chars > 500").select("lang", F.col("doc_id").alias("element_id"))
    tl = _t(spark, sf_dir, "labels").select(F.lit("en").alias("lang"), F.col("doc_id").alias("element_id"))
    return overlay.unknown_ids(tl, d, ["lang"])


def id_collisions(spark, sf_dir):
    ids = _t(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("book_id"), F.when(F.col("event_id") % 3 == 0, text.element_id(F.col("event_id"))).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("element_id"))
    tl = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("book_id"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("element_id"))
    return overlay.colliding_ids(ids, tl, ["book_id"])


def element_ids(spark, sf_dir):
    e = F.concat(F.element_at(F.array(F.lit("mo_s_"), F.lit("mo_s_00"), F.lit("x_s_"), F.lit("mo_s_-")), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", e.alias("element_id"), text.is_element_id(e).alias("valid"), F.coalesce(text.element_number(e), F.lit(-1)).alias("number"))


def probe_json(spark, sf_dir):
    """Chapters of probe results built from events: by string times, by ticks, or none."""
    e = _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k IS NOT NULL")
    a = F.format_string('{"start":%d,"end":%d,"time_base":"1/1000","tags":{"title":"Part %d"}}', "k", F.col("k") + 500, F.col("event_id") % 10)
    b = F.format_string('{"start_time":"%d.5","end_time":"%d","time_base":"1/0"}', "k", F.col("k") + 9)
    j = F.when(F.col("event_id") % 3 == 0, F.format_string('{"chapters":[],"format":{"duration":"%d.25"}}', "k")).otherwise(F.concat(F.lit('{"chapters":['), a, F.lit(","), b, F.lit("]}")))
    return timelines.probe_chapters(e.select("event_id", j.alias("json")), "event_id", "json")


def audio_units(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.format_string("/audio/file_%d.m4b", F.col("event_id") % 2000).alias("path"), F.col("event_id").alias("chap_pos"), F.lit(1.0).alias("start_s"), (F.col("user_id") % 3).cast("double").alias("end_s"), "event_type")
    files = e.select("path").distinct().withColumn("duration_s", F.lit(42.5))
    return timelines.audio_units(e.withColumnRenamed("event_type", "title"), files)


def alignment_json(spark, sf_dir):
    """Timeline rows written as alignment JSON for each user, and read again."""
    e = _events(spark, sf_dir)
    e = e.select("user_id", (F.col("pos") % 3).alias("chapter_pos"), F.format_string("c%d", F.col("pos") % 3).alias("spine_item_id"), F.lit("a.xhtml").alias("xhtml_filename"), F.lit("a.mp3").alias("audio_filename"), "pos", text.element_id(F.col("event_id")).alias("element_id"), F.col("event_type").alias("text"), "start_ms", "end_ms", (F.col("event_id") % 8 / 8).alias("confidence"), F.lit("/p").alias("block_xpath"), F.lit(0).alias("char_start"), F.lit(4).alias("char_end"))
    back = timelines.parse_alignment(timelines.alignment_json(e, ["user_id"]), ["user_id"], "json")
    return back.select("user_id", "spine_item_id", "element_id", "text", "start_ms", "end_ms", "confidence", "char_end")


def playlists(spark, sf_dir):
    p = timeline.clips(_events(spark, sf_dir), ["user_id"])
    p = p.select("user_id", "pos", "par_id", "clip_start", "clip_end", F.lit("text/a&b.xhtml").alias("text_ref"), text.element_id(F.col("event_id")).alias("element_id"), F.lit("audio/a.mp3").alias("audio_src"))
    return overlay.playlist(p, ["user_id"])


def mime_lookup(spark, sf_dir):
    ext = F.array(*[F.lit(x) for x in (".mp3", ".M4B", ".ogg", ".wav", ".xyz", "", ".m4a", ".AAC")])
    path = F.concat(F.lit("audio/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(ext, (F.col("p_partkey") % 8 + 1).cast("int")))
    return _t(spark, sf_dir, "part").select("p_partkey", text.audio_mime(path).alias("media_type"))


def unique_ids(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("book_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("a/"), F.col("p_brand"), F.lit(".mp3")).alias("path"))
    return overlay.manifest_items(p, ["book_id"])


def first_distinct(spark, sf_dir):
    s = _t(spark, sf_dir, "part").select("p_size", "p_brand", "p_partkey")
    return overlay.first_distinct(s, ["p_size"], "p_brand", "p_partkey")


def best_file(spark, sf_dir):
    """Files by base name in folders, resolved by the order of the usual places."""
    p = _t(spark, sf_dir, "part").withColumn("book_id", F.col("p_partkey") % 50).withColumn("name", F.concat(F.lit("c"), (F.col("p_size") % 5).cast("string"), F.lit(".xhtml")))
    d = F.array(*[F.lit(x) for x in ("EPUB/", "OEBPS/", "OPS/", "other/deep/", "")])
    files = p.select("book_id", F.concat(F.element_at(d, (F.col("p_partkey") % 5 + 1).cast("int")), "name").alias("path")).distinct()
    return overlay.resolve(p.select("book_id", "name").distinct(), files, ["book_id"])


def block_groups(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "pos", F.concat(F.lit("/p["), (F.col("event_id") % 5).cast("string"), F.lit("]")).alias("block_xpath"), F.col("event_id").alias("element_id"))
    return overlay.group_by_block(e, ["user_id"]).select("user_id", "block_xpath", "first_pos", "block_rank", F.size("entries").alias("n"))


def block_checks(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.concat(F.lit("/p["), (F.col("event_id") % 5).cast("string"), F.lit("]")).alias("block_xpath"))
    b = _t(spark, sf_dir, "events").select("user_id", F.concat(F.lit("/p["), (F.col("event_id") % 4).cast("string"), F.lit("]")).alias("block_xpath"))
    return overlay.unresolved_blocks(e, b, ["user_id"])


def svg_items(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("<SVG/>"))).otherwise(F.col("html")).alias("html"), F.array(F.lit("scripted")).alias("properties"))
    return overlay.with_svg(p).select("page_id", F.array_join("properties", " ").alias("properties"))


def paths(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", text.basename(u).alias("basename"), text.slug(text.basename(u)).alias("slug"), text.href_path(F.concat(u, F.lit("#part"))).alias("path"))


def readable_durations(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", clock.readable(F.col("start_ms").cast("double")).alias("text"))


def total_chars(spark, sf_dir):
    """Characters of every unmatched run, and documents and sentences for each language."""
    s = _sentences(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_distinct("doc_id").alias("n_chapters"), F.sum(F.col("char_end") - F.col("char_start")).alias("n_chars"))


def previews(spark, sf_dir):
    """First three sentences of each document."""
    s = _sentences(spark, sf_dir).filter("pos < 3")
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("preview"))


def _pick(values: list[str | None], at) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def rewritten_documents(spark, sf_dir):
    """Documents as one paragraph each, with a span around every sentence."""
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<p>"), esc, F.lit("</p>")).alias("markup"))
    return rewrite.rewrite(d, _ranges(spark, sf_dir).withColumn("block_xpath", F.lit("/p[1]")), ["doc_id"])


def chapter_playlists(spark, sf_dir):
    """Playlists of books whose chapters are users' events."""
    e = _events(spark, sf_dir)
    name = lambda kind: F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(kind))
    rows = e.select((F.col("user_id") % 10).alias("book_id"), F.col("user_id").alias("chapter_pos"), name("").alias("spine_item_id"), name(".xhtml").alias("xhtml_filename"), name(".mp3").alias("audio_filename"), "pos", text.element_id(F.col("event_id")).alias("element_id"), "start_ms", "end_ms")
    heads = rows.select("book_id", "xhtml_filename", "audio_filename").distinct()
    files = heads.select("book_id", F.explode(F.array(F.concat(F.lit("OEBPS/text/"), "xhtml_filename"), F.concat(F.lit("OEBPS/audio/"), "audio_filename"))).alias("path"))
    return packages.chapter_playlists(files, rows)


def relative_paths(spark, sf_dir):
    k = F.col("p_partkey")
    path, folder = F.concat(_pick(["a/b/", "a/", "", "a/d/e/"], k), F.replace("p_brand", F.lit("#"), F.lit("-"))), _pick(["a/b", "a", "", "a/d/f", "z"], k)
    return _t(spark, sf_dir, "part").select("p_partkey", path.alias("path"), folder.alias("folder"), text.relative(path, folder).alias("relative"))


def reading_order(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("book_id", F.col("p_partkey") % 50)
    refs = p.select("book_id", F.col("p_partkey").alias("ref_pos"), F.concat(F.lit("i"), (F.floor(F.col("p_partkey") / 50) % 60).cast("string")).alias("idref"))
    items = p.select("book_id", F.col("p_partkey").alias("item_pos"), F.concat(F.lit("i"), F.col("p_size").cast("string")).alias("id"), F.concat(F.lit("t/"), F.col("p_partkey").cast("string"), _pick([".xhtml", ".html", ".css", ".HTML", ".ncx"], F.col("p_partkey"))).alias("href"), _pick(["application/xhtml+xml", "text/css", "Text/HTML"], F.floor(F.col("p_partkey") / 5)).alias("media_type"))
    return books.join_manifest(refs, items, ["book_id"])


def spine_labels(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    spine = pages.select((F.col("page_id") % 20).cast("long").alias("book_id"), F.col("page_id").alias("spine_pos"), F.concat(F.lit("text/p"), (F.col("page_id") % 30).cast("string"), F.lit(".xhtml#a")).alias("href"))
    k = F.col("p_partkey")
    nav = _t(spark, sf_dir, "part").select((k % 20).cast("long").alias("book_id"), F.concat(_pick(["text/p", "p"], F.floor(k / 20)), (F.col("p_size") % 40).cast("string"), F.lit(".xhtml")).alias("target"), F.when(k % 7 != 0, F.col("p_name")).otherwise("").alias("label"), _pick(["toc", "toc", "guide"], k).alias("kind"), k.alias("seq"))
    return books.labelled(spine, nav).select("spine_pos", "book_id", F.coalesce("label", F.lit("-")).alias("label"), F.coalesce("guide_type", F.lit("-")).alias("guide_type"))


def audio_formats(spark, sf_dir):
    k = F.col("p_partkey")
    heads = ["494433", "FFFB90", "00000020667479704D344220", "000000206674797061617863", "000000206674797061617820", "", "00", "FFD8"]
    path = F.concat(F.lit("a/"), F.col("p_brand"), _pick([".mp3", ".M4A", ".aaxc", ".wav", ".mp4"], F.floor(k / 8)))
    found = timelines.audio_format(F.unhex(_pick(heads, k)), path, _pick([None, None, None, "M4B ", "aaxc", "aax ", "mp3"], k))
    return _t(spark, sf_dir, "part").select("p_partkey", F.coalesce(found, F.lit("-")).alias("format"))


def dead_links(spark, sf_dir):
    p, s = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    links = p.select((F.col("p_partkey") % 40).alias("book_id"), F.concat(F.lit("t"), F.col("p_size").cast("string"), F.lit(".xhtml")).alias("src")).distinct()
    files = s.select((F.col("s_suppkey") % 40).alias("book_id"), F.concat(F.lit("t"), (F.col("s_suppkey") % 50).cast("string"), F.lit(".xhtml")).alias("path")).distinct()
    files = files.unionByName(s.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") % 40).alias("book_id"), F.lit("titlepage.xhtml").alias("path")).distinct())
    return overlay.dead_links(links, files, ["book_id"]).select(F.col("book_id").cast("long").alias("book_id"), "src", F.coalesce("new_src", F.lit("-")).alias("new_src"))


def overlay_links(spark, sf_dir):
    """Books of twenty parts: playlists find their text by id, by path or by the stem of its name."""
    p = _t(spark, sf_dir, "part").withColumn("book_id", F.floor(F.col("p_partkey") / 20))
    k, at = F.col("p_partkey"), lambda c: c.cast("string")
    smils = p.select("book_id", F.concat(F.lit("s"), at(k)).alias("smil_id"), F.concat(F.lit("c"), at(F.col("p_size"))).alias("chapter_id"), F.concat(F.lit("x/p"), at(k % 17), F.lit(".xhtml")).alias("xhtml_path"))
    items = p.select("book_id", F.concat(F.lit("c"), at(k % 50)).alias("item_id"), F.concat(_pick(["x/p", "y/p"], k), at(F.col("p_size") % 17), F.lit(".xhtml")).alias("href"), _pick(["application/xhtml+xml", "text/html", "text/css"], k).alias("media_type"))
    return overlay.link_overlays(smils, items, ["book_id"])


def active_styles(spark, sf_dir):
    css = F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 1, ".-epub-media-overlay-active {}").when(F.col("p_partkey") % 4 == 2, "").otherwise(F.concat(F.lit("p {} /* "), "p_name", F.lit(" */ \n\n")))
    return _t(spark, sf_dir, "part").select("p_partkey", overlay.active_style(css).alias("css"))


def chapters_with_text(spark, sf_dir):
    """Documents that have sentences, as chapters."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    return mapping.with_sentences(d, _sentences(spark, sf_dir), ["doc_id"])


NAMES = [
    sentence_spans, sentence_ids, word_tokens, word_norm, chapter_titles, html_blocks, block_segments, section_reasons, title_numbers, title_fuzzy,
    timeline_continuous, clip_faults, timeline_clamp, timeline_validate, gap_interpolate, durations_rollup, last_clip_end, clocks, positional_map,
    subsequence_map, unit_map, manual_map, word_match, sentence_align, span_overlap, wrapped_segments, skip_filter, id_checks, id_collisions, element_ids,
    probe_json, audio_units, alignment_json, playlists, mime_lookup, unique_ids, first_distinct, best_file, block_groups, block_checks, svg_items, paths,
    readable_durations, total_chars, previews, rewritten_documents, chapter_playlists, relative_paths, reading_order, spine_labels, audio_formats, dead_links,
    overlay_links, active_styles, chapters_with_text,
]


#: Counted columns are longs in results, as they are in SQL.
LONGS = {"pos", "char_start", "char_end", "seg_pos", "first_pos", "block_rank", "chapter_index", "unit_index", "rank"}


def _with_longs(query):
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if c in LONGS and kind == "int"})

    return run


def queries() -> dict:
    return {f.__name__: _with_longs(f) for f in NAMES}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
