"""Reading and writing of probe results and alignments as JSON, and audio formats by their first bytes."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import half_even

PROBE = "chapters array<struct<id:bigint,time_base:string,start:bigint,start_time:string,end:bigint,end_time:string,tags:struct<title:string>>>, format struct<duration:string,tags:struct<title:string>>"
#: Numbers are read as text, so that 12.5 becomes 12 as by a cast, and words fail.
ENTRY = "element_id:string,text:string,start_ms:string,end_ms:string,confidence:string,block_xpath:string,char_start:string,char_end:string"
ALIGNMENT = f"array<struct<spine_item_id:string,xhtml_filename:string,audio_filename:string,timeline:array<struct<{ENTRY}>>>>"


def _seconds(text: Column, ticks: Column, base: Column) -> Column:
    part = lambda i: F.get(F.split(base, "/"), F.lit(i)).try_cast("double")
    scaled = F.when(part(1) != 0, ticks * part(0) / part(1))
    return F.round(F.coalesce(text.try_cast("double"), scaled, ticks.cast("double"), F.lit(0.0)), 6)


def probe_chapters(files: DataFrame, key: str, json: str, fallback_duration: float | None = None, fallback_title: str | None = None) -> DataFrame:
    """(key, chap_pos, title, start_s, end_s): the chapters of each file's probe JSON, or one over the whole file."""
    p = files.select(key, F.from_json(json, PROBE).alias("p"))
    c = F.col("c")
    many = p.filter(F.size("p.chapters") > 0).select(key, F.posexplode("p.chapters").alias("i", "c"))
    many = many.select(key, F.col("i").alias("chap_pos"), F.coalesce(F.nullif(c["tags"]["title"], F.lit("")), F.format_string("Chapter %d", F.col("i") + 1)).alias("title"), _seconds(c["start_time"], c["start"], c["time_base"]).alias("start_s"), _seconds(c["end_time"], c["end"], c["time_base"]).alias("end_s"))
    one = p.filter(F.coalesce(F.size("p.chapters"), F.lit(0)) <= 0).select(
        key, F.lit(0).alias("chap_pos"), F.coalesce(F.nullif(F.lit(fallback_title), F.lit("")), F.nullif("p.format.tags.title", F.lit("")), F.lit("Chapter 1")).alias("title"),
        F.lit(0.0).alias("start_s"), F.round(F.coalesce(F.col("p.format.duration").try_cast("double"), F.lit(fallback_duration).cast("double"), F.lit(0.0)), 6).alias("end_s"),
    )
    return many.unionByName(one)


def audio_units(chapters: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit_pos, start_s, end_s, title): chapters with a positive duration, or the whole file (duration_s, its
    stem as title) where none has."""
    good = chapters.filter("end_s > start_s").select(key, F.col("chap_pos").alias("unit_pos"), "start_s", "end_s", "title")
    bare = files.join(good.select(key), key, "left_anti")
    whole = bare.select(key, F.lit(0).alias("unit_pos"), F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s"), F.regexp_extract(key, r"([^/]*?)(\.[^./]*)?\z", 1).alias("title"))
    return good.unionByName(whole)


def parse_alignment(source: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Timeline rows of alignment JSON: a list of chapters, or a single one."""
    text = F.trim(json)
    listed = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    c = source.select(*keys, F.posexplode(F.from_json(listed, ALIGNMENT)).alias("chapter_pos", "c"))
    e = c.select(*keys, "chapter_pos", "c.spine_item_id", "c.xhtml_filename", "c.audio_filename", F.posexplode("c.timeline").alias("pos", "e"))
    whole = lambda n: F.col(f"e.{n}").cast("double").cast("long").alias(n)
    return e.select(
        *keys, "chapter_pos", "spine_item_id", "xhtml_filename", "audio_filename", "pos", "e.element_id", "e.text", whole("start_ms"), whole("end_ms"),
        F.coalesce(F.col("e.confidence").cast("double"), F.lit(1.0)).alias("confidence"), F.coalesce("e.block_xpath", F.lit("")).alias("block_xpath"),
        F.coalesce(F.col("e.char_start").cast("double").cast("int"), F.lit(0)).alias("char_start"), F.coalesce(F.col("e.char_end").cast("double").cast("int"), F.lit(0)).alias("char_end"),
    )


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Timeline rows of alignment files, keyed by file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))
    return parse_alignment(files, ["file"], "json")


def alignment_json(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): chapters in order, entries in order, confidence to four places."""
    entry = F.struct("pos", F.struct("element_id", "text", "start_ms", "end_ms", half_even(F.col("confidence").cast("double"), 4).alias("confidence"), "block_xpath", "char_start", "char_end").alias("e"))
    head = ["spine_item_id", "xhtml_filename", "audio_filename"]
    chapters = timeline.groupBy(*keys, "chapter_pos", *head).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    chapter = F.struct("chapter_pos", F.struct(*head, F.transform("t", lambda x: x["e"]).alias("timeline")).alias("c"))
    books = chapters.groupBy(*keys).agg(F.array_sort(F.collect_list(chapter)).alias("cs"))
    return books.select(*keys, F.to_json(F.transform("cs", lambda x: x["c"])).alias("json"))


def audio_format(content: Column, path: Column, brand: Column | None = None) -> Column:
    """'.mp3', '.m4b', '.aax', '.aaxc' by a probed brand, else by the first 64 bytes, else by extension; null if none."""
    head = F.hex(F.substring(content, 1, 64))
    at = lambda i, n: F.substring(head, 2 * i + 1, 2 * n)
    brands = F.lower(brand) if brand is not None else F.lit(None).cast("string")
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    return (
        F.when(brands.contains("aaxc"), ".aaxc").when(brands.contains("aax"), ".aax").when(brands.contains("m4b") | brands.contains("m4a"), ".m4b").when(brands.contains("mp3"), ".mp3")
        .when(at(0, 3) == "494433", ".mp3").when((at(0, 1) == "FF") & (F.substring(head, 3, 1) >= "E"), ".mp3")
        .when((at(4, 4) == "66747970") & head.rlike("^(..)*61617863"), ".aaxc").when((at(4, 4) == "66747970") & (head.rlike("^(..)*61617820") | at(8, 4).contains("616178")), ".aax")
        .when(at(4, 4) == "66747970", ".m4b").when(ext.isin(".aax", ".aaxc", ".m4b", ".mp3"), ext).when(ext.isin(".m4a", ".mp4"), ".m4b")
    )
